"""Decontamination, Jaccard join, substring dedup, HTML text, toxicity and the pipeline."""

import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from streamloom.llm import common, decontamination, html_text, jaccard_join, queries, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(*texts, start=1):
    return [(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, ties, empty and very long texts, extra columns with names of results."""
    rng = random.Random(9)
    long_ = words(rng, 40_000)
    data = [(1, "a b", None, None, 3), (1, "a b", None, None, 3), (None, "a b", "en", "s", 3), (None, None, None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, long_, "en", "s", 1), (5, long_ + " more", "en", "s", 1), (6, "x" * 200_000, "en", "s", 1), (7, "...!!", "en", "s", 1)]
    return spark.createDataFrame(data, SCHEMA).withColumns({"class_id": F.lit(0), "item_id": F.lit("z"), "score": F.lit(None).cast("double"), "id": F.lit(1), "k1": F.lit(2)})


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# ---------------------------------------------------------------- word hashes


def test_word_hashes():
    texts = ["Ab c, d2 éÀ\nz", "", None, "q w e r t y", "ab C", "a", "..."]
    w = common.Words(pa.array(texts))
    split = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower()) for t in texts]
    assert np.diff(w.first).tolist() == [len(s) for s in split]
    by_word = {}
    for word, h in zip((x for s in split for x in s), w.hashes.tolist(), strict=True):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert np.diff(w.shingles(3)[1]).tolist() == [max(0, len(s) - 2) for s in split]
    assert np.diff(w.shingles(3, short=True)[1]).tolist() == [max(min(1, len(s)), len(s) - 2) for s in split]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2060)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.v: r.label for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for a, b in edges if a != b for v in (a, b)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- decontamination


def plain_tiles(doc, item, least):
    used_d, used_i, total = set(), set(), 0
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in used_i and d + n not in used_d:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, d)
        if best is None:
            return total
        n, i, d = best
        used_i.update(range(i, i + n))
        used_d.update(range(d, d + n))
        total += n


def test_tiles_equal_plain_tiling(spark):
    rng = random.Random(6)
    for _ in range(40):
        item = [rng.choice("abcdef") + str(rng.randrange(4)) for _ in range(25)]
        cut = rng.randrange(5, 20)
        doc = [rng.choice("xyz") for _ in range(6)] + item[cut:] + ["q"] + item[:cut] + item[3:12]
        rng.random() < 0.5 and doc.insert(9, "w")
        x, y = (common.Words(pa.array([" ".join(t)])).hashes for t in (doc, item))
        got = decontamination.tiles(x, y, 5)
        assert sum(t[2] for t in got) == plain_tiles(doc, item, 5)
        assert all(doc[a : a + n] == item[b : b + n] for a, b, n in got)


def test_repeated_words_cost_no_product(spark):
    """A text of one word against an item of it, and many items with a shared opening: memory stays small."""
    started = time.monotonic()
    same = decontamination.Seeds([1], ["w " * 400], 5)
    found = list(decontamination._pairs(pa.array(["w " * 32_000]), same, 0.5))
    assert [(x[0], x[1], x[2]) for x in found] == [(0, 1, 1.0)]
    rng = random.Random(3)
    opening = words(rng, 20)
    many = decontamination.Seeds(list(range(20_000)), [f"{opening} {words(rng, 30)}" for _ in range(20_000)], 5)
    assert list(decontamination._pairs(pa.array([f"{words(rng, 9)} {opening}"] * 20), many, 0.5)) == []
    assert time.monotonic() - started < 60


def test_find_contaminated(spark, docs, odd, monkeypatch):
    rng = random.Random(2)
    a, b, c = words(rng, 30), words(rng, 20), "too short"
    parts = a.split()
    shuffled = " ".join(parts[15:] + ["between"] + parts[:15])
    d = spark.createDataFrame(rows(f"start {a.upper()}, end", shuffled, f"{a} and {b}", words(rng, 100), " ".join(parts[:10]), None, "", c), SCHEMA)
    items = spark.createDataFrame([(10, a), (11, b), (12, c), (13, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.coverage, 2), r.n_tiles) for r in decontamination.find(d, items).collect()}
    assert got == {(1, 10): (1.0, 1), (2, 10): (1.0, 2), (3, 10): (1.0, 1), (3, 11): (1.0, 1)}
    clean = decontamination.without_contaminated(d, items)
    assert sorted(r.doc_id for r in clean.collect()) == [4, 5, 6, 7, 8] and clean.columns == d.columns
    monkeypatch.setattr(decontamination, "BLOCK_SEEDS", 10)  # a block for each item
    assert {(r.doc_id, r.item_id) for r in decontamination.find(d, items).collect()} == set(got)
    assert sorted(r.doc_id for r in decontamination.without_contaminated(d, items).collect()) == [4, 5, 6, 7, 8]
    assert decontamination.find(odd, items).count() == 0 and decontamination.find(d.where("false"), items).count() == 0
    assert decontamination.find(d, items.where("false")).count() == 0


def test_decontamination_equals_brute_force(spark, sf, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    w = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    grams = {i: {tuple(x[k : k + 5]) for k in range(len(x) - 4)} for i, x in ((i, w(t)) for i, t in items.items())}
    for r in docs.collect():
        x = w(r.text)
        own = {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
        for i, g in grams.items():
            if g & own and plain_tiles(x, w(items[i]), 5) >= 0.5 * len(w(items[i])):
                want.add((r.doc_id, i))
    assert {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, sf).collect()} == want


# ---------------------------------------------------------------- Jaccard join


def plain_classes(pairs):
    texts = [t or "" for _, t in pairs]
    values, at = common.Words(pa.array(texts)).shingles(short=True)
    sets = [set(values[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    root = list(range(len(texts)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    links = [set() for _ in texts]
    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if texts[i] == texts[j]:
                root[find(i)] = find(j)
            elif n and n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                root[find(i)] = find(j)
                links[i].add(texts[j])
                links[j].add(texts[i])
    least = {}
    for i, (d, _) in enumerate(pairs):
        least[find(i)] = min(x for x in (least.get(find(i)), d) if x is not None) if d is not None or find(i) in least else None
    return sorted(((d, least[find(i)], len(links[i])) for i, (d, _) in enumerate(pairs)), key=repr)


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        x = base.split()
        for _ in range(rng.randrange(edits + 1)):
            x[rng.randrange(len(x))] = words(rng, 1)
        out.append(" ".join(x))
    return out


def test_join_equals_brute_force(spark, monkeypatch):
    """Groups above the leaf and block sizes, copies, texts that share a passage, short texts."""
    monkeypatch.setattr(jaccard_join, "LEAF", 20)
    rng = random.Random(8)
    passage = words(rng, 40)
    texts = near_copies(rng, words(rng, 150), 150, 2) + near_copies(rng, words(rng, 60), 12, 3) + [words(rng, 80)] * 30
    texts += [f"{words(rng, 30)} {passage} {words(rng, 30)}" for _ in range(60)] + ["a b", "A, b", "a b c", "", "...", "a b"]
    pairs = list(enumerate(texts))
    rng.shuffle(pairs)
    df = spark.createDataFrame([(i, t) for i, t in pairs], "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(df).collect()), key=repr)
    assert got == plain_classes(pairs)


def test_large_groups_of_equal_shingles(spark):
    # one text each with other marks between the words: equal sets, and more of them than a leaf holds
    rng, n, groups = random.Random(16), jaccard_join.LEAF + 1, 16
    texts = []
    for _ in range(groups):
        w = words(rng, 12).split()
        texts += ["".join(x + (", " if k >> i & 1 else " ") for i, x in enumerate(w)) for k in range(n)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows(*texts), SCHEMA)).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(1 + i, 1 + i // n * n, n - 1) for i in range(n * groups)}


def test_join_on_test_data(spark, sf, docs):
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in queries.op8_jaccard_join(spark, sf).collect()), key=repr)
    assert got == plain_classes(pairs)


def test_join_of_odd_rows(odd):
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(odd).collect()), key=repr)
    assert got == sorted([(1, 1, 0), (1, 1, 0), (None, 1, 0), (None, 2, 0), (2, 2, 0), (3, 2, 0), (4, 4, 1), (5, 4, 1), (6, 6, 0), (7, 7, 0)], key=repr)
    assert jaccard_join.near_duplicates(odd.where("false")).count() == 0
    kept = jaccard_join.one_of_each(odd)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 6, 7] and kept.columns == odd.columns


def test_workers_give_memory_back():
    """A task's end returns freed memory; a worker that kept it would add up with later stages'."""
    import psutil

    def run(batches):
        for b in batches:
            pieces = [bytes(1000) for _ in range(100_000)]
            rest = pieces[::1000]
            del pieces
            yield b.slice(0, len(rest))

    before = psutil.Process().memory_info().rss
    assert sum(b.num_rows for b in common.tidy(run)(iter([pa.RecordBatch.from_pydict({"x": range(200)})]))) == 100
    assert psutil.Process().memory_info().rss - before < 40_000_000


# ---------------------------------------------------------------- substrings


def tree(v, lo, hi, least, out):
    if hi - lo + 1 >= least:
        m = min(range(lo, hi + 1), key=lambda i: (v[i], i))
        out.append((lo, m, hi))
        tree(v, lo, m - 1, least, out)
        tree(v, m + 1, hi, least, out)


@pytest.mark.parametrize("least", [1, 2, 7, 46])
def test_compact_windows_equal_the_tree(least):
    rng = random.Random(least)
    sizes = [57, 0, 5, 200, 46]
    values, at = np.array([rng.randrange(2**64) for _ in range(sum(sizes))], np.uint64), np.r_[0, np.cumsum(sizes)]
    got = sorted(zip(*(x.tolist() for x in substrings.compact_windows(values, at, least, 1)), strict=True))
    want = []
    for d in range(len(sizes)):
        v = (((values[at[d] : at[d + 1]] >> np.uint64(32)).astype(np.uint32) ^ substrings._XOR[1]) * substrings._ODD[1]).tolist()
        nodes = []
        if v:
            tree(v, 0, len(v) - 1, least, nodes)
        want += [(d, *n) for n in nodes]
    assert got == sorted(want)


def test_passages(spark):
    rng = random.Random(5)
    p = words(rng, 60)
    changed = p.split()
    changed[30] = "changed"
    t = [f"{words(rng, 80)} {p} {words(rng, 50)}", f"{words(rng, 20)} {p.upper()}", words(rng, 200), f"{' '.join(changed)} {words(rng, 30)}", " ".join(p.split()[:40]) + words(rng, 40)]
    d = spark.createDataFrame(rows(*t), SCHEMA)
    found = substrings.find(d)
    got = {(r.doc_id, r.kept_id): [(x.first_word, x.last_word) for x in r.passages] for r in found.collect()}
    assert got == {(2, 1): [(20, 79)], (4, 1): [(0, 59)]}
    cut = {r.doc_id: r for r in substrings.cut(d, found).collect()}
    assert cut[1].text == t[0] and cut[3].text == t[2] and len(cut) == 5
    assert cut[2].text.split() == t[1].split()[:20] and cut[2].n_chars == len(cut[2].text)


def shingled(*texts):
    values, at = common.Words(pa.array(texts)).shingles()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def test_passages_of_repeated_lines():
    rng = random.Random(5)
    line = words(rng, 20)
    for times in (3, 5, 8):
        copy = " ".join([line] * times)
        first, later = shingled(f"{words(rng, 70)} {copy} {words(rng, 40)}", f"{words(rng, 30)} {copy} {words(rng, 30)}")
        found = substrings.passages(first, later, 46, 0.8)
        assert [(l, r) for l, r, *_ in found] == [(30, 30 + 20 * times - 5)]
    # more than half of the passage stands further up as well
    copy = words(rng, 64)
    quoted = " ".join(copy.split()[:40])
    first, later = shingled(f"{quoted} {words(rng, 300)} {copy}", f"{words(rng, 30)} {copy}")
    assert substrings.passages(first, later, 46, 0.8) == [(30, 89, 340, 399, 1.0)]


def test_passages_with_an_insertion():
    rng = random.Random(8)
    copy = words(rng, 98).split()
    mended = " ".join([*copy[:49], words(rng, 8), *copy[49:]])
    first, later = shingled(f"{words(rng, 60)} {' '.join(copy)} {words(rng, 60)}", f"{words(rng, 30)} {mended} {words(rng, 30)}")
    assert substrings.passages(first, later, 46, 0.8) == [(30, 131, 60, 153, 90 / 106)]


def test_candidates_of_near_copies_at_the_limit():
    # 50 words, one of them changed: Jaccard 41/51
    rng, pairs = random.Random(21), []
    for _ in range(600):
        copy = words(rng, 50).split()
        pairs.append((f"{words(rng, 30)} {' '.join(copy)} {words(rng, 30)}", f"{words(rng, 20)} {' '.join([*copy[:25], words(rng, 1), *copy[26:]])} {words(rng, 40)}"))
    values, at = common.Words(pa.array([t for p in pairs for t in p])).shingles()
    agreed = np.zeros(len(pairs), int)
    for k in range(substrings.HASHES):
        text, _, centre, _ = substrings.compact_windows(values, at, 46, k)
        held = [set() for _ in at[1:]]
        for t, v in zip(text.tolist(), values[at[text] + centre].tolist(), strict=True):
            held[t].add(v)
        agreed += [bool(a & b) for a, b in zip(held[::2], held[1::2], strict=True)]
    assert all(substrings.passages(*shingled(*p), 46, 0.8) for p in pairs)
    assert (agreed >= substrings.AGREE).mean() >= 0.99


def test_repeats_in_test_data(spark, sf, docs):
    """Every document with 50 words in a row that an earlier one has is found, and the others repeat much."""
    texts = {r.doc_id: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (r.text or "").lower()) for r in docs.collect()}
    seen, want = {}, set()
    for i in sorted(texts):
        for k in range(len(texts[i]) - 49):
            if seen.setdefault(tuple(texts[i][k : k + 50]), i) != i:
                want.add(i)
    found = queries.op9_substrings(spark, sf).collect()
    assert want <= {r.doc_id for r in found}
    for r in found:
        for p in r.passages:
            a, b = texts[r.doc_id][p.first_word : p.last_word + 1], texts[r.kept_id][p.kept_first : p.kept_last + 1]
            x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
            assert len(a) >= 50 and len(x & y) / len(x | y) >= 0.8 - 1e-9


def test_recall_of_near_passages(spark):
    """Families of near passages (some under the limit, some at it, some verbatim) against all pairs by brute force."""
    rng, texts = random.Random(33), []
    boiler = [words(rng, 22) for _ in range(3)]
    for _ in range(25):
        base = words(rng, rng.choice([52, 60, 90])).split()
        for edits in (0, 1, 1, 2, 3, 3, 4):
            x = list(base)
            for _ in range(edits):
                x[rng.randrange(len(x))] = words(rng, 1)
            copy = " ".join(x)
            texts.append(f"{words(rng, rng.randrange(60))} {rng.choice(boiler)} {copy} {rng.choice(boiler)} {words(rng, rng.randrange(60))}")
    rng.shuffle(texts)
    own = shingled(*texts)
    want = {j: [i for i in range(j) if np.intersect1d(own[i], own[j]).size >= 20 and substrings.passages(own[i], own[j], 46, 0.8)] for j in range(len(texts))}
    want = {j: set(x) for j, x in want.items() if x}
    found = [(r.doc_id - 1, r.kept_id - 1) for r in substrings.find(spark.createDataFrame(rows(*texts), SCHEMA)).collect()]
    assert all(i in want[j] for j, i in found)
    assert len({j for j, _ in found}) >= 0.93 * len(want)


def test_next_holder(spark):
    """A version just under the limit holds the signatures first; the verbatim pair behind it is still found."""
    rng, texts = random.Random(34), []
    for _ in range(40):
        copy = words(rng, 55).split()
        near = list(copy)
        near[18], near[36] = words(rng, 1), words(rng, 1)
        texts += [" ".join(near), f"{words(rng, 30)} {' '.join(copy)}", f"{' '.join(copy)} {words(rng, 30)}"]
    found = {(r.doc_id, r.kept_id) for r in substrings.find(spark.createDataFrame(rows(*texts), SCHEMA)).collect()}
    assert found == {(i + 3, i + 2) for i in range(0, 120, 3)}


def test_holder_behind_many(spark):
    """However many unlike versions hold the signatures first, the verbatim pair behind them is found."""
    rng, texts, n = random.Random(35), [], 9
    for _ in range(20):
        copy = words(rng, 55).split()
        for _ in range(n - 2):
            near = list(copy)
            near[18], near[36] = words(rng, 1), words(rng, 1)
            texts.append(" ".join(near))
        texts += [f"{words(rng, 30)} {' '.join(copy)}", f"{' '.join(copy)} {words(rng, 30)}"]
    found = {(r.doc_id, r.kept_id) for r in substrings.find(spark.createDataFrame(rows(*texts), SCHEMA)).collect()}
    assert found == {(i + n, i + n - 1) for i in range(0, 20 * n, n)}


def test_holders_are_not_all_listed(spark):
    """Copies behind unlike versions each name a holder, not all lesser ones: rows grow with the copies, not their square."""
    rng, texts, versions, copies = random.Random(36), [], 7, 12
    copy = words(rng, 55).split()
    for _ in range(versions):
        near = list(copy)
        near[18], near[36] = words(rng, 1), words(rng, 1)
        texts.append(" ".join(near))
    texts += [f"{words(rng, 30)} {' '.join(copy)} {words(rng, 30)}" for _ in range(copies)]
    found = substrings.find(spark.createDataFrame(rows(*texts), SCHEMA)).collect()
    assert {r.doc_id for r in found} == set(range(versions + 2, versions + copies + 1))
    assert len(found) <= 2 * copies


@pytest.mark.parametrize("least", [1, 7, 46])
def test_different_shingles_of_runs(least):
    rng = np.random.default_rng(least)
    values, held = rng.integers(0, 20, 90).astype(np.uint64), rng.random((20, 3)) < 0.5
    hits = held[values.astype(int)].astype(np.uint8)
    runs = [set(values[k : k + least].tolist()) for k in range(len(values) - least + 1)]
    before = substrings._before(values)
    assert substrings._different(hits, before, least).tolist() == [[sum(held[int(x), c] for x in run) for c in range(3)] for run in runs]
    assert substrings._different(None, before, least)[:, 0].tolist() == [len(run) for run in runs]


def test_cut_of_repeated_ids(spark):
    rng = random.Random(35)
    p, other = words(rng, 60), words(rng, 100)
    df = spark.createDataFrame([(1, p), (2, p), (2, other), (2, other), (3, other), (3, None), (None, p)], "doc_id long, text string").withColumns({"text_key": F.lit(1), "id": F.lit(2), "p": F.lit(3)})
    out = substrings.cut(df, substrings.find(df))
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, p), (2, other), (2, other), (3, None), (None, p)], key=repr)
    empty = df.where("false")
    assert substrings.cut(empty, substrings.find(empty)).count() == 0


def test_substrings_of_odd_rows(odd):
    got = {(r.doc_id, r.kept_id): r.n_words for r in substrings.find(odd).collect()}
    assert got == {(5, 4): 40_000} or got == {(5, 4): 40_001}
    assert substrings.find(odd.where("false")).count() == 0
    cut = substrings.cut(odd, substrings.find(odd))
    assert cut.columns == odd.columns and cut.count() in (9, 10)


def test_without():
    assert substrings.without("One, two three. Four", [(1, 2)]) == "One, . Four"
    assert substrings.without("a b", [(0, 1)]) == "" and substrings.without("a b", [(5, 9)]) == "a b"


# ---------------------------------------------------------------- HTML


@pytest.fixture(scope="module")
def model():
    return html_text.train(html_text.labelled_pages(300))


def test_marginals_equal_enumeration(model):
    """Sum-product against summing over all labellings of a small tree."""
    nodes = html_text.parse("<div class=content><p>some words, and more.</p><ul><li><a>x</a></li></ul></div><footer>end</footer>")
    score = html_text.features(nodes) @ model.weights
    total, on = 0.0, np.zeros(len(nodes))
    for code in range(2 ** len(nodes)):
        label = [(code >> i) & 1 for i in range(len(nodes))]
        weight = np.exp(sum(score[i] * label[i] for i in range(len(nodes))) + sum(model.edge[label[nodes[i].parent], label[i]] for i in range(1, len(nodes))))
        total += weight
        on += weight * np.array(label)
    assert np.allclose(model.marginals(nodes, score), on / total)


def test_held_out_pages(model):
    wrong = seen = 0
    for nodes, labels in html_text.labelled_pages(150, seed=99):
        has = np.array([any(p[1].strip() for p in n.pieces) for n in nodes])
        said = model.marginals(nodes, html_text.features(nodes) @ model.weights) > 0.5
        wrong += int(((said != (labels == 1)) & has).sum())
        seen += int(has.sum())
    assert wrong < 0.05 * seen


def test_unseen_layouts():
    """Articles of layouts without hints, as the default model reads them."""
    m, rng = html_text.train(html_text.labelled_pages()), random.Random(5)
    text = lambda n: html_text._words(rng, n)
    many = lambda n, k: [text(k) for _ in range(n)]
    p = lambda xs: "".join(f"<p>{x}</p>" for x in xs)
    menu = "<nav><ul><li><a href=#>Home</a><li><a href=#>About us</a></ul></nav>"
    a, b, c, d = many(5, 80), many(5, 80), many(3, 60), many(1, 40)
    title, para, item = text(5), text(40), text(6)
    assert m.text(f"<body>{p(a)}</body>") == "\n\n".join(a)
    assert m.text(f"<body><div><div><div>{p(b)}</div></div></div></body>") == "\n\n".join(b)
    assert m.text(f"<body><div id=wrap>{menu}{p(c)}<footer>&copy; 2020 me</footer></div></body>") == "\n\n".join(c)
    assert m.text(f"<body><article>{p(d)}</article></body>") == d[0]
    got = m.text(f"<body><article><h1>{title}</h1><p>{para}</p><ul><li><a href=x>{item}</a></li></ul></article><footer>by me</footer></body>")
    assert got == "\n\n".join([title, para, item])


def test_pages_equal_their_articles(spark):
    """The article element of every page, without the adverts in it, is the yardstick."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r.text for r in queries.op6_html_text(spark, "/root/testdata/sf0.01").collect()}
    for r in pages:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        nodes = html_text.parse("<body>" + re.sub(r'<div class="ad">.*?</div>', "", inner, flags=re.S))
        assert got[r.page_id] == "\n\n".join(html_text.blocks(nodes, [True] * len(nodes)))


def test_parse_attributes_and_hostile_pages():
    texts = lambda h: html_text.blocks(n := html_text.parse(h), [True] * len(n))
    assert texts("<p title=it's>one isn't</p><p title='a > b' x=\"'\">two</p><p a = \"</p>\">three") == ["one isn't", "two", "three"]
    assert texts("a < b <select><option>x <p>kept</p>") == ["a < b x", "kept"]
    assert texts("<p>on<script>no</p>") == ["on"]
    started = time.monotonic()
    for part, n in (("<p title=\"a' ", 70_000), ("<a '", 250_000), ("<p title='", 100_000), ("<!--", 250_000), ("<select>", 100_000), ("</p>", 250_000)):
        html_text.parse(part * n)
    html_text.parse("<div>" * 50_000 + "</p></li>" * 50_000)
    assert time.monotonic() - started < 30


def test_extract(spark, model):
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>Title &amp; more</h1><p>First   para,<br>with <b>bold &eacute;</b> words\n here.<p>Second one, which is longer and goes on for a while.</article><div class="comments"><p>I disagree, a reader says.</p></div><footer>&copy; 2024</footer>'
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<"), (5, "u", "<!-- never ends"), (None, "u", page), (None, "u", page)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(df, model).orderBy("page_id").collect()
    want = "Title & more\n\nFirst para, with bold é words here.\n\nSecond one, which is longer and goes on for a while."
    assert [r.text for r in got] == [want, want, want, "", "", "", ""] and got[0].n_chars == len(want)
    assert html_text.extract(df.where("false"), model).count() == 0


# ---------------------------------------------------------------- toxicity


def test_toxicity_learns_words_and_pairs(spark):
    rng = random.Random(3)
    common_words = [words(rng, 1) for _ in range(200)]
    texts, labels = [], []
    for i in range(900):
        t = [rng.choice(common_words) for _ in range(rng.randrange(20, 80))]
        y = i % 3 == 0
        if y:
            t.insert(rng.randrange(len(t)), rng.choice(["badword", "worse", "awfulness"]))
        texts.append(" ".join(t))
        labels.append(int(y))
    m = toxicity.train(texts[:700], labels[:700])
    said = m.scores(pa.array(texts[700:])) >= toxicity.CUT
    assert (said == np.array(labels[700:], bool)).mean() > 0.95
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a " * 50_000), (3, texts[0])], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = toxicity.score(df, m).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(df.where("false"), m).count() == 0


def test_toxicity_without_labels():
    m = toxicity.train([], [])
    assert 0 <= m.scores(pa.array(["anything"]))[0] <= 1


def test_toxicity_reads_every_label(spark, monkeypatch):
    """More rows than one shard holds: all of them train, a word of the last few included."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 300)
    rng = random.Random(4)
    usual = [words(rng, 1) for _ in range(100)]
    data = []
    for i in range(1500):
        t = [rng.choice(usual) for _ in range(20)]
        y = int(i % 3 == 0)
        data.append((i, " ".join([*t, rng.choice(["badword", "worse"])] if y else t), y))
    df = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    assert toxicity.labelled(df, labels).count() == 1500
    m, again = toxicity.fit(df, labels), toxicity.fit(df, labels)
    said = m.scores(pa.array([t for _, t, _ in data])) >= toxicity.CUT
    assert (said == np.array([y for *_, y in data], bool)).mean() > 0.95
    assert np.array_equal(m.embed, again.embed) and np.array_equal(m.thresholds, again.thresholds)
    assert toxicity.fit(df, labels.where("false")).scores(pa.array(["x"]))[0] <= 1


def test_held_out_toxicity(spark):
    path = "/root/testdata/sf0.01"
    rows_ = queries.op10_toxicity(spark, path).where("held_out").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    y = np.array([labels[r.doc_id] for r in rows_ if r.doc_id in labels])
    s = np.array([r.score for r in rows_ if r.doc_id in labels])
    assert (s[y == 1][:, None] > s[y == 0][None, :]).mean() > 0.65  # 38 toxic rows to learn from, in four languages


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = common.stage(stage(spark, docs, sf), name)
        n = out.count()
        assert 0 < n <= before
        if name != "token_ids":
            assert out.columns == docs.columns and out.schema == docs.schema
            docs, before = out, n
    assert n == before and {"doc_id", "ids", "n_tokens"} <= set(out.columns)
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "benchmark_leaks", "token_ids"]


def test_pipeline_with_clashing_columns_and_without_rows(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.lit(1) for c in ("kept", "ratio", "n_words", "_text", "class_id", "rid", "k1", "id", "text_key", "places")})
    out = docs.limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stage(stage(spark, out, sf), "s")
        assert out.columns == docs.columns
    assert out.count() > 0
    folder = tmp_path / "empty"
    docs.where("false").write.parquet(str(folder / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(folder / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(folder)).count() == 0


def test_runs_for_a_recall():
    assert [jaccard_join.runs_for(r, 0.8, 6) for r in (0.9, 0.99, 0.999)] == [9, 17, 26]


def test_recall_of_links_at_the_threshold(spark):
    """Pairs of texts at Jaccard 0.8 or just above, each pair a class of its own."""
    rng, texts = random.Random(41), []
    for _ in range(400):
        x = words(rng, 103).split()
        y = list(x)
        y[30], y[60] = words(rng, 1), words(rng, 1)  # 89 of 109 shingles shared
        texts += [" ".join(x), " ".join(y)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows(*texts), SCHEMA)).where("n_links = 1").count()
    assert got >= 2 * 0.99 * 400


def test_pipeline_decisions(spark, tmp_path, sf):
    rng = random.Random(7)
    p, item = words(rng, 60), next(iter(spark.read.parquet(f"{sf}/benchmark.parquet").limit(1).collect())).text
    body = words(rng, 300)
    near = body.split()
    near[100] = "changed"
    texts = [body, " ".join(near), body, f"{words(rng, 50)} {p}", f"{p} {words(rng, 50)}", f"{words(rng, 50)} {item}", "too few", None, "same line again\n" * 50, words(rng, 80)]
    folder = tmp_path / "in"
    spark.createDataFrame(rows(*texts), SCHEMA).write.parquet(str(folder / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(folder / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(folder))
    assert sorted(r.doc_id for r in got.collect()) == [1, 4, 5, 10]


def test_staged_tables_go(spark, sf):
    """What a stage of the pipeline has read for the last time does not stay on the disk of the next."""
    folder = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir()) if folder.exists() else set()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = jaccard_join.one_of_each(docs)
    assert one.count()
    mid = set(folder.iterdir())
    assert sorted(p.name.split("-")[0] for p in mid - before) == ["classes"]
    found = substrings.find(docs)
    assert found.count()
    assert {p.name.split("-")[0] for p in set(folder.iterdir()) - mid} == {"passages"}
    assert one.count() and found.count()
