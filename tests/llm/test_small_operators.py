"""Sharding, license scan, quality rules, SentencePiece and token files against plain restatements."""

import hashlib
import json
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from streamloom.llm import common, license_scan, quality, queries, sentencepieces, sharding, token_files

ODD = [
    (1, "one two three"), (1, "one two three"), (2, None), (None, "no id at all"), (4, ""), (5, "  double  space\n\nand lines\n"), (6, "x" * 300_000),
    (7, "word " * 60_000), (8, "tabs\tand nbsp 　wide ▁ marks <s> </s> <unk>"), (9, "émoji 😀 ① ﬁ\x00 nul"), (10, "All rights reserved. CC BY CC BY"), (11, " lead"), (12, "trail "), (13, "\n"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, ties, empty and very long texts, and columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", 0, "x") for i, t in ODD], "doc_id long, text string, lang string, n_words int, kept string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# ---------------------------------------------------------------- sharding


def test_shards_are_balanced_and_gapless(spark, sf):
    rows = queries.op1_sharding(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    sizes, slots = np.zeros(40), {}
    for r in rows:
        sizes[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert abs(sizes - sizes.mean()).max() <= max(r["size"] for r in rows)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_shards_equal_one_pass(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 5, 1000]) * rng.randrange(1, 9)) for i in range(500)]
    got = {r.id: (r.shard, r.slot) for r in sharding.byte_shards(spark.createDataFrame(rows, "id long, size long"), 7, F.col("size"), [F.col("id")]).collect()}
    total, at, used = sum(s for _, s in rows), 0, {}
    for i, s in rows:
        shard = min(6, (2 * at + s) * 7 // (2 * total))
        assert got[i] == (shard, used.setdefault(shard, 0))
        used[shard] += 1
        at += s


def test_shards_of_odd_rows(odd, none):
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 16
    out = sharding.byte_shards(odd, 3, size, [F.xxhash64("text"), F.col("doc_id")])
    assert out.count() == len(ODD) and set(odd.columns) < set(out.columns)
    assert sharding.byte_shards(none, 3, size, [F.col("doc_id")]).count() == 0
    clash = sharding.byte_shards(odd.withColumns({"Shard": F.lit("x"), "slot": F.lit("y")}), 3, size, [F.xxhash64("text"), F.col("doc_id")])
    assert sorted(r.slot for r in clash.where("shard = 0").collect()) == list(range(clash.where("shard = 0").count()))


# ---------------------------------------------------------------- license scan


def plain_words(text):
    return re.findall(license_scan.WORD, (text or "").translate(str.maketrans(license_scan.UPPER, license_scan.LOWER)))


def plain_scan(text):
    w = plain_words(text)
    places, labels, best = [], set(), 0.0
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    base = ",".join(sorted(labels))
    for label, texts in license_scan.TEMPLATES.items():
        for t in texts:
            wanted = set(plain_words(t))
            step = license_scan.stride(license_scan.TEMPLATES)
            for i in range(0, max(len(w), 1), step):
                share = len(wanted & set(w[i : i + 2 * step])) / len(wanted)
                if share >= license_scan.THRESHOLD - 1e-12:
                    labels.add(label)
                    best = max(best, share)
    return (len(w), len(places), min(places, default=None), max(places, default=None), base, ",".join(sorted(labels)), 1.0 if places else best)


def test_scan_equals_brute_force(docs):
    extra = [(10**6, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and files\nLicensed under CC BY-NC 4.0 or CC BY SA 4.0"), (10**6 + 1, "Licensed Apache License Version 2")]
    more = docs.sparkSession.createDataFrame(extra, "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    want = {r.doc_id: plain_scan(r.text) for r in both.collect()}
    got = {r.doc_id: tuple(r)[1:] for r in license_scan.scan(both).collect()}
    assert got == want


def test_wrapped_statements(spark):
    head = "Copyright 2020 someone\n\n"
    wrapped = "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the Software), to deal"
    df = spark.createDataFrame([(1, head + wrapped), (2, wrapped.replace("\n# ", " ")), (3, "word " * 200 + wrapped)], "doc_id long, text string")
    assert [r.labels for r in license_scan.scan(df).orderBy("doc_id").collect()] == ["mit"] * 3


def test_scan_of_odd_rows(odd, none):
    got = sorted((repr(r.doc_id), tuple(r)[1:]) for r in license_scan.scan(odd).collect())
    assert got == sorted((repr(i), plain_scan(t)) for i, t in ODD)
    assert license_scan.scan(none).count() == 0


def test_scan_equals_sql(spark, sf, docs):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op2_license_scan"]).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in license_scan.scan(docs).collect())


# ---------------------------------------------------------------- quality


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, g in enumerate(grams) if len(words) < 5000 and grams.count(g) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_counts_equal_brute_force(docs):
    for r in docs.where("n_chars < 4000").limit(60).collect():
        assert quality.counts(r.text) == plain_counts(r.text)
    assert quality.counts("a b c d e a b c d e") == (10, 10, 0, 0, 10)
    assert quality.counts("x y\n\n x y\nx y\n\t\n") == (6, 6, 0, 1, 0)


def test_judge(odd, none, docs):
    rows = quality.judge(odd).collect()
    assert len(rows) == len(ODD) and all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows)
    assert not any(r.kept for r in rows if r.base_failed)
    assert quality.judge(none).count() == 0
    assert quality.judge(docs).where("kept").count() > 0.7 * docs.count()


def test_kept_rows_with_clashing_columns(odd, none, docs):
    clash = odd.withColumns({c: F.lit(1) for c in ("kept", "ratio", "n_words", "_text")})
    out = quality.kept(clash)
    assert out.columns == clash.columns and out.count() == quality.judge(odd).where("kept").count() and quality.kept(none).count() == 0
    assert {r.doc_id for r in quality.kept(docs).collect()} == {r.doc_id for r in quality.judge(docs).where("kept").collect()}


def test_labelled_quality(spark):
    """Junk is rejected and good text kept, by the tables' own labels (all lengths)."""
    path = "/root/testdata/sf0.1"
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    said = [(good[r.doc_id], r.kept) for r in queries.op3_quality_rules(spark, path).collect() if r.doc_id in good]
    share = lambda q, k: sum(x == (q, k) for x in said) / max(1, sum(x[0] == q for x in said))
    print("kept of good", share(1, True), "rejected of junk", share(0, False))
    assert share(1, True) > 0.95 and share(0, False) > 0.5


def test_bands():
    noise = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=20_000))
    same = "the same few words again and again, " * 500
    import zstandard

    bands, c = quality.Bands(), zstandard.ZstdCompressor(level=1)
    for text in (noise, same):
        raw = text.encode()
        assert not quality.in_bands(len(raw), *quality.ratios(raw, bands, c), bands)


def test_base64_is_outside_the_bands(docs):
    import base64

    import zstandard

    bands, c = quality.Bands(), zstandard.ZstdCompressor(level=1)
    rng = random.Random(2)
    kept = lambda raw: quality.in_bands(len(raw), *quality.ratios(raw, bands, c), bands)
    for n in (180, 250, 500, 760, 1000, 1500, 2048, 4096, 8192, 16384, 40_000):
        raw = rng.randbytes(n)
        assert not kept(base64.encodebytes(raw)[:n]) and not kept(base64.b64encode(raw)[:n])
    # a long text whose chunks are base64 to a third
    prose = max((r.text for r in docs.where("n_chars > 12000 and lang = 'en'").collect() if kept(r.text.encode())), key=len).encode()
    assert not kept(prose + b"\n" + base64.encodebytes(rng.randbytes(len(prose) // 2))[: len(prose) // 2])


# ---------------------------------------------------------------- SentencePiece


@pytest.fixture(scope="module")
def model():
    return queries.tokenizer_file("piece_bpe_32k.model")


def expected(sp, text):
    ids = sp.encode(text or "") + [2]
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_sentencepiece_equals_the_library(spark, sf, odd, none, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op4_sentencepiece(spark, sf).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(sp, texts[r.doc_id])
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentencepieces.encode_documents(odd, model).collect())
    assert got == sorted(expected(sp, t) for _, t in ODD)
    ids = sentencepieces.encode_documents(odd.where("doc_id = 9"), model).first().ids
    assert ids == sp.encode(ODD[9][1]) + [2]
    assert sentencepieces.encode_documents(none, model).count() == 0


def test_agenda_alone_equals_the_library(model):
    """Without the library's check, so that only the own merges are at work."""
    codec = sentencepieces.Codec(open(model, "rb").read(), check=False)
    checked = sentencepieces.Codec(open(model, "rb").read())
    whole = sentencepieces.Codec(open(model, "rb").read())
    whole.splits = False
    rng = random.Random(4)
    alphabet = [*"ab  \n\té中😀▁\x00.,　ﬁ①́", "the", " the", "<s>", "<0x0A>", "ing", "tion"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30))) for _ in range(2000)] + [t or "" for _, t in ODD if len(t or "") < 1000]
    for t, own, theirs in zip(texts, codec.encode(texts), codec.sp.encode(texts), strict=True):
        assert own == " ".join(map(str, theirs))
        assert codec.decode(theirs) == codec.sp.decode(theirs)
    for c in (codec, checked, whole):
        assert [x[1] for x in c.round_trip(texts)] == [c.sp.decode(c.sp.encode(t)) for t in texts]
    assert not any(x[2] for x in checked.round_trip(texts))


# ---------------------------------------------------------------- token files


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (token_files.unpack(data, bits, 1001) == ids).all()


def test_bits():
    assert [token_files.bits_for(n) for n in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_random_access(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 64)
    rng, path = np.random.default_rng(1), tmp_path / "f"
    docs = [rng.integers(0, 5000, n).astype(np.uint32) for n in (0, 10, 63, 1, 200, 0, 5)]
    with open(path, "wb") as f:
        w = token_files.Writer(f, 13)
        for i, d in enumerate(docs):
            w.add(None if i == 2 else i, d)
        assert w.close() == sum(map(len, docs))
    data = path.read_bytes()
    r = token_files.Reader(lambda at, n: data[at : at + n], len(data))
    assert len(r.blocks) > 2 and r.nulls.tolist() == [False, False, True] + [False] * 4
    assert all((r.document(i) == d).all() and len(r.document(i)) == len(d) for i, d in enumerate(docs))


def check_files(df, folder, path, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    manifest = token_files.write_files(df, folder, path, 2)
    got = token_files.read_files(manifest, folder).orderBy("start").collect()
    at = 0
    for r, (i, text) in zip(got, rows, strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(rows)


def test_token_files(spark, docs, odd, none):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    check_files(docs, common.shared_path(spark, "t"), path, rows)
    check_files(odd, common.shared_path(spark, "t"), path, sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")))
    folder = common.shared_path(spark, "t")
    assert token_files.read_files(token_files.write_files(none, folder, path, 2), folder).count() == 0


def test_segments_equal_whole_texts():
    from tokenizers import Tokenizer

    e = token_files.Encoder(open(queries.tokenizer_file("byte_bpe_50k.json")).read())
    rng = random.Random(2)
    alphabet = [*"ab  \n\té中😀.,　①́\x01\x85\x1c\xa0", "the", " the", "'s", "'ll", "<|endoftext|>", " 12", "\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30))) for _ in range(3000)]
    texts += [" ".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30))) for _ in range(3000)]
    texts += ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b", "<|endoftext", "", None, " ", "\n"]
    plain = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for chunk in (len(texts), 100):
        got = []
        for i in range(0, len(texts), chunk):
            ids, at = e.encode(pa.array(texts[i : i + chunk], pa.string()))
            got += [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        assert got == want
    assert len(e.encode(pa.array([], pa.string()))[0]) == 0
    other = json.loads(open(queries.tokenizer_file("byte_bpe_50k.json")).read())
    other["pre_tokenizer"]["add_prefix_space"] = True
    e = token_files.Encoder(json.dumps(other))
    ids, at = e.encode(pa.array(["one two", "three"]))
    assert not e.splits and ids.tolist() == [i for t in ("one two", "three") for i in e.library.encode(t, add_special_tokens=False).ids]


def test_ids_that_do_not_fit():
    with pytest.raises(ValueError):
        token_files.pack(np.array([70000], np.uint32), 16)
    with pytest.raises(ValueError):
        token_files.pack(np.array([8192], np.uint32), 13)


def test_vocabulary_of_the_tokenizer():
    assert token_files.vocabulary_size(open(queries.tokenizer_file("byte_bpe_50k.json")).read()) == 50257


def test_frequent_segments_stay_encoded(monkeypatch):
    """What a worker meets again and again is encoded once, while rare segments are forgotten."""
    monkeypatch.setattr(token_files, "CACHE", 300)
    e = token_files.Encoder(open(queries.tokenizer_file("byte_bpe_50k.json")).read())
    learned, learn = [], e._learn
    monkeypatch.setattr(e, "_learn", lambda keys: (learned.extend(keys), learn(keys)))
    for n in range(50):
        text = " ".join(["frequent", *(f"rare{n}x{k}" for k in range(100)), "frequent"])
        ids, _ = e.encode(pa.array([text]))
        assert ids.tolist() == e.library.encode(text, add_special_tokens=False).ids
        assert len(e.cache) + len(e.older) <= 2 * (300 + 102)
    assert learned.count("frequent") == 1 and learned.count("rare49x7") == 1


def test_frequent_pieces_stay_encoded(monkeypatch, model):
    monkeypatch.setattr(sentencepieces, "CACHE", 300)
    codec = sentencepieces.Codec(open(model, "rb").read())
    learned, learn = [], codec._learn
    monkeypatch.setattr(codec, "_learn", lambda keys: (learned.extend(keys), learn(keys)))
    for n in range(50):
        text = " ".join(["frequent", "ﬁ\x00", *(f"rare{n}x{k}" for k in range(100)), "frequent  \n\nline \n"])
        ids = codec.sp.encode(text)
        assert codec.round_trip([text]) == [(" ".join(map(str, ids)), codec.sp.decode(ids), 0)]
        assert len(codec.cache) + len(codec.older) <= 2 * (300 + 110)
    assert learned.count("frequent") == 1 and learned.count("rare49x7") == 1
