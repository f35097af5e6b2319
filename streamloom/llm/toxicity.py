"""Toxicity: a convolutional text classifier over hashed word embeddings, trained and run in numpy.

Training reads every labelled row: shards of them are gone over in parallel and the models averaged after
each round; counts and thresholds come from all rows.

Words are hashed into buckets with an embedding each; filters of several widths slide over them, a
rectifier and the maximum over the text follow, and a logistic unit weighs the maxima.  Thresholds are
calibrated by language, which is guessed from function words of the text alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Hash buckets, embedding size, filters of each width, widths.
BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 15, 16, 16, (1, 2, 3)
#: A bucket needs so many labelled texts to count.
MIN_DOCS = 6
#: Labelled rows and words that one task trains on, about, and how often the tasks' models are averaged.
SHARD_ROWS, SHARD_WORDS, ROUNDS = 8000, 8_000_000, 4
#: Bins of a logit in calibration, over this span on both sides of 0.
BINS, SPAN = 4096, 32.0
EPOCHS, BATCH, RATE, DECAY = 8, 32, 0.01, 1e-4
#: Steps that training takes at least.
STEPS = 300
#: Words run through the filters at once.
WORDS_AT_ONCE = 100_000
#: The score at which every language's threshold comes to lie.
CUT = 0.3
#: Function words by which a language is told.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are with as be this by from or an",
    "de": "der die das und ist von den dem zu mit des nicht ein eine als auch für im auf sich",
    "fr": "le la les de des et un une est que qui dans pour par sur pas avec du au ce",
    "es": "el la los de y que en un una es por con para las del se no al su lo",
}


def _buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, where each text's words begin, and its language (-1: unknown)."""
    w = common.Words(texts)
    votes = np.zeros((len(w.first) - 1, len(FUNCTION_WORDS)), dtype=np.int64)
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    for k, words in enumerate(FUNCTION_WORDS.values()):
        known = np.sort(common.Words(pa.array([words])).hashes)
        at = np.minimum(np.searchsorted(known, w.hashes), len(known) - 1)
        votes[:, k] = np.bincount(text[known[at] == w.hashes], minlength=len(votes))
    lang = np.where(votes.max(axis=1, initial=0) > 0, votes.argmax(axis=1), -1)
    return (w.hashes >> np.uint64(64 - 15)).astype(np.int32), w.first, lang


@dataclass
class Classifier:
    embed: np.ndarray = field(repr=False)
    filters: dict[int, np.ndarray] = field(repr=False)  # width: (width, SIZE, FILTERS)
    bias: dict[int, np.ndarray] = field(repr=False)
    out: np.ndarray = field(repr=False)
    prior: float = 0.0
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(FUNCTION_WORDS) + 1))  # the last: language unknown

    @classmethod
    def fresh(cls, known: np.ndarray, rng: np.random.Generator) -> Classifier:
        """Buckets outside ``known`` keep an embedding of zeros."""
        embed = (rng.normal(0, 0.3, (BUCKETS, SIZE)) * known[:, None]).astype(np.float32)
        return cls(
            embed,
            {w: rng.normal(0, (w * SIZE) ** -0.5, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS},
            {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
            rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32),
        )

    def copy(self) -> Classifier:
        return Classifier(self.embed.copy(), {w: f.copy() for w, f in self.filters.items()}, {w: b.copy() for w, b in self.bias.items()}, self.out.copy(), self.prior, self.thresholds.copy())

    def packed(self) -> np.ndarray:
        """All that training changes, as one array."""
        return np.concatenate([x.reshape(-1) for x in (self.embed, *self.filters.values(), *self.bias.values(), self.out)]).astype(np.float64)

    def unpack(self, values: np.ndarray) -> None:
        """Take over an array that ``packed`` made."""
        at = 0
        for x in (self.embed, *self.filters.values(), *self.bias.values(), self.out):
            x[...] = values[at : at + x.size].reshape(x.shape)
            at += x.size

    def maps(self, buckets: np.ndarray, first: np.ndarray) -> dict[int, np.ndarray]:
        """Rectified filter outputs at every place; 0 where a window would leave its text."""
        vectors = self.embed[buckets]
        ends = np.repeat(first[1:], np.diff(first))
        out = {}
        for w in WIDTHS:
            n = max(0, len(vectors) - w + 1)
            made = np.zeros((len(vectors), FILTERS), np.float32)
            made[:n] = self.bias[w] + sum(vectors[j : n + j] @ self.filters[w][j] for j in range(w))
            made[np.arange(len(vectors)) + w > ends] = 0
            out[w] = np.maximum(made, 0)
        return out

    def logits(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A logit for each text, some texts at a time so that the maps stay small."""
        out, a = [np.zeros(0, np.float32)], 0
        while a < len(first) - 1:
            b = max(a + 1, int(np.searchsorted(first, first[a] + WORDS_AT_ONCE, side="right")) - 1)
            out.append(self._logits(buckets[first[a] : first[b]], first[a : b + 1] - first[a]))
            a = b
        return np.concatenate(out)

    def _logits(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        full = np.flatnonzero(np.diff(first) > 0)
        pooled = np.zeros((len(first) - 1, len(self.out)), np.float32)
        if len(full):
            pooled[full] = np.concatenate([np.maximum.reduceat(m, first[full], axis=0) for m in self.maps(buckets, first).values()], axis=1)
        return pooled @ self.out + self.prior

    def scores(self, texts: pa.Array) -> np.ndarray:
        buckets, first, lang = _buckets(texts)
        z = self.logits(buckets, first) - self.thresholds[lang] + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def train(texts: list[str], labels: list[int], weights: tuple[float, float] = (1.0, 1.0), seed: int = 7) -> Classifier:
    """Fit on four fifths of the texts, calibrate the thresholds on the rest.

    ``weights``: rows that each sampled row of class 0 and 1 stands for, used in calibration only.
    """
    rng = np.random.default_rng(seed)
    parts = [_buckets(pa.array(texts[i : i + 256], pa.string())) for i in range(0, len(texts), 256)]
    buckets = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32)
    first = np.r_[0, np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))] if parts else np.zeros(1, np.int64)
    lang = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.int64)
    y = np.array(labels, dtype=np.float32)
    n = len(y)
    order = rng.permutation(n)
    fit, held = np.sort(order[n // 5 :]), np.sort(order[: n // 5])
    docs_with = np.zeros(BUCKETS, dtype=np.int64)
    for i in fit:
        docs_with[np.unique(buckets[first[i] : first[i + 1]])] += 1
    model = Classifier.fresh(docs_with >= MIN_DOCS, rng)
    share = float(np.clip(y[fit].mean() if len(fit) else 0.5, 0.01, 0.99))
    model.prior = float(np.log(share / (1 - share)))
    if len(fit):
        _descend(model, buckets, first, y, fit, rng)
    _calibrate(model, buckets, first, lang, y, held if len(held) >= 50 else np.arange(n), weights)
    return model


def _descend(model: Classifier, buckets: np.ndarray, first: np.ndarray, y: np.ndarray, rows: np.ndarray, rng: np.random.Generator, epochs: int | None = None) -> None:
    """Adam over mini-batches; only the places that win the maximum pass a gradient on."""
    known = np.abs(model.embed).sum(axis=1) > 0
    names = ["embed", "out", *[("f", w) for w in WIDTHS], *[("b", w) for w in WIDTHS]]
    value = {"embed": model.embed, "out": model.out} | {("f", w): model.filters[w] for w in WIDTHS} | {("b", w): model.bias[w] for w in WIDTHS}
    first_m, second_m = ({k: np.zeros_like(value[k]) for k in names} for _ in range(2))
    step = 0
    # the rarer class is drawn again until it makes up a third, and few rows are gone over more often
    rare = rows[y[rows] == (y[rows].mean() < 0.5)]
    again = max(0, (len(rows) - len(rare)) // 2 - len(rare)) if len(rare) else 0
    epochs = epochs or max(EPOCHS, -(-STEPS * BATCH // (len(rows) + again)))
    for _ in range(epochs):
        drawn = np.concatenate([rows, rng.choice(rare, again)]) if again else rows
        for part in np.array_split(rng.permutation(drawn), -(-len(drawn) // BATCH)):
            part = part[np.diff(first)[part] > 0]
            if not len(part):
                continue
            own = np.concatenate([buckets[first[i] : first[i + 1]] for i in part])
            at = np.r_[0, np.cumsum(np.diff(first)[part])]
            maps = model.maps(own, at)
            place = {w: np.stack([a + m[a:b].argmax(axis=0) for a, b in zip(at[:-1], at[1:], strict=True)]) for w, m in maps.items()}
            pooled = np.concatenate([np.take_along_axis(maps[w], place[w], axis=0) for w in WIDTHS], axis=1)
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.prior, -30, 30)))
            error = (p - y[part]) / len(part)
            grad = {k: np.zeros_like(value[k]) for k in names if k != "embed"}
            grad["out"] = pooled.T @ error + DECAY * model.out
            embed_grad: dict[str, list[np.ndarray]] = {"row": [], "value": []}
            for k, w in enumerate(WIDTHS):
                back = error[:, None] * model.out[k * FILTERS : (k + 1) * FILTERS] * (pooled[:, k * FILTERS : (k + 1) * FILTERS] > 0)
                grad["b", w] = back.sum(axis=0)
                for j in range(w):
                    words = own[np.minimum(place[w] + j, len(own) - 1)]
                    grad["f", w][j] = np.einsum("dfs,df->sf", model.embed[words], back) + DECAY * model.filters[w][j]
                    embed_grad["row"].append(words.reshape(-1))
                    embed_grad["value"].append((back[:, :, None] * model.filters[w][j].T[None]).reshape(-1, SIZE))
            row, inverse = np.unique(np.concatenate(embed_grad["row"]), return_inverse=True)
            total = np.zeros((len(row), SIZE), np.float32)
            np.add.at(total, inverse, np.concatenate(embed_grad["value"]))
            total *= known[row][:, None]
            step += 1
            scale = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k in names:
                g, i = (total, row) if k == "embed" else (grad[k], slice(None))
                first_m[k][i] = 0.9 * first_m[k][i] + 0.1 * g
                second_m[k][i] = 0.999 * second_m[k][i] + 0.001 * g * g
                value[k][i] -= scale * first_m[k][i] / (np.sqrt(second_m[k][i]) + 1e-8)


def _calibrate(model: Classifier, buckets: np.ndarray, first: np.ndarray, lang: np.ndarray, y: np.ndarray, rows: np.ndarray, weights: tuple[float, float]) -> None:
    """Per language the logit that gives the best F1; all rows together where a language has few of label 1."""
    z = model.logits(buckets, first)

    def best(chosen: np.ndarray) -> float:
        order = chosen[np.argsort(-z[chosen], kind="stable")]
        hit = np.cumsum(y[order] * weights[1])
        called = hit + np.cumsum((1 - y[order]) * weights[0])
        f1 = 2 * hit / (called + hit[-1])
        top = np.flatnonzero(f1 >= f1.max() - 1e-9)
        k = int(top[len(top) // 2])
        return float(z[order[k]] + z[order[min(k + 1, len(order) - 1)]]) / 2

    overall = best(rows) if len(rows) and y[rows].any() else float(np.log(CUT / (1 - CUT)))
    model.thresholds = np.full(len(FUNCTION_WORDS) + 1, overall, dtype=np.float32)
    for k in range(len(FUNCTION_WORDS)):
        own = rows[lang[rows] == k]
        if y[own].sum() >= 20:
            model.thresholds[k] = best(own)


def _summed(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]], size: int) -> np.ndarray:
    """The sum of the (shard, array of ``size``) that ``run`` makes of the partitions, added in parts by the
    executors in the order of shards, so that it is the same each time."""
    width = -(-size // 64)
    parts = "part int, shard long, value binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, value in run(batches):
            made = [value[k * width : (k + 1) * width].astype(np.float64).tobytes() for k in range(64)]
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(64), pa.int32()), "shard": pa.array([shard] * 64, pa.int64()), "value": pa.array(made, pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(value, dtype=np.float64)
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()), "shard": pa.array([0] * len(total), pa.int64()), "value": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    out = np.zeros(64 * width)
    for row in rows.mapInArrow(cut, parts).repartition(8, "part").sortWithinPartitions("part", "shard").mapInArrow(add, parts).collect():
        value = np.frombuffer(row["value"], dtype=np.float64)
        out[row["part"] * width : row["part"] * width + len(value)] = value
    return out[:size]


_ROWS = "i long, y int, lang int, words int, held boolean, buckets binary"


def labelled(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Every labelled text once, as the buckets of its words; a fifth of them is held for calibration.

    Rows with a null id or label, or with two labels, are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z and y in (0, 1)").select(F.col(doc_id).alias("i"), F.col("y").cast("int").alias("y"))
    rows = df.select(df[doc_id].alias("i"), df[text].alias("t")).join(known, "i").dropDuplicates(["i"])
    rows = rows.select(F.xxhash64("i").alias("i"), "y", (F.pmod(F.xxhash64("i", F.lit("held")), F.lit(5)) == 0).alias("held"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            for a, b in common.slices(column, common.SLICE_BYTES // 2):
                buckets, first, lang = _buckets(column.slice(a, b - a))
                made = pa.array([buckets[x:y].tobytes() for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(lang, pa.int32()), pa.array(np.diff(first), pa.int32()), own.column(2), made], ["i", "y", "lang", "words", "held", "buckets"])

    return rows.mapInArrow(run, _ROWS)


def _unpacked(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """buckets, where each text begins, labels and languages of rows of ``labelled``."""
    parts = [np.frombuffer(x, dtype=np.int32) for x in table.column("buckets").to_pylist()]
    first = np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int64)
    return np.concatenate([*parts, np.zeros(0, np.int32)]), first, table.column("y").to_numpy().astype(np.float32), table.column("lang").to_numpy()


def fit(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", seed: int = 7) -> Classifier:
    """A classifier trained on every labelled row of ``df``, whatever their number; nothing is sampled.

    Shards of about ``SHARD_ROWS`` rows are trained on by a task each, from the same model; the results are
    averaged by rows, ``ROUNDS`` times.  The driver holds one model.
    """
    spark = df.sparkSession
    common.ship(spark)
    rows = common.stage(labelled(df, labels, text, doc_id, label), "labelled")
    totals = {r["held"]: r for r in rows.groupBy("held").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.sum(F.col("words").cast("long")).alias("words")).collect()}
    rng = np.random.default_rng(seed)
    if False not in totals:
        return train([], [], seed=seed)
    n, positive, words = totals[False]["n"], totals[False]["y"], totals[False]["words"]
    fitted = rows.where("not held")

    def texts_with(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        total = np.zeros(BUCKETS)
        for batch in batches:
            for x in batch.column("buckets").to_pylist():
                total[np.unique(np.frombuffer(x, dtype=np.int32))] += 1
        yield 0, total

    model = Classifier.fresh(_summed(fitted, texts_with, BUCKETS) >= MIN_DOCS, rng)
    share = float(np.clip(positive / n, 0.01, 0.99))
    model.prior = float(np.log(share / (1 - share)))
    shards = max(1, -(-n // SHARD_ROWS), -(-words // SHARD_WORDS))
    rounds = ROUNDS if shards > 1 else 1
    dealt = common.stage(fitted.withColumn("shard", F.pmod("i", F.lit(shards))).repartition(int(shards), "shard").sortWithinPartitions("shard", "i").select("shard", "i", "y", "lang", "buckets"), "shards") if shards > 1 else None
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        source = (dealt if dealt is not None else fitted.withColumn("shard", F.lit(0).cast("long")).select("shard", "i", "y", "lang", "buckets")).repartition(int(shards), "shard").sortWithinPartitions("shard", "i")

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
            for table, at in common.complete_groups(batches, 1):
                for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = table.slice(x, y - x)
                    shard = own.column("shard")[0].as_py()
                    buckets, first, classes, _ = _unpacked(own)
                    mine = sent.value.copy()
                    _descend(mine, buckets, first, classes, np.arange(y - x), np.random.default_rng([seed, k, shard]), EPOCHS // ROUNDS if shards > 1 else None)
                    yield shard, np.r_[mine.packed() * (y - x), y - x]

        total = _summed(source, learn, len(model.packed()) + 1)
        model.unpack(total[:-1] / total[-1])
    calibrating = rows.where("held") if True in totals and totals[True]["n"] >= 50 else rows
    sent = spark.sparkContext.broadcast(model)
    languages = len(FUNCTION_WORDS) + 1

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        total = np.zeros((languages, 2, BINS))
        for batch in batches:
            buckets, first, classes, lang = _unpacked(batch)
            z = np.clip((sent.value.logits(buckets, first) + SPAN) * (BINS / (2 * SPAN)), 0, BINS - 1).astype(np.int64)
            np.add.at(total, (lang, classes.astype(np.int64), z), 1)
        yield 0, total.reshape(-1)

    _thresholds(model, _summed(calibrating, binned, languages * 2 * BINS).reshape(languages, 2, BINS))
    return model


def _thresholds(model: Classifier, counts: np.ndarray) -> None:
    """As ``_calibrate``, from counts of logits by language, class and bin; a threshold is a bin's lower end."""

    def best(own: np.ndarray) -> float:
        hit, called = np.cumsum(own[1][::-1]), np.cumsum(own.sum(axis=0)[::-1])
        f1 = 2 * hit / (called + hit[-1])
        top = np.flatnonzero(f1 >= f1.max() - 1e-9)
        return float((BINS - 1 - top[len(top) // 2]) * (2 * SPAN / BINS) - SPAN)

    overall = best(counts.sum(axis=0)) if counts[:, 1].any() else float(np.log(CUT / (1 - CUT)))
    model.thresholds = np.full(len(counts), overall, dtype=np.float32)
    for k in range(len(FUNCTION_WORDS)):
        if counts[k, 1].sum() >= 20:
            model.thresholds[k] = best(counts[k])


def score(df: DataFrame, model: Classifier, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and score (0 to 1) of every whole text; a row for each row of ``df``, no shuffle.

    The model is broadcast; its size does not depend on the data.  Null counts as the empty text, whose
    score is that of no filter firing.
    """
    common.ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(*keep, df[text].alias("_text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for a, b in common.slices(column, common.SLICE_BYTES // 2):
                made = pa.array(own.scores(column.slice(a, b - a)), pa.float64())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)], made], [*batch.schema.names[:-1], "score"])

    return source.mapInArrow(run, kept + "score double")
