"""Toxicity by a classifier chain of linear models on words and openings of words.

The categories are predicted in order; each model after the first also reads the probabilities of the categories
before it. While training, those are out-of-fold predictions: the probability that a model which never saw the row
gives it. The same predictions set each category's threshold. Training reads a sample of at most SAMPLE_ROWS labelled
rows, drawn by a hash of the key; its models are fitted in parallel tasks. Prediction reads all rows and whole texts.

A text's features are its distinct words (runs of ASCII letters and of bytes beyond ASCII, A-Z lower-cased) and the
openings of longer words, so that inflected and compound forms count together; they are told apart by hash buckets.

Null texts count as empty. Rows with a null label or key are left out of training. Without labelled rows of both
kinds a category gets its constant rate as probability. Columns named as the results are replaced. Equal texts get
equal probabilities, wherever they stand; one that equals the threshold counts as of the category. Repeated rows get a
row each, an empty table gives an empty result, and rows without labels alone give probabilities near 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import distinct, materialize, mix, text_slices

SAMPLE_ROWS = 10_000
#: Hash buckets of features; only those in MIN_DOCS sample texts or more get a weight.
BUCKET_BITS, MIN_DOCS = 20, 5
#: Bytes of the openings that stand for longer words.
OPENINGS = (4, 5, 6, 7)
FOLDS = 3
ITERATIONS, PENALTY = 40, 0.003
#: Bytes of texts whose features are made together.
AT_ONCE = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of each text, end to end, and each text's number of them. `texts`: one of `text_slices`."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    low = data | np.uint8(32)
    solid = ((low - np.uint8(97)) < 26) | (data >= 128)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.append(False, solid[:-1]) if len(data) else solid
    at = np.flatnonzero(solid & (~before | first[:-1]))
    if not len(at):
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    after = np.append(solid[1:], False)
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    lengths = ends - at
    place = np.arange(len(data), dtype=np.int64) - at[np.maximum(np.cumsum(solid & (~before | first[:-1])) - 1, 0)]
    place[~solid] = 0
    powers = np.cumprod(np.full(int(place.max()) + 1, _BASE, np.uint64))
    # bytes beyond ASCII keep their case bit
    terms = (np.where(data < 128, low, data).astype(np.uint64) + np.uint64(1)) * powers[place]
    terms[~solid] = 0
    sums = np.append(np.uint64(0), np.cumsum(terms))
    hashes, owners = [sums[ends] - sums[at]], [np.arange(len(at))]
    for n in OPENINGS:
        longer = np.flatnonzero(lengths > n)
        hashes.append(sums[at[longer] + n] - sums[at[longer]] + np.uint64(n * 0xD6E8FEB86659FD93 % (1 << 64)))
        owners.append(longer)
    bucket = mix(np.concatenate(hashes)) >> np.uint64(64 - BUCKET_BITS)
    doc = np.searchsorted(offsets, at, side="right") - 1
    keys = distinct((doc[np.concatenate(owners)].astype(np.uint64) << np.uint64(BUCKET_BITS)) | bucket)
    counts = np.bincount((keys >> np.uint64(BUCKET_BITS)).astype(np.int64), minlength=len(texts))
    return (keys & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64), counts


@dataclass
class Linear:
    """Weights of buckets, of the probabilities of earlier categories, and a constant."""

    weights: np.ndarray
    earlier: np.ndarray
    constant: float

    def predict(self, flat: np.ndarray, counts: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        # a sum for each text, so that equal texts get equal values wherever they stand
        sums, full = np.zeros(len(counts)), counts > 0
        if full.any():
            sums[full] = np.add.reduceat(self.weights[flat].astype(float), (np.cumsum(counts) - counts)[full])
        z = sums + earlier @ self.earlier + self.constant
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(flat: np.ndarray, counts: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Linear:
    """Logistic regression with an L2 penalty, by limited-memory quasi-Newton steps over the frequent buckets."""
    size = 1 << BUCKET_BITS
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return Linear(np.zeros(size), np.zeros(earlier.shape[1]), 30.0 if rate else -30.0)
    frequent = np.flatnonzero(np.bincount(flat, minlength=size) >= MIN_DOCS)
    number = np.full(size, -1)
    number[frequent] = np.arange(len(frequent))
    column, row = number[flat], np.repeat(np.arange(len(y)), counts)
    column, row = column[column >= 0], row[column >= 0]
    n, k = len(frequent), earlier.shape[1]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, w[column], len(y)) + earlier @ w[n : n + k] + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        off = (p - y) / len(y)
        slope = np.concatenate([np.bincount(column, off[row], n), earlier.T @ off, [off.sum()]])
        slope[:-1] += PENALTY * w[:-1]
        return float(np.mean(np.logaddexp(0, z) - y * z) + PENALTY / 2 * (w[:-1] ** 2).sum()), slope

    w = np.zeros(n + k + 1)
    value, slope = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ITERATIONS):
        way, parts = slope.copy(), []
        for s, d in reversed(steps):
            a = s @ way / (s @ d)
            parts.append(a)
            way -= a * d
        if steps:
            way *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1])
        for (s, d), a in zip(steps, reversed(parts), strict=True):
            way += s * (a - d @ way / (s @ d))
        length = 1.0
        while length > 1e-6:
            new_value, new_slope = loss(w - length * way)
            if new_value <= value - 1e-4 * length * (slope @ way):
                break
            length /= 2
        else:
            break
        s, d = -length * way, new_slope - slope
        w, done = w + s, value - new_value < 1e-7
        value, slope = new_value, new_slope
        if s @ d > 1e-12:
            steps = [*steps[-7:], (s, d)]
        if done:
            break
    weights = np.zeros(size)
    weights[frequent] = w[:n]
    return Linear(weights, w[n : n + k], float(w[-1]))


@dataclass
class Chain:
    """Fitted models and thresholds, in the order of the categories."""

    categories: list[str]
    models: list[Linear] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def predict(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add p_<category> and is_<category> for each category."""
        spark, names = df.sparkSession, [f"p_{c}" for c in self.categories]
        kept = df.drop(*names)
        # a model has 2 ** BUCKET_BITS weights, whatever the data
        shared = spark.sparkContext.broadcast([Linear(m.weights.astype(np.float32), m.earlier, m.constant) for m in self.models])
        place = kept.columns.index(text)
        schema = T.StructType([*kept.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, texts in text_slices(batch.column(place), AT_ONCE):
                    flat, counts = features(texts)
                    done = np.empty((len(texts), 0))
                    for model in shared.value:
                        done = np.column_stack([done, model.predict(flat, counts, done)])
                    columns = [c.slice(start, len(texts)) for c in batch.columns] + [pa.array(done[:, i]) for i in range(len(names))]
                    yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *names])

        out = kept.mapInArrow(run, schema)
        return out.withColumns({f"is_{c}": F.col(f"p_{c}") >= self.thresholds.get(c, 0.5) for c in self.categories})


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in text_slices(batch.column(1), AT_ONCE):
            flat, counts = features(texts)
            ends = np.cumsum(counts)
            packed = [flat[e - n : e].astype("<i4").tobytes() for n, e in zip(counts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(packed, pa.binary())], ["k", "buckets"])


def _fitted(category: str, earlier: list[str]):
    """One model, from the rows of one group: all rows, or all but those of a fold."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        flat, counts, before = _unpacked(rows, earlier)
        m = fit_linear(flat, counts, before, rows[category].to_numpy(float))
        used = np.flatnonzero(m.weights)
        return pd.DataFrame({"fit": [rows["fit"].iloc[0]], "used": [used.tolist()], "weights": [m.weights[used].tolist()], "earlier": [m.earlier.tolist()], "constant": [m.constant]})

    return run


def _unpacked(rows: pd.DataFrame, earlier: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    arrays = [np.frombuffer(b, "<i4") for b in rows["buckets"]]
    flat = np.concatenate(arrays).astype(np.int64) if arrays else np.empty(0, np.int64)
    return flat, np.array([len(a) for a in arrays], np.int64), rows[earlier].to_numpy(float) if earlier else np.empty((len(rows), 0))


def _out_of_fold(models: dict[int, Linear], earlier: list[str], name: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            flat, counts, before = _unpacked(rows, earlier)
            made = {fold: m.predict(flat, counts, before) for fold, m in models.items()}
            own = rows["fold"].to_numpy()
            yield rows.assign(**{name: np.choose(own, [made[f] for f in range(FOLDS)])})

    return run


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Chain:
    """Fit on rows of `docs` joined with `labels` (key and one 0/1 column for each category)."""
    chain = Chain(list(categories))
    known = labels.select(F.col(key).alias("k"), *(F.col(c).cast("double").alias(c) for c in categories)).dropna()
    chosen = known.orderBy(F.xxhash64("k"), "k").limit(sample_rows)
    # at most sample_rows keys and labels
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen.select("k").distinct()), "k", "left_semi")
    kind = texts.schema["k"].dataType.simpleString()
    rows = texts.mapInArrow(_buckets, f"k {kind}, buckets binary").join(F.broadcast(chosen), "k")
    rows = materialize(rows.withColumn("fold", F.pmod(F.xxhash64("k", F.lit(7)), F.lit(FOLDS)).cast("int")), "tox-sample")
    for i, category in enumerate(categories):
        earlier = [f"p_{c}" for c in categories[:i]]
        # group FOLDS gets all rows, group f those outside fold f: bounded copies of a bounded sample
        groups = rows.withColumn("fit", F.explode(F.sequence(F.lit(0), F.lit(FOLDS)))).filter("fit <> fold").select("fit", "buckets", category, *earlier)
        schema = "fit int, used array<int>, weights array<double>, earlier array<double>, constant double"
        models = {}
        for r in groups.groupBy("fit").applyInPandas(_fitted(category, earlier), schema).collect():
            weights = np.zeros(1 << BUCKET_BITS, np.float32)
            weights[np.array(r["used"], np.int64)] = r["weights"]
            models[r["fit"]] = Linear(weights, np.array(r["earlier"], float), r["constant"])
        none = Linear(np.zeros(1 << BUCKET_BITS, np.float32), np.zeros(i), -30.0)
        chain.models.append(models.get(FOLDS, none))
        name = f"p_{category}"
        folds = {f: models.get(f, none) for f in range(FOLDS)}
        made = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])
        rows = materialize(rows.mapInPandas(_out_of_fold(folds, earlier, name), made), "tox-folds")
        chain.thresholds[category] = _threshold(rows, category)
    return chain


def _threshold(rows: DataFrame, category: str) -> float:
    """The probability from which a row counts as of the category: the best F1 on out-of-fold predictions, in steps of 0.001.

    Of a run of equally good steps the middle is taken; without rows of both kinds it is 0.5.
    """
    step = F.floor(F.col(f"p_{category}") * 1000).cast("int").alias("s")
    sums = rows.groupBy(step).agg(F.count_if(F.col(category) == 1).alias("yes"), F.count_if(F.col(category) == 0).alias("no"))
    counts = {r["s"]: (r["yes"], r["no"]) for r in sums.collect()}
    total = sum(yes for yes, _ in counts.values())
    if not total or total == sum(yes + no for yes, no in counts.values()):
        return 0.5
    scores, hits, said = {}, 0, 0
    for s in range(1000, -1, -1):
        yes, no = counts.get(s, (0, 0))
        hits, said = hits + yes, said + yes + no
        scores[s] = 2 * hits / (total + said)
    best = max(scores.values())
    top = max(s for s, f in scores.items() if f == best)
    low = top
    while low - 1 in scores and scores[low - 1] == best:
        low -= 1
    return max((top + low) / 2000, 0.001)
