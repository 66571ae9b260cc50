"""Hard-negative mining with exact whole-number scores from float32 products modulo small primes.

Components are scaled and floored to whole numbers. A tile (a block of rows and a block of anchors) multiplies its two
matrices once for each prime: residues are centred, so that sums of up to WIDTH products stay below 2**24 and float32
holds them exactly. The primes' product exceeds four times the largest possible score (the largest squared length, by
Cauchy and Schwarz), so the scores follow from the residues by Chinese remaindering in mixed radix, sign included.

Two passes. In the first, rows meet anchors of their own label only: labels are hashed to buckets, and a bucket of many
rows (a hot label) is cut into blocks. Its result, each anchor's few positives with their scores, goes with the anchor
into the second, where anchors meet all rows block by block and each (anchor, positive) keeps its best rows of another
label inside its window of scores. Tiles keep at most `negatives` rows for each (anchor, positive), so what is ranked at
the end grows with anchors times blocks, not with anchors times rows.

Rows with a null id, a null label, a null or empty vector, null or non-finite components, or another length than most
take no part; zero vectors do. An id names one row: rows that repeat an id count once, of differing ones that with the
greatest label, then the greatest vector. Equal scores go to the smaller id. An anchor without another row of its label,
and a positive without a row in its window, give no row; so does an empty table. Other columns are ignored, whatever
their names. Vectors with a squared length of 2**63 or more after scaling are an error, as scores must fit a long.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .groups import whole_groups

#: Components multiplied in one float32 product; longer vectors are added up in runs of these.
WIDTH = 1024
#: Rows and anchors of a tile at most, less for long vectors; anchors multiplied at once.
ROW_BLOCK, ANCHOR_BLOCK, CHUNK = 16_384, 4_096, 64
TILE_BYTES = 32 << 20
#: Tiles share tasks beyond this number.
MOST_TASKS = 20_000


def primes_for(bound: int, dimensions: int) -> list[int]:
    """The largest primes whose centred residues keep float32 sums exact, as many as scores of up to `bound` need."""
    half = math.isqrt((1 << 24) // max(1, min(dimensions, WIDTH)))
    found, product, p = [], 1, 2 * half + 1
    while product <= 4 * bound + 1:
        if all(p % q for q in range(2, math.isqrt(p) + 1)):
            found.append(p)
            product *= p
        p -= 1
    return found


def residues(values: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """For each prime the values' residues nearest to 0, as float32."""
    out = []
    for p in primes:
        r = values % p
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def exact_products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """left @ right.T as int64, from the residues of both."""
    value, base, digit = None, 1, None
    for a, b, p in zip(left, right, primes, strict=True):
        r = np.zeros((len(a), len(b)), np.int32)
        for at in range(0, a.shape[1], WIDTH):
            r = (r + (a[:, at : at + WIDTH] @ b[:, at : at + WIDTH].T).astype(np.int32)) % np.int32(p)
        # the next digit in mixed radix; 64-bit wrap-around is harmless, as scores themselves fit
        if value is None:
            value, digit = r.astype(np.int64), r
        else:
            digit = (r - (value % p if base < 1 << 62 else _wrapped(digits, primes, p))) * pow(base, -1, p) % p
            value = value + digit.astype(np.int64) * np.int64(base if base < 1 << 63 else (base + (1 << 63)) % (1 << 64) - (1 << 63))
        digits = [digit] if base == 1 else [*digits, digit]
        base *= p
    # positive scores lie below a quarter of the range, negative ones above three quarters
    over = base if base < 1 << 63 else (base + (1 << 63)) % (1 << 64) - (1 << 63)
    return np.where(2 * digit.astype(np.int64) > primes[-1], value - np.int64(over), value)


def _wrapped(digits: list[np.ndarray], primes: list[int], p: int) -> np.ndarray:
    """The value of mixed-radix digits modulo p, where the value itself may pass 64 bits."""
    total, base = 0, 1
    for d, q in zip(digits, primes):
        total, base = (total + d.astype(np.int64) * (base % p)) % p, base * q
    return total


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """The k allowed places of the highest scores, the first place first among equals."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        own = scores[at]
        least = np.partition(own, len(own) - k)[len(own) - k]
        above = at[own > least]
        at = np.concatenate([above, at[own == least][: k - len(above)]])
    return at[np.lexsort((at, -scores[at]))]


def prepared(df: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, v): one row an id, components as whole numbers."""
    whole = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    whole = whole.filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    length = whole.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    whole = whole.filter(F.size("v") == (length["n"] if length else 0))
    named = whole.groupBy("id").agg(F.max(F.struct("label", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))).alias("r"))
    return named.select("id", "r.label", "r.v")


def _tiles(rows: DataFrame, anchors: DataFrame, buckets: int, sizes: tuple[int, int], carried: str | None = None) -> DataFrame:
    """Rows and anchors, met block by block: (bucket, rb, ab, asks, id, label, v, windows), sorted in tasks of whole tiles.

    With `buckets`, labels are hashed to that many, and rows meet the anchors of their bucket; without, they meet all.
    """
    row_block, anchor_block = sizes
    if buckets:
        bucket = F.pmod(F.xxhash64("label"), F.lit(buckets))
        rows, anchors = rows.withColumn("bucket", bucket), anchors.withColumn("bucket", bucket)
        blocks = lambda n, most: F.ceil(F.col(n) / most).cast("long")
        rb = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", blocks("n", row_block).alias("rbs"))
        ab = anchors.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", blocks("n", anchor_block).alias("abs"))
        size = materialize(rb.join(ab, "bucket"), "negatives-blocks")
        tiles = size.agg(F.sum(F.col("rbs") * F.col("abs"))).first()[0] or 1
        rows, anchors = rows.join(size, "bucket"), anchors.join(size, "bucket")
    else:
        rbs, abs_ = (max(1, math.ceil(df.count() / most)) for df, most in ((rows, row_block), (anchors, anchor_block)))
        tiles, one = rbs * abs_, {"bucket": F.lit(0).cast("long"), "rbs": F.lit(rbs).cast("long"), "abs": F.lit(abs_).cast("long")}
        rows, anchors = rows.withColumns(one), anchors.withColumns(one)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")
    met = rows.select("bucket", F.pmod(F.xxhash64("id", F.lit(1)), "rbs").alias("rb"), every("abs").alias("ab"), F.lit(False).alias("asks"), "id", "label", "v", none.alias("windows"))
    ask = anchors.select("bucket", every("rbs").alias("rb"), F.pmod(F.xxhash64("id", F.lit(2)), "abs").alias("ab"), F.lit(True).alias("asks"), "id", "label", "v", (F.col(carried) if carried else none).alias("windows"))
    # by range, so that no two tiles fall into a task while others have none
    return met.unionByName(ask).repartitionByRange(min(tiles, MOST_TASKS), "bucket", "rb", "ab").sortWithinPartitions("bucket", "rb", "ab", "asks", "id")


def _scored(batches: Iterator[pa.RecordBatch], primes: list[int]) -> Iterator[tuple]:
    """For every anchor of every tile: its part's place, the anchors, the rows' ids and labels, and the rows' scores."""
    for table, starts in whole_groups(batches, ["bucket", "rb", "ab"]):
        for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            part = table.slice(start, end - start).combine_chunks()
            asks = part["asks"].to_numpy(zero_copy_only=False).astype(bool)
            n = int((~asks).sum())  # rows come before anchors
            if not n or n == len(asks):
                continue
            ids, labels = part["id"].to_numpy(), part["label"].to_numpy()
            vectors = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            own = residues(vectors[:n], primes)
            windows = part["windows"]
            for at in range(n, len(ids), CHUNK):
                some = slice(at, min(at + CHUNK, len(ids)))
                scores = exact_products(residues(vectors[some], primes), own, primes)
                for i in range(len(scores)):
                    yield ids[at + i], labels[at + i], windows[at + i], ids[:n], labels[:n], scores[i]


def _positives(primes: list[int], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchor, label, _, ids, labels, scores in _scored(batches, primes):
            at = best(scores, (labels == label) & (ids != anchor), k)
            yield _batch([np.full(len(at), anchor), np.full(len(at), label), ids[at], scores[at]], ["anchor_id", "label", "positive_id", "positive_score"])

    return run


def _negatives(primes: list[int], k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchor, label, windows, ids, labels, scores in _scored(batches, primes):
            other = labels != label
            for w in windows.as_py():
                least, most = -(-low * w["score"] // 100), high * w["score"] // 100
                at = best(scores, other & (scores >= least) & (scores <= most), k)
                if len(at):
                    yield _batch([np.full(len(at), anchor), np.full(len(at), w["id"]), np.full(len(at), w["score"]), ids[at], scores[at]], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)


def hard_negatives(
    df: DataFrame, is_anchor: Callable[[Column], Column], key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are the rows whose id `is_anchor`; an anchor's positives are its `positives` other rows of the same label with
    the highest scores; a negative's score lies between `low` and `high` percent of the positive's.
    """
    spark = df.sparkSession
    rows = materialize(prepared(df, key, vector, label, scale), "negatives-rows")
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total, longest, dimensions = rows.agg(F.count(F.lit(1)), F.max(length), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if longest >= 1 << 63:
        raise ValueError("scores may not fit 64 bits: a vector's squared length is 2**63 or more after scaling")
    # a double's rounding is covered
    primes = primes_for(int(longest * (1 + 1e-9)) + 1, dimensions)
    most = max(1, TILE_BYTES // (8 * dimensions))
    sizes = (min(row_block, most), min(anchor_block, most))
    anchors = rows.filter(is_anchor(F.col("id")))
    same = _tiles(rows, anchors, math.ceil(total / sizes[0]), sizes)
    found = same.mapInArrow(_positives(primes, positives), "anchor_id long, label long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= positives)
    windows = first.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("windows"))
    asks = materialize(anchors.join(windows, "id"), "negatives-anchors")
    every = _tiles(rows, asks, 0, sizes, "windows")
    near = every.mapInArrow(_negatives(primes, negatives, low, high), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
