"""Approximate nearest neighbours by multi-index hashing.

Codes are signs of vectors under rotations learned on a bounded sample (iterative quantisation: principal axes, then a
rotation that brings points near the corners of a cube). A code is cut into substrings of SUB bits. Index and queries
meet in tiles: a block of index rows, in which every substring has its own table from value to rows, and a block of
queries. Within a code distance r some substring differs in at most r // (number of substrings) bits, so probing all
values that near in every table retrieves each code within r; these are checked on whole codes, then ranked by the
exact distance of the original vectors. r is learned on the sample: the least that keeps RECALL of its true neighbours.

How much the probes spare depends on the vectors: where neighbours are near, few bits may be wrong and few rows are
probed (`probed` tells the share); where the tenth neighbour is nearly as far as the thousandth, nearly all are.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part. Equal
distances go to the smaller id. Of rows that repeat an id the nearest one counts, and a list names an id once, never the
query's own; a query id that is repeated gets one list, of the nearest to any of its rows. Without vectors or queries the result is empty.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, run_starts
from .groups import whole_groups

SAMPLE_ROWS = 8192
#: Neighbour pairs of the sample that the radius must cover, and how many queries of the sample are tried.
RECALL, TRIED = 0.985, 256
ROTATIONS, DIMENSIONS, SUB = 2, 64, 8
INDEX_BLOCK, QUERY_BLOCK = 65_536, 16_384

_COUNTS = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_APART = _COUNTS[np.arange(256)[:, None] ^ np.arange(256)[None, :]]


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors as doubles that are whole, finite and not zero, of the most common length."""
    v = F.col(vector).cast("array<double>")
    whole = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    length = whole.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return whole.filter(F.size("v") == (length["n"] if length else 0))


class Codes:
    """Learned rotations and radius."""

    def __init__(self, sample: np.ndarray, recall: float = RECALL, k: int = 10):
        rng = np.random.default_rng(5)
        self.mean = sample.mean(0)
        centred = sample - self.mean
        p = min(DIMENSIONS, sample.shape[1])
        axes = np.linalg.svd(centred.T @ centred)[0][:, :p]
        low = centred @ axes
        self.rotations = []
        for _ in range(ROTATIONS):
            r = np.linalg.qr(rng.normal(size=(p, p)))[0]
            for _ in range(20):
                u, _, vt = np.linalg.svd(np.where(low @ r > 0, 1.0, -1.0).T @ low)
                r = (u @ vt).T
            self.rotations.append(axes @ r)
        self.parts = math.ceil(p * ROTATIONS / SUB)
        self.radius = self._learn(sample, recall, k)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """A row of bytes, one for each substring."""
        centred = vectors - self.mean
        return np.packbits(np.concatenate([centred @ r > 0 for r in self.rotations], axis=1), axis=1)

    def _learn(self, sample: np.ndarray, recall: float, k: int) -> int:
        codes, tried = self.of(sample), min(TRIED, len(sample))
        squares = (sample**2).sum(1)
        apart = []
        for i in range(tried):
            d = squares - 2 * sample @ sample[i]
            d[i] = np.inf
            near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
            apart += _APART[codes[near], codes[i]].sum(1, dtype=np.int64).tolist()
        return int(np.ceil(np.quantile(apart, recall))) if apart else self.parts * SUB


def probed(index: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of queries: the first one's number, and for each the rows of `index` that share a near enough substring.

    Each substring has a table of its own, from value to rows. With `parts` substrings, a code within the radius
    differs from the query's in at most radius // parts bits of some substring; and after the first
    (radius % parts) + 1 substrings, in at most one bit less.
    """
    parts = index.shape[1]
    tables = []
    for j in range(parts):
        allowed = radius // parts - (j > radius % parts)
        order = np.argsort(index[:, j], kind="stable")
        bounds = np.searchsorted(index[:, j][order], np.arange(257))
        near = [np.concatenate([order[bounds[u] : bounds[u + 1]] for u in np.flatnonzero(_APART[v] <= allowed)] or [order[:0]]) for v in np.unique(queries[:, j])]
        tables.append(dict(zip(np.unique(queries[:, j]).tolist(), near, strict=True)))
    for start in range(0, len(queries), 64):
        own = queries[start : start + 64]
        seen = np.zeros((len(own), len(index)), bool)
        for j, near in enumerate(tables):
            for q, v in enumerate(own[:, j].tolist()):
                seen[q, near[v]] = True
        yield start, seen


def probe(index: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query code its number and the rows of `index` within `radius`."""
    for start, seen in probed(index, queries, radius):
        for q in range(len(seen)):
            rows = np.flatnonzero(seen[q])
            yield start + q, rows[_APART[index[rows], queries[start + q]].sum(1, dtype=np.int64) <= radius]


def _search(codes: Codes, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["tile"]):
            for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                part = table.slice(start, end - start).combine_chunks()
                asks = part["asks"].to_numpy(zero_copy_only=False).astype(bool)
                ids = part["id"].to_numpy()
                flat = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
                vectors = flat.reshape(len(ids), -1)
                own, own_ids, asked, asked_ids = vectors[~asks], ids[~asks], vectors[asks], ids[asks]
                if not len(own) or not len(asked):
                    continue
                out, repeated = [], len(np.unique(own_ids)) < len(own_ids)
                for q, rows in probe(codes.of(own), codes.of(asked), codes.radius):
                    rows = rows[own_ids[rows] != asked_ids[q]]
                    d = np.sqrt(((own[rows] - asked[q]) ** 2).sum(1))
                    if repeated:
                        nearer = np.lexsort((d, own_ids[rows]))
                        nearer = nearer[run_starts(own_ids[rows][nearer])] if len(nearer) else nearer
                        rows, d = rows[nearer], d[nearer]
                    if len(rows) > k:
                        kept = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                        rows, d = rows[kept], d[kept]
                    best = np.lexsort((own_ids[rows], d))[:k]
                    out.append((np.full(len(best), asked_ids[q]), own_ids[rows[best]], d[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return run


def nearest(df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 10, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: up to k nearest of each query row. `is_query`: id column to boolean column.

    A query whose probe finds fewer than k rows searches all rows instead, so none gets fewer than there are.
    """
    spark = df.sparkSession
    rows = materialize(valid_vectors(df, key, vector), "ann-rows")
    total = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toArrow()
    codes = Codes(picked["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(picked.num_rows, -1), k=k)
    found = _tiles(rows, is_query, total, codes, k)
    short = materialize(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "ann-found")
    queries = rows.filter(is_query(F.col("id")))
    wanted = min(k, rows.select("id").distinct().count() - 1)
    few = queries.select("id").distinct().join(short.filter(F.col("n") >= wanted).select(F.col("query_id").alias("id")), "id", "left_anti")
    few = materialize(few, "ann-few")
    if not few.isEmpty():
        whole = Codes.__new__(Codes)
        whole.__dict__ = codes.__dict__ | {"radius": codes.parts * SUB}
        again = _tiles(rows, is_query, total, whole, k, few)
        found = found.join(few.withColumnRenamed("id", "query_id"), "query_id", "left_anti").unionByName(again)
    return found


def _tiles(rows: DataFrame, is_query, total: int, codes: Codes, k: int, only: DataFrame | None = None) -> DataFrame:
    queries = rows.filter(is_query(F.col("id")))
    if only is not None:
        queries = queries.join(only, "id")
    asked = queries.count()
    spread = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(math.ceil(total / INDEX_BLOCK), min(spread, math.ceil(total / 4096)), 1)
    groups = max(math.ceil(asked / QUERY_BLOCK), 1)
    ib, qb = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(groups))
    # a tile holds a block of either side: the stated queries meet all rows, block by block
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    index = rows.select(ib.cast("long").alias("ib"), every(groups).alias("qb"), "id", "v").select((F.col("ib") * groups + F.col("qb")).alias("tile"), F.lit(False).alias("asks"), "id", "v")
    asks = queries.select(every(blocks).alias("ib"), qb.cast("long").alias("qb"), "id", "v").select((F.col("ib") * groups + F.col("qb")).alias("tile"), F.lit(True).alias("asks"), "id", "v")
    # by range, so that no two tiles fall into a task while others have none
    tiles = index.unionByName(asks).repartitionByRange(blocks * groups, "tile").sortWithinPartitions("tile")
    best = tiles.mapInArrow(_search(codes, k), "query_id long, vec_id long, score double")
    # rows that repeat an id share a block; only a repeated query names a candidate twice
    best = best.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
