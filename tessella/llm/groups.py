"""Streams of whole groups from sorted partitions, and connected components by large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold only whole groups of equal long `keys`, and where each group starts (and the end).

    The partition must be sorted by `keys`. What is held at once is an Arrow batch and one group.
    """
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        starts = _starts(held, keys)
        if len(starts) > 1:
            yield held.slice(0, starts[-1]), starts
            held = held.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held, np.append(_starts(held, keys), held.num_rows)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    if table.num_rows:
        new[0] = True
        for k in keys:
            column = table[k].to_numpy()
            new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


class Forest:
    """Union-find over the rows 0 to n - 1; a root is its tree's lowest row."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(root, row) of every row that isn't a root."""
        rows = [i for i, u in enumerate(self.up) if u != i]
        return np.array([self.root(i) for i in rows], np.int64), np.array(rows, np.int64)


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): the smallest node that each linked node reaches.

    Each round rewires links towards smaller nodes, large-star then small-star, until nothing changes; the number of
    links never grows. Minima are pre-aggregated and joined back, so a hub's links are not gathered in one task.
    """
    spark = links.sparkSession
    edges = materialize(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
        edges = materialize(small.filter("a <> b").distinct(), "links")
        new = _state(edges)
        if new == state:
            break
        state = new
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
