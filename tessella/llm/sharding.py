"""Weighted rendezvous hashing of record keys to shards, in DataFrame functions only.

Each key draws one number for each shard from a hash of (key, shard); the shard with the highest score
weight / -ln(draw) wins. A new shard can only win keys from others, so one more shard moves rows only into itself.
Null keys are one key. Repeated rows of a key go to the same shard; ties go to the lower shard.
Columns named shard, slot or grown_shard are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dense_rank_in


def _score(key: Column, shard: int, weight: float) -> Column:
    """Greatest wins; the draw lies in (0, 1)."""
    draw = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.lit(float(weight)) / -F.log(draw)


def rendezvous(df: DataFrame, key: str, weights: list[float], grown_weight: float | None = None) -> DataFrame:
    """Add shard (0 to len(weights) - 1) and, with `grown_weight`, grown_shard: the shard when one of that weight is added."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    scores = [F.struct(_score(text, i, w).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights)]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = df.withColumn("__best", best).withColumn("shard", -F.col("__best.i"))
    if grown_weight is not None:
        new = _score(text, len(weights), grown_weight)
        out = out.withColumn("grown_shard", F.when(new > F.col("__best.s"), F.lit(len(weights))).otherwise(F.col("shard")))
    return out.drop("__best")


def assign_shards(df: DataFrame, key: str, weights: list[float], grown_weight: float | None = None) -> DataFrame:
    """`rendezvous` and slot: each row's gapless place from 0 within its shard, in the order of a hash of the key."""
    return dense_rank_in(rendezvous(df, key, weights, grown_weight), "shard", F.col(key), "slot")
