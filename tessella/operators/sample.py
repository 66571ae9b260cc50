"""Deterministic, order-free samples and quotas: rows are ranked by a hash of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *key: Column) -> Column:
    """A row's place in the seeded shuffle. md5, so that any SQL engine can repeat it."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))


def per_stratum(df: DataFrame, strata: list[str], n: int | Column, seed: int, key: str, exact: bool = False) -> DataFrame:
    """At most n rows of each stratum. With `exact` a stratum of fewer rows is an error.

    n may be a column, the same for all rows of a stratum; null takes all. Null strata are strata of their own.

    A stratum may hold most rows, so none is sorted whole: it is cut into 4,096 buckets of the shuffle, counts say which
    of them are wanted, and ranks are made within these only. With one n for all, Spark keeps n rows of a stratum in each
    partition before it shuffles.
    """
    by_draw = draw(seed, F.col(key))
    if isinstance(n, int) and not exact:
        own = Window.partitionBy(*strata).orderBy(by_draw, key)
        return df.withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= n).drop("_r")
    limit = F.lit(n) if isinstance(n, int) else n
    drawn = df.withColumns({"_d": by_draw, "_g": F.struct(*strata), "_n": limit}).withColumn("_b", _bucket("_d"))
    counts = drawn.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_k"), F.max("_n").alias("_n"))
    stratum = Window.partitionBy("_g")
    before = stratum.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.select("_g", "_b", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_o"), F.max("_n").over(stratum).alias("_n"), F.sum("_k").over(stratum).alias("_all"))
    if exact:
        sizes = sizes.filter(F.when(F.col("_all") < F.col("_n"), F.raise_error(F.lit("stratum too small"))).otherwise(F.lit(True)))
    wanted = sizes.filter("_n is null or _o < _n").select("_g", "_b", "_o", "_n")
    placed = drawn.drop("_n").join(wanted, ["_g", "_b"]).withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_d", key)))
    return placed.filter("_n is null or _o + _r <= _n").select(*df.columns)


def whole_table(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows of the table: a top-n of the shuffle, without a full sort."""
    return df.orderBy(draw(seed, F.col(key)), key).limit(n)


def split_off(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Add sampled: true for n rows drawn by hash, false for their complement. Rows of equal key stay together.

    The n-th row's draw is the bound; one row comes to the driver, and both parts are filters of the table, without a join.
    """
    at = F.struct(draw(seed, F.col(key)).alias("d"), F.col(key).alias("k"))
    if n <= 0:
        return df.withColumn("sampled", F.lit(False))
    bound = df.select(at.alias("at")).orderBy("at").limit(n).agg(F.max("at").alias("at")).first()["at"]
    if bound is None:
        return df.withColumn("sampled", F.lit(False))
    kind = df.schema[key].dataType
    return df.withColumn("sampled", at <= F.struct(F.lit(bound["d"]).alias("d"), F.lit(bound["k"]).cast(kind).alias("k")))


def round_robin(df: DataFrame, groups: list[str], n: int, seed: int, key: str) -> DataFrame:
    """n rows picked in turn from each group, groups in their order; in key order."""
    w = Window.partitionBy(*groups).orderBy(draw(seed, F.col(key)), key)
    return df.withColumn("_r", F.row_number().over(w)).orderBy("_r", *groups).limit(n).drop("_r").orderBy(key)


def fill_quota(df: DataFrame, key: list[str], cell: list[str], order: str, passes: Column, quota: int) -> DataFrame:
    """First `quota` rows of each cell in arrival order, of those that pass and are the first of their key."""
    first = Window.partitionBy(*key).orderBy(order)
    unique = df.filter(passes).withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")
    w = Window.partitionBy(*cell).orderBy(order)
    return unique.withColumn("quota_rank", F.row_number().over(w)).filter(F.col("quota_rank") <= quota)


def rejected_before_full(df: DataFrame, accepted: DataFrame, cell: list[str], order: str, reason: Column, quota: int) -> DataFrame:
    """(cell, reason, n): rejections that arrived before their cell was full; later attempts were never made."""
    full = accepted.groupBy(*cell).agg(F.max(order).alias("_last"), F.count(F.lit(1)).alias("_n"))
    joined = df.withColumn("reason", reason).filter("reason is not null").join(full, cell, "left")
    seen = joined.filter((F.coalesce(F.col("_n"), F.lit(0)) < quota) | (F.col(order) < F.col("_last")))
    return seen.groupBy(*cell, "reason").agg(F.count(F.lit(1)).alias("n"))


def shuffled(elements: Column, seed: int, *key: Column) -> Column:
    """An array in the seeded order of (key, element)."""
    keyed = F.array_sort(F.transform(elements, lambda x: F.struct(draw(seed, *key, x).alias("h"), x.alias("x"))))
    return F.transform(keyed, lambda p: p["x"])


def drawn_pairs(elements: Column, n: int, seed: int) -> Column:
    """At most n pairs `a,b` of an array's different elements, a before b, in the seeded order of pairs.

    Every pair is drawn, and after each first element only the n that come first are kept, so a row never holds all its pairs.
    """
    def pair(a: Column, b: Column) -> Column:
        s = F.concat_ws(",", a, b)
        return F.struct(draw(seed, s).alias("d"), s.alias("s"))

    def kept(own: Column) -> Column:
        firsts = F.transform(own, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        none = F.array().cast("array<struct<d: string, s: string>>")
        return F.aggregate(firsts, none, lambda found, a: F.slice(F.sort_array(F.concat(found, F.transform(F.slice(own, a["i"] + 2, F.size(own)), lambda b: pair(a["x"], b)))), 1, n))

    # as a variable, so that the elements are put in order once
    own = F.array(F.sort_array(F.array_distinct(F.array_compact(elements))))
    return F.transform(F.get(F.transform(own, kept), F.lit(0)), lambda p: p["s"])


def one_index(size: Column, seed: int, *key: Column) -> Column:
    """An index from 0 within `size`, the same for lists that are drawn together."""
    return F.pmod(F.conv(F.substring(draw(seed, *key), 1, 8), 16, 10).cast("long"), size)


def _bucket(drawn: str) -> Column:
    """Which of 4,096 buckets of the shuffle, which follow each other, a row falls in."""
    return F.substring(drawn, 1, 3)


def ranked(df: DataFrame, seed: int, key: str, rank: str) -> DataFrame:
    """Add the row's place, from 1, in the seeded shuffle of the whole table.

    Rows are ranked within 4,096 buckets of the shuffle; counts of the buckets give the offsets.
    """
    drawn = df.withColumn("_d", draw(seed, F.col(key))).withColumn("_b", _bucket("_d"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = drawn.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy("_d", key))
    # 4,096 rows at most
    placed = drawn.withColumn("_p", own).join(F.broadcast(offsets), "_b")
    return placed.withColumn(rank, F.col("_o") + F.col("_p")).drop("_b", "_d", "_p", "_o")


def balanced_schedule(df: DataFrame, levels: int, seed: int, key: str) -> DataFrame:
    """Add k: levels 1 to `levels` in turn over the shuffled rows, so that their numbers differ by one at most."""
    return ranked(df, seed, key, "_place").withColumn("k", F.pmod(F.col("_place") - 1, F.lit(levels)) + 1).drop("_place")


def hardest(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their rank."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
