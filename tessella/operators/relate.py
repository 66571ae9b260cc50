"""Joins that need care: set containment, near-equal sets, prefixes, exclusions, comparison of two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import checkpointed
from . import sample


#: Lengths that the prefixes of a table may have: each is an expression of the plan.
MOST_LENGTHS = 200


def _signature(items: Column) -> Column:
    """64 bits, one for each item's hash: a set lies in another only if its bits do."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    return F.aggregate(items, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(bit(x)))


def _lookup(small: DataFrame, large: DataFrame, group: list[str], proper: bool = True) -> tuple[DataFrame, DataFrame, Column]:
    """Both tables of sets `_s`, prepared for a join on equality, and the join's condition.

    A contained set shares its rarest item with what contains it. Each small set (`_a`) is looked up by that one item
    only, in the lists of items of the large ones (`_b`), so candidates grow with the rarest item's frequency and no pair
    is tried by more than one item. Signatures are compared before sets are.
    """
    items = large.select(*large.columns, F.explode("_s").alias("_i"))
    frequency = items.groupBy(*group, "_i").agg(F.count(F.lit(1)).alias("_f"))
    names = [c for c in small.columns if c not in (*group, "_s")]
    looked = small.select(*small.columns, F.explode("_s").alias("_i")).join(frequency, [*group, "_i"])
    rare = looked.groupBy(*group, *names, "_s").agg(F.min_by("_i", F.struct("_f", "_i")).alias("_i"))
    left = rare.withColumnRenamed("_s", "_a").withColumn("_wa", _signature(F.col("_a"))).alias("small")
    right = items.withColumnRenamed("_s", "_b").withColumn("_wb", _signature(F.col("_b"))).alias("large")
    size = F.size("_a") < F.size("_b") if proper else F.size("_a") <= F.size("_b")
    bits = F.col("_wa").bitwiseAND(F.bitwise_not("_wb")) == 0
    ok = size & bits & (F.size(F.array_except("_a", "_b")) == 0)
    for name in (*group, "_i"):
        ok = (F.col(f"small.{name}") == F.col(f"large.{name}")) & ok
    return left, right, ok


def _sets(sets: DataFrame, group: list[str], names: list, items: str) -> DataFrame:
    return sets.select(*group, *names, F.array_sort(F.array_distinct(items)).alias("_s")).filter(F.size("_s") > 0)


def contained_sets(sets: DataFrame, group: list[str], key: str, items: str, proper: bool = True) -> DataFrame:
    """(group, small, large): pairs of sets of a group of which the first lies in the second. Empty sets and null groups are left out."""
    small, large = (_sets(sets, group, [F.col(key).alias(name)], items) for name in ("small", "large"))
    left, right, ok = _lookup(small, large, group, proper)
    pairs = left.join(right, ok if proper else ok & (F.col("small.small") != F.col("large.large")))
    return pairs.select(*[F.col(f"small.{g}") for g in group], F.col("small.small"), F.col("large.large"))


def _holders(sets: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """(group, names) of the sets `_s` that hold another set of their group properly.

    A semi join: a set is done with the first set found in it, and gives a row at most for each of its items, however many
    it holds. Equal sets are looked up once.
    """
    left, right, ok = _lookup(sets.select(*group, "_s").distinct(), sets, group)
    return right.join(left, ok, "left_semi").select(*group, *[F.col("_b").alias(n) if n == "_s" else F.col(n) for n in names]).distinct()


def minimal_sets(sets: DataFrame, group: list[str], key: str, items: str) -> DataFrame:
    """Sets that hold no other set of their group. Equal sets don't hold each other, an empty one is held by none; null groups are kept."""
    held = _holders(_sets(sets, group, [key], items), group, [key])
    return sets.join(held, [*group, key], "left_anti")


#: A group of at most so many sets and elements is compared within its row, a larger one by joins.
ROW_SETS, ROW_ELEMENTS = 128, 4096


def union_of_contained(sets: DataFrame, group: list[str], key: str, items: str, carried: str) -> DataFrame:
    """(group, key, union): all `carried` elements of the sets strictly inside each set; a set that holds none has no row.

    Sets are written once and shuffled by their group. Null groups have no rows, and a set needs an element that isn't null
    to be found in another.
    """
    own = checkpointed(sets.select(*group, F.col(key).alias("_k"), F.array_sort(F.array_distinct(items)).alias("_s"), F.col(carried).alias("_c")).filter(F.size("_s") > 0).dropna(subset=group))
    sizes = own.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.size("_s") + F.greatest(F.size("_c"), F.lit(0))).alias("_m"))
    large = checkpointed(sizes.filter((F.col("_n") > ROW_SETS) | (F.col("_m") > ROW_ELEMENTS)).select(*group))
    if large.isEmpty():
        return _unions_in_rows(own, group).withColumnRenamed("_k", key)
    few = _unions_in_rows(own.join(large, group, "left_anti"), group)
    return few.unionByName(_unions_by_joins(own.join(large, group, "left_semi"), group)).withColumnRenamed("_k", key)


def _unions_in_rows(sets: DataFrame, group: list[str]) -> DataFrame:
    """(group, _k, union), with all sets of a group in one row."""
    held = sets.groupBy(*group).agg(F.collect_list(F.struct("_k", "_s", "_c")).alias("_all"))

    def inside(b: Column) -> Column:
        fits = lambda a: (F.size(a["_s"]) < F.size(b["_s"])) & F.exists(a["_s"], F.isnotnull) & (F.size(F.array_except(a["_s"], b["_s"])) == 0)
        found = F.transform(F.filter("_all", fits), lambda a: F.coalesce(a["_c"], F.array().cast(sets.schema["_c"].dataType)))
        return F.struct(b["_k"].alias("_k"), F.when(F.size(found) > 0, F.array_sort(F.array_distinct(F.flatten(found)))).alias("union"))

    return held.select(*group, F.explode(F.transform("_all", inside)).alias("_u")).select(*group, "_u.*").filter("union is not null")


def _unions_by_joins(sets: DataFrame, group: list[str]) -> DataFrame:
    """(group, _k, union). An element is looked for in the smallest sets that carry it: those which hold another carrier of it add
    nothing. So pairs are those of a set with its elements' smallest carriers, and equal sets are joined once."""
    boxed = F.transform("_c", lambda x: F.struct(x.alias("v")))
    carriers = sets.select(*group, "_s", F.explode_outer(boxed).alias("_c")).distinct()
    # sets without elements have a null there: they are equal to none, so all stay, and their holders get a row
    smallest = carriers.join(_holders(carriers, [*group, "_c"], ["_s"]), [*group, "_c", "_s"], "left_anti")
    named = sets.select(*group, "_k", "_s")
    left, right, ok = _lookup(smallest, named.select(*group, "_s").distinct(), group)
    inside = left.join(right, ok).select(*[F.col(f"small.{g}") for g in group], F.col("_b").alias("_s"), "_c")
    unions = inside.groupBy(*group, "_s").agg(F.array_sort(F.transform(F.collect_set("_c"), lambda x: x["v"])).alias("union"))
    return named.join(unions, [*group, "_s"]).select(*group, "_k", "union")


def differ_on_one(left: DataFrame, right: DataFrame, group: list[str], key: str, items: str) -> DataFrame:
    """(group, a, b, dropped_a, dropped_b): sets of equal size that agree on all elements but one each.

    Each set is looked up by its variants with one element left out; the join is on equality.
    """

    def variants(df: DataFrame, name: str) -> DataFrame:
        s = df.select(*group, F.col(key).alias(name), F.array_sort(F.array_distinct(items)).alias("_s"))
        e = s.select(*group, name, "_s", F.explode("_s").alias(f"dropped_{name}"))
        return e.select(*group, name, f"dropped_{name}", F.array_remove(F.col("_s"), F.col(f"dropped_{name}")).alias("_rest"))

    pairs = variants(left, "a").join(variants(right, "b"), [*group, "_rest"])
    return pairs.filter(F.col("dropped_a") != F.col("dropped_b")).select(*group, "a", "b", "dropped_a", "dropped_b")


def labels_of_others(labels: DataFrame, owner: str, label: str) -> DataFrame:
    """(owner, label): labels that some other owner has and this one hasn't.

    The result itself has a row for each owner and foreign label; owners are few (one for each guideline).
    """
    own = labels.select(owner, label).distinct()
    offered = own.select(owner).distinct().crossJoin(own.select(label).distinct())
    return offered.join(own, [owner, label], "left_anti")


def drawn_labels_of_others(labels: DataFrame, owner: str, label: str, n: int, seed: int) -> DataFrame:
    """(owner, label): the first n labels, in the seeded order, that some other owner has and this one hasn't.

    Labels are ranked once for all owners. Of an owner with m labels the first n others have ranks of n + m at most, so
    these ranks are drawn and its own are taken away: rows grow with what owners have, not with owners times labels.
    Null owners and labels take no part.
    """
    own = labels.select(owner, label).filter(F.col(owner).isNotNull() & F.col(label).isNotNull()).distinct()
    ranked = sample.ranked(own.select(label).distinct(), seed, label, "_r")
    held = own.join(ranked, label).select(owner, "_r")
    reach = held.groupBy(owner).agg((F.count(F.lit(1)) + n).alias("_m"))
    tried = reach.select(owner, F.explode(F.sequence(F.lit(1).cast("long"), "_m")).alias("_r")).join(held, [owner, "_r"], "left_anti")
    first = tried.join(ranked, "_r").withColumn("_p", F.row_number().over(Window.partitionBy(owner).orderBy("_r"))).filter(F.col("_p") <= n)
    return first.select(owner, label)


def prefix_lookup(df: DataFrame, name: str, table: DataFrame, prefix: str, order: str, value: str, default: Column) -> DataFrame:
    """Add `value` of the first entry of a small table, in its order, that `name` equals or starts with.

    Names are cut to the lengths that prefixes have (as many as the longest prefix has characters, at most), so that
    the join is on equality.
    """
    lengths = [r[0] for r in table.select(F.length(prefix)).distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"prefixes have more than {MOST_LENGTHS} lengths")
    cut = F.array(*[F.when(F.length(name) >= n, F.substring(F.col(name), 1, n)) for n in sorted(lengths)])
    names = df.select(name).distinct().withColumn("_p", F.explode(F.array_compact(cut)))
    found = names.join(table.select(F.col(prefix).alias("_p"), order, value), "_p").groupBy(name).agg(F.min_by(value, order).alias(value))
    return df.join(found, name, "left").withColumn(value, F.coalesce(F.col(value), default))


def first_pool(items: DataFrame, item: str, pools: DataFrame, pool: str, pool_pos: str, candidate: str, default: str) -> DataFrame:
    """Add pool: the first pool that holds the item, else `default`."""
    found = pools.groupBy(F.col(candidate).alias(item)).agg(F.min_by(pool, pool_pos).alias("pool"))
    return items.join(found, item, "left").withColumn("pool", F.coalesce("pool", F.lit(default)))


def filled_grid(left: DataFrame, right: DataFrame, counts: DataFrame, on: list[str], value: str) -> DataFrame:
    """Every combination of two small lists with its count, 0 where there is none."""
    grid = left.distinct().crossJoin(right.distinct())
    return grid.join(counts, on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def differences(reported: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status): rows of one table only, as `extra` (reported only) or `missing` (found only)."""
    sides = reported.select(*keys, F.lit(True).alias("_r")).unionByName(found.select(*keys, F.lit(False).alias("_r")))
    held = sides.groupBy(*keys).agg(F.bool_and("_r").alias("_all"), F.bool_or("_r").alias("_any"))
    return held.filter("_all or not _any").select(*keys, F.when(F.col("_all"), "extra").otherwise("missing").alias("status"))


def unanswered(requests: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Distinct requests without an answer: what is left to ask."""
    return requests.dropDuplicates([key]).join(answers.select(key), key, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose key the parent lacks; null keys are orphans."""
    return child.join(parent.select(key), key, "left_anti")


def setting_changes(current: DataFrame, stored: DataFrame, name: str, value: str) -> DataFrame:
    """(name, current, stored) of settings that differ, null for one that a side lacks."""
    a = current.select(name, F.col(value).alias("current"))
    b = stored.select(name, F.col(value).alias("stored"))
    return a.join(b, name, "full_outer").filter(~F.col("current").eqNullSafe(F.col("stored")))


def keep_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key, by one aggregation."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*key, "_r.*")


def consistent_states(worlds: DataFrame, contexts: DataFrame, on: list[str]) -> DataFrame:
    """Worlds that agree with a context: state & mask = value, within equal `on` columns."""
    return worlds.join(contexts, on).filter(F.col("state").bitwiseAND(F.col("mask")) == F.col("value"))


def zip_positions(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row for each position of two arrays of equal length; others are an error."""
    same = F.when(F.size(left) == F.size(right), F.arrays_zip(left, right)).otherwise(F.raise_error(F.lit("lengths differ")))
    return df.select("*", F.posexplode(same).alias("pos", "_z")).select(*[c for c in df.columns if c not in (left, right)], "pos", f"_z.{left}", f"_z.{right}")


def partition_rank(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows of the first n distinct values of a column."""
    first = df.select(column).distinct().orderBy(column).limit(n)
    return df.join(F.broadcast(first), column, "left_semi")


def with_group_rank(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
