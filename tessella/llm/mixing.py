"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's rows, in a fixed hash order, form blocks. With whole weights a_s that sum to q, block i of a source has
its release at slot floor(i q / a_s) and its deadline at ceil((i + 1) q / a_s); in each slot the released block of the
earliest deadline goes next, ties to the source first by name. Within a period of q slots each source gets exactly a_s
slots and is never a block or more off a_s / q, and the schedule repeats, so one period is scheduled, whatever the
data, and every block looks up its slot.

Weights are rounded to whole ones by largest remainders. Sources that would get less than a slot of a period aren't
rounded up: together they are one source of the level, which gets a slot at least, and its slots are scheduled among them
by a level of their own, with a period of its own, and so on. So at every level a share (of the level's slots) is rounded
by less than 1 / PERIOD, a source's error is its pools' errors times its part of them, and the number of sources has no
bound. A pooled source is less than a block off within its pool's slots, to which the pool's own block adds at most
the source's part of the pool. A level has at most as many levels below it as the weights' range takes, by factors of
4 at least.

Sources of equal whole weight have equal releases and deadlines and take turns by name, so the scheduler's state has one
entry for each different weight: about 200 at most where they sum to 20,000, however many sources there are.

No row is dropped: a source that runs out leaves its slots to the others, in order. Null sources are a source of their
own. A source whose weight is zero, null or not given comes after all others, block by block in turn with those like it;
negative or infinite weights and a source named twice in the weights are errors. Rows that repeat a key are ranked each,
in any order. Empty tables give an empty result. Extra columns pass through; columns named as the operator's own are
replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dense_rank_in, materialize

#: Slots of a period at least.
PERIOD = 20_000
#: Slots that are scheduled before their list is joined to the period's.
RUN = 200
BLOCK_ROWS = 16
#: Rows of a level's tables up to which they are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 200_000


def target_weights(sizes: DataFrame, power: float = 0.5) -> DataFrame:
    """Default target: a source's share is its number of rows to `power`, so large sources count for less."""
    return sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(power)))


def whole_weights(weights: DataFrame, period: int = PERIOD) -> tuple[DataFrame, DataFrame]:
    """(source, weight) to (source, pool, a, s, q) of a level, and the (source, weight) that its pool holds.

    Whole weights a by largest remainders, sources numbered by name (s), and their sum q; the pool is a row with `pool` true,
    a null source and the last number. `weights` has one row a source, and positive weights.
    """
    total, most = weights.agg(F.sum("weight"), F.max("weight")).first()
    if total is None:
        total = most = 1.0
    # the largest weight gets four slots or more
    size = max(period, math.ceil(4 * total / most * (1 - 1e-12)))
    exact = weights.withColumn("exact", F.col("weight") / F.lit(total) * size)
    kept, small = exact.filter("exact >= 1"), exact.filter("exact < 1")
    pool = small.agg(F.sum("weight").alias("weight"), F.sum("exact").alias("exact")).filter("exact is not null")
    pool = pool.select(F.lit(None).cast(weights.schema["source"].dataType).alias("source"), "weight", F.greatest("exact", F.lit(1.0)).alias("exact"), F.lit(True).alias("pool"))
    level = kept.withColumn("pool", F.lit(False)).unionByName(pool)
    # a level has at most `size` rows
    every = Window.partitionBy()
    left = F.lit(size) - F.sum(F.floor("exact")).over(every)
    place = F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.floor("exact")), "pool", "source"))
    dealt = level.withColumn("a", (F.floor("exact") + (place <= left).cast("int")).cast("int"))
    numbered = dealt.withColumn("s", F.row_number().over(Window.orderBy("pool", "source")) - 1)
    return numbered.withColumn("q", F.sum("a").over(every).cast("int")).drop("exact"), small.select("source", "weight")


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def schedule(weights: DataFrame) -> DataFrame:
    """Earliest deadline first over one period: (s, a, q, nth, slot, release, deadline), q rows in all.

    `weights`: (s, a, q). The state has, for each different weight, which block and which of its sources is next.
    """
    classes = weights.groupBy("a", "q").agg(F.array_sort(F.collect_list("s")).alias("members"))
    one = classes.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("a", "members"))).alias("classes"))

    def release(i: Column, a: Column) -> Column:
        return F.floor(i.cast("long") * F.col("q") / a).cast("int")

    def deadline(i: Column, a: Column) -> Column:
        return F.ceil((i.cast("long") + 1) * F.col("q") / a).cast("int")

    # a weight's next block: its number, whose turn it is, its release, its deadline and the source
    def entry(i: Column, turn: Column, c: Column) -> Column:
        return F.struct(
            i.alias("i"), turn.alias("turn"), F.when(i < c["a"], release(i, c["a"])).otherwise(F.col("q")).alias("r"), deadline(i, c["a"]).alias("d"), F.get(c["members"], turn).alias("s")
        )

    def after(x: Column, c: Column) -> Column:
        last = x["turn"] + 1 == F.size(c["members"])
        return entry(F.when(last, x["i"] + 1).otherwise(x["i"]), F.when(last, F.lit(0)).otherwise(x["turn"] + 1), c)

    def step(state: Column, slot: Column) -> Column:
        first = F.array_min(F.transform(state["next"], lambda x, k: F.when(x["r"] <= slot, F.struct(x["d"].alias("d"), x["s"].alias("s"), k.alias("k")))))

        def taken(pick: Column) -> Column:
            k = pick["k"]
            later = F.concat(F.slice(state["next"], F.lit(1), k), F.array(after(F.get(state["next"], k), F.get(F.col("classes"), k))), F.slice(state["next"], k + 2, F.size("classes")))
            return F.struct(later.alias("next"), F.array_append(state["slots"], pick["s"]).alias("slots"))

        return _bound(first, taken)

    def run(state: Column, first: Column) -> Column:
        last = F.least(first + RUN, F.col("q")) - 1
        start = F.struct(state["next"].alias("next"), F.array().cast("array<int>").alias("slots"))
        return F.aggregate(F.sequence(first, last), start, step, lambda s: F.struct(s["next"].alias("next"), F.array_append(state["runs"], s["slots"]).alias("runs")))

    start = F.struct(F.transform("classes", lambda c: entry(F.lit(0), F.lit(0), c)).alias("next"), F.array().cast("array<array<int>>").alias("runs"))
    slots = F.aggregate(F.sequence(F.lit(0), F.col("q") - 1, F.lit(RUN)), start, run, lambda s: F.flatten(s["runs"]))
    picked = one.select(F.posexplode(slots).alias("slot", "s"))
    nth = F.row_number().over(Window.partitionBy("s").orderBy("slot")) - 1
    joined = picked.withColumn("nth", nth).join(weights.select("s", "a", "q"), "s")
    return joined.withColumn("release", F.floor(F.col("nth").cast("long") * F.col("q") / F.col("a")).cast("int")).withColumn(
        "deadline", F.ceil((F.col("nth").cast("long") + 1) * F.col("q") / F.col("a")).cast("int")
    )


def checked_weights(sizes: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, n, weight) of every source of the table; sources without a weight get 0."""
    odd = (F.col("weight") < 0) | F.isnan(F.col("weight").cast("double")) | (F.abs(F.col("weight").cast("double")) == float("inf"))
    if not weights.filter(odd).isEmpty():
        raise ValueError("weights must be finite and not negative")
    if not weights.groupBy("source").count().filter("count > 1").isEmpty():
        raise ValueError("a source is named twice in the weights")
    same = sizes["source"].eqNullSafe(weights["source"])
    return sizes.join(weights, same, "left").select(sizes["source"], "n", F.coalesce(weights["weight"].cast("double"), F.lit(0.0)).alias("weight"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table if it was counted and is small."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def levels(weights: DataFrame, period: int = PERIOD) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(level, source, a, q) of every source; (level, source, nth, slot, release, deadline) of its blocks in a period of its
    level; and for each level but the last (pa, pq, pnth, pslot), the slots of its pool. weights: (source, weight), all positive."""
    sources, tables, pools, n = None, None, [], 0
    left = weights.select("source", "weight")
    while True:
        whole, rest = whole_weights(left, period)
        whole = materialize(whole, "mix-weights")
        slots = materialize(schedule(whole).join(whole.select("s", "source", "pool"), "s"), "mix-period")
        own = whole.filter("not pool").select(F.lit(n).alias("level"), "source", "a", "q")
        table = slots.filter("not pool").select(F.lit(n).alias("level"), "source", "nth", "slot", "release", "deadline")
        sources, tables = (own, table) if sources is None else (sources.unionByName(own), tables.unionByName(table))
        left = materialize(rest, "mix-pool")
        if left.isEmpty():
            return sources, tables, pools
        pools.append(slots.filter("pool").select(F.col("a").alias("__mix_pa"), F.col("q").alias("__mix_pq"), F.col("nth").alias("__mix_pnth"), F.col("slot").alias("__mix_pslot")))
        n += 1


def mix_sources(
    df: DataFrame,
    source: str = "source",
    key: str = "doc_id",
    weights: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
    period: int = PERIOD,
) -> DataFrame:
    """Add block (of its source, from 0), period, slot, release, deadline, place (in the block) and global_slot.

    Rows in the order of (global_slot, place) are the mix. Period, slot, release and deadline count the slots of the
    source's level (for all but pooled sources, the slots of the mix: global_slot = period * q + slot). global_slot grows
    without ties between blocks. Sources of weight 0 have no period, slot, release and deadline. `weights`: (source,
    weight); default `target_weights`.
    """
    made = ["block", "period", "slot", "release", "deadline", "place", "global_slot"]
    df = df.drop(*made)
    sizes = materialize(df.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    given = target_weights(sizes) if weights is None else checked_weights(sizes, weights)
    given = materialize(given, "mix-given")
    whole, table, pools = levels(given.filter("weight > 0"), period)
    whole, pools = materialize(whole, "mix-sources"), [_small(materialize(p, "mix-slots")) for p in pools]
    table = materialize(table, "mix-table")
    # sources of weight 0 take turns after the last slot that any other can have
    blocks = F.ceil(F.col("n") / block_rows)
    bound = given.join(whole, given["source"].eqNullSafe(whole["source"])).select("level", ((F.floor((blocks - 1) / F.col("a")) + 1) * F.col("q")).alias("u"))
    last = bound.groupBy("level").agg(F.max("u").alias("u"))
    for n in range(len(pools) - 1, -1, -1):
        sizes_of = pools[n].agg(F.max("__mix_pa"), F.max("__mix_pq")).first()
        up = (F.floor((F.col("u") - 1) / sizes_of[0]) + 1) * sizes_of[1]
        last = last.withColumn("u", F.when(F.col("level") > n, up).otherwise(F.col("u")))
    end = last.agg(F.max("u")).first()[0] or 0
    idle = given.filter("weight = 0").select(F.col("source"), F.row_number().over(Window.orderBy("source")).alias("turn"), F.count(F.lit(1)).over(Window.partitionBy()).alias("turns"))
    per_source = whole.unionByName(idle, allowMissingColumns=True)
    per_source = materialize(per_source.select(*[F.col(c).alias(f"__mix_{c}") for c in ("source", "level", "a", "q", "turn", "turns")]), "mix-per-source")
    slots = table.select(F.col("level").alias("__mix_l"), F.col("source").alias("__mix_t"), F.col("nth").alias("__mix_n"), "slot", "release", "deadline")
    ranked = dense_rank_in(df, source, F.col(key), "__mix_row")
    of_source = ranked.join(_small(per_source), F.col(source).eqNullSafe(F.col("__mix_source")))
    blocked = of_source.withColumn("block", F.floor(F.col("__mix_row") / block_rows)).withColumns(
        {
            "place": (F.col("__mix_row") % block_rows).cast("int"),
            "period": F.floor(F.col("block") / F.col("__mix_a")),
            "__mix_i": (F.col("block") % F.col("__mix_a")).cast("int"),
        }
    )
    same = F.col(source).eqNullSafe(F.col("__mix_t")) & (F.col("__mix_i") == F.col("__mix_n")) & (F.col("__mix_level") == F.col("__mix_l"))
    placed = blocked.join(_small(slots), same, "left").withColumn("__mix_u", F.col("period") * F.col("__mix_q") + F.col("slot"))
    # a pooled source's slot is a block of the pool, which has its slot one level up
    for n in range(len(pools) - 1, -1, -1):
        pa = pools[n].select("__mix_pa").first()[0]
        nth = F.when(F.col("__mix_level") > n, F.col("__mix_u") % pa)
        placed = placed.join(pools[n], nth == F.col("__mix_pnth"), "left")
        up = F.floor(F.col("__mix_u") / F.col("__mix_pa")) * F.col("__mix_pq") + F.col("__mix_pslot")
        placed = placed.withColumn("__mix_u", F.coalesce(up, F.col("__mix_u"))).drop("__mix_pa", "__mix_pq", "__mix_pnth", "__mix_pslot")
    turn = F.lit(end) + F.col("block") * F.col("__mix_turns") + F.col("__mix_turn") - 1
    placed = placed.withColumn("global_slot", F.coalesce("__mix_u", turn))
    return placed.drop(*[f"__mix_{c}" for c in ("row", "source", "level", "a", "q", "turn", "turns", "l", "t", "n", "i", "u")])
