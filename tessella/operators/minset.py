"""Minimal sufficient sets of variables: functional dependencies, levelwise search, verification.

A problem's worlds are bit-packed states with an outcome y. A set of variables is sufficient when equal bits on it
imply equal y. Sets are bit masks; a level's candidate masks are joined with the worlds on the problem and reduced by
one aggregation, so the work is spread over (problem, mask, pattern).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import checkpointed


def bit(state: Column, index: Column) -> Column:
    return F.getbit(state, index)


def mask_of(indices: Column) -> Column:
    """Bits set at an array of indices."""
    return F.aggregate(indices, F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))))


def value_of(indices: Column, values: Column) -> Column:
    """Bits of an assignment: set where the value at the same position is 1."""
    chosen = F.filter(F.arrays_zip(indices.alias("i"), values.alias("v")), lambda p: p["v"] == 1)
    return mask_of(F.transform(chosen, lambda p: p["i"]))


def bitstring(state: Column, n: int) -> Column:
    """Bits from index 0 to n - 1 as text."""
    return F.reverse(F.substring(F.lpad(F.bin(state), 64, "0"), 64 - n + 1, n))


def pack(flags: list[Column]) -> Column:
    """Booleans as bits 0, 1, ... of a long."""
    parts = [F.when(f, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, f in enumerate(flags)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def sufficient(worlds: DataFrame, masks: DataFrame, problem: str = "problem_id") -> DataFrame:
    """(problem, mask, is_sufficient): whether y is constant for equal bits under the mask."""
    pairs = worlds.join(masks.select(problem, "mask"), problem)
    patterns = pairs.groupBy(problem, "mask", F.col("state").bitwiseAND(F.col("mask")).alias("_p")).agg(F.min("y").alias("_a"), F.max("y").alias("_b"))
    return patterns.groupBy(problem, "mask").agg(F.bool_and(F.col("_a") == F.col("_b")).alias("is_sufficient"))


def grow(masks: DataFrame, variables: DataFrame, problem: str = "problem_id") -> DataFrame:
    """Masks with one more variable, of a higher index than those they hold, so that each set is made once."""
    joined = masks.select(problem, "mask", "top").join(variables.select(problem, F.col("idx")), problem).filter("idx > top")
    return joined.select(problem, F.col("mask").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("idx"))).alias("mask"), F.col("idx").alias("top"))


def exhaustive(worlds: DataFrame, reported: DataFrame, variables: DataFrame, most: int, problem: str = "problem_id") -> DataFrame:
    """(problem, mask, kind): sets of a problem that are reported but not minimal and sufficient (`extra`), or the reverse (`missing`).

    reported: (problem, mask). What must be reported is what the search of `minimal_sufficient` finds at its smallest k;
    a problem for which it finds nothing, or too much, must report nothing.
    """
    found = minimal_sufficient(worlds, variables, most, problem=problem)[0].select(problem, "mask").withColumn("_f", F.lit(True))
    both = reported.select(problem, "mask").distinct().withColumn("_r", F.lit(True)).join(found, [problem, "mask"], "full")
    return both.filter("_f is null or _r is null").select(problem, "mask", F.when(F.col("_f").isNull(), F.lit("extra")).otherwise(F.lit("missing")).alias("kind"))


def witnesses(worlds: DataFrame, masks: DataFrame, problem: str = "problem_id") -> DataFrame:
    """(problem, mask, diff) of masks that don't suffice: bits in which two worlds differ that agree on the mask but not on y.

    One aggregation over (problem, mask, pattern) finds such a pair in each pattern; of a mask's the one with the fewest
    differing bits of `vars` is taken. masks: (problem, mask, vars), the variables as a mask.
    """
    pairs = worlds.join(masks.select(problem, "mask", "vars"), problem)
    patterns = pairs.groupBy(problem, "mask", "vars", F.col("state").bitwiseAND(F.col("mask")).alias("_p")).agg(
        F.min("y").alias("_a"), F.max("y").alias("_b"), F.min_by("state", F.struct("y", "state")).alias("_s"), F.max_by("state", F.struct("y", "state")).alias("_t")
    )
    diff = F.col("_s").bitwiseXOR(F.col("_t")).bitwiseAND(F.col("vars"))
    apart = patterns.filter("_a <> _b").select(problem, "mask", diff.alias("_d"))
    return apart.groupBy(problem, "mask").agg(F.min_by("_d", F.struct(F.bit_count("_d"), "_d")).alias("diff"))


def smaller_suffices(worlds: DataFrame, claims: DataFrame, most: int, problem: str = "problem_id") -> tuple[DataFrame, DataFrame]:
    """(problem, found): whether at most `size` of a problem's variables suffice; and (problem, n_nodes), the sets that were looked at.

    claims: (problem, vars, size), the variables as a mask, size up to `most`. A sufficient set hits every difference of
    two worlds with unequal outcomes, so a set that doesn't suffice is only grown by the variables of its witness: any
    sufficient set that holds it holds one of these. No other set is made, and a problem leaves at its first hit.
    """
    level = checkpointed(claims.select(problem, "vars", "size", F.lit(0).cast("long").alias("mask")))
    none = level.select(problem, "mask").filter("false")
    hits, nodes = none.select(problem), none.select(problem)
    for size in range(most + 1):
        open_ = checkpointed(witnesses(worlds, level, problem))
        nodes = nodes.unionByName(level.select(problem))
        good = checkpointed(level.join(open_, [problem, "mask"], "left_anti").select(problem).distinct())
        hits = hits.unionByName(good)
        bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("diff", i) == 1)
        rest = level.filter(F.col("size") > size).join(good, problem, "left_anti").join(open_, [problem, "mask"])
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_i"))
        grown = rest.select(problem, "vars", "size", "mask", F.explode(bits).alias("_i"))
        level = checkpointed(grown.select(problem, "vars", "size", F.col("mask").bitwiseOR(one).alias("mask")).distinct())
        if level.isEmpty():
            break
    found = claims.select(problem).join(hits.distinct().withColumn("_f", F.lit(True)), problem, "left")
    return found.select(problem, F.coalesce("_f", F.lit(False)).alias("found")), nodes.groupBy(problem).agg(F.count(F.lit(1)).alias("n_nodes"))


def minimal_sufficient(worlds: DataFrame, variables: DataFrame, most: int, cap: int | None = None, problem: str = "problem_id") -> tuple[DataFrame, DataFrame]:
    """Smallest k and all sufficient masks of that size: (problem, k, mask), and (problem, k, n_sets, n_tested, status).

    variables: (problem, idx). Levels 0 to `most` run in order; a problem leaves at its first level with a hit. A
    problem with `cap` hits or more is rejected and gives no mask; one without a hit has status none.
    """
    level = checkpointed(worlds.select(problem).distinct().select(problem, F.lit(0).cast("long").alias("mask"), F.lit(-1).alias("top")))
    hits, report = None, None
    for k in range(most + 1):
        tested = checkpointed(sufficient(worlds, level, problem))
        found = tested.filter("is_sufficient").select(problem, F.lit(k).alias("k"), "mask")
        counts = tested.groupBy(problem).agg(F.lit(k).alias("k"), F.count_if("is_sufficient").alias("n_sets"), F.count(F.lit(1)).alias("n_tested"))
        hits = found if hits is None else hits.unionByName(found)
        report = counts if report is None else report.unionByName(counts)
        rest = level.join(found.select(problem).distinct(), problem, "left_anti")
        if k < most:
            level = checkpointed(grow(rest, variables, problem))
            if level.isEmpty():
                break
    total = report.groupBy(problem).agg(
        F.max_by("k", "k").alias("last_k"), F.max("n_sets").alias("n_sets"), F.sum("n_tested").alias("n_tested"), F.min(F.when(F.col("n_sets") > 0, F.col("k"))).alias("k")
    )
    over = F.lit(False) if cap is None else F.col("n_sets") >= cap
    status = F.when(F.col("n_sets") == 0, "none").when(over, "rejected").otherwise("found")
    summary = total.select(problem, "k", "n_sets", "n_tested", status.alias("status"))
    kept = hits.join(summary.filter("status = 'found'").select(problem), problem, "left_semi")
    return kept, summary


def verify_sets(worlds: DataFrame, sets: DataFrame, width: int = 64, problem: str = "problem_id") -> DataFrame:
    """(problem, mask, is_sufficient, is_minimal): a minimal set suffices and none of its drop-one subsets does."""
    each = sets.select(problem, "mask", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("_i")).filter(F.getbit("mask", F.col("_i")) == 1)
    less = each.select(problem, F.col("mask").alias("whole"), F.col("mask").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_i"))).alias("mask"))
    asked = less.select(problem, "mask").unionByName(sets.select(problem, "mask")).distinct()
    judged = checkpointed(sufficient(worlds, asked, problem))
    loose = less.join(judged.filter("is_sufficient"), [problem, "mask"]).select(problem, F.col("whole").alias("mask")).distinct()
    out = sets.select(problem, "mask").join(judged, [problem, "mask"]).join(loose.withColumn("_l", F.lit(True)), [problem, "mask"], "left")
    return out.select(problem, "mask", "is_sufficient", (F.col("is_sufficient") & F.col("_l").isNull()).alias("is_minimal"))


def determined(worlds: DataFrame, contexts: DataFrame, problem: str = "problem_id") -> DataFrame:
    """(problem, context, n_states, n_outcomes, is_determined): what is left when state & mask = value is known."""
    left = worlds.join(contexts, problem).filter(F.col("state").bitwiseAND(F.col("mask")) == F.col("value"))
    return left.groupBy(problem, "context").agg(
        F.count(F.lit(1)).alias("n_states"), F.count_distinct("y").alias("n_outcomes"), (F.min("y") == F.max("y")).alias("is_determined")
    )


def narrowed(worlds: DataFrame, truth: DataFrame, order: DataFrame, low: int, high: int, problem: str = "problem_id") -> DataFrame:
    """(problem, mask, n_left): the first prefix of revealed bits that leaves low to high candidates; none if it is undershot.

    truth: (problem, true_state); order: (problem, pos, idx), the order in which bits are revealed.
    """
    w = Window.partitionBy(problem).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixes = order.withColumn("mask", F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("idx"))).over(w)).select(problem, "pos", "mask")
    known = prefixes.join(truth, problem).withColumn("value", F.col("true_state").bitwiseAND(F.col("mask")))
    left = worlds.join(known, problem).filter(F.col("state").bitwiseAND(F.col("mask")) == F.col("value"))
    counts = left.groupBy(problem, "pos", "mask").agg(F.count(F.lit(1)).alias("n_left"))
    first = counts.filter(F.col("n_left") <= high).groupBy(problem).agg(F.min_by(F.struct("mask", "n_left"), "pos").alias("_f"))
    return first.select(problem, "_f.mask", "_f.n_left").filter(F.col("n_left") >= low)


def forbid_profile(sets: Column, queryable: Column) -> Column:
    """struct(canonical, forbidden, allowed, extra): the first set by (size, names), other sets' variables, and what may be asked."""
    canonical = F.get(F.array_sort(F.transform(sets, lambda s: F.struct(F.size(s).alias("n"), F.transform(s, F.lower).alias("l"), s.alias("s")))), F.lit(0))["s"]
    forbidden = F.array_sort(F.array_except(F.flatten(sets), canonical))
    allowed = F.array_except(queryable, forbidden)
    return F.struct(canonical.alias("canonical"), forbidden.alias("forbidden"), allowed.alias("allowed"), F.array_except(allowed, canonical).alias("extra"))


def stable_distractors(states: DataFrame, width: int, model: str = "model") -> DataFrame:
    """(model, idx): bits constant inside every attractor and of both values across attractors. states: (model, attractor_id, state)."""
    bits = states.select(model, "attractor_id", F.posexplode(F.array(*[F.getbit("state", F.lit(i)) for i in range(width)])).alias("idx", "b"))
    per = bits.groupBy(model, "attractor_id", "idx").agg(F.min("b").alias("a"), F.max("b").alias("z"))
    return per.groupBy(model, "idx").agg(F.bool_and(F.col("a") == F.col("z")).alias("_s"), F.min("a").alias("_a"), F.max("z").alias("_z")).filter("_s and _a < _z").select(model, "idx")


def best_answer(worlds: DataFrame, asks: DataFrame, narrow: bool, problem: str = "problem_id") -> DataFrame:
    """(problem, idx, value, n_states): the answer to a queried bit that leaves the most (or, with `narrow`, the fewest) states.

    asks: (problem, idx, true_y); an answer must leave some state of the true outcome. Ties go to 0.
    """
    counts = worlds.join(asks, problem).groupBy(problem, "idx", F.getbit("state", F.col("idx")).cast("int").alias("value")).agg(
        F.count(F.lit(1)).alias("n_states"), F.bool_or(F.col("y") == F.col("true_y")).alias("_ok")
    )
    order = F.col("n_states") if narrow else -F.col("n_states")
    w = Window.partitionBy(problem, "idx").orderBy(order, "value")
    return counts.filter("_ok").withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(problem, "idx", "value", "n_states")


def explanations(worlds: DataFrame, rows: DataFrame, variables: DataFrame, most: int, problem: str = "problem_id") -> DataFrame:
    """(problem, row_id, k, mask): smallest parts of an observed row that already fix its outcome.

    rows: (problem, row_id, row_state, row_y). A part suffices when every world that agrees with the row on it has the
    row's outcome. Levels run in order; a row leaves at its first level with a hit.
    """
    level = rows.withColumns({"mask": F.lit(0).cast("long"), "top": F.lit(-1)})
    out = None
    for k in range(most + 1):
        level = checkpointed(level)
        same = worlds.join(level, problem).filter(F.col("state").bitwiseAND(F.col("mask")) == F.col("row_state").bitwiseAND(F.col("mask")))
        judged = same.groupBy(problem, "row_id", "mask").agg(F.bool_and(F.col("y") == F.col("row_y")).alias("_ok"))
        found = checkpointed(judged.filter("_ok").select(problem, "row_id", F.lit(k).alias("k"), "mask"))
        out = found if out is None else out.unionByName(found)
        rest = level.join(found.select(problem, "row_id").distinct(), [problem, "row_id"], "left_anti")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("idx"))
        grown = rest.join(variables.select(problem, "idx"), problem).filter("idx > top")
        level = grown.withColumns({"mask": F.col("mask").bitwiseOR(bit), "top": F.col("idx")}).drop("idx")
    return out


def identified(worlds: DataFrame, contexts: DataFrame, problem: str = "problem_id") -> DataFrame:
    """(problem, context, verdict): none, not unique, other, or ok for the outcome that a context leaves. contexts also hold `expected`."""
    left = contexts.join(worlds, problem, "left").withColumn("_in", F.col("state").bitwiseAND(F.col("mask")) == F.col("value"))
    seen = left.groupBy(problem, "context", "expected").agg(F.count_distinct(F.when(F.col("_in"), F.col("y"))).alias("_n"), F.min(F.when(F.col("_in"), F.col("y"))).alias("_y"))
    verdict = F.when(F.col("_n") == 0, "none").when(F.col("_n") > 1, "not unique").when(F.col("_y") != F.col("expected"), "other").otherwise("ok")
    return seen.select(problem, "context", verdict.alias("verdict"))
