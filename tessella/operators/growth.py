"""Pairs of a context and a set of variables, grown level by level, and the problem rows built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import checkpointed
from .logic import context_tables, essential, is_sufficient, settled_contexts


def bare(literal: Column) -> Column:
    return F.regexp_replace(literal, "^not ", "")


def negated(literal: Column) -> Column:
    return F.when(literal.startswith("not "), bare(literal)).otherwise(F.concat(F.lit("not "), literal))


def holding(contexts: DataFrame, level: DataFrame, problem: str = "problem_id") -> DataFrame:
    """(problem, context): contexts that hold a context of the level. Each of the level's is looked up by its rarest literal."""
    large = contexts.select(problem, "context", F.explode("context").alias("_l"))
    freq = large.groupBy(problem, "_l").agg(F.count(F.lit(1)).alias("_f"))
    small = level.select(problem, F.col("context").alias("_a")).distinct()
    each = small.select(problem, "_a", F.explode("_a").alias("_l")).join(freq, [problem, "_l"], "left")
    rare = each.groupBy(problem, "_a").agg(F.min_by("_l", F.struct(F.coalesce("_f", F.lit(0)), "_l")).alias("_l"))
    held = large.join(rare, [problem, "_l"]).filter(F.size(F.array_except("_a", "context")) == 0).select(problem, "context")
    empty = small.filter(F.size("_a") == 0).select(problem)
    return held.unionByName(contexts.select(problem, "context").join(empty, problem, "left_semi")).distinct()


def free_variables(contexts: DataFrame, variables: DataFrame, goals: DataFrame, problem: str = "problem_id") -> DataFrame:
    """(problem, context, var): variables that may still be asked, neither the goal nor known from the context."""
    rows = contexts.select(problem, "context").distinct().join(variables, problem).join(goals, problem)
    known = F.array_contains(F.transform("context", bare), F.col("var"))
    return rows.filter(~known & (F.col("var") != F.col("goal"))).select(problem, "context", "var").distinct()


def sibling_pairs(grown: DataFrame, level: DataFrame, free: DataFrame, problem: str = "problem_id") -> DataFrame:
    """(problem, context, vars): for each context the sets that its parent has in the level, of variables that may be asked.

    grown: (problem, context, parent), the context and the larger one it comes from.
    """
    key = [problem, "context"]
    siblings = level.select(problem, F.col("context").alias("parent"), "vars")
    pairs = grown.select(*key, "parent").distinct().join(siblings, [problem, "parent"]).select(*key, "vars").distinct()
    closed = pairs.select(*key, "vars", F.explode("vars").alias("var")).join(free, [*key, "var"], "left_anti").select(*key, "vars").distinct()
    return pairs.join(closed, [*key, "vars"], "left_anti")


def grown_levels(
    lits: DataFrame, goals: DataFrame, variables: DataFrame, level_one: DataFrame, max_k: int = 4, problem: str = "problem_id"
) -> tuple[DataFrame, DataFrame]:
    """(problem, k, context, vars): the pairs of level one and all that grow from them, up to max_k variables; and what it took.

    level_one: (problem, context, vars) with an array of literals and one variable; lits: (problem, clause_id, var, val);
    goals: (problem, goal); variables: (problem, var), all that may be asked.
    A pair grows by moving a literal of its context into its set. It stays if the old set suffices with that literal
    negated, the smaller context holds no context of the level before, and no k - 1 free variables suffice under it. A
    pair with several parents is kept once, if one of them passes. All pairs of a level are judged in one batch. Cheap
    tests come first: contained contexts by a join, then the sets of the same parent, and only what is left is searched.

    The second result, (problem, k, context, n_closures, n_full), has the contexts that were searched: cases closed, and
    cases that all sets of k - 1 variables have.
    """
    key = [problem, "context"]
    level = checkpointed(level_one.select(problem, F.array_sort("context").alias("context"), F.array_sort("vars").alias("vars")).distinct())
    found = level.withColumn("k", F.lit(1))
    work = None
    for k in range(2, max_k + 1):
        moved = level.select(problem, F.col("context").alias("parent"), "vars", F.explode("context").alias("_l"))
        rest = F.array_remove("parent", F.col("_l"))
        grown = moved.select(
            problem, rest.alias("context"), F.array_sort(F.array_append("vars", bare(F.col("_l")))).alias("_grown"), "vars", "parent",
            F.array_sort(F.array_append(rest, negated(F.col("_l")))).alias("_flipped"),
        )
        grown = checkpointed(grown.distinct())
        grown = checkpointed(grown.join(holding(grown.select(*key).distinct(), level, problem), key, "left_anti"))
        if grown.isEmpty():
            break
        free = checkpointed(free_variables(grown, variables, goals, problem))
        flipped = grown.select(problem, F.col("_flipped").alias("context"), "vars")
        asked = checkpointed(flipped.unionByName(sibling_pairs(grown, level, free, problem)).distinct())
        good = checkpointed(is_sufficient(context_tables(lits, goals, asked, problem), key).filter("is_sufficient").select(*key, "vars"))
        easy = sibling_pairs(grown, level, free, problem).join(good, [*key, "vars"], "left_semi").select(*key).distinct()
        still = good.withColumnRenamed("context", "_flipped")
        grown = grown.join(still, [problem, "_flipped", "vars"], "left_semi").join(easy, key, "left_anti")
        grown = checkpointed(grown.select(*key, F.col("_grown").alias("vars")).distinct())
        settled, searched = settled_contexts(lits, goals, free.join(grown.select(*key).distinct(), key, "left_semi"), k - 1, problem)
        searched = searched.select(problem, F.lit(k).alias("k"), "context", "n_closures", "n_full")
        work = searched if work is None else work.unionByName(searched)
        level = checkpointed(grown.join(settled, key, "left_anti").select(*key, "vars").distinct())
        found = found.unionByName(level.withColumn("k", F.lit(k)))
    if work is None:
        work = found.select(problem, "k", "context", F.lit(0).cast("long").alias("n_closures"), F.lit(0).cast("decimal(38,0)").alias("n_full")).filter("false")
    return found.select(problem, "k", "context", "vars"), work


def grown_sets(lits: DataFrame, goals: DataFrame, variables: DataFrame, level_one: DataFrame, max_k: int = 4, problem: str = "problem_id") -> DataFrame:
    """The pairs of `grown_levels`: (problem, k, context, vars)."""
    return grown_levels(lits, goals, variables, level_one, max_k, problem)[0]


def problem_rows(
    lits: DataFrame, goals: DataFrame, variables: DataFrame, sets: DataFrame, invalid: DataFrame | None = None, problem: str = "problem_id"
) -> DataFrame:
    """A row for each (problem, k, context) with a valid set: known_true, known_false, goal, invalid_vars, valid_vars, sets.

    sets: (problem, k, context, vars), literals and variables in order; invalid: sets of the same shape that are refused. A
    set is valid if it is not refused, holds neither the goal nor a known variable, suffices, loses something with each of
    its variables (sets of one variable aside), and no smaller number of free variables suffices. Empty sets are not valid.
    """
    key = [problem, "context"]
    sets = sets.select(problem, "k", F.array_sort("context").alias("context"), F.array_sort("vars").alias("vars")).distinct()
    if invalid is not None:
        refused = invalid.select(problem, "k", F.array_sort("context").alias("context"), F.array_sort("vars").alias("vars"))
        sets = sets.join(refused, [problem, "k", "context", "vars"], "left_anti")
    sets = sets.join(goals, problem).filter(F.size("vars") > 0)
    names = F.transform("context", bare)
    sets = checkpointed(sets.filter(~F.arrays_overlap("vars", F.array_append(names, F.col("goal")))))
    tables = checkpointed(context_tables(lits, goals, sets.select(*key, "vars").distinct(), problem))
    enough = is_sufficient(tables, key).filter("is_sufficient").select(*key, "vars")
    needed = essential(tables, key).filter("is_essential or size(vars) = 1").select(*key, "vars")
    good = checkpointed(sets.join(enough, [*key, "vars"], "left_semi").join(needed, [*key, "vars"], "left_semi"))
    largest = good.agg(F.max(F.size("vars"))).first()[0] or 0
    for n in range(2, largest + 1):
        of_size = good.filter(F.size("vars") == n)
        easy, _ = settled_contexts(lits, goals, free_variables(of_size, variables, goals, problem), n - 1, problem)
        good = checkpointed(good.filter(F.size("vars") != n).unionByName(of_size.join(easy, key, "left_anti")))
    rows = good.groupBy(problem, "k", "context", "goal").agg(F.array_sort(F.collect_set("vars")).alias("sets"))
    every = variables.groupBy(problem).agg(F.array_sort(F.collect_set("var")).alias("all_vars"))
    closed = F.array_distinct(F.array_append(names, F.col("goal")))
    return rows.join(every, problem, "left").select(
        problem, "k", "context", F.filter("context", lambda x: ~x.startswith("not ")).alias("known_true"),
        F.array_sort(F.transform(F.filter("context", lambda x: x.startswith("not ")), bare)).alias("known_false"),
        "goal", F.array_sort(closed).alias("invalid_vars"), F.array_except("all_vars", closed).alias("valid_vars"), "sets",
    )
