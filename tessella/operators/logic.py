"""Sufficiency of variable sets under Horn clauses, and minimal held-out sets of rule graphs. All cases run in one batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import checkpointed
from .fixpoint import Closure, Index, clause_index, close, refuted


def _columns(problem: str | list[str]) -> list[str]:
    return [problem] if isinstance(problem, str) else problem


def combinations(variables: DataFrame, k: int, problem: str | list[str] = "problem_id", var: str = "var") -> DataFrame:
    """(problem, vars): all k-subsets of each problem's variables, in name order; each is made once.

    A set grows from its problem's row of variables by what stands after its last one, so nothing is joined and no row holds sets.
    """
    by = _columns(problem)
    if not k:
        return variables.select(*by).distinct().select(*by, F.array().cast("array<string>").alias("vars"))
    # a null variable is a set of its own and stands beside no other
    known = variables.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in (by if k == 1 else [*by, var])]))
    held = known.groupBy(*by).agg(F.array_sort(F.collect_set(F.struct(F.col(var).alias("v")))).alias("_all"))
    sets = held.select(*by, "_all", F.lit(-1).alias("_at"), F.array().cast("array<string>").alias("vars"))
    for _ in range(k):
        after = F.when(F.col("_at") + 1 < F.size("_all"), F.sequence(F.col("_at") + 1, F.size("_all") - 1))
        longer = sets.select(*by, "_all", F.explode(after).alias("_at"), "vars")
        sets = longer.select(*by, "_all", "_at", F.array_append("vars", F.get("_all", F.col("_at"))["v"]).alias("vars"))
    return sets.select(*by, "vars")


def literal_structs(context: str) -> Column:
    """An array of literals `x` and `not x` as an array of (var, val)."""
    bare = lambda x: F.struct(F.regexp_replace(x, "^not ", "").alias("var"), (~x.startswith("not ")).alias("val"))
    return F.transform(context, bare)


def no_facts(branches: DataFrame, problem: str = "problem_id") -> DataFrame:
    return branches.select(problem, "branch_id", F.lit("").alias("var"), F.lit(True).alias("val")).filter("false")


def context_closures(index: Index, contexts: DataFrame, problem: str = "problem_id") -> tuple[DataFrame, Closure]:
    """(problem, context, branch_id), and the closure of each context. contexts: (problem, context), arrays of literals."""
    named = checkpointed(contexts.select(problem, "context").distinct().withColumn("branch_id", F.to_json(F.struct("context"))))
    facts = named.select(problem, "branch_id", F.explode(literal_structs("context")).alias("_l")).select(problem, "branch_id", "_l.*")
    return named, close(index, facts, named, None, problem)


def context_tables(lits: DataFrame, goals: DataFrame, sets: DataFrame, problem: str = "problem_id") -> DataFrame:
    """(problem, context, vars, assignment, feasible, forced) for each of the 2^k assignments of each set of variables.

    sets: (problem, context, vars), the context an array of literals that hold besides. goals: (problem, goal). Bit i of
    the assignment is the value of the i-th variable. A context is closed once; its assignments start from that.
    """
    index = clause_index(lits, problem)
    contexts, base = context_closures(index, sets, problem)
    bits = F.explode(F.expr("sequence(0, cast(shiftleft(1, size(vars)) - 1 as int))"))
    rows = sets.select(problem, "context", "vars").distinct().join(contexts.withColumnRenamed("branch_id", "parent"), [problem, "context"])
    rows = rows.select("*", bits.alias("assignment")).withColumn("branch_id", F.to_json(F.struct("context", "vars", "assignment")))
    chosen = F.transform("vars", lambda v, i: F.struct(v.alias("var"), (F.getbit(F.col("assignment").cast("long"), i) == 1).alias("val")))
    cases = rows.join(goals, problem).select(problem, "branch_id", "parent", chosen.alias("literals"), F.col("goal").alias("var"))
    _, judged = refuted(index, base, cases, problem)
    return rows.join(judged, [problem, "branch_id"]).select(problem, "context", "vars", "assignment", "feasible", "forced")


def settled_contexts(lits: DataFrame, goals: DataFrame, free: DataFrame, k: int, problem: str = "problem_id") -> tuple[DataFrame, DataFrame]:
    """(problem, context) under which some k of the free variables suffice, and (problem, context, n_closures, n_full).

    free: (problem, context, var). Cases form a tree: a context, then its variables in name order, each true or false. A
    case starts from its parent's closure and adds one literal. Below a case that is infeasible, or that forces the goal,
    nothing is closed any more, as all cases there are or do the same. A set suffices when none of its cases is left open;
    its context then leaves the search, for more variables suffice as well. n_closures counts the cases that were closed,
    n_full the 2^k cases of all sets of k.
    """
    by = [problem, "context"]
    index = clause_index(lits, problem)
    own = checkpointed(free.select(*by, "var").distinct())
    sizes = own.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("_m")).filter(F.col("_m") >= k)
    choose = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(1).cast("decimal(38,0)"), lambda x, i: (x * (F.col("_m") - k + i) / i).cast("decimal(38,0)")) if k else F.lit(1)
    full = sizes.select(*by, (choose * (1 << k)).cast("decimal(38,0)").alias("n_full"))
    # a context starts from what unit clauses force; its own literals are the first case
    root = sizes.select(problem, F.lit("").alias("branch_id")).distinct()
    base = close(index, no_facts(root, problem), root, None, problem)
    nodes = sizes.select(problem, F.to_json(F.struct("context")).alias("branch_id"), "context", F.array().cast("array<string>").alias("vars"))
    cases = nodes.join(goals, problem).select(problem, "branch_id", F.lit("").alias("parent"), literal_structs("context").alias("literals"), F.col("goal").alias("var"))
    done, closed = [], []
    for size in range(k + 1):
        nodes = checkpointed(nodes)
        base, judged = refuted(index, base, cases, problem)
        closed.append(nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_closures")))
        open_ = F.col("feasible") & F.col("forced").isNull()
        status = checkpointed(nodes.join(judged, [problem, "branch_id"]).withColumn("_open", open_))
        sets = status.groupBy(*by, "vars").agg(F.bool_or("_open").alias("_open"), F.bool_or("feasible").alias("_any"))
        # at the top nothing is left of an infeasible context; below it, a set without an open case has a feasible one further up
        found = sets.filter("not _open and _any" if size == 0 else "not _open").select(*by).distinct()
        done.append(checkpointed(found))
        if size == k:
            break
        rest = status.filter("_open").join(done[-1], by, "left_anti").select(problem, "branch_id", "context", "vars")
        longer = rest.join(own, by)
        if size:
            longer = longer.filter(F.col("var") > F.element_at("vars", -1))
        longer = longer.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("val"))
        grown = checkpointed(longer.select(
            problem, F.col("branch_id").alias("parent"), F.concat("branch_id", F.to_json(F.struct("var", "val"))).alias("branch_id"), "context",
            F.array_append("vars", F.col("var")).alias("vars"), F.array(F.struct("var", "val")).alias("literals"),
        ))
        if grown.isEmpty():
            break
        cases = grown.join(goals, problem).select(problem, "branch_id", "parent", "literals", F.col("goal").alias("var"))
        nodes = grown.select(problem, "branch_id", "context", "vars")
    counted = reduce(DataFrame.unionByName, closed).groupBy(*by).agg(F.sum("n_closures").alias("n_closures"))
    return reduce(DataFrame.unionByName, done).distinct(), full.join(counted, by)


def truth_tables(lits: DataFrame, facts: DataFrame, goals: DataFrame, sets: DataFrame, problem: str = "problem_id") -> DataFrame:
    """(problem, vars, assignment, feasible, forced): `context_tables` with a problem's facts, (problem, var, val), as the context."""
    literal = F.when(F.col("val"), F.col("var")).otherwise(F.concat(F.lit("not "), F.col("var")))
    known = facts.groupBy(problem).agg(F.array_sort(F.collect_set(literal)).alias("context"))
    cases = sets.join(known, problem, "left").withColumn("context", F.coalesce("context", F.array().cast("array<string>")))
    return context_tables(lits, goals, cases, problem).drop("context")


def is_sufficient(tables: DataFrame, problem: str | list[str] = "problem_id") -> DataFrame:
    """(problem, vars, is_sufficient): every feasible assignment forces the goal, and one is feasible."""
    return tables.groupBy(*_columns(problem), "vars").agg(
        (F.bool_or("feasible") & F.bool_and(~F.col("feasible") | F.col("forced").isNotNull())).alias("is_sufficient")
    )


def essential(tables: DataFrame, problem: str | list[str] = "problem_id") -> DataFrame:
    """(problem, vars, is_essential): each variable has two assignments that differ in it alone and force opposite goals."""
    by = [*_columns(problem), "vars"]
    good = tables.filter("feasible and forced is not null").select(*by, F.col("assignment").cast("long").alias("a"), "forced")
    each = good.select("*", F.explode(F.sequence(F.lit(0), F.size("vars") - 1)).alias("i"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i"))
    cleared = each.withColumn("rest", F.col("a").bitwiseAND(F.expr("~shiftleft(1L, i)"))).withColumn("_b", F.col("a").bitwiseAND(bit))
    pairs = cleared.groupBy(*by, "i", "rest").agg(F.count_distinct("forced").alias("_n"))
    flips = pairs.groupBy(*by, "i").agg(F.max("_n").alias("_n"))
    judged = flips.groupBy(*by).agg(F.count_if(F.col("_n") > 1).alias("_ok"))
    sets = tables.select(*by).distinct()
    return sets.join(judged, by, "left").select(*by, (F.coalesce("_ok", F.lit(0)) == F.size("vars")).alias("is_essential"))


def sufficient_sets(lits: DataFrame, facts: DataFrame, goals: DataFrame, variables: DataFrame, k: int, problem: str = "problem_id") -> DataFrame:
    """(problem, vars, is_minimal): sufficient sets of size k; minimal if no set of size k - 1 of the problem suffices."""
    own = is_sufficient(truth_tables(lits, facts, goals, combinations(variables, k, problem), problem), problem).filter("is_sufficient")
    if k == 0:
        return own.select(problem, "vars", F.lit(True).alias("is_minimal"))
    less = is_sufficient(truth_tables(lits, facts, goals, combinations(variables, k - 1, problem), problem), problem)
    easy = less.filter("is_sufficient").select(problem, F.lit(True).alias("_e")).distinct()
    return own.join(easy, problem, "left").select(problem, "vars", F.col("_e").isNull().alias("is_minimal"))


def derivable(rules: DataFrame, known: DataFrame, problem: str = "problem_id") -> DataFrame:
    """(problem, case, node): nodes known in each case, when a rule's output is known once all its inputs are.

    rules: (problem, output, inputs); known: (problem, case, node).
    """
    need = rules.select(problem, "output", F.size("inputs").alias("_n"), F.explode("inputs").alias("node"))
    have = new = checkpointed(known.select(problem, "case", "node").distinct())
    while not new.isEmpty():
        touched = new.join(need, [problem, "node"]).select(problem, "case", "output").distinct()
        inputs = touched.join(need, [problem, "output"]).join(have, [problem, "case", "node"], "left_semi")
        ready = inputs.groupBy(problem, "case", "output", "_n").agg(F.count(F.lit(1)).alias("_h")).filter("_h = _n")
        new = checkpointed(ready.select(problem, "case", F.col("output").alias("node")).distinct().join(have, [problem, "case", "node"], "left_anti"))
        have = checkpointed(have.unionByName(new))
    return have


def held_out_sets(rules: DataFrame, leaves: DataFrame, goals: DataFrame, sets: DataFrame, problem: str = "problem_id") -> DataFrame:
    """(problem, vars, is_minimal): the goal is known with all held-out leaves given back, and with no proper part of them.

    leaves: (problem, node), all of them; sets: (problem, vars), held-out leaves.
    """
    rows = sets.select(problem, "vars", F.explode(F.expr("sequence(0, cast(shiftleft(1, size(vars)) - 1 as int))")).alias("given"))
    rows = checkpointed(rows.withColumn("case", F.concat_ws("|", F.array_join("vars", ","), F.col("given").cast("string"))))
    kept = F.filter("vars", lambda x, i: F.getbit(F.col("given").cast("long"), i) == 1)
    missing = F.array_except("vars", kept)
    known = rows.withColumn("_m", missing).join(leaves, problem).filter(~F.array_contains("_m", F.col("node"))).select(problem, "case", "node")
    reached = derivable(rules, known, problem).join(goals.select(problem, F.col("goal").alias("node")), [problem, "node"], "left_semi")
    judged = rows.join(reached.select(problem, "case", F.lit(True).alias("_k")), [problem, "case"], "left")
    whole = F.col("given") == F.expr("shiftleft(1, size(vars)) - 1")
    return judged.groupBy(problem, "vars").agg(F.bool_and(F.coalesce("_k", F.lit(False)) == whole).alias("is_minimal"))


def self_contradictory(sets: DataFrame, items: str) -> DataFrame:
    """Add contradicts: a set holds a literal and its negation."""
    bare = F.transform(items, lambda x: F.regexp_replace(x, "^not ", ""))
    return sets.withColumn("contradicts", F.size(F.array_distinct(bare)) < F.size(F.array_distinct(items)))
