"""Verification of problems: five checks with the first that fails, and whether any smaller set would do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import checkpointed
from . import fixpoint, minset


def set_count(n: Column, k: Column, most: int) -> Column:
    """The number of sets of k out of n, for k up to `most`; null for a negative k."""
    step = lambda x, i: F.when(i <= k, (x * (n - k + i) / i).cast("decimal(38,0)")).otherwise(x)
    counted = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, most))), F.lit(1).cast("decimal(38,0)"), step)
    return F.when(k < 0, None).when(k > n, 0).otherwise(counted)


def global_minimality(worlds: DataFrame, claims: DataFrame, variables: DataFrame, most: int, cap: int, problem: str = "problem_id") -> DataFrame:
    """(problem, k, status, n_tested): pass if no set of k - 1 variables suffices, fail if one does; skip where k is 0 or over `most`, or where there are more than `cap` sets of k - 1.

    n_tested, the number of such sets, is computed; no set is made that no pair of worlds asks for. variables: (problem, idx).
    """
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("idx"))
    own = variables.select(problem, "idx").distinct().groupBy(problem).agg(F.bit_or(one).alias("vars"), F.count(F.lit(1)).cast("int").alias("_n"))
    known = claims.select(problem, "k").join(own, problem, "left")
    n, size = F.coalesce("_n", F.lit(0)), F.col("k") - 1
    total = F.when(F.col("k") <= most, F.coalesce(set_count(n, size, most), F.lit(0))).otherwise(0)
    rows = checkpointed(known.select(problem, "k", F.coalesce("vars", F.lit(0)).cast("long").alias("vars"), total.cast("decimal(38,0)").alias("n_tested")))
    tried = rows.filter((F.col("n_tested") > 0) & (F.col("n_tested") <= cap)).join(worlds.select(problem).distinct(), problem, "left_semi")
    found, _ = minset.smaller_suffices(worlds, tried.select(problem, "vars", size.alias("size")), most - 1, problem)
    status = F.when(F.col("found").isNull(), "skip").when(F.col("found"), "fail").otherwise("pass")
    return rows.join(found, problem, "left").select(problem, "k", status.alias("status"), F.col("n_tested").cast("long").alias("n_tested"))


def five_checks(worlds: DataFrame, sets: DataFrame, claims: DataFrame, variables: DataFrame, most: int, cap: int, problem: str = "problem_id") -> DataFrame:
    """(problem, mask, verdict): the first check that a claimed minimal set fails, or ok.

    In order: the outcome isn't fixed without any variable, the set suffices, it has k variables, none of them can be
    spared, and no set of k - 1 variables suffices.
    """
    empty = worlds.select(problem).distinct().withColumn("mask", F.lit(0).cast("long"))
    free = minset.sufficient(worlds, empty, problem).select(problem, F.col("is_sufficient").alias("_free"))
    smaller = global_minimality(worlds, claims, variables, most, cap, problem).select(problem, "k", (F.col("status") == "fail").alias("_smaller"))
    judged = minset.verify_sets(worlds, sets, problem=problem).join(free, problem, "left").join(smaller, problem, "left")
    verdict = (
        F.when(F.col("_free"), "determined without").when(~F.col("is_sufficient"), "not sufficient").when(F.bit_count("mask") != F.col("k"), "wrong size")
        .when(~F.col("is_minimal"), "not essential").when(F.col("_smaller"), "smaller set").otherwise("ok")
    )
    return judged.select(problem, "mask", verdict.alias("verdict"))


def sample_errors(checks: DataFrame, problem: str, flags: dict[str, str]) -> DataFrame:
    """(problem, errors): the messages of the flags that are true, in their order; a null flag counts as an error.

    checks has one row for each problem and one boolean column for each flag: `flags` maps columns to messages.
    """
    found = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(True)), F.lit(m)) for c, m in flags.items()]))
    return checks.select(problem, found.alias("errors"))


def validated(
    nodes: DataFrame, edges: DataFrame, rules: DataFrame, claims: DataFrame, variables: int = 3, rule_count: int = 2, depth: int = 0, problem: str = "problem_id"
) -> DataFrame:
    """(problem, errors): what is wrong with each problem of a rule graph, computed from its rows; an empty array if nothing is.

    nodes: (problem, node, value, known), the stated values and whether they are given; edges: (problem, src, dst); rules:
    (problem, output, rule_type, inputs, constant); claims: a row for each problem, (problem, goal, num_vars, num_rules,
    depth, asked_vars, asked_rules, asked_depth, distractors). Sizes may be off by `variables`, `rule_count` and `depth`.
    In order: cycles (nodes that never lose all their incoming edges), a goal that is no node or that no node without
    incoming edges leads to, sizes, outputs that the rules never reach or whose kind is unknown, else the first name whose
    value is another one, and distractors that lead to the goal. Null sizes and values count as wrong.
    Small problems are judged within their rows; large ones, and those that name a known node or an output twice or have several claims, in rounds.
    """
    node, edge, rule = F.struct("node", "value", "known"), F.struct("src", "dst"), F.struct("output", "rule_type", "inputs", "constant")
    claim = F.struct(*[c for c in claims.columns if c != problem])
    rows = nodes.select(problem, node.alias("_node"))
    for part in (edges.select(problem, edge.alias("_edge")), rules.select(problem, rule.alias("_rule")), claims.select(problem, claim.alias("_claim"))):
        rows = rows.unionByName(part, allowMissingColumns=True)
    rows = checkpointed(rows)
    owned = rows.filter(F.col(problem).isNotNull())
    size = F.sum(1 + F.coalesce(F.greatest(F.size("_rule.inputs"), F.lit(0)), F.lit(0)))
    large = checkpointed(owned.groupBy(problem).agg(size.alias("_n")).filter(F.col("_n") > fixpoint.ROW_RULES).select(problem))
    few = owned if large.isEmpty() else owned.join(large, problem, "left_anti")
    held = few.groupBy(problem).agg(*[F.collect_list(f"_{c}").alias(f"{c}s") for c in ("node", "edge", "rule", "claim")]).filter(F.size("claims") > 0)
    twice = lambda xs: F.size(F.array_distinct(xs)) < F.size(xs)
    known = F.filter("nodes", lambda n: n["known"])
    held = checkpointed(held.withColumn("_twice", twice(F.transform(known, lambda n: n["node"])) | twice(F.col("rules.output")) | (F.size("claims") > 1)))
    bounds = (variables, rule_count, depth, problem)
    # a claim without a problem has no rows beside it
    alone = rows.filter(F.col(problem).isNull() & F.col("_claim").isNotNull())
    alone = alone.select(problem, *[F.array().cast(held.schema[c].dataType).alias(c) for c in ("nodes", "edges", "rules")], "_claim.*")
    found = validated_rows(held.filter("not _twice").select(problem, "nodes", "edges", "rules", F.inline("claims")).unionByName(alone), *bounds)
    rest = checkpointed(large.unionByName(held.filter("_twice").select(problem)))
    if rest.isEmpty():
        return found
    return found.unionByName(_validated_in_rounds(*[df.join(rest, problem, "left_semi") for df in (nodes, edges, rules, claims)], *bounds))


def validated_rows(problems: DataFrame, variables: int = 3, rule_count: int = 2, depth: int = 0, problem: str = "problem_id") -> DataFrame:
    """`validated` of problems that are a row each: the arrays `nodes` of (node, value, known), `edges` of (src, dst) and `rules` of
    (output, rule_type, inputs, constant), and the columns of the claim. Nothing is shuffled. A name is known once and put out once."""
    known = F.transform(F.filter("nodes", lambda n: n["known"]), lambda n: F.struct(n["node"].alias("node"), n["value"].alias("value")))
    rows = problems.withColumns({
        "_nodes": F.array_distinct(F.concat("nodes.node", "edges.src", "edges.dst")), "_edges": F.array_distinct(F.filter("edges", lambda e: e["dst"].isNotNull())), "_leaves": known,
        "_outputs": F.col("rules.output"),
    })
    among = lambda xs, x: F.coalesce(F.array_contains(xs, x), F.lit(False))
    rows = rows.withColumns({"_goals": F.filter(F.array("goal"), lambda g: among("_nodes", g)), "_levels": F.expr(fixpoint.LEVELS), "_values": fixpoint.computed("_leaves", "rules")})
    rows = rows.withColumns({"_above": F.expr(fixpoint.ANCESTORS), "_levelled": F.col("_levels.node")})
    told = lambda v: F.filter("nodes", lambda n: n["node"] == v["node"])
    wrong = lambda v: v["value"].isNotNull() & ((F.size(told(v)) == 0) | F.exists(told(v), lambda n: n["value"].isNull() | (n["value"] != v["value"])))
    least = lambda test: F.array_min(F.transform(F.filter("_values", test), lambda v: v["node"]))
    true = lambda test: F.when(test, True)
    lost = F.filter("_outputs", lambda o: ~among("_values.node", o))
    rows = rows.withColumns({
        "_cyclic": true(F.exists("_nodes", lambda n: ~among("_levelled", n))), "_present": true(F.size("_goals") > 0),
        "_reached": true(F.exists("_levels", lambda x: (x["level"] == 0) & among("_above", x["node"]))), "_lost": lost,
        "_odd": least(lambda v: v["value"].isNull() & among("_outputs", v["node"])), "_other": least(wrong),
        "_overlap": true(F.exists("distractors", lambda d: among("_above", d))),
    })
    rows = rows.withColumn("_missing", F.when(F.size("_lost") > 0, F.array_sort(F.array_distinct(F.filter("_lost", lambda o: o.isNotNull())))))
    return _errors(rows, variables, rule_count, depth, problem)


def _validated_in_rounds(
    nodes: DataFrame, edges: DataFrame, rules: DataFrame, claims: DataFrame, variables: int, rule_count: int, depth: int, problem: str
) -> DataFrame:
    """`validated` of large problems. What is written in rounds takes far less room than in memory, so its joins are not left to the size of its files."""
    ids = nodes.select(problem, "node").unionByName(edges.select(problem, F.col("src").alias("node"))).unionByName(edges.select(problem, F.col("dst").alias("node"))).distinct()
    ids = checkpointed(ids)
    levels = fixpoint.topological_levels(ids, edges, problem).hint("merge")
    cyclic = ids.join(levels, [problem, "node"], "left_anti").select(problem).distinct().withColumn("_cyclic", F.lit(True))
    goals = claims.select(problem, "goal")
    known_goals = checkpointed(goals.join(ids.withColumnRenamed("node", "goal").hint("merge"), [problem, "goal"], "left_semi"))
    above = checkpointed(fixpoint.ancestors(edges, known_goals, problem)).hint("merge")
    leaves = above.join(levels.filter("level = 0"), [problem, "node"], "left_semi").select(problem).distinct().withColumn("_reached", F.lit(True))
    present = known_goals.select(problem, F.lit(True).alias("_present"))
    given = nodes.filter("known").select(problem, "node", "value")
    values = checkpointed(fixpoint.recompute(rules, given, problem)).hint("merge")
    outputs = rules.select(problem, F.col("output").alias("node"))
    missing = outputs.join(values, [problem, "node"], "left_anti").groupBy(problem).agg(F.array_sort(F.collect_set("node")).alias("_missing"))
    odd = values.filter("value is null").join(outputs, [problem, "node"], "left_semi").groupBy(problem).agg(F.min("node").alias("_odd"))
    stated = nodes.select(problem, "node", F.col("value").alias("_v"))
    other = values.join(stated, [problem, "node"], "left").filter("value is not null and (_v is null or _v <> value)").groupBy(problem).agg(F.min("node").alias("_other"))
    overlap = claims.select(problem, F.explode("distractors").alias("node")).join(above, [problem, "node"], "left_semi").select(problem).distinct().withColumn("_overlap", F.lit(True))
    rows = claims
    for part in (cyclic, present, leaves, missing, odd, other, overlap):
        rows = rows.join(part.hint("merge"), problem, "left")
    return _errors(rows, variables, rule_count, depth, problem)


def _errors(rows: DataFrame, variables: int, rule_count: int, depth: int, problem: str) -> DataFrame:
    """(problem, errors) of claims beside what was found of them: _cyclic, _present, _reached and _overlap, true or null, and the names _missing, _odd and _other."""
    near = lambda a, b, most: F.coalesce(F.abs(F.col(a) - F.col(b)) <= most, F.lit(False))
    computed = F.col("_missing").isNull() & F.col("_odd").isNull()
    checks = [
        (F.col("_cyclic").isNotNull(), F.lit("graph is not acyclic")),
        (F.col("_present").isNull(), F.lit("goal is not a node")),
        (F.col("_present").isNotNull() & F.col("_reached").isNull(), F.lit("goal not reached from a leaf")),
        (~near("num_vars", "asked_vars", variables), F.lit("number of variables")),
        (~near("num_rules", "asked_rules", rule_count), F.lit("number of rules")),
        (~near("depth", "asked_depth", depth), F.lit("depth")),
        (F.col("_missing").isNotNull(), F.concat(F.lit("not computed: "), F.array_join("_missing", ", "))),
        (F.col("_odd").isNotNull(), F.concat(F.lit("unknown rule for "), F.col("_odd"))),
        (computed & F.col("_other").isNotNull(), F.concat(F.lit("value mismatch for "), F.col("_other"))),
        (F.col("_overlap").isNotNull(), F.lit("distractors lead to the goal")),
    ]
    return rows.select(problem, F.array_compact(F.array(*[F.when(test, text) for test, text in checks])).alias("errors"))
