"""Queries on problem tables: an order is a problem, its lines are literals, conditions or worlds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import verdicts
from ..operators import metrics, minset, problems, relate, sample, verify
from .base import table
from .curation import _LISTS, _lists
from .search import _WORLDS, BITS, _variables, _worlds

joined = lambda c: F.array_join(c, ",")


def eligible_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a wanted k that pass the gate of their k."""
    parts = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey") % 5)
    wanted = problems.keep_values(parts, "k", [1, 2, 3])
    return problems.eligible(wanted, "k", {1: F.col("p_size") >= 10, 2: F.col("p_size") >= 20, 3: F.lit(True)}).select("p_partkey", "k")


def catalogue_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as models: those without a catalogue entry, and those whose entry has another size than claimed."""
    entries = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    claims = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 12).alias("claimed"))
    return problems.with_catalogue(claims, entries, "c_custkey", "n", "claimed").filter("problem is not null").select("c_custkey", "problem")


def outcomes_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose status and priority occur together on no order over 300,000."""
    orders = table(spark, sf_dir, "orders")
    return problems.outside(orders, orders.filter("o_totalprice > 300000"), ["o_orderstatus", "o_orderpriority"]).select("o_orderkey")


def world_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return problems.world_rows(_lists(spark, sf_dir), "o", "items")


def context_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    worlds = _worlds(spark, sf_dir)
    contexts = worlds.select("problem_id").distinct().select("problem_id", F.explode(F.array(*[F.lit(v).cast("long") for v in (0, 1, 8, 9)])).alias("value"), F.lit(9).cast("long").alias("mask"))
    basin = worlds.select("problem_id", "state", F.col("y").alias("attractor_id")).distinct()
    return problems.context_outcomes(worlds.select("problem_id", "state").distinct(), contexts.withColumn("context", F.col("value")), basin, 1)


def _literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o, literals, q): x<line>, negated where the line was returned, and the largest quantity."""
    lit = F.concat(F.when(F.col("l_returnflag") == "R", "not x").otherwise("x"), F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_set(lit)).alias("literals"), F.max("l_quantity").alias("q"))


_LITERALS = "x AS (SELECT l_orderkey AS o, list_sort(list_distinct(list(CASE WHEN l_returnflag = 'R' THEN 'not x' ELSE 'x' END || l_linenumber))) AS literals, max(l_quantity) AS q FROM lineitem GROUP BY 1)"


def assignment_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truth of assignments that are a derivation's literals in another order; every third order has one literal too many."""
    lits = _literals(spark, sf_dir)
    target = F.when(F.col("q") > 40, "goal").otherwise("not goal")
    derivations = lits.select("o", F.to_json(F.reverse("literals")).alias("key"), target.alias("target"))
    more = F.when(F.col("o") % 3 == 0, F.array(F.lit("z"))).otherwise(F.array().cast("array<string>"))
    return problems.assignment_targets(lits.select("o", F.concat("literals", more).alias("literals")), derivations, "o", F.lit("goal"))


def truths_of_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.element_at(F.array(F.lit("ambiguity"), F.lit("forbid"), F.lit("any")), (F.col("o") % 3 + 1).cast("int"))
    lists = _lists(spark, sf_dir)
    sets = F.array(F.slice("items", 1, 1))
    truth = problems.truth_of_mode(mode, sets, F.array(F.slice("items", 1, 1), F.col("items")), F.size("items"))
    return lists.select("o", F.array_join(truth, ";").alias("truth"))


def unknown_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lits = _literals(spark, sf_dir)
    return lits.select("o", joined(problems.unknown_literals(F.array("literals"), F.array(F.lit("x1")), F.lit("x3"))).alias("unknown"))


def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _lists(spark, sf_dir).select(F.reverse(F.slice("items", 2, 100)).alias("context"), F.slice("items", 1, 1).alias("chosen"))
    out = problems.distinct_pairs(pairs, "context", "chosen")
    return out.select(joined("context").alias("context"), joined("chosen").alias("chosen"))


def smallest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three smallest parts of each brand and size class, ties by key."""
    parts = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 3).alias("cell"), "p_size", "p_partkey")
    return sample.hardest(parts, ["p_brand", "cell"], [F.col("p_size"), F.col("p_partkey")], 3)


def name_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's item names as a text of its last two names has them, the rest after."""
    text = joined(F.reverse(F.slice("items", -2, 2)))
    lists = _lists(spark, sf_dir).filter(F.size("items") >= 2)
    return lists.select("o", joined(problems.by_appearance(F.col("items"), text)).alias("names"))


def equation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, all names and the goal of each order's equations x<line> = x<line + 1> + y<line>."""
    line = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("x"), line).alias("lhs"), F.concat(F.lit("x"), line + 1, F.lit(" + y"), line).alias("rhs"), F.concat(F.lit("y"), line).alias("y"))
    per = rows.groupBy("l_orderkey").agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in ("lhs", "rhs", "y")])
    leaves = problems.leaf_names(F.array().cast("array<string>"), F.concat("y", "lhs"), F.col("lhs"))
    goal = problems.goal_name(F.concat(F.lit("Now: what is "), F.get("lhs", F.lit(0)), F.lit("?")))
    return per.select("l_orderkey", joined(leaves).alias("leaves"), joined(problems.names_in(F.concat("lhs", "rhs"))).alias("names"), goal.alias("goal"))


def shortened_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event keys without an obsolete field, and whether they had it."""
    old = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"id":"'), F.col("event_id"), F.lit('","old":"1","type":"'), F.col("event_type"), F.lit('"}')))
    key = F.coalesce(old, F.concat(F.lit('{"id":"'), F.col("event_id"), F.lit('"}')))
    return table(spark, sf_dir, "events").select("event_id", problems.without_field(key, "old").alias("k")).select("event_id", "k.key", "k.changed")


def listed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("["), F.col("p_size"), F.lit(", 1.5]"))).otherwise(F.col("p_size").cast("string"))
    numbers = problems.listed_numbers(cell, F.lit(3))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(numbers).alias("n"), F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x).alias("total"))


def catalogue_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _worlds(spark, sf_dir).select(F.col("problem_id").alias("model"), F.col("y").alias("attractor_id"), "state").distinct()
    return problems.catalogue_text(states, BITS)


def thinking_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each order's returned and kept lines as the thoughts of two sides."""
    line = F.struct("l_linenumber", "l_partkey")
    own = lambda kept: F.transform(F.array_sort(F.collect_list(F.when(kept, line))), lambda x: x["l_partkey"])
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(own(F.col("l_returnflag") == "R").alias("a"), own(F.col("l_returnflag") != "R").alias("b"))
    return problems.thinking_trace(per, "l_orderkey", {"asker": "a", "answerer": "b"})


def one_of_each_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order of each customer for either sign of its total, in seeded order."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("o"), "o_totalprice")
    rows = orders.join(_literals(spark, sf_dir), "o")
    out = problems.one_of_each_sign(rows, "o_custkey", F.col("o_totalprice") < 150_000, "literals", F.struct(sample.draw(42, F.col("o")), "o"))
    return out.select("o_custkey", "negative", "o")


def foreign_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five foreign labels of each nation, drawn by hash."""
    labels = table(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_custkey") % 40).alias("label"))
    return relate.drawn_labels_of_others(labels, "c_nationkey", "label", 5, 42)


def forbid_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical set of each customer's baskets, and what may be asked when the others are forbidden."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("o"))
    sets = orders.join(_lists(spark, sf_dir), "o").groupBy("o_custkey").agg(F.collect_list("items").alias("sets"))
    queryable = F.array(*[F.lit(f"I{i:02d}") for i in range(12)])
    p = sets.select("o_custkey", minset.forbid_profile(F.col("sets"), queryable).alias("p"))
    return p.select("o_custkey", *[joined(f"p.{c}").alias(c) for c in ("canonical", "forbidden", "allowed", "extra")])


MASKS, K = (3, 5, 6, 7, 9, 10, 12, 17, 20, 33, 40, 48), 2


def _claims(worlds: DataFrame) -> DataFrame:
    return worlds.select("problem_id").distinct().withColumn("k", F.lit(K))


def five_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    worlds = _worlds(spark, sf_dir)
    sets = worlds.select("problem_id").distinct().select("problem_id", F.explode(F.array(*[F.lit(m).cast("long") for m in MASKS])).alias("mask"))
    return verify.five_checks(worlds, sets, _claims(worlds), _variables(worlds), K, 100)


def global_minimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    worlds = _worlds(spark, sf_dir)
    claims = worlds.groupBy("problem_id").agg((F.max("state") % 4).cast("int").alias("k"))
    return verify.global_minimality(worlds, claims, _variables(worlds), 2, 100)


def sample_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with what is wrong with them: too many lines, a wrong total, or no line."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("q"))
    rows = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    checks = rows.select("o_orderkey", F.col("n").isNull().alias("none"), (F.col("n") > 5).alias("many"), (F.col("q") > 49).alias("value"))
    return verify.sample_errors(checks, "o_orderkey", {"none": "no lines", "many": "too many lines", "value": "value mismatch"}).select("o_orderkey", F.array_join("errors", "; ").alias("errors"))


REPLIES = [
    "Question: Is Alice kind? Is Alice [very tall]?", "I am done. End questioning", "Answer: 3", "answer: no", "Yes, but not sure about how many", "There are 2 or 4", "Answer: Yes\nno doubt", "It is so.\nanswer: not sure", "hm",
]


def reply_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the replies of lines say, read as choices, as a number of missing facts and as a truth."""
    said = F.get(F.array(*map(F.lit, REPLIES)), (F.col("l_partkey") % len(REPLIES)).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(said, F.when(F.col("l_linenumber") % 2 == 0, F.lit("")).otherwise(F.lit(" Yes"))).alias("t"))
    t = F.col("t")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", joined(verdicts.choice_verdict(t)).alias("choices"), verdicts.ambiguity_verdict(t).alias("missing"), verdicts.truth_verdict(t).alias("truth"))


def settled_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last number that a kept line states as an answer, by order."""
    said = F.when(F.col("l_quantity") > 20, F.concat(F.lit("So. Answer: "), F.col("l_partkey"), F.lit(" or 7"))).when(F.col("l_quantity") > 10, "Answer: unclear").otherwise(F.col("l_partkey").cast("string"))
    message = F.struct("l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "N", "model").otherwise("user").alias("role"), said.alias("content"))
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(message)).alias("m"))
    return per.select("l_orderkey", verdicts.settled_number(F.col("m"), "model").alias("number"))


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, scored rows and accuracy of orders: overall, for each k and each depth."""
    correct = F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_orderstatus") == "F")
    rows = table(spark, sf_dir, "orders").select(correct.alias("correct"), (F.col("o_custkey") % 4).alias("k"), (F.col("o_orderkey") % 7).alias("depth"))
    out = metrics.scored_rows(rows, "correct", ["k", "depth"])
    return out.withColumn("accuracy", F.round("accuracy", 6))


def question_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode metrics of orders as dialogues with matched questions: overall and for each k."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("q"), F.col("l_partkey") % 9).alias("q"), "l_quantity", "l_linenumber")
    matched = F.when(F.col("q") < "q6", F.col("q"))
    per = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("q")).alias("asked"), F.sum(matched.isNotNull().cast("int")).alias("n_matched"), F.collect_set(matched).alias("matched"), F.max("l_linenumber").alias("turns"), F.sum("l_quantity").alias("tokens"))
    wanted = F.array(F.lit("q1"), F.lit("q4"), F.lit("q7"))
    rows = table(spark, sf_dir, "orders").join(per, "o_orderkey")
    episodes = rows.select(
        F.col("o_custkey").alias("sample_id"), (F.col("o_orderstatus") == "F").alias("correct"), (F.col("o_orderstatus") != "P").alias("answered"), (F.col("o_orderkey") % 10 == 0).alias("error"),
        "asked", "matched", "n_matched", wanted.alias("wanted"), "tokens", "turns", (F.col("o_custkey") % 3 + 1).alias("k"),
    )
    out = metrics.question_metrics(episodes, ["k"])
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return metrics.coverage(parts.select((F.col("p_size") % 4).alias("k"), (F.col("p_size") % 9).alias("depth"), (F.col("p_retailprice") > 1500).alias("dear"), (F.col("p_size") > 25).alias("large")), "k", "depth", ["dear", "large"])


QUERIES = {
    f.__name__: f
    for f in (
        eligible_problems, catalogue_checks, outcomes_outside, world_rows, context_outcomes, assignment_targets, truths_of_modes, unknown_literals, distinct_pairs, smallest_first, name_order, equation_names,
        shortened_keys, listed_numbers, catalogue_text, thinking_trace, one_of_each_sign, foreign_samples, forbid_profiles, five_checks, global_minimality, sample_errors, reply_verdicts, settled_numbers, scored_rows,
        question_metrics, coverage_summary,
    )
}

_JUDGED = f"""WITH {_WORLDS}, masks AS (SELECT unnest(range(0, 64))::BIGINT AS mask), pt AS (SELECT problem_id, mask, min(y) = max(y) AS one FROM w, masks GROUP BY problem_id, mask, state & mask),
  s AS (SELECT problem_id, mask, bool_and(one) AS ok FROM pt GROUP BY ALL)"""
_REPLY = "[" + ", ".join("'" + r.replace("\n", "' || chr(10) || '") + "'" for r in REPLIES) + "]"

ORACLES = {
    "eligible_problems": "SELECT p_partkey, p_partkey % 5 AS k FROM part WHERE p_partkey % 5 = 1 AND p_size >= 10 OR p_partkey % 5 = 2 AND p_size >= 20 OR p_partkey % 5 = 3",
    "catalogue_checks": """SELECT c_custkey, CASE WHEN n IS NULL THEN 'missing' ELSE 'size' END AS problem FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
      WHERE n IS NULL OR n <> c_custkey % 12""",
    "outcomes_outside": "SELECT o_orderkey FROM orders ANTI JOIN (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 300000) USING (o_orderstatus, o_orderpriority)",
    "world_rows": f"WITH {_LISTS} SELECT o, unnest(range(0, len(items))) AS pos, unnest(items) AS world FROM b",
    "context_outcomes": f"""WITH {_WORLDS}, u AS (SELECT DISTINCT problem_id, state, y FROM w), l AS (SELECT problem_id, y, (min(state) >> 1) & 1 AS bit FROM u GROUP BY ALL),
      d AS (SELECT DISTINCT problem_id, state FROM u), c AS (SELECT DISTINCT problem_id, context FROM u, (SELECT unnest([0, 1, 8, 9])::BIGINT AS context))
      SELECT c.problem_id, context, count(*) AS n_states, count(DISTINCT u.y) AS n_attractors, count(DISTINCT u.y) FILTER (bit = 1) AS n_on
      FROM c JOIN d ON d.problem_id = c.problem_id AND d.state & 9 = context JOIN u ON u.problem_id = d.problem_id AND u.state = d.state JOIN l ON l.problem_id = u.problem_id AND l.y = u.y GROUP BY ALL""",
    "assignment_targets": "SELECT l_orderkey AS o, CASE WHEN max(l_quantity) > 40 THEN 'yes' ELSE 'no' END AS truth FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1",
    "truths_of_modes": f"WITH {_LISTS} SELECT o, CASE o % 3 WHEN 0 THEN len(items)::VARCHAR WHEN 1 THEN items[1] ELSE items[1] || ';' || array_to_string(items, ',') END AS truth FROM b",
    "unknown_literals": f"WITH {_LITERALS} SELECT o, array_to_string([v FOR v IN list_sort(list_distinct([replace(v, 'not ', '') FOR v IN literals])) IF v NOT IN ('x1', 'x3')], ',') AS unknown FROM x",
    "distinct_pairs": f"WITH {_LISTS} SELECT DISTINCT array_to_string(items[2:], ',') AS context, items[1] AS chosen FROM b",
    "smallest_first": "SELECT p_brand, p_size % 3 AS cell, p_size, p_partkey, row_number() OVER (PARTITION BY p_brand, p_size % 3 ORDER BY p_size, p_partkey) AS rank FROM part QUALIFY rank <= 3",
    "name_order": f"WITH {_LISTS} SELECT o, array_to_string(list_concat([items[-1], items[-2]], items[1:len(items) - 2]), ',') AS names FROM b WHERE len(items) >= 2",
    "equation_names": """WITH n AS (SELECT l_orderkey, list_distinct(list('x' || l_linenumber)) AS a, list_distinct(list('x' || (l_linenumber + 1))) AS c, list_distinct(list('y' || l_linenumber)) AS y FROM lineitem GROUP BY 1)
      SELECT l_orderkey, array_to_string(list_sort(y), ',') AS leaves, array_to_string(list_sort(list_distinct(list_concat(list_concat(a, c), y))), ',') AS names, list_sort(a)[1] AS goal FROM n""",
    "shortened_keys": """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"id":"' || event_id || '","type":"' || event_type || '"}' ELSE '{"id":"' || event_id || '"}' END AS key, event_id % 2 = 0 AS changed FROM events""",
    "listed_numbers": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 3 END AS n, CASE WHEN p_size % 2 = 0 THEN p_size + 1.5::DOUBLE ELSE 3.0::DOUBLE * p_size END AS total FROM part",
    "catalogue_text": f"""WITH {_WORLDS}, u AS (SELECT DISTINCT problem_id, y, state FROM w), l AS (SELECT problem_id, y, y || ': ' || string_agg(reverse(lpad(bin(state), {BITS}, '0')), ' -> ' ORDER BY state) AS line FROM u GROUP BY problem_id, y)
      SELECT problem_id AS model, string_agg(line, chr(10) ORDER BY y) AS text FROM l GROUP BY 1""",
    "thinking_trace": """SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'asker' ELSE 'answerer' END AS side, row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R' ORDER BY l_linenumber, l_partkey) - 1 AS pos, l_partkey AS content FROM lineitem""",
    "one_of_each_sign": f"WITH {_LITERALS} SELECT o_custkey, o_totalprice < 150000 AS negative, o FROM orders JOIN x ON o = o_orderkey WHERE o_totalprice >= 150000 OR len([v FOR v IN literals IF starts_with(v, 'not ')]) <= 1 QUALIFY row_number() OVER (PARTITION BY o_custkey, o_totalprice < 150000 ORDER BY md5('42|' || o), o) = 1",
    "foreign_samples": "WITH l AS (SELECT DISTINCT c_nationkey, c_custkey % 40 AS label FROM customer), f AS (SELECT * FROM (SELECT DISTINCT c_nationkey FROM l), (SELECT DISTINCT label FROM l) EXCEPT SELECT * FROM l) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('42|' || label), label) <= 5",
    "forbid_profiles": f"""WITH {_LISTS}, s AS (SELECT o_custkey, arg_min(items, {{'n': len(items), 's': items}}) AS c, list_distinct(flatten(list(items))) AS every FROM b JOIN orders ON o_orderkey = o GROUP BY 1),
      f AS (SELECT *, [v FOR v IN list_sort(every) IF NOT list_contains(c, v)] AS f, [v FOR v IN list_transform(range(0, 12), lambda i: 'I' || lpad(i::VARCHAR, 2, '0')) IF NOT list_contains([v FOR v IN list_sort(every) IF NOT list_contains(c, v)], v)] AS a FROM s)
      SELECT o_custkey, array_to_string(c, ',') AS canonical, array_to_string(f, ',') AS forbidden, array_to_string(a, ',') AS allowed, array_to_string([v FOR v IN a IF NOT list_contains(c, v)], ',') AS extra FROM f""",
    "five_checks": _JUDGED + f""", c AS (SELECT * FROM s WHERE mask IN {MASKS}), d AS (SELECT c.problem_id, c.mask, bool_or(s.ok) AS loose FROM c JOIN s ON s.problem_id = c.problem_id AND s.mask & c.mask = s.mask AND bit_count(s.mask) = bit_count(c.mask) - 1 GROUP BY ALL),
      g AS (SELECT problem_id, bool_or(ok) FILTER (bit_count(mask) = {K - 1}) AS smaller, bool_or(ok) FILTER (mask = 0) AS free FROM s GROUP BY 1)
      SELECT c.problem_id, c.mask, CASE WHEN free THEN 'determined without' WHEN NOT c.ok THEN 'not sufficient' WHEN bit_count(c.mask) <> {K} THEN 'wrong size' WHEN loose THEN 'not essential' WHEN smaller THEN 'smaller set' ELSE 'ok' END AS verdict
      FROM c JOIN d USING (problem_id, mask) JOIN g USING (problem_id)""",
    "global_minimality": _JUDGED + """, k AS (SELECT problem_id, (max(state) % 4)::INT AS k FROM w GROUP BY 1), n AS (SELECT k.problem_id, k.k, count(s.ok) AS n_tested, bool_or(s.ok) AS hit FROM k LEFT JOIN s ON s.problem_id = k.problem_id AND bit_count(s.mask) = k.k - 1 AND k.k <= 2 GROUP BY ALL)
      SELECT problem_id, k, CASE WHEN hit IS NULL THEN 'skip' WHEN hit THEN 'fail' ELSE 'pass' END AS status, n_tested FROM n""",
    "sample_errors": """SELECT o_orderkey, concat_ws('; ', CASE WHEN n IS NULL THEN 'no lines' END, CASE WHEN coalesce(n > 5, true) THEN 'too many lines' END, CASE WHEN coalesce(q > 49, true) THEN 'value mismatch' END) AS errors
      FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "reply_verdicts": rf"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, {_REPLY}[l_partkey % {len(REPLIES)} + 1] || CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE ' Yes' END AS t FROM lineitem),
      q AS (SELECT *, CASE WHEN contains(t, 'End questioning') THEN 'End questioning' ELSE trim(list_last(string_split(t, 'Question:'))) END AS p FROM r), z AS (SELECT *, lower(p) AS s, string_split(p, chr(10))[1] || list_last(string_split(lower(p), 'answer')) AS told FROM q)
      SELECT l_orderkey, l_linenumber, l_partkey,
        CASE WHEN contains(s, 'end questioning') THEN 'End questioning' WHEN len(regexp_extract_all(p, 'Is Alice \[?([ \w-]+)\]?\?', 1)) > 0 THEN array_to_string(list_sort(list_distinct(regexp_extract_all(p, 'Is Alice \[?([ \w-]+)\]?\?', 1))), ',') ELSE 'None' END AS choices,
        coalesce(list_last(regexp_extract_all(s, 'answer:\s*([1-4])\b', 1)), CASE WHEN contains(s, 'answer: no') OR regexp_matches(s, '\bno\b.*ambiguous') THEN 'no' WHEN contains(s, 'yes, but not sure') THEN 'not sure' END, list_last(regexp_extract_all(s, '\b([1-4])\b', 1)), 'None') AS missing,
        CASE WHEN NOT regexp_matches(s, 'yes|not sure|no') THEN 'None' WHEN contains(told, 'not sure') THEN 'not sure' WHEN contains(told, 'no') THEN 'no' WHEN contains(told, 'yes') THEN 'yes' END AS truth FROM z""",
    "settled_numbers": "SELECT l_orderkey, arg_max(l_partkey, {'a': l_linenumber, 'b': l_partkey}) FILTER (l_returnflag = 'N' AND l_quantity > 20)::DOUBLE AS number FROM lineitem GROUP BY 1",
    "scored_rows": """WITH r AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS correct, o_custkey % 4 AS k, o_orderkey % 7 AS depth FROM orders)
      SELECT k, depth, CASE WHEN grouping(k) = 0 THEN 'k' WHEN grouping(depth) = 0 THEN 'depth' ELSE 'overall' END AS scope, count(*) AS n_rows, count(correct) AS n_scored, round(avg(correct::INT), 6) AS accuracy,
        count(*) FILTER (correct) AS n_correct, count(*) FILTER (NOT correct) AS n_incorrect FROM r GROUP BY GROUPING SETS ((), (k), (depth))""",
    "question_metrics": """WITH l AS (SELECT l_orderkey, list('q' || (l_partkey % 9)) AS asked, max(l_linenumber) AS turns, sum(l_quantity) AS tokens FROM lineitem GROUP BY 1),
      e AS (SELECT o_custkey AS s, o_orderstatus = 'F' AS correct, o_orderstatus <> 'P' AS answered, o_orderkey % 10 = 0 AS error, o_custkey % 3 + 1 AS k, turns, tokens, len(asked) AS n, list_distinct(asked) AS a, [v FOR v IN asked IF v < 'q6'] AS m FROM orders JOIN l ON l_orderkey = o_orderkey),
      f AS (SELECT *, len(m) / n AS precision, 2.0 * len(list_intersect(list_distinct(m), ['q1', 'q4', 'q7'])) / nullif(len(list_distinct(m)) + 3, 3) AS f1, len(list_intersect(a, ['q1', 'q4', 'q7'])) / len(list_distinct(list_concat(a, ['q1', 'q4', 'q7']))) AS jaccard FROM e),
      c AS (SELECT s, k, avg(correct::INT) AS m FROM e GROUP BY ALL), g AS (SELECT k, avg(m) AS macro FROM c GROUP BY GROUPING SETS ((), (k)))
      SELECT x.*, round(g.macro, 6) AS macro_accuracy FROM (SELECT k, CASE WHEN grouping(k) = 0 THEN 'k' ELSE 'overall' END AS scope, count(*) AS total_episodes, count(*) FILTER (error) AS n_episode_errors, round(avg(correct::INT), 6) AS micro_accuracy, round(avg(answered::INT), 6) AS answer_rate, round(avg(n), 6) AS avg_questions_used,
        round(avg(coalesce(f1, 0)), 6) AS avg_minset_f1, round(avg(jaccard), 6) AS avg_minset_jaccard, round(avg(tokens), 6) AS avg_thinking_tokens, round(avg(turns), 6) AS avg_num_turns_used, round(avg(n - k), 6) AS avg_overhead_questions, round(avg(precision), 6) AS avg_question_precision
        FROM f GROUP BY GROUPING SETS ((), (k))) x JOIN g ON g.k IS NOT DISTINCT FROM x.k""",
    "coverage_summary": """WITH p AS (SELECT p_size % 4 AS k, CASE WHEN p_size % 9 <= 3 THEN 'low' WHEN p_size % 9 <= 6 THEN 'mid' ELSE 'high' END AS b, p_retailprice > 1500 AS dear, p_size > 25 AS large FROM part)
      SELECT (SELECT string_agg(k || '=' || n, ', ' ORDER BY k) FROM (SELECT k, count(*) AS n FROM p GROUP BY 1)) AS by_k, (SELECT string_agg(b || '=' || n, ', ' ORDER BY b) FROM (SELECT b, count(*) AS n FROM p GROUP BY 1)) AS by_depth,
        count(*) FILTER (dear) AS n_dear, count(*) FILTER (large) AS n_large, count(*) AS n FROM p""",
}
