"""Queries that score asked sets and aggregate episodes. An episode is an order, its asked set the items of its lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import setscore
from ..operators import metrics
from . import beliefs, dialogue
from .base import table

ITEMS = 25


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c, o, items): each order's set of item classes."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_set(F.concat(F.lit("I"), (F.col("l_partkey") % ITEMS).cast("string")))).alias("items"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"))
    return orders.join(lines, "o")


_BASKETS = f"b AS (SELECT o_custkey AS c, o_orderkey AS o, list_sort(list_distinct(list('I' || (l_partkey % {ITEMS})))) AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


def _truth(baskets: DataFrame) -> DataFrame:
    """(c, sets): the item sets of a customer's orders of even key."""
    return baskets.filter("o % 2 = 0").groupBy("c").agg(F.collect_list("items").alias("sets"))


def set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    baskets = _baskets(spark, sf_dir)
    scored = baskets.filter("o % 2 = 1").join(_truth(baskets), "c", "left")
    items = F.transform("items", F.lower)
    return scored.select(
        "o", F.round(setscore.max_f1(items, F.col("sets")), 6).alias("max_f1"), F.round(setscore.max_jaccard(items, F.col("sets")), 6).alias("max_jaccard"),
        setscore.covers_any(F.col("items"), F.col("sets")).alias("covers_any"), setscore.matches_any(F.col("items"), F.col("sets")).alias("matches_any"),
    )


def set_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    baskets = _baskets(spark, sf_dir)
    first = baskets.groupBy("c").agg(F.min_by("items", "o").alias("truth"))
    scored = baskets.join(first, "c").select("o", setscore.set_report(F.col("items"), F.col("truth")).alias("r"), setscore.precision_recall(F.col("items"), F.col("truth")).alias("p"))
    six = lambda c: F.round(c, 6)
    return scored.select(
        "o", "r.exact", six("r.jaccard").alias("jaccard"), "r.pred_size", "r.truth_size", "r.n_extra", "r.n_missing", six("r.over_rate").alias("over_rate"), six("r.under_rate").alias("under_rate"),
        "r.signed_difference", F.array_join("r.extra", ",").alias("extra"), F.array_join("r.missing", ",").alias("missing"), six("p.precision").alias("precision"), six("p.recall").alias("recall"), six("p.f1").alias("f1"),
    )


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_questions"), F.sum("l_quantity").alias("tokens"), F.max("l_linenumber").alias("turns"))
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 4 + 1).alias("k"), F.col("c_mktsegment").alias("task"))
    scored = set_scores(spark, sf_dir).select(F.col("o").alias("o_orderkey"), F.col("max_f1").alias("f1"), F.col("max_jaccard").alias("jaccard"))
    joined = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("c_custkey") == F.col("o_custkey"), "left").join(scored, "o_orderkey", "left")
    return joined.select(
        F.col("o_custkey").alias("sample_id"), (F.col("o_orderstatus") == "F").alias("correct"), (F.col("o_orderstatus") != "P").alias("answered"),
        "n_questions", "tokens", "turns", "k", "task", "f1", "jaccard",
    )


def episode_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.episode_metrics(_episodes(spark, sf_dir), ["k", "task"])
    return out.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def turn_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("task"), (F.col("l_tax") > 0.04).alias("known"), (F.col("l_discount") > 0.05).alias("covered"))
    out = metrics.pooled_rates(lines, ["task"], ["known", "covered"])
    return out.select("task", "scope", F.round("known_rate", 6).alias("known_rate"), F.round("covered_rate", 6).alias("covered_rate"))


def ever_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of orders, overall and by status, in which a line's target was ever known or covered."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("task"))
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    turns = lines.select("l_orderkey", "task", (F.col("l_tax") > 0.06).alias("known"), (F.col("l_discount") > 0.08).alias("covered"))
    out = metrics.ever_rates(turns, ["l_orderkey"], ["task"], ["known", "covered"])
    return out.select("task", "scope", "n_episodes", *[F.round(c, 6).alias(c) for c in ("ever_known_rate", "ever_covered_rate")])


def numeric_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.numeric_profile(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.select("column", *[F.round(c, 4).alias(c) for c in ("mean", "median", "min", "max")], F.round("total", 2).alias("total"), "n")


def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.outcome_counts(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", ["F", "O", "P"])


def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_tax") > 0.04).alias("taxed"), (F.col("l_discount") > 0.05).alias("reduced"), (F.col("l_quantity") > 25).alias("large"))
    return metrics.flag_counts(lines, ["taxed", "reduced", "large"])


def run_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _episodes(spark, sf_dir)
    out = metrics.run_performance(e, F.col("correct"), F.col("n_questions"), F.lit(20))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("success_rate", "mean_turns_won", "mean_turns_all")])


def call_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("dataset")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("turns"))
    return metrics.call_estimate(config.withColumns({"episodes": F.lit(2), "batches": F.lit(1)}))


def feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.feasibility(table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey") % 10), "p_brand", "p_size", "k")
    return out.select("p_brand", "n", "min_queryable", F.round("avg_queryable", 6).alias("avg_queryable"), "min_margin", F.round("avg_margin", 6).alias("avg_margin"), "n_violations")


def feasibility_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that can't be run, whose later items may be asked for and whose first one must be."""
    lists = _baskets(spark, sf_dir).select("o", (F.col("o") % 4).alias("k"), F.filter("items", lambda i: i > "I10").alias("queryable"), F.slice("items", 1, 1).alias("first"))
    found = metrics.feasibility_violations(lists, "o", "queryable", "k", "first")
    return found.withColumn("missing", F.array_join("missing", ","))


def asked_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate and invalid items of each episode: repeated items, and distinct items outside the valid range."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % ITEMS).alias("i"))
    return lines.groupBy("l_orderkey").agg((F.count("i") - F.count_distinct("i")).alias("n_duplicate"), F.count_distinct(F.when(F.col("i") >= 20, F.col("i"))).alias("n_invalid"))


def family_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each family with the columns of the combined report; what a family lacks is null.

    Orders have turns and tokens of their lines, users the turn at which their events get clear, customers the value of questions.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("turns"), F.sum("l_quantity").alias("tokens"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.lit("orders").alias("family"), (F.col("o_orderstatus") == "F").alias("correct"), "turns", "tokens")
    logs = dialogue.turns_to_clarity(spark, sf_dir).select(F.lit("events").alias("family"), F.col("turns_to_clarity").isNotNull().alias("sufficient"), F.col("turns_to_clarity").alias("turns_to"))
    values = beliefs.episode_values(spark, sf_dir).select(F.lit("customers").alias("family"), F.col("n_turns").alias("turns"), F.col("mean_eig").alias("eig"), F.col("final_entropy").alias("entropy"), (F.col("final_entropy") < 0.5).alias("correct"))
    rows = orders.unionByName(logs, allowMissingColumns=True).unionByName(values, allowMissingColumns=True)
    out = metrics.family_rows(rows, "family")
    return out.select("family", "n", *[F.round(c, 4).alias(c) for c in out.columns[2:]])


QUERIES = {f.__name__: f for f in (set_scores, set_reports, episode_metrics, turn_rates, ever_rates, numeric_profiles, outcome_counts, flag_counts, run_performance, call_estimate, feasibility, feasibility_violations, asked_counts, family_summary)}

_SCORES = f"""{_BASKETS}, s AS (SELECT a.o, len(a.items) AS na, len(g.items) AS ng, len(list_intersect(a.items, g.items)) AS i, g.o IS NOT NULL AS has FROM b a LEFT JOIN b g ON a.c = g.c AND g.o % 2 = 0 WHERE a.o % 2 = 1),
  sc AS (SELECT o, round(coalesce(max(2.0::DOUBLE * i / (na + ng)), 0), 6) AS max_f1, round(coalesce(max(i::DOUBLE / (na + ng - i)), 0), 6) AS max_jaccard,
    bool_or(coalesce(has AND i = ng, false)) AS covers_any, bool_or(coalesce(has AND i = ng AND i = na, false)) AS matches_any FROM s GROUP BY o)"""
_EPISODES = """l AS (SELECT l_orderkey, count(*) AS n_questions, sum(l_quantity) AS tokens, max(l_linenumber) AS turns FROM lineitem GROUP BY 1),
  ep AS (SELECT o_custkey AS sample_id, o_orderstatus = 'F' AS correct, o_orderstatus <> 'P' AS answered, n_questions, tokens, turns, c_nationkey % 4 + 1 AS k, c_mktsegment AS task, max_f1 AS f1, max_jaccard AS jaccard
    FROM orders JOIN l ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN sc ON o = o_orderkey)"""
ORACLES = {
    "set_scores": f"WITH {_SCORES} SELECT * FROM sc",
    "set_reports": f"""WITH {_BASKETS}, f AS (SELECT c, arg_min(items, o) AS truth FROM b GROUP BY c),
      j AS (SELECT o, items AS p, truth AS g, len(list_intersect(items, truth)) AS i, list_sort([x FOR x IN items IF NOT list_contains(truth, x)]) AS ex, list_sort([x FOR x IN truth IF NOT list_contains(items, x)]) AS mi FROM b JOIN f USING (c))
      SELECT o, len(ex) = 0 AND len(mi) = 0 AS exact, round(i::DOUBLE / (len(p) + len(g) - i), 6) AS jaccard, len(p)::INT AS pred_size, len(g)::INT AS truth_size, len(ex)::INT AS n_extra, len(mi)::INT AS n_missing,
        round(len(ex)::DOUBLE / len(g), 6) AS over_rate, round(len(mi)::DOUBLE / len(g), 6) AS under_rate, (len(ex) - len(mi))::INT AS signed_difference, array_to_string(ex, ',') AS extra, array_to_string(mi, ',') AS missing,
        round(i::DOUBLE / len(p), 6) AS precision, round(i::DOUBLE / len(g), 6) AS recall, round(2.0::DOUBLE * i / (len(p) + len(g)), 6) AS f1 FROM j""",
    "episode_metrics": f"""WITH {_SCORES}, {_EPISODES},
      m AS (SELECT sample_id, k, task, avg(correct::INT) AS m FROM ep GROUP BY ALL),
      a AS (SELECT k, task, CASE WHEN grouping(task) = 0 THEN 'task' WHEN grouping(k) = 0 THEN 'k' ELSE 'overall' END AS scope, count(*) AS total_episodes, round(avg(correct::INT), 5) AS micro_accuracy, round(avg(answered::INT), 5) AS answer_rate,
        round(avg(n_questions), 5) AS avg_questions_used, round(avg(f1), 5) AS avg_minset_f1, round(avg(jaccard), 5) AS avg_minset_jaccard, round(avg(tokens), 5) AS avg_thinking_tokens, round(avg(turns), 5) AS avg_num_turns_used,
        round(avg(n_questions - k), 5) AS avg_overhead_questions FROM ep GROUP BY GROUPING SETS ((), (k), (task))),
      n AS (SELECT k, task, CASE WHEN grouping(task) = 0 THEN 'task' WHEN grouping(k) = 0 THEN 'k' ELSE 'overall' END AS scope, round(avg(m), 5) AS macro_accuracy FROM m GROUP BY GROUPING SETS ((), (k), (task)))
      SELECT a.*, n.macro_accuracy FROM a JOIN n ON a.scope = n.scope AND a.k IS NOT DISTINCT FROM n.k AND a.task IS NOT DISTINCT FROM n.task""",
    "turn_rates": """SELECT l_returnflag AS task, CASE WHEN grouping(l_returnflag) = 0 THEN 'task' ELSE 'overall' END AS scope, round(avg((l_tax > 0.04)::INT), 6) AS known_rate, round(avg((l_discount > 0.05)::INT), 6) AS covered_rate
      FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag))""",
    "ever_rates": """WITH e AS (SELECT l_orderkey, o_orderstatus AS task, bool_or(l_tax > 0.06) AS known, bool_or(l_discount > 0.08) AS covered FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
      SELECT task, CASE WHEN grouping(task) = 0 THEN 'task' ELSE 'overall' END AS scope, count(*) AS n_episodes, round(avg(known::INT), 6) AS ever_known_rate, round(avg(covered::INT), 6) AS ever_covered_rate FROM e GROUP BY GROUPING SETS ((), (task))""",
    "numeric_profiles": " UNION ALL ".join(f"SELECT '{c}' AS column, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(sum({c}), 2) AS total, count({c}) AS n FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "outcome_counts": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"n_F\", count(*) FILTER (o_orderstatus = 'O') AS \"n_O\", count(*) FILTER (o_orderstatus = 'P') AS \"n_P\" FROM orders GROUP BY 1",
    "flag_counts": "SELECT 'taxed' AS flag, count(*) FILTER (l_tax > 0.04) AS n FROM lineitem UNION ALL SELECT 'reduced', count(*) FILTER (l_discount > 0.05) FROM lineitem UNION ALL SELECT 'large', count(*) FILTER (l_quantity > 25) FROM lineitem",
    "run_performance": f"WITH {_SCORES}, {_EPISODES} SELECT count(*) AS n, round(avg(correct::INT), 6) AS success_rate, round(avg(n_questions) FILTER (correct), 6) AS mean_turns_won, round(avg(CASE WHEN correct THEN n_questions ELSE 20 END), 6) AS mean_turns_all FROM ep",
    "call_estimate": "WITH c AS (SELECT event_type AS dataset, count(*) * 2 * count(DISTINCT user_id) AS calls FROM events GROUP BY 1) SELECT dataset, sum(calls)::BIGINT AS calls FROM c GROUP BY ROLLUP (dataset)",
    "feasibility": """SELECT p_brand, count(*) AS n, min(p_size) AS min_queryable, round(avg(p_size), 6) AS avg_queryable, min(p_size - p_partkey % 10) AS min_margin, round(avg(p_size - p_partkey % 10), 6) AS avg_margin,
      count(*) FILTER (p_size - p_partkey % 10 < 0) AS n_violations FROM part GROUP BY 1""",
    "feasibility_violations": f"""WITH {_BASKETS}, p AS (SELECT o AS key, o % 4 AS k, len([i FOR i IN items IF i > 'I10'])::INT AS n_queryable, CASE WHEN items[1] <= 'I10' THEN items[1] ELSE '' END AS missing FROM b),
      v AS (SELECT unnest(['below_k', 'none_queryable', 'canonical_missing']) AS kind, unnest([n_queryable < k, n_queryable = 0, missing <> '']) AS broken, * FROM p), x AS (SELECT * FROM v WHERE broken)
      SELECT kind, (count(*) OVER (PARTITION BY kind)) AS n, row_number() OVER (PARTITION BY kind ORDER BY key) AS pos, key, k, n_queryable, missing FROM x QUALIFY pos <= 10""",
    "asked_counts": f"SELECT l_orderkey, count(*) - count(DISTINCT l_partkey % {ITEMS}) AS n_duplicate, count(DISTINCT l_partkey % {ITEMS}) FILTER (l_partkey % {ITEMS} >= 20) AS n_invalid FROM lineitem GROUP BY 1",
    "family_summary": f"""WITH l AS (SELECT l_orderkey, count(*) AS turns, sum(l_quantity) AS tokens FROM lineitem GROUP BY 1), z AS ({dialogue.ORACLES["turns_to_clarity"]}), y AS ({beliefs.ORACLES["episode_values"]}),
      u AS (SELECT 'orders' AS family, o_orderstatus = 'F' AS correct, NULL::BOOLEAN AS sufficient, NULL::BIGINT AS turns_to, turns, tokens, NULL::DOUBLE AS eig, NULL::DOUBLE AS entropy FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
        UNION ALL SELECT 'events', NULL, turns_to_clarity IS NOT NULL, turns_to_clarity, NULL, NULL, NULL, NULL FROM z UNION ALL SELECT 'customers', final_entropy < 0.5, NULL, NULL, n_turns, NULL, mean_eig, final_entropy FROM y)
      SELECT family, count(*) AS n, round(avg(correct::INT), 4) AS accuracy, round(avg(sufficient::INT), 4) AS final_sufficiency, round(avg(turns_to), 4) AS turns_to_sufficiency, round(avg(turns), 4) AS avg_turns, round(avg(turns) FILTER (correct), 4) AS avg_turns_right,
        round(avg(tokens), 4) AS avg_tokens, round(avg(eig), 4) AS mean_eig, round(avg(entropy), 4) AS mean_final_entropy FROM u GROUP BY 1""",
}
