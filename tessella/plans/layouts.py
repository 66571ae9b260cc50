"""Queries on the layouts of problem rows, replies and trees: an order is a problem, its lines are names, steps or values."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import layouts, sample
from ..sources import io
from ..sources.storage import checkpoint_dir
from .base import table
from .curation import _LISTS, _lists
from .problems import joined

FAMILIES, TARGETS = ("GeneReg-SS", "GeneReg-Dyn", "other"), ("attractor_id", "marker_gene")


def task_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the task that their family and target make."""
    pick = lambda values, c: F.get(F.array(*map(F.lit, values)), (F.col(c) % len(values)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", layouts.task_name(pick(FAMILIES, "p_partkey"), pick(TARGETS, "p_size")).alias("task"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o, names, values): v<part % 60> of each order's lines in order of first line, and the largest quantity of each."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.concat(F.lit("v"), F.col("l_partkey") % 60).alias("name"), "l_quantity")
    per = line.groupBy("o", "name").agg(F.max("l_quantity").alias("q"))
    return per.groupBy("o").agg(F.array_sort(F.collect_list("name")).alias("names"), F.map_from_entries(F.collect_list(F.struct("name", "q"))).alias("values"))


def aliased_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's names, values and one rule by aliases in name order."""
    rows = _names(spark, sf_dir).withColumn("a", layouts.alias_map(F.col("names")))
    rule = F.struct(F.get("names", F.lit(0)).alias("output"), F.lit("sum_mul_k").alias("rule_type"), F.col("names").alias("inputs"), F.lit(3).alias("constant"))
    values = F.array_sort(F.map_entries(layouts.aliased_values(F.col("values"), F.col("a"))))
    return rows.select(
        "o", joined(layouts.aliased(F.col("names"), F.col("a"))).alias("names"), joined(F.transform(values, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("int")))).alias("values"),
        F.get(layouts.aliased_rules(F.array(rule), F.col("a")), F.lit(0))["expression"].alias("rule"),
    )


def laid_out_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the layout of problem files: all names can be asked, all but the first are relevant, the last is held out."""
    rows = _names(spark, sf_dir).select("o", F.col("names").alias("leaves"), F.slice("names", 2, 100).alias("relevant"), F.slice("names", -1, 1).alias("held_out"), F.aggregate(F.map_values("values"), F.lit(0.0), lambda s, v: s + v).alias("answer"))
    return layouts.reference_layout(rows, "leaves", "relevant", "held_out", ["answer"])


def held_out_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of an order's items as a held-out choice, with its id."""
    rows = _lists(spark, sf_dir).select("o", joined("items").alias("text"), F.size("items").alias("k"), F.col("items").alias("choices"))
    return layouts.held_out_rows(rows, "text", "k", "choices").select("o", "problem_id", "sample_id", "held_out")


def result_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of constraints and variables of orders' cells: lists, objects and text that is neither."""
    rows = _names(spark, sf_dir)
    cell = F.when(F.col("o") % 3 == 0, F.to_json("names")).when(F.col("o") % 3 == 1, F.to_json("values")).otherwise("none")
    cost = F.when(F.col("o") % 2 == 0, F.lit("0.5"))
    return rows.select("o", layouts.result_counts(cell, cell, cost, F.lit(None).cast("int")).alias("c")).select("o", "c.*")


def written_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as trees of JSON files, written and read again, as indented text: region, then market segments, then the number of customers."""
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = customers.groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).cast("string").alias("n"))
    leaf = F.concat(F.lit('{"type":"decision","label":"'), "n", F.lit('"}'))
    branch = F.concat(F.lit('"'), "c_mktsegment", F.lit('":{"type":"assessment","label":"count","next":'), leaf, F.lit("}"))
    trees = counts.groupBy("n_name").agg(F.concat(F.lit('{"type":"condition","label":"segment","branches":{'), F.array_join(F.array_sort(F.collect_list(branch)), ","), F.lit("}}")).alias("value"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    trees.select(F.col("value"), "n_name").repartition("n_name").write.partitionBy("n_name").text(path)
    docs = spark.read.text(path, wholetext=True).select(F.col("n_name").alias("tree"), F.col("value").alias("json"))
    return layouts.tree_text(layouts.tree_rows(docs))


def _tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a tree for each nation: its region, then market segments, then the sign of the balance, then the number of customers."""
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sign = F.when(F.col("c_acctbal") < 0, "debt").otherwise("credit").alias("sign")
    counts = customers.groupBy("n_name", "n_regionkey", F.col("c_mktsegment").alias("s"), sign).agg(F.count(F.lit(1)).cast("string").alias("n"))
    text = lambda *parts: F.concat(*[F.lit(p[1:]) if p.startswith("'") else F.col(p) for p in parts])
    branches = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    leaf = text("'\"", "sign", "'\":{\"type\":\"decision\",\"label\":\"", "n", "'\"}")
    signs = counts.groupBy("n_name", "n_regionkey", "s").agg(branches(leaf).alias("b"))
    branch = text("'\"", "s", "'\":{\"type\":\"condition\",\"label\":\"balance of ", "s", "'\",\"branches\":{", "b", "'}}")
    trees = signs.groupBy("n_name", F.col("n_regionkey").cast("string").alias("r")).agg(branches(branch).alias("b"))
    root = text("'{\"type\":\"assessment\",\"label\":\"region ", "r", "'\",\"next\":{\"type\":\"condition\",\"label\":\"segment\",\"branches\":{", "b", "'}}}")
    return layouts.tree_rows(trees.select(F.col("n_name").alias("tree"), root.alias("json")))


def tree_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each way through a nation's tree with its last one or two conditions asked for."""
    asked = layouts.tree_questions(layouts.tree_paths(_tree_nodes(spark, sf_dir)), 2)
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["label"], F.lit("="), x["answer"])), ",")
    return asked.select("tree", "k", "assessment", said("context").alias("context"), said("desired").alias("desired"), F.array_join("questions", ",").alias("questions"), "outcome")


def tree_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, decisions, conditions and category of each nation's tree."""
    return layouts.tree_summary(_tree_nodes(spark, sf_dir)).withColumn("conditions", F.array_join("conditions", ","))


def checked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines, some cut off or without a text, read again with the bad lines put aside."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    doc = F.struct("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("lang"), "text")
    line = F.when(F.col("doc_id") % 7 == 0, F.regexp_replace(F.to_json(doc), r"\}$", "")).otherwise(F.to_json(doc))
    table(spark, sf_dir, "documents").select(line.alias("value")).write.text(path)
    good, bad = io.read_checked(spark, path, "doc_id long, lang string, text string", ["doc_id", "lang"])
    both = good.select(F.lit("good").alias("reason"), F.length("text").alias("n")).unionByName(bad.select("reason", F.lit(None).cast("int").alias("n")))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n_chars"))


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as JSON lines to one folder for each priority's digit, read as one table by wildcard, counted by shard."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.concat(F.lit("new_"), F.substring("o_orderpriority", 1, 1), F.lit("_500k")).alias("folder"))
    orders.write.partitionBy("folder").json(path)
    rows = io.read_shards(spark, f"{path}/folder=new_*_500k", "o_orderkey long, o_totalprice double", r"new_(\w+)_500k")
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("n_keys"))


SAID = ["So.\nQuestion: Is it red?\nmore", "Question: a? b\nAnswer: 4 ", "nothing here", "answer: yes\nAnswer:\nno", "first\nQuestion: who asks, and why"]


def split_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the replies of lines show, and what else they say."""
    said = F.get(F.array(*map(F.lit, SAID)), (F.col("l_partkey") % len(SAID)).cast("int"))
    t = F.concat(said, F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" "), F.col("l_linenumber"))).otherwise(""))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", tx.visible_action(t).alias("a"), joined(F.transform(tx.asked_questions(t), tx.same_question)).alias("questions"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "a.visible", "a.rest", "questions")


def joined_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's items with a part of them and an empty one, joined without what is held twice."""
    items = F.col("items")
    return _lists(spark, sf_dir).select("o", tx.joined_parts(F.concat(F.transform(items, lambda i: F.substring(i, 1, 2)), F.array(F.lit(" ")), items)).alias("text"))


def billed_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that lines bill, from usage JSON of three kinds."""
    q, p = F.col("l_quantity").cast("int"), F.col("l_partkey")
    obj = lambda *kv: F.concat(F.lit("{"), *[x for i, (k, v) in enumerate(kv) for x in (F.lit(("," if i else "") + f'"{k}":'), v.cast("string"))], F.lit("}"))
    usage = F.when(p % 3 == 0, obj(("prompt_token_count", q), ("candidates_token_count", q * 2), ("thoughts_token_count", q))).when(p % 3 == 1, obj(("promptTokenCount", q), ("totalTokenCount", q * 5))).otherwise(obj(("thoughtsTokenCount", q)))
    rows = table(spark, sf_dir, "lineitem").select((p % 3).alias("kind"), tx.billed_tokens(usage).alias("t"))
    return rows.groupBy("kind").agg(F.sum("t.output").alias("output"), F.sum("t.prompt").alias("prompt"), F.count(F.lit(1)).alias("n"))


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report on parts with two sampled parts of each size class."""
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).alias("k"), (F.col("p_size") % 9).alias("depth"), (F.col("p_retailprice") > 1500).alias("dear"), "p_name")
    picked = sample.per_stratum(parts, ["k"], 2, 42, "p_partkey")
    return layouts.audit_report(parts, picked, "p_partkey", "k", "depth", ["dear"], ["p_name", "depth"], "Audit report")


QUERIES = {
    f.__name__: f
    for f in (task_names, aliased_problems, laid_out_problems, held_out_problems, result_sizes, written_trees, tree_questions, tree_summaries, checked_lines, shard_counts, split_actions, joined_notes, billed_usage, audit_lines)
}

_NAMES = """p AS (SELECT l_orderkey AS o, 'v' || (l_partkey % 60) AS name, l_partkey % 60 AS number, max(l_quantity) AS q FROM lineitem GROUP BY ALL),
  a AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY number) - 1 AS i FROM p), n AS (SELECT *, chr((65 + i % 26)::INT) || (i // 26 + 1) AS alias FROM a)"""
_TREES = """t AS (SELECT n_name AS tree, 'region ' || n_regionkey AS assessment, c_mktsegment AS s, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS b, count(*)::VARCHAR AS outcome
  FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)"""
_SAID = "[" + ", ".join("'" + s.replace("\n", "' || chr(10) || '") + "'" for s in SAID) + "]"

ORACLES = {
    "task_names": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL WHEN p_partkey % 3 = 0 AND p_size % 2 = 0 THEN 'ss_id' WHEN p_partkey % 3 = 0 THEN 'ss_marker' WHEN p_size % 2 = 0 THEN 'dyn_attr' ELSE 'dyn_marker' END AS task FROM part""",
    "aliased_problems": f"""WITH {_NAMES} SELECT o, string_agg(alias, ',' ORDER BY name) AS names, string_agg(alias || '=' || q::INT, ',' ORDER BY alias) AS values,
      arg_min(alias, name) || ' = (' || string_agg(alias, ' + ' ORDER BY name) || ') * 3' AS rule FROM n GROUP BY o""",
    "laid_out_problems": f"""WITH {_NAMES}, l AS (SELECT o, list(name ORDER BY name) AS leaves, list(name ORDER BY number) AS asked, sum(q)::BIGINT::VARCHAR AS answer FROM n GROUP BY o)
      SELECT o, to_json(leaves)::VARCHAR AS leaves, to_json(leaves[2:])::VARCHAR AS relevant, to_json(leaves[-1:])::VARCHAR AS held_out, to_json(asked)::VARCHAR AS possible_questions,
        to_json([v FOR v IN asked IF list_contains(leaves[2:], v) AND v <> leaves[-1]])::VARCHAR AS given_conditions, answer FROM l""",
    "held_out_problems": f"""WITH {_LISTS}, t AS (SELECT o, items, md5(array_to_string(items, ','))[:12] AS h FROM b), u AS (SELECT o, h, len(items) AS k, unnest(items) AS held_out, unnest(range(1, len(items) + 1)) AS r FROM t)
      SELECT o, h AS problem_id, h || '_k' || k || '_' || r AS sample_id, held_out FROM u""",
    "result_sizes": f"""WITH {_NAMES} SELECT o, CASE WHEN o % 3 < 2 THEN count(*) END AS num_constraints, CASE WHEN o % 3 = 1 THEN count(*) END AS num_vars, CASE WHEN o % 2 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS cost_usd, 0 AS thinking_tokens FROM n GROUP BY o""",
    "written_trees": """SELECT n_name AS tree, 'If segment:' || chr(10) || string_agg('  ' || s || ':' || chr(10) || '    Assessment: count' || chr(10) || '      -> ' || n, chr(10) ORDER BY s) AS text
      FROM (SELECT n_name, c_mktsegment AS s, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL) GROUP BY 1""",
    "tree_questions": f"""WITH {_TREES} SELECT tree, k::INT AS k, assessment, CASE WHEN k = 1 THEN 'segment=' || s ELSE '' END AS context, CASE WHEN k = 2 THEN 'segment=' || s || ',' ELSE '' END || 'balance of ' || s || '=' || b AS desired,
      CASE WHEN k = 2 THEN 'segment,' ELSE '' END || 'balance of ' || s AS questions, outcome FROM t, range(1, 3) r(k)""",
    "tree_summaries": f"""WITH {_TREES} SELECT tree, 2 + count(DISTINCT s) + count(*) AS n_nodes, count(*) AS n_decisions, string_agg(DISTINCT 'balance of ' || s, ',' ORDER BY 'balance of ' || s) || ',segment' AS conditions, max(assessment) AS category FROM t GROUP BY 1""",
    "checked_lines": """WITH r AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'unreadable' WHEN doc_id % 5 = 0 OR lang IS NULL THEN 'missing lang' ELSE 'good' END AS reason, length(text) AS n FROM documents)
      SELECT reason, count(*) AS rows, sum(CASE WHEN reason = 'good' THEN n END)::BIGINT AS n_chars FROM r GROUP BY 1""",
    "shard_counts": "SELECT o_orderpriority[1] AS shard, count(*) AS n, count(DISTINCT o_orderkey) AS n_keys FROM orders GROUP BY 1",
    "split_actions": rf"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % {len(SAID)} AS m, CASE WHEN l_linenumber % 2 = 0 THEN ' ' || l_linenumber ELSE '' END AS e, {_SAID} AS said FROM lineitem)
      SELECT l_orderkey, l_linenumber, l_partkey, CASE m WHEN 0 THEN 'Question: Is it red?' WHEN 1 THEN trim('Answer: 4 ' || e) WHEN 2 THEN '' WHEN 3 THEN 'Answer:' || chr(10) || 'no' || e ELSE 'Question: who asks, and why' || e END AS visible,
        CASE m WHEN 0 THEN 'So.' || chr(10) || chr(10) || 'more' || e WHEN 1 THEN 'Question: a? b' WHEN 2 THEN said[3] || e WHEN 3 THEN 'answer: yes' ELSE 'first' END AS rest,
        CASE m WHEN 0 THEN 'is it red' WHEN 1 THEN 'a' WHEN 4 THEN 'who asks, and why' || e ELSE '' END AS questions FROM r""",
    "joined_notes": f"WITH {_LISTS} SELECT o, array_to_string(items, chr(10) || chr(10)) AS text FROM b",
    "billed_usage": """SELECT l_partkey % 3 AS kind, sum(CASE l_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 1 END * l_quantity::INT)::BIGINT AS output, sum(CASE WHEN l_partkey % 3 < 2 THEN l_quantity::INT ELSE 0 END)::BIGINT AS prompt, count(*) AS n FROM lineitem GROUP BY 1""",
    "audit_lines": """WITH p AS (SELECT p_partkey, p_size % 4 AS k, p_size % 9 AS depth, p_retailprice > 1500 AS dear, p_name FROM part),
      s AS (SELECT *, CASE WHEN depth <= 3 THEN 'low' WHEN depth <= 6 THEN 'mid' ELSE 'high' END AS d FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY md5('42|' || p_partkey), p_partkey) <= 2),
      r AS (SELECT row_number() OVER (ORDER BY p_partkey) AS section, * FROM s)
      SELECT 0 AS section, 0 AS pos, '# Audit report' AS line UNION ALL SELECT 0, 1, '- Total rows: ' || count(*) FROM p UNION ALL SELECT 0, 2, '- Audited rows: ' || count(*) FROM s
      UNION ALL SELECT 0, 3, '- k distribution: ' || string_agg(k || '=' || n, ', ' ORDER BY k) FROM (SELECT k, count(*) AS n FROM s GROUP BY 1) UNION ALL SELECT 0, 4, '- depth buckets: ' || string_agg(d || '=' || n, ', ' ORDER BY d) FROM (SELECT d, count(*) AS n FROM s GROUP BY 1)
      UNION ALL SELECT 0, 5, '- dear=true: ' || count(*) FILTER (dear) || '/' || count(*) FROM s UNION ALL SELECT section, 0, '## Row ' || section || ': ' || p_partkey FROM r
      UNION ALL SELECT section, 1, '- p_name: ' || p_name FROM r UNION ALL SELECT section, 2, '- depth: ' || depth FROM r""",
}
