"""Queries that shape, check and store problems."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import curate, metrics, minset, relate, sample
from ..sources import io
from ..sources.storage import checkpoint_dir
from .base import table
from .search import BITS, _variables, _worlds, _WORLDS

CLASSES = 12


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o, items): item names of each order, in order, each once."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.format_string("I%02d", F.col("l_partkey") % CLASSES).alias("i"))
    return lines.groupBy("o").agg(F.array_sort(F.collect_set("i")).alias("items"))


_LISTS = f"b AS (SELECT l_orderkey AS o, list_sort(list_distinct(list('I' || lpad((l_partkey % {CLASSES})::VARCHAR, 2, '0')))) AS items FROM lineitem GROUP BY 1)"


def masked_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curate.mask_last(_lists(spark, sf_dir), "items", 3)
    return rows.select("o", "k", F.array_join("context", ",").alias("context"), F.array_join("desired", ",").alias("desired"))


def flipped_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's rules with every literal negated, and its known true and false items exchanged."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", F.concat(F.lit("not x"), F.col("l_linenumber"))).otherwise(F.concat(F.lit("x"), F.col("l_linenumber"))).alias("lit"), "l_returnflag")
    rules = lines.groupBy("l_orderkey").agg(F.array(F.array_sort(F.collect_set("lit"))).alias("rules"), F.count_if(F.col("l_returnflag") == "A").alias("known_true"), F.count_if(F.col("l_returnflag") == "N").alias("known_false"))
    out = curate.flip_problem(rules, ["rules"], "known_true", "known_false")
    return out.select("l_orderkey", F.array_join(F.array_sort(F.flatten("rules")), ",").alias("rules"), "known_true", "known_false")


def problem_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth bucket, truthiness, limits and printed number of each part."""
    budget = F.when(F.col("p_partkey") % 3 == 0, "k").when(F.col("p_partkey") % 3 == 1, "0").otherwise("4")
    limits = curate.episode_limits(budget, F.col("p_size") % 5 + 1, F.col("p_size"))
    flag = F.when(F.col("p_size") % 2 == 0, " Yes ").otherwise("off")
    return table(spark, sf_dir, "part").select(
        "p_partkey", curate.depth_bucket(F.col("p_size") % 9).alias("bucket"), curate.truthy(flag).alias("flag"), limits["turns"].alias("turns"), limits["questions"].alias("questions"),
        tx.plain_number((F.col("p_size") / 2).cast("double")).alias("half"), tx.text_id(F.col("p_type")).alias("id"),
    )


def choice_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options in seeded order with `none` last, and the indices of the true ones."""
    lists = _lists(spark, sf_dir)
    truth = F.filter("items", lambda x: x < "I04")
    out = lists.select("o", curate.choices(F.col("items"), truth, "none", 42, F.col("o")).alias("c"))
    return out.select("o", F.array_join("c.options", ",").alias("options"), F.array_join(F.transform("c.truth", lambda x: x.cast("string")), ",").alias("truth"))


def asked_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_partkey") % CLASSES).alias("i"))
    out = curate.asked_status(lines, ["l_linenumber", "l_suppkey"], "l_orderkey", "i", F.col("i") < 8)
    return out.groupBy("l_orderkey", "status").agg(F.count(F.lit(1)).alias("n"))


def cell_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dear parts of each brand and size class, zero-filled, with means."""
    parts = table(spark, sf_dir, "part").withColumn("cell", F.col("p_size") % 4)
    stats = parts.filter("p_retailprice > 1500").groupBy("p_brand", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_type").alias("types"), F.round(F.avg("p_retailprice"), 4).alias("avg_price"))
    return relate.filled_grid(parts.select("p_brand"), parts.select("cell"), stats, ["p_brand", "cell"], "n")


def predicted_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of the sizes of predicted sets: distinct numbers named in a message, else its distinct words."""
    numbers = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([0-9]+)\b"), F.lit(1))))
    words = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z]+)"), F.lit(1))))
    sizes = table(spark, sf_dir, "conversations").select(F.when(numbers > 0, numbers).otherwise(words).alias("n"))
    return sizes.agg(F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"), F.min("n").alias("min"), F.max("n").alias("max"), F.count("n").alias("count"))


def first_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's first line of flag R as its answer: the turn, and whether it was forced (the last line)."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag"))).alias("logs"))
    first = F.try_element_at(F.filter("logs", lambda t: t["l_returnflag"] == "R"), F.lit(1))
    return lines.select("l_orderkey", first["l_linenumber"].alias("turn"), (first["l_linenumber"] == F.try_element_at("logs", F.lit(-1))["l_linenumber"]).alias("forced"))


def difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: the least, over orders, of the largest quantity and the last number of a line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("difficulty"), F.col("l_linenumber").alias("depth"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return metrics.least_hard(orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")), ["o_custkey"], "o_orderkey", ["difficulty", "depth"])


def flipped_worlds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a world, whose lines are variables that are true where one was returned, with all values and the target negated."""
    values = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_returnflag") == "R").alias("v"))
    entry = F.struct(F.concat(F.lit("x"), "l_linenumber").alias("k"), "v")
    target = F.when(F.count_if("v") > 1, "goal").otherwise("not goal")
    worlds = values.groupBy("l_orderkey").agg(F.array(F.struct(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("assignments"), target.alias("target"))).alias("worlds"))
    flipped = worlds.select("l_orderkey", F.inline(curate.flip_worlds(F.col("worlds"))))
    said = F.array_join(F.transform(F.map_entries("assignments"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return flipped.select("l_orderkey", said.alias("assignments"), "target")


def shortest_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per basket: the smallest basket of the same customer inside it, and the one of the lowest priority's number; the first key wins a tie."""
    depth = F.substring("o_orderpriority", 1, 1).cast("int").alias("depth")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"), depth)
    sets = orders.join(_lists(spark, sf_dir), "o")
    pairs = relate.contained_sets(sets, ["c"], "o", "items").join(sets.select(F.col("o").alias("small"), F.size("items").alias("n"), "depth"), "small")
    return pairs.groupBy(F.col("large").alias("o")).agg(F.min_by("small", F.struct("n", "small")).alias("small"), F.min_by("small", F.struct("depth", "small")).alias("shallow"))


def generation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.agg(
        F.round(F.avg("p_size"), 3).alias("avg_size"), F.round(F.avg((F.col("p_size") > 25).cast("int")), 3).alias("share_large"),
        F.min("p_size").alias("min_size"), F.max("p_size").alias("max_size"), F.count(F.lit(1)).alias("n"),
    )


def stable_distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _worlds(spark, sf_dir).select(F.col("problem_id").alias("model"), F.col("y").alias("attractor_id"), "state")
    return minset.stable_distractors(states, BITS)


def explained_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest parts of each brand's largest state that fix its outcome."""
    worlds = _worlds(spark, sf_dir)
    row = worlds.groupBy("problem_id").agg(F.max(F.struct("state", "y")).alias("r")).select("problem_id", F.lit(0).alias("row_id"), F.col("r.state").alias("row_state"), F.col("r.y").alias("row_y"))
    return minset.explanations(worlds, row, _variables(worlds), BITS).select("problem_id", "k", "mask")


def identified_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    worlds = _worlds(spark, sf_dir)
    contexts = worlds.select("problem_id").distinct().select("problem_id", F.explode(F.array(*[F.lit(v).cast("long") for v in (0, 3, 9, 64)])).alias("value"), F.lit(75).cast("long").alias("mask"), F.lit(0).alias("expected"))
    return minset.identified(worlds, contexts.withColumn("context", F.col("value")))


def sampled_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of item names of each order: all, or ten drawn by hash where there are more."""
    lists = _lists(spark, sf_dir).filter(F.col("o").isNotNull())
    return lists.select(F.col("o").alias("problem_id"), F.explode(sample.drawn_pairs(F.col("items"), 10, 42)).alias("s"))


def policy_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two seeded choices among each order's items that an earlier line hasn't asked and that aren't banned."""
    lists = _lists(spark, sf_dir)
    free = curate.available(F.col("items"), F.slice("items", 1, 1), F.array(F.lit("I05")))
    return lists.select("o", F.array_join(F.slice(sample.shuffled(free, 42, F.col("o")), 1, 2), ",").alias("asked"))


def log_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an append-only log in two appends, of which the second names half of the keys again, compacted and read back."""
    place = f"{checkpoint_dir(spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").withColumn("key", F.col("user_id").cast("string"))
    io.append_log(events.groupBy("key").agg(F.max("event_id").cast("string").alias("result")), f"{place}/log")
    io.append_log(events.filter("user_id % 2 = 0").groupBy("key").agg(F.min("event_id").cast("string").alias("result")), f"{place}/log")
    io.compact_log(spark, f"{place}/log", f"{place}/compact")
    return io.read_log(spark, f"{place}/compact").select("key", "result")


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their items as JSON cells, written as CSV and read again with a declared schema."""
    place = f"{checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    io.write_json_cells_csv(_lists(spark, sf_dir), place)
    back = io.read_problem_csv(spark, place, "o long, items string")
    return back.select("o", F.array_join(tx.string_list(F.col("items")), ",").alias("items"))


def resume_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, from the least to the largest id, that have no label yet."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    first, last = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return io.remaining(docs, table(spark, sf_dir, "labels"), "doc_id", first or 0, last or 0)


QUERIES = {
    f.__name__: f
    for f in (
        masked_conditions, flipped_problems, problem_columns, choice_lists, asked_status, cell_statistics, predicted_sizes, first_answers, difficulty, flipped_worlds, shortest_contained, generation_summary,
        stable_distractors, explained_rows, identified_outcomes, sampled_subsets, policy_choices, log_compaction, csv_round_trip, resume_rows,
    )
}

ORACLES = {
    "masked_conditions": f"WITH {_LISTS} SELECT o, k::INT AS k, array_to_string(items[1:len(items) - k], ',') AS context, array_to_string(items[len(items) - k + 1:], ',') AS desired FROM b, range(1, 4) r(k) WHERE k <= len(items)",
    "flipped_problems": """WITH l AS (SELECT DISTINCT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'x' || l_linenumber ELSE 'not x' || l_linenumber END AS f FROM lineitem)
      SELECT l.l_orderkey, r AS rules, known_true, known_false FROM (SELECT l_orderkey, string_agg(f, ',' ORDER BY f) AS r FROM l GROUP BY 1) l JOIN (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS known_true, count(*) FILTER (l_returnflag = 'A') AS known_false FROM lineitem GROUP BY 1) c USING (l_orderkey)""",
    "problem_columns": """SELECT p_partkey, CASE WHEN p_size % 9 <= 3 THEN 'low' WHEN p_size % 9 <= 6 THEN 'mid' ELSE 'high' END AS bucket, p_size % 2 = 0 AS flag,
      CASE p_partkey % 3 WHEN 0 THEN p_size % 5 + 1 WHEN 1 THEN 1 ELSE 4 END AS turns, CASE WHEN p_partkey % 3 = 1 THEN greatest(1, p_size) ELSE 1 END AS questions,
      CASE WHEN p_size % 2 = 0 THEN (p_size // 2)::VARCHAR ELSE (p_size / 2)::VARCHAR END AS half, substr(md5(p_type), 1, 12) AS id FROM part""",
    "choice_lists": f"""WITH {_LISTS}, u AS (SELECT o, unnest(items) AS i FROM b), n AS (SELECT o, i, row_number() OVER (PARTITION BY o ORDER BY md5('42|' || o || '|' || i), i) - 1 AS p FROM u)
      SELECT o, string_agg(i, ',' ORDER BY p) || ',none' AS options, coalesce(string_agg(p, ',' ORDER BY p) FILTER (i < 'I04'), count(*)::VARCHAR) AS truth FROM n GROUP BY 1""",
    "asked_status": f"WITH s AS (SELECT l_orderkey, CASE WHEN row_number() OVER (PARTITION BY l_orderkey, l_partkey % {CLASSES} ORDER BY l_linenumber, l_suppkey) > 1 THEN 'duplicate' WHEN l_partkey % {CLASSES} < 8 THEN 'valid' ELSE 'invalid' END AS status FROM lineitem) SELECT l_orderkey, status, count(*) AS n FROM s GROUP BY ALL",
    "cell_statistics": "SELECT p_brand, cell, coalesce(n, 0) AS n, types, avg_price FROM (SELECT DISTINCT p_brand FROM part) CROSS JOIN (SELECT DISTINCT p_size % 4 AS cell FROM part) LEFT JOIN (SELECT p_brand, p_size % 4 AS cell, count(*) AS n, count(DISTINCT p_type) AS types, round(avg(p_retailprice), 4) AS avg_price FROM part WHERE p_retailprice > 1500 GROUP BY ALL) USING (p_brand, cell)",
    "predicted_sizes": r"""WITH s AS (SELECT len(list_distinct(regexp_extract_all(text, '\b([0-9]+)\b'))) AS a, len(list_distinct(regexp_extract_all(text, '([A-Za-z]+)'))) AS b FROM conversations), n AS (SELECT CASE WHEN a > 0 THEN a ELSE b END AS n FROM s)
      SELECT round(avg(n), 6) AS mean, median(n) AS median, min(n) AS min, max(n) AS max, count(n) AS count FROM n""",
    "first_answers": """WITH f AS (SELECT l_orderkey, min({'l': l_linenumber, 's': l_suppkey, 'p': l_partkey}) FILTER (l_returnflag = 'R').l AS turn, max({'l': l_linenumber, 's': l_suppkey, 'p': l_partkey, 'r': l_returnflag}).l AS last FROM lineitem GROUP BY 1) SELECT l_orderkey, turn, turn = last AS forced FROM f""",
    "flipped_worlds": """WITH v AS (SELECT l_orderkey, 'x' || l_linenumber AS k, bool_or(l_returnflag = 'R') AS v FROM lineitem GROUP BY ALL)
      SELECT l_orderkey, string_agg(k || '=' || (NOT v)::VARCHAR, ',' ORDER BY k) AS assignments, CASE WHEN count(*) FILTER (v) > 1 THEN 'not goal' ELSE 'goal' END AS target FROM v GROUP BY 1""",
    "difficulty": "SELECT o_custkey, min(q) AS difficulty, min(d) AS depth FROM orders JOIN (SELECT l_orderkey, max(l_quantity) AS q, max(l_linenumber) AS d FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1",
    "shortest_contained": f"WITH {_LISTS}, s AS (SELECT o_custkey AS c, o, items, o_orderpriority[1]::INT AS d FROM b JOIN orders ON o = o_orderkey) SELECT g.o, arg_min(a.o, {{'n': len(a.items), 'o': a.o}}) AS small, arg_min(a.o, {{'d': a.d, 'o': a.o}}) AS shallow FROM s a JOIN s g ON a.c = g.c AND len(a.items) < len(g.items) AND list_has_all(g.items, a.items) GROUP BY 1",
    "generation_summary": "SELECT round(avg(p_size), 3) AS avg_size, round(avg((p_size > 25)::INT), 3) AS share_large, min(p_size) AS min_size, max(p_size) AS max_size, count(*) AS n FROM part",
    "stable_distractors": f"WITH {_WORLDS}, x AS (SELECT problem_id AS model, y, i::INT AS idx, min((state >> i::INT) & 1) AS a, max((state >> i::INT) & 1) AS z FROM w, range(0, 6) r(i) GROUP BY ALL) SELECT model, idx FROM x GROUP BY ALL HAVING bool_and(a = z) AND min(a) < max(z)",
    "explained_rows": f"""WITH {_WORLDS}, t AS (SELECT problem_id, max({{'s': state, 'y': y}}) AS r FROM w GROUP BY 1), e AS (SELECT problem_id, mask, bool_and(y = r.y) AS ok FROM w JOIN t USING (problem_id), (SELECT unnest(range(0, 64))::BIGINT AS mask) WHERE state & mask = r.s & mask GROUP BY ALL)
      SELECT problem_id, bit_count(mask)::INT AS k, mask FROM e WHERE ok QUALIFY bit_count(mask) = min(bit_count(mask)) OVER (PARTITION BY problem_id)""",
    "identified_outcomes": f"""WITH {_WORLDS}, c AS (SELECT * FROM (SELECT DISTINCT problem_id FROM w), (SELECT unnest([0, 3, 9, 64])::BIGINT AS context)), s AS (SELECT c.problem_id, context, count(DISTINCT y) AS n, min(y) AS y FROM c LEFT JOIN w ON w.problem_id = c.problem_id AND state & 75 = context GROUP BY ALL)
      SELECT problem_id, context, CASE WHEN n = 0 THEN 'none' WHEN n > 1 THEN 'not unique' WHEN y <> 0 THEN 'other' ELSE 'ok' END AS verdict FROM s""",
    "sampled_subsets": f"WITH {_LISTS}, u AS (SELECT o, unnest(items) AS i FROM b), p AS (SELECT a.o AS problem_id, a.i || ',' || c.i AS s FROM u a JOIN u c ON a.o = c.o AND a.i < c.i) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY md5('42|' || s), s) <= 10",
    "policy_choices": f"WITH {_LISTS}, u AS (SELECT o, items, unnest(items) AS i FROM b), n AS (SELECT o, i, row_number() OVER (PARTITION BY o ORDER BY md5('42|' || o || '|' || i), i) AS p FROM u WHERE i <> items[1] AND i <> 'I05') SELECT b.o, coalesce(string_agg(i, ',' ORDER BY p), '') AS asked FROM b LEFT JOIN n ON n.o = b.o AND p <= 2 GROUP BY 1",
    "log_compaction": "SELECT user_id::VARCHAR AS key, CASE WHEN user_id % 2 = 0 THEN min(event_id) ELSE max(event_id) END::VARCHAR AS result FROM events GROUP BY user_id",
    "csv_round_trip": f"WITH {_LISTS} SELECT o, array_to_string(items, ',') AS items FROM b",
    "resume_rows": "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)",
}
