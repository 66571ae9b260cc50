"""Queries of the joins that need care. A set is the basket of an order; a group is a customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts, relate
from .base import table

CLASSES = 12


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_set(F.col("l_partkey") % CLASSES)).alias("items"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"))
    return orders.join(lines, "o")


_BASKETS = f"""b AS (SELECT o_custkey AS c, o_orderkey AS o, list_sort(list_distinct(list(l_partkey % {CLASSES}))) AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
  p AS (SELECT a.c, a.o AS small, g.o AS large, a.items AS ai, g.items AS gi FROM b a JOIN b g ON a.c = g.c AND a.o <> g.o AND len(a.items) < len(g.items) AND list_has_all(g.items, a.items))"""


def contained_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.contained_sets(_baskets(spark, sf_dir), ["c"], "o", "items")


def minimal_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.minimal_sets(_baskets(spark, sf_dir), ["c"], "o", "items").select("c", "o")


def union_of_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    baskets = _baskets(spark, sf_dir)
    out = relate.union_of_contained(baskets, ["c"], "o", "items", "items")
    return out.select("c", "o", F.array_join(F.transform("union", lambda x: x.cast("string")), ",").alias("union"))


def differ_on_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of even and odd key of a customer whose baskets differ in exactly one class."""
    baskets = _baskets(spark, sf_dir)
    return relate.differ_on_one(baskets.filter("o % 2 = 0"), baskets.filter("o % 2 = 1"), ["c"], "o", "items")


def foreign_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_custkey") % 40).alias("label"))
    return relate.labels_of_others(labels, "c_nationkey", "label")


def price_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price of each part type's first matching prefix: the types' first three and five letters, in alphabetical order."""
    parts = table(spark, sf_dir, "part")
    prefix = lambda n: F.substring("p_type", 1, n).alias("prefix")
    prices = parts.filter("p_type < 'M'").select(prefix(3), "p_size").unionByName(parts.filter("p_type > 'N'").select(prefix(5), "p_size"))
    prices = prices.groupBy("prefix").agg(F.max("p_size").cast("double").alias("price")).withColumn("pos", F.col("prefix"))
    return relate.prefix_lookup(parts.select("p_partkey", "p_type"), "p_type", prices, "prefix", "pos", "price", F.lit(0.0)).select("p_partkey", "p_type", "price")


def first_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first market segment, in alphabetical order, that has a customer of the supplier's nation."""
    pools = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("pool"), F.col("c_mktsegment").alias("pool_pos"), F.col("c_nationkey").alias("n"))
    items = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"))
    return relate.first_pool(items, "n", pools, "pool", "pool_pos", "n", "none").select("s_suppkey", "pool")


def filled_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    counts = orders.filter("o_totalprice > 300000").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return relate.filled_grid(orders.select("o_orderpriority"), orders.select("o_orderstatus"), counts, ["o_orderpriority", "o_orderstatus"], "n")


def set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that only returned or only kept lines have."""
    lines = table(spark, sf_dir, "lineitem")
    a, b = (lines.filter(F.col("l_returnflag") == f).select("l_partkey", "l_suppkey") for f in ("R", "A"))
    return relate.differences(a, b, ["l_partkey", "l_suppkey"])


def unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with text that have no label: requests without an answer, each text asked once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    labels = table(spark, sf_dir, "labels").join(docs, "doc_id").select("key")
    return relate.unanswered(docs.select("key"), labels, "key")


def orphan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    return relate.orphans(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


def setting_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers of equal number whose nations differ, as two versions of a manifest."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_nationkey").alias("value"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.col("c_nationkey").alias("value"))
    return relate.setting_changes(a, b, "name", "value")


def first_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each distinct text, with the text's short id."""
    docs = table(spark, sf_dir, "documents").select(F.substring(F.md5("text"), 1, 12).alias("id"), "doc_id", "lang")
    return relate.keep_first(docs, ["id"], "doc_id")


def zipped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("a"), F.array_sort(F.collect_list("l_suppkey")).alias("b"))
    return relate.zip_positions(lists, "a", "b")


def key_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.key_problems(table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey")


FIELDS = {"orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "documents": "doc_id text lang source n_chars", "labels": "doc_id quality toxic"}


def field_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of three tables, with the rows and nulls of each."""
    return contracts.field_inventory({t: table(spark, sf_dir, t) for t in FIELDS}).select("table", "pos", "field", "n_rows", "n_nulls")


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.file_inventory(spark, f"{sf_dir}/benchmark.parquet").select("bytes", "sha256")


def required_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that lack one of two required properties in their url."""
    pages = table(spark, sf_dir, "pages")
    found = pages.select(F.col("page_id").alias("object"), F.explode(F.create_map(F.lit("scheme"), F.regexp_extract("url", "^(https)://", 1), F.lit("query"), F.regexp_extract("url", r"\?(.+)$", 1))).alias("property", "value"))
    required = pages.select(F.col("page_id").alias("object"), F.explode(F.array(F.lit("scheme"), F.lit("query"))).alias("property"))
    return contracts.missing_properties(found, required, ["object", "property"])


QUERIES = {
    f.__name__: f
    for f in (
        contained_sets, minimal_baskets, union_of_contained, differ_on_one, foreign_labels, price_lookup, first_pool, filled_grid, set_differences, unanswered, orphan_labels,
        setting_changes, first_texts, zipped_lists, key_problems, field_inventory, file_inventory, required_values,
    )
}

ORACLES = {
    "field_inventory": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", {i} AS pos, '{f}' AS field, count(*) AS n_rows, count(*) - count({f}) AS n_nulls FROM {t}" for t, fs in FIELDS.items() for i, f in enumerate(fs.split())),
    "contained_sets": f"WITH {_BASKETS} SELECT c, small, large FROM p",
    "minimal_baskets": f"WITH {_BASKETS} SELECT c, o FROM b ANTI JOIN (SELECT DISTINCT c, large AS o FROM p) USING (c, o)",
    "union_of_contained": f"WITH {_BASKETS} SELECT c, large AS o, array_to_string(list_sort(list_distinct(flatten(list(ai)))), ',') AS union FROM p GROUP BY ALL",
    "differ_on_one": f"WITH {_BASKETS}, d AS (SELECT a.c, a.o AS a, g.o AS b, [x FOR x IN a.items IF NOT list_contains(g.items, x)] AS da, [x FOR x IN g.items IF NOT list_contains(a.items, x)] AS db FROM b a JOIN b g ON a.c = g.c AND a.o % 2 = 0 AND g.o % 2 = 1) SELECT c, a, b, da[1] AS dropped_a, db[1] AS dropped_b FROM d WHERE len(da) = 1 AND len(db) = 1",
    "foreign_labels": "WITH l AS (SELECT DISTINCT c_nationkey, c_custkey % 40 AS label FROM customer) SELECT * FROM (SELECT DISTINCT c_nationkey FROM l), (SELECT DISTINCT label FROM l) EXCEPT SELECT * FROM l",
    "price_lookup": "WITH q AS (SELECT prefix, max(p_size)::DOUBLE AS price FROM (SELECT substr(p_type, 1, 3) AS prefix, p_size FROM part WHERE p_type < 'M' UNION ALL SELECT substr(p_type, 1, 5), p_size FROM part WHERE p_type > 'N') GROUP BY 1) SELECT p_partkey, p_type, coalesce((SELECT arg_min(price, prefix) FROM q WHERE starts_with(p_type, prefix)), 0) AS price FROM part",
    "first_pool": "SELECT s_suppkey, coalesce((SELECT min(c_mktsegment) FROM customer WHERE c_nationkey = s_nationkey), 'none') AS pool FROM supplier",
    "filled_grid": "SELECT o_orderpriority, o_orderstatus, coalesce(n, 0) AS n FROM (SELECT DISTINCT o_orderpriority FROM orders) CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders) LEFT JOIN (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY ALL) USING (o_orderpriority, o_orderstatus)",
    "set_differences": "WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A') SELECT *, 'extra' AS status FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'missing' FROM (FROM b EXCEPT FROM a)",
    "unanswered": "WITH d AS (SELECT doc_id, sha256(text) AS key FROM documents) SELECT DISTINCT key FROM d EXCEPT SELECT key FROM d JOIN labels USING (doc_id)",
    "orphan_labels": "SELECT c_custkey AS k, c_nationkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey",
    "setting_changes": "SELECT coalesce(s_suppkey, c_custkey) AS name, s_nationkey AS current, c_nationkey AS stored FROM supplier FULL JOIN customer ON s_suppkey = c_custkey WHERE s_nationkey IS DISTINCT FROM c_nationkey",
    "first_texts": "SELECT substr(md5(text), 1, 12) AS id, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY 1",
    "zipped_lists": "SELECT a.l_orderkey, a.pos, a.a, b.b FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS pos, l_partkey AS a FROM lineitem) a JOIN (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) - 1 AS pos, l_suppkey AS b FROM lineitem) b USING (l_orderkey, pos)",
    "key_problems": "SELECT l_orderkey, count(*) AS n, 'duplicate' AS problem FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "required_values": "SELECT page_id AS object, 'scheme' AS property FROM pages WHERE NOT starts_with(url, 'https://') UNION ALL SELECT page_id, 'query' FROM pages WHERE NOT regexp_matches(url, '\\?.+$')",
}
