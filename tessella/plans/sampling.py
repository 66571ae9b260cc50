"""Queries that draw samples and fill quotas; the shuffle is an md5 order, which SQL repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts, sample
from .base import table

SEED = 42


def stratified_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 orders of each priority."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return sample.per_stratum(orders, ["o_orderpriority"], 30, SEED, "o_orderkey")


def sized_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A size for each stratum; a null size takes all."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    size = F.when(F.col("o_orderstatus") == "F", 200).when(F.col("o_orderstatus") == "O", 50)
    return sample.per_stratum(orders, ["o_orderstatus"], size, SEED, "o_orderkey")


def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.whole_table(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), 100, SEED, "c_custkey")


def sample_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers marked as a sample of 100 and its complement."""
    return sample.split_off(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), 100, SEED, "c_custkey")


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") % 3).alias("bucket"))
    return sample.round_robin(parts, ["p_brand", "bucket"], 120, SEED, "p_partkey")


def filled_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 5 good labels of each (brand, size class), the first of each type and price class only."""
    parts = table(spark, sf_dir, "part").withColumn("cell", F.col("p_size") % 4)
    passes = F.col("p_retailprice") > 950
    return sample.fill_quota(parts, ["p_brand", "p_type", "cell"], ["p_brand", "cell"], "p_partkey", passes, 5).select("p_partkey", "p_brand", "cell", "quota_rank")


def quota_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("cell", F.col("p_size") % 4)
    passes = F.col("p_retailprice") > 950
    kept = sample.fill_quota(parts, ["p_brand", "p_type", "cell"], ["p_brand", "cell"], "p_partkey", passes, 5)
    return sample.rejected_before_full(parts, kept, ["p_brand", "cell"], "p_partkey", F.when(~passes, F.lit("cheap")), 5)


def hardest_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest lines of each order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.desc("l_partkey"), F.desc("l_linenumber")]
    return sample.hardest(lines, ["l_orderkey"], order, 3)


def worlds_per_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two events of each (user, type) in hash order."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return sample.per_stratum(events, ["user_id", "event_type"], 2, SEED, "event_id")


def aligned_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of each order at an index drawn from the order's key."""
    pair = F.struct("l_partkey", "l_suppkey")
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(pair)).alias("p"))
    at = sample.one_index(F.size("p"), SEED, F.col("l_orderkey")).cast("int")
    picked = lists.withColumn("x", F.get("p", at))
    return picked.select("l_orderkey", "x.l_partkey", "x.l_suppkey")


def shuffled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("o"))
    return lists.select("o_custkey", F.array_join(F.transform(sample.shuffled(F.col("o"), SEED, F.col("o_custkey")), lambda x: x.cast("string")), ",").alias("items"))


def balanced_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their level in a balanced schedule of four."""
    return sample.balanced_schedule(table(spark, sf_dir, "customer").select("c_custkey"), 4, SEED, "c_custkey")


def curation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the first gate they fail, with means: the rejection counters and cell statistics of a curation run."""
    gates = {"price": F.col("p_retailprice") > 950, "size": F.col("p_size") >= 5, "type": ~F.col("p_type").startswith("PROMO")}
    gated = contracts.gate(table(spark, sf_dir, "part"), gates)
    return gated.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("n_brands"), F.round(F.avg(F.col("p_size").cast("double")), 6).alias("avg_size"))


QUERIES = {
    f.__name__: f
    for f in (stratified_orders, sized_strata, uniform_sample, sample_split, round_robin, filled_quotas, quota_rejections, hardest_sets, worlds_per_outcome, aligned_element, shuffled_items, balanced_levels, curation_gates)
}

_QUOTA = """p AS (SELECT *, p_size % 4 AS cell FROM part), u AS (SELECT * FROM p WHERE p_retailprice > 950 QUALIFY row_number() OVER (PARTITION BY p_brand, p_type, cell ORDER BY p_partkey) = 1),
  a AS (SELECT *, row_number() OVER (PARTITION BY p_brand, cell ORDER BY p_partkey) AS quota_rank FROM u QUALIFY quota_rank <= 5)"""
ORACLES = {
    "balanced_levels": "SELECT c_custkey, (row_number() OVER (ORDER BY md5('42|' || c_custkey), c_custkey) - 1) % 4 + 1 AS k FROM customer",
    "stratified_orders": "SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|' || o_orderkey), o_orderkey) <= 30",
    "sized_strata": "SELECT o_orderkey, o_orderstatus FROM orders QUALIFY o_orderstatus NOT IN ('F', 'O') OR row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey) <= CASE o_orderstatus WHEN 'F' THEN 200 ELSE 50 END",
    "sample_split": "SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY md5('42|' || c_custkey), c_custkey) <= 100 AS sampled FROM customer",
    "uniform_sample": "SELECT c_custkey, c_mktsegment FROM customer ORDER BY md5('42|' || c_custkey), c_custkey LIMIT 100",
    "round_robin": "WITH p AS (SELECT p_partkey, p_brand, p_size % 3 AS bucket FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, bucket ORDER BY md5('42|' || p_partkey), p_partkey) AS r FROM p) SELECT p_partkey, p_brand, bucket FROM (SELECT * FROM r ORDER BY r, p_brand, bucket LIMIT 120)",
    "filled_quotas": f"WITH {_QUOTA} SELECT p_partkey, p_brand, cell, quota_rank FROM a",
    "quota_rejections": f"WITH {_QUOTA}, f AS (SELECT p_brand, cell, max(p_partkey) AS l, count(*) AS n FROM a GROUP BY ALL) SELECT p.p_brand, p.cell, 'cheap' AS reason, count(*) AS n FROM p LEFT JOIN f USING (p_brand, cell) WHERE NOT p_retailprice > 950 AND (coalesce(f.n, 0) < 5 OR p_partkey < l) GROUP BY ALL",
    "hardest_sets": "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey DESC, l_linenumber DESC) AS rank FROM lineitem QUALIFY rank <= 3",
    "worlds_per_outcome": "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5('42|' || event_id), event_id) <= 2",
    "aligned_element": "WITH l AS (SELECT l_orderkey, list({'l_partkey': l_partkey, 'l_suppkey': l_suppkey} ORDER BY l_partkey, l_suppkey) AS p FROM lineitem GROUP BY 1), x AS (SELECT l_orderkey, p[1 + (('0x' || substr(md5('42|' || l_orderkey), 1, 8))::BIGINT % len(p))] AS x FROM l) SELECT l_orderkey, x.l_partkey AS l_partkey, x.l_suppkey AS l_suppkey FROM x",
    "shuffled_items": "SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY md5('42|' || o_custkey || '|' || o_orderkey), o_orderkey) AS items FROM orders GROUP BY 1",
    "curation_gates": "WITH g AS (SELECT *, CASE WHEN NOT p_retailprice > 950 THEN 'price' WHEN NOT p_size >= 5 THEN 'size' WHEN p_type LIKE 'PROMO%' THEN 'type' END AS reason FROM part) SELECT reason, count(*) AS n, count(DISTINCT p_brand) AS n_brands, round(avg(p_size), 6) AS avg_size FROM g GROUP BY 1",
}
