"""Joins, draws and tables that must hold with hot groups, against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import relate, sample
from tessella.streaming import jobs


def _random_sets(n, seed):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2]), i, rng.sample("abcdefg", rng.randint(0, 5)), [rng.choice([None, "x", "y", "z"]) for _ in range(rng.randint(0, 2))]) for i in range(n)]


def _inside(a, b):
    return a[0] == b[0] and a[2] and set(a[2]) < set(b[2])


SCHEMA = "g int, k int, s array<string>, c array<string>"


@pytest.mark.parametrize("seed", range(3))
def test_containment_equals_all_pairs(spark, seed):
    rows = _random_sets(60, seed)
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = {(a[1], b[1]) for a, b in itertools.permutations(rows, 2) if _inside(a, b)}
    assert {(r.small, r.large) for r in relate.contained_sets(df, ["g"], "k", "s").collect()} == pairs
    loose = {(a[1], b[1]) for a, b in itertools.permutations(rows, 2) if a[0] == b[0] and a[2] and set(a[2]) <= set(b[2])}
    assert {(r.small, r.large) for r in relate.contained_sets(df, ["g"], "k", "s", proper=False).collect()} == loose
    assert sorted(r.k for r in relate.minimal_sets(df, ["g"], "k", "s").collect()) == sorted(r[1] for r in rows if r[1] not in {b for _, b in pairs})
    held = {}
    for a, b in itertools.permutations(rows, 2):
        if _inside(a, b):
            held.setdefault(b[1], set()).update(a[3])
    order = lambda xs: sorted(xs, key=lambda x: (x is None, x))
    assert {r.k: r.union for r in relate.union_of_contained(df, ["g"], "k", "s", "c").collect()} == {k: order(v) for k, v in held.items()}


def test_minimal_sets_of_a_hot_group_emit_no_pairs(spark):
    """2,000 copies of a small set inside 2,000 large ones: four million pairs, of which none is made."""
    df = spark.range(4000).select(F.lit(1).alias("g"), F.col("id").alias("k"), F.when(F.col("id") < 2000, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.col("id").cast("int"))).alias("s"))
    assert relate.minimal_sets(df, ["g"], "k", "s").filter("k >= 2000").count() == 0
    held = relate._holders(relate._sets(df, ["g"], ["k"], "s"), ["g"], ["k"])
    assert held.count() == 2000 and "LeftSemi" in held._jdf.queryExecution().executedPlan().toString()


def test_null_groups_empty_tables_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, 1, ["a"], []), (None, 2, ["a", "b"], []), (1, 3, None, []), (1, 4, ["a"], ["x"]), (1, 4, ["a"], ["x"]), (1, 5, ["a", "b"], None)], SCHEMA)
    assert sorted(r.k for r in relate.minimal_sets(df, ["g"], "k", "s").collect()) == [1, 2, 3, 4, 4]
    assert [(r.k, r.union) for r in relate.union_of_contained(df, ["g"], "k", "s", "c").collect()] == [(5, ["x"])]
    none = df.limit(0)
    assert relate.contained_sets(none, ["g"], "k", "s").count() == relate.union_of_contained(none, ["g"], "k", "s", "c").count() == 0


def test_drawn_labels_equal_the_first_of_the_complement(spark):
    rng = random.Random(5)
    rows = [(o, f"l{x}") for o in range(8) for x in rng.sample(range(30), rng.choice([0, 1, 5, 28, 30]))] + [(None, "l1"), (3, None), (1, "l2"), (1, "l2")]
    df = spark.createDataFrame(rows, "o int, label string")
    grid = relate.labels_of_others(df.dropna(), "o", "label")
    want = {(r.o, r.label) for r in sample.per_stratum(grid, ["o"], 4, 9, "label").collect()}
    got = relate.drawn_labels_of_others(df, "o", "label", 4, 9)
    assert sorted((r.o, r.label) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_sized_strata_with_a_hot_and_a_null_stratum(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 6 == 0, F.lit("all")).when(F.col("id") % 9 == 3, F.lit("few")).alias("g"), F.lit(1).alias("_x"))
    size = F.when(F.col("g") == "hot", 5000).when(F.col("g") == "few", 7).when(F.col("g").isNull(), 11)
    rows = df.select("*", size.alias("n"), sample.draw(3, F.col("id")).alias("d")).collect()
    want = set()
    for g in ("hot", "all", "few", None):
        own = sorted((r for r in rows if r.g == g), key=lambda r: (r.d, r.id))
        want |= {r.id for r in (own if g == "all" else own[: own[0].n])}
    got = sample.per_stratum(df, ["g"], size, 3, "id")
    assert got.columns == df.columns
    assert sorted(r.id for r in got.collect()) == sorted(want)
    # of the 20,000 rows of the hot stratum no bucket, and so no task, sorts more than 40
    buckets = df.filter("g = 'hot'").select(sample.draw(3, F.col("id")).alias("d")).groupBy(sample._bucket("d")).count()
    assert buckets.agg(F.max("count")).first()[0] <= 40
    assert sample.per_stratum(df.limit(0), ["g"], size, 3, "id").count() == 0


def test_exact_strata(spark):
    df = spark.range(40).withColumn("g", F.col("id") % 3)
    same = lambda d: sorted(r.id for r in d.collect())
    assert same(sample.per_stratum(df, ["g"], 13, 1, "id", exact=True)) == same(sample.per_stratum(df, ["g"], 13, 1, "id"))
    with pytest.raises(Exception, match="stratum too small"):
        sample.per_stratum(df, ["g"], 14, 1, "id", exact=True).collect()


def _feed(spark, folder, rows, name):
    spark.createDataFrame(rows, "k int, seq long, v string").coalesce(1).write.parquet(f"{folder}/{name}")


def test_latest_wins_rewrites_only_touched_buckets(spark, tmp_path):
    feed, table = str(tmp_path / "feed"), str(tmp_path / "table")

    def run():
        stream = spark.readStream.schema("k int, seq long, v string").option("recursiveFileLookup", "true").parquet(feed)
        query = jobs.latest_wins(stream, table, "k", "seq", str(tmp_path / "state"), buckets=16)
        query.awaitTermination()
        return {r.k: (r.seq, r.v) for r in jobs.read_latest(spark, table, query).collect()}

    _feed(spark, feed, [(k, 1, "a") for k in range(200)] + [(None, 1, "n"), (500, None, "z")], "one")
    first = run()
    assert first == {**{k: (1, "a") for k in range(200)}, None: (1, "n"), 500: (None, "z")}
    _feed(spark, feed, [(7, 5, "new"), (7, 4, "old"), (500, 2, "y"), (8, 0, "late")], "two")
    assert run() == {**first, 7: (5, "new"), 500: (2, "y")}
    wrote = [p for p in (tmp_path / "table" / "data").glob("v1-*/_bucket=*")]
    assert 1 <= len(wrote) <= 3
    assert run() == {**first, 7: (5, "new"), 500: (2, "y")}
    # the first batch's buckets that the second wrote anew are still named by the manifest before
    assert jobs.unused_files(spark, table).count() == 0
    _feed(spark, feed, [(7, 6, "newer")], "three")
    assert run()[7] == (6, "newer")
    unused = [r.path for r in jobs.unused_files(spark, table).collect()]
    assert unused and all("/v0-" in p for p in unused)


def test_a_batch_that_runs_again_and_a_half_written_one(spark, tmp_path):
    feed, table = str(tmp_path / "feed"), str(tmp_path / "table")
    _feed(spark, feed, [(1, 1, "a"), (2, 1, "b")], "one")

    def run(state):
        stream = spark.readStream.schema("k int, seq long, v string").option("recursiveFileLookup", "true").parquet(feed)
        query = jobs.latest_wins(stream, table, "k", "seq", str(tmp_path / state), buckets=4)
        query.awaitTermination()
        return {r.k: r.v for r in jobs.read_latest(spark, table, query).collect()}

    assert run("state") == {1: "a", 2: "b"}
    # the same first batch again, as after a lost commit
    assert run("again") == {1: "a", 2: "b"}
    # data of a later batch without its manifest isn't read
    half = spark.createDataFrame([(1, 9, "half", 0)], "k int, seq long, v string, _bucket int")
    half.write.partitionBy("_bucket").parquet(f"{table}/data/v1-half")
    assert run("state") == {1: "a", 2: "b"}
    with pytest.raises(ValueError):
        jobs.read_latest(spark, str(tmp_path / "nothing"), None)
