from pyspark.sql import functions as F

from tessella.operators import relate


def unions(spark):
    rows = [("a", 1, [1], [7, None]), ("a", 2, [1, 2], [8]), ("a", 3, [1, 2, 3], None), ("a", 4, [2, 1], [9]), ("a", 5, [], [5]), ("a", 6, [4, 5], [1]), ("a", 7, [4, 5, 6], []),
            ("b", 1, [None], [3]), ("b", 2, [None, 1], [4]), ("b", 3, [None, 1, 2], [4]), (None, 1, [1], [1]), (None, 2, [1, 2], [1])]
    sets = spark.createDataFrame(rows, "g string, k int, items array<int>, carried array<int>")
    return sorted((tuple(r) for r in relate.union_of_contained(sets, ["g"], "k", "items", "carried").collect()), key=repr)


def test_unions_in_rows_and_by_joins_agree(spark, monkeypatch):
    rows = unions(spark)
    assert rows == [("a", 2, [7, None]), ("a", 3, [7, 8, 9, None]), ("a", 4, [7, None]), ("a", 7, [1]), ("b", 3, [4])]
    monkeypatch.setattr(relate, "ROW_SETS", 0)
    assert unions(spark) == rows
    monkeypatch.setattr(relate, "ROW_SETS", 4)
    assert unions(spark) == rows


def test_small_groups_are_shuffled_as_sets_only(spark, monkeypatch):
    sets = spark.range(40).select((F.col("id") % 4).alias("g"), F.col("id").alias("k"), F.sequence(F.lit(0), F.col("id")).alias("items"))
    plan = relate.union_of_contained(sets, ["g"], "k", "items", "items")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0


def test_differences_take_one_aggregation(spark):
    a, b = (spark.createDataFrame(r, "k int, v int") for r in ([(1, 1), (1, 1), (2, None), (3, 3)], [(3, 3), (4, None), (4, None)]))
    out = relate.differences(a, b, ["k", "v"])
    assert sorted(map(tuple, out.collect()), key=repr) == [(1, 1, "extra"), (2, None, "extra"), (4, None, "missing")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
