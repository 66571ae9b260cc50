"""Subsets of a problem's variables, and pairs drawn from them."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import logic, sample
from tessella.plans import curation

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("k", [0, 1, 2, 3, 4])
def test_combinations_equal_a_plain_loop(spark, k):
    rng = random.Random(3)
    names = {(p, q): {rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))} for p in range(5) for q in "xy"}
    rows = [(p, q, v) for (p, q), vs in names.items() for v in vs for _ in range(2)]
    got = logic.combinations(spark.createDataFrame(rows, "p int, q string, var string"), k, ["p", "q"])
    assert got.columns == ["p", "q", "vars"]
    assert sorted((r.p, r.q, tuple(r.vars)) for r in got.collect()) == sorted((*at, c) for at, vs in names.items() for c in itertools.combinations(sorted(vs), k))


def test_null_variables_and_problems(spark):
    rows = spark.createDataFrame([(1, None), (1, "b"), (1, "a"), (2, None), (None, "a"), (None, "b")], "problem_id int, var string")
    of = lambda k: sorted((str(r.problem_id), *map(str, r.vars)) for r in logic.combinations(rows, k).collect())
    assert of(0) == [("1",), ("2",), ("None",)]
    assert of(1) == [("1", "None"), ("1", "a"), ("1", "b"), ("2", "None")]
    assert of(2) == [("1", "a", "b")]


def test_combinations_join_nothing(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("problem_id"), F.col("id").cast("string").alias("var"))
    assert "Join" not in logic.combinations(rows, 3)._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_an_order_are_drawn_within_its_row(spark):
    plan = curation.sampled_subsets(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


@pytest.mark.parametrize("n", [1, 10, 1000])
def test_drawn_pairs_equal_a_plain_sort(spark, n):
    lists = [[], ["a"], ["b", None, "a", "b"], [f"I{i:02}" for i in range(20)], None]
    rows = spark.createDataFrame(list(enumerate(lists)), "id int, items array<string>")
    got = {r.id: r.pairs for r in rows.select("id", sample.drawn_pairs(F.col("items"), n, 42).alias("pairs")).collect()}
    for i, items in enumerate(lists):
        pairs = [",".join(c) for c in itertools.combinations(sorted({x for x in items or [] if x}), 2)]
        want = sorted(pairs, key=lambda s: (hashlib.md5(f"42|{s}".encode()).hexdigest(), s))[:n]
        assert got[i] == (None if items is None else want)
