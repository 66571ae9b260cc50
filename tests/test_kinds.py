"""Customers with equal problems: each kind is solved once, and every customer gets its rows under its own names."""

import random
from datetime import datetime

import duckdb
import pytest

from tessella.operators import fixpoint, growth
from tessella.plans import registry

from .oracle import assert_same

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def orders(spark, path, copies):
    """Orders of 60 customers, repeated with other keys; some have no customer, some no priority."""
    rng, rows = random.Random(6), []
    for n in range(900):
        c = rng.randrange(60)
        few = PRIORITIES if c % 3 else PRIORITIES[:3]
        rows.append((n, None if c == 59 else c, rng.choice([100_000.0, 150_000.0, 200_000.0, 200_000.0]), rng.choice([*few, None]) if c % 10 == 7 else rng.choice(few)))
    rows = [(n + 1000 * i, None if c is None else c + 100 * i, "O", x, datetime(2000, 1, 1), p) for i in range(copies) for n, c, x, p in rows]
    kinds = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{path}/orders.parquet")
    return str(path)


@pytest.mark.parametrize("name, bound", [("grown_sets", 200_000), ("problem_rows", 200_000), ("problem_rows", 0)])
def test_rows_are_those_of_the_sql(spark, tmp_path, monkeypatch, name, bound):
    monkeypatch.setattr(fixpoint, "BROADCAST_ROWS", bound)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{orders(spark, tmp_path, 2)}/orders.parquet/*.parquet')")
    assert_same(spark, con, str(tmp_path), registry.QUERIES[name], registry.ORACLES[name])


def test_more_customers_of_a_kind_make_no_more_problems(spark, tmp_path, monkeypatch):
    class Seen(Exception):
        pass

    def level_one(*given):
        raise Seen(given[3].select("problem_id").distinct().count(), given[3].count())

    monkeypatch.setattr(growth, "grown_sets", level_one)
    sizes = []
    for copies in (1, 4):
        for name in ("grown_sets", "problem_rows"):
            with pytest.raises(Seen) as seen:
                registry.QUERIES[name](spark, orders(spark, tmp_path / f"{name}{copies}", copies))
            sizes.append(seen.value.args)
    assert len(set(sizes)) == 1 and sizes[0][0] > 5
