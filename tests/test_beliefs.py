import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.operators import belief

SCHEMA = "e long, turn int, pos int, candidate string, label string, observed string"


def _rows(episodes=4, pool=30, turns=7, missing=0.05):
    rng = random.Random(7)
    rows = []
    for e in [None, *range(episodes)]:
        for t in range(1, turns + 1):
            observed = rng.choice(["yes", "no"])
            for c in range(pool):
                if rng.random() >= missing:
                    rows.append((e, t, c % 11, f"c{c}", rng.choice(["yes", "no", "pass", None]), observed))
    return rows


def _weight(label, observed):
    return math.log(0.98 if label == observed else 0.5 if label == "pass" else 0.02)


def _posteriors(rows):
    sums, out, by_turn = defaultdict(float), {}, defaultdict(list)
    for e, t, _, c, label, observed in sorted(rows, key=lambda r: r[1]):
        sums[e, c] += _weight(label, observed)
        by_turn[e, t].append((c, sums[e, c], sums[e, c] - _weight(label, observed), label, observed))
    for at, found in by_turn.items():
        after, before = [[x[i] for x in found] for i in (1, 2)]
        for c, a, b, label, observed in found:
            out[(*at, c)] = (math.exp(b - max(before)) / sum(math.exp(x - max(before)) for x in before), math.exp(a - max(after)) / sum(math.exp(x - max(after)) for x in after), label, observed)
    return out


def test_beliefs_and_values_equal_plain_sums(spark):
    rows = _rows()
    want = _posteriors(rows)
    judged = spark.createDataFrame(rows, SCHEMA)
    got = {(r.e, r.turn, r.candidate): (r.prior, r.posterior) for r in belief.beliefs(judged, ["e"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k][:2], rel=1e-9) for k in want)
    values = {(r.e, r.turn): r for r in belief.question_values(judged, ["e"]).collect()}
    assert values.keys() == {k[:2] for k in want}
    entropy = lambda ps: -sum(p * math.log(p + 1e-12) for p in ps)
    for at, r in values.items():
        here = [v for k, v in want.items() if k[:2] == at]
        labels = defaultdict(list)
        for p, _, label, _ in here:
            labels[label].append(p)
        left = sum(sum(ps) * -sum(p / sum(ps) * math.log(p / sum(ps)) for p in ps) for ps in labels.values())
        assert r.entropy_before == pytest.approx(entropy([v[0] for v in here]), abs=1e-9)
        assert r.entropy_after == pytest.approx(entropy([v[1] for v in here]), abs=1e-9)
        assert r.eig == pytest.approx(r.entropy_before - left, abs=1e-9)
        assert r.support == pytest.approx(sum(v[0] for v in here if v[2] == v[3]), abs=1e-12)
        assert r.pass_mass == pytest.approx(sum(v[0] for v in here if v[2] == "pass"), abs=1e-12)


def test_long_episodes_neither_underflow_nor_lose_the_sum(spark):
    rows = [(1, t, c, f"c{c}", "yes" if c else "no", "yes") for t in range(1, 601) for c in range(3)]
    last = {r.candidate: r for r in belief.beliefs(spark.createDataFrame(rows, SCHEMA), ["e"]).filter("turn = 600").collect()}
    assert last["c0"].posterior == 0.0 and last["c1"].posterior == last["c2"].posterior == pytest.approx(0.5)
    values = belief.question_values(spark.createDataFrame(rows, SCHEMA), ["e"]).filter("turn = 600").first()
    assert values.eig == pytest.approx(0.0, abs=1e-9) and values.entropy_after == pytest.approx(math.log(2), abs=1e-9)


def test_many_equal_candidates_are_few_cells(spark):
    rows = [(1, t, c, f"c{c}", "yes" if c % 2 else "no", "yes") for t in range(1, 5) for c in range(1000)]
    counted = belief._counted(spark.createDataFrame(rows, SCHEMA), ["e"], "turn", "candidate")
    assert belief._cells(counted, ["e"], "turn", ["label", "observed"]).count() == 4 * 2


@pytest.mark.parametrize("keep", [1, 5, 100])
def test_pruned_beliefs_equal_a_loop_over_turns(spark, keep):
    rows = _rows(turns=9)
    rows.append((9, 3, 0, "alone", "no", "yes"))
    want = {}
    for e in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == e]
        left = {(r[2], r[3]): (0, 0, 0) for r in mine}
        for t in sorted({r[1] for r in mine}):
            now = {}
            for _, turn, pos, c, label, observed in mine:
                if turn == t and (pos, c) in left:
                    m, p, n = left[pos, c]
                    now[pos, c] = (m + (label == observed), p + (label != observed and label == "pass"), n + 1)
            score = lambda x: x[0] * math.log(0.98) + x[1] * math.log(0.5) + (x[2] - x[0] - x[1]) * math.log(0.02)
            left = {k: now[k] for k in sorted(now, key=lambda k: (-score(now[k]), k))[:keep]}
            total = sum(math.exp(score(x)) for x in left.values())
            want |= {(e, t, c): math.exp(score(x)) / total for (_, c), x in left.items()}
    got = belief.pruned_beliefs(spark.createDataFrame(rows, SCHEMA), ["e"], keep)
    found = {(r.e, r.turn, r.candidate): r.posterior for r in got.collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    assert got.columns == ["e", "turn", "candidate", "pos", "posterior"]


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert belief.beliefs(empty, ["e"]).count() == belief.question_values(empty, ["e"]).count() == belief.pruned_beliefs(empty, ["e"], 3).count() == 0


@pytest.mark.parametrize("bound", [0, 200_000])
def test_equal_histories_are_judged_once(spark, monkeypatch, bound):
    monkeypatch.setattr(belief, "BROADCAST_ROWS", bound)
    asked = spark.createDataFrame([(t, c, f"c{c}", ["yes", "no", "pass"][(c + t) % 3]) for t in (1, 2) for c in range(6)], "turn int, pos int, candidate string, label string")
    told = [["yes", "no"], ["no", "no"], [None, "pass"]]
    rows = [(e, [(t, x) for t, x in enumerate(told[e % 3], 1)]) for e in range(30)] + [(30, []), (None, [(2, "yes")])]
    answered = spark.createDataFrame(rows, "e long, history array<struct<turn: int, observed: string>>")
    judged = answered.select("e", F.inline("history")).join(asked, "turn")
    seen = []

    def values(judged, by):
        seen.append(judged.count())
        return belief.question_values(judged, by)

    got = belief.by_history(answered, asked, values)
    assert seen == [(3 * 2 + 1) * 6]
    want = belief.question_values(judged, ["e"])
    plain = lambda df: sorted((str(r.e), r.turn, *(round(x, 9) for x in (r.entropy_before, r.entropy_after, r.eig, r.support, r.pass_mass))) for r in df.collect())
    assert plain(got) == plain(want) and got.count() == 61
    assert belief.by_history(answered.limit(0), asked, belief.question_values).count() == 0


def test_no_row_is_made_for_a_customer_and_a_candidate(spark, tmp_path):
    """Two tables of customers, the second six times the first: what is judged doesn't grow, and every customer has its rows."""
    from tessella.plans import beliefs

    base = "/root/testdata/sf0.001"
    (tmp_path / "nation.parquet").symlink_to(f"{base}/nation.parquet")
    customers = spark.range(1, 1 + 13 * 25 * 6).select(F.col("id").alias("c_custkey"), (F.col("id") / 13).cast("long").alias("c_nationkey") % 25)
    customers.toDF("c_custkey", "c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    judged = []

    def values(rows, by):
        judged.append(rows.count())
        return belief.question_values(rows, by)

    assert beliefs._by_history(spark, str(tmp_path), values).count() == 13 * 25 * 6 * 6
    assert judged[0] <= 13 * 25 * 6 * 25
