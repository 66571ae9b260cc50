import itertools
import random

from pyspark.sql import functions as F

from tessella.operators import curate, fixpoint, logic


def models(clauses, facts, names):
    out = []
    for bits in itertools.product([False, True], repeat=len(names)):
        v = dict(zip(names, bits, strict=True))
        if all(v[n] == x for n, x in facts.items()) and all(any(v[x.removeprefix("not ")] != x.startswith("not ") for x in c) for c in clauses):
            out.append(v)
    return out


def test_sufficiency_against_all_models(spark):
    rng = random.Random(5)
    names = list("abcdg")
    problems = {}
    for p in range(6):
        clauses = []
        for _ in range(6):
            body = rng.sample(names[:4], rng.randint(1, 2))
            head = rng.choice([n for n in names if n not in body])
            clauses.append([head, *[f"not {b}" for b in body]])
        clauses.append(["not a", "not g"] if p % 2 else ["g", "not a"])
        problems[f"p{p}"] = clauses
    rows = [(p, i, c) for p, cs in problems.items() for i, c in enumerate(cs)]
    lits = fixpoint.literals(spark.createDataFrame(rows, "problem_id string, clause_id int, clause array<string>"))
    facts = spark.createDataFrame([(p, "d", True) for p in problems], "problem_id string, var string, val boolean")
    goals = spark.createDataFrame([(p, "g") for p in problems], "problem_id string, goal string")
    variables = spark.createDataFrame([(p, v) for p in problems for v in "abc"], "problem_id string, var string")
    tables = logic.truth_tables(lits, facts, goals, logic.combinations(variables, 2))
    got = {(r.problem_id, tuple(r.vars)): r.is_sufficient for r in logic.is_sufficient(tables).collect()}
    flips = {(r.problem_id, tuple(r.vars)): r.is_essential for r in logic.essential(tables).collect()}
    assert len(got) == 18
    for p, cs in problems.items():
        for pair in itertools.combinations("abc", 2):
            values = {}
            for bits in itertools.product([False, True], repeat=2):
                seen = {m["g"] for m in models(cs, {"d": True, **dict(zip(pair, bits, strict=True))}, names)}
                if seen:
                    values[bits] = seen
            assert got[p, pair] == (bool(values) and all(len(s) == 1 for s in values.values()))
            fixed = {b: next(iter(s)) for b, s in values.items() if len(s) == 1}
            need = [any(b[:i] + (not b[i],) + b[i + 1 :] in fixed and fixed[b] != fixed[b[:i] + (not b[i],) + b[i + 1 :]] for b in fixed) for i in range(2)]
            assert flips[p, pair] == all(need)
    minimal = logic.sufficient_sets(lits, facts, goals, variables, 1).collect()
    assert all(len(r.vars) == 1 for r in minimal)


def test_held_out_sets(spark):
    rules = spark.createDataFrame([(1, "P", ["B", "F"]), (1, "T", ["B", "P"])], "problem_id int, output string, inputs array<string>")
    leaves = spark.createDataFrame([(1, x) for x in "ABF"], "problem_id int, node string")
    goals = spark.createDataFrame([(1, "T")], "problem_id int, goal string")
    sets = spark.createDataFrame([(1, ["B", "F"]), (1, ["A"]), (1, ["F"]), (1, ["A", "B"])], "problem_id int, vars array<string>")
    got = {tuple(r.vars): r.is_minimal for r in logic.held_out_sets(rules, leaves, goals, sets).collect()}
    assert got == {("B", "F"): True, ("A",): False, ("F",): True, ("A", "B"): False}


def test_curation_columns(spark):
    df = spark.createDataFrame([(1, [["a", "not b"]], ["x"], ["y"], ["c1", "c2", "c3"])], "i int, rules array<array<string>>, t array<string>, f array<string>, c array<string>")
    flipped = curate.flip_problem(df, ["rules"], "t", "f").first()
    assert (flipped.rules, flipped.t, flipped.f) == ([["not a", "b"]], ["y"], ["x"])
    assert [(r.k, r.context, r.desired) for r in curate.mask_last(df, "c", 2).orderBy("k").collect()] == [(1, ["c1", "c2"], ["c3"]), (2, ["c1"], ["c2", "c3"])]
    one = lambda c: spark.range(1).select(c.alias("r")).first()["r"]
    assert [one(curate.depth_bucket(F.lit(x))) for x in (2, 5, 9, "x")] == ["low", "mid", "high", "unknown"]
    assert one(curate.truthy(F.lit(" Yes "))) and not one(curate.truthy(F.lit(None)))
    assert one(curate.numbered_labels(F.lit("1. yes\n2) no\n1. no\n9. yes\n3: hmm"), F.lit(3))) == {1: "yes", 2: "no"}
    assert one(curate.reasoning_tokens(F.lit('{"a": {"b": 0}, "c": 7}'), ["a.b", "c"])) == 7
    assert one(curate.clean_text(F.lit("a [x]  b\n\n\n\nc"))) == "a b\n\nc"
    limits = one(curate.episode_limits(F.lit("k"), F.lit(3), F.lit(9))), one(curate.episode_limits(F.lit("0"), F.lit(3), F.lit(9)))
    assert [(x.turns, x.questions) for x in limits] == [(3, 1), (1, 9)]
    picked = one(curate.choices(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")), "none", 1, F.lit(5)))
    assert picked.options[-1] == "none" and [picked.options[i] for i in picked.truth] == ["b"]
    text = one(curate.problem_text(F.create_map(F.lit("B"), F.lit("bees"), F.lit("A"), F.lit("ants")), F.create_map(F.lit("A"), F.lit(15.0), F.lit("B"), F.lit(2.0)), F.create_map(F.lit("T"), F.lit("A + B")), F.lit("T"), F.array(F.lit("B"))))
    assert text == "Variables:\nA = 15: ants\nB: bees\nEquations:\nT = A + B\nGoal: What is T?"
    assert one(curate.missing_count(F.lit("x"), F.lit("4"))) == 4
