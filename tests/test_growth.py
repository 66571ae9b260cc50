import itertools
import random

from tessella.operators import fixpoint, growth

NAMES = list("abcdeg")


def models(clauses):
    worlds = (dict(zip(NAMES, bits, strict=True)) for bits in itertools.product([False, True], repeat=len(NAMES)))
    return [v for v in worlds if all(any(v[x.removeprefix("not ")] != x.startswith("not ") for x in c) for c in clauses)]


def patterns(worlds, context, names):
    out = {}
    for v in worlds:
        if all(v[x.removeprefix("not ")] != x.startswith("not ") for x in context):
            out.setdefault(tuple(v[n] for n in names), set()).add(v["g"])
    return out


def suffices(worlds, context, names):
    found = patterns(worlds, context, names)
    return bool(found) and all(len(x) == 1 for x in found.values())


def free(context):
    return [n for n in NAMES if n != "g" and n not in {x.removeprefix("not ") for x in context}]


def settled(worlds, context, k):
    return any(suffices(worlds, context, s) for s in itertools.combinations(free(context), k))


def negated(x):
    return x.removeprefix("not ") if x.startswith("not ") else f"not {x}"


def grown(worlds, first, max_k):
    levels = {1: set(first)}
    for k in range(2, max_k + 1):
        levels[k] = set()
        for context, names in levels[k - 1]:
            for x in context:
                rest = tuple(sorted(set(context) - {x}))
                held = any(set(c) <= set(rest) for c, _ in levels[k - 1])
                if not held and suffices(worlds, (*rest, negated(x)), names) and not settled(worlds, rest, k - 1):
                    levels[k].add((rest, tuple(sorted({*names, x.removeprefix("not ")}))))
    return levels


def valid(worlds, context, names):
    if {"g", *(x.removeprefix("not ") for x in context)} & set(names) or not suffices(worlds, context, names):
        return False
    found, n = patterns(worlds, context, names), len(names)
    flips = [any(p[:i] + (not p[i],) + p[i + 1 :] in found and found[p] != found[p[:i] + (not p[i],) + p[i + 1 :]] for p in found) for i in range(n)]
    return n == 1 or all(flips) and not settled(worlds, context, n - 1)


def test_grown_sets_and_problem_rows_against_all_models(spark):
    rng = random.Random(11)
    problems = {"chain": [["g", "not a", "not b"], ["not g", "a"], ["not g", "b"], ["b", "not c", "not d"], ["not b", "c"], ["not b", "d"]]}
    for p in range(4):
        a, b, c, d, e = rng.sample("abcde", 5)
        made = [["g", f"not {a}", f"not {b}"], ["not g", a], ["not g", b], [b, f"not {c}", f"not {d}"], [f"not {b}", c], [f"not {b}", d]]
        problems[f"p{p}"] = [*made, [d, f"not {e}"], *([[f"not {c}", f"not {e}"]] if p % 2 else [])]
    worlds = {p: models(cs) for p, cs in problems.items()}
    first = {}
    for p, ws in worlds.items():
        literals = [x for n in NAMES[:-1] for x in (n, f"not {n}")]
        contexts = [tuple(sorted(c)) for n in (1, 2, 3) for c in itertools.combinations(literals, n) if len({x.removeprefix("not ") for x in c}) == n]
        pairs = [(c, (v,)) for c in contexts for v in free(c) if suffices(ws, c, (v,)) and not suffices(ws, c, ())]
        first[p] = rng.sample(pairs, min(8, len(pairs)))
    first["chain"] = [(("a", "c"), ("d",)), (("a", "d"), ("c",))]
    lits = fixpoint.literals(spark.createDataFrame([(p, i, c) for p, cs in problems.items() for i, c in enumerate(cs)], "problem_id string, clause_id int, clause array<string>"))
    goals = spark.createDataFrame([(p, "g") for p in problems], "problem_id string, goal string")
    variables = spark.createDataFrame([(p, v) for p in problems for v in NAMES], "problem_id string, var string")
    level = spark.createDataFrame([(p, list(c), list(s)) for p, ps in first.items() for c, s in ps], "problem_id string, context array<string>, vars array<string>")
    sets, work = growth.grown_levels(lits, goals, variables, level, 3)
    spent = work.collect()
    assert spent and sum(r.n_closures for r in spent if r.k == 3) < sum(int(r.n_full) for r in spent if r.k == 3)
    got = {(r.problem_id, r.k, tuple(r.context), tuple(r.vars)) for r in sets.collect()}
    assert got == {(p, k, c, s) for p in problems for k, found in grown(worlds[p], first[p], 3).items() for c, s in found}
    assert {k for _, k, _, _ in got} >= {1, 2}

    extra = [(p, 2, ["a"], ["b", "c"]) for p in problems] + [("chain", 2, [], ["a", "b"]), ("chain", 1, ["a"], ["a"]), ("chain", 1, ["a"], ["g"])]
    more = sets.unionByName(spark.createDataFrame(extra, "problem_id string, k int, context array<string>, vars array<string>"))
    refused = sorted(x for x in got if x[0] == "chain")[0]
    invalid = spark.createDataFrame([(refused[0], refused[1], list(refused[2]), list(refused[3]))], more.schema)
    want = {}
    for p, k, c, s in {(x[0], x[1], tuple(x[2]), tuple(x[3])) for x in [*got, *extra]} - {refused}:
        if valid(worlds[p], c, s):
            want.setdefault((p, k, c), set()).add(s)
    rows = growth.problem_rows(lits, goals, variables, more, invalid).collect()
    assert {(r.problem_id, r.k, tuple(r.context)): {tuple(s) for s in r.sets} for r in rows} == want
    for r in rows:
        assert r.valid_vars == free(r.context) and r.invalid_vars == sorted(set(NAMES) - set(free(r.context)))
        assert sorted(r.known_true + [f"not {x}" for x in r.known_false]) == r.context


def test_contradictory_sets_against_all_models(spark):
    rng = random.Random(3)
    problems, sets = {}, []
    for p in range(5):
        problems[p] = [[rng.choice(["not ", ""]) + x if i == 0 else f"not {x}" for i, x in enumerate(rng.sample(NAMES, rng.randint(1, 3)))] for _ in range(7)]
        sets += [(p, i, [rng.choice(["", "not "]) + x for x in rng.choices(NAMES, k=rng.randint(0, 4))]) for i in range(30)]
    problems[5], sets = [["a"], []], [*sets, (5, 0, ["b"])]
    lits = fixpoint.literals(spark.createDataFrame([(p, i, c) for p, cs in problems.items() for i, c in enumerate(cs)], "problem_id int, clause_id int, clause array<string>"))
    df = spark.createDataFrame(sets, "problem_id int, i int, items array<string>")
    got = {(r.problem_id, r.i): r.reason for r in fixpoint.contradictory_sets(lits, df, "i", "items").collect()}
    want = {}
    for p, i, items in sets:
        if not any(all(v[x.removeprefix("not ")] != x.startswith("not ") for x in items) for v in models(problems[p])):
            want[p, i] = "both signs" if {x for x in items if negated(x) in items} else "inferred"
    assert got == want and set(want.values()) == {"both signs", "inferred"}


def test_no_pairs(spark):
    lits = fixpoint.literals(spark.createDataFrame([(1, 1, ["g", "not a"])], "problem_id int, clause_id int, clause array<string>"))
    goals = spark.createDataFrame([(1, "g")], "problem_id int, goal string")
    variables = spark.createDataFrame([(1, "a"), (1, "g")], "problem_id int, var string")
    none = spark.createDataFrame([], "problem_id int, context array<string>, vars array<string>")
    sets = growth.grown_sets(lits, goals, variables, none)
    assert sets.count() == 0 and growth.problem_rows(lits, goals, variables, sets).count() == 0
