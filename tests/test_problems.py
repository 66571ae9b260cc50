"""Readers, logs and problem tables on hand-made rows, shaped as logs and problem files are."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.functions import verdicts
from tessella.operators import fixpoint, metrics, minset, problems, sample, verify
from tessella.sources import io


def one(spark, column, **values):
    """The value of a column expression over one row; values: name=(type, value)."""
    schema = ", ".join(f"{n} {t}" for n, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("r")).first().r


def test_later_append_wins_whatever_the_file_names(spark, tmp_path):
    for n in range(6):
        log = str(tmp_path / f"log{n}")
        for word in ("first", "second", "third"):
            io.append_log(spark.createDataFrame([("k", word), (word, "own")], "key string, result string"), log)
        assert {r.key: r.result for r in io.latest_lines(io.read_log(spark, log)).collect()} == {"k": "third", "first": "own", "second": "own", "third": "own"}
    within = str(tmp_path / "within")
    io.append_log(spark.createDataFrame([("k", "a"), ("k", "b")], "key string, result string").coalesce(1), within)
    assert io.latest_lines(io.read_log(spark, within)).first().result == "b"
    compact = str(tmp_path / "compact")
    io.compact_log(spark, within, compact)
    io.append_log(spark.createDataFrame([("k", "c")], "key string, result string"), compact)
    assert io.latest_lines(io.read_log(spark, compact)).first().result == "c"


def test_tasks_by_name(spark, tmp_path):
    lines = [{"family": "f", "target": "a", "k": 1}, {"family": "f", "target": "b", "k": 2}, {"family": "g", "target": "a", "k": 3}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    task = F.concat_ws("_", "family", "target")
    rows = io.read_tasks(spark, str(tmp_path / "t.jsonl"), "family string, target string, k int", task, ["f_a", "g_a"])
    assert sorted((r.task, r.k) for r in rows.collect()) == [("f_a", 1), ("g_a", 3)]


@pytest.mark.parametrize(
    "cell, value",
    [("True", "true"), ("false", "false"), (" 12 ", "12"), ("-3.50", "-3.5"), ("[1, 2]", "[1, 2]"), ('{"a": 1}', '{"a":"1"}'), ('say "x"', '"say \\"x\\""'), ("", None), ("  ", None), (None, None), ("[open", '"[open"'), ("1.2.3", '"1.2.3"')],
)
def test_sniffed_cells(spark, cell, value):
    assert one(spark, io.sniffed(F.col("c")), c=("string", cell)) == value


def test_result_documents(spark, tmp_path):
    (tmp_path / "a_results.json").write_text(json.dumps({"metrics": {"total": 2, "rate": 0.5, "name": "x"}, "episodes": [{"turn": 1}, {"turn": 2}], "other": 1}, indent=1))
    (tmp_path / "b_results.json").write_text(json.dumps({"metrics": {"total": 3}}))
    numbers, episodes = io.result_parts(spark, str(tmp_path / "*_results.json"), "metrics", "episodes", "turn: int")
    assert sorted((r.file[-14:], r.name, r.value) for r in numbers.collect()) == [("a_results.json", "rate", 0.5), ("a_results.json", "total", 2.0), ("b_results.json", "total", 3.0)]
    assert sorted(r.turn for r in episodes.collect()) == [1, 2]


def test_questions_with_fallback(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "g int")
    lists = "g int, questions array<string>"
    out = io.with_questions(rows, spark.createDataFrame([(1, ["a"])], lists), spark.createDataFrame([(1, ["z"]), (2, ["b"])], lists), "g")
    assert {r.g: r.questions for r in out.collect()} == {1: ["a"], 2: ["b"], 3: []}


def test_statistics_files(spark, tmp_path):
    io.write_statistics(spark.createDataFrame([(1, "x", 2.5)], "b int, a string, c double").coalesce(1), str(tmp_path / "s"), ["b", "a", "c"])
    assert next((tmp_path / "s" / "csv").glob("*.csv")).read_text() == "b,a,c\n1,x,2.5\n"
    assert next((tmp_path / "s" / "json").glob("*.json")).read_text() == '{"a":"x","b":1,"c":2.5}\n'


@pytest.mark.parametrize(
    "cell, value",
    [("['a', 'b']", ["a", "b"]), ('["a", "b"]', ["a", "b"]), ("['it\\'s', 'the dog\\'s']", ["it's", "the dog's"]), ("[\"don't\", 'x']", ["don't", "x"]), ("('a', 'b',)", ["a", "b"]), ("[]", [])],
)
def test_lists_in_either_notation(spark, cell, value):
    assert one(spark, tx.string_list(F.col("c")), c=("string", cell)) == value


@pytest.mark.parametrize("text, label", [("I cannot determine that", "pass"), ("That can’t determine it", "pass"), ("yes, or I cannot determine", "yes"), ("so no, unsure", "pass"), ("yes and no", "yes"), ("well yes and no", None)])
def test_labels_of_mentions(spark, text, label):
    assert one(spark, tx.answer_label(F.col("t")), t=("string", text)) == label


def test_questions_about_x_go_first(spark):
    said = lambda f, t: one(spark, f(F.col("t")), t=("string", t))
    assert said(tx.questions_in, "Should we? Is X alive. Now? Can it?") == ["Is X alive. Now?"]
    assert said(tx.questions_in, "Was it red? Should it be blue! or green?") == ["Should it be blue! or green?"]
    assert said(tx.is_question, "Was it red?") is False and said(tx.is_question, "So: is x red? Yes.") is True


def test_guesses_in_order(spark):
    said = lambda t: one(spark, tx.guess_entity(F.col("t")), t=("string", t))
    assert [said(t) for t in ("X is 'Rome'.", "Is it a dog?", "My guess is Mars!", "I think it is tea", "It is \"gold\"", "plain", "")] == ["Rome", "a dog", "Mars", "tea", "gold", "plain", ""]


@pytest.mark.parametrize(
    "text, choices, missing, truth",
    [
        ("Question: Is Alice kind? Is Alice [tall]?", ["kind", "tall"], "None", "None"), ("End questioning now", ["End questioning"], "None", "None"), ("Answer: 2, no, answer: 3", ["None"], "3", "no"),
        ("Answer: No", ["None"], "no", "no"), ("Yes, but not sure", ["None"], "not sure", "not sure"), ("maybe 4", ["None"], "4", "None"), ("Answer: Yes", ["None"], "None", "yes"),
    ],
)
def test_verdicts(spark, text, choices, missing, truth):
    got = lambda f: one(spark, f(F.col("t")), t=("string", text))
    assert (got(verdicts.choice_verdict), got(verdicts.ambiguity_verdict), got(verdicts.truth_verdict)) == (choices, missing, truth)


def test_places_of_a_truth_are_read_for_themselves(spark):
    said = lambda t: one(spark, verdicts.truth_verdict(F.col("t")), t=("string", t))
    # the line ends in n, and o follows the word
    assert said("yes, again\nanswero") == "yes"
    # in capitals before the last `answer` only, and nowhere
    assert said("YES\nmy answer: maybe") is None and said("YES, the answer: maybe") is None and said("hm") == "None"
    assert said("Perhaps.\nThe Answer: NOT SURE") == "not sure" and said("yes\nanswer: no") == "no" and said("") == "None"


def test_settled_number(spark):
    kind = "array<struct<role:string,content:string>>"
    said = [("model", "Answer: 4"), ("user", "Answer: 9"), ("model", "answer: 5.5 or 6"), ("model", "Answer: none"), ("model", "7")]
    assert one(spark, verdicts.settled_number(F.col("m"), "model"), m=(kind, said)) == 5.5
    assert one(spark, verdicts.settled_number(F.col("m"), "model"), m=(kind, [])) is None


def test_wanted_values_must_exist(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    assert [r.k for r in problems.keep_values(rows, "k", [2, 5]).collect()] == [2]
    with pytest.raises(ValueError, match="wanted k"):
        problems.keep_values(rows, "k", [7])


def test_assignments_in_any_order(spark):
    derivations = spark.createDataFrame([(1, "['b', 'not a']", "g"), (1, '["a","b"]', "not g"), (2, '["a"]', "other")], "p int, key string, target string")
    asked = spark.createDataFrame([(1, ["not a", "b"]), (1, ["b", "a"]), (1, ["a"]), (2, ["a"])], "p int, literals array<string>")
    assert sorted(r.truth for r in problems.assignment_targets(asked, derivations, "p", F.lit("g")).collect()) == ["no", "yes"]


def test_question_metrics(spark):
    kind = "sample_id int, correct boolean, answered boolean, error boolean, asked array<string>, matched array<string>, n_matched int, wanted array<string>, tokens int, turns int, k int"
    rows = [(1, True, True, False, ["a", "x"], ["a"], 1, ["a", "b"], 10, 2, 1), (1, False, True, True, [], [], 0, ["a"], 0, 1, 1), (2, True, False, False, ["b"], ["b"], 1, ["b"], 5, 1, 2)]
    got = {(r.scope, r.k): r for r in metrics.question_metrics(spark.createDataFrame(rows, kind), ["k"]).collect()}
    every, first = got["overall", None], got["k", 1]
    assert (every.total_episodes, every.n_episode_errors, first.n_episode_errors) == (3, 1, 1)
    assert every.avg_question_precision == pytest.approx(0.5) and every.avg_minset_f1 == pytest.approx((2 / 3 + 0 + 1) / 3)
    assert every.avg_minset_jaccard == pytest.approx((1 / 3 + 0 + 1) / 3) and every.macro_accuracy == pytest.approx(0.75)


def test_levels_differ_by_one_at_most(spark):
    rows = sample.balanced_schedule(spark.range(1003).repartition(5), 4, 42, "id").groupBy("k").count().collect()
    assert sorted(r["count"] for r in rows) == [250, 251, 251, 251] and sorted(r.k for r in rows) == [1, 2, 3, 4]


def test_five_checks(spark):
    states = [(s >> 2 & 1) & (s & 1) for s in range(8)]  # y = bit 0 and bit 2
    worlds = spark.createDataFrame([(1, s, y) for s, y in enumerate(states)] + [(2, s, 1) for s in range(8)], "problem_id int, state long, y int")
    variables = spark.createDataFrame([(p, i) for p in (1, 2) for i in range(3)], "problem_id int, idx int")
    claims = spark.createDataFrame([(1, 2), (2, 2)], "problem_id int, k int")
    sets = spark.createDataFrame([(1, 5), (1, 3), (1, 7), (2, 1)], "problem_id int, mask long")
    got = {(r.problem_id, r.mask): r.verdict for r in verify.five_checks(worlds, sets, claims, variables, 2, 10).collect()}
    assert got == {(1, 5): "ok", (1, 3): "not sufficient", (1, 7): "wrong size", (2, 1): "determined without"}
    status = {(r.problem_id, r.k): (r.status, r.n_tested) for r in verify.global_minimality(worlds, spark.createDataFrame([(1, 2), (2, 3)], "problem_id int, k int"), variables, 3, 3).collect()}
    assert status == {(1, 2): ("pass", 3), (2, 3): ("fail", 3)}
    capped = verify.global_minimality(worlds, claims, variables, 2, 2).collect()
    assert {r.status for r in capped} == {"skip"}


def test_sample_errors(spark):
    rows = spark.createDataFrame([(1, False, False), (2, True, None), (3, False, True)], "p int, a boolean, b boolean")
    assert {r.p: r.errors for r in verify.sample_errors(rows, "p", {"a": "cycle", "b": "depth"}).collect()} == {1: [], 2: ["cycle", "depth"], 3: ["depth"]}


def test_columns_of_problems(spark):
    names, rules = ("array<string>", ["T", "P", "A"]), ("array<string>", ["P = B + (F * B)", "T = B + P"])
    assert one(spark, problems.by_appearance(F.col("n"), F.lit("first P then T")), n=names) == ["P", "T", "A"]
    assert one(spark, problems.names_in(F.col("r")), r=rules) == ["B", "F", "P", "T"]
    assert one(spark, problems.leaf_names(F.col("g"), F.col("v"), F.col("d")), g=("array<string>", []), v=("array<string>", ["B", "A", "F", "P"]), d=("array<string>", ["P", "T"])) == ["A", "B", "F"]
    assert one(spark, problems.goal_name(F.col("t")), t=("string", "So what is T ?")) == "T"
    assert one(spark, problems.without_field(F.col("k"), "old"), k=("string", '{"a":"1","old":"x"}')).asDict() == {"key": '{"a":"1"}', "changed": True}
    assert one(spark, problems.listed_numbers(F.col("c"), F.lit(2)), c=("string", "[1, 2.5]")) == [1.0, 2.5] and one(spark, problems.listed_numbers(F.col("c"), F.lit(2)), c=("string", "3")) == [3.0, 3.0]
    assert one(spark, problems.unknown_literals(F.col("r"), F.col("k"), F.lit("g")), r=("array<array<string>>", [["g", "not a", "not b"], ["a", "not c"]]), k=("array<string>", ["b"])) == ["a", "c"]


def plain_levels(nodes, edges):
    """Round by round: nodes all of whose sources have a level."""
    level, n = {}, 0
    while True:
        new = [x for x in nodes if x not in level and all(a in level for a, b in edges if b == x)]
        if not new:
            return level
        level |= dict.fromkeys(new, n)
        n += 1


def test_topological_levels_against_rounds(spark):
    rng = random.Random(2)
    graphs = {}
    for p in range(12):
        nodes = [f"n{i}" for i in range(rng.randint(1, 9))]
        pairs = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :]] if p % 2 else [(a, b) for a in nodes for b in nodes]
        graphs[p] = (nodes, rng.choices(pairs, k=rng.randint(0, 9)) if pairs else [])
    nodes = spark.createDataFrame([(p, x) for p, (ns, _) in graphs.items() for x in ns], "problem_id int, node string")
    edges = spark.createDataFrame([(p, a, b) for p, (_, es) in graphs.items() for a, b in es], "problem_id int, src string, dst string")
    got = {(r.problem_id, r.node): r.level for r in fixpoint.topological_levels(nodes, edges).collect()}
    assert got == {(p, x): n for p, (ns, es) in graphs.items() for x, n in plain_levels(ns, es).items()}


def test_errors_of_problems_from_their_rows(spark):
    """The sample problem of the fixtures (P = B + F, T = B + P), right and with one fault each."""
    nodes = {"B": (200.0, True), "F": (90.0, True), "A": (15.0, True), "P": (290.0, False), "T": (490.0, False)}
    edges = [("B", "P"), ("F", "P"), ("B", "T"), ("P", "T")]
    rules = [("P", "add_xy", ["B", "F"], None), ("T", "add_xy", ["B", "P"], None)]
    claim = {"goal": "T", "num_vars": 5, "num_rules": 2, "depth": 2, "asked_vars": 5, "asked_rules": 3, "asked_depth": 2, "distractors": ["A"]}
    cases = {
        "right": ((nodes, edges, rules, claim), []),
        "cycle": ((nodes, [*edges, ("T", "P")], rules, claim), ["graph is not acyclic"]),
        "no goal": ((nodes, edges, rules, claim | {"goal": "Z"}), ["goal is not a node"]),
        "unreached": ((nodes, [("P", "T"), ("T", "P")], rules, claim), ["graph is not acyclic", "goal not reached from a leaf"]),
        "sizes": ((nodes, edges, rules, claim | {"num_vars": 9, "num_rules": 6, "depth": 1}), ["number of variables", "number of rules", "depth"]),
        "stalled": ((nodes, edges, [("P", "add_xy", ["B", "X"], None), rules[1]], claim), ["not computed: P, T"]),
        "odd": ((nodes, edges, [("P", "pow", ["B", "F"], None)], claim), ["unknown rule for P"]),
        "value": ((nodes | {"P": (291.0, False), "T": (1.0, False)}, edges, rules, claim), ["value mismatch for P"]),
        "overlap": ((nodes, edges, rules, claim | {"distractors": ["A", "F"]}), ["distractors lead to the goal"]),
        "no null": ((nodes, edges, rules, claim | {"num_vars": None, "distractors": []}), ["number of variables"]),
    }
    flat = lambda i, f: [(p, *x) for p, (parts, _) in cases.items() for x in f(parts[i])]
    n = spark.createDataFrame(flat(0, lambda d: [(k, *v) for k, v in d.items()]), "problem_id string, node string, value double, known boolean")
    e = spark.createDataFrame(flat(1, list), "problem_id string, src string, dst string")
    r = spark.createDataFrame(flat(2, list), "problem_id string, output string, rule_type string, inputs array<string>, constant double")
    fields = "goal string, num_vars int, num_rules int, depth int, asked_vars int, asked_rules int, asked_depth int, distractors array<string>"
    c = spark.createDataFrame(flat(3, lambda d: [tuple(d.values())]), f"problem_id string, {fields}")
    assert {x.problem_id: x.errors for x in verify.validated(n, e, r, c).collect()} == {p: want for p, (_, want) in cases.items()}


def test_global_minimality_makes_only_sets_that_witnesses_ask_for(spark):
    """Against all sets; and of 40 variables, three of which settle the outcome, few of the 10,701 sets of up to three are looked at."""
    rng = random.Random(9)
    rows = {p: [(rng.getrandbits(6), None) for _ in range(25)] for p in range(8)}
    rows = {p: [(s, (s & [3, 5, 7, 21, 0, 63, 1, 9][p]) % 5) for s, _ in ws] for p, ws in rows.items()}
    worlds = spark.createDataFrame([(p, s, y) for p, ws in rows.items() for s, y in ws], "problem_id int, state long, y int")
    names = spark.createDataFrame([(p, i) for p in rows for i in range(6)], "problem_id int, idx int")
    for k in (0, 1, 2, 3, 6, 7):
        claims = spark.createDataFrame([(p, k) for p in rows], "problem_id int, k int")
        got = {r.problem_id: (r.status, r.n_tested) for r in verify.global_minimality(worlds, claims, names, 7, 15).collect()}
        for p, ws in rows.items():
            sets = list(itertools.combinations(range(6), k - 1)) if k else []
            ok = [all(len({y for s, y in ws if tuple(s >> i & 1 for i in c) == key}) < 2 for key in {tuple(s >> i & 1 for i in c) for s, _ in ws}) for c in sets]
            assert got[p] == ("skip" if not sets or len(sets) > 15 else "fail" if any(ok) else "pass", len(sets))
    wide = [(1, rng.getrandbits(40), 0) for _ in range(150)]
    wide = spark.createDataFrame([(p, s, s & 7) for p, s, _ in wide], "problem_id int, state long, y long")
    claim = spark.createDataFrame([(1, (1 << 40) - 1, 3)], "problem_id int, vars long, size int")
    found, looked = minset.smaller_suffices(wide, claim, 3)
    assert found.first().found and looked.first().n_nodes < 6_000
