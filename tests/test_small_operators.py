"""Operators of a few lines each, held against values that follow from their definitions."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import setscore
from tessella.functions import text as tx
from tessella.operators import contracts, curate, layouts, metrics, minset, problems, relate, sample, turns
from tessella.sources import io


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_numbers_and_choices(spark):
    got = values(spark, setscore.numbers_equal(F.col("a"), F.col("b")), [(1.0, 1.0 + 9e-7), (1.0, 1.1), (None, 1.0), (None, None)], "a double, b double")
    assert got == [True, False, False, False]
    assert values(spark, setscore.choice_correct(F.col("a"), F.col("b")), [(2, 2), (-1, -1), (None, 2), (1, 2)], "a int, b int") == [True, False, False, False]


def test_number_verdicts(spark):
    rows = [("Answer: 12 or 13", "12"), ("answer: 3\nanswer: I am not sure, 4", "Not sure"), ("not sure", "4"), ("ANSWER: 007", "7"), ("answer: none", "0"), (None, "1"), ("5", None), ("a12", "12")]
    got = values(spark, setscore.number_verdict(F.col("r"), F.col("t")), rows, "r string, t string")
    assert [(g.said, g.correct) for g in got] == [("12", True), ("Not sure", True), ("Not sure", False), ("007", True), (None, False), (None, False), ("5", False), (None, False)]


def test_truths_of_any_shape_are_sets(spark):
    rows = [("3",), ("[2, 1, 2]",), ("[[1, 2], [3]]",), ("[]",), ("[[]]",), ("x",), (None,)]
    assert values(spark, setscore.choice_sets(F.col("t")), rows, "t string") == [[[3]], [[1, 2]], [[1, 2], [3]], [[]], [[]], [[]], [[]]]


def test_names_literals_and_clauses(spark):
    assert values(spark, tx.normalize_entity(F.col("t")), [("  (“The *Eiffel*  Tower”)!",), (None,)], "t string")[0] == "the eiffel tower"
    assert values(spark, tx.literal_map(F.col("w")), [(["a", "not b"],), ([],)], "w array<string>") == [{"a": True, "b": False}, {}]
    assert values(spark, tx.to_clause(F.col("p"), F.col("c")), [(["a", "not b"], "c")], "p array<string>, c string") == [["b", "c", "not a"]]


def test_sentences_of_both_polarities(spark):
    rules = [["not c", "b", "a"], ["z", "not y"], ["only"], ["not a", "not b"], []]
    want = "If Alice is not a and Alice is not b, then Alice is not c.\nIf Alice is y, then Alice is z."
    assert values(spark, tx.rule_sentences(F.col("r")), [(rules,)], "r array<array<string>>") == [want]
    assert values(spark, tx.rule_sentence(F.col("r")), [(["not z", "y"],)], "r array<string>") == ["If Alice is z, then Alice is y."]


def test_worlds_of_a_flipped_problem(spark):
    worlds = [({"a": True, "b": None}, "goal"), ({}, "not goal")]
    got = values(spark, curate.flip_worlds(F.col("w")), [(worlds,)], "w array<struct<assignments:map<string,boolean>,target:string>>")[0]
    assert [(w.assignments, w.target) for w in got] == [({"a": False, "b": None}, "not goal"), ({}, "goal")]


def test_two_variants_and_first_parts(spark):
    df = spark.createDataFrame([(1, "whole", "part"), (2, None, "p")], "id int, full string, partial string")
    out = curate.two_variants(df, "full", "partial")
    assert out.count() == 4 and out.groupBy("id").count().filter("count <> 2").isEmpty()
    shards = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3), ("a", 4)], "shard string, v int")
    assert sorted(r.v for r in relate.partition_rank(shards, "shard", 2).collect()) == [1, 2, 4]
    assert sorted(r.n for r in problems.keep_range(spark.createDataFrame([(1,), (2,), (3,), (None,)], "n int"), "n", 2, 3).collect()) == [2, 3]


def test_record_in_messages(spark):
    messages = [("user", "LOG_JSON: {1}"), ("assistant", "LOG_JSON: {2}"), ("user", "LOG_JSON: {3}"), ("user", "more")]
    assert values(spark, io.embedded_record(F.col("m")), [(messages,), ([],)], "m array<struct<role:string,content:string>>") == ["{3}", None]


def test_strata_too_small_are_an_error(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(9)], "id int, s int")
    assert sample.per_stratum(df, ["s"], 4, 1, "id", exact=True).count() == 8
    with pytest.raises(Exception, match="stratum too small"):
        sample.per_stratum(df, ["s"], 5, 1, "id", exact=True).collect()


@pytest.mark.parametrize("n", [0, 1, 7, 20, 50])
def test_a_split_is_the_sample_and_the_rest(spark, n):
    df = spark.range(20)
    flagged = sample.split_off(df, n, 3, "id").collect()
    assert len(flagged) == 20
    assert {r.id for r in flagged if r.sampled} == {r.id for r in sample.whole_table(df, n, 3, "id").collect()}


def test_files_and_their_digests(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"abc")
    row = contracts.file_inventory(spark, str(tmp_path)).first()
    assert row.path.endswith("/a.txt") and row.bytes == 3 and row.sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_expected_columns_and_empty_tables(spark):
    out = contracts.with_columns_of(spark.createDataFrame([(1, "x")], "a int, extra string"), {"a": "long", "b": "string"})
    assert out.columns == ["a", "b"] and tuple(out.first()) == (1, None)
    assert contracts.require_none(spark.range(0), "rows").first().ok
    with pytest.raises(Exception, match="rows: 2"):
        contracts.require_none(spark.range(2), "rows").collect()


def test_infeasible_problems_are_named_and_stop_a_run(spark):
    rows = [(i, ["a", "b"], 3, ["a", "z"]) for i in range(25)] + [(30, [], 0, []), (31, None, 1, None), (32, ["a", "a", "b"], 2, ["b"])]
    found = metrics.feasibility_violations(spark.createDataFrame(rows, "id int, q array<string>, k int, c array<string>"), "id", "q", "k", "c").collect()
    kinds = {k: [r for r in found if r.kind == k] for k in ("below_k", "none_queryable", "canonical_missing")}
    assert {k: (len(v), {r.n for r in v}) for k, v in kinds.items()} == {"below_k": (10, {26}), "none_queryable": (2, {2}), "canonical_missing": (10, {25})}
    assert [r.key for r in sorted(kinds["below_k"], key=lambda r: r.pos)] == list(range(10)) and kinds["canonical_missing"][0].missing == ["z"]
    violations = spark.createDataFrame(found)
    with pytest.raises(Exception, match="below_k=26, canonical_missing=25, none_queryable=2"):
        contracts.require_feasible(violations).collect()
    assert contracts.require_feasible(violations.filter("false")).first().ok


def test_easiest_set_at_its_worst(spark):
    rows = [("p", 1, 5, 1), ("p", 1, 2, 9), ("p", 2, 7, None), ("q", 1, None, None)]
    got = {r.p: (r.n, r.d) for r in metrics.least_hard(spark.createDataFrame(rows, "p string, s int, n int, d int"), ["p"], "s", ["n", "d"]).collect()}
    assert got == {"p": (5, 9), "q": (None, None)}


def test_lines_of_a_resumed_log(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "i int, s string")
    log = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (9, "a"), (4, "d"), (4, "d"), (None, "a")], "i int, s string")
    got = {(r.i, r.s): r.problem for r in turns.signature_breaks(log, rows, "i", "s").collect()}
    assert got == {(2, "x"): "signature", (9, "a"): "unknown", (4, "d"): "twice", (None, "a"): "unknown"}


@pytest.mark.parametrize("form", ["json", "csv"])
def test_bad_lines_are_put_aside(spark, tmp_path, form):
    lines = {
        "json": ['{"id": 1, "name": "a", "more": 0}', '{"id": "x", "name": "b"}', '{"id": 2}', "", "null", '{"id": 3, "na', '{"name": "c"}'],
        "csv": ['1,a', 'x,b', '2,', '', '1,2,3', '3', ',c'],
    }[form]
    (tmp_path / "f").write_text("\n".join(lines))
    good, bad = io.read_checked(spark, str(tmp_path), "id int, name string", ["id", "name"], form)
    assert [tuple(r) for r in good.collect()] == [(1, "a")]
    reasons = {r.line: r.reason for r in bad.collect()}
    assert len(reasons) == 5 and reasons[lines[1]] == "unreadable" and reasons[lines[2]] == "missing name" and reasons[lines[6]] == "missing id" and reasons[lines[4]] == reasons[lines[5]] == "unreadable"


def test_candidate_pools(spark, tmp_path):
    (tmp_path / "animals.txt").write_text("Cat\n dog \r\n\ncat\nBee\nDOG")
    (tmp_path / "none.txt").write_text("")
    assert [tuple(r) for r in io.read_pools(spark, str(tmp_path)).orderBy("pool", "pos").collect()] == [("animals", 0, "Cat"), ("animals", 1, "dog"), ("animals", 2, "Bee")]


def _walk(node, assessment, path):
    """Ways to decisions, read off a tree by recursion."""
    kind, label = node.get("type"), node.get("label")
    if kind == "decision":
        return [(assessment, tuple(path), label)]
    if kind == "assessment" and "branches" not in node and "next" in node:
        return _walk(node["next"], label, path)
    if kind == "condition" and "branches" in node:
        return [w for answer, below in node["branches"].items() for w in _walk(below, assessment, [*path, (label, answer)])]
    return _walk(node["next"], assessment, path) if kind == "condition" and "next" in node else []


def test_ways_through_trees(spark):
    leaf = lambda x: {"type": "decision", "label": x}
    deep = {"type": "condition", "label": "c2", "branches": {"u": leaf("d2"), "v": {"type": "assessment", "label": "a2", "next": leaf("d3")}}}
    trees = {
        "t": {"type": "assessment", "label": "a1", "next": {"type": "condition", "label": "c1", "branches": {"yes": leaf("d1"), "no": deep}}},
        "only": leaf("d"),
        "single": {"type": "condition", "label": "c", "next": leaf("d")},
        "odd": {"type": "other", "label": "o", "next": leaf("lost")},
        "below": {"type": "decision", "label": "top", "branches": {"x": leaf("under")}},
        "bare": {"type": "assessment", "label": "a"},
    }
    docs = spark.createDataFrame([(k, json.dumps(v)) for k, v in trees.items()], "tree string, json string")
    nodes = layouts.tree_rows(docs).cache()
    paths = layouts.tree_paths(nodes)
    got = sorted((r.tree, r.assessment or "", tuple((c.label, c.answer) for c in r.conditions), r.outcome) for r in paths.collect())
    assert got == sorted((k, a or "", p, o) for k, v in trees.items() for a, p, o in _walk(v, None, []))
    asked = {(r.outcome, r.k): (len(r.context), [(c.label, c.answer) for c in r.desired], r.questions) for r in layouts.tree_questions(paths, 2).collect()}
    assert asked == {
        ("d1", 1): (0, [("c1", "yes")], ["c1"]), ("d2", 1): (1, [("c2", "u")], ["c2"]), ("d2", 2): (0, [("c1", "no"), ("c2", "u")], ["c1", "c2"]),
        ("d3", 1): (1, [("c2", "v")], ["c2"]), ("d3", 2): (0, [("c1", "no"), ("c2", "v")], ["c1", "c2"]),
    }
    summary = {r.tree: (r.n_decisions, r.conditions, r.category) for r in layouts.tree_summary(nodes).collect()}
    assert summary == {"t": (3, ["c1", "c2"], "a2"), "only": (1, [], "Unknown"), "single": (1, ["c"], "Unknown"), "odd": (1, [], "Unknown"), "below": (2, [], "Unknown"), "bare": (0, [], "a")}


def test_reported_sets_are_held_against_the_search(spark):
    worlds = spark.createDataFrame([(p, s, (s & 1) if p == "one" else s & 3) for p in ("one", "two") for s in range(8)], "problem_id string, state long, y int")
    variables = worlds.select("problem_id").distinct().withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(2))))
    reported = spark.createDataFrame([("one", 1), ("one", 1), ("one", 2), ("two", 7)], "problem_id string, mask long")
    got = sorted(tuple(r) for r in minset.exhaustive(worlds, reported, variables, 3).collect())
    assert got == [("one", 2, "extra"), ("two", 3, "missing"), ("two", 7, "extra")]
