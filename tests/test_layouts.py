"""Layouts, trees, replies, shards, copies and medians on hand-made rows."""

import json
import statistics

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators import layouts, metrics
from tessella.sources import io

from .test_problems import one


def test_task_names(spark):
    rows = spark.createDataFrame([("GeneReg-SS", "marker_gene"), ("GeneReg-Dyn", "attractor_id"), ("x", "marker_gene"), (None, None)], "f string, t string")
    assert [r.n for r in rows.select(layouts.task_name(F.col("f"), F.col("t")).alias("n")).collect()] == ["ss_marker", "dyn_attr", None, None]


def test_aliases_follow_name_order(spark):
    names = [f"v{i}" for i in range(28)][::-1] + ["v0"]
    got = one(spark, layouts.alias_map(F.col("n")), n=("array<string>", names))
    assert got == {f"v{i}": f"{chr(65 + i % 26)}{i // 26 + 1}" for i in range(28)}
    assert one(spark, layouts.alias_map(F.col("n")), n=("array<string>", [])) == {}


@pytest.mark.parametrize(
    "kind, inputs, constant, expression",
    [("add_xy", ["a", "b"], None, "C1 = A1 + B1"), ("sub_xy", ["b", "a"], None, "C1 = B1 - A1"), ("mul_k", ["a"], 2, "C1 = A1 * 2"), ("div_k", ["a"], 2, "C1 = A1 // 2"), ("add_k", ["a"], 2, "C1 = A1 + 2"),
     ("sub_k", ["a"], 2, "C1 = A1 - 2"), ("sum_mul_k", ["a", "b"], 3, "C1 = (A1 + B1) * 3"), ("other", ["a"], 1, None)],
)
def test_aliased_rules(spark, kind, inputs, constant, expression):
    rule = one(spark, layouts.aliased_rules(F.col("r"), layouts.alias_map(F.array(F.lit("a"), F.lit("b"), F.lit("c")))), r=("array<struct<output:string,rule_type:string,inputs:array<string>,constant:long>>", [("c", kind, inputs, constant)]))[0]
    assert (rule.output, rule.expression) == ("C1", expression)


def test_reference_row(spark):
    """The first row of the sample table: leaves A, B and F, of which B and F are relevant and held out."""
    df = spark.createDataFrame([("0d", ["F", "A", "B"], ["F", "B"], ["B"], 490.0, 1.5)], "id string, leaves array<string>, relevant array<string>, held array<string>, answer double, mean double")
    r = layouts.reference_layout(df, "leaves", "relevant", "held", ["answer", "mean"]).first()
    assert (r.possible_questions, r.given_conditions, r.held, r.answer, r.mean) == ('["A","B","F"]', '["F"]', '["B"]', "490", "1.5")


def test_held_out_rows(spark):
    df = spark.createDataFrame([("text", 2, [["a", "b"], ["a", "c"]]), ("none", 1, [])], "t string, k int, choices array<array<string>>")
    rows = layouts.held_out_rows(df, "t", "k", "choices").orderBy("sample_id").collect()
    assert [(r.sample_id[12:], r.held_out) for r in rows] == [("_k2_1", ["a", "b"]), ("_k2_2", ["a", "c"])]


@pytest.mark.parametrize("cell, n, vs", [('{"a":1,"b":2}', 2, 2), ("[1,2,3]", 3, None), ("text", None, None), (None, None, None), ("[]", 0, None), ("{}", 0, 0)])
def test_result_counts(spark, cell, n, vs):
    r = one(spark, layouts.result_counts(F.col("c"), F.col("c"), F.lit(None), F.lit(None)), c=("string", cell))
    assert tuple(r) == (n, vs, 0.0, 0)


TREE = {
    "type": "assessment", "label": "check",
    "next": {"type": "condition", "label": "fever", "branches": {"yes": {"type": "decision", "label": "treat"}, "no": {"type": "condition", "label": "cough", "next": {"type": "decision", "label": "wait"}}}},
}


def test_trees_from_files_to_text(spark, tmp_path):
    (tmp_path / "g1.json").write_text(json.dumps(TREE, indent=2))
    (tmp_path / "g2.json").write_text(json.dumps({"type": "other", "label": "alone"}))
    nodes = layouts.tree_rows(io.read_documents(spark, str(tmp_path)))
    assert sorted((r.tree, len(r.path), r.label) for r in nodes.collect()) == [("g1", 0, "check"), ("g1", 1, "fever"), ("g1", 2, "cough"), ("g1", 2, "treat"), ("g1", 3, "wait"), ("g2", 0, "alone")]
    text = {r.tree: r.text for r in layouts.tree_text(nodes).collect()}
    assert text == {"g1": "Assessment: check\n  If fever:\n    yes:\n      -> treat\n    no:\n      If cough:\n        -> wait", "g2": "alone"}


@pytest.mark.parametrize(
    "text, visible, rest",
    [("a\nQuestion: x?\nb", "Question: x?", "a\n\nb"), ("Question: x?\nAnswer: 1", "Answer: 1", "Question: x?"), ("no action", "", "no action"), ("", "", ""), ("ANSWER: yes ", "ANSWER: yes", ""), ("see Answer: 1", "", "see Answer: 1")],
)
def test_visible_action(spark, text, visible, rest):
    assert tuple(one(spark, tx.visible_action(F.col("t")), t=("string", text))) == (visible, rest)


@pytest.mark.parametrize("parts, text", [(["ab", "a", "", "abc", "x"], "abc\n\nx"), ([" ", None], ""), (["a", "a"], "a"), ([], "")])
def test_joined_parts(spark, parts, text):
    assert one(spark, tx.joined_parts(F.col("p")), p=("array<string>", parts)) == text


@pytest.mark.parametrize("text, found", [("Question: How old? Question: Is it  so?", ["How old?", "Is it  so?"]), ("question: no mark\nmore", ["no mark?"]), ("nothing", []), ("Question:", [])])
def test_asked_questions(spark, text, found):
    assert one(spark, tx.asked_questions(F.col("t")), t=("string", text)) == found


def test_same_question(spark):
    assert one(spark, tx.same_question(F.col("t")), t=("string", '  Does he  SMOKE? "')) == "does he smoke"


@pytest.mark.parametrize(
    "usage, output",
    [({"prompt_token_count": 5, "response_token_count": 7, "thoughts_token_count": 3}, 10), ({"promptTokenCount": 5, "totalTokenCount": 9}, 4), ({"prompt_token_count": 9, "total_token_count": 5}, 0), ({"thoughtsTokenCount": 3}, 3), ({}, 0)],
)
def test_billed_tokens(spark, usage, output):
    assert one(spark, tx.billed_tokens(F.col("u")), u=("string", json.dumps(usage))).output == output


def test_shards(spark, tmp_path):
    for shard in ("a", "b"):
        (tmp_path / f"new_{shard}_500k").mkdir()
        (tmp_path / f"new_{shard}_500k" / "rows.jsonl").write_text(f'{{"v": "{shard}"}}\n')
    (tmp_path / "old").mkdir()
    rows = io.read_shards(spark, f"{tmp_path}/new_*_500k", "v string", r"new_(\w+)_500k").collect()
    assert sorted((r.v, r.shard) for r in rows) == [("a", "a"), ("b", "b")]


def test_copies(spark, tmp_path):
    for side, files in (("left", {"a": "1", "b": "12", "c": "x", "d": "d"}), ("right", {"a": "1", "b": "1", "c": "y", "e": "e"})):
        (tmp_path / side).mkdir()
        for name, content in files.items():
            (tmp_path / side / name).write_text(content)
    found = io.copies_differ(spark, str(tmp_path / "left"), str(tmp_path / "right"))
    assert sorted(map(tuple, found.collect())) == [("b", "size"), ("c", "content"), ("d", "missing right"), ("e", "missing left")]


@pytest.mark.parametrize("most", [0, 10, 10**6])
def test_medians_are_exact(spark, most):
    columns = {"even": [float(i * 7919 % 1000) for i in range(1000)], "ties": [1.0] * 499 + [2.0] * 501, "half": [1.0] * 500 + [2.0] * 500, "few": [3.0] + [None] * 999, "none": [None] * 1000}
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    found = {r.column: r.median for r in metrics.medians(df, list(columns), most).collect()}
    assert found == {c: statistics.median([x for x in v if x is not None]) for c, v in columns.items() if c != "none"}


def test_profile_of_nothing(spark):
    df = spark.createDataFrame([("x",), (None,)], "c string")
    assert tuple(metrics.numeric_profile(df, ["c"]).first()) == ("c", None, None, None, None, None, 0)


def test_audit_of_no_rows(spark):
    df = spark.createDataFrame([], "id int, k int, depth int, f boolean")
    lines = [r.line for r in layouts.audit_report(df, df, "id", "k", "depth", ["f"], ["k"], "T").orderBy("section", "pos").collect()]
    assert lines == ["# T", "- Total rows: 0", "- Audited rows: 0", "- k distribution: ", "- depth buckets: ", "- f=true: 0/0"]
