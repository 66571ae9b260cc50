from pyspark.sql import Row
from pyspark.sql import functions as F

from tessella.operators import belief, fixpoint, minset, relate, sample, turns
from tessella.sources import io


def test_pairing(spark):
    said = [(1, 1, "system", "s"), (1, 2, "assistant", "q1"), (1, 3, "assistant", "q2"), (1, 4, "user", "a"), (1, 5, "user", "b"), (1, 6, "assistant", ""), (1, 7, "assistant", "Q2"), (1, 8, "user", "c")]
    got = turns.flag_repeats(turns.pair_replies(spark.createDataFrame(said, "conv_id int, turn int, role string, text string"))).orderBy("pair").collect()
    assert [(r.question, r.answer, r.is_repeat) for r in got] == [("q2", "a", False), ("Q2", "c", True)]


def test_turns_to_clarity(spark):
    t = lambda *xs: [Row(is_ambiguous=x) for x in xs]
    rows = [(0, []), (1, t(True)), (2, t(True, False)), (3, t(False, True)), (4, t(True, True, False))]
    df = spark.createDataFrame(rows, "i int, logs array<struct<is_ambiguous: boolean>>")
    assert [r[0] for r in df.orderBy("i").select(turns.turns_to_clarity(F.col("logs"))).collect()] == [None, None, 2, None, 3]


def clauses(spark, *cs):
    return spark.createDataFrame([("p", i, list(c)) for i, c in enumerate(cs)], "problem_id string, clause_id int, clause array<string>")


def test_horn_closure_and_refutation(spark):
    lits = fixpoint.literals(clauses(spark, ["c", "not a", "not b"], ["d", "not c"], ["not d", "not e"]))
    facts = spark.createDataFrame([("p", 0, "a", True), ("p", 0, "b", True), ("p", 1, "a", True), ("p", 1, "d", True), ("p", 1, "e", True)], "problem_id string, branch_id int, var string, val boolean")
    known, bad = fixpoint.horn_closure(lits, facts)
    assert {(r.var, r.val) for r in known.filter("branch_id = 0").collect()} == {("a", True), ("b", True), ("c", True), ("d", True), ("e", False)}
    assert [r.branch_id for r in bad.collect()] == [1]
    ask = spark.createDataFrame([("p", 0, "d"), ("p", 0, "e"), ("p", 0, "z")], "problem_id string, branch_id int, var string")
    forced = {r.var: r.forced for r in fixpoint.forced_values(lits, facts.filter("branch_id = 0"), ask).collect()}
    assert forced == {"d": True, "e": False, "z": None}


def test_graph(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "t"), (1, "x", "y"), (1, "y", "x"), (1, "a", "t")], "problem_id int, src string, dst string")
    goals = spark.createDataFrame([(1, "t")], "problem_id int, goal string")
    assert {r.node for r in fixpoint.ancestors(edges, goals).collect()} == {"t", "b", "a"}
    assert {(r.node, r.dist) for r in fixpoint.distances(edges, goals).collect()} == {("t", 0), ("b", 1), ("a", 1)}
    assert {r.node for r in fixpoint.cyclic_nodes(edges).collect()} == {"x", "y"}
    assert fixpoint.cyclic_nodes(edges.filter("src in ('a', 'b')")).count() == 0


def test_recompute(spark):
    rules = spark.createDataFrame([(1, "s", "sub_xy", ["a", "b"], None), (1, "h", "div_k", ["s"], 2.0), (1, "m", "sum_mul_k", ["a", "b", "h"], 3.0), (1, "u", "add_k", ["lost"], 1.0)], "problem_id int, output string, rule_type string, inputs array<string>, constant double")
    leaves = spark.createDataFrame([(1, "a", 1.0), (1, "b", 8.0)], "problem_id int, node string, value double")
    got = {r.node: r.value for r in fixpoint.recompute(rules, leaves).collect()}
    assert got == {"a": 1.0, "b": 8.0, "s": -7.0, "h": -4.0, "m": 15.0}


def test_terminal_cycles(spark):
    t = spark.createDataFrame([("m", 0, 1), ("m", 1, 2), ("m", 2, 3), ("m", 3, 2), ("m", 4, 4), ("m", 5, 0)], "model string, state long, next long")
    assert {r.state: r.cycle for r in fixpoint.terminal_cycles(t).collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 4, 5: 2}


def test_minimal_sets_and_their_verification(spark):
    worlds = [("p", s, (s & 1) ^ (s >> 1 & 1)) for s in range(8)] + [("q", s, 7) for s in range(4)] + [("top", 1 << 62, 1), ("top", 0, 0)]
    worlds = spark.createDataFrame(worlds, "problem_id string, state long, y int")
    names = spark.createDataFrame([("p", i) for i in range(3)] + [("q", 0), ("top", 62)], "problem_id string, idx int")
    sets, report = minset.minimal_sufficient(worlds, names, 3)
    assert {(r.problem_id, r.k, r.mask) for r in sets.collect()} == {("p", 2, 3), ("q", 0, 0), ("top", 1, 1 << 62)}
    assert {r.problem_id: r.status for r in report.collect()} == {"p": "found", "q": "found", "top": "found"}
    assert all(r.is_minimal for r in minset.verify_sets(worlds, sets.select("problem_id", "mask")).collect())
    assert {r.problem_id: r.status for r in minset.minimal_sufficient(worlds, names, 3, cap=1)[1].collect()}["p"] == "rejected"


def test_posterior_equals_the_sequential_rule(spark):
    labels = {1: ["yes", "no", "pass"], 2: ["no", "no", "yes"]}
    seen = {1: "yes", 2: "no"}
    rows = [(1, t, c, labels[t][c], seen[t]) for t in labels for c in range(3)]
    df = spark.createDataFrame(rows, "e int, turn int, candidate int, label string, observed string")
    got = {(r.turn, r.candidate): r.posterior for r in belief.beliefs(df, ["e"]).collect()}
    p = [1 / 3] * 3
    for t in (1, 2):
        p = [x * (0.98 if labels[t][c] == seen[t] else 0.5 if labels[t][c] == "pass" else 0.02) for c, x in enumerate(p)]
        p = [x / sum(p) for x in p]
        assert all(abs(got[t, c] - p[c]) < 1e-12 for c in range(3))


def test_samples_ignore_row_order(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    pick = lambda d: {r.id for r in sample.per_stratum(d, ["g"], 7, 1, "id").collect()}
    assert pick(df) == pick(df.repartition(9).orderBy(F.desc("id"))) and len(pick(df)) == 21


def test_containment(spark):
    s = spark.createDataFrame([(1, 1, ["a"]), (1, 2, ["a", "b"]), (1, 3, ["b"]), (1, 4, []), (2, 5, ["a", "b", "c"])], "g int, k int, s array<string>")
    assert {(r.small, r.large) for r in relate.contained_sets(s, ["g"], "k", "s").collect()} == {(1, 2), (3, 2)}
    assert {r.k for r in relate.minimal_sets(s, ["g"], "k", "s").collect()} == {1, 3, 4, 5}


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "old"), ("k2", "x")], "key string, result string").coalesce(1)
    io.append_log(rows, str(tmp_path / "log"))
    (tmp_path / "log" / "zz.json").write_text('{"key": "k1", "result": "new"}\nnot json\n\n')
    io.compact_log(spark, str(tmp_path / "log"), str(tmp_path / "compact"))
    assert {r.key: r.result for r in io.read_log(spark, str(tmp_path / "compact")).collect()} == {"k1": "new", "k2": "x"}
    nested = spark.createDataFrame([(1, ["a", 'say "b"'], "two\nlines")], "i int, xs array<string>, t string")
    io.write_json_cells_csv(nested, str(tmp_path / "csv"))
    back = io.read_problem_csv(spark, str(tmp_path / "csv"), "i int, xs string, t string").first()
    assert (back.i, back.xs, back.t) == (1, '["a","say \\"b\\""]', "two\nlines")
    (tmp_path / "a.json").write_text('[{"index": 1}, {"index": 2}]')
    (tmp_path / "b.jsonl").write_text('{"index": 3}\n\n')
    assert io.read_episodes(spark, str(tmp_path / "a.json"), str(tmp_path / "b.jsonl"), "index int").count() == 3
    files = io.files_of(spark, str(tmp_path), "*.json*", excluded="^b")
    assert io.last_file(files.filter("name like 'a%'").withColumn("g", F.lit(1)), ["g"]).first().path.endswith("a.json")
    assert [r.line for r in io.markdown_table(spark.createDataFrame([(1, 0.5), (2, None)], "a int, b double"), "a").orderBy("pos").collect()][2:] == ["| 1 | 0.500 |", "| 2 | - |"]
