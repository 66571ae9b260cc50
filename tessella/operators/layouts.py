"""Layouts of generated problem rows, aliases of their names, trees as rows and as text, and audit reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.storage import checkpointed
from .curate import depth_bucket, mask_last

# The task names of problem families and what they ask for.
TASKS = {
    ("GeneReg-SS", "attractor_id"): "ss_id",
    ("GeneReg-SS", "marker_gene"): "ss_marker",
    ("GeneReg-Dyn", "attractor_id"): "dyn_attr",
    ("GeneReg-Dyn", "marker_gene"): "dyn_marker",
}

LETTERS = 26


def task_name(family: Column, target: Column, tasks: dict[tuple[str, str], str] = TASKS) -> Column:
    """The task of a family and target; null for others."""
    cases = [F.when((family == f) & (target == t), name) for (f, t), name in tasks.items()]
    return F.coalesce(*cases)


def in_name_order(names: Column) -> Column:
    """Names by letters, then number."""
    keyed = F.array_sort(F.transform(names, lambda n: F.struct(tx.natural_key(n).alias("o"), n.alias("n"))))
    return F.transform(keyed, lambda p: p["n"])


def alias_map(names: Column) -> Column:
    """Map from each name, in name order, to A1, B1, … Z1, A2, …; a repeated name counts once."""
    order = in_name_order(F.array_distinct(names))
    letter = lambda i: F.char(F.lit(65) + i % LETTERS)
    return F.map_from_arrays(order, F.transform(order, lambda _, i: F.concat(letter(i), (F.floor(i / LETTERS) + 1).cast("string"))))


def aliased(names: Column, aliases: Column) -> Column:
    """A list of names by their aliases; a name without one gives null."""
    return F.transform(names, lambda n: F.try_element_at(aliases, n))


def aliased_values(values: Column, aliases: Column) -> Column:
    """A map from names to values as one from aliases; names without an alias are left out."""
    return F.transform_keys(F.map_filter(values, lambda n, _: F.map_contains_key(aliases, n)), lambda n, _: F.element_at(aliases, n))


def aliased_rules(rules: Column, aliases: Column) -> Column:
    """Rules (output, rule_type, inputs, constant) by aliases, with the expression that they stand for.

    div_k is floor division; sum_mul_k multiplies the sum of all inputs.
    """

    def one(rule: Column) -> Column:
        inputs, k = aliased(rule["inputs"], aliases), rule["constant"].cast("string")
        a, b, kind = F.get(inputs, F.lit(0)), F.get(inputs, F.lit(1)), rule["rule_type"]
        signs = {"mul_k": " * ", "div_k": " // ", "add_k": " + ", "sub_k": " - "}
        right = F.coalesce(
            F.when(kind == "add_xy", F.concat(a, F.lit(" + "), b)), F.when(kind == "sub_xy", F.concat(a, F.lit(" - "), b)),
            *[F.when(kind == name, F.concat(a, F.lit(sign), k)) for name, sign in signs.items()],
            F.when(kind == "sum_mul_k", F.concat(F.lit("("), F.array_join(inputs, " + "), F.lit(") * "), k)),
        )
        output = F.try_element_at(aliases, rule["output"])
        return F.struct(output.alias("output"), kind.alias("rule_type"), inputs.alias("inputs"), rule["constant"].alias("constant"), F.concat(output, F.lit(" = "), right).alias("expression"))

    return F.transform(rules, one)


def reference_layout(df: DataFrame, leaves: str, relevant: str, held_out: str, numbers: list[str]) -> DataFrame:
    """Generated rows in the layout of problem files: every leaf can be asked for, relevant leaves that aren't held out are
    given, both in name order; lists are JSON text, and a whole number has no decimals."""
    given = F.filter(relevant, lambda n: ~F.array_contains(held_out, n))
    lists = {"possible_questions": in_name_order(F.col(leaves)), "given_conditions": in_name_order(given)}
    kept = [c for c in df.columns if c not in (leaves, relevant, held_out, *numbers)]
    return df.select(
        *kept, *[F.to_json(c).alias(n) for n, c in lists.items()], *[F.to_json(c).alias(c) for c in (leaves, relevant, held_out)],
        *[tx.plain_number(F.col(c).cast("double")).alias(c) for c in numbers],
    )


def held_out_rows(df: DataFrame, text: str, k: str, choices: str) -> DataFrame:
    """One row for each held-out choice, which come best first: sample_id from the text's hash, k and the choice's rank from 1."""
    problem = tx.text_id(F.col(text))
    rows = df.withColumn("problem_id", problem).select("*", F.posexplode(choices).alias("_pos", "held_out")).drop(choices)
    rank = (F.col("_pos") + 1).cast("string")
    return rows.withColumn("sample_id", F.concat("problem_id", F.lit("_k"), F.col(k), F.lit("_"), rank)).drop("_pos")


def result_counts(constraints: Column, variables: Column, cost: Column, tokens: Column) -> Column:
    """struct(num_constraints, num_vars, cost_usd, thinking_tokens) of a result row.

    constraints: JSON text of a list or object, of which entries count; variables: JSON text of an object; both null if
    they are anything else. A missing cost or number of tokens is 0.
    """
    entries = F.size(F.json_object_keys(variables))
    n = F.coalesce(F.json_array_length(constraints), F.size(F.json_object_keys(constraints)))
    return F.struct(
        n.alias("num_constraints"), F.when(entries >= 0, entries).alias("num_vars"), F.coalesce(cost.cast("double"), F.lit(0.0)).alias("cost_usd"), F.coalesce(tokens.cast("long"), F.lit(0)).alias("thinking_tokens"),
    )


def tree_rows(trees: DataFrame, tree: str = "tree") -> DataFrame:
    """(tree, path, trail, type, label): the nodes of nested JSON trees, one round for each depth.

    trees: (tree, json), a node being an object with type, label and either `next`, its only child, or `branches`, from an
    answer to a child. path: a struct (pos, answer) for each step from the root; the answer is null for an only child.
    trail: a struct (type, label, answer) for each node above.
    """
    node = F.from_json("json", "type string, label string, next string, branches map<string,string>")
    root = F.array().cast("array<struct<pos:int,answer:string>>")
    above = F.array().cast("array<struct<type:string,label:string,answer:string>>")
    new = checkpointed(trees.select(tree, root.alias("path"), above.alias("trail"), node.alias("_n")).filter("_n is not null"))
    out = new
    while not new.isEmpty():
        only = F.when(F.col("_n.next").isNotNull() & (F.coalesce(F.col("_n.type"), F.lit("")) != "decision"), F.create_map(F.lit("_next"), F.col("_n.next")))
        below = new.select(tree, "path", "trail", F.col("_n.type").alias("_t"), F.col("_n.label").alias("_l"), F.posexplode(F.coalesce("_n.branches", only)).alias("pos", "answer", "json"), F.col("_n.branches").isNull().alias("_only"))
        answer = F.when(~F.col("_only"), F.col("answer")).alias("answer")
        passed = F.struct(F.col("_t").alias("type"), F.col("_l").alias("label"), answer)
        grown = [F.array_append("path", F.struct("pos", answer)).alias("path"), F.array_append("trail", passed).alias("trail")]
        new = checkpointed(below.select(tree, *grown, node.alias("_n")).filter("_n is not null"))
        out = out.unionByName(new)
    return out.select(tree, "path", "trail", F.col("_n.type").alias("type"), F.col("_n.label").alias("label"))


def _walked(trail: Column) -> Column:
    """Whether a way leads only through assessments, each with an only child, and conditions."""
    return F.forall(trail, lambda n: F.coalesce(((n["type"] == "assessment") & n["answer"].isNull()) | (n["type"] == "condition"), F.lit(False)))


def tree_paths(nodes: DataFrame, tree: str = "tree") -> DataFrame:
    """(tree, path, assessment, conditions, outcome): the ways from the root to a decision, from `tree_rows`.

    conditions: a struct (label, answer) for each condition on the way that branches, from the root on; a condition with
    an only child asks nothing. assessment: the label of the last assessment on the way, null without one.
    """
    last = F.try_element_at(F.filter("trail", lambda n: n["type"] == "assessment"), F.lit(-1))["label"]
    asked = F.filter("trail", lambda n: (n["type"] == "condition") & n["answer"].isNotNull())
    conditions = F.transform(asked, lambda n: F.struct(n["label"].alias("label"), n["answer"].alias("answer")))
    ends = nodes.filter((F.col("type") == "decision") & _walked(F.col("trail")))
    return ends.select(tree, "path", last.alias("assessment"), conditions.alias("conditions"), F.col("label").alias("outcome"))


def tree_questions(paths: DataFrame, most: int, tree: str = "tree") -> DataFrame:
    """(tree, path, k, assessment, context, desired, questions, outcome): each way with its last k conditions asked for, k from 1 to `most`."""
    masked = mask_last(paths, "conditions", most)
    return masked.select(tree, "path", "k", "assessment", "context", "desired", F.transform("desired", lambda c: c["label"]).alias("questions"), "outcome")


def tree_summary(nodes: DataFrame, tree: str = "tree") -> DataFrame:
    """(tree, n_nodes, n_decisions, conditions, category): conditions are the distinct labels that ways lead to, sorted.

    category is the label of the last assessment in the order of reading, `Unknown` where there is none.
    """
    reached, empty = _walked(F.col("trail")), F.coalesce(F.col("label"), F.lit("")) == ""
    order = F.transform("path", lambda p: p["pos"])
    assessed = reached & (F.col("type") == "assessment")
    return nodes.groupBy(tree).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("type") == "decision").alias("n_decisions"),
        F.array_sort(F.collect_set(F.when(reached & (F.col("type") == "condition") & ~empty, F.col("label")))).alias("conditions"),
        F.coalesce(F.max_by("label", F.when(assessed, order)), F.lit("Unknown")).alias("category"),
    )


def tree_text(nodes: DataFrame, tree: str = "tree") -> DataFrame:
    """(tree, text): each tree as indented lines, by depth first. A tree is one document, so a reader can take its text.

    A child stands two blanks deeper, and below an answer, which has a line of its own, four.
    """
    step = lambda n, p: n + F.when(p["answer"].isNull(), 1).otherwise(2)
    blanks = lambda n: F.repeat(F.lit("  "), n)
    indent = F.aggregate("path", F.lit(0), step)
    label = F.coalesce("label", F.lit(""))
    said = F.when(F.col("type") == "assessment", F.concat(F.lit("Assessment: "), label)).when(F.col("type") == "condition", F.concat(F.lit("If "), label, F.lit(":")))
    said = said.when(F.col("type") == "decision", F.concat(F.lit("-> "), label)).otherwise(label)
    answer = F.try_element_at("path", F.lit(-1))["answer"]
    line = F.concat(F.coalesce(F.concat(blanks(indent - 1), answer, F.lit(":\n")), F.lit("")), blanks(indent), said)
    lines = F.array_sort(F.collect_list(F.struct(F.transform("path", lambda p: p["pos"]).alias("at"), line.alias("line"))))
    return nodes.groupBy(tree).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def audit_report(df: DataFrame, picked: DataFrame, key: str, k: str, depth: str, flags: list[str], fields: list[str], title: str) -> DataFrame:
    """(section, pos, line): a report in Markdown: numbers of rows, coverage of the picked rows, and a section for each of them.

    Sections of rows are numbered by the key's order; `picked` is a sample for people to read, which is why a window
    over all of it is fine.
    """
    shares = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c, "n"))), lambda p: F.concat(p["v"], F.lit("="), p["n"])), ", ")
    counted = lambda c: picked.groupBy(c.cast("string").alias("v")).agg(F.count(F.lit(1)).cast("string").alias("n")).agg(shares("v").alias("t"))
    head = [picked.sparkSession.createDataFrame([(f"# {title}",)], "t string")]
    head += [rows.agg(F.concat(F.lit(f"- {name}: "), F.count(F.lit(1))).alias("t")) for name, rows in (("Total rows", df), ("Audited rows", picked))]
    head += [counted(c).select(F.concat(F.lit(f"- {name}: "), "t").alias("t")) for name, c in (("k distribution", F.col(k)), ("depth buckets", depth_bucket(F.col(depth))))]
    head += [picked.agg(F.concat(F.lit(f"- {f}=true: "), F.count_if(F.coalesce(f, F.lit(False))), F.lit("/"), F.count(F.lit(1))).alias("t")) for f in flags]
    lines = reduce(DataFrame.unionByName, [h.select(F.lit(0).alias("section"), F.lit(i).alias("pos"), F.col("t").alias("line")) for i, h in enumerate(head)])
    numbered = picked.withColumn("section", F.row_number().over(Window.orderBy(key)))
    texts = [F.concat(F.lit("## Row "), "section", F.lit(": "), F.col(key).cast("string")), *[F.concat(F.lit(f"- {f}: "), F.coalesce(F.col(f).cast("string"), F.lit("-"))) for f in fields]]
    return lines.unionByName(numbered.select("section", F.posexplode(F.array(*texts)).alias("pos", "line")))
