"""Projections that shape problems and episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .sample import shuffled


def depth_bucket(depth: Column) -> Column:
    d = depth.cast("string").try_cast("double")
    return F.when(d.isNull(), "unknown").when(d <= 3, "low").when(d <= 6, "mid").otherwise("high")


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes"), F.lit(False))


def flip_problem(df: DataFrame, literal_sets: list[str], known_true: str, known_false: str) -> DataFrame:
    """Every literal negated, and known true and known false facts exchanged; undetermined stays undetermined."""
    flipped = df.withColumns({c: tx.flip_sets(F.col(c)) for c in literal_sets})
    return flipped.withColumns({known_true: F.col(known_false), known_false: F.col(known_true)})


def flip_worlds(worlds: Column) -> Column:
    """Worlds of a flipped problem: array of struct(assignments, target); every value and the target are negated, unknown (null) values stay."""
    other = lambda w: F.transform_values(w["assignments"], lambda _, v: ~v)
    return F.transform(worlds, lambda w: F.struct(other(w).alias("assignments"), tx.negate(w["target"]).alias("target")))


def mask_last(df: DataFrame, conditions: str, most: int) -> DataFrame:
    """One row for each k from 1 to min(most, size): context without the last k conditions, and those as `desired`."""
    n = F.size(conditions)
    rows = df.filter(n > 0).withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), n))))
    return rows.withColumns({"context": F.slice(conditions, F.lit(1), n - F.col("k")), "desired": F.slice(conditions, n - F.col("k") + 1, F.col("k"))})


def problem_text(variables: Column, values: Column, equations: Column, goal: Column, held_out: Column) -> Column:
    """Variables with their values but for the held-out ones, equations in name order, and the goal.

    variables: map name to meaning; values: map name to number; equations: map output to expression.
    """
    names = F.array_sort(F.transform(F.map_keys(variables), lambda n: F.struct(tx.natural_key(n).alias("o"), n.alias("n"))))
    value = lambda n: F.when(~F.array_contains(held_out, n) & F.map_contains_key(values, n), F.concat(F.lit(" = "), tx.plain_number(values[n]))).otherwise(F.lit(""))
    lines = F.transform(names, lambda p: F.concat(p["n"], value(p["n"]), F.lit(": "), variables[p["n"]]))
    rules = F.array_sort(F.transform(F.map_entries(equations), lambda e: F.concat(e["key"], F.lit(" = "), e["value"])))
    return F.concat_ws("\n", F.lit("Variables:"), F.array_join(lines, "\n"), F.lit("Equations:"), F.array_join(rules, "\n"), F.concat(F.lit("Goal: What is "), goal, F.lit("?")))


def clean_text(text: Column) -> Column:
    """Without [...] parts, with single blanks and at most one empty line in a row."""
    t = F.regexp_replace(F.regexp_replace(text, r"\[[^\]]*\]", ""), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r" *\n *", "\n"), r"\n{3,}", "\n\n"))


def choices(options: Column, truth: Column, none: str, seed: int, key: Column) -> Column:
    """struct(options in seeded order with `none` last, indices of true ones; the index of `none` if there are none)."""
    order = F.array_append(shuffled(F.array_distinct(options), seed, key), F.lit(none))
    hits = F.filter(F.transform(order, lambda o, i: F.when(F.array_contains(truth, o), i)), lambda i: i.isNotNull())
    return F.struct(order.alias("options"), F.when(F.size(hits) > 0, hits).otherwise(F.array(F.size(order) - 1)).alias("truth"))


def two_variants(df: DataFrame, full: str, partial: str) -> DataFrame:
    """Each problem as its full text and as its under-specified text."""
    variants = F.array(F.struct(F.lit("full").alias("variant"), F.col(full).alias("text")), F.struct(F.lit("partial").alias("variant"), F.col(partial).alias("text")))
    return df.withColumn("_v", F.explode(variants)).select(*[c for c in df.columns if c not in (full, partial)], "_v.variant", "_v.text")


def episode_limits(budget: Column, k: Column, n_queryable: Column) -> Column:
    """struct(turns, questions a turn): `k` is the sample's k, 0 one turn for all, else a number of turns with one question."""
    n = F.when(budget == "k", k).otherwise(budget.try_cast("int"))
    bulk = n == 0
    return F.struct(F.when(bulk, 1).otherwise(n).alias("turns"), F.when(bulk, F.greatest(F.lit(1), n_queryable)).otherwise(1).alias("questions"))


def missing_count(*fallbacks: Column) -> Column:
    """The first number present, at least one; one if none is."""
    return F.greatest(F.lit(1), F.coalesce(*[f.cast("string").try_cast("int") for f in fallbacks], F.lit(1)))


def available(valid: Column, asked: Column, banned: Column) -> Column:
    return F.array_except(F.array_except(valid, asked), banned)


def asked_status(asked: DataFrame, order: list[str], episode: str, item: str, valid: Column) -> DataFrame:
    """Add status of each asked item in order: duplicate (asked before), invalid, or valid."""
    from pyspark.sql import Window

    w = Window.partitionBy(episode, item).orderBy(*order)
    return asked.withColumn("status", F.when(F.row_number().over(w) > 1, "duplicate").when(~valid, "invalid").otherwise("valid"))


def reasoning_tokens(usage: Column, paths: list[str]) -> Column:
    """The first positive of several fields of a provider's usage JSON, else 0."""
    found = [F.get_json_object(usage, f"$.{p}").try_cast("long") for p in paths]
    return F.coalesce(*[F.when(x > 0, x) for x in found], F.lit(0))


def numbered_labels(text: Column, n: Column) -> Column:
    """Map from index 1..n to label of lines such as `2. yes`; the first line of an index counts, others are left out."""
    line = r"^\s*(\d+)\s*[.):\-]\s*(.+)$"
    rows = F.transform(F.split(text, "\n"), lambda x: F.struct(F.regexp_extract(x, line, 1).try_cast("int").alias("i"), tx.answer_label(F.regexp_extract(x, line, 2)).alias("l")))
    good = F.filter(rows, lambda r: r["i"].between(1, n) & r["l"].isNotNull())
    first = F.filter(good, lambda r, p: ~F.exists(F.slice(good, F.lit(1), p), lambda q: q["i"] == r["i"]))
    return F.map_from_entries(first)
