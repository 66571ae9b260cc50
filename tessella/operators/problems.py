"""Joins, filters and columns of problem tables: eligibility, catalogues, contexts, assignments, equations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .minset import bitstring
from .relate import consistent_states

#: Comes after every place in a text.
_LATE = 1 << 40


def keep_values(df: DataFrame, column: str, wanted: list) -> DataFrame:
    """Rows whose column has a wanted value; an error, at once, if there are none."""
    kept = df.filter(F.col(column).isin(wanted))
    if kept.isEmpty():
        raise ValueError(f"no row has a wanted {column}: {wanted}")
    return kept


def keep_range(df: DataFrame, column: str, least: int, most: int) -> DataFrame:
    """Rows whose size lies from least to most, both included; null is in no range."""
    return df.filter(F.col(column).between(least, most))


def eligible(df: DataFrame, column: str, gates: dict) -> DataFrame:
    """Rows that pass the gate of their own value; values without a gate don't pass. One filter, in place of a union of strata."""
    passes = F.lit(False)
    for value, gate in gates.items():
        passes = passes | ((F.col(column) == value) & gate)
    return df.filter(passes)


def with_catalogue(df: DataFrame, catalogue: DataFrame, key: str, size: str, claimed: str) -> DataFrame:
    """Add problem: missing (no such entry), size (the entry's size isn't the claimed one), or null."""
    entries = catalogue.select(key, F.col(size).alias("_size"))
    problem = F.when(F.col("_size").isNull(), "missing").when(F.col("_size") != F.col(claimed), "size")
    return df.join(entries, key, "left").withColumn("problem", problem).drop("_size")


def outside(df: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose combination of keys isn't allowed."""
    return df.join(allowed.select(*keys).distinct(), keys, "left_anti")


def world_rows(df: DataFrame, key: str, worlds: str) -> DataFrame:
    """One row for each world of a sample, numbered from 0."""
    return df.select(key, F.posexplode(worlds).alias("pos", "world"))


def context_outcomes(states: DataFrame, contexts: DataFrame, basin: DataFrame, marker: int, problem: str = "problem_id") -> DataFrame:
    """(problem, context, n_states, n_attractors, n_on): where the states that agree with a context lead, and how many of
    those attractors have the marker bit set in their smallest state.

    states: (problem, state); contexts: (problem, context, mask, value); basin: (problem, state, attractor_id).
    """
    shown = basin.groupBy(problem, "attractor_id").agg(F.min("state").alias("_least"))
    reached = consistent_states(states, contexts, [problem]).select(problem, "context", "state").join(basin, [problem, "state"]).join(shown, [problem, "attractor_id"])
    on = F.getbit("_least", F.lit(marker)) == 1
    return reached.groupBy(problem, "context").agg(
        F.count(F.lit(1)).alias("n_states"), F.count_distinct("attractor_id").alias("n_attractors"), F.count_distinct(F.when(on, F.col("attractor_id"))).alias("n_on")
    )


def assignment_targets(assignments: DataFrame, derivations: DataFrame, problem: str, goal: Column) -> DataFrame:
    """(problem, truth): yes or no for assignments whose literals, in any order, are those of a derivation; others are dropped.

    assignments: (problem, literals); derivations: (problem, key, target), the key a JSON list of literals.
    """
    entries = derivations.select(problem, F.array_sort(F.array_distinct(tx.string_list(F.col("key")))).alias("_set"), "target")
    asked = assignments.withColumn("_set", F.array_sort(F.array_distinct("literals")))
    truth = F.when(F.col("target") == goal, "yes").when(F.col("target") == F.concat(F.lit("not "), goal), "no")
    return asked.join(entries, [problem, "_set"]).select(problem, truth.alias("truth")).filter("truth is not null")


def truth_of_mode(mode: Column, sets: Column, alternatives: Column, k: Column) -> Column:
    """What counts as right: k as text where ambiguity is asked, the sets where alternatives are forbidden, else all alternatives."""
    as_text = lambda s: F.array_sort(F.transform(s, lambda x: F.array_join(F.array_sort(x), ",")))
    return F.when(mode == "ambiguity", F.array(k.cast("string"))).when(mode == "forbid", as_text(sets)).otherwise(as_text(alternatives))


def unknown_literals(rules: Column, known: Column, goal: Column) -> Column:
    """Names that rules mention, without known ones and the goal, sorted."""
    names = F.transform(F.flatten(rules), lambda x: F.regexp_replace(x, "^not ", ""))
    return F.array_sort(F.array_except(F.array_distinct(names), F.array_append(known, goal)))


def distinct_pairs(df: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs of sets, each once, whatever the order of their elements."""
    return df.select(F.array_sort(F.array_distinct(left)).alias(left), F.array_sort(F.array_distinct(right)).alias(right)).distinct()


def by_appearance(names: Column, text: Column) -> Column:
    """Names in the order in which the text names them first; those it doesn't name come after, in their own order."""
    at = lambda n: F.nullif(F.instr(text, n).cast("long"), F.lit(0))
    keyed = F.transform(names, lambda n: F.struct(F.coalesce(at(n), F.lit(_LATE)).alias("at"), n.alias("n")))
    return F.transform(F.array_sort(keyed), lambda x: x["n"])


def leaf_names(given: Column, valued: Column, defined: Column) -> Column:
    """The given leaves, else names with a value that no equation defines; sorted."""
    return F.array_sort(F.coalesce(F.when(F.size(given) > 0, given), F.array_except(valued, defined)))


def names_in(expressions: Column) -> Column:
    """Every name in a list of expressions, once, sorted."""
    found = F.flatten(F.transform(expressions, lambda e: F.regexp_extract_all(e, F.lit(r"([A-Za-z_]\w*)"), F.lit(1))))
    return F.array_sort(F.array_distinct(found))


def goal_name(text: Column) -> Column:
    """The name in `What is <name>?`; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?i)what\s+is\s+([A-Za-z_]\w*)\s*\?", 1), F.lit(""))


def without_field(key: Column, name: str) -> Column:
    """struct(key, changed): a JSON object's text without a field, and whether it had it."""
    fields = F.from_json(key, "map<string,string>")
    return F.struct(F.to_json(F.map_filter(fields, lambda k, _: k != name)).alias("key"), F.map_contains_key(fields, F.lit(name)).alias("changed"))


def listed_numbers(cell: Column, n: Column) -> Column:
    """A cell that holds a JSON list of numbers, or one number for all of n places, as a list."""
    return F.coalesce(F.from_json(cell, "array<double>"), F.array_repeat(cell.try_cast("double"), n))


def catalogue_text(states: DataFrame, width: int, model: str = "model") -> DataFrame:
    """(model, text): a line for each attractor in the order of its id: its states as bits, joined by arrows.

    states: (model, attractor_id, state). A model's catalogue is one text, so it is bounded by what a reader can take.
    """
    lines = states.groupBy(model, "attractor_id").agg(F.array_join(F.array_sort(F.collect_list("state")), " ").alias("_n"), F.array_sort(F.collect_list("state")).alias("_s"))
    shown = lines.withColumn("line", F.concat(F.col("attractor_id").cast("string"), F.lit(": "), F.array_join(F.transform("_s", lambda s: bitstring(s, width)), " -> ")))
    ordered = F.array_sort(F.collect_list(F.struct("attractor_id", "line")))
    return shown.groupBy(model).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def thinking_trace(df: DataFrame, key: str, sides: dict[str, str]) -> DataFrame:
    """(key, side, pos, content): the thoughts of each side, numbered from 0."""
    out = None
    for side, column in sides.items():
        rows = df.select(key, F.lit(side).alias("side"), F.posexplode(column).alias("pos", "content"))
        out = rows if out is None else out.unionByName(rows)
    return out


def one_of_each_sign(df: DataFrame, problem: str, negative: Column, literals: str, order: Column) -> DataFrame:
    """The first row of each problem and sign in the given order; negative rows with more than one negated literal take no part."""
    negated = F.size(F.filter(literals, lambda x: x.startswith("not ")))
    rows = df.withColumn("negative", negative).filter(~F.col("negative") | (negated <= 1))
    rest = [c for c in rows.columns if c not in (problem, "negative")]
    return rows.groupBy(problem, "negative").agg(F.min_by(F.struct(*rest), order).alias("_r")).select(problem, "negative", "_r.*")
