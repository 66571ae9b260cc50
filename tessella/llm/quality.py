"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a boolean column that is true where a document must go; a null counts as false. Rules read counts that are
computed once as columns (`cheap_features`); only the base rule also needs the count of repeated windows, which is by
far the dearest. On a sample each rule's cost (CPU time per row, less that of reading the row) and selectivity (share
it rejects) are measured; rules run in the order of rejection per cost, and a rule is evaluated only for documents
that all rules before it let pass. The order never changes a verdict, only `rejected_by`, which names the first rule
that rejects.

The sample is a share of the rows of every partition; the share follows from the number of rows, so that about
`SAMPLE_ROWS` are drawn.

Null texts count as empty. Empty and blank texts have no words and fail the base rule. Repeated rows get the same
verdict each. Ties between rules go by name. An empty table gives an empty result and the rules' order by name. Extra
columns pass through; columns named as the counts or as `rejected_by` are replaced.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, materialize, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rows of the sample on which costs and selectivities are measured, about; each rule is evaluated REPEATS times.
SAMPLE_ROWS, REPEATS = 2000, 3
CHEAP = ("n_words", "word_chars", "n_symbols", "n_dup_lines")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), BLANKS, "")).cast("long")


def n_symbols(text: Column) -> Column:
    full = F.coalesce(text, F.lit(""))
    return (F.length(full) - F.length(F.translate(full, SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is named; the optimizer doesn't unfold it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _doubled(a: Column, step: int) -> Column:
    """Hashes of runs twice as long, from hashes of runs of `step` words."""
    return _let(
        F.greatest(F.size(a) - step, F.lit(0)),
        lambda n: F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(step + 1), n), lambda x, y: F.xxhash64(x, y)),
    )


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more: sort (hash, place), keep equal neighbours, join their spans."""

    def places(p: Column) -> Column:
        alike = lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"])
        return F.array_sort(F.transform(F.filter(p, lambda x, i: F.coalesce(alike(x, i), F.lit(False))), lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return _let(
        F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        lambda p: F.aggregate(
            places(p),
            start,
            lambda s, i: F.struct((s["n"] + F.least(i - s["last"], F.lit(WINDOW))).alias("n"), i.alias("last")),
            lambda s: s["n"],
        ),
    )


def n_repeat_words(text: Column) -> Column:
    """Words in 8-word windows that the text holds twice or more.

    Hashes of 8 words come from three doublings: pairs, pairs of pairs, pairs of those. Only texts in which a hash
    repeats go on to find the places.
    """
    words = F.transform(words_of(text), lambda w: F.xxhash64(w))
    count = lambda a: F.when(F.size(F.array_distinct(a)) < F.size(a), _covered(a)).otherwise(F.lit(0))
    eights = lambda a: _let(_doubled(a, 1), lambda b: _let(_doubled(b, 2), lambda c: _let(_doubled(c, 4), count)))
    return _let(words, eights).cast("long")


def cheap_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that rules share: n_words, word_chars, n_symbols, n_dup_lines."""
    t = F.col(text)
    return df.withColumns({"n_words": n_words(t), "word_chars": word_chars(t), "n_symbols": n_symbols(t), "n_dup_lines": n_dup_lines(t)})


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """`cheap_features` and n_repeat_words."""
    return cheap_features(df, text).withColumn("n_repeat_words", n_repeat_words(F.col(text)))


def base_rule(text: Column) -> Column:
    """Fewer than 20 words, or over 30 % of them in repeated 8-word windows. Reads n_words; counts windows itself."""
    return F.when(F.col("n_words") < 20, F.lit(True)).otherwise(100 * n_repeat_words(text) > 30 * F.col("n_words"))


def default_rules(text: str = "text") -> dict[str, Column]:
    """The base rule and others, wide enough that prose in any alphabetic language passes; they read `cheap_features`."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "base": base_rule(F.col(text)),
        "symbols": 10 * F.col("n_symbols") > words,
        "word_length": (F.col("word_chars") > 15 * words) | (F.col("word_chars") < 2 * words),
        "letters": 2 * F.length(F.regexp_replace(t, r"\P{L}+", "")) < F.col("word_chars"),
        "lines": F.size(F.filter(F.split(t, "\n"), lambda x: F.length(x) > 0)) * 2 < 3 * F.col("n_dup_lines"),
    }


def sample(df: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """About `sample_rows` rows of all partitions, with the counts that rules read, in the shared folder."""
    share = min(1.0, sample_rows / max(df.count(), 1))
    drawn = df.select(text).sample(share, seed=7)
    return materialize(cheap_features(drawn, text).repartition(4), "quality-sample")


def measured(rows: DataFrame, rules: dict[str, Column], repeats: int = REPEATS) -> dict[str, tuple[float, float]]:
    """(seconds, share rejected) of each rule over the sample: the least of several runs, less the least of an empty one.

    Every run reads all columns of the sample, so that what is left over is the rule's own work.
    """
    total = max(rows.count(), 1)
    touch = F.sum(sum((F.coalesce(F.octet_length(c) if t == "string" else F.lit(8), F.lit(0)) for c, t in rows.dtypes), F.lit(0)))

    def run(rule: Column) -> tuple[float, int]:
        began = time.perf_counter()
        rejected = rows.agg(touch, F.count_if(F.coalesce(rule, F.lit(False)))).first()[1]
        return time.perf_counter() - began, rejected

    run(F.lit(False))  # compiles and opens files
    idle = min(run(F.lit(False))[0] for _ in range(repeats))
    found = {}
    for name in sorted(rules):
        runs = [run(rules[name]) for _ in range(repeats + 1)][1:]
        found[name] = max(min(s for s, _ in runs) - idle, 1e-4), runs[0][1] / total
    return found


def ranked(costs: dict[str, tuple[float, float]]) -> list[str]:
    """Rule names by rejection per cost, highest first; rules that reject nothing come last, the cheapest first; ties by name."""
    return sorted(costs, key=lambda name: (-costs[name][1] / costs[name][0], costs[name][0] if not costs[name][1] else 0.0, name))


def plan_cascade(df: DataFrame, rules: dict[str, Column], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names in the order of the cascade, as measured on a sample of `df`."""
    rows = sample(df, text, sample_rows)
    return ranked(measured(rows, rules)) if not rows.isEmpty() else sorted(rules)


def cascade(rules: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule, in `order`, that rejects the row; null where all let it pass. Later rules don't run then."""
    chain = F.lit(None).cast("string")
    for name in reversed(order):
        chain = F.when(F.coalesce(rules[name], F.lit(False)), F.lit(name)).otherwise(chain)
    return chain


def apply_rules(df: DataFrame, text: str = "text", rules: dict[str, Column] | None = None, order: list[str] | None = None) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and rejected_by: the first rule that rejects the row, or null."""
    rules = default_rules(text) if rules is None else rules
    order = plan_cascade(df, rules, text) if order is None else order
    return cheap_features(df, text).withColumn("rejected_by", cascade(rules, order))
