"""Scores of an asked set against ground-truth sets, as pure column functions on string arrays.

Three F1 families differ on purpose: `max_f1` and `max_jaccard` ignore case and give 0 for an empty side,
`one_set_f1` drops null matches, and `precision_recall` keeps case and divides by at least one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lowered(xs: Column) -> Column:
    """The set of an array's elements without case."""
    return F.array_distinct(F.transform(xs, F.lower))


def _none(xs: Column) -> Column:
    return F.coalesce(F.size(xs) <= 0, F.lit(True))


def _best(asked: Column, sets: Column, score) -> Column:
    best = let(lowered(asked), lambda a: F.array_max(F.transform(sets, lambda s: let(lowered(s), lambda g: score(a, g)))))
    return F.when(_none(asked) | _none(sets), F.lit(0.0)).otherwise(F.coalesce(F.greatest(best, F.lit(0.0)), F.lit(0.0)))


def max_f1(asked: Column, sets: Column) -> Column:
    """Largest F1 of the asked set with any of the sets; 0 where either side is empty."""
    # 2pr / (p + r) with p = i/|a| and r = i/|g| is 2i / (|a| + |g|)
    return _best(asked, sets, lambda a, g: 2.0 * F.size(F.array_intersect(a, g)) / (F.size(a) + F.size(g)))


def max_jaccard(asked: Column, sets: Column) -> Column:
    return _best(asked, sets, lambda a, g: F.size(F.array_intersect(a, g)) / F.size(F.array_union(a, g)))


def covers_any(asked: Column, sets: Column) -> Column:
    """Whether the asked set holds some non-empty set."""
    return F.coalesce(F.exists(sets, lambda g: (F.size(g) > 0) & (F.size(F.array_except(g, asked)) == 0)), F.lit(False))


def one_set_f1(matched: Column, truth: Column) -> Column:
    """F1 of the matches that aren't null with one set."""
    own = F.array_compact(matched)
    return max_f1(own, F.array(truth))


def one_set_jaccard(asked: Column, truth: Column) -> Column:
    return max_jaccard(asked, F.array(truth))


def question_precision(matched: Column, asked: Column) -> Column:
    """Share of asked questions with a match, by count."""
    return F.when(_none(asked), F.lit(0.0)).otherwise(F.size(F.array_compact(matched)) / F.size(asked))


def precision_recall(pred: Column, truth: Column) -> Column:
    """struct(precision, recall, f1) on case-sensitive sets, denominators at least one."""

    def scored(p: Column, g: Column) -> Column:
        shared = F.size(F.array_intersect(p, g))
        precision, recall = shared / F.greatest(F.size(p), F.lit(1)), shared / F.greatest(F.size(g), F.lit(1))
        f1 = F.when(shared == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))
        return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))

    return let(F.array_distinct(pred), lambda p: let(F.array_distinct(truth), lambda g: scored(p, g)))


def set_report(pred: Column, truth: Column) -> Column:
    """struct of exactness, Jaccard (1 if both are empty), sizes, extra and missing elements and their rates."""

    def report(p: Column, g: Column) -> Column:
        shared, union = F.size(F.array_intersect(p, g)), F.size(F.array_union(p, g))
        extra, missing = F.array_sort(F.array_except(p, g)), F.array_sort(F.array_except(g, p))
        return F.struct(
            ((F.size(extra) == 0) & (F.size(missing) == 0)).alias("exact"),
            F.when(union > 0, shared / union).otherwise(F.lit(1.0)).alias("jaccard"),
            F.size(p).alias("pred_size"), F.size(g).alias("truth_size"), shared.alias("intersection"), union.alias("union"),
            F.size(extra).alias("n_extra"), F.size(missing).alias("n_missing"),
            F.when(F.size(g) > 0, F.size(extra) / F.size(g)).when(F.size(extra) > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("over_rate"),
            F.when(F.size(g) > 0, F.size(missing) / F.size(g)).otherwise(F.lit(0.0)).alias("under_rate"),
            (F.size(extra) - F.size(missing)).alias("signed_difference"), extra.alias("extra"), missing.alias("missing"),
        )

    return let(F.array_distinct(pred), lambda p: let(F.array_distinct(truth), lambda g: report(p, g)))


def matches_any(pred: Column, sets: Column) -> Column:
    """Whether the predicted set equals one of the sets."""
    canonical = lambda x: F.array_sort(F.array_distinct(x))
    return F.coalesce(let(canonical(pred), lambda p: F.exists(sets, lambda g: canonical(g) == p)), F.lit(False))


def numbers_equal(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def choice_correct(chosen: Column, truth: Column) -> Column:
    """Single choice: null or -1 (unparsable) is wrong."""
    return F.coalesce((chosen >= 0) & (chosen == truth), F.lit(False))


def number_verdict(reply: Column, truth: Column) -> Column:
    """struct(said, correct) of a reply that names a whole number or that it isn't sure, in what follows its last `answer:`.

    said: `Not sure`, the first number's digits, or null. truth: a number as text or `Not sure`. Without a truth, or with one
    that is neither, the reply is wrong.
    """
    answer = F.substring_index(F.lower(F.coalesce(reply, F.lit(""))), "answer:", -1)
    number = F.nullif(F.regexp_extract(answer, r"\b([0-9]+)\b", 1), F.lit(""))
    said = F.when(F.contains(answer, F.lit("not sure")), F.lit("Not sure")).otherwise(number)
    whole = lambda x: F.regexp_replace(F.trim(x), r"^0+(?=\d)", "")
    same = F.when(said == "Not sure", truth == "Not sure").otherwise(whole(said) == whole(truth))
    return F.struct(said.alias("said"), F.coalesce(same, F.lit(False)).alias("correct"))


def choice_sets(truth: Column) -> Column:
    """JSON text of a number, a list of numbers or a list of lists as an array of sorted sets; an empty list or anything else is one empty set."""
    nested, flat = F.from_json(truth, "array<array<int>>"), F.from_json(truth, "array<int>")
    single = truth.try_cast("int")
    whole = lambda x: F.array_sort(F.array_distinct(F.array_compact(x)))
    is_nested = truth.rlike(r"^\s*\[\s*\[")
    sets = F.when(single.isNotNull(), F.array(F.array(single))).when(is_nested, F.transform(nested, whole)).when(flat.isNotNull(), F.array(whole(flat)))
    return F.coalesce(sets, F.array(F.array().cast("array<int>")))
