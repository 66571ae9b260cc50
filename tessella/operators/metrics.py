"""Metrics of episodes: one aggregation per grain, all scopes from one GROUPING SETS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import setscore
from . import contracts, curate


def scoped(df: DataFrame, scopes: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates overall and by each of `scopes`: a scope column is null where its row is of another scope; `scope` names it."""
    sets = [[], *[[s] for s in scopes]]
    cols = [F.col(s) for s in scopes]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *cols)
    name = F.lit("overall")
    for s in scopes:
        name = F.when(F.grouping(s) == 0, F.lit(s)).otherwise(name)
    return grouped.agg(name.alias("scope"), *aggregates)


def macro_accuracy(df: DataFrame, sample: str, correct: str, scopes: list[str]) -> DataFrame:
    """Mean over samples of a sample's share of correct episodes, in each scope. Scope columns depend on the sample."""
    means = df.groupBy(sample, *scopes).agg(F.avg(F.col(correct).cast("double")).alias("_m"))
    return scoped(means, scopes, [F.avg("_m").alias("macro_accuracy")])


def episode_metrics(episodes: DataFrame, scopes: list[str], sample: str = "sample_id", more: tuple[Column, ...] = ()) -> DataFrame:
    """Totals, micro and macro accuracy, answer rate, and averages of questions, F1, Jaccard, tokens, turns and overhead.

    episodes: sample_id, correct, answered, n_questions, k, f1, jaccard, tokens, turns and the scope columns. Episodes
    without a sample have null k, f1 and jaccard: they count in totals, and not in the averages of these.
    """
    d = lambda c: F.avg(F.col(c).cast("double"))
    core = scoped(
        episodes, scopes,
        [
            F.count(F.lit(1)).alias("total_episodes"), d("correct").alias("micro_accuracy"), d("answered").alias("answer_rate"),
            d("n_questions").alias("avg_questions_used"), d("f1").alias("avg_minset_f1"), d("jaccard").alias("avg_minset_jaccard"),
            d("tokens").alias("avg_thinking_tokens"), d("turns").alias("avg_num_turns_used"),
            F.avg((F.col("n_questions") - F.col("k")).cast("double")).alias("avg_overhead_questions"), *more,
        ],
    )
    macro = macro_accuracy(episodes, sample, "correct", scopes)
    on = [core["scope"] == macro["scope"], *[core[s].eqNullSafe(macro[s]) for s in scopes]]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return core.join(macro, condition).select(*[core[c] for c in core.columns], macro["macro_accuracy"])


def question_metrics(episodes: DataFrame, scopes: list[str], sample: str = "sample_id") -> DataFrame:
    """`episode_metrics` of dialogues whose questions are matched with wanted ones, with errors and question-level precision.

    episodes: sample_id, correct, answered, error, asked, matched (the distinct matches), n_matched (questions with a
    match), wanted, tokens, turns, k and the scope columns. F1 is of the matches, Jaccard of the questions as asked.
    """
    rows = episodes.withColumns({
        "n_questions": F.size("asked"), "f1": setscore.one_set_f1(F.col("matched"), F.col("wanted")), "jaccard": setscore.one_set_jaccard(F.col("asked"), F.col("wanted")),
        "precision": F.when(F.size("asked") > 0, F.col("n_matched") / F.size("asked")).otherwise(0.0),
    })
    more = (F.count_if("error").alias("n_episode_errors"), F.avg("precision").alias("avg_question_precision"))
    return episode_metrics(rows, scopes, sample, more)


def scored_rows(df: DataFrame, correct: str, scopes: list[str]) -> DataFrame:
    """Rows, scored rows, accuracy over them, right and wrong ones: overall and in each scope. A null verdict isn't scored."""
    c = F.col(correct)
    return scoped(df, scopes, [
        F.count(F.lit(1)).alias("n_rows"), F.count(c).alias("n_scored"), F.avg(c.cast("double")).alias("accuracy"), F.count_if(c).alias("n_correct"), F.count_if(~c).alias("n_incorrect"),
    ])


def coverage(df: DataFrame, k: str, depth: str, flags: list[str]) -> DataFrame:
    """One row: rows by k and by depth bucket as text, the number of rows with each flag, and of all rows.

    Rows are counted by (k, bucket) first; only these cells, a handful, are listed.
    """
    bucket = curate.depth_bucket(F.col(depth)).alias("_b")
    cells = df.groupBy(F.col(k).alias("_k"), bucket).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(f).alias(f"n_{f}") for f in flags])

    def listed(by: str) -> Column:
        one = F.array_sort(F.collect_set(by))
        every = F.collect_list(F.struct(F.col(by).alias("v"), "_n"))
        total = lambda v: F.aggregate(F.filter(every, lambda x: x["v"] == v), F.lit(0).cast("long"), lambda a, x: a + x["_n"])
        return F.array_join(F.transform(one, lambda v: F.concat(v.cast("string"), F.lit("="), total(v).cast("string"))), ", ")

    return cells.agg(listed("_k").alias("by_k"), listed("_b").alias("by_depth"), *[F.sum(f"n_{f}").alias(f"n_{f}") for f in flags], F.sum("_n").alias("n"))


def pooled_rates(turns: DataFrame, scopes: list[str], flags: list[str]) -> DataFrame:
    """Rates over all turns pooled: turns of long episodes count as often as they occur."""
    return scoped(turns, scopes, [F.avg(F.col(f).cast("double")).alias(f"{f}_rate") for f in flags])


def ever_rates(turns: DataFrame, episode: list[str], scopes: list[str], flags: list[str]) -> DataFrame:
    """Share of episodes in which a flag ever holds, in each scope. Scope columns depend on the episode; null flags don't hold."""
    ever = turns.groupBy(*episode, *scopes).agg(*[F.max(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags])
    return scoped(ever, scopes, [F.count(F.lit(1)).alias("n_episodes"), *[F.avg(F.col(f).cast("double")).alias(f"ever_{f}_rate") for f in flags]])


#: Values between the bounds of a median beyond which the bounds are narrowed before what lies between is sorted.
SORTED = 1_000_000
#: Share of the values on either side of the middle that the next bounds leave in; ten times the error of the quantiles.
MARGIN, ACCURACY = 0.001, 10_000


def medians(df: DataFrame, columns: list[str], most: int = SORTED) -> DataFrame:
    """(column, median) of columns of doubles, exact; a column without values gives no row.

    Approximate quantiles bound the middle, and exact counts below and between the bounds say which ranks are wanted
    there, until at most `most` values, ties not counted, are left for a window. The driver holds a few numbers a column.
    """
    first = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    size = {c: first[f"n_{c}"] for c in columns if first[f"n_{c}"]}
    bounds = {c: (first[f"lo_{c}"], first[f"hi_{c}"]) for c in size}
    below, inside = dict.fromkeys(size, 0), dict(size)
    wide = set(size)
    while wide := {c for c in wide if inside[c] > most and bounds[c][0] < bounds[c][1]}:
        middle = {c: ((size[c] - 1) / 2 - below[c]) / inside[c] for c in wide}
        near = {c: F.when(F.col(c).between(*bounds[c]), F.col(c)) for c in wide}
        ends = {c: [max(0.0, middle[c] - MARGIN), min(1.0, middle[c] + MARGIN)] for c in wide}
        found = df.agg(*[F.percentile_approx(near[c], ends[c], ACCURACY).alias(c) for c in wide]).first()
        counts = df.agg(*[a for c in wide for a in (F.count_if(F.col(c) < found[c][0]).alias(f"below_{c}"), F.count_if(F.col(c).between(*found[c])).alias(f"in_{c}"))]).first()
        for c in list(wide):
            under, held = counts[f"below_{c}"], counts[f"in_{c}"]
            if under > (size[c] - 1) // 2 or under + held <= size[c] // 2 or held == inside[c]:
                wide.discard(c)  # no narrower bounds that hold the middle
            else:
                bounds[c], below[c], inside[c] = tuple(found[c]), under, held
    if not size:
        return df.sparkSession.createDataFrame([], "column string, median double")
    ranks = df.sparkSession.createDataFrame([(c, below[c], (n - 1) // 2, n // 2) for c, n in size.items()], "column string, _below long, _r1 long, _r2 long")
    near = [F.when(F.col(c).between(*bounds[c]), F.col(c)).alias(c) for c in size]
    values = df.select(*near).unpivot([], list(size), "column", "x").filter("x is not null").groupBy("column", "x").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("column").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    # a row for each column
    placed = values.withColumn("_upto", F.sum("_n").over(upto)).join(F.broadcast(ranks), "column")
    at = lambda r: F.min(F.when(F.col("_below") + F.col("_upto") > F.col(r), F.col("x")))
    return placed.groupBy("column").agg(((at("_r1") + at("_r2")) / 2).alias("median"))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, median, min, max, total, n) of each column; what isn't a number is left out. The median is exact."""
    values = [F.nullif(F.col(c).try_cast("double"), F.lit(float("nan"))).alias(c) for c in columns]
    numbers = df.select(*values)
    rest = numbers.unpivot([], columns, "column", "x").groupBy("column").agg(F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"), F.sum("x").alias("total"), F.count("x").alias("n"))
    # a row for each column
    return rest.join(F.broadcast(medians(numbers, columns)), "column", "left").select("column", "mean", "median", "min", "max", "total", "n")


def flag_counts(df: DataFrame, flags: list[str]) -> DataFrame:
    """(flag, n): rows for which each flag is true."""
    long = df.select(*[F.col(f).cast("int").alias(f) for f in flags]).unpivot([], flags, "flag", "x")
    return long.groupBy("flag").agg(F.sum("x").alias("n"))


def outcome_counts(df: DataFrame, outcome: str, by: str, outcomes: list) -> DataFrame:
    """One row for each `by`, one count column for each outcome."""
    counts = [F.count_if(F.col(outcome) == o).alias(f"n_{o}") for o in outcomes]
    return df.groupBy(by).agg(*counts)


def count_map(df: DataFrame, by: str) -> DataFrame:
    """One row with a map from value to its number of rows, ordered by value."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(by).cast("string").alias("k"), "n")))).alias("counts"))


def run_performance(dialogues: DataFrame, won: Column, turns: Column, most: Column) -> DataFrame:
    """Dialogues, success rate, mean length of successes, and mean length with failures counted as the most turns."""
    return dialogues.agg(
        F.count(F.lit(1)).alias("n"), F.avg(won.cast("double")).alias("success_rate"),
        F.avg(F.when(won, turns.cast("double"))).alias("mean_turns_won"), F.avg(F.when(won, turns).otherwise(most).cast("double")).alias("mean_turns_all"),
    )


def call_estimate(config: DataFrame) -> DataFrame:
    """Calls for each dataset and in all: rows * episodes * (calls, or turns * batches where it is a game)."""
    calls = F.col("rows") * F.col("episodes") * F.col("turns") * F.col("batches")
    return config.withColumn("calls", calls).rollup("dataset").agg(F.sum("calls").alias("calls"))


def feasibility(problems: DataFrame, task: str, queryable: str, k: str) -> DataFrame:
    """Per task: number, least and mean queryable variables, least and mean margin over k, and problems without margin."""
    margin = F.col(queryable) - F.col(k)
    return problems.groupBy(task).agg(
        F.count(F.lit(1)).alias("n"), F.min(queryable).alias("min_queryable"), F.avg(F.col(queryable).cast("double")).alias("avg_queryable"),
        F.min(margin).alias("min_margin"), F.avg(margin.cast("double")).alias("avg_margin"), F.count_if(margin < 0).alias("n_violations"),
    )


#: Rows that a report names of each kind of violation.
NAMED = 10


def feasibility_violations(problems: DataFrame, key: str, queryable: str, k: str, canonical: str, most: int = NAMED) -> DataFrame:
    """(kind, n, pos, key, k, n_queryable, missing): how many problems break a rule, and the first `most` of them by key.

    Kinds: `below_k`, fewer queryable variables than k; `none_queryable`; `canonical_missing`, canonical variables
    that aren't queryable, which `missing` names. `queryable` and `canonical` are arrays; null is an empty one. A problem may be of several kinds; a kind without problems has
    no row.
    """
    empty = F.array().cast("array<string>")
    names, wanted = F.coalesce(queryable, empty), F.coalesce(canonical, empty)
    rows = problems.select(F.col(key).alias("key"), F.col(k).alias("k"), F.size(F.array_distinct(names)).alias("n_queryable"), F.array_except(wanted, names).alias("missing"))
    kinds = F.array_compact(F.array(
        F.when(F.col("n_queryable") < F.col("k"), F.lit("below_k")), F.when(F.col("n_queryable") == 0, F.lit("none_queryable")), F.when(F.size("missing") > 0, F.lit("canonical_missing")),
    ))
    broken = rows.withColumn("kind", F.explode(kinds))
    counts = broken.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    first = broken.withColumn("pos", F.row_number().over(Window.partitionBy("kind").orderBy("key", "k"))).filter(F.col("pos") <= most)
    # a row for each of three kinds
    return first.join(F.broadcast(counts), "kind").select("kind", "n", "pos", "key", "k", "n_queryable", "missing")


#: What an episode may tell; a family whose episodes lack one of these has null for it.
TOLD = {"correct": "boolean", "sufficient": "boolean", "turns_to": "double", "turns": "double", "tokens": "double", "eig": "double", "entropy": "double"}


def family_rows(episodes: DataFrame, family: str) -> DataFrame:
    """One row for each family: episodes, accuracy, final sufficiency, turns to it, turns of all and of right ones, tokens, gain and last entropy.

    episodes: family and any of the columns of `TOLD`. Means are of the episodes that have a value.
    """
    rows = contracts.with_columns_of(episodes, {family: "string", **TOLD})
    mean = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(family).agg(
        F.count(F.lit(1)).alias("n"), mean(F.col("correct")).alias("accuracy"), mean(F.col("sufficient")).alias("final_sufficiency"), mean(F.col("turns_to")).alias("turns_to_sufficiency"),
        mean(F.col("turns")).alias("avg_turns"), mean(F.when(F.col("correct"), F.col("turns"))).alias("avg_turns_right"), mean(F.col("tokens")).alias("avg_tokens"),
        mean(F.col("eig")).alias("mean_eig"), mean(F.col("entropy")).alias("mean_final_entropy"),
    )


def least_hard(rows: DataFrame, by: list[str], sets: str, measures: list[str]) -> DataFrame:
    """Of each problem and measure the least, over its sets, of a set's largest value: how hard the easiest set is at worst.

    rows: (by, set, measures), one for each assignment of a set; null measures (not derived) are passed over.
    """
    worst = rows.groupBy(*by, sets).agg(*[F.max(m).alias(m) for m in measures])
    return worst.groupBy(*by).agg(*[F.min(m).alias(m) for m in measures])
