"""Dialogue turns and turn logs: pairing, duplicates, sufficiency, running flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_replies(messages: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pair, turn, question, answer): each user reply with the assistant message just before it.

    Empty and system messages are ignored; of several assistant messages the last counts; a user reply clears it, so a
    second user reply in a row pairs with nothing and gives no row.
    """
    said = messages.filter(F.col(role).isin("user", "assistant") & (F.trim(F.coalesce(F.col(text), F.lit(""))) != ""))
    w = Window.partitionBy(conv).orderBy(order)
    pairs = said.withColumn("_role", F.lag(role).over(w)).withColumn("question", F.lag(text).over(w))
    pairs = pairs.filter((F.col(role) == "user") & (F.col("_role") == "assistant"))
    return pairs.select(conv, F.row_number().over(w).alias("pair"), F.col(order).alias("turn"), "question", F.col(text).alias("answer"))


def flag_repeats(pairs: DataFrame, conv: str = "conv_id", order: str = "pair", question: str = "question") -> DataFrame:
    """Add is_repeat: the question was asked before in the dialogue, in any case."""
    w = Window.partitionBy(conv, F.lower(question)).orderBy(order)
    return pairs.withColumn("is_repeat", F.row_number().over(w) > 1)


def latest_per_key(log: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key in log order, by one aggregation (no window, no sort)."""
    rest = [c for c in log.columns if c not in keys]
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return latest.select(*keys, "_r.*")


def turns_to_clarity(logs: Column) -> Column:
    """Ambiguous turns plus one, if the last turn isn't ambiguous; null without turns or with an ambiguous last turn."""
    clear = ~F.try_element_at(logs, F.lit(-1))["is_ambiguous"]
    return F.when(clear, F.size(F.filter(logs, lambda t: t["is_ambiguous"])) + 1)


def turn_of_coverage(asks: DataFrame, needs: DataFrame, episode: list[str], turn: str = "turn", item: str = "item") -> DataFrame:
    """(episode, n_needed, covered_at): the first turn by which all needed items were asked; null if never.

    asks: (episode, turn, item); needs: (episode, item). Episodes without needs give no row.
    """
    first = asks.groupBy(*episode, item).agg(F.min(turn).alias("_t"))
    joined = needs.select(*episode, item).distinct().join(first, [*episode, item], "left")
    n = joined.groupBy(*episode).agg(F.count(F.lit(1)).alias("n_needed"), F.count("_t").alias("_n"), F.max("_t").alias("_t"))
    return n.select(*episode, "n_needed", F.when(F.col("_n") == F.col("n_needed"), F.col("_t")).alias("covered_at"))


def running_ambiguity(turns: DataFrame, episode: str, order: list[str], flag: str) -> DataFrame:
    """Add still_ambiguous: whether every question so far left the episode ambiguous."""
    w = Window.partitionBy(episode).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumn("still_ambiguous", F.min(F.col(flag).cast("int")).over(w) == 1)


def carry_header(lines: DataFrame, doc: str, order: str, is_header: Column, header: Column) -> DataFrame:
    """Add section: the last header line at or before each line."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("section", F.last(F.when(is_header, header), ignorenulls=True).over(w))


def log_breaks(log: DataFrame, group: str, order: str, index: str, start: int = 0) -> DataFrame:
    """Rows whose index isn't start + offset in the log."""
    w = Window.partitionBy(group).orderBy(order)
    return log.withColumn("expected", F.row_number().over(w) - 1 + start).filter(F.col(index) != F.col("expected"))


def signature_breaks(log: DataFrame, rows: DataFrame, index: str, signature: str) -> DataFrame:
    """(index, signature, expected, problem): lines of a log that don't belong to the rows that it is resumed for.

    `rows` hold the signature that each index must have. problem: `unknown` index, `signature` of another row (a null
    equals a null only), or `twice`, an index that several lines name; the first of these that holds.
    """
    lines = log.groupBy(index, signature).agg(F.count(F.lit(1)).alias("_n"))
    named = lines.groupBy(F.col(index).alias("_i")).agg(F.sum("_n").alias("_all"))
    wanted = rows.select(F.col(index).alias("_w"), F.col(signature).alias("expected")).withColumn("_known", F.lit(True))
    found = lines.join(named, F.col(index).eqNullSafe(F.col("_i"))).join(wanted, F.col(index) == F.col("_w"), "left")
    problem = F.when(F.col("_known").isNull(), "unknown").when(~F.col(signature).eqNullSafe(F.col("expected")), "signature").when(F.col("_all") > 1, "twice")
    return found.withColumn("problem", problem).filter("problem is not null").select(index, signature, "expected", "problem")


def compact_transcript(messages: DataFrame, conv: str, order: str, role: str, text: str) -> DataFrame:
    """(conv, system, transcript): system text, and other messages as `Guesser:` and `Answerer:` lines."""
    names = F.when(F.col(role) == "assistant", F.lit("Guesser: ")).otherwise(F.lit("Answerer: "))
    lines = F.array_sort(F.collect_list(F.when(F.col(role) != "system", F.struct(F.col(order).alias("o"), F.concat(names, text).alias("t")))))
    system = F.array_sort(F.collect_list(F.when(F.col(role) == "system", F.struct(F.col(order).alias("o"), F.col(text).alias("t")))))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["t"]), "\n")
    return messages.groupBy(conv).agg(joined(system).alias("system"), joined(lines).alias("transcript"))
