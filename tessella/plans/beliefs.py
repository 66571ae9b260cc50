"""Question value over a pool of nations: one episode for each customer, six questions, answers from the customer's nation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import belief
from .base import table

TURNS = 6


def _label(nation: Column, region: Column, turn: Column) -> Column:
    """Five questions about a bit of the nation's key, one about the region; some are judged `pass`."""
    yes = F.when(turn <= 5, F.call_function("shiftright", nation, (turn - 1).cast("int")).bitwiseAND(F.lit(1)) == 1).otherwise(region >= 2)
    return F.when((nation * 7 + turn) % 11 == 0, "pass").when(yes, "yes").otherwise("no")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    turns = F.explode(F.sequence(F.lit(1), F.lit(TURNS)))
    asked = nations.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("candidate"), "n_regionkey", turns.alias("turn"))
    return asked.select("pos", "candidate", "turn", _label(F.col("pos"), F.col("n_regionkey"), F.col("turn")).alias("label"))


def _by_history(spark: SparkSession, sf_dir: str, values: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """Values of each customer's episode, from its answers: those of the customer's nation, of which every thirteenth is turned round."""
    asked = _asked(spark, sf_dir)
    truth = asked.groupBy(F.col("pos").alias("c_nationkey")).agg(F.array_sort(F.collect_list(F.struct("turn", F.col("label").alias("t")))).alias("_truth"))

    def told(x: Column) -> Column:
        wrong = (F.col("c_custkey") + x["turn"]) % 13 == 0
        return F.struct(x["turn"].alias("turn"), F.when(wrong & (x["t"] == "yes"), "no").when(wrong & (x["t"] == "no"), "yes").otherwise(x["t"]).alias("observed"))

    # a few bytes of a customer give many rows, so they are dealt out however few files hold them
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").repartition("c_custkey")
    # the pool of candidates is fixed: 25 nations, six questions
    episodes = customers.join(F.broadcast(truth), "c_nationkey")
    return belief.by_history(episodes.select("c_custkey", F.transform("_truth", told).alias("history")), F.broadcast(asked), values)


def question_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _by_history(spark, sf_dir, belief.question_values)
    return values.select("c_custkey", "turn", *[F.round(c, 5).alias(c) for c in ("entropy_before", "entropy_after", "eig", "eig_share", "support", "pass_mass")])


def episode_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _by_history(spark, sf_dir, lambda judged, by: belief.episode_values(belief.question_values(judged, by), by))
    return out.select("c_custkey", "n_turns", *[F.round(c, 5).alias(c) for c in ("mean_eig", "initial_entropy", "final_entropy", "total_eig")])


def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three likeliest nations after each turn."""

    def top(judged: DataFrame, by: list[str]) -> DataFrame:
        return belief.top_candidates(belief.beliefs(judged, by).withColumn("posterior", F.round("posterior", 9)), by, 3)

    return _by_history(spark, sf_dir, top).select("c_custkey", "turn", "rank", "candidate", F.round("posterior", 5).alias("posterior"))


def pruned_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs that keep only the ten likeliest nations after each turn."""

    def left(judged: DataFrame, by: list[str]) -> DataFrame:
        return belief.pruned_beliefs(judged, by, 10).groupBy(*by, "turn").agg(F.count(F.lit(1)).alias("n_left"), F.round(belief.entropy(F.col("posterior")), 5).alias("entropy"))

    return _by_history(spark, sf_dir, left).select("c_custkey", "turn", "n_left", "entropy")


QUERIES = {f.__name__: f for f in (question_values, episode_values, top_candidates, pruned_beliefs)}

_JUDGED = """q AS (SELECT n_nationkey AS pos, n_name AS candidate, t AS turn, CASE WHEN (n_nationkey * 7 + t) % 11 = 0 THEN 'pass' WHEN CASE WHEN t <= 5 THEN (n_nationkey >> (t - 1)::INT) & 1 = 1 ELSE n_regionkey >= 2 END THEN 'yes' ELSE 'no' END AS label
    FROM nation, range(1, 7) r(t)),
  o AS (SELECT c_custkey, turn, CASE WHEN (c_custkey + turn) % 13 = 0 THEN CASE label WHEN 'yes' THEN 'no' WHEN 'no' THEN 'yes' ELSE label END ELSE label END AS observed FROM customer JOIN q ON pos = c_nationkey),
  j AS (SELECT o.*, pos, candidate, label, ln(CASE WHEN label = observed THEN 0.98 WHEN label = 'pass' THEN 0.5 ELSE 0.02 END::DOUBLE) AS l FROM o JOIN q USING (turn)),
  s AS (SELECT *, sum(l) OVER (PARTITION BY c_custkey, candidate ORDER BY turn) AS a FROM j),
  b AS (SELECT *, exp(a) / sum(exp(a)) OVER w AS posterior, exp(a - l) / sum(exp(a - l)) OVER w AS prior FROM s WINDOW w AS (PARTITION BY c_custkey, turn))"""
_VALUES = """h AS (SELECT c_custkey, turn, -sum(prior * ln(prior + 1e-12)) AS h0, -sum(posterior * ln(posterior + 1e-12)) AS h1, sum(prior) FILTER (label = observed) AS support, coalesce(sum(prior) FILTER (label = 'pass'), 0) AS pass_mass FROM b GROUP BY ALL),
  c AS (SELECT c_custkey, turn, sum(p * (ln(p) - x / p)) AS c FROM (SELECT c_custkey, turn, label, sum(prior) AS p, sum(prior * ln(prior)) AS x FROM b GROUP BY ALL) GROUP BY ALL),
  v AS (SELECT c_custkey, turn, h0 AS entropy_before, h1 AS entropy_after, h0 - c AS eig, (h0 - c) / (h0 + 1e-12) AS eig_share, coalesce(support, 0) AS support, pass_mass FROM h JOIN c USING (c_custkey, turn))"""
ORACLES = {
    "question_values": f"WITH {_JUDGED}, {_VALUES} SELECT c_custkey, turn, round(entropy_before, 5) AS entropy_before, round(entropy_after, 5) AS entropy_after, round(eig, 5) AS eig, round(eig_share, 5) AS eig_share, round(support, 5) AS support, round(pass_mass, 5) AS pass_mass FROM v",
    "episode_values": f"WITH {_JUDGED}, {_VALUES} SELECT c_custkey, count(*) AS n_turns, round(avg(eig), 5) AS mean_eig, round(arg_min(entropy_before, turn), 5) AS initial_entropy, round(arg_max(entropy_after, turn), 5) AS final_entropy, round(sum(eig), 5) AS total_eig FROM v GROUP BY 1",
    "pruned_beliefs": f"""WITH RECURSIVE {_JUDGED.split(",\n  s AS")[0]}, k(c_custkey, turn, pos, m, p) AS (SELECT c_custkey, 0::BIGINT, n_nationkey, 0, 0 FROM customer, nation UNION ALL
      SELECT c_custkey, turn, pos, m, p FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY m * ln(0.98) + p * ln(0.5) + (turn - m - p) * ln(0.02) DESC, pos) AS r
        FROM (SELECT k.c_custkey, j.turn, k.pos, k.m + (label = observed)::INT AS m, k.p + (label <> observed AND label = 'pass')::INT AS p FROM k JOIN j ON j.c_custkey = k.c_custkey AND j.turn = k.turn + 1 AND j.pos = k.pos)) WHERE r <= 10),
      e AS (SELECT *, exp(m * ln(0.98) + p * ln(0.5) + (turn - m - p) * ln(0.02)) AS w FROM k WHERE turn > 0), q2 AS (SELECT *, w / sum(w) OVER (PARTITION BY c_custkey, turn) AS x FROM e)
      SELECT c_custkey, turn, count(*) AS n_left, round(-sum(x * ln(x + 1e-12)), 5) AS entropy FROM q2 GROUP BY ALL""",
    "top_candidates": f"WITH {_JUDGED}, r AS (SELECT c_custkey, turn, row_number() OVER (PARTITION BY c_custkey, turn ORDER BY round(posterior, 9) DESC, pos) AS rank, candidate, round(round(posterior, 9), 5) AS posterior FROM b) SELECT * FROM r WHERE rank <= 3",
}
