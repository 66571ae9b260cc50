"""Queries that run a streaming job over the events table to its end and read what it left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import checkpoint_dir
from ..streaming import jobs
from .base import table


#: Event types that an episode's state may hold.
MOST_TYPES = 1000


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream; times as instants."""
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def _place(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _drained(stream: DataFrame, place: str, mode: str) -> DataFrame:
    """Run to the end; each batch appends its output rows with the batch's number."""
    columns = stream.columns

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{place}/out/e={epoch}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{place}/out/*").select(*columns, "_epoch")


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _place(spark, "latest")
    rows = _stream(spark, sf_dir).select("user_id", "event_id", "event_type", "value")
    query = jobs.latest_wins(rows, f"{place}/table", "user_id", "event_id", f"{place}/state")
    query.awaitTermination()
    return jobs.read_latest(spark, f"{place}/table", query)


def stream_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = jobs.metric_board(_stream(spark, sf_dir).withColumn("hit", F.col("value") > 20), ["event_type"], "hit")
    out = _drained(board, _place(spark, "board"), "update")
    latest = out.groupBy("event_type").agg(F.max_by(F.struct("n", "hits", "rate"), "_epoch").alias("r"))
    return latest.select("event_type", "r.n", "r.hits", F.round("r.rate", 6).alias("rate"))


def stream_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").limit(MOST_TYPES + 1).collect()]
    if len(types) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} event types: the state holds a time for each")
    covered = jobs.live_coverage(_stream(spark, sf_dir).select("user_id", "event_type", "ts"), "user_id", "event_type", "ts", types, "36500 days")
    return _drained(covered, _place(spark, "coverage"), "append").select("user_id", F.col("covered_at").cast("timestamp_ntz").alias("covered_at"))


QUERIES = {f.__name__: f for f in (stream_latest, stream_board, stream_coverage)}
ORACLES = {
    "stream_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1",
    "stream_board": "SELECT event_type, count(*) AS n, count(*) FILTER (value > 20) AS hits, round(count(*) FILTER (value > 20) / count(*), 6) AS rate FROM events GROUP BY 1",
    "stream_coverage": "WITH f AS (SELECT user_id, event_type, min(ts) AS t FROM events GROUP BY ALL), n AS (SELECT count(DISTINCT event_type) AS n FROM events) SELECT user_id, max(t)::TIMESTAMP AS covered_at FROM f, n GROUP BY user_id HAVING count(*) = max(n.n)",
}
