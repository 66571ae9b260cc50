"""Coverage of episodes as events come in files, one micro-batch each."""

import uuid

import pytest

from tessella.streaming import jobs

SCHEMA = "user long, kind string, ts timestamp"


def _run(spark, tmp_path, batches, needed, idle):
    """Rows that each batch emits; a batch is (user, kind, seconds) rows."""
    place, out = tmp_path / uuid.uuid4().hex, []
    for rows in batches:
        data = spark.createDataFrame(rows, "user long, kind string, s long").selectExpr("user", "kind", "timestamp_seconds(s) AS ts")
        data.coalesce(1).write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{place}/in")
        got = []
        keep = lambda batch, _: got.extend((r.user, r.at, r.n_seen) for r in batch.selectExpr("user", "unix_seconds(covered_at) AS at", "n_seen").collect())  # noqa: B023, E731
        covered = jobs.live_coverage(stream, "user", "kind", "ts", needed, idle)
        covered.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
        out.append(sorted(got))
    return out


def test_emitted_once_by_the_earliest_times_across_batches(spark, tmp_path):
    batches = [
        [(1, "a", 100), (1, "other", 110), (2, "a", 100), (3, None, 100)],
        [(1, "b", 90), (1, "a", 50), (2, "b", 130), (2, "a", 140)],
        [(1, "b", 10), (2, "b", 1), (3, "b", 105), (3, "a", 101), (3, "b", None)],
    ]
    got = _run(spark, tmp_path, batches, ["a", "b"], "1 day")
    assert got == [[], [(1, 90, 4), (2, 130, 3)], [(3, 105, 4)]]


def test_idle_episodes_are_closed_and_start_anew(spark, tmp_path):
    batches = [[(1, "a", 100), (2, "a", 100)], [(9, "a", 5000)], [(9, "a", 5001)], [(1, "b", 5100), (2, "a", 5100), (2, "b", 5101)]]
    got = _run(spark, tmp_path, batches, ["a", "b"], "60 seconds")
    assert got == [[], [], [], [(2, 5101, 2)]]


def test_no_needed_items(spark):
    with pytest.raises(ValueError):
        jobs.live_coverage(spark.createDataFrame([], SCHEMA), "user", "kind", "ts", [])
