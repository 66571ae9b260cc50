"""Structured Streaming jobs over append-only logs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


#: Hash buckets of a latest-wins table; also the most rows of a manifest.
BUCKETS = 256


def latest_wins(stream: DataFrame, table: str, key: str, sequence: str, checkpoint: str, buckets: int = BUCKETS):
    """Keep in folder `table` the row of the highest sequence of each key; of equal sequences the row of the larger hash.

    Keys fall in hash buckets. A micro-batch reads and writes the buckets that it touches, and then a manifest: for every
    bucket the folder that holds it. A manifest is one file, moved to its place when all of it is written, and each run of
    a batch has a folder of its own, so readers see a whole table whatever fails. A batch that runs again starts from the
    manifest before it and gives the same table. Null keys are one key; a null sequence comes before all others. Files that later manifests
    don't name stay: `unused_files` lists them. `buckets` is fixed by the table's first batch.
    """
    rest = [c for c in stream.columns if c != key]
    order = F.struct(F.col(sequence), F.xxhash64(*rest))
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        newest = _newest_manifest(spark, table, epoch - 1)
        placed = {} if newest is None else _manifest(spark, table, newest)
        latest = lambda rows: rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")
        # at most one row for each bucket
        touched = sorted(r[0] for r in batch.select(bucket.alias("_bucket")).distinct().collect())
        old = [f"{table}/data/{placed[b]}/_bucket={b}" for b in touched if b in placed]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(*old)) if old else batch
        folder = f"v{epoch}-{uuid.uuid4().hex}"
        latest(rows).withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{table}/data/{folder}")
        named = sorted((placed | dict.fromkeys(touched, folder)).items())
        spark.createDataFrame(named, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/v{epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_MANIFEST = "bucket int, folder string"


def _files(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Paths of the files of a name below a folder; no row where the folder is missing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(folder).select("path")


def _newest_manifest(spark: SparkSession, table: str, most: int | None = None) -> int | None:
    """The newest whole manifest, of those up to a number."""
    wholes = _files(spark, f"{table}/manifest", "*.parquet").select(F.regexp_extract("path", r"/v(\d+)/[^/]+$", 1).cast("long").alias("v"))
    return (wholes if most is None else wholes.filter(F.col("v") <= most)).agg(F.max("v")).first()[0]


def _manifest(spark: SparkSession, table: str, version: int) -> dict[int, str]:
    return {r.bucket: r.folder for r in spark.read.schema(_MANIFEST).parquet(f"{table}/manifest/v{version}").collect()}


def read_latest(spark: SparkSession, table: str, query) -> DataFrame:
    """The table that a finished `latest_wins` query left, by its newest whole manifest, also if the last run had no data."""
    newest = _newest_manifest(spark, table)
    if newest is None:
        raise ValueError(f"no whole version in {table}")
    return spark.read.parquet(*[f"{table}/data/{folder}/_bucket={bucket}" for bucket, folder in sorted(_manifest(spark, table, newest).items())])


def unused_files(spark: SparkSession, table: str) -> DataFrame:
    """(path) of data files that neither the newest whole manifest nor the one before it names: what may be deleted."""
    newest = _newest_manifest(spark, table)
    before = None if newest is None else _newest_manifest(spark, table, newest - 1)
    kept = {f"{folder}/_bucket={b}" for m in (newest, before) if m is not None for b, folder in _manifest(spark, table, m).items()}
    named = spark.createDataFrame([(k,) for k in sorted(kept)], "place string")
    # two manifests name at most two places for each bucket
    files = _files(spark, f"{table}/data", "*.parquet").withColumn("place", F.regexp_extract("path", r"([^/]+/_bucket=\d+)/[^/]+$", 1))
    return files.join(F.broadcast(named), "place", "left_anti").select("path")


def metric_board(stream: DataFrame, by: list[str], flag: str) -> DataFrame:
    """Running counts and rates; ratios come from sums, so update mode needs no history."""
    return stream.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(flag).cast("long")).alias("hits")).withColumn("rate", F.col("hits") / F.col("n"))


class _Coverage(StatefulProcessor):
    """Of an open episode the first time of each needed item, until it is covered; then only that it is."""

    def __init__(self, episode: str, item: str, time: str, needed: list[str]) -> None:
        self.episode, self.item, self.time, self.needed = episode, item, time, frozenset(needed)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getMapState("first", "item string", "at long")
        self.whole = handle.getValueState("whole", "n_seen long, covered boolean, closes long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n, covered, closes = self.whole.get() if self.whole.exists() else (0, False, None)
        latest = timerValues.getCurrentWatermarkInMs() + 1
        for frame in rows:
            n += len(frame)
            times = frame[self.time].dropna()
            latest = max(latest, int(times.max().value // 1_000_000)) if len(times) else latest
            if not covered:
                for name, at in frame[frame[self.item].isin(self.needed)].groupby(self.item)[self.time].min().dropna().items():
                    micros = int(at.value // 1000)
                    if not self.first.containsKey((name,)) or micros < self.first.getValue((name,))[0]:
                        self.first.updateValue((name,), (micros,))
        if not covered:
            found = [at for (at,) in self.first.values()]
            if len(found) == len(self.needed):
                covered = True
                self.first.clear()
                yield pd.DataFrame({self.episode: [key[0]], "covered_at": [pd.Timestamp(max(found), unit="us")], "n_seen": [n]})
        if closes is None or latest > closes:
            if closes is not None:
                self.handle.deleteTimer(closes)
            # fires once the watermark, which lags by the idle time, has passed the last event
            self.handle.registerTimer(latest)
            closes = latest
        self.whole.update((n, covered, closes))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        self.whole.clear()
        return iter(())

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def live_coverage(stream: DataFrame, episode: str, item: str, time: str, needed: list[str], idle: str = "1 hour") -> DataFrame:
    """(episode, covered_at, n_seen): emitted once, at the event that completes the needed items of an episode.

    State: a time of first sight for each needed item until all are seen, and a timer that each later event moves. Rows may
    come in any order within the watermark; an episode that stays idle past the watermark is closed, and one that comes
    back later starts anew. Null items and null times complete nothing. Sets the session's state store to RocksDB,
    which keeps state on disk and not on the heap.
    """
    if not needed:
        raise ValueError("no needed items")
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = f"`{episode}` {stream.schema[episode].dataType.simpleString()}, covered_at timestamp, n_seen long"
    marked = stream.withWatermark(time, idle)
    return marked.groupBy(episode).transformWithStateInPandas(_Coverage(episode, item, time, needed), schema, "append", "eventTime")
