"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What separates words: the blank and the control characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: Leading bits of the 64-bit order hash that say which bucket of its group a row falls in.
BUCKET_BITS = 12
#: Rows of a bucket beyond which it is cut anew.
MOST_ROWS = 1 << 16
#: Hot buckets, or hashes of hot rows, up to which they are broadcast: a few MB.
MOST_BROADCAST = 100_000

_MIX_1, _MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_fallback_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, on a local master only, a temporary one where that is unset."""
    global _fallback_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _fallback_dir is None:
        _fallback_dir = tempfile.mkdtemp(prefix="tessella-")
    return _fallback_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Spark's file system classes; a session that has ended is no error."""
    if spark.sparkContext._jsc is None:
        return
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors, and gives the planner true sizes."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), "")


def dense_rank_in(df: DataFrame, group: str, key: Column, rank: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """Add `rank`: a gapless number from 0 within `group`, in the order of buckets of a hash of `key`.

    One group may hold most rows, so a group is cut into hash-ordered buckets: counts of (group, bucket) give each
    bucket its offset, and only a bucket's rows meet in one task. One key may hold most rows as well: a bucket of more
    than `most_rows` rows is cut anew by a hash of all columns, into parts of about that size, which follow each other.
    In a bucket or part rows stand in the order of their key's hash; null keys are spread by their other columns. Rows
    that are equal in every column stay together, in any order, as they can't be told apart. Null groups form one group.
    A column named `rank` is replaced. The counts are written to the shared folder once.
    """
    h, b, g, r, o, n, p = (f"__rank_{x}" for x in "hbgronp")
    # types without a hash stay out
    rest = [F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    hashed = df.withColumn(h, F.coalesce(F.when(key.isNotNull(), F.xxhash64(key)), F.xxhash64(*rest))).withColumn(b, F.shiftrightunsigned(h, 64 - BUCKET_BITS))
    keyed = hashed.withColumn(g, F.to_json(F.struct(F.col(group).alias("g"))))
    sizes = materialize(keyed.groupBy(g, b).agg(F.count(F.lit(1)).alias(n)), "rank-sizes").withColumn(p, F.lit(0).cast("long"))
    large = sizes.filter(F.col(n) > most_rows).select(g, b, F.ceil(F.col(n) / most_rows).alias(r))
    if found := large.count():
        parts = keyed.join(F.broadcast(large) if found <= MOST_BROADCAST else large, [g, b], "left")
        keyed = parts.withColumn(p, F.when(F.col(r).isNotNull(), F.pmod(F.xxhash64(h, *rest), F.col(r))).otherwise(F.lit(0))).drop(r)
        cut = keyed.join(F.broadcast(large) if found <= MOST_BROADCAST else large, [g, b], "left_semi").groupBy(g, b, p).agg(F.count(F.lit(1)).alias(n))
        sizes = sizes.filter(F.col(n) <= most_rows).unionByName(cut)
    else:
        keyed = keyed.withColumn(p, F.lit(0).cast("long"))
    before = Window.partitionBy(g).orderBy(b, p).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(g, b, p, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(o))
    # within a bucket the leading bits are equal, so the signed order of the hash is also its unsigned order
    own = Window.partitionBy(g, b, p).orderBy(h)
    ranked = keyed.withColumn(r, F.row_number().over(own) - 1).join(offsets, [g, b, p])
    return ranked.withColumn(rank, F.col(r) + F.col(o)).drop(h, b, g, r, o, p)


def run_starts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(first)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values. Sorting outruns numpy's own unique by far on whole numbers."""
    ordered = np.sort(values)
    return ordered[run_starts(ordered)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX_1
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX_2
    return x ^ (x >> np.uint64(33))


def text_slices(texts: pa.Array, most_bytes: int = 4 << 20):
    """Cut a column of texts into runs of about `most_bytes`; yields (first row, array)."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1)
        yield start, texts.slice(start, end - start)
        start = end


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts with A-Z lower-cased, and each text's number of words.

    `texts` is one of `text_slices`. A hash is a polynomial in the word's bytes, summed for all words of the run at once.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    blank = (data == 32) | ((data - np.uint8(9)) < 5)
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, blank[:-1]
    starts = ~blank & (before | first)
    at = np.flatnonzero(starts)
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    low = data + np.uint8(32) * ((data - np.uint8(65)) < 26)
    place = np.arange(len(data), dtype=np.int64) - at[np.maximum(np.cumsum(starts) - 1, 0)]
    place[blank] = 0
    powers = np.cumprod(np.full(int(place.max()) + 1, _BASE, np.uint64))
    terms = (low.astype(np.uint64) + np.uint64(1)) * powers[np.maximum(place, 0)]
    terms[blank] = 0
    return mix(np.add.reduceat(terms, at)), np.diff(np.searchsorted(at, offsets))
