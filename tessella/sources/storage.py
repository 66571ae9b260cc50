"""Where rounds of a loop and intermediate tables are kept."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own_dir: str | None = None


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a local master only, which is then also set for the context."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="tessella-")
        found = _own_dir
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def _written(df: DataFrame) -> str:
    """Write to a new folder in the shared one, which is removed when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read again: cuts the lineage of loops, survives lost executors, and gives the planner true sizes."""
    return df.sparkSession.read.schema(df.schema).parquet(_written(df))


class Pieces:
    """A table that a loop adds to: each piece is written once, and all are read by one scan, so plans keep their shape."""

    #: Pieces after which all are written as one.
    MOST = 64

    def __init__(self, spark: SparkSession, schema: StructType):
        self.spark, self.schema, self.paths = spark, schema, []
        #: Rows of the piece that was added last, and of all that were added.
        self.last = self.rows = 0
        #: What else was counted in the last piece.
        self.seen: dict = {}

    def add(self, df: DataFrame, **counted: Column) -> DataFrame:
        """Write another piece; returns its rows. counted: aggregates over them."""
        if len(self.paths) >= self.MOST:
            self.paths = [_written(self.all())]
        seen = Observation()
        self.paths.append(_written(df.select(*self.schema.names).observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counted.items()])))
        # what is known to be empty is not observed
        self.last, self.seen = seen.get.get("n", 0), seen.get
        self.rows += self.last
        return self.spark.read.schema(self.schema).parquet(self.paths[-1])

    def all(self) -> DataFrame:
        if not self.paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
