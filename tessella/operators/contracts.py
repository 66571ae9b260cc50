"""Data contracts: each check gives rows that break it, or a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def key_problems(df: DataFrame, key: str) -> DataFrame:
    """(key, n, problem): null keys and keys that occur twice or more."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    problem = F.when(F.col(key).isNull(), F.lit("null")).when(F.col("n") > 1, F.lit("duplicate"))
    return counts.withColumn("problem", problem).filter("problem is not null")


def missing_properties(found: DataFrame, required: DataFrame, keys: list[str]) -> DataFrame:
    """Required (object, property) rows that the metadata lack or leave empty."""
    present = found.filter(F.trim(F.coalesce("value", F.lit(""))) != "").select(*keys)
    return required.select(*keys).join(present, keys, "left_anti")


def field_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, pos, field, type, nullable, n_rows, n_nulls) of each table: its schema, and one aggregation over its rows."""
    out = None
    for t, df in tables.items():
        kind = lambda i, f: [F.lit(i).alias("pos"), F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.nullable).alias("nullable")]
        each = [F.struct(*kind(i, f), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(f.name).isNull()).alias("n_nulls")) for i, f in enumerate(df.schema)]
        rows = df.agg(F.array(*each).alias("f")).select(F.lit(t).alias("table"), F.inline("f"))
        out = rows if out is None else out.unionByName(rows)
    return out


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def gate(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Add reason: the first gate that a row fails, null if it passes all. Gates that are null count as failed."""
    reason = F.lit(None).cast("string")
    for name, passes in reversed(gates.items()):
        reason = F.when(~F.coalesce(passes, F.lit(False)), F.lit(name)).otherwise(reason)
    return df.withColumn("reason", reason)


def require_none(df: DataFrame, message: str) -> DataFrame:
    """One row that is true; an error where `df` has rows."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.when(F.col("n") == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.col("n").cast("string")))).alias("ok"))


def require_feasible(violations: DataFrame) -> DataFrame:
    """One row that is true, before a run; an error that tells the kinds and their numbers where `metrics.feasibility_violations` has rows."""
    kinds = violations.select("kind", "n").distinct()
    # at most three kinds
    told = kinds.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat(x["kind"], F.lit("="), x["n"].cast("string"))), ", ").alias("t"))
    return told.select(F.when(F.col("t") == "", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("problems can't be run: "), F.col("t")))).alias("ok"))


def with_columns_of(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """The expected columns, null where the table lacks them."""
    have = set(df.columns)
    return df.select(*[F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in expected.items()])
