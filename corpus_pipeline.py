"""A training corpus in five stages, each of which calls one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's
docs. All but the last return the columns of documents. Stages 7, 8 and 6 drop what they reject; mixing keeps every
document and writes them in the order of the mix; the last encodes each text and decodes it again, and gives each row
its place in that order as `mix_position`.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import bpe, mixing, neardup, quality, toxicity
from tessella.llm.common import scratch_path
from tessella.llm.queries import CATEGORIES, labelled, tokenizer_path


#: Documents of this similarity or more are near duplicates; op6 has a contract of its own.
NEAR_PERCENT = 80


def _packed(docs: DataFrame) -> DataFrame:
    """Whole rows as `doc` beside the columns that operators read, so that no other column can clash with theirs."""
    return docs.select(F.struct("*").alias("doc"), "doc_id", "text", "source")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.apply_rules(_packed(docs))
    # a filter would be pushed below the counts, which each rule would then compute again
    return judged.select(F.inline(F.when(F.col("rejected_by").isNull(), F.array("doc"))))


def filter_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.fit_chain(docs, labelled(spark, sf_dir), CATEGORIES)
    return chain.predict(_packed(docs)).filter(~F.col("is_toxic")).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs, percent=NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_packed(docs))
    return mixed.repartitionByRange("global_slot", "place").sortWithinPartitions("global_slot", "place").select("doc.*")


def _positioned(docs: DataFrame) -> DataFrame:
    """Add mix_position, from 0: files in the order of their names and rows as they stand in them (or partitions, in memory)."""
    try:
        placed = docs.withColumns({"__file": F.col("_metadata.file_name"), "__at": F.col("_metadata.row_index")})
    except AnalysisException:
        number = F.monotonically_increasing_id()
        placed = docs.withColumn("__at", number).withColumn("__file", F.shiftright("__at", 33).cast("string"))
        placed = placed.withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(F.length("__file"), "__file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    # a row for each file
    return placed.join(F.broadcast(offsets), "__file").withColumn("mix_position", F.col("__offset") + F.col("__at")).drop("__file", "__at", "__offset")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(_positioned(docs), tokenizer_path(), keep=("doc_id", "lang", "source", "n_chars", "mix_position"))
    return coded.withColumns(
        {"n_tokens": (F.octet_length("ids") / 4).cast("long"), "ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)}
    ).drop("decoded")


STAGES = [
    ("quality rules", filter_quality),
    ("toxicity", filter_toxic),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("bpe", encode),
]

#: The classifier's fitted weights can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each stage's output is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        path = scratch_path(spark, "pipeline")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
