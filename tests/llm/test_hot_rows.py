"""One key, or one row, that is a third of a table."""

import pytest
from pyspark.sql import functions as F

from tessella.llm import common, lm, sharding


@pytest.mark.parametrize("hot", [7, None])
def test_ranks_spread_the_rows_of_one_key(spark, hot):
    """A third of 60,000 rows has one key; in parts of about 500 rows the ranks are gapless, and the other keys keep their order."""
    df = spark.range(60_000).select(F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.col("id")).cast("long").alias("k"), F.col("id").alias("x"))
    ranked = common.dense_rank_in(df, "g", F.col("k"), "r", most_rows=500)
    rows = ranked.collect()
    assert ranked.columns == ["g", "k", "x", "r"] and sorted(r.r for r in rows) == list(range(60_000))
    again = {r.x: r.r for r in common.dense_rank_in(df.repartition(7), "g", F.col("k"), "r", most_rows=500).collect()}
    whole = {r.x: r.r for r in common.dense_rank_in(df, "g", F.col("k"), "r", most_rows=1 << 40).collect()}
    order = lambda ranks: [x for x in sorted(ranks, key=ranks.get) if x % 3]
    in_parts = {r.x: r.r for r in rows}
    one_bucket = {r.x for r in df.filter(F.shiftrightunsigned(F.xxhash64("k"), 64 - common.BUCKET_BITS) == F.shiftrightunsigned(F.xxhash64(F.lit(7).cast("long")), 64 - common.BUCKET_BITS)).collect()}
    assert [x for x in order(in_parts) if x not in one_bucket] == [x for x in order(whole) if x not in one_bucket]
    if hot:
        # parts are told by the rows' hash alone, so they are the same for any order of the input but for equal hashes
        assert sorted(in_parts.values()) == sorted(again.values())
        parts = _parts(spark, df, len(one_bucket), 500)
        assert max(parts) <= 700 and sum(parts) == len(one_bucket)


def _parts(spark, df, n, most):
    """Sizes of the parts of the hot bucket."""
    h = F.xxhash64("k")
    bucket = lambda x: F.shiftrightunsigned(x, 64 - common.BUCKET_BITS)
    hot = df.filter(bucket(h) == bucket(F.xxhash64(F.lit(7).cast("long"))))
    return [r["count"] for r in hot.groupBy(F.pmod(F.xxhash64(h, "g", "k", "x"), F.lit(-(-n // most)))).count().collect()]


def test_slots_of_repeated_rows_and_hot_keys_have_no_gaps(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(1)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 500, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    placed = sharding.assign_shards(df, "doc_id", [1.0] * 5).collect()
    for shard in range(5):
        own = sorted(r.slot for r in placed if r.shard == shard)
        assert own == list(range(len(own)))
    assert len({r.shard for r in placed if r.doc_id == 1}) == 1


def _docs(spark):
    hot = spark.range(6000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), F.lit("the same text over and over").alias("text"))
    none = spark.range(70_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(True).alias("held_out"), F.lit(None).cast("string").alias("text"))
    other = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 7 == 2).alias("held_out"), F.concat(F.lit("the text of "), F.col("id"), F.lit(" and more")).alias("text"))
    return hot.unionByName(none).unionByName(other)


def test_repeated_rows_are_scored_once_and_kept(spark):
    df = _docs(spark)
    count = lambda d: {tuple(r)[:-1]: r.n for r in d.groupBy("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 9).alias("b"), F.round("score", 9).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    # large chunks: no row is hot; small ones: two are
    plain, hot = count(lm.score_texts(df)), count(lm.score_texts(df, chunk_bytes=4000))
    assert sum(plain.values()) == 76_300 and max(plain.values()) == 70_000
    assert plain == hot


def test_no_chunk_holds_a_hot_row_more_than_once(spark):
    docs = _docs(spark)
    sizes, size, hot = lm._marked_hot(docs, 500)
    assert hot == 2 and size == docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0]
    once = lm.collapsed(docs, sizes, hot)
    assert once.count() == 302 and once.agg(F.sum("copies")).first()[0] == 76_300
    assert {(r.doc_id, r.text is None): r.copies for r in once.filter("copies > 1").collect()} == {(5, False): 6000, (None, True): 70_000}
    assert lm._marked_hot(docs.limit(0), 500)[1:] == (0, 0)
