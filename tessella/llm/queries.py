"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, credentials, html, lm, merkle, mixing, neardup, negatives, quality, sharding, toxicity, warc
from .common import scratch_path

TOKENIZER = "byte_bpe_50k.json"
SHARDS = 40
CATEGORIES = ["low_quality", "toxic"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The file of a public tokenizer that is installed beside the library."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    records = warc.read_warc(spark, path, payloads=False)
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, 'urn:page:(-?[0-9]+)', 1), '') as bigint)")
    revisit = F.col("record_type") == "revisit"
    return records.select(
        number("record_id").alias("page_id"),
        F.when(revisit, F.col("http_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("header_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs).select("doc_id", "source", "block", "period", "slot", "release", "deadline", "global_slot", "place")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    return lm.score_texts(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.default_rules()
    order = quality.plan_cascade(docs, rules)
    # the result holds the count of repeated windows, so the base rule reads it here
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counted = quality.features(docs).withColumn("base_failed", failed)
    judged = counted.withColumn("rejected_by", quality.cascade(rules | {"base": F.col("base_failed")}, order))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and a 0/1 column for each category."""
    return table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit_chain(docs, labelled(spark, sf_dir), CATEGORIES)
    return chain.predict(docs).select("doc_id", "p_low_quality", "p_toxic", "is_toxic")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law")
    )
    return sharding.assign_shards(docs, "doc_id", [1.0] * SHARDS, grown_weight=1.0).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), lambda i: i % 100 == 0)


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*credentials.CERTAIN))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in credentials.CERTAIN], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents").select(*fields)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # a null id has no decimal, so its row stays as it is
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf_of(*[lowered if f == "text" else F.col(f) for f in fields]))
    rows = merkle.manifest(docs.withColumn("tampered", tampered), fields, "lang", "doc_id", ("doc_id", "tampered"))
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root")
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), folded)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_bpe, op3_ann, op4_mixing, op5_lm, op6_neardup, op7_quality, op8_toxicity, op9_sharding, op10_html,
        op11_negatives, op12_secrets, op13_merkle,
    )
}

_B32 = " || ".join(
    f"translate(lpad(to_base(('0x' || substr(h, {at}, 10))::BIGINT, 32), 8, '0'), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
    for at in (1, 11, 21, 31)
)
#: Words, counts and repeated windows of a document, as DuckDB computes them; shared by op7 and the pipeline.
QUALITY_SQL = r"""
d AS (SELECT *, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w,
             [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM {docs}),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id),
f AS (SELECT d.*, len(w)::BIGINT AS n_words, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(coalesce(text, ''), '\P{{L}}+', '', 'g')) AS letters,
             len([x FOR x IN string_split(coalesce(text, ''), chr(10)) IF length(x) > 0]) AS full_lines
      FROM d LEFT JOIN cov USING (doc_id)),
q AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             10 * n_symbols > greatest(n_words, 1) OR word_chars > 15 * greatest(n_words, 1) OR word_chars < 2 * greatest(n_words, 1)
             OR 2 * letters < word_chars OR full_lines * 2 < 3 * n_dup_lines AS rejected FROM f)"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _climb(k: int, a: str = "a", p: str = "p") -> str:
    """SQL of one level: nodes and paths of groups that have more than one node left go up, others stay."""
    up = "CASE WHEN n > 1 THEN i // 8 ELSE i END"
    left, right = "array_to_string(hs[1:(p.i % 8)::INT], '')", "array_to_string(hs[(p.i % 8)::INT + 2:], '')"
    return f"""{a}{k + 1} AS (SELECT lang, {up} AS i, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (n + 7) // 8 AS n FROM {a}{k} GROUP BY lang, n, {up}),
    {p}x{k} AS (SELECT lang, i // 8 AS run, list(h ORDER BY i) AS hs, n FROM {a}{k} GROUP BY lang, n, i // 8),
    {p}{k + 1} AS (SELECT doc_id, p.lang, leaf, subroot, {up.replace(" i ", " p.i ")} AS i, CASE WHEN n > 1 THEN sha256({left} || f || {right}) ELSE f END AS f, CASE WHEN n > 1 THEN proof || {left} || {right} ELSE proof END AS proof
      FROM {p}{k} p JOIN {p}x{k} x ON x.lang IS NOT DISTINCT FROM p.lang AND x.run = p.i // 8)"""


def _merkle_sql(levels: int) -> str:
    """SQL of the manifest and its check, for groups of up to 8 ** levels leaves and up to 64 groups."""
    step = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    bits = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, i: " + step.format("a") + ", xor(c, x))"
    crc = f"xor(list_reduce([ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')], lambda c, x: {bits}, 4294967295), 4294967295)"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return ",\n".join([
        f"WITH d AS (SELECT doc_id, lang, {_leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {_leaf(low)} END AS bad FROM documents)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
        "a0 AS (SELECT lang, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM r)",
        "p0 AS (SELECT doc_id, lang, leaf, NULL::VARCHAR AS subroot, i, coalesce(bad, leaf) AS f, '' AS proof FROM r)",
        *[_climb(k) for k in range(levels)],
        f"b0 AS (SELECT '' AS lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n, lang AS was FROM a{levels})",
        f"q0 AS (SELECT doc_id, '' AS lang, leaf, h AS subroot, b.i, f, proof FROM p{levels} p JOIN b0 b ON b.was IS NOT DISTINCT FROM p.lang)",
        _climb(0, "b", "q"),
        _climb(1, "b", "q"),
    ]) + "\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM q2, b2"


_NEGATIVES_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_dot_product(a.q, r.q)::BIGINT AS score FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""

ORACLES = {
    "op1_warc": f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, upper(sha1(b)) AS h FROM p),
        e AS (SELECT page_id, payload_bytes, {_B32} AS payload_digest FROM d), m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM e)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to FROM m""",
    "op7_quality": "WITH " + QUALITY_SQL.format(docs="documents")
    + " SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM q",
    "op11_negatives": _NEGATIVES_SQL,
    "op13_merkle": _merkle_sql(9),
}
