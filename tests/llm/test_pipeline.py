"""Each stage of the pipeline on what the stage before kept, against plain Python; and odd tables."""

import hashlib

import corpus_pipeline
from tessella.llm import bpe, mixing, neardup, toxicity
from tessella.llm.common import materialize
from tessella.llm.queries import CATEGORIES, labelled, tokenizer_path

from .test_text_operators import ODD, brute_components, quality_counts

SF = "/root/testdata/sf0.001"


def keeps(text):
    """The quality stage's verdict, in plain Python."""
    text = text or ""
    n, chars, symbols, dup, repeat = quality_counts(text)
    lines = sum(bool(x) for x in text.split("\n"))
    letters = sum(c.isalpha() for c in text)
    bad = 10 * symbols > max(n, 1) or chars > 15 * max(n, 1) or chars < 2 * max(n, 1) or 2 * letters < chars or 2 * lines < 3 * dup
    return not (bad or n < 20 or 100 * repeat > 30 * n)


def as_rows(df, names):
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = materialize(corpus_pipeline.filter_quality(spark, docs, SF), "test")
    assert as_rows(kept, names) == as_rows(spark.createDataFrame([r for r in docs.collect() if keeps(r.text)], docs.schema), names)

    clean = materialize(corpus_pipeline.filter_toxic(spark, kept, SF), "test")
    chain = toxicity.fit_chain(kept, labelled(spark, SF), CATEGORIES)
    toxic = {r.doc_id for r in chain.predict(kept).collect() if r.p_toxic >= chain.thresholds.get("toxic", 0.5)}
    assert as_rows(clean, names) == sorted((tuple(r) for r in kept.collect() if r.doc_id not in toxic), key=repr)

    single = materialize(corpus_pipeline.drop_near_duplicates(spark, clean, SF), "test")
    rows = clean.collect()
    first = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in rows], 80) if i == c}
    assert {r.doc_id for r in single.collect()} == first and single.columns == names

    mixed = materialize(corpus_pipeline.mix(spark, single, SF), "test")
    assert as_rows(mixed, names) == as_rows(single, names)
    place = {r.doc_id: (r.global_slot, r.place) for r in mixing.mix_sources(single).collect()}
    files = mixed.selectExpr("doc_id", "_metadata.file_name AS f", "monotonically_increasing_id() AS m").collect()
    order = [place[r.doc_id] for r in sorted(files, key=lambda r: (r.f, r.m))]
    assert order == sorted(order)

    library = bpe._tokenizer(tokenizer_path())
    texts = {r.doc_id: r.text for r in mixed.collect()}
    for r in corpus_pipeline.encode(spark, mixed, SF).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, bpe.ids_array(r.ids).tolist()) == (len(ids), ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_take_odd_and_empty_tables(spark):
    odd = spark.createDataFrame(
        [(i, t, None, f"s{(i or 0) % 2}" if i != 1 else None, None, 5, "x") for i, t in ODD],
        "doc_id long, text string, lang string, source string, n_chars long, slot int, rejected_by string",
    )
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        rows = out.collect()
        assert len(rows) <= len(ODD)
        if name != "bpe":
            assert out.columns == odd.columns and all(r.slot == 5 and r.rejected_by == "x" for r in rows)
        if name in ("mixing", "bpe"):
            assert len(rows) == len(ODD)
        assert stage(spark, odd.limit(0), SF).count() == 0
    assert neardup.drop_near_duplicates(odd.limit(0)).columns == odd.columns
