"""Operators on texts against brute force, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe, common, lm, neardup, quality, toxicity
from tessella.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = random.Random(3)
LONG = " ".join(f"w{RNG.randint(0, 9000)}" for _ in range(60_000))
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE Two"), (6, "a b c d e f g h i j"), (7, "a b c d e f g h i j"), (8, LONG), (9, LONG + " x"), (10, "É Ω ß   　 z \U0001f600 nul\x00 end"),
    (11, "x<|endoftext|> y  <|endoftext|>"), (12, "don't we'll\n\n  so"), (None, "lost"), (None, None), (7, "a b c d e f g h i j"), (13, "line one two three\nline one two three\n\nline one two three"), (14, "\x1c\x1d odd\x85"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Extra columns are named as results and helpers are."""
    rows = [(i, t, None if i == 1 else f"s{(i or 0) % 2}", 5, "q") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, kept string").repartition(3)


def words(text):
    return WORD.findall((text or "").translate(LOW))


def test_word_hashes_tell_words_apart():
    texts = ["", "a  B\x0bc", None, "c b", "longer-wordé a", " "]
    runs = list(common.text_slices(pa.array(texts), 4))
    got = [h for _, run in runs for h in common.word_hashes(run)[0].tolist()]
    counts = [n for _, run in runs for n in common.word_hashes(run)[1].tolist()]
    flat = [w for t in texts for w in words(t)]
    assert counts == [len(words(t)) for t in texts]
    assert len(set(zip(flat, got, strict=True))) == len(set(flat)) == len(set(got))


def test_bpe_equals_the_library(spark, odd):
    path = tokenizer_path()
    coded = bpe.decode(bpe.encode(odd, path, keep=("doc_id", "text", "kept")), path).collect()
    assert len(coded) == len(ODD)
    library = bpe._tokenizer(path)
    for r in coded:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert bpe.ids_array(r.ids).tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(odd.limit(0), path).count() == 0


def test_bpe_random_texts():
    path = tokenizer_path()
    library, encoder = bpe._tokenizer(path), bpe.Encoder(path)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'", ".", ",", "1", "Ω", " ", "<|endoftext|>", "word", "ß", "中", "-", "\r\n", " ", "à"]
    texts = ["".join(RNG.choices(parts, k=RNG.randint(1, 30))) for _ in range(3000)]
    for t, got in zip(texts, encoder.encode(texts), strict=True):
        assert bpe.ids_array(got).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def brute_components(rows, percent=85):
    sets = [(i, words(t)) for i, t in rows]
    sets = [(i, frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])) for i, w in sets]
    up = {i: i for i, _ in sets if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [(i, len(s), root(i) if i is not None else None) for i, s in sets]


def sort(rows):
    return sorted(rows, key=repr)


def test_near_duplicates_of_odd_rows(spark, odd):
    got = neardup.near_duplicates(odd).collect()
    assert sort([(r.doc_id, r.n_shingles, r.component_id) for r in got]) == sort(brute_components(ODD))
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert neardup.near_duplicates(odd.limit(0)).count() == 0
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {i for i, _, c in brute_components(ODD) if i == c}


def test_near_duplicates_of_chains_and_groups(spark, monkeypatch):
    base = [f"t{RNG.randint(0, 500)}" for _ in range(150)]
    rows, text = [], list(base)
    for i in range(40):  # each text one word further from the first
        text[RNG.randrange(150)] = f"n{i}"
        rows.append((100 + i, " ".join(text)))
    for i in range(120):  # copies of one text with a word or two changed
        other = base[::-1]
        for _ in range(RNG.randint(0, 3)):
            other[RNG.randrange(150)] = f"m{RNG.randint(0, 99)}"
        rows.append((1000 - i, " ".join(other)))
    rows += [(2000 + i, " ".join(f"u{RNG.randint(0, 10**6)}" for _ in range(80))) for i in range(30)]
    expected = sort(brute_components(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "TILE", 37)
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    got = neardup.near_duplicates(df).collect()
    assert sort([(r.doc_id, r.n_shingles, r.component_id) for r in got]) == expected


def quality_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = collections.Counter(windows)
    covered = {j for i, g in enumerate(windows) if often[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_and_cascade(spark, odd):
    texts = [t for _, t in ODD] + [" ".join("a b c d e f g h".split() * 9), "a b c d e f g h x a b c d e f g h", " ".join(f"v{i % 40}" for i in range(200)), "# | $ %" * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r for r in quality.features(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality_counts(t)
    rules = quality.default_rules()
    order = quality.plan_cascade(df, rules)
    verdict = lambda o: {r.i: r.rejected_by is None for r in quality.apply_rules(df, order=o).collect()}
    assert verdict(order) == verdict(order[::-1])
    assert quality.apply_rules(odd).count() == len(ODD)
    assert quality.apply_rules(odd.limit(0)).count() == 0


def test_cascade_puts_cheap_rejection_first(spark):
    df = spark.createDataFrame([("x" * 50,)] * 50, "text string")
    rules = {"never": F.length("text") < 0, "always": F.length("text") > 0}
    assert quality.plan_cascade(df, rules)[0] == "always"


def test_cascade_orders_by_rejection_per_cost(spark):
    costs = {"dear": (8.0, 0.4), "cheap": (0.1, 0.1), "idle": (0.1, 0.0), "slow_idle": (1.0, 0.0), "b": (0.2, 0.2)}
    assert quality.ranked(costs) == ["b", "cheap", "dear", "idle", "slow_idle"]
    text = " ".join(f"w{i}" for i in range(4000))
    rows = quality.sample(spark.createDataFrame([(text + str(i),) for i in range(40)], "text string"), sample_rows=40)
    found = quality.measured(rows, quality.default_rules())
    assert rows.count() == 40 and found["base"][0] > found["symbols"][0] and found["base"][1] == found["lines"][1] == found["symbols"][1] == 0
    part = quality.sample(spark.range(4000).selectExpr("concat('t', id) AS text"), sample_rows=400)
    assert 250 < part.count() < 550
    assert quality.plan_cascade(rows.limit(0).select("text"), quality.default_rules()) == sorted(quality.default_rules())


def test_rejected_by_names_the_first_rule(spark):
    df = spark.createDataFrame([("# | $ %" * 30,), ("one two",), (" ".join(f"word{chr(97 + i % 26)}{i % 7}" for i in range(60)),)], "text string")
    order = ["base", "symbols", "word_length", "letters", "lines"]
    assert [r.rejected_by for r in quality.apply_rules(df, order=order).collect()][1:] == ["base", None]
    assert [r.rejected_by for r in quality.apply_rules(df, order=order[::-1]).collect()][0] != "base"


def base_scores(rows):
    tokens = {i: [*words(t), "\n"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total = sum(counts.values())
    p = {i: sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in ws) for i, ws in tokens.items()}
    return {i: (held[i], len(ws), sum(counts[w] > 0 for w in ws), total, p[i]) for i, ws in tokens.items()}


def corpus():
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(RNG.choices(vocabulary, weights, k=RNG.randint(0, 60))) if i % 9 else None) for i in range(400)]


def held_out(df):
    return df.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2)


def test_lm_scores(spark):
    rows = corpus()
    df = held_out(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = {r.doc_id: r for r in lm.score_texts(df).collect()}
    for i, (held, n, known, total, base) in base_scores(rows).items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score <= 0
    cut = {r.doc_id: r for r in lm.score_texts(df, chunk_bytes=50).collect()}  # many small chunks
    assert all(cut[i].score == pytest.approx(got[i].score, rel=1e-9) and cut[i].base_score == pytest.approx(got[i].base_score, rel=1e-9) for i in got)
    assert all(cut[i].n_known == got[i].n_known for i in got)


def test_lm_filter_never_reads_low():
    import numpy as np

    rng = np.random.default_rng(1)
    keys = lm.distinct(rng.integers(0, 1 << 32, 60_000, dtype=np.uint64)).astype(np.uint32)
    counts = np.where(np.arange(len(keys)) % 50 == 0, rng.integers(1, 10**6, len(keys)), 1 + np.arange(len(keys)) % 4)
    bits, data = lm.build_filter(keys, counts)
    levels = lm.probe_filter(keys, bits, data)
    assert (levels >= lm.level(counts)).all() and (levels == lm.level(counts)).mean() > 0.998
    absent = np.setdiff1d(rng.integers(0, 1 << 32, 200_000, dtype=np.uint64).astype(np.uint32), keys)
    assert (lm.probe_filter(absent, bits, data) > 0).mean() < 0.001


def plain_filter(counts):
    """A Bloom filter in plain Python: a set of bits for each segment's entries, with the same hash functions."""
    import numpy as np

    by_segment = collections.defaultdict(list)
    for key, n in counts.items():
        by_segment[key >> 58].append((((key << 6) & (2**64 - 1)) >> 32, 1 + math.floor(math.log(n) / math.log(lm.BASE) + 1e-9)))
    filters = {}

    def mixed(x):
        return int(lm.mix(np.array([x % 2**64], np.uint64))[0])

    def places(key, q, bits):
        entry = mixed(key + q * lm._LEVEL)
        step = mixed(entry) | 1
        return [((((entry + i * step) % 2**64) >> 32) * bits) >> 32 for i in range(1, lm.PROBES + 1)]

    for segment, entries in by_segment.items():
        bits = max(64, -(-sum(q for _, q in entries) * lm.BITS_PER_ENTRY // 64) * 64)
        filters[segment] = bits, {p for key, top in entries for q in range(1, top + 1) for p in places(key, q, bits)}

    def level_of(key):
        if key >> 58 not in filters:
            return 0
        bits, hit = filters[key >> 58]
        q = 0
        while all(p in hit for p in places(((key << 6) & (2**64 - 1)) >> 32, q + 1, bits)):
            q += 1
        return q

    return level_of


def test_lm_scores_equal_a_plain_filter(spark):
    import numpy as np

    rows = corpus()[:120]
    hashes = lambda t: lm.tokens(pa.array([t or ""], pa.large_string()))[0]
    texts = {i: hashes(t) for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    single, pairs = collections.Counter(), collections.Counter()
    for i, ws in texts.items():
        if not held[i]:
            single.update(ws.tolist())
            pairs.update(lm.pair_keys(ws[:-1], ws[1:]).tolist())
    named = {int(lm.word_keys(np.array([w], np.uint64))[0]): n for w, n in single.items()}
    level_of = plain_filter(named | dict(pairs))
    count = lambda key: float(lm.count_of(np.array([level_of(key)]))[0])
    total, distinct = sum(single.values()), len(single)
    got = {r.doc_id: r.score for r in lm.score_texts(held_out(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, ws in texts.items():
        score, before = 0.0, None
        for w in ws:
            c = count(int(lm.word_keys(np.array([w]))[0]))
            v = 0.0 if before is None else count(int(lm.word_keys(np.array([before]))[0]))
            both = 0.0 if before is None else count(int(lm.pair_keys(np.array([before]), np.array([w]))[0]))
            weight = v / (v + lm.BACKOFF)
            score += math.log10(weight * min(1.0, both / max(v, 1.0)) + (1 - weight) * (c + 1) / (total + distinct + 1))
            before = w
        assert got[i] == pytest.approx(score, rel=1e-9)


def test_lm_odd_rows(spark, odd):
    got = lm.score_texts(held_out(odd)).collect()
    assert len(got) == len(ODD) and all(r.n_tokens >= 1 for r in got)
    assert lm.score_texts(held_out(odd.limit(0))).count() == 0
    only_held = lm.score_texts(odd.withColumn("held_out", F.lit(True))).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in only_held)
    unknown = lm.score_texts(odd.withColumn("held_out", F.lit(None).cast("boolean"))).collect()
    assert len(unknown) == len(ODD) and all(r.train_tokens == 0 and r.held_out is None for r in unknown)


def labelled(spark):
    plain = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows, labels = [], []
    for i in range(1200):
        text = RNG.choices(plain, k=30)
        toxic, junk = int(i % 6 == 0), int(i % 5 == 0)
        text += RNG.choices(["vile", "nasty", "rotten"], k=3) * toxic + ["buy", "now"] * junk
        rows.append((i, " ".join(text)))
        labels.append((i, junk, toxic) if i % 2 else (i, None, toxic) if i % 50 == 0 else (i, junk, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, junk int, toxic int")


def test_chain_learns_and_feeds_forward(spark, odd):
    docs, labels = labelled(spark)
    train = labels.filter("doc_id < 800")
    chain = toxicity.fit_chain(docs, train, ["junk", "toxic"])
    held = chain.predict(docs.filter("doc_id >= 800")).join(labels, "doc_id").collect()
    assert sum(r.is_toxic == (r.toxic == 1) for r in held) >= 0.97 * len(held)
    assert len(chain.models[1].earlier) == 1 and len(chain.models[0].earlier) == 0
    out = chain.predict(odd)
    assert out.count() == len(ODD) and set(odd.columns) <= set(out.columns)
    assert hashlib.sha1(str(sorted(r.p_toxic for r in out.collect())).encode()).hexdigest()


def test_chain_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.p_toxic < 1e-6 and not r.is_toxic for r in toxicity.fit_chain(odd, none, ["toxic"]).predict(odd).collect())
    one_kind = spark.createDataFrame([(i, 1) for i in range(1, 14)], "doc_id long, toxic int")
    assert toxicity.fit_chain(odd, one_kind, ["toxic"]).predict(odd.limit(0)).count() == 0
