"""Archives, pages, vectors, mixing and sharding against brute force, and on odd rows."""

import base64
import hashlib
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tessella.llm import ann, html, mixing, sharding, warc
from tessella.llm.common import scratch_path

RNG = random.Random(4)
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
PAGES = [
    (1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", f"one {FAKE} two {FAKE}WARC/1.0\r\n"), (6, "u", f"one {FAKE} two {FAKE}WARC/1.0\r\n"), (7, "bad\r\nurl", "é　" * 40_000),
    (8, "u", "WARC/1."), (9, "u", "\r\n\r\nContent-Length: 3\r\n\r\n"), (9, "u", "other"), (2, "http://b/", "<p>x</p>"), (None, "n", "null id"), (10, "u", FAKE * 3000), (11, "u", "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n"),
]
KINDS = "page_id long, url string, html string, digest string, block int"


def archived(spark, rows, min_bytes=0, **options):
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], KINDS).repartition(3)
    path = scratch_path(spark, "test-warc")
    warc.write_warc(pages, path, min_bytes=min_bytes)
    return warc.read_warc(spark, path, **options).collect()


def expected(rows, min_bytes=0):
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = len(data) < min_bytes or (-1 if i is None else i) == top[h or ""]
        out.append((f"urn:page:{'' if i is None else i}", "response" if first else "revisit", None if first else f"urn:page:{top[h or '']}", base64.b32encode(hashlib.sha1(data).digest()).decode(), len(data)))
    return sorted(out, key=repr)


def got(records):
    return sorted([(r.record_id, r.record_type, r.refers_to, r.header_digest, r.http_bytes) for r in records], key=repr)


@pytest.mark.parametrize("split", ["128m", "5k"])
def test_warc_round_trip_rejects_magic_in_payloads(spark, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        records = archived(spark, PAGES)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got(records) == expected(PAGES)
    assert got(archived(spark, PAGES, payloads=False)) == expected(PAGES)
    texts = {(r[0], r[2] or "") for r in PAGES}
    for r in records:
        if r.record_type == "response":
            assert r.payload_digest == r.header_digest and r.payload_bytes == r.http_bytes
            number = r.record_id.removeprefix("urn:page:")
            assert (int(number) if number else None, bytes(r.payload).decode()) in texts


def test_warc_small_payloads_stay_responses(spark):
    assert got(archived(spark, PAGES, min_bytes=100)) == expected(PAGES, 100)


def test_warc_of_no_pages(spark):
    assert archived(spark, []) == []


def test_digest_is_base32(spark):
    assert spark.range(1).select(warc.digest(F.lit("abc"))).first()[0] == base64.b32encode(hashlib.sha1(b"abc").digest()).decode()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><a href="/">Home</a></header>
<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice">We use cookies</div><div id=sidebar>Side <a href=x>link</a></div>
<article><h1>Head &amp; line</h1><p>First   para<b>graph</b> is long enough.<br>Next <i>line</i><p>Second one &lt;here&gt; &eacute;.</p><div class="ad-box">Buy</div>
<section class="comments"><p>I disagree with everything in this very long comment text indeed.</p></section><form><input value=z><p>Send</p></form></article><footer>&copy; x</footer></body></html>"""


def test_article_text():
    assert html.main_text(PAGE) == "Head & line First paragraph is long enough. Next line Second one <here> é."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a b"), ("<article><h1>t<p><b>x<br></article><footer>f", "t x"), ("<", "<"), ("a < b", "a < b"), ("<body><script>x", ""),
        ("<ul><li>a<li>b</ul>", "a b"), ("<p>&#x41;&#66;&nbsp;c</p>", "AB c"), ("<div><p>one</p></div></div></p>two", "one two"), ("<p>x<!-- no --><![CDATA[y]]>z", "xz"),
    ],
)
def test_odd_pages(page, text):
    assert html.main_text(page) == text


def test_deep_and_long_pages():
    assert html.main_text("<div>" * 5000 + "deep words" + "</div>" * 5000) == "deep words"
    words = " ".join(f"w{i}" for i in range(100_000))
    assert html.main_text(f"<body><nav><a>m</a></nav><div><p>{words}</p></div></body>") == words


def test_subtree_without_article_tag():
    paragraphs = "".join(f"<p>Sentence number {i} of the story, with enough words in it.</p>" for i in range(8))
    page = f"<body><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><div><div>{paragraphs}</div></div><div><a href=4>four</a></div></body>"
    assert html.main_text(page).startswith("Sentence number 0") and html.main_text(page).endswith("words in it.") and "four" not in html.main_text(page)


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, None), (2, None, None, None)], "page_id long, url string, html string, text string")
    rows = html.extract(pages).collect()
    assert sorted((r.page_id, r.n_chars) for r in rows) == [(1, len(html.main_text(PAGE))), (2, 0), (2, 0)]
    assert html.extract(pages.limit(0)).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score string")


def test_nearest_neighbours(spark):
    rows = [(i, [RNG.gauss(0, 1) for _ in range(20)], 1, "s") for i in range(600)]
    rows += [(600 + i, rows[i][1], 1, None) for i in range(20)]  # ties
    rows += [(700, None, 1, "s"), (701, [0.0] * 20, 1, "s"), (702, [math.nan] * 20, 1, "s"), (703, [math.inf] * 20, 1, "s"), (704, [None] * 20, 1, "s"), (705, [1.0], 1, "s"), (None, [1.0] * 20, 1, "s"), (706, [], 1, "s")]
    found = ann.nearest(vectors(spark, rows), lambda i: i % 50 == 0).collect()
    import numpy as np

    data = {i: np.array(v, np.float32).astype(float) for i, v, _, _ in rows[:620]}
    hits = 0
    for q in range(0, 620, 50):
        best = sorted((math.sqrt(((v - data[q]) ** 2).sum()), i) for i, v in data.items() if i != q)[:10]
        own = sorted([(r["rank"], r.vec_id, r.score) for r in found if r.query_id == q])
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        hits += len({i for _, i, _ in own} & {i for _, i in best})
    assert hits >= 0.9 * 130
    assert {r.query_id for r in found} == set(range(0, 620, 50))


def test_nearest_of_few_and_none(spark):
    few = vectors(spark, [(0, [1.0, 2.0], 1, "s"), (1, [1.0, 2.0], 1, "s"), (2, [5.0, 5.0], 1, "s")])
    assert [(r["rank"], r.vec_id) for r in ann.nearest(few, lambda i: i == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.nearest(few.limit(0), lambda i: i == 0).count() == 0
    assert ann.nearest(few.limit(1), lambda i: i == 0).count() == 0


def documents(spark, sizes):
    rows = [(len(sizes) * j + i, s, "x", 7) for i, (s, n) in enumerate(sizes) for j in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, slot string, block int")


def test_mix_deviates_by_less_than_a_block(spark):
    sizes = [("a", 900), ("b", 300), ("c", 60), (None, 40)]
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.15), (None, 0.05)], "source string, weight double")
    docs = documents(spark, sizes)
    mixed = mixing.mix_sources(docs, weights=weights, block_rows=4, period=100)
    rows = sorted(mixed.collect(), key=lambda r: (r.global_slot, r.place))
    assert len(rows) == 1300 and len({r.doc_id for r in rows}) == len({r.doc_id for r in docs.collect()})
    blocks = list(dict.fromkeys((r.source, r.block) for r in rows))
    assert len({r.global_slot for r in rows}) == len(blocks)
    share = {r.source: r.weight for r in weights.collect()}
    done = dict.fromkeys(share, 0)
    for t, (source, _) in enumerate(blocks, 1):
        done[source] += 1
        if any(done[s] * 4 >= n for s, n in sizes):
            break  # a source has run out
        assert all(abs(done[s] - share[s] * t) < 1 for s in share)
    assert t > 90
    assert all(r.release <= r.slot < r.deadline for r in rows)


def plain_edf(shares):
    """Earliest deadline first, slot by slot, over one period: shares are whole numbers by source."""
    q, done, order = sum(shares.values()), dict.fromkeys(shares, 0), []
    for t in range(q):
        ready = [(math.ceil((done[s] + 1) * q / a), s) for s, a in shares.items() if done[s] < a and done[s] * q // a <= t]
        pick = min(ready)[1]
        order.append((pick, done[pick]))
        done[pick] += 1
    return order


def test_mix_follows_a_plain_schedule(spark):
    rng = random.Random(6)
    shares = {f"s{i:02d}": rng.randint(1, 60) for i in range(12)}
    shares["s03"] += 500 - sum(shares.values()) if sum(shares.values()) < 500 else 0
    weights = spark.createDataFrame([(s, float(a)) for s, a in shares.items()], "source string, weight double")
    docs = documents(spark, [(s, 3 * a) for s, a in shares.items()])
    period = sum(shares.values())
    rows = mixing.mix_sources(docs, weights=weights, block_rows=1, period=period).collect()
    got = [(r.source, r.block) for r in sorted(rows, key=lambda r: r.global_slot)]
    assert got == [(s, i + p * shares[s]) for p in range(3) for s, i in plain_edf(shares)]


def test_mix_rounds_shares_by_less_than_a_slot(spark):
    weights = spark.createDataFrame([("big", 1 / 3), *[(f"t{i}", (2 / 3) / 300) for i in range(300)]], "source string, weight double")
    whole = {r.source: r for r in mixing.whole_weights(weights)[0].collect()}
    q = whole["big"].q
    assert q == mixing.PERIOD and all(abs(r.a - q * r.weight) < 1 for r in whole.values())
    many = spark.createDataFrame([(f"t{i}", 1.0) for i in range(60)], "source string, weight double")
    assert {r.a for r in mixing.whole_weights(many, 10)[0].collect()} == {4}


def deviations(order, target):
    """The largest distance of a source's count from its target at any position."""
    done, worst = dict.fromkeys(target, 0), dict.fromkeys(target, 0.0)
    for t, s in enumerate(order):
        worst[s] = max(worst[s], abs(done[s] - t * target[s]), abs(done[s] + 1 - (t + 1) * target[s]))
        done[s] += 1
    return {s: max(w, abs(done[s] - len(order) * target[s])) for s, w in worst.items()}


def test_mix_does_not_round_small_sources_up(spark):
    """A source beside 2,000 of a ten millionth each, over several periods: all are within a block of the given target."""
    weights = spark.createDataFrame([("big", 1.0), *[(f"t{i}", 1e-7) for i in range(2000)]], "source string, weight double")
    docs = documents(spark, [("big", 60_000), *[(f"t{i}", 1) for i in range(2000)]])
    rows = mixing.mix_sources(docs, weights=weights, block_rows=1).select("source", "global_slot").collect()
    order = [r.source for r in sorted(rows, key=lambda r: r.global_slot)]
    assert len(order) == 62_000 and len({r.global_slot for r in rows}) == 62_000
    total = 1.0 + 2000 * 1e-7
    target = {"big": 1.0 / total, **{f"t{i}": 1e-7 / total for i in range(2000)}}
    assert order[:60_000].count("big") in (59_988, 59_989) and max(deviations(order[:59_900], target).values()) < 1.001


def test_mix_of_pools_within_pools(spark):
    """Weights over many powers of ten take several levels; each level keeps its shares."""
    shares = {f"s{i}": 10.0 ** -i for i in range(13)}
    weights = spark.createDataFrame(list(shares.items()), "source string, weight double")
    whole, table, pools = mixing.levels(weights, 50)
    assert whole.select("level").distinct().count() == len(pools) + 1 > 3 and table.count() >= 13
    docs = documents(spark, [(s, 400 if i == 0 else 5) for i, s in enumerate(shares)])
    rows = mixing.mix_sources(docs, weights=weights, block_rows=1, period=50).collect()
    assert len({r.global_slot for r in rows}) == len(rows) == docs.count()
    for s in shares:
        own = sorted((r for r in rows if r.source == s), key=lambda r: r.global_slot)
        assert [r.block for r in own] == list(range(len(own)))


def test_mix_of_many_sources_takes_little_time(spark):
    rng = random.Random(4)
    shares = {f"s{i}": rng.choice([0.5, 1.0, 2.0, 3.5, 10.0 * rng.random()]) for i in range(5000)}
    weights = spark.createDataFrame(list(shares.items()), "source string, weight double")
    total = sum(shares.values())
    docs = documents(spark, [(s, max(1, round(20_000 * w / total))) for s, w in shares.items()])
    began = time.perf_counter()
    rows = mixing.mix_sources(docs, weights=weights, block_rows=1).select("source", "global_slot").collect()
    assert time.perf_counter() - began < 120
    order = [r.source for r in sorted(rows, key=lambda r: r.global_slot)]
    # up to where the first source has run out
    worst = deviations(order[:10_000], {s: w / total for s, w in shares.items()})
    assert max(worst.values()) < 1.0 + 10_000 / mixing.PERIOD


def test_mix_odd_weights(spark):
    docs = documents(spark, [("a", 70), ("b", 40), (None, 20), ("zero", 20), ("other", 5)])
    weights = spark.createDataFrame([("a", 2.0), ("b", 1.0), (None, 1.0), ("zero", 0.0), ("absent", 5.0), ("other", None)], "source string, weight double")
    rows = sorted(mixing.mix_sources(docs, weights=weights, block_rows=4).collect(), key=lambda r: (r.global_slot, r.place))
    assert len(rows) == docs.count() and [r.source in ("zero", "other") for r in rows] == [False] * 130 + [True] * 25
    assert len({r.global_slot for r in rows}) == len({(r.source, r.block) for r in rows})
    assert all((r.slot is None) == (r.source in ("zero", "other")) for r in rows)
    none = spark.createDataFrame([], "source string, weight double")
    assert mixing.mix_sources(docs, weights=none).count() == docs.count()
    for bad in ([("a", 1.0), ("a", 2.0)], [("a", -1.0)], [("a", math.nan)], [("a", math.inf)]):
        with pytest.raises(ValueError):
            mixing.mix_sources(docs, weights=spark.createDataFrame(bad, "source string, weight double"))


def test_mix_default_weights_and_empty(spark):
    docs = documents(spark, [("big", 500), ("small", 20)])
    assert mixing.mix_sources(docs).count() == 520
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    one = mixing.mix_sources(documents(spark, [("only", 50)])).collect()
    assert sorted((r.global_slot, r.place) for r in one) == [(i // 16, i % 16) for i in range(50)]


def test_shards(spark):
    rows = [(i, "t", 3) for i in range(4000)] + [(None, "t", 3), (None, "u", 3), (5, "t", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(5)
    out = sharding.assign_shards(df, "doc_id", [1.0] * 40, 1.0).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert r.grown_shard in (r.shard, 40)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values()) and set(by) == set(range(40))
    assert len({r.shard for r in out if r.doc_id is None}) == 1 and len({r.shard for r in out if r.doc_id == 5}) == 1
    moved = sum(r.grown_shard == 40 for r in out)
    assert 40 <= moved <= 180
    heavy = sharding.rendezvous(df, "doc_id", [3.0, 1.0]).groupBy("shard").count().collect()
    assert 0.7 < {r.shard: r["count"] for r in heavy}[0] / len(rows) < 0.8
    assert sharding.assign_shards(df.limit(0), "doc_id", [1.0], 1.0).count() == 0
    same = {r.doc_id: r.shard for r in sharding.rendezvous(df.repartition(2), "doc_id", [1.0] * 40).collect()}
    assert all(same[r.doc_id] == r.shard for r in out)
