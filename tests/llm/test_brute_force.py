"""Sharding and the classifier chain against plain Python."""

import math
import random
import struct

import numpy as np
import pyarrow as pa
import xxhash

from tessella.llm import common, sharding, toxicity

RNG = random.Random(21)


def spark_hash(*values):
    """xxhash64 as Spark computes it: each value is hashed with the hash so far as its seed."""
    seed = 42
    for v, kind in values:
        data = v.encode() if kind == "s" else struct.pack("<" + kind, v)
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed


def score(key, shard, weight):
    draw = ((spark_hash((str(key), "s"), (shard, "i")) >> 11) + 0.5) / (1 << 53)
    return weight / -math.log(draw)


def test_shards_equal_plain_rendezvous(spark):
    weights = [1.0, 2.5, 0.5, 1.0, 4.0]
    ids = RNG.sample(range(-(10**9), 10**12), 700)
    df = spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in sharding.assign_shards(df, "doc_id", weights, 1.5).collect()}
    shards = {}
    for i in ids:
        best = max(range(5), key=lambda s: (score(i, s, weights[s]), -s))
        grown = 5 if score(i, 5, 1.5) > score(i, best, weights[best]) else best
        assert (got[i].shard, got[i].grown_shard) == (best, grown)
        shards.setdefault(best, []).append(i)
    for members in shards.values():
        order = sorted(members, key=lambda i: spark_hash((i, "q")))
        assert [got[i].slot for i in order] == list(range(len(order)))


def test_shards_of_null_keys_and_odd_columns(spark):
    df = spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, id AS n, map(id, 'x') AS m, 3 AS shard FROM range(500)")
    rows = sharding.assign_shards(df, "doc_id", [1.0] * 4, 1.0).collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(500))
    assert sharding.assign_shards(df.limit(0), "doc_id", [1.0] * 4, 1.0).count() == 0


def newton(x, y):
    """Penalised logistic regression to the minimum; the last column of x is the constant, which isn't penalised."""
    w, penalty = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, toxicity.PENALTY), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (p - y) / len(y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(penalty + 1e-12)
        w -= np.linalg.solve(curve, slope)
    return w


class Plain:
    """One model of a chain over sets of features."""

    def __init__(self, sets, earlier, y):
        counts = {}
        for s in sets:
            for f in s:
                counts[f] = counts.get(f, 0) + 1
        self.place = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= toxicity.MIN_DOCS))}
        self.w = newton(self.matrix(sets, earlier), np.array(y, float))

    def matrix(self, sets, earlier):
        x = np.zeros((len(sets), len(self.place)))
        for row, s in enumerate(sets):
            for f in s:
                if f in self.place:
                    x[row, self.place[f]] = 1
        return np.column_stack([x, np.array(earlier, float).reshape(len(sets), -1), np.ones(len(sets))])

    def predict(self, sets, earlier):
        return 1 / (1 + np.exp(-self.matrix(sets, earlier) @ self.w))


def test_chain_equals_a_plain_loop(spark):
    """Out-of-fold probabilities, thresholds and predictions of two categories, by one loop over folds."""
    words = [f"w{chr(97 + i)}{chr(97 + i % 7)}" for i in range(26)]
    texts, labels = [], []
    for _ in range(260):
        junk, toxic = int(RNG.random() < 0.35), int(RNG.random() < 0.3)
        t = RNG.choices(words, k=12) + ["buy", "now"] * (junk and RNG.random() < 0.9) + ["vile", "rot"] * (toxic and RNG.random() < 0.85) + ["vile"] * (RNG.random() < 0.05)
        RNG.shuffle(t)
        texts.append(" ".join(t))
        labels.append((junk, toxic))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame([(i, *ls) for i, ls in enumerate(labels)], "doc_id long, junk int, toxic int")
    chain = toxicity.fit_chain(docs, known, ["junk", "toxic"])
    got = sorted((r.doc_id, r.p_junk, r.p_toxic, r.is_toxic) for r in chain.predict(docs).collect())

    sets = []
    for t in texts:
        flat, _ = toxicity.features(next(a for _, a in common.text_slices(pa.array([t]))))
        sets.append(set(flat.tolist()))
    n = len(texts)
    fold = []
    for i in range(n):
        signed = spark_hash((i, "q"), (7, "i"))
        fold.append((signed - (1 << 64) if signed >> 63 else signed) % toxicity.FOLDS)
    seen, final, cuts = np.zeros((n, 0)), np.zeros((n, 0)), []
    for category in range(2):
        y = [ls[category] for ls in labels]
        out = np.zeros(n)
        for f in range(toxicity.FOLDS):
            rows, held = [i for i in range(n) if fold[i] != f], [i for i in range(n) if fold[i] == f]
            out[held] = Plain([sets[i] for i in rows], seen[rows], [y[i] for i in rows]).predict([sets[i] for i in held], seen[held])
        whole = Plain(sets, seen, y).predict(sets, final)
        best = lambda c: 2 * sum(y[i] for i in range(n) if out[i] >= c) / (sum(y) + sum(out >= c))  # noqa: B023, E731
        cuts.append(max(best(s / 1000) for s in range(1001)))
        assert abs(best(chain.thresholds[["junk", "toxic"][category]]) - cuts[-1]) < 0.02
        seen, final = np.column_stack([seen, out]), np.column_stack([final, whole])
    assert np.abs(np.array([g[1:3] for g in got]) - final).max() < 0.03
    assert [g[3] for g in got] == [g[2] >= chain.thresholds["toxic"] for g in got]
    assert sum(g[3] == (ls[1] == 1) for g, ls in zip(got, labels, strict=True)) > 0.85 * n


def test_chain_ties_and_repeats(spark):
    """Equal texts get equal probabilities, and a probability at the threshold counts as of the category."""
    docs = spark.createDataFrame([(i, "vile rot" if i % 3 == 0 else "fine day") for i in range(60)], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    chain = toxicity.fit_chain(docs, known, ["toxic"])
    rows = chain.predict(docs.union(docs)).collect()
    assert len(rows) == 120 and len({(r.text, r.p_toxic, r.is_toxic) for r in rows}) == 2
    assert all(r.is_toxic == (r.text == "vile rot") for r in rows)
    top = max(r.p_toxic for r in rows)
    chain.thresholds["toxic"] = top
    assert all(r.is_toxic == (r.p_toxic == top) for r in chain.predict(docs).collect())
