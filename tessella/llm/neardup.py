"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document's set is its distinct word shingles. Each of `SLOTS` hash functions gives the low `b` = 8 bits of the set's
minimum, so that similar sets differ in few slots. The signature is cut into chunks; when two signatures differ in at
most 2 * chunks - 1 slots, some chunk differs in at most one (pigeonhole). Each chunk's allowed errors are enumerated
as one key per left-out slot, so every pair within that distance shares a key: no such pair is lost. The number of
chunks follows from the similarity asked for (`Chunks`). Pairs within the distance are confirmed on full sets.

Exact copies collapse first: only one document of each distinct set goes on. Key groups of more than `TILE` documents,
and candidate clusters of more than that or of more than `TILE_SHINGLES` shingles, are cut into pairs of tiles, so a
task holds a bounded number of documents and of shingles (or one document, if that is longer); what a task returns is
a spanning forest of what it has linked, never all pairs.

Null texts count as empty. Documents without words are linked with nothing and kept. Rows that share a doc_id count as
one document; null doc_ids are linked with nothing and kept. An empty table gives an empty result. Other columns are
ignored by `near_duplicates` and pass through `drop_near_duplicates`, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distinct, materialize, mix, text_slices, word_hashes
from .groups import Forest, components, whole_groups

SLOTS = 64
#: Chance at most that a pair of exactly the similarity asked for differs in more slots than are allowed.
MISS = 1e-4
SHINGLE = 5
#: Documents of a tile. Groups of at most SMALL are compared by shifting rows, larger ones by matrix.
TILE, SMALL = 2048, 48
#: Shingles of a tile of texts, about.
TILE_SHINGLES = 1 << 21
#: Documents with near candidates, of three numbers each, that may be broadcast.
BROADCAST_ROWS = 2_000_000

_SEEDS = np.random.default_rng(20240607)
_MULTIPLIERS = _SEEDS.integers(1, 1 << 32, SLOTS, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _SEEDS.integers(0, 1 << 32, SLOTS, dtype=np.uint32)
_WEIGHTS = _SEEDS.integers(1, 1 << 63, SLOTS, dtype=np.uint64) | np.uint64(1)


class Chunks:
    """The fewest chunks of a signature for links of `percent`, and the slots in which two signatures may differ."""

    def __init__(self, percent: int):
        fits = (n for n in range(1, SLOTS // 2 + 1) if miss_chance(percent, 2 * n - 1) < MISS)
        self.number = next(fits, 0)
        if not self.number:
            raise ValueError(f"{SLOTS} slots can't find pairs of {percent} percent")
        self.distance = 2 * self.number - 1
        self.of_slot = np.arange(SLOTS) * self.number // SLOTS
        self.starts = np.searchsorted(self.of_slot, np.arange(self.number))


def miss_chance(percent: int, distance: int) -> float:
    """Chance that signatures of two sets of that similarity differ in more than `distance` slots."""
    p = (1 - percent / 100) * 255 / 256
    return sum(math.comb(SLOTS, k) * p**k * (1 - p) ** (SLOTS - k) for k in range(distance + 1, SLOTS + 1))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and each text's number of them.

    A text of fewer than `size` words gives its whole sequence as one shingle.
    """
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    powers = [np.uint64(pow(0xD6E8FEB86659FD93, i, 1 << 64)) for i in range(size)]
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for i, p in enumerate(powers):
        rolled += words[i : i + len(rolled)] * p
    rolled = mix(rolled + np.uint64(size))
    sets = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= size:
            sets.append(distinct(rolled[end - n : end - size + 1]))
        elif n:
            short = np.add.reduce(words[end - n : end] * np.array(powers[:n], np.uint64))
            sets.append(mix(np.array([short + np.uint64(n)], np.uint64)))
        else:
            sets.append(np.empty(0, np.uint64))
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.array([len(s) for s in sets], np.int64)


def signatures(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """b-bit MinHash signatures, a row of SLOTS bytes for each set that isn't empty."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    folded = ((flat >> np.uint64(32)) ^ flat).astype(np.uint32)
    out = np.empty((len(starts), SLOTS), np.uint8)
    for i in range(SLOTS if len(starts) else 0):
        low = np.minimum.reduceat(folded * _MULTIPLIERS[i] + _SHIFTS[i], starts)
        out[:, i] = (low * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def _profile(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                flat, sizes = shingle_sets(texts, size)
                sigs = iter(signatures(flat, sizes))
                ends = np.cumsum(sizes)
                prints, rows = [], []
                for n, end in zip(sizes.tolist(), ends.tolist(), strict=True):
                    prints.append(hashlib.blake2b(flat[end - n : end].tobytes(), digest_size=16).digest() if n else None)
                    rows.append(next(sigs).tobytes() if n else None)
                ids = batch.column(0).slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(prints, pa.binary()), pa.array(rows, pa.binary())], ["doc_id", "n_shingles", "fp", "sig"])

    return run


def _as_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SLOTS)


def _keys(chunks: Chunks):
    """SLOTS keys of a signature: its chunk with one slot left out; the low bits of a key name the slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                weighted = (_as_matrix(part.column(1)).astype(np.uint64) + np.uint64(1)) * _WEIGHTS
                sums = np.add.reduceat(weighted, chunks.starts, axis=1)
                left = mix(sums[:, chunks.of_slot] - weighted + np.arange(SLOTS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                keys = (left & np.uint64(2**64 - SLOTS)) | np.arange(SLOTS, dtype=np.uint64)
                docs = np.repeat(part.column(0).to_numpy(), SLOTS)
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(keys.ravel().view(np.int64))], ["doc", "key"])

    return run


def _own_key(chunks: Chunks, unlike: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether `slot` names the first key that a pair shares, so that one group alone reports the pair."""
    errors = np.add.reduceat(unlike, chunks.starts, axis=1, dtype=np.int64)
    chunk = np.argmax(errors <= 1, axis=1)
    inside = unlike & (chunks.of_slot[None, :] == chunk[:, None])
    first = np.where(inside.any(axis=1), np.argmax(inside, axis=1), chunks.starts[chunk])
    return first == slot


def _near(chunks: Chunks):
    """Links of signatures within the distance in each group of a key and pair of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["key", "ta", "tb"]):
            docs = table["doc"].to_numpy()
            keys, sigs = table["key"].to_numpy(), _as_matrix(table["sig"])
            sizes = np.diff(starts)
            a_found, b_found = [], []
            place = np.arange(len(docs)) - np.repeat(starts[:-1], sizes)
            size_of = np.repeat(sizes, sizes)
            for lag in range(1, min(SMALL, int(sizes.max())) if len(sizes) else 0):
                at = np.flatnonzero((place + lag < size_of) & (size_of <= SMALL))
                for cut in range(0, len(at), 1 << 16):
                    i = at[cut : cut + (1 << 16)]
                    unlike = sigs[i] != sigs[i + lag]
                    ok = unlike.sum(axis=1) <= chunks.distance
                    i, unlike = i[ok], unlike[ok]
                    own = _own_key(chunks, unlike, keys[i] & (SLOTS - 1))
                    a_found.append(docs[i[own]])
                    b_found.append(docs[i[own] + lag])
            for start, n in zip(starts[:-1][sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                own, forest = sigs[start : start + n], Forest(n)
                for i in range(n):
                    near = np.flatnonzero((own[i + 1 :] != own[i]).sum(axis=1) <= chunks.distance) + i + 1
                    for j in near.tolist():
                        forest.join(i, j)
                roots, rows = forest.links()
                a_found.append(docs[start + roots])
                b_found.append(docs[start + rows])
            if a_found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_found)), pa.array(np.concatenate(b_found))], ["a", "b"])

    return run


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["cluster", "ta", "tb"]):
            docs = table["doc"].to_numpy()
            a_found, b_found = [], []
            for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                roots, rows = _link(table["text"].slice(start, end - start).combine_chunks(), size, percent)
                a_found.append(docs[start + roots])
                b_found.append(docs[start + rows])
            if a_found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_found)), pa.array(np.concatenate(b_found))], ["a", "b"])

    return run


def _link(texts: pa.Array, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among a few texts, on full sets: intersections are counted by inverted lists."""
    parts = [shingle_sets(t, size) for _, t in text_slices(texts)]
    flat, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    n, forest = len(sizes), Forest(len(sizes))
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    bounds = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.empty(0, np.int64)
    lengths = np.diff(np.append(bounds, len(flat)))
    list_of = np.repeat(np.arange(len(bounds)), lengths)
    by_doc = np.argsort(owner, kind="stable")
    ends = np.cumsum(sizes)
    for i in range(n - 1):
        lists = list_of[by_doc[ends[i] - sizes[i] : ends[i]]]
        lists = lists[lengths[lists] > 1]
        if not len(lists):
            continue
        long = lengths[lists]
        places = np.repeat(bounds[lists] - (np.cumsum(long) - long), long) + np.arange(long.sum())
        shared = np.bincount(owner[places], minlength=n)
        linked = 100 * shared >= percent * (sizes[i] + sizes - shared)
        for j in np.flatnonzero(linked[i + 1 :]).tolist():
            forest.join(i, i + 1 + j)
    return forest.links()


def _tiled(df: DataFrame, tiles: Column) -> DataFrame:
    """Rows dealt to pairs of tiles (ta, tb) of their group, which is to have so many tiles."""
    own = F.when(tiles > 1, F.pmod(F.xxhash64("doc"), tiles)).otherwise(0).cast("int")
    dealt = df.withColumn("tile", own).withColumn("_o", F.explode(F.sequence(F.lit(0), (tiles - 1).cast("int"))))
    return dealt.withColumns({"ta": F.least("tile", "_o").cast("long"), "tb": F.greatest("tile", "_o").cast("long")}).drop("_o")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row: components of links 100 * shared >= percent * union."""
    chunks = Chunks(percent)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    base = materialize(docs.mapInArrow(_profile(shingle), "doc_id long, n_shingles long, fp binary, sig binary"), "dup-base")
    classes = materialize(
        base.filter("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc"), F.min("sig").alias("sig"), F.min("n_shingles").alias("shingles")),
        "dup-classes",
    )
    sigs = classes.select("doc", "sig")
    keys = sigs.mapInArrow(_keys(chunks), "doc long, key long")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = _tiled(keys.join(shared, "key").join(sigs, "doc"), F.ceil(F.col("n") / TILE)).select("key", "ta", "tb", "doc", "sig")
    members = members.repartition("key", "ta", "tb").sortWithinPartitions("key", "ta", "tb", "doc")
    clusters = materialize(components(members.mapInArrow(_near(chunks), "a long, b long")), "dup-clusters")
    member = clusters.withColumnRenamed("node", "doc").join(classes.select("doc", "shingles"), "doc")
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("s"))
    sizes = sizes.select("component", F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("s") / TILE_SHINGLES)).alias("tiles"))
    sized = sizes.join(clusters, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"), "tiles")
    # up to a bound the clustered ids go to the texts; beyond it both are shuffled
    sized = F.broadcast(sized) if clusters.count() <= BROADCAST_ROWS else sized.hint("merge")
    tiles = _tiled(
        docs.join(sized, "doc_id").withColumnRenamed("doc_id", "doc"),
        F.col("tiles"),
    ).select("cluster", "ta", "tb", "doc", "text")
    tiles = tiles.repartition("cluster", "ta", "tb").sortWithinPartitions("cluster", "ta", "tb", "doc")
    links = tiles.mapInArrow(_confirm(shingle, percent), "a long, b long")
    found = components(links)
    of_class = classes.select("fp", "doc").join(found.withColumnRenamed("node", "doc"), "doc", "left")
    of_class = of_class.select("fp", F.coalesce("component", "doc").alias("component_id"))
    return (
        base.join(of_class, "fp", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """The rows whose document has the smallest id of its component, or no id."""
    gone = near_duplicates(df, key, text, percent).filter(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    return df.join(gone, key, "left_anti")
