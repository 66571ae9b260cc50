"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs over all training texts are quantised to levels q = 1 + floor(log_b count). A key of
level q enters a Bloom filter once for each level 1 to q; probing levels upwards until one is missing gives the level
back, so a probe never reads a count too low and reads it too high only by a false positive.

The filter grows with the corpus, so it has no size at which it may be broadcast: it is cut into segments by leading
key bits, each built by one task and kept in the shared folder, and the same segments are probed at every size. Texts
are dealt to chunks; each chunk sends its distinct keys to their segments, is answered with levels (and exact word
counts) in the order of the keys, and scores its texts with them. Keys travel sorted and packed, four bytes each.

    p(w | v) = L min(1, c(v, w) / c(v)) + (1 - L) (c(w) + 1) / (N + V + 1),    L = c(v) / (c(v) + BACKOFF)

with counts read from the filter; the first word has no v. Words are told apart by 64-bit hashes.

Null texts count as empty: one token, the end. Rows with a null `held_out` are scored and not learned from. Repeated
rows are each learned from and each get a row of scores; rows repeated so often that they would fill a good part of a
chunk are scored once and their scores repeated. Without training rows every count is 0; an empty table gives no rows.
Other columns are ignored, whatever their names. A chunk asks each segment in a row of its own: on tables of many
terabytes, raise `chunk_bytes` and `segment_bytes` together. Scores don't depend on `chunk_bytes`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, distinct, materialize, mix, run_starts, text_slices, word_hashes

BASE = 1.5
#: An absent key is found with a chance of 0.05 %; and its 32 bits are those of another key of a full segment with 0.06 %.
BITS_PER_ENTRY, PROBES = 16, 11
BACKOFF = 10.0
#: Text of a chunk, about; its tokens and their counts are held by one task.
CHUNK_BYTES = 8 << 20
#: Training text for which a segment of the filter is planned.
SEGMENT_BYTES = 24 << 20
#: Chunks and segments at least, so that small tables are spread as well.
LEAST = 64
#: Tokens counted in a worker before they are sent on.
AT_ONCE = 1 << 22

#: Equal rows that together hold this part of a chunk are scored once; there are at most this many of them for each chunk.
HOT_PARTS = 8
_END = np.uint64(0x2545F4914F6CDD1D)
_PAIR = np.uint64(0x9FB21C651E98DF25)
_WORD = np.uint64(0xA0761D6478BD642F)
_LEVEL = 0x9E3779B97F4A7C15


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, and where each text starts."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts + 1) - 1
    out = np.empty(len(words) + len(counts), np.uint64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = words, _END
    return out, ends - counts


def word_keys(words: np.ndarray) -> np.ndarray:
    return mix(words ^ _WORD)


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + words)


def second_places(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of the tokens that have one before them in their text."""
    inner = np.ones(len(words), bool)
    inner[starts] = False
    return np.flatnonzero(inner)


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 for level 0."""
    low = np.ceil(BASE ** (levels - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE**levels - 1e-9) - 1)
    return np.where(levels > 0, (low + high) / 2, 0.0)


class Segments:
    """Which segment a key belongs to, by its leading bits, and its 32 bits there."""

    def __init__(self, number: int):
        self.number, self.bits = number, int(math.log2(number))

    def cut(self, keys: np.ndarray) -> list[np.ndarray]:
        """Sorted keys, by segment."""
        return np.split(keys, np.searchsorted(keys, np.arange(1, self.number, dtype=np.uint64) << np.uint64(64 - self.bits)))

    def inner(self, keys: np.ndarray) -> np.ndarray:
        return ((keys << np.uint64(self.bits)) >> np.uint64(32)).astype(np.uint32)


def _entries(keys: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of keys at level q, and the steps between their probes."""
    entries = mix(keys.astype(np.uint64) + np.uint64(q * _LEVEL % (1 << 64)))
    return entries, mix(entries) | np.uint64(1)


def _place(entries: np.ndarray, steps: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """Bit numbers of a probe, in a segment of so many bits (below 2 ** 32)."""
    return (((entries + np.uint64(probe) * steps) >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)


def build_filter(keys: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """(bits, data) of a segment from its 32-bit keys, each with its count."""
    levels = level(counts) if len(keys) else np.empty(0, np.int64)
    bits = max(64, -(-int(levels.sum()) * BITS_PER_ENTRY // 64) * 64)
    hit = np.zeros(bits, bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        entries, steps = _entries(keys[levels >= q], q)
        for probe in range(1, PROBES + 1):
            hit[_place(entries, steps, probe, bits)] = True
    return bits, np.packbits(hit, bitorder="little").tobytes()


def probe_filter(keys: np.ndarray, bits: int, data: bytes) -> np.ndarray:
    """Levels of 32-bit keys, by membership probes from level 1 up."""
    found, at, bytes_ = np.zeros(len(keys), np.uint8), np.arange(len(keys)), np.frombuffer(data, np.uint8)
    q = 1
    while len(at):
        entries, steps = _entries(keys[at], q)
        for probe in range(1, PROBES + 1):
            place = _place(entries, steps, probe, bits)
            ok = (bytes_[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            at, entries, steps = at[ok], entries[ok], steps[ok]
        found[at] = q
        q += 1
    return found


def _run_counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    values = np.sort(values)
    starts = run_starts(values)
    return values[starts], np.diff(np.append(starts, len(values)))


def _packed_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys with counts of a byte: a key of a larger count is named several times."""
    times = -(-counts // 255)
    small = np.full(int(times.sum()), 255, np.uint8)
    small[np.cumsum(times) - 1] = counts - 255 * (times - 1)
    return np.repeat(keys, times), small


def _gather(segments: Segments):
    """Training texts to rows of counts for each segment: exact ones of words, and keys of words and pairs."""

    def sent(words: list[np.ndarray], pairs: list[np.ndarray]) -> pa.RecordBatch:
        single, single_n = _run_counts(np.concatenate(words))
        double, double_n = _run_counts(np.concatenate(pairs))
        named = word_keys(single)
        order = np.argsort(named)
        rows = []
        lists = [segments.cut(x) for x in (single, named[order], double)]
        at = [np.cumsum([0, *map(len, cuts)]) for cuts in lists]
        counts = (single_n, single_n[order], double_n)
        for i in range(segments.number):
            (w, wn), (k, kn), (p, pn) = ((cuts[i], n[a[i] : a[i + 1]]) for cuts, n, a in zip(lists, counts, at, strict=True))
            if len(w) or len(k) or len(p):
                keys, small = _packed_counts(segments.inner(np.concatenate([k, p])), np.concatenate([kn, pn]))
                rows.append((i, w.tobytes(), wn.tobytes(), keys.tobytes(), small.tobytes()))
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], _SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, size = [], [], 0
        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                new, starts = tokens(texts)
                at = second_places(new, starts)
                words.append(new)
                pairs.append(pair_keys(new[at - 1], new[at]))
                size += len(new)
                if size >= AT_ONCE:
                    yield sent(words, pairs)
                    words, pairs, size = [], [], 0
        if size:
            yield sent(words, pairs)

    return run


_SENT = ["segment", "words", "word_n", "keys", "n"]


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = run_starts(keys)
    return keys[starts], np.add.reduceat(counts[order].astype(np.int64), starts) if len(starts) else np.empty(0, np.int64)


def _build(rows: pa.Table) -> pa.Table:
    """One segment: its words with exact counts, and its filter."""
    words, counts = _summed(_joined(rows["words"], np.uint64), _joined(rows["word_n"], np.int64))
    bits, data = build_filter(*_summed(_joined(rows["keys"], np.uint32), _joined(rows["n"], np.uint8)))
    made = [rows["segment"][0].as_py(), len(words), int(counts.sum()), words.tobytes(), counts.tobytes(), bits, data]
    return pa.table([pa.array([x]) for x in made], _MODEL.names)


_MODEL = pa.schema([("segment", pa.int64()), ("distinct", pa.int64()), ("total", pa.int64()), ("words", pa.binary()), ("word_n", pa.binary()), ("bits", pa.int64()), ("data", pa.binary())])


class _Chunk:
    """A chunk's tokens, and its distinct words and pairs in the order in which they are asked and answered."""

    def __init__(self, texts: pa.Array):
        words, starts, base = [], [], 0
        for _, part in text_slices(texts):
            new, at = tokens(part)
            words.append(new)
            starts.append(at + base)
            base += len(new)
        self.tokens, self.starts = np.concatenate(words), np.concatenate(starts)
        self.second = second_places(self.tokens, self.starts)
        self.pairs = pair_keys(self.tokens[self.second - 1], self.tokens[self.second])


def _of_each(values: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """The answer to each value, from the answers to the sorted distinct values."""
    order = np.argsort(values)
    rank = np.zeros(len(values), np.int64)
    ordered = values[order]
    rank[1:] = np.cumsum(ordered[1:] != ordered[:-1])
    out = np.empty(len(values), answers.dtype)
    out[order] = answers[rank]
    return out


def _ask(segments: Segments):
    """A chunk's texts to a row for each segment: the words, and keys of words and pairs, that the chunk wants from it."""

    def run(table: pa.Table) -> pa.Table:
        chunk = _Chunk(table["text"].combine_chunks())
        words = distinct(chunk.tokens)
        lists = [segments.cut(words), segments.cut(np.sort(word_keys(words))), segments.cut(distinct(chunk.pairs))]
        rows = [(i, w.tobytes(), segments.inner(k).tobytes(), segments.inner(p).tobytes()) for i, (w, k, p) in enumerate(zip(*lists, strict=True)) if len(w) or len(k) or len(p)]
        columns = [pa.array([table["chunk"][0].as_py()] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64())]
        return pa.table([*columns, *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], ["chunk", "segment", "words", "word_keys", "pairs"])

    return run


def _answer(model: pa.Table, asked: pa.Table) -> pa.Table:
    """A segment's word counts and filter, probed for every chunk: answers in the order asked."""
    known = _joined(model["words"], np.uint64)
    known_n = _joined(model["word_n"], np.int64)
    bits, data = (model["bits"][0].as_py(), model["data"][0].as_py()) if model.num_rows else (64, bytes(8))

    def parts(answers: np.ndarray, column: str, width: int) -> pa.Array:
        ends = np.cumsum([len(x) // width for x in asked[column].to_pylist()])
        return pa.array([x.tobytes() for x in np.split(answers, ends[:-1])] if len(ends) else [], pa.binary())

    words = _joined(asked["words"], np.uint64)
    at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
    exact = np.where(known[at] == words, known_n[at], 0) if len(known) else np.zeros(len(words), np.int64)
    levels = [probe_filter(_joined(asked[c], np.uint32), bits, data) for c in ("word_keys", "pairs")]
    columns = [parts(exact.astype(np.int64), "words", 8), parts(levels[0], "word_keys", 4), parts(levels[1], "pairs", 4)]
    return pa.table([asked["chunk"], asked["segment"], *columns], ["chunk", "segment", "counts", "word_levels", "pair_levels"])


def _log_p(pair_n, before_n, word_n, total, distinct_words):
    """log10 p(w | v); before_n is 0 where there is no v."""
    weight = before_n / (before_n + BACKOFF)
    ratio = np.minimum(1.0, pair_n / np.maximum(before_n, 1.0))
    return np.log10(weight * ratio + (1 - weight) * (word_n + 1) / (total + distinct_words + 1))


def _row_hash() -> Column:
    return F.xxhash64("doc_id", "held_out", "text")


def _marked_hot(docs: DataFrame, least_bytes: float) -> tuple[DataFrame, int, int]:
    """Hashes of rows, with `hot` for rows that are named so often that together they hold `least_bytes`; all bytes; how many are hot."""
    sizes = docs.groupBy(_row_hash().alias("row")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("bytes"))
    sizes = sizes.withColumn("hot", (F.col("n") > 1) & (F.col("bytes") > least_bytes))
    size, hot = sizes.agg(F.sum("bytes"), F.count_if("hot")).first()
    return sizes, size or 0, hot


def collapsed(docs: DataFrame, sizes: DataFrame, hot: int) -> DataFrame:
    """Hot rows once, with the number of their copies; all other rows as they are, with 1."""
    docs = docs.withColumn("copies", F.lit(1).cast("long"))
    if not hot:
        return docs
    named = sizes.filter("hot").select("row")
    if hot <= MOST_BROADCAST:
        named = F.broadcast(named)
    marked = docs.withColumn("row", _row_hash())
    once = marked.join(named, "row", "left_semi").groupBy("doc_id", "held_out", "text").agg(F.sum("copies").alias("copies"))
    return marked.join(named, "row", "left_anti").drop("row").unionByName(once)


def _repeated(scored: DataFrame) -> DataFrame:
    """Each row as often as it has copies, in blocks that different tasks write."""
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(copies - 1) div 65536"))).alias("block")
    blocks = scored.select("*", block).repartition("doc_id", "block")
    return blocks.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(65536), F.col("copies") - F.col("block") * 65536)))).drop("block", "copy")


def _score(total: int, distinct_words: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("segment")
        chunk = _Chunk(docs["text"].combine_chunks())
        words = distinct(chunk.tokens)
        named = np.empty(len(words), np.uint8)
        named[np.argsort(word_keys(words))] = _joined(answers["word_levels"], np.uint8)
        exact = _of_each(chunk.tokens, _joined(answers["counts"], np.int64))
        word_n = count_of(_of_each(chunk.tokens, named).astype(np.int64))
        pair_n, before_n = np.zeros(len(word_n)), np.zeros(len(word_n))
        pair_n[chunk.second] = count_of(_of_each(chunk.pairs, _joined(answers["pair_levels"], np.uint8)).astype(np.int64))
        before_n[chunk.second] = word_n[chunk.second - 1]
        base = np.log10((exact + 1) / (total + distinct_words + 1))
        score = _log_p(pair_n, before_n, word_n, total, distinct_words)
        sizes = np.diff(np.append(chunk.starts, len(word_n)))
        sums = [np.add.reduceat(x, chunk.starts) for x in ((exact > 0).astype(np.int64), base, score)]
        return pa.table([docs["doc_id"], docs["held_out"], docs["copies"], *map(pa.array, (sizes, *sums))], ["doc_id", "held_out", "copies", "n_tokens", "n_known", "base_score", "score"])

    return run


_SCORED = "doc_id long, held_out boolean, copies long, n_tokens long, n_known long, base_score double, score double"


def score_texts(df: DataFrame, key: str = "doc_id", text: str = "text", held_out: str = "held_out", chunk_bytes: int = CHUNK_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; learns where `held_out` is false."""
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(held_out).alias("held_out"), F.col(text).alias("text"))
    sizes, size, hot = _marked_hot(docs, chunk_bytes / HOT_PARTS)
    segments = Segments(1 << math.ceil(math.log2(max(LEAST, size / segment_bytes))))
    sent = docs.filter(~F.col("held_out")).select("text").mapInArrow(_gather(segments), "segment long, words binary, word_n binary, keys binary, n binary")
    # a task for each segment and chunk, or so, however many there are
    built = sent.repartition(segments.number, "segment").groupBy("segment").applyInArrow(_build, "segment long, distinct long, total long, words binary, word_n binary, bits long, data binary")
    model = materialize(built, "lm-filter")
    total, distinct_words = model.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    # dealt by content, so that rows fall into the same chunk whenever they are read
    chunks = max(LEAST, math.ceil(size / chunk_bytes))
    dealt = collapsed(docs, sizes, hot).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long")).repartition(chunks, "chunk").groupBy("chunk")
    asked = dealt.applyInArrow(_ask(segments), "chunk long, segment long, words binary, word_keys binary, pairs binary")
    held = model.select("segment", "words", "word_n", "bits", "data").groupBy("segment")
    answers = held.cogroup(asked.repartition(segments.number, "segment").groupBy("segment")).applyInArrow(_answer, "chunk long, segment long, counts binary, word_levels binary, pair_levels binary")
    scored = dealt.cogroup(answers.groupBy("chunk")).applyInArrow(_score(total, distinct_words), _SCORED)
    scored = (_repeated(scored) if hot else scored).drop("copies")
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))
