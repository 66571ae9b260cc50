"""Byte-pair encoding and decoding by forced-boundary splitting.

A pair of bytes that occurs inside no vocabulary token can never be merged over, so a cut between them is certain.
Two kinds of such pairs are used, where the tokenizer's own pre-splitting also ends a piece and starts the next
afresh, whatever stands on the other side: a blank after a character that isn't white space, and punctuation or a line
end after an ASCII letter. Texts are cut at the first kind; each distinct fragment is looked up in a bounded memory,
and what isn't there is cut at the second kind and encoded piece by piece. Ids of fragments are concatenated.

Null texts count as empty and give no ids. Ids are kept as little-endian unsigned 32-bit integers, end to end. Added
tokens (such as the end of a text) are recognised in texts and never cut. Texts of any length stay whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Fragments in each of a worker's two memories: when the young one is full it becomes the old one, from which
#: what is still used moves back.
REMEMBERED = 120_000
#: Bytes of texts that are handled together.
AT_ONCE = 1 << 20
#: The pre-splitting pattern of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters below this are letters in every version of Unicode; pieces with others are left to the tokenizer's own library.
BEYOND_LATIN = re.compile("[^\x00-\u024f]")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker on each core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def pair_table(tokenizer) -> np.ndarray:
    """256 x 256: whether a pair of bytes occurs inside some vocabulary token."""
    byte_of, inside = _byte_of(), np.zeros((256, 256), bool)
    for token in tokenizer.get_vocab(with_added_tokens=False):
        data = [byte_of.get(c) for c in token]
        for a, b in zip(data, data[1:], strict=False):
            if a is not None and b is not None:
                inside[a, b] = True
    return inside


def _class(characters) -> str:
    return "".join(re.escape(c) for c in characters)


class Splitter:
    """Certain cuts of one vocabulary."""

    def __init__(self, path: str):
        tokenizer = _tokenizer(path)
        inside = pair_table(tokenizer)
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.whole = any(" " in t for t in self.added)
        # characters after which a blank may stand inside a token, told by their last byte; from U+3000 on all count
        after = [chr(c) for c in range(33, 0x3000) if inside[chr(c).encode()[-1], 32]]
        self.unsafe = re.compile(rf"[\s\x00{_class(after)}\u3000-\U0010FFFF] ")
        self.safe_cut = re.compile(rf"(?<=[^\s\x1c-\x1f{_class(after)}\u3000-\U0010FFFF])(?= )")
        letters = [chr(c) for c in range(128) if chr(c).isalpha()]
        marks = [chr(c) for c in [10, *range(33, 127)] if not chr(c).isalnum() and not inside[[ord(x) for x in letters], c].any()]
        self.mark_cut = re.compile(rf"(?<=[A-Za-z])(?=[{_class(marks)}])") if marks else None

    def fragments(self, text: str) -> list[str]:
        if self.whole:
            return [text]
        if self.unsafe.search(text) is None and "\x00" not in text:
            return text.replace(" ", "\x00 ").split("\x00")
        return self.safe_cut.split(text)

    def pieces(self, fragment: str) -> list[str]:
        if self.mark_cut is None or any(t in fragment for t in self.added):
            return [fragment]
        return self.mark_cut.split(fragment)


@lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


@lru_cache(maxsize=2)
def _ranked(path: str):
    """The same vocabulary for merging by rank, if its ids follow the order of its merges; else None."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    byte_of, vocabulary = _byte_of(), model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [vocabulary["".join(m)] for m in pairs]
    tokens = {t: i for t, i in vocabulary.items() if all(c in byte_of for c in t)}
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or len(merged) + 256 != len(tokens):
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in tokens.items()}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of fragments, remembered up to a bound."""

    def __init__(self, path: str):
        self.tokenizer, self.ranked, self.splitter = _tokenizer(path), _ranked(path), splitter(path)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        if self.ranked is None or BEYOND_LATIN.search(piece) or any(t in piece for t in self.splitter.added):
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        else:
            ids = self.ranked.encode_ordinary(piece)
        return np.array(ids, "<u4").tobytes()

    def mixed(self, fragment: str) -> bytes:
        """A fragment with marks in it: its pieces are remembered too."""
        parts, known = [], self.known
        for p in self.splitter.pieces(fragment):
            ids = known.get(p) or self.old.get(p)
            if ids is None:
                ids = self.piece(p)
            known[p] = ids
            parts.append(ids)
        return b"".join(parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.old, self.known = self.known, {}
        lists, known, old = [self.splitter.fragments(t) for t in texts], self.known, self.old
        # words of Latin letters hold no added token if each of those has some other character
        simple = self.ranked is not None and not any(t.isalpha() for t in self.splitter.added)
        ordinary, beyond, pack = self.ranked and self.ranked.encode_ordinary, BEYOND_LATIN.search, struct.Struct
        packs = [pack(f"<{n}I").pack for n in range(64)]
        for f in set().union(*lists).difference(known):
            ids = old.get(f)
            if ids is not None:
                known[f] = ids
            elif simple and f[1:].isalpha() and not beyond(f):
                found = ordinary(f)
                known[f] = packs[len(found)](*found) if len(found) < 64 else np.array(found, "<u4").tobytes()
            else:
                known[f] = self.mixed(f)
        return [b"".join(map(known.__getitem__, fs)) for fs in lists]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for start, texts in text_slices(batch.column(0), AT_ONCE):
                ids = pa.array(encoder.encode(texts.to_pylist()), pa.binary())
                kept = [c.slice(start, len(texts)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*kept, ids], [*batch.schema.names[1:], "ids"])

    return run


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and ids: a text's token ids as packed binary. `path` names the tokenizer's file."""
    kept = df.select(F.col(text).alias("_text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return kept.mapInArrow(_encode(path), f"{schema}, ids binary")


def ids_array(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")


@lru_cache(maxsize=2)
def _bytes_of_ids(path: str) -> list[bytes]:
    """Each id's bytes; added tokens and others that aren't byte-level text stand for themselves."""
    tokenizer, byte_of = _tokenizer(path), _byte_of()
    table = [b""] * (max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        table[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return table


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bytes_of_ids(path).__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                ids = rows.column(rows.num_columns - 1).to_pylist()
                texts = [b"".join(map(table, ids_array(x or b"").tolist())).decode("utf-8", "replace") for x in ids]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], [*rows.schema.names, "decoded"])

    return run


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add decoded, the text of packed ids; special tokens stay."""
    ordered = df.select(*[c for c in df.columns if c != ids], ids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    return ordered.mapInArrow(_decode(path), f"{schema}, decoded string")


def round_trip(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`encode`, then `decode`, in the same workers: the columns `keep`, ids and decoded."""
    kept = df.select(F.col(text).alias("_text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    there, back = _encode(path), _decode(path)
    return kept.mapInArrow(lambda batches: back(there(batches)), f"{schema}, ids binary, decoded string")
