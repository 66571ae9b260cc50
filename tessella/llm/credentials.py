r"""Scans for secrets: certain ones by pattern, weak ones only where the parts of a credential come together.

A text's parts have roles. Identifiers: access (AKIA...), login (`user: ...`, `client_id=...`). Secrets: assign
(`password = ...`), hex (24 digits or more), and the weak kinds pass (`pwd: ...`, `key=...`) and blob (20 characters or
more of mixed letters and digits, of MIN_BITS a character or more). Endpoints: host (a url, `host=...`). The kinds assign,
access and hex are certain and always stay. A weak part is a candidate, and stays only where complementary parts co-occur:

    login with a secret; pass or blob with an identifier or an endpoint; host with an identifier and a secret.

Parts come together by an interval join: a part's interval reaches REACH code points to either side, but not past its
scope, which is a run of lines without a blank one between them; another part joins if it overlaps that interval. Each
role's parts are sorted with the furthest end so far beside each, so a probe is one bisection and no pair is made, however
many parts a text has. Both sides may be weak: a login and a blob beside each other are both reported. A url that holds
a name and a password has its parts within itself. Weak parts that overlap a certain one, or a weak one that starts
earlier, are dropped. All this needs one text at a time, so a text is scanned and joined where it is read, and nothing is
shuffled; a repeated or very frequent doc_id is no burden.

Null and empty texts have no spans. Texts of any length are scanned whole; each pattern takes time in proportion to the
text. Positions count code points, the end exclusive; spans are ordered by start, then by kind as in KINDS. Repeated rows
give a row each, an empty table none. Only the columns in `keep` are returned, whatever their names, beside `spans`; a
column of that name in `keep` is an error.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: In the order in which spans that start together stand.
KINDS = ("assign", "access", "hex", "login", "pass", "host", "blob")
CERTAIN = KINDS[:3]
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "login": "identifier", "pass": "secret", "host": "endpoint", "blob": "secret"}
#: Of each weak kind: sets of roles; the part stays if all roles of one set are near.
NEEDS = {
    "login": [{"secret"}],
    "pass": [{"identifier"}, {"endpoint"}],
    "blob": [{"identifier"}, {"endpoint"}],
    "host": [{"identifier", "secret"}],
}
#: Code points to either side within which parts come together, and least entropy of a blob's characters.
REACH, MIN_BITS = 200, 3.5

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# a run that is long enough, from its first digit
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_NAMED = re.compile(
    r"(?<![A-Za-z0-9])(?:(?P<login>user(?:name|_?id)?|login|account|client_?id|access_?key_?id)|(?P<pass>pwd|pass(?:phrase|code)?|auth|key|credentials?)|(?P<host>host(?:name)?|server|endpoint|url))"
    r"[\"']?\x20*[:=]\x20*[\"']?(?P<value>[A-Za-z0-9@+/_.:=-]+)",
    re.I | re.A,
)
_URL = re.compile(r"(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]{0,20}://[^\s\"'<>]{4,}", re.A)
_WITHIN = re.compile(r"[^/]*://[^/:@]+:[^/@]+@")
_BLOB = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
_BLANK = re.compile(r"\n[ \t\r]*(?=\n)")
#: Least characters of a named value.
_LEAST = {"login": 3, "pass": 6, "host": 4}

Part = tuple[int, int, str]


def bits(value: str) -> float:
    """Entropy of a value's characters, in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def certain(text: str) -> list[Part]:
    """(start, end, kind) of the parts that are secrets by their pattern."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def _is_blob(value: str) -> bool:
    some = (any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value))
    return all(some) and bits(value) >= MIN_BITS


def weak(text: str, taken: list[Part]) -> list[Part]:
    """Candidates in the order of their starts, none of which overlaps another or one that is `taken`."""
    found = [(m.start(), m.end(), m.lastgroup if m.lastgroup != "value" else next(k for k in ("login", "pass", "host") if m[k])) for m in _NAMED.finditer(text)]
    sizes = {m.start(): m.end("value") - m.start("value") for m in _NAMED.finditer(text)} if found else {}
    found = [p for p in found if sizes[p[0]] >= _LEAST[p[2]]]
    found += [(m.start(), m.end(), "host") for m in _URL.finditer(text)]
    found += [(m.start(), m.end(), "blob") for m in _BLOB.finditer(text) if _is_blob(m[0])]
    found.sort(key=lambda p: (p[0], KINDS.index(p[2])))
    near, out, last = Intervals(taken), [], 0
    for p in found:
        if p[0] >= last and not near.meet(p[0], p[1]):
            out.append(p)
            last = p[1]
    return out


class Intervals:
    """Sorted intervals; whether any of them overlaps another one."""

    def __init__(self, parts: list[Part]):
        ordered = sorted(parts)
        self.starts, self.furthest, far = [p[0] for p in ordered], [], 0
        for p in ordered:
            far = max(far, p[1])
            self.furthest.append(far)

    def meet(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.furthest[i - 1] > start


def linked(text: str, found: list[Part], candidates: list[Part], reach: int = REACH) -> list[Part]:
    """The candidates whose complementary parts overlap their interval."""
    if not candidates:
        return []
    blanks = [m.start() for m in _BLANK.finditer(text)]
    by_role: dict[str, list[Part]] = {"identifier": [], "secret": [], "endpoint": []}
    for p in found + candidates:
        by_role[ROLE[p[2]]].append(p)
    roles = {r: Intervals(parts) for r, parts in by_role.items()}
    out = []
    for start, end, kind in candidates:
        if kind == "host" and _WITHIN.match(text, start, end):
            out.append((start, end, kind))
            continue
        i = bisect_left(blanks, start)
        low = max(start - reach, blanks[i - 1] if i else 0)
        high = min(end + reach, blanks[i] if i < len(blanks) else len(text))
        near = {r for r, own in roles.items() if r != ROLE[kind] and own.meet(low, high)}
        if any(need <= near for need in NEEDS[kind]):
            out.append((start, end, kind))
    return out


def spans_of(text: str, reach: int = REACH) -> list[dict]:
    """All spans of a text, in order."""
    found = certain(text)
    found += linked(text, found, weak(text, found), reach)
    found.sort(key=lambda p: (p[0], KINDS.index(p[2])))
    return [{"kind": k, "start": s, "end": e} for s, e, k in found]


def _scan(reach: int):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column(0)):
                spans = pa.array([spans_of(t, reach) for t in texts.to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(start, len(texts)), spans], ["_row", "spans"])

    return run


def find_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), reach: int = REACH) -> DataFrame:
    """The columns `keep` and spans: array of (kind, start, end)."""
    if "spans" in keep:
        raise ValueError("a kept column is named spans")
    packed = df.select(F.col(text).cast("string").alias("_text"), F.struct(*keep).alias("_row"))
    schema = f"_row {packed.schema['_row'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return packed.mapInArrow(_scan(reach), schema).select("_row.*", "spans")
