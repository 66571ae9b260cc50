"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing: of pages with equal payloads of at least `min_bytes`, that of the largest page_id is a response record and
the others are revisits without a payload; the text writer lays out records of any number of files in parallel.

Reading: tasks read splits of a file cut at the magic `WARC/1.` and emit, for each place where it stands, a candidate
record start and the offset of its successor as its header declares it. The magic may also stand inside a payload, so
the chain is verified: within a split, pointer jumping finds where each candidate's chain leaves the split; across
splits, it doubles the hops from each file's start until no new split is reached. Only candidates reachable from the
start of the file are records. Pieces between a record's start and its successor are its payload, magic included.

Null payloads count as empty. Rows that repeat both page_id and payload are all responses if the id is the largest of
its group. A null page_id is smaller than any other. An empty table writes no record. Urls and headers may have any
length; of a url that holds the magic, one character is written percent-encoded. Other columns are ignored. A file
whose chain of records doesn't end with the file raises an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize
from .groups import whole_groups

MAGIC = "WARC/1."
END = "\r\n\r\n"
#: The digit alphabets of base conversion and of base32 (RFC 4648).
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def digest(payload: Column) -> Column:
    """SHA-1 in upper-case base32: each 10 hex digits are 8 base32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> None:
    """Write one record for each row to archives under `path`."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": digest(F.col("payload"))})
    equal = rows.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
    # only digests that repeat; written, so that the join knows its size: small ones are broadcast, others shuffled
    equal = materialize(equal.filter("n > 1").select("digest", "first"), "warc-equal")
    known = rows.join(equal, "digest", "left")
    refers = F.when((F.col("bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    known = known.withColumn("refers", refers)
    block = F.when(F.col("refers").isNull(), F.concat(F.lit(_HTTP), F.col("bytes").cast("string"), F.lit(END), F.col("payload"))).otherwise(F.concat(F.lit(_HTTP), F.col("bytes").cast("string"), F.lit(END)))
    # the magic stands in no header
    clean_url = F.replace(F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20"), F.lit(MAGIC), F.lit(MAGIC.replace("/", "%2F")))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("refers").isNull(), F.lit("response")).otherwise(F.lit("revisit")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), clean_url,
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("refers").cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit(END),
    )
    records = known.withColumn("block", block).select(F.concat(header, "block").alias("value"))
    records.write.option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Text between two magics, with its file and split and its number in the order of the scan."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("piece"),
    )


def _end_at(data: Column) -> Column:
    """Byte position, from 1, of the first END; 0 where there is none."""
    before = F.octet_length(F.substring_index(data.cast("string"), END, 1))
    return F.when(before < F.octet_length(data), before + 1).otherwise(0)


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)


def _parsed(pieces: DataFrame) -> DataFrame:
    """Header fields of a piece as if it began a record, and its whole length as declared (null: no such header)."""
    head_bytes = _end_at(F.col("piece"))
    head = F.when(head_bytes > 0, F.decode(F.substring(F.col("piece"), F.lit(1), head_bytes - 1), "ISO-8859-1"))
    length = F.expr("try_cast(_content_length as bigint)")
    out = pieces.withColumn("_head", head).withColumn("_content_length", F.nullif(_field(F.col("_head"), "Content-Length"), F.lit("")))
    good = F.col("_head").rlike(r"^[01]\r\n") & (length >= 0)
    body_at = head_bytes + 3 + len(MAGIC)
    return out.withColumns({
        "bytes": F.octet_length("piece").cast("long") + len(MAGIC),
        "body_at": body_at.cast("long"),
        "span": F.when(good, body_at + length + len(END)).cast("long"),
        "content_length": length,
    })


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each split: where each candidate starts and where its chain leaves the split, by pointer jumping."""
    for table, starts in whole_groups(batches, ["file", "split"]):
        for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            part = table.slice(start, end - start)
            sizes, base = part["bytes"].to_numpy(), part["base"].to_numpy()[0]
            # the magic before a piece belongs to it; a file begins with an empty piece that has none
            at = base + np.cumsum(sizes) - sizes - len(MAGIC)
            span = part["span"].to_numpy(zero_copy_only=False)
            good = ~np.isnan(span.astype(float))
            to = np.where(good, at + np.where(good, span, 0).astype(np.int64), -1)
            final = base + int(sizes.sum()) - len(MAGIC)
            inside = np.searchsorted(at, to)
            hit = (to >= 0) & (inside < len(at)) & (at[np.minimum(inside, len(at) - 1)] == to)
            # -1: the chain breaks inside the split; rows that leave it point to themselves
            jump = np.where(hit, inside, np.arange(len(at)))
            leave = np.where(to >= final, to, -1)
            for _ in range(max(1, math.ceil(math.log2(len(at) + 1)))):
                jump = jump[jump]
            columns = [part["file"].to_numpy(), part["split"].to_numpy(), part["seq"].to_numpy(), at, to, leave[jump]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["file", "split", "seq", "at", "to", "leaves"])


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each split: the candidates on the chain from its entry, by doubling the reached set."""
    for table, starts in whole_groups(batches, ["file", "split"]):
        for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            part = table.slice(start, end - start)
            at, to = part["at"].to_numpy(), part["to"].to_numpy()
            inside = np.minimum(np.searchsorted(at, to), len(at) - 1)
            jump = np.append(np.where(at[inside] == to, inside, len(at)), len(at))
            seen = np.append(at == part["entry"].to_numpy()[0], False)
            for _ in range(max(1, math.ceil(math.log2(len(at) + 1)))):
                seen[jump[np.flatnonzero(seen)]] = True
                jump = jump[jump]
            rows = np.flatnonzero(seen[:-1])
            columns = [pa.array(part[c].to_numpy()[rows]) for c in ("file", "split", "seq", "at")]
            yield pa.RecordBatch.from_arrays(columns, ["file", "split", "seq", "at"])


def _chain(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, split, seq, at) of the true records, and of every piece."""
    totals = pieces.groupBy("file", "split").agg(F.sum("bytes").alias("sum"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", "split", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    rows = pieces.join(bases, ["file", "split"]).repartition("file", "split").sortWithinPartitions("file", "split", "seq")
    schema = "file long, split long, seq long, at long, to long, leaves long"
    chains = materialize(rows.select("file", "split", "seq", "bytes", "span", "base").mapInArrow(_exits, schema), "warc-chains")
    # hops between splits: from a candidate to where its chain leaves the split, if a candidate stands there
    hops = chains.filter("leaves >= 0").select("file", F.col("at").alias("x"), F.col("leaves").alias("y"))
    hops = materialize(hops.join(chains.select("file", F.col("at").alias("y")), ["file", "y"], "left_semi"), "warc-hops")
    entries = materialize(chains.filter("at = 0").select("file", F.col("at").alias("x")), "warc-entries")
    reached = entries.count()
    while reached:
        new = entries.join(hops, ["file", "x"]).select("file", F.col("y").alias("x"))
        entries = materialize(entries.unionByName(new).distinct(), "warc-entries")
        count = entries.count()
        if count == reached:
            break
        reached = count
        further = hops.select("file", F.col("x").alias("y"), F.col("y").alias("z"))
        hops = materialize(hops.join(further, ["file", "y"]).select("file", "x", F.col("z").alias("y")), "warc-hops")
    entry = chains.join(entries.withColumnRenamed("x", "at"), ["file", "at"], "left_semi").select("file", "split", F.col("at").alias("entry"))
    rows = chains.drop("leaves").join(entry, ["file", "split"]).repartition("file", "split").sortWithinPartitions("file", "split", "seq")
    true = rows.mapInArrow(_reached, "file long, split long, seq long, at long")
    return materialize(true, "warc-records"), chains.select("file", "split", "seq", "at")


def _split_records(records: DataFrame, places: DataFrame, broken: DataFrame) -> DataFrame:
    """(file, split, seq, piece_at, at) of every piece of the true records in `broken`, which have more pieces than one."""
    marked = places.join(records.select("file", "split", "seq", F.col("at").alias("start")), ["file", "split", "seq"], "left")
    inside = Window.partitionBy("file", "split").orderBy("seq")
    marked = marked.withColumn("own", F.last("start", ignorenulls=True).over(inside))
    lasts = marked.groupBy("file", "split").agg(F.max("start").alias("last"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("file", "split", F.max("last").over(earlier).alias("carried"))
    owned = marked.join(carried, ["file", "split"]).select("file", "split", "seq", F.col("at").alias("piece_at"), F.coalesce("own", "carried").alias("at"))
    return owned.join(broken, ["file", "at"])


def _check_ends(table: DataFrame, spans: DataFrame) -> None:
    """Raise where a file's chain of records doesn't end with the file, so that no record is left out in silence."""
    sizes = table.groupBy("file").agg(F.min("path").alias("path"), (F.sum("bytes") - len(MAGIC)).alias("size"))
    ends = spans.groupBy("file").agg(F.max(F.col("at") + F.col("span")).alias("end"))
    found = sizes.join(ends, "file", "left").withColumn("end", F.coalesce("end", F.lit(0))).filter(F.col("end") != F.col("size")).first()
    if found is not None:
        raise ValueError(f"{found.path}: the chain of records ends at byte {found.end} of {found.size}")


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record: path, at, record_id, record_type, target_uri, refers_to, header_digest, http_bytes, payload_bytes, payload_digest, payload.

    payload_bytes and payload_digest are of the record's own payload; a revisit has none, see http_bytes and
    header_digest. The archives are scanned once and what is read is kept in the shared folder: splits may be cut
    differently in a later scan, when executors have come or gone. Without `payloads` only header fields and digests
    are kept, and pieces that aren't a whole record by their own header, and no payload column is returned; only if a
    payload holds whole records in a row, the archives are read once more.
    """
    parsed = _fields(_parsed(_pieces(spark, path))).withColumn("file", F.xxhash64("path"))
    if not payloads:
        parsed = parsed.withColumn("piece", F.when(F.col("bytes").eqNullSafe(F.col("span")), F.lit(None)).otherwise(F.col("piece")))
    table = materialize(parsed.select("file", "split", "seq", "bytes", "span", "path", *_NAMES, "piece"), "warc-pieces")
    records, places = _chain(table.select("file", "split", "seq", "bytes", "span"))
    spans = records.join(table.select("file", "split", "seq", "bytes", "span"), ["file", "split", "seq"])
    _check_ends(table, spans)
    broken = materialize(spans.filter("bytes <> span").select("file", "at", "span"), "warc-broken")
    some_broken = not broken.isEmpty()
    # a record of one piece is whole in its row
    one = table.filter(F.col("bytes") == F.col("span")).join(records, ["file", "split", "seq"])
    one = _fields(_parsed(one.select("path", "at", "piece"))).select(*_OUT) if payloads else one.select("path", "at", *_NAMES)
    if not some_broken:
        return one
    owned = materialize(_split_records(records, places, broken), "warc-owned")
    parts = table.select("file", "split", "seq", "path", "piece").join(owned, ["file", "split", "seq"])
    if not payloads and not parts.filter(F.col("piece").isNull()).isEmpty():
        return read_warc(spark, path).drop("payload")
    built = parts.groupBy("file", "at").agg(F.min("path").alias("path"), F.max("span").alias("span"), F.array_sort(F.collect_list(F.struct("piece_at", "piece"))).alias("ps"))
    magic = F.lit(MAGIC).cast("binary")
    glued = F.aggregate(F.slice("ps", 2, F.size("ps")), F.get("ps", F.lit(0))["piece"], lambda a, x: F.concat(a, magic, x["piece"]))
    # pieces after the declared end belong to no record
    many = _parsed(built.select("path", "at", F.substring(glued, F.lit(1), (F.col("span") - len(MAGIC)).cast("int")).alias("piece")))
    return one.unionByName(_fields(many).select(*one.columns))


_NAMES = ["record_id", "record_type", "target_uri", "refers_to", "header_digest", "http_bytes", "payload_bytes", "payload_digest"]
_OUT = ["path", "at", *_NAMES, "payload"]


def _fields(parsed: DataFrame) -> DataFrame:
    head = F.col("_head")
    # `body_at` counts the magic, which the piece lacks
    block = F.substring(F.col("piece"), (F.col("body_at") - len(MAGIC) + 1).cast("int"), F.col("content_length").cast("int"))
    out = parsed.withColumn("_block", block)
    http_head = _end_at(F.col("_block"))
    http = F.decode(F.substring(F.col("_block"), F.lit(1), http_head), "ISO-8859-1")
    is_http = _field(head, "Content-Type").startswith("application/http") & (http_head > 0)
    payload = F.when(is_http, F.substring(F.col("_block"), http_head + len(END), F.octet_length("_block"))).otherwise(F.col("_block"))
    out = out.withColumns({
        "record_id": F.regexp_extract(_field(head, "WARC-Record-ID"), "^<?([^>]*)", 1), "record_type": _field(head, "WARC-Type"), "target_uri": _field(head, "WARC-Target-URI"),
        "refers_to": F.nullif(F.regexp_extract(_field(head, "WARC-Refers-To"), "^<?([^>]*)", 1), F.lit("")), "header_digest": F.regexp_replace(_field(head, "WARC-Payload-Digest"), "^sha1:", ""),
        "http_bytes": F.when(is_http, F.nullif(F.regexp_extract(http, "(?i)content-length:[ ]*([0-9]+)", 1), F.lit("")).try_cast("bigint")),
        "payload": payload,
    })
    return out.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": digest(F.col("payload"))})
