"""A Merkle manifest of a dataset, whose proofs come from a butterfly exchange of subtree roots; DataFrame functions only.

A row's leaf is the SHA-256 of its fields; digests are lower-case hex text. Within each group, leaves in order form runs
of FANOUT consecutive nodes, and a run (the last may be shorter, even of one) becomes the digest of its joined digests,
until one node is left: the group's subroot. Subroots in the order of their groups form a tree of the same kind, whose
last node is the root.

Leaves get their places from a range sort and counts of its partitions. Aligned blocks of FANOUT ** LEVELS leaves hash
their own subtree. Then blocks swap roots round by round: in round r a block sends the root of its subtree of
FANOUT ** r blocks to the blocks of its aligned group of FANOUT ** (r + 1) that have its place within their own subtree;
where the last subtree of a group is incomplete, its blocks answer in turn for the places that it lacks. Each block
receives every subtree's root exactly once, hashes the parent itself, as all its neighbours do, and keeps its siblings:
after the last round it holds its whole proof, and no pass goes back down. A round moves FANOUT digests a block, so rows
of a round are the blocks times FANOUT, whatever the group sizes; a group that holds most rows only has more blocks.
The tree of subroots takes the same rounds with a subroot in the place of a block.

Nulls in a field are `-`; null groups are one group and come first, as do null orders. Rows of equal order follow each
other by their leaf; exact copies of a row take neighbouring places, which of them is which is not told. Empty texts
and texts of any length are hashed whole. An empty table gives no row; a table of one row has its leaf as root and an
empty proof. Only the fields, the order, the group and the columns in `keep` are read; `keep` must not hold a column
named as one of the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FANOUT = 8
#: Levels of a block's own subtree: 512 leaves.
LEVELS = 3
#: Rows of the counts of partitions and groups up to which they are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 100_000
RESULTS = ("leaf", "place", "subroot", "root", "proof")
_STEP = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(*fields: Column) -> Column:
    """The digest of fields, each `-` if null, else its length in UTF-8 bytes, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings, level by level, give."""
    return F.aggregate(proof, leaf, lambda x, step: digest(step["left"], x, step["right"]))


def siblings(proof: Column) -> Column:
    """A proof's digests, level by level, left to right, joined."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def ranged(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows sorted by range over all partitions; equal rows are told apart by where they were read, so copies of one are spread as well."""
    salted = df.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    return salted.repartitionByRange(*columns, "_salt").sortWithinPartitions(*columns, "_salt").drop("_salt")


def ranked(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """Add `place`, from 0 without gaps within each group, in the order of `order`, and `total`, the group's rows.

    Rows are sorted by range over all partitions, so a group may fill many of them; what each partition holds of each
    group is counted, and the counts of the partitions before it are added.
    """
    ordered = ranged(df, [*groups, *order])
    number = F.monotonically_increasing_id()
    placed = materialize(ordered.withColumns({"_part": F.shiftright(number, 33), "_at": number.bitwiseAND((1 << 33) - 1)}), "merkle-sorted")
    counts = placed.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    every = Window.partitionBy(*groups)
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    starts = counts.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("_part").alias("_p"), start.alias("_start"), F.sum("_n").over(every).alias("total"))
    starts = materialize(starts, "merkle-starts")
    # a row for each partition and group that meet
    if starts.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        starts = F.broadcast(starts)
    same = F.col("_part") == F.col("_p")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return placed.join(starts, same).withColumn("place", F.col("_at") + F.col("_start")).drop(*[f"_{g}" for g in groups], "_p", "_start", "_at", "_part")


def _runs(nodes: Column) -> Column:
    """The next level: a digest for each run of FANOUT nodes."""
    firsts = F.sequence(F.lit(1), F.size(nodes), F.lit(FANOUT))
    return F.transform(firsts, lambda i: F.sha2(F.array_join(F.slice(nodes, i, FANOUT), ""), 256))


def _step(nodes: Column, at: Column) -> Column:
    """What stands left and right of the node at `at` in its run."""
    own = F.pmod(at, F.lit(FANOUT))
    first = at - own + 1
    right = F.slice(nodes, at + 2, F.lit(FANOUT - 1) - own)
    return F.struct(F.array_join(F.slice(nodes, first, own), "").alias("left"), F.array_join(right, "").alias("right"))


def exchange(blocks: DataFrame) -> DataFrame:
    """(g, b, n, digest, proof) with the group's last digest and each block's whole proof.

    blocks: (g, b, n, digest, proof): group number, block number from 0, blocks of the group, the block's own digest.
    """
    span, most = 1, blocks.agg(F.max("n")).first()[0] or 0
    while span < most:
        done, active = blocks.filter(F.col("n") <= span), blocks.filter(F.col("n") > span)
        low = F.pmod("b", F.lit(span))
        subtree = (F.col("b") - low) / span
        subtree = subtree.cast("long")
        own = F.pmod(subtree, F.lit(FANOUT))
        base = F.col("b") - low - own * span
        size = F.least(F.lit(span).cast("long"), F.col("n") - (F.col("b") - low))
        last = F.least(F.lit(FANOUT - 1).cast("long"), F.floor((F.col("n") - 1 - base) / span))
        sends = active.select("g", "b", "n", "digest", "proof", low.alias("low"), own.alias("own"), base.alias("base"), size.alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("to"))
        to_first = F.col("base") + F.col("to") * span
        to_size = F.least(F.lit(span).cast("long"), F.col("n") - to_first)
        places = F.when(F.col("low") < to_size, F.sequence(F.col("low"), to_size - 1, F.col("size")))
        sent = sends.withColumn("at", F.explode(places)).withColumn("at", to_first + F.col("at"))
        mine = F.when(F.col("at") == F.col("b"), F.col("proof"))
        sent = sent.select("g", F.col("at").alias("b"), "n", F.struct("own", "digest").alias("root"), mine.alias("proof"))
        got = sent.groupBy("g", "b", "n").agg(F.array_sort(F.collect_list("root")).alias("roots"), F.first("proof", ignorenulls=True).alias("proof"))
        nodes = F.transform("roots", lambda r: r["digest"])
        at = F.pmod(F.floor(F.col("b") / span), F.lit(FANOUT)).cast("int")
        up = got.select("g", "b", "n", F.sha2(F.array_join(nodes, ""), 256).alias("digest"), F.array_append("proof", _step(nodes, at)).alias("proof"))
        blocks = materialize(done.unionByName(up), "merkle-round")
        span *= FANOUT
    return blocks


def _empty_proof() -> Column:
    return F.array().cast(f"array<{_STEP}>")


def manifest(df: DataFrame, fields: list[str], group: str, order: str, keep: tuple[str, ...] = (), levels: int = LEVELS) -> DataFrame:
    """The columns `keep`, leaf, place in the group, subroot, root and proof: array of (left, right) from the leaf up to the root.

    fields: the columns that a leaf holds, in their order; levels: those of a block's own subtree, 1 or more.
    """
    if levels < 1:
        raise ValueError("a block has one level or more")
    if set(keep) & set(RESULTS):
        raise ValueError(f"kept columns may not be named {RESULTS}")
    kept = F.struct(*keep) if keep else F.lit(None).cast("struct<none:int>")
    hashed = df.select(leaf_of(*[F.col(f) for f in fields]).alias("leaf"), F.col(group).alias("g"), F.col(order).alias("o"), kept.alias("row"))
    per_block = FANOUT**levels
    blocked = ranked(hashed, ["g"], ["o", "leaf"]).withColumns({"b": F.floor(F.col("place") / per_block), "n": F.ceil(F.col("total") / per_block)})
    own = blocked.groupBy("g", "b", "n").agg(F.array_sort(F.collect_list(F.struct("place", "leaf", "row"))).alias("rows"))
    own = own.select(
        F.to_json(F.struct("g")).alias("key"), "g", "b", "n", F.transform("rows", lambda r: r["leaf"]).alias("l0"),
        F.transform("rows", lambda r: F.struct(r["place"].alias("place"), r["row"].alias("row"))).alias("rows"),
    )
    # a level is built while more than one node of the group is left
    for i in range(1, levels + 1):
        below = F.col(f"l{i - 1}")
        own = own.withColumn(f"l{i}", F.when((F.col("n") > 1) | (F.size(below) > 1), _runs(below)).otherwise(below))
    own = materialize(own.withColumn("digest", F.element_at(f"l{levels}", 1)).drop(f"l{levels}"), "merkle-blocks")
    inner = exchange(own.select(F.col("key").alias("g"), "b", "n", "digest", _empty_proof().alias("proof")))
    tops = own.filter("b = 0").select("key", "g").join(inner.filter("b = 0").select(F.col("g").alias("key"), F.col("digest").alias("subroot")), "key")
    tops = materialize(ranked(tops, [], ["g"]), "merkle-groups")
    outer = exchange(tops.select(F.lit("").alias("g"), F.col("place").alias("b"), F.col("total").alias("n"), F.col("subroot").alias("digest"), _empty_proof().alias("proof")))
    outer = tops.select("key", "subroot", F.col("place").alias("b")).join(outer.select("b", F.col("digest").alias("root"), F.col("proof").alias("outer")), "b").drop("b")
    upper = inner.select(F.col("g").alias("key"), "b", F.col("proof").alias("inner")).join(outer, "key")
    upper = upper.select("key", "b", "subroot", "root", F.concat("inner", "outer").alias("upper"))

    def row(r: Column, i: Column) -> Column:
        local = [F.when((F.col("n") > 1) | (F.size(f"l{k}") > 1), _step(F.col(f"l{k}"), F.floor(i / FANOUT**k).cast("int"))) for k in range(levels)]
        proof = F.concat(F.array_compact(F.array(*local)), F.col("upper"))
        return F.struct(r["row"].alias("row"), F.get("l0", i).alias("leaf"), r["place"].alias("place"), proof.alias("proof"))

    whole = own.drop("g", "digest").join(upper, ["key", "b"]).select("subroot", "root", F.inline(F.transform("rows", row)))
    return whole.select(*(["row.*"] if keep else []), "leaf", "place", "subroot", "root", "proof")
