"""Shards by a k-d tree over metadata, cut at weighted medians.

Documents with equal texts form one point: its weight is their bytes, its coordinates are its metadata (source and
language as hashed positions, the logarithm of the size), and every point has a hashed tie position as well. A node with several
leaves to come is cut along its widest dimension where the bytes below are in proportion to the leaves below; the
cut is found by histograms over ever narrower brackets, one small aggregate for all nodes at once, until what is
left inside the bracket weighs a thousandth of a leaf. Equal texts have equal coordinates and so stay together, but for
those whose copies weigh too much for an even cut: such a point is salted into many.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemahelm.llm.common import stash

#: A position: 31 bits of the coordinate, then 31 bits that order equal ones.
_BITS = 31
_TOP = (1 << _BITS) - 1
#: Buckets of one histogram.
_BUCKET_BITS = 14
DIMENSIONS = ("at_source", "at_lang", "at_size", "at_tie")
_POINT = ["tk", "size", "text_crc32", "salt"]


@dataclass(frozen=True)
class Cut:
    node: int
    dimension: str
    at: int  # positions below go to child 2 * node, others to 2 * node + 1


def _of(node: Column, values: dict[int, int]) -> Column:
    """The value of the row's node, null where it has none."""
    return F.element_at(F.create_map(*[F.lit(x).cast("bigint") for pair in values.items() for x in pair]), node)


def _along(dimension: Column) -> Column:
    """The row's position along the dimension of this number."""
    return F.element_at(F.array(*DIMENSIONS), dimension.cast("int"))


def _with_node(points: DataFrame, cuts: list[list[Cut]]) -> DataFrame:
    """``points`` with the node that each is in after all levels of cuts; the root is 1. A node without a cut keeps its rows."""
    points = points.withColumn("node", F.lit(1).cast("bigint"))
    for level in cuts:
        node = F.col("node")
        along = _along(_of(node, {c.node: DIMENSIONS.index(c.dimension) + 1 for c in level}))
        child = 2 * node + (along >= _of(node, {c.node: c.at for c in level})).cast("bigint")
        points = points.withColumn("node", F.coalesce(child, node))
    return points


def _hashed(c: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(c, F.lit("position")), 64 - _BITS)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", "source", "lang", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("tk"), F.spark_partition_id().alias("chunk"), F.monotonically_increasing_id().alias("row"),
    )


def _points(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """(rows with salt, points): points have weight ``w``, coordinates and tie; heavy ones are salted."""
    key = ["tk", "size", "text_crc32"]
    groups = rows.groupBy(*key).agg(F.sum("size").alias("w"), F.min("source").alias("g_source"), F.min("lang").alias("g_lang"))
    groups = stash(groups, "groups")
    total = groups.agg(F.sum("w").alias("w"), F.max("size").alias("size")).first()
    # No document can be cut, so a group is split only if it outweighs the largest one. At most 32 groups a shard can.
    limit = max((total["w"] or 0) / (32 * shards), total["size"] or 0)
    heavy = groups.where(F.col("w") > limit).select(*key, F.lit(True).alias("heavy"))
    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("row", "doc_id"), F.lit(1 << 12))).otherwise(F.lit(0)).cast("int")
    salted = rows.join(F.broadcast(heavy), key, "left").withColumn("salt", salt).drop("heavy")
    parts = salted.where("salt != 0").groupBy(*key, "salt").agg(F.sum("size").alias("w"))
    parts = parts.join(groups.drop("w"), key)
    rest = salted.where("salt = 0").groupBy(*key, "salt").agg(F.sum("size").alias("w"), F.min("source").alias("s"), F.min("lang").alias("l"))
    # Both parts of a salted group take the group's metadata; for others it is their own.
    rest = rest.join(F.broadcast(heavy), key, "left").drop("heavy").select(*key, "salt", "w", F.col("s").alias("g_source"), F.col("l").alias("g_lang"))
    points = parts.select(*rest.columns).union(rest)
    log_size = F.least(F.log2(F.col("size").cast("double")) / 48, F.lit(1.0))
    tie = F.shiftrightunsigned(F.xxhash64("tk", "size", "text_crc32", "salt"), 64 - _BITS)
    at = lambda x: (x * (_TOP + 1) + tie).cast("bigint")
    return salted, points.select(
        *_POINT, "w", at(_hashed(F.coalesce("g_source", F.lit("")))).alias("at_source"), at(_hashed(F.coalesce("g_lang", F.lit("")))).alias("at_lang"),
        at(F.floor(log_size * _TOP).cast("bigint")).alias("at_size"), at(F.lit(0).cast("bigint")).alias("at_tie"),
    )


def _widest(points: DataFrame, cuts: list[list[Cut]], open_: dict[int, int], extents: dict[str, int]) -> tuple[dict[int, str], dict[int, tuple[int, int, int]]]:
    """For each open node its widest dimension (relative to the whole) and (least, greatest position + 1, weight)."""
    seen = _with_node(points, cuts).where(F.col("node").isin(list(open_)))
    aggs = [f(F.col(d)).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]
    dimension, bracket = {}, {}
    for r in seen.groupBy("node").agg(F.sum("w").alias("w"), *aggs).collect():  # one row for each open node
        # Ties do not widen a coordinate; if all coordinates are equal the ties are cut.
        width = {d: ((r[f"hi_{d}"] >> _BITS) - (r[f"lo_{d}"] >> _BITS)) / max(1, extents[d]) for d in DIMENSIONS}
        best = max(DIMENSIONS, key=lambda d: (width[d], d == "at_tie"))
        dimension[r["node"]] = best
        bracket[r["node"]] = (r[f"lo_{best}"], r[f"hi_{best}"] + 1, r["w"])
    return dimension, bracket


def build_tree(points: DataFrame, shards: int, slack: float = 1e-3) -> tuple[list[list[Cut]], dict[int, int]]:
    """Levels of cuts, and leaf -> shard number. ``slack``: share of a leaf's bytes that a cut may be off, besides one point."""
    first = points.agg(F.sum("w").alias("w"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).first()
    extents = {d: (first[d] or 0) >> _BITS for d in DIMENSIONS}
    whole = first["w"] or 0
    cuts: list[list[Cut]] = []
    leaves = {1: shards}
    while any(n > 1 for n in leaves.values()):
        open_ = {node: n for node, n in leaves.items() if n > 1}
        dimension, bracket = _widest(points, cuts, open_, extents)
        share = {node: n // 2 / n for node, n in open_.items()}
        goal = {node: round(bracket[node][2] * share[node]) if node in bracket else 0 for node in open_}
        lo = {node: bracket[node][0] if node in bracket else 0 for node in open_}
        hi = {node: bracket[node][1] if node in bracket else 1 for node in open_}
        below = dict.fromkeys(open_, 0)
        done = {node: lo[node] for node in open_ if node not in bracket}
        while len(done) < len(open_):
            todo = [node for node in open_ if node not in done]
            shift = {node: max(0, (hi[node] - lo[node] - 1).bit_length() - _BUCKET_BITS) for node in todo}
            node = F.col("node")
            seen = _with_node(points, cuts).where(node.isin(todo)).withColumn("at", _along(_of(node, {n: DIMENSIONS.index(dimension[n]) + 1 for n in todo})))
            seen = seen.where((F.col("at") >= _of(node, {n: lo[n] for n in todo})) & (F.col("at") < _of(node, {n: hi[n] for n in todo})))
            seen = seen.withColumn("off", F.col("at") - _of(node, {n: lo[n] for n in todo}))
            seen = seen.withColumn("step", _of(node, {n: 1 << shift[n] for n in todo}))
            filled = seen.groupBy("node", F.expr("off div step").alias("bucket")).agg(F.sum("w").alias("w"), F.min("at").alias("first"), F.max("at").alias("last"))
            order = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
            # At most 2**14 rows for each node, and one of them reaches the goal.
            upto = filled.withColumn("upto", F.sum("w").over(order) + _of(node, {n: below[n] for n in todo}))
            reached = upto.where(F.col("upto") >= _of(node, {n: goal[n] for n in todo}))
            for r in reached.groupBy("node").agg(F.min(F.struct("bucket", "w", "upto", "first", "last")).alias("b")).collect():
                n, b = r["node"], r["b"]
                if b["first"] == b["last"] or b["w"] <= slack * whole / shards:
                    # The bucket goes to the side that leaves the smaller error.
                    over, under = b["upto"] - goal[n], goal[n] - (b["upto"] - b["w"])
                    done[n] = b["last"] + 1 if over <= under else b["first"]
                else:
                    lo[n], hi[n], below[n] = b["first"], b["last"] + 1, b["upto"] - b["w"]
        cuts.append([Cut(n, dimension.get(n, "at_tie"), done[n]) for n in open_])
        leaves = {k: v for k, v in leaves.items() if v <= 1} | {
            c: v for n, k in open_.items() for c, v in ((2 * n, k // 2), (2 * n + 1, k - k // 2))
        }
    return cuts, {leaf: i for i, leaf in enumerate(sorted(leaves, key=lambda n: bin(n)))}


def shard(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, text, lang, source) -> doc_id, source, lang, size, text_crc32, law, shard, slot, grown_shard; a row for each document.

    The number of leaves is ``shards``, or what ``target_bytes`` for each asks. Shards have nearly equal sums of ``size``
    (UTF-8 bytes of the text, null none, plus one); ``slot`` numbers a shard's documents from 0 without gaps;
    ``grown_shard`` is null. Null metadata is a value of its own, the empty one; null ids are kept; repeated rows are equal texts; other
    columns are not read; an empty table gives an empty result.
    """
    rows = stash(_rows(docs), "rows")
    if target_bytes is not None:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    salted, points = _points(rows, shards)
    points = stash(points, "points")
    cuts, number = build_tree(points, shards)
    placed = _with_node(points, cuts).select(*_POINT, _of(F.col("node"), number).cast("int").alias("shard"))
    placed = stash(salted.join(placed, _POINT).select("doc_id", "source", "lang", "size", "text_crc32", "chunk", "row", "shard"), "placed")
    # Slots: numbers inside (shard, input split), after those of the splits before. A split has a bounded number of rows.
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "chunk", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("row")) - 1
    numbered = placed.withColumn("inside", inside).join(starts, ["shard", "chunk"])
    return numbered.select(
        "doc_id", "source", "lang", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("inside")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
