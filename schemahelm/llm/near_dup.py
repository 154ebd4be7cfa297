"""MinHash near-duplicates from bottom-k sketches of one hash function.

1. A text's set of distinct word shingles is hashed once; its ``k`` smallest values are its sketch. Texts with equal
   sets (a 128-bit fingerprint of all values) fall into one class, and only classes go on.
2. Inverted lists: two sets that overlap by ``threshold`` share most of their smallest values, and with them runs of
   neighbouring ones. A class enters a list for each run of three neighbouring retained values. For sets no larger
   than the sketch such a run is certain at a similarity of 0.8: at most a quarter as many values are unshared as are
   shared, and those cannot cut the shared ones into runs of two (sets of four or five values also enter lists of runs of
   two). For larger sets the chance to share no run of 64 values is about 1e-10. Single values would put all texts
   with a common passage into one list.
3. Candidates come from lists that still hold different components: first each list's members against a centre, then
   all remaining pairs of short lists, and another centre for long ones. Links merge components, so a group of
   thousands of copies needs a few links for each member. What then remains in long lists meets by the rarest values of
   the full sets, which every two linked sets must share some of, so nothing is capped.
4. The union sketch of a pair (the k smallest values of both) estimates its similarity and drops clear misses; pairs
   that pass are decided on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from schemahelm.llm.bitmap import bitmap, has_bits
from schemahelm.llm.common import WordHashes, raw, row_key, shingle_hashes, slices, stash, without_rows
from schemahelm.llm.components import components

#: Retained values of a sketch.
K = 64
#: Lists up to this size are compared pair by pair, longer ones by centres and then by their rarest values.
SHORT = 24
#: Rounds of centres.
ROUNDS = 2
#: Chance that the estimate drops a pair right at the threshold.
MISS = 1e-7


def shingle_set(text: bytes, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; fewer words than ``words`` are one shingle, none is empty."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    return np.unique(shingle_hashes(hashes.array(tokens), min(words, len(tokens))))


def least_shared(threshold: float, k: int = K, miss: float = MISS) -> int:
    """Shared values of a union sketch that a pair at the threshold falls below with a chance of at most ``miss``."""
    below = 0.0
    for s in range(k + 1):
        below += comb(k, s) * threshold**s * (1 - threshold) ** (k - s)
        if below > miss:
            return s
    return k


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(row, doc_id, text) -> row, doc_id, n, fp1, fp2 (fingerprint of the whole set), key (of the row), sketch."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch):
                n, fps, least = [], [], []
                for text in raw(part.column("text")):
                    s = shingle_set(text, words, hashes)
                    n.append(len(s))
                    fps.append(xxhash.xxh3_128_digest(s.tobytes()))
                    least.append(s[:K].tobytes())
                fp = np.frombuffer(b"".join(fps), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array(n, pa.int64()), pa.array(fp[:, 0].copy()),
                     pa.array(fp[:, 1].copy()), part.column("key"), pa.array(least, pa.binary())],
                    ["row", "doc_id", "n", "fp1", "fp2", "key", "sketch"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("row", "doc_id", "key", "text").mapInArrow(
        compute, f"row bigint, doc_id {id_type}, n bigint, fp1 bigint, fp2 bigint, key bigint, sketch binary"
    )


def list_keys(nodes: DataFrame) -> DataFrame:
    """Classes (node, n, sketch) -> (key, node): one row for each list that a class enters."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, owners = [], []
            for node, n, sketch in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "sketch"))):
                s = np.frombuffer(sketch, np.uint64)
                own = [shingle_hashes(s, 3)] if n >= 5 else []
                if n <= 5:
                    own.append(shingle_hashes(s, 2))
                for x in own:
                    keys.append(x)
                    owners.append(np.full(len(x), node, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], ["key", "node"]
            )

    return nodes.select("node", "n", "sketch").mapInArrow(compute, "key bigint, node bigint")


def _estimate(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that may be links: a, b, fingerprints, and ``sure`` where the sketches are the whole sets."""
    side = lambda x: nodes.select(*(F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in ("node", "n", "fp1", "fp2", "sketch")))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    # A ratio of sizes below the threshold rules a link out.
    joined = joined.where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    least = least_shared(num / den)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed, sure = [], []
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "n_a", "n_b"))):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([p, q]))
                twice = both[1:][both[1:] == both[:-1]]
                whole = n <= K and m <= K
                if whole:
                    passed.append(den * len(twice) >= num * (n + m - len(twice)))
                else:
                    # The k smallest of the union; k values and their repeats end at this one.
                    last = np.unique(both)[K - 1]
                    passed.append(int(np.searchsorted(twice, last, "right")) >= least)
                sure.append(whole)
            keep = pa.array(passed, pa.bool_())
            cols = [batch.column(c) for c in ("a", "b", "fp1_a", "fp2_a", "fp1_b", "fp2_b")]
            out = pa.RecordBatch.from_arrays([*cols, pa.array(sure, pa.bool_())], ["a", "b", "fp1_a", "fp2_a", "fp1_b", "fp2_b", "sure"])
            yield out.filter(keep)

    return joined.mapInArrow(compute, "a bigint, b bigint, fp1_a bigint, fp2_a bigint, fp1_b bigint, fp2_b bigint, sure boolean")


def _confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Estimated pairs -> links (u, v), decided on the full sets."""
    side = lambda x: sets.select(*(F.col(c).alias(f"{c}_{x}") for c in ("fp1", "fp2", "items")))
    joined = pairs.where("NOT sure").join(side("a"), ["fp1_a", "fp2_a"]).join(side("b"), ["fp1_b", "fp2_b"])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for x, y in zip(batch.column("items_a").to_pylist(), batch.column("items_b").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([p, q]))
                shared = int((both[1:] == both[:-1]).sum())
                links.append(den * shared >= num * (len(p) + len(q) - shared))
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["u", "v"])
            yield out.filter(pa.array(links, pa.bool_()))

    decided = joined.select("a", "b", "items_a", "items_b").mapInArrow(compute, "u bigint, v bigint")
    return decided.union(pairs.where("sure").select("a", "b"))


def _candidates(lists: DataFrame, round_: int) -> DataFrame:
    """Pairs (a, b) of different components: members with their list's centre; in round 1 all pairs of short lists too.

    The centre is the member with the most company in all its lists, so the least changed of a group of copies; in round
    1 it is the next such one of another component.
    """
    centre = F.min(F.struct((-F.col("company")).alias("o"), "node", "comp"))
    pick = lambda rows: rows.groupBy("key").agg(centre.alias("c")).select("key", F.col("c.node").alias("head"), F.col("c.comp").alias("own"))
    starred = lists if round_ == 0 else lists.where(F.col("size") > SHORT)
    heads = pick(starred)
    if round_ == 1:
        heads = pick(starred.join(heads, "key").where("comp != own").select(starred.columns))
    pairs = starred.join(heads, "key").where("comp != own").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))
    if round_ == 1:
        short = lists.where(F.col("size") <= SHORT)
        left = short.select("key", F.col("node").alias("a"), F.col("comp").alias("comp_a"))
        right = short.select("key", F.col("node").alias("b"), F.col("comp").alias("comp_b"))
        pairs = pairs.union(left.join(right, "key").where("a < b AND comp_a != comp_b").select("a", "b"))
    return pairs.distinct()


def _prefix_pairs(lists: DataFrame, nodes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different components in long lists that can still be links, from the rarest values of the full sets.

    Two sets at the threshold share at least ``need`` values, so they share one of their ``n - need + 1`` rarest, in
    any one order of all values (prefix), and enough values follow it in both (position). Most values of a much changed copy occur nowhere else, and it then meets nobody.
    """
    sized = lists.join(nodes.select("node", "n"), "node")
    least = sized.groupBy("key").agg(F.min("n").alias("least"))
    members = sized.join(least, "key").groupBy("node", "comp", "n").agg(F.min("least").alias("least"))
    partner = F.greatest(F.col("least"), F.ceil(F.col("n") * num / den))
    members = members.withColumn("prefix", F.col("n") - F.ceil((F.col("n") + partner) * num / (num + den)) + 1).drop("least")

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [np.frombuffer(x, np.int64) for x in batch.column("items").to_pylist()]
            at = np.repeat(np.arange(len(items)), [len(x) for x in items])
            for i in range(0, len(at), 1 << 18):
                part = pa.array(at[i : i + (1 << 18)])
                flat = np.concatenate(items)[i : i + (1 << 18)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(part) for c in ("node", "comp", "n", "prefix")), pa.array(flat)], ["node", "comp", "n", "prefix", "value"])

    held = nodes.select("node", "fp1", "fp2", F.when(F.col("n") <= K, F.col("sketch")).alias("whole"))
    full = members.join(held, "node").join(sets, ["fp1", "fp2"], "left").select("node", "comp", "n", "prefix", F.coalesce("items", "whole").alias("items"))
    each = stash(full.mapInArrow(values, "node bigint, comp bigint, n bigint, prefix bigint, value bigint"), "values")
    owners = each.groupBy("value").agg(F.count("*").alias("owners"))
    order = Window.partitionBy("node").orderBy("owners", "value")  # the values of one text
    ranked = each.join(owners, "value").withColumn("rank", F.row_number().over(order)).where("rank <= prefix AND owners > 1")
    rare = stash(ranked.select("value", "node", "comp", (F.col("n") - F.col("rank") + 1).alias("rest"), "n"), "rare")
    # In each list, all but its largest component against everyone of another component.
    shares = rare.groupBy("value", "comp").agg(F.count("*").alias("n"))
    major = shares.groupBy("value").agg(F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1")
    alive = rare.join(major.select("value", F.col("m.comp").alias("major")), "value")
    side = lambda rows, x: rows.select("value", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "comp", "rest", "n")))
    # At the first value that two sets share, no more can follow than the shorter rest of both: if that is below what
    # the threshold asks of their sizes, the pair is none. The sizes themselves must be near enough as well.
    need = F.ceil((F.col("n_x") + F.col("n_y")) * num / (num + den))
    near = (F.least("rest_x", "rest_y") >= need) & (F.least("n_x", "n_y") * den >= F.greatest("n_x", "n_y") * num)
    pairs = side(alive.where("comp != major"), "x").join(side(alive, "y"), "value").where((F.col("comp_x") != F.col("comp_y")) & near)
    pairs = pairs.select(F.col("node_x").alias("x"), F.col("node_y").alias("y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _mixed(lists: DataFrame) -> DataFrame:
    """Rows of the lists that hold more than one component."""
    alive = lists.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    return lists.join(alive, "key")


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, text) -> row_key, doc_id, n_shingles, component_id, kept; one row for each document.

    Documents are linked if ``den * |intersection| >= num * |union|`` over their sets of ``words``-word shingles (A-Z lower-cased,
    words split at ASCII white space); num / den must be at least 0.8. ``component_id`` is the least id of a component and ``kept``
    tells whether a document has it. Null, empty and blank texts have no shingles and are linked with nothing. A null
    id is never the least, unless a component has no other; such documents have a null component and are kept. Repeated
    rows share a component. Other columns are not read; an empty table gives an empty result.
    """
    if num < 0.8 * den:
        raise ValueError("the runs of retained values need a similarity of at least 0.8")
    keyed = docs.select("doc_id", "text", row_key().alias("key"))
    rows = stash(sketches(keyed.withColumn("row", F.monotonically_increasing_id()), words), "sketches")
    nodes = stash(
        rows.where("n > 3").select(F.col("row").alias("node"), "n", "fp1", "fp2", F.col("key").alias("row_key"), "sketch").dropDuplicates(["fp1", "fp2"]),
        "classes",
    )
    keys = list_keys(nodes)
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stash(keys.join(sizes, "key"), "members")
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    lists = stash(members.join(company, "node").select("key", "node", "size", "company", F.col("node").alias("comp")), "lists")

    # A set that the sketch holds whole is compared in full with a larger one, if the threshold lets them be linked.
    listed = nodes.join(lists.select("node").distinct(), "node").where(F.col("n") * den > K * num)
    wanted = bitmap(listed, F.col("row_key"))

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            hit = has_bits(wanted.value, batch.column("key").to_numpy())
            for part in slices(batch.select(["text"]).filter(pa.array(hit))):
                sets = [shingle_set(t, words, hashes) for t in raw(part.column("text"))]
                fp = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp[:, 0].copy()), pa.array(fp[:, 1].copy()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["fp1", "fp2", "items"],
                )

    sets = stash(
        keyed.select("key", "text").mapInArrow(full_sets, "fp1 bigint, fp2 bigint, items binary").dropDuplicates(["fp1", "fp2"]), "sets"
    )

    links, tried = [], None
    for round_ in range(ROUNDS + 1):
        if round_ < ROUNDS:
            pairs = _candidates(lists, round_)
        else:
            pairs = _prefix_pairs(lists, nodes, sets, num, den)
        # Pairs that failed the estimate may be met again; they fail again at little cost.
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        passed = stash(_estimate(pairs, nodes, num, den), "passed")
        found = stash(_confirm(passed, sets, num, den), "links")
        links.append(found)
        if round_ == ROUNDS:
            break
        tried = passed.select("a", "b") if tried is None else tried.union(passed.select("a", "b"))
        comp_of = lists.select("node", "comp").distinct()
        joined = (
            found.join(comp_of.select(F.col("node").alias("u"), F.col("comp").alias("cu")), "u")
            .join(comp_of.select(F.col("node").alias("v"), F.col("comp").alias("cv")), "v")
            .select(F.col("cu").alias("u"), F.col("cv").alias("v"))
        )
        merged = components(joined).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        lists = lists.join(merged, "comp", "left").select("key", "node", "size", "company", F.coalesce("to", "comp").alias("comp"))
        lists = _mixed(lists)
        if round_ >= 1:
            lists = lists.where(F.col("size") > SHORT)
        lists = stash(lists, "lists")
        if lists.isEmpty():
            break

    edges = links[0]
    for more in links[1:]:
        edges = edges.union(more)
    comp = components(edges)
    named = nodes.select("node", "fp1", "fp2").join(comp, "node").select("fp1", "fp2", "comp")
    classes = rows.where("n > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("least")).join(named, ["fp1", "fp2"], "left")
    least = classes.where("comp IS NOT NULL").groupBy("comp").agg(F.min("least").alias("component"))
    classes = classes.join(least, "comp", "left").select("fp1", "fp2", F.coalesce("component", "least").alias("component"))
    result = rows.select("doc_id", "n", "fp1", "fp2", F.col("key").alias("row_key")).join(classes, ["fp1", "fp2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return result.select("row_key", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that have the least id of their component; see ``near_duplicates``."""
    return without_rows(docs, near_duplicates(docs, words, num, den).where("NOT kept"))
