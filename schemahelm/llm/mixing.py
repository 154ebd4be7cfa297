"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Documents are dealt to shards by a seeded hash: a source to as many as leave it some tens of blocks in each, from a seeded one
on, so a source that holds a third of all rows is spread over all shards, and a small one is not rounded in each of
them. In each shard, every source's documents lie in a seeded order and their tokens are cut into blocks of equal length.
A shard gives its blocks to the sources by highest quotients, votes over 1, 3, 5, ...; a source's votes are the
blocks that its target asks of this shard, and it can take each of its blocks at most ``max_repeats`` times. The quota
is an integer: all blocks are taken ``quota // blocks`` times, and the rest is a run of neighbouring blocks from
a seeded place on, around the end. As the documents lie in random order the run is a random choice of documents, and at
most two of them are cut.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemahelm.llm.common import raw, slices, stash, table_types
from schemahelm.operators.slices import sorted_slices


@dataclass(frozen=True)
class MixPlan:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    max_repeats: int = 2
    block_tokens: int = 16
    cell_blocks: int = 64  # blocks that a source has in each of its shards, about, at least
    shard_tokens: int = 1 << 18
    seed: int = 17


def with_sizes(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` plus ``__size``: number of runs of other than ASCII white space in ``text``; null has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n = [len(t.split()) for t in raw(part.column("text"))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64())], [*part.schema.names, "__size"])

    return docs.mapInArrow(count, f"{table_types(docs)}, __size bigint")


def source_targets(sources: DataFrame, plan: MixPlan) -> DataFrame:
    """(__sk, __source_size), a row for each source -> the same plus __target.

    Shares by weight, at most ``max_repeats`` times the source's size, the excess shared anew until none is above. Weights
    repeat along the order of the names. Each round is one aggregate, whatever the number of sources.
    """
    weights = F.array(*map(F.lit, plan.weights))
    last = F.col("__sk") == ""  # the null source
    ranked = sorted_slices(sources.select("__sk", "__source_size", last.alias("__last")), ["__last", "__sk"]).ranked("__rank")
    weighed = ranked.select("__sk", "__source_size", F.element_at(weights, (F.col("__rank") % len(plan.weights) + 1).cast("int")).alias("__weight"))
    weighed = stash(weighed.withColumn("__cap", (plan.max_repeats * F.col("__source_size")).cast("double")), "sources")
    size, weight = weighed.agg(F.sum("__source_size"), F.sum("__weight")).first()
    left, full = plan.share * (size or 0), -1
    while weight:
        over = F.lit(left) * F.col("__weight") / F.lit(weight) > F.col("__cap")
        # Once over, a source stays over: what is left for each weight only grows.
        n, caps, open_weight = weighed.agg(F.count_if(over), F.sum(F.when(over, F.col("__cap"))), F.sum(F.when(~over, F.col("__weight")))).first()
        if n == full:
            break
        full, left, weight = n, plan.share * size - (caps or 0.0), open_weight or 0.0
    share = F.lit(left) * F.col("__weight") / F.lit(weight) if weight else F.col("__cap")
    return weighed.select("__sk", "__source_size", F.least("__cap", share).alias("__target"))


def apportion(votes: np.ndarray, seats: int, capacity: np.ndarray) -> np.ndarray:
    """Seats by Sainte-Laguë, no party over its capacity: what handing them out one by one at the highest quotient gives.

    Rounding the votes at one vote a seat is the same up to a few seats, which are then given or taken singly.
    """
    n = np.minimum(np.floor(votes + 0.5).astype(np.int64), capacity)
    missing = seats - int(n.sum())
    if missing >= 0:
        heap = [(-votes[i] / (2 * n[i] + 1), i) for i in range(len(n)) if n[i] < capacity[i]]
        heapq.heapify(heap)
        while missing and heap:
            _, i = heapq.heappop(heap)
            n[i] += 1
            missing -= 1
            if n[i] < capacity[i]:
                heapq.heappush(heap, (-votes[i] / (2 * n[i] + 1), i))
    else:
        heap = [(votes[i] / (2 * n[i] - 1), -i) for i in range(len(n)) if n[i]]
        heapq.heapify(heap)
        while missing and heap:
            _, i = heapq.heappop(heap)
            n[-i] -= 1
            missing += 1
            if n[-i]:
                heapq.heappush(heap, (votes[-i] / (2 * n[-i] - 1), i))
    return n


def _source_key(source: Column) -> Column:
    """Never null: a null source gets a key that no other has."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _dealt(rows: DataFrame, plan: MixPlan, shards: int) -> DataFrame:
    """Rows of known sources with their shard."""
    spread = F.least(F.lit(shards), F.greatest(F.lit(1), F.floor(F.col("__source_size") / (plan.cell_blocks * plan.block_tokens))))
    first = F.xxhash64("__sk", F.lit(plan.seed))
    return rows.withColumn("__shard", F.pmod(F.pmod(first, F.lit(shards)) + F.pmod("__order", spread), F.lit(shards)).cast("int"))


def _quotas(rows: DataFrame, plan: MixPlan) -> tuple[DataFrame, int]:
    """(__sk, __order, __size) -> a row for each source and shard with its blocks and quota; the number of shards."""
    sources = rows.groupBy("__sk").agg(F.sum("__size").alias("__source_size"))
    known = stash(source_targets(sources, plan), "targets")
    whole = known.agg(F.sum("__source_size")).first()[0] or 0
    shards = max(1, -(-whole // plan.shard_tokens))
    cells = _dealt(rows.join(known, "__sk"), plan, shards).groupBy("__sk", "__shard").agg(
        F.sum("__size").alias("__cell"), F.first("__source_size").alias("__source_size"), F.first("__target").alias("__target")
    )
    block, repeats = plan.block_tokens, plan.max_repeats
    cells = cells.withColumn("__turn", F.xxhash64("__sk", "__shard", F.lit(plan.seed)))

    def share_out(pdf: pd.DataFrame) -> pd.DataFrame:
        # Ties go in a seeded order.
        pdf = pdf.sort_values(["__turn", "__sk"], ignore_index=True)
        cell, size = pdf["__cell"].to_numpy(), pdf["__source_size"].to_numpy()
        blocks = np.where(cell > 0, np.maximum(1, np.rint(cell / block)), 0).astype(np.int64)
        votes = np.where(size > 0, pdf["__target"].to_numpy() / np.maximum(size, 1), 0.0) * blocks
        quota = apportion(votes, int(np.rint(votes.sum())), repeats * blocks)
        return pdf.drop(columns="__turn").assign(__blocks=blocks, __quota=quota)

    schema = "__sk string, __shard int, __cell bigint, __source_size bigint, __target double, __blocks bigint, __quota bigint"
    return cells.groupBy("__shard").applyInPandas(share_out, schema), shards


def _taken(rows: DataFrame, quotas: DataFrame, plan: MixPlan, shards: int) -> DataFrame:
    """Rows with __sk, __order, __size, __tie -> the same plus __source_size, __target and __taken."""
    order = Window.partitionBy("__sk", "__shard").orderBy("__order", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    known = quotas.select("__sk", "__source_size").distinct()
    dealt = _dealt(rows.join(known, "__sk"), plan, shards).drop("__source_size")
    placed = dealt.withColumn("__end", F.sum("__size").over(order)).join(quotas, ["__sk", "__shard"])
    start, end, blocks = F.col("__end") - F.col("__size"), F.col("__end"), F.greatest("__blocks", F.lit(1))
    rest = F.col("__quota") % blocks
    first = F.pmod(F.xxhash64("__sk", "__shard", F.lit(plan.seed)), blocks)
    bound = lambda i: F.floor(i * F.col("__cell") / blocks).cast("bigint")
    overlap = lambda a, b: F.greatest(F.lit(0), F.least(end, b) - F.greatest(start, a))
    last = first + rest
    some = overlap(bound(first), bound(F.least(last, blocks))) + overlap(F.lit(0), bound(F.greatest(last - blocks, F.lit(0))))
    whole = F.floor(F.col("__quota") / blocks).cast("bigint")
    return placed.withColumn("__taken", (whole * F.col("__size") + some).cast("bigint"))


def _keyed(docs: DataFrame, plan: MixPlan) -> DataFrame:
    """Seeded order by id and text; equal rows are alike, so their order among each other does not matter."""
    return docs.select(
        "*", _source_key(F.col("source")).alias("__sk"), F.xxhash64("doc_id", "text", F.lit(plan.seed)).alias("__order"),
        F.col("doc_id").alias("__tie"),
    )


def mix(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """(doc_id, text, source) -> doc_id, source, size, source_size, target, taken; one row for each document.

    ``taken`` counts the words that the mix takes of a document, repeats included, at most ``max_repeats`` times its size. Null
    and blank texts have size 0 and nothing is taken; a null source is a source of its own, the last; a null id is kept;
    repeated rows are documents of their own. Other columns are not read; an empty table gives an empty result.
    """
    rows = with_sizes(_keyed(docs.select("doc_id", "text", "source"), plan)).drop("text")
    rows = stash(rows, "sizes")
    quotas, shards = _quotas(rows, plan)
    done = _taken(rows, stash(quotas, "quotas"), plan, shards)
    return done.select("doc_id", "source", F.col("__size").alias("size"), *(F.col(f"__{c}").alias(c) for c in ("source_size", "target", "taken")))


def mixed_documents(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns as they are, each as often as it is taken (a cut one if half of it is)."""
    sized = with_sizes(_keyed(docs, plan))
    narrow = stash(sized.select("__sk", "__order", "__size"), "sizes")
    quotas, shards = _quotas(narrow, plan)
    done = _taken(sized, stash(quotas, "quotas"), plan, shards)
    times = F.floor((F.col("__taken") * 2 + F.col("__size")) / (F.greatest("__size", F.lit(1)) * 2)).cast("int")
    copies = done.select(*docs.columns, times.alias("__times")).where("__times > 0")
    return copies.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)

