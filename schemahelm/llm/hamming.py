"""Exact top-k search of binary codes by incremental multi-index hashing.

A code of ``segments * 16`` bits is cut into segments of 16 bits. Codes at a distance of at most ``segments * (r + 1) - 1``
differ by at most ``r`` bits in some segment, so after looking up all values within radius ``r`` in every segment's table, all
of these are known. The radius grows by one until a query's k-th verified distance lies inside what is covered.

Equal codes are searched once. There is one index for all queries: a row for each code and segment. The radius grows for all open
queries together. What is looked up are the distinct values of the open queries' segments, so the lookups of a radius are bounded by
the values that a segment can have, and a code is compared with a query where it is first met. The distance of the last of a
query's best codes so far bounds what later radii bring.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemahelm.llm.common import stash

SEGMENT = 16
#: Lookups in a task.
PROBES = 1 << 20


def sign_code(embedding: Column, bits: int = 64) -> Column:
    """64-bit code of a vector: bit ``i`` is set if element ``i`` is above zero. Null for vectors of another length."""
    terms = [F.when(F.get(embedding, F.lit(i)) > 0, F.lit(-(1 << 63) if i == 63 else 1 << i)).otherwise(F.lit(0)).cast("bigint") for i in range(bits)]
    code = terms[0]
    for t in terms[1:]:
        code = code.bitwiseOR(t)
    return F.when(F.size(embedding) == bits, code)


def _parts(code: Column, segments: int) -> list[Column]:
    """The code's segments as numbers, lowest bits first."""
    return [F.shiftrightunsigned(code, SEGMENT * s).bitwiseAND(F.lit((1 << SEGMENT) - 1)).cast("int") for s in range(segments)]


def _met(open_: DataFrame, tables: DataFrame, values: DataFrame, radius: int, tasks: int, segments: int) -> DataFrame:
    """Codes that differ from an open query by exactly ``radius`` bits in some segment and by less in none: q, found, least, distance.

    A pair is taken in the first segment of that kind only, so it is met once over all radii, and not if its distance is above the query's bound.
    """
    masks = [sum(1 << b for b in bits) for bits in combinations(range(SEGMENT), radius)]
    asked = open_.select("q", "bound", F.posexplode(F.array(*_parts(F.col("q"), segments))).alias("s", "w"))
    near = F.explode(F.expr(f"array({', '.join(map(str, masks))})")).alias("mask")
    probes = asked.select("s", "w").distinct().repartition(tasks, "s", "w").select("s", "w", near)
    probes = probes.select("s", "w", F.col("w").bitwiseXOR(F.col("mask")).alias("v")).join(F.broadcast(values), ["s", "v"])
    apart = F.col("q").bitwiseXOR(F.col("code"))
    pairs = asked.join(probes, ["s", "w"]).join(tables, ["s", "v"]).withColumn("distance", F.bit_count(apart)).where("distance <= bound")
    for t, part in enumerate(_parts(apart, segments)):
        pairs = pairs.where(F.bit_count(part) >= radius + F.when(F.col("s") > t, 1).otherwise(0))
    return pairs.select("q", F.col("code").alias("found"), "least", "distance")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, segments: int = 4) -> DataFrame:
    """(id, code) tables -> query_id, rank (from 1), neighbor_id, distance: the ``k`` nearest rows other than the query itself.

    Exact in Hamming distance, ties by id. Rows with a null id or code take no part; repeated rows are one row; fewer than
    ``k`` other rows give them all; empty tables give no rows.
    """
    rows = stash(vectors.select("id", "code").dropna().distinct(), "codes")
    asked = stash(queries.select(F.col("id").alias("query_id"), "code").dropna().distinct(), "queries")
    # Of each code the k + 1 least ids: no more can be among the k nearest of anything, the query itself left out.
    few = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    ids = stash(rows.withColumn("rn", few).where(F.col("rn") <= k + 1).select("code", "id"), "ids")
    index = stash(ids.groupBy("code").agg(F.min("id").alias("least")), "index")
    wanted = min(k + 1, index.count())
    tables = stash(index.select("code", "least", F.posexplode(F.array(*_parts(F.col("code"), segments))).alias("s", "v")), "tables")
    # At most 65,536 values a segment, whatever the number of codes.
    values = stash(tables.select("s", "v").distinct(), "values")
    open_ = stash(asked.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(SEGMENT * segments)), "open")
    best, done = None, []
    for radius in range(SEGMENT + 1):
        n = open_.count()
        if not n or not wanted:
            break
        tasks = 1 + min(n, 1 << SEGMENT) * segments * comb(SEGMENT, radius) // PROBES
        met = _met(open_, tables, values, radius, tasks, segments)
        if best is not None:
            met = met.unionByName(best.join(open_.select("q"), "q", "left_semi"))
        order = Window.partitionBy("q").orderBy("distance", "least")
        best = stash(met.withColumn("near", F.row_number().over(order)).where(F.col("near") <= wanted).drop("near"), "best")
        covered = segments * (radius + 1) - 1
        # All codes within ``covered`` are known; a query is done if its last wanted one lies there.
        far = F.max("distance")
        full = F.count(F.lit(1)) == wanted
        state = open_.select("q").join(best.groupBy("q").agg(full.alias("full"), far.alias("far")), "q", "left")
        state = stash(state.withColumn("closed", F.coalesce(F.col("full") & (F.col("far") <= covered), F.lit(radius == SEGMENT))), "state")
        done.append(best.join(state.where("closed").select("q"), "q", "left_semi"))
        open_ = state.where("NOT closed").select("q", F.when(F.col("full"), F.col("far")).otherwise(F.lit(SEGMENT * segments)).alias("bound"))
    empty = asked.sparkSession.createDataFrame([], "q bigint, found bigint, least bigint, distance int")
    found = reduce(DataFrame.unionByName, done, empty).select(F.col("q").alias("code"), "found", "distance")
    nearest = lambda by, n: F.row_number().over(Window.partitionBy(by).orderBy("distance", "neighbor_id")) <= n
    named = found.join(ids.select(F.col("code").alias("found"), F.col("id").alias("neighbor_id")), "found")
    named = named.withColumn("near", nearest("code", k + 1)).where("near").select("code", "neighbor_id", "distance")
    pairs = asked.join(named, "code").where("query_id != neighbor_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")
