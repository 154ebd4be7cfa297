"""Label selectors and routing of requests to targets.

Requests are many, targets may be many too. A request therefore never carries the list of candidates: the
choice is looked up by an equality (rank of the hash, preferred label, key) in a table with one small row
per target or label.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemahelm.functions.labels import has_any_label, has_label
from schemahelm.functions.text import fnv1a32
from schemahelm.functions.typing import col_of

_IN = re.compile(r"^([a-z0-9_\-]+)\s+in\s+\(([^)]*)\)$")
_TOP_COMMA = re.compile(r",(?![^(]*\))")


def selector(query: str | Sequence[str], labels: Column | str = "label_set") -> Column:
    """Condition of a selector over a normalised label array.

    Text: ``a=b``, ``k in (x,y)``, ``k``, ``!k``; a comma is AND, a bar separates OR groups, case does not
    matter, and an empty text selects everything. A list of labels is an AND of them.
    """
    have = col_of(labels)
    if not isinstance(query, str):
        return reduce(lambda a, b: a & b, [has_label(have, q) for q in query if q], F.lit(True))
    groups = [
        reduce(lambda a, b: a & b, [_term(t, have) for t in map(str.strip, _TOP_COMMA.split(group)) if t], F.lit(True))
        for group in query.strip().lower().split("|")
    ]
    return reduce(lambda a, b: a | b, groups)


def _term(token: str, have: Column) -> Column:
    if token.startswith("!"):
        return ~has_label(have, token[1:].strip())
    listed = _IN.match(token)
    if listed:
        values = [v.strip() for v in listed[2].split(",") if v.strip()]
        return has_any_label(have, [f"{listed[1]}={v}" for v in values])
    if "=" in token:
        key, value = token.split("=", 1)
        return has_label(have, f"{key.strip()}={value.strip()}")
    return has_label(have, token)


def select_targets(targets: DataFrame, query: str | Sequence[str], labels: str = "label_set") -> DataFrame:
    return targets.where(selector(query, labels))


def find_label(targets: DataFrame, label: str) -> DataFrame:
    return targets.where(has_label("label_set", label)).orderBy("tkey")


def find_all(targets: DataFrame, *labels: str) -> DataFrame:
    """Targets that hold all labels; no label finds nothing."""
    cond = reduce(lambda a, b: a & b, [has_label("label_set", x) for x in labels]) if labels else F.lit(False)
    return targets.where(cond).orderBy("tkey")


def find_any(targets: DataFrame, *labels: str) -> DataFrame:
    return targets.where(has_any_label("label_set", list(labels))).orderBy("tkey")


# --- ranks ------------------------------------------------------------------------------------------------


def ordered_index(df: DataFrame, key: str, index: str = "idx", slices: int = 64) -> DataFrame:
    """Add the zero-based position of each (unique) key in sort order.

    A bounded sample (the ``4 * slices`` keys with the smallest hashes) cuts the key range into slices; positions are
    counted per slice and shifted by the sizes of the slices before. The cuts only balance the work, the positions are
    exact for any cuts. Nothing runs before the result is used.
    """
    # One row: the sample is a limit, its cuts an array of at most ``slices`` keys.
    sample = df.select(F.col(key).alias("_k")).orderBy(F.sha2(F.col(key).cast("string"), 256)).limit(4 * slices)
    cuts = sample.agg(F.array_sort(F.collect_list("_k")).alias("_s")).select(
        F.filter("_s", lambda x, i: (i > 0) & (i % 4 == 0)).alias("_cuts"), F.lit(1).alias("_one")
    )
    rows = df.withColumn("_one", F.lit(1)).join(F.broadcast(cuts), "_one").drop("_one")
    rows = rows.withColumn("_slice", F.size(F.filter("_cuts", lambda c: c <= F.col(key)))).drop("_cuts")
    # At most ``slices`` rows of sizes.
    sizes = rows.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(1)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    local = F.row_number().over(Window.partitionBy("_slice").orderBy(key)) - 1
    return (
        rows.withColumn("_local", local)
        .join(F.broadcast(shifts), "_slice")
        .withColumn(index, (F.col("_local") + F.col("_shift")).cast("bigint"))
        .drop("_slice", "_local", "_shift")
    )


# --- choice of a target -----------------------------------------------------------------------------------


def route(requests: DataFrame, targets: DataFrame, strategy: str = "first", query: str = "", prefer_col: str = "prefer_label", hash_col: str = "hash_source") -> DataFrame:
    """Requests with ``chosen``: one of the targets that match ``query``, or NULL.

    ``first`` takes the lowest key; ``prefer`` the lowest key that holds the request's preferred label, any
    candidate if only other targets hold it, and nothing if no target does; ``hash`` spreads by FNV-1a.
    """
    candidates = select_targets(targets, query).select("tkey", "label_set")
    lowest = candidates.agg(F.min("tkey").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row of totals for all requests.
    reqs = requests.withColumn("_one", F.lit(1)).join(F.broadcast(lowest.withColumn("_one", F.lit(1))), "_one").drop("_one")
    if strategy == "first":
        return reqs.withColumn("chosen", F.col("_first")).drop("_first", "_n")
    if strategy == "prefer":
        tagged = targets.select("tkey", "label_set", selector(query).alias("_in"))
        held = tagged.select("tkey", "_in", F.explode("label_set").alias("_label"))
        best = held.groupBy("_label").agg(F.min(F.when(F.col("_in"), F.col("tkey"))).alias("_best"))
        wanted = F.lower(F.coalesce(F.col(prefer_col), F.lit("")))
        joined = reqs.withColumn("_want", wanted).join(best.withColumn("_held", F.lit(True)), F.col("_want") == F.col("_label"), "left")
        chosen = F.when(F.col("_want") == "", F.col("_first")).when(F.col("_held"), F.coalesce("_best", "_first"))
        return joined.withColumn("chosen", chosen).drop("_first", "_n", "_want", "_label", "_best", "_held")
    if strategy == "hash":
        ranks = ordered_index(candidates.select("tkey"), "tkey", "_idx").withColumnRenamed("tkey", "chosen")
        source = F.coalesce(F.nullif(F.col(hash_col), F.lit("")), F.col("_first"))
        reqs = reqs.withColumn("_source", source)
        # Sources repeat far more than they differ, and hashing goes byte by byte: each is hashed and placed once.
        placed = reqs.select("_source", "_n").distinct().where("_source IS NOT NULL")
        spot = F.when(F.col("_n") > 0, F.pmod(fnv1a32("_source"), F.col("_n")))
        placed = placed.withColumn("_idx", spot).join(ranks, "_idx").select("_source", "chosen")
        return reqs.join(placed, "_source", "left").drop("_source", "_first", "_n")
    raise ValueError(f"unknown strategy: {strategy}")


def resolve_target(requests: DataFrame, targets: DataFrame, query_choice: str = "chosen", tenant_prefix: str = "tenant:", default_key: str | None = None) -> DataFrame:
    """``resolved``: the explicit key if such a target exists, else the query's choice, else the tenant's own
    target, else the default."""
    keys = lambda name: targets.select(F.col("tkey").alias(name))
    df = requests.join(keys("_explicit"), F.col("explicit_key") == F.col("_explicit"), "left")
    own = F.concat(F.lit(tenant_prefix), F.nullif(F.col("tenant_id"), F.lit("")))
    df = df.withColumn("_own", own).join(keys("_tenant"), F.col("_own") == F.col("_tenant"), "left")
    choice = [F.col("_explicit")]
    if query_choice in requests.columns:
        choice.append(F.col(query_choice))
    choice += [F.col("_tenant"), F.lit(default_key)]
    return df.withColumn("resolved", F.coalesce(*choice)).drop("_explicit", "_own", "_tenant")


def candidate_ranks(requests: DataFrame, targets: DataFrame, query: str = "", unavailable: DataFrame | None = None, prefer_col: str = "prefer_label") -> DataFrame:
    """The complete order of targets for each label that requests prefer: ``want, rank`` (from 1), ``tkey``.

    Targets with the label come first, whether or not they match the query, then all others that match it; both by
    key. Without a known label ``want`` is ordered by key alone. Requests share these few orders; none carries its own.
    """
    usable = targets if unavailable is None else targets.join(unavailable.select("tkey"), "tkey", "left_anti")
    wants = requests.select(F.lower(F.coalesce(F.col(prefer_col), F.lit(""))).alias("want")).distinct()
    held = usable.select("tkey", F.explode("label_set").alias("want")).where("want <> ''").distinct().join(wants, "want", "left_semi")
    rest = select_targets(usable, query).select("tkey", F.lit(1).alias("_all")).join(wants.withColumn("_all", F.lit(1)), "_all").drop("_all")
    rest = rest.join(held, ["want", "tkey"], "left_anti")
    both = held.select("want", "tkey", F.lit(0).alias("_class")).unionByName(rest.select("want", "tkey", F.lit(1).alias("_class")))
    # One group for each wanted label, with the targets.
    order = Window.partitionBy("want").orderBy("_class", "tkey")
    return both.withColumn("rank", F.row_number().over(order)).select("want", "rank", "tkey")


def _primaries(requests: DataFrame, targets: DataFrame, ranks: DataFrame, unavailable: DataFrame | None, primary_col: str, prefer_col: str) -> DataFrame:
    """Requests with ``want``, ``primary`` (where it is usable) and the primary's rank in the order."""
    usable = targets if unavailable is None else targets.join(unavailable.select("tkey"), "tkey", "left_anti")
    known = usable.select(F.col("tkey").alias("primary"))
    rows = requests.withColumn("want", F.lower(F.coalesce(F.col(prefer_col), F.lit("")))).join(known, F.col(primary_col) == F.col("primary"), "left")
    own = ranks.select(F.col("want").alias("_w"), F.col("tkey").alias("_t"), F.col("rank").alias("_own"))
    return rows.join(own, (F.col("want") == F.col("_w")) & (F.col("primary") == F.col("_t")), "left").drop("_w", "_t")


def candidates(requests: DataFrame, targets: DataFrame, query: str = "", unavailable: DataFrame | None = None, primary_col: str = "explicit_key", prefer_col: str = "prefer_label") -> DataFrame:
    """Every order in which requests try targets, in full: ``primary, want, position`` (from 1), ``tkey``.

    A row for each distinct pair of primary and preferred label and each target: the primary, then the label's, then the rest. The
    number of attempts is a limit of the run (:func:`attempt_outcome`), not of the order.
    """
    ranks = candidate_ranks(requests, targets, query, unavailable, prefer_col)
    pairs = _primaries(requests, targets, ranks, unavailable, primary_col, prefer_col).select("want", "primary", "_own").distinct()
    first = F.col("primary").isNotNull().cast("int")
    moved = F.col("rank") + first - (F.col("rank") > F.coalesce("_own", F.lit(1 << 30))).cast("int")
    rest = pairs.join(ranks, "want").where(~F.col("tkey").eqNullSafe(F.col("primary"))).select("primary", "want", moved.alias("position"), "tkey")
    head = pairs.where("primary IS NOT NULL").select("primary", "want", F.lit(1).alias("position"), F.col("primary").alias("tkey"))
    return head.unionByName(rest)


def candidate_at(requests: DataFrame, targets: DataFrame, attempt: Column, query: str = "", unavailable: DataFrame | None = None, primary_col: str = "explicit_key", prefer_col: str = "prefer_label") -> DataFrame:
    """Requests with ``tkey``: the target of this attempt (from 1), NULL past the last; found by its rank in the shared order."""
    ranks = candidate_ranks(requests, targets, query, unavailable, prefer_col)
    rows = _primaries(requests, targets, ranks, unavailable, primary_col, prefer_col).withColumn("_at", attempt)
    after = F.when(F.col("primary").isNull(), F.col("_at")).otherwise(
        F.col("_at") - 1 + (F.col("_at") - 1 >= F.coalesce("_own", F.lit(1 << 30))).cast("int")
    )
    named = ranks.select(F.col("want").alias("_w"), F.col("rank").alias("_r"), F.col("tkey").alias("_next"))
    joined = rows.withColumn("_rank", after).join(named, (F.col("want") == F.col("_w")) & (F.col("_rank") == F.col("_r")), "left")
    chosen = F.when(F.col("primary").isNotNull() & (F.col("_at") == 1), F.col("primary")).otherwise(F.col("_next"))
    return joined.withColumn("tkey", chosen).drop("want", "primary", "_own", "_at", "_rank", "_w", "_r", "_next")


def for_each_target(targets: DataFrame, query: str, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """Call ``fn`` once per selected target, on the executors; ``fn`` gets the row and returns a result row.

    Target keys are unique, so the calls spread over the existing partitions without grouping.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([fn(row) for row in batch.to_dict("records")])

    return select_targets(targets, query).mapInPandas(run, schema)


# --- attempts ---------------------------------------------------------------------------------------------

# --- fixed values: error code -> transient and retryable
TRANSIENT_ERRORS = ["deadline_exceeded", "canceled", "timeout", "bad_connection"]


def classify_errors(code: Column | str) -> Column:
    """``struct(transient, retryable)`` of an error code; anything unknown is neither."""
    hit = F.coalesce(F.lower(col_of(code)).isin(TRANSIENT_ERRORS), F.lit(False))
    return F.struct(hit.alias("transient"), hit.alias("retryable"))


def backoff_ms(attempt: Column | str, base_ms: int, max_ms: int = 0) -> Column:
    """Wait after an attempt: doubles from ``base_ms``, up to ``max_ms`` where that is positive."""
    if base_ms <= 0:
        return F.lit(0).cast("bigint")
    n = col_of(attempt).cast("bigint")
    # Past 2**62 milliseconds the wait stays there instead of running over.
    wait = F.least(F.lit(base_ms) * F.pow(F.lit(2.0), n - 1), F.lit(float(1 << 62))).cast("bigint")
    capped = F.when(n > 1, F.least(wait, F.lit(max_ms))).otherwise(wait) if max_ms > 0 else wait
    return F.when(n > 0, capped).otherwise(F.lit(0).cast("bigint"))


def attempt_outcome(attempts: DataFrame, max_attempts: int = 3, write: bool = False, allow_write_retry: bool = False, base_ms: int = 100, max_ms: int = 0) -> DataFrame:
    """How each request ends.

    Input: ``request_id, attempt_no, tkey, outcome`` (ok, transient, permanent) and optionally ``available``.
    Unavailable targets are skipped; the first success or final error ends the run, as does the limit. The
    rank limit prunes map-side, so a request with very many rows sends few.
    """
    df = attempts.where("available") if "available" in attempts.columns else attempts
    order = Window.partitionBy("request_id").orderBy("attempt_no")
    tried = df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= max(max_attempts, 1))
    retry = (F.col("outcome") == "transient") & F.lit(not write or allow_write_retry)
    final = F.when((F.col("outcome") == "ok") | ~retry, F.col("_rn"))
    ended = tried.groupBy("request_id").agg(
        F.min(final).alias("_end"),
        F.min_by(F.struct("outcome", "tkey"), final).alias("_last"),
        F.count(F.lit(1)).alias("_n"),
    )
    used = F.coalesce("_end", "_n")
    failed = F.when(F.col("_end").isNull(), F.col("_n")).otherwise(F.col("_end") - 1)
    waits = F.aggregate(
        F.sequence(F.lit(0), failed.cast("int")), F.lit(0).cast("bigint"), lambda acc, i: acc + backoff_ms(i, base_ms, max_ms)
    )
    status = (
        F.when(F.col("_end").isNull(), F.lit("exhausted"))
        .when(F.col("_last.outcome") == "ok", F.lit("ok"))
        .otherwise(F.lit("failed"))
    )
    return ended.select(
        "request_id",
        status.alias("status"),
        used.cast("bigint").alias("attempts"),
        F.col("_last.tkey").alias("tkey"),
        waits.alias("waited_ms"),
    )
