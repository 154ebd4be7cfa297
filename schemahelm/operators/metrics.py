"""Counters, histograms, fingerprints and indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemahelm.functions.text import norm_path

# --- fixed values -----------------------------------------------------------------------------------------
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
BREAKER_STATES = ["closed", "open", "half_open"]
# --- end of fixed values ----------------------------------------------------------------------------------


def fields_per_table(fields: DataFrame, by: Sequence[str] = ("table_name",)) -> DataFrame:
    return fields.groupBy(*by).agg(F.count(F.lit(1)).alias("fields"))


def count_distinct_tables(fields: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tables touched; distinct rows first, so that a large group is folded before the final count."""
    return fields.select(*by, "table_name").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("tables"))


def request_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("tenant", "method", norm_path("path").alias("path"), F.col("status").cast("string").alias("status")).agg(
        F.count(F.lit(1)).alias("requests")
    )


def latency_histogram(log: DataFrame, value: str = "duration_s", by: Sequence[str] = ("tenant", "method", "path"), buckets: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """Cumulative buckets (``le``) with sum and count of each series; one pass, then a row-local expansion."""
    log = log.withColumn("path", norm_path("path")) if "path" in by else log
    v = F.col(value)
    counted = log.groupBy(*by).agg(
        *[F.count_if(v <= b).alias(f"_b{i}") for i, b in enumerate(buckets)],
        F.count(F.lit(1)).alias("count"),
        F.round(F.sum(v), 2).alias("sum"),
    )
    entries = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"_b{i}").alias("cumulative")) for i, b in enumerate(buckets)]
    entries.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("cumulative")))
    return counted.select(*by, F.explode(F.array(*entries)).alias("_e"), "sum", "count").select(*by, "_e.*", "sum", "count")


def audit_counts(audit: DataFrame, by: Sequence[str] = ("action",)) -> DataFrame:
    return audit.groupBy(*by).agg(F.count(F.lit(1)).alias("events"))


def apply_error_counts(errors: DataFrame) -> DataFrame:
    """Apply errors by table and error text."""
    return errors.groupBy("table_name", "error").agg(F.count(F.lit(1)).alias("errors"))


def failure_counts(attempts: DataFrame) -> DataFrame:
    """Failures per target and transient flag."""
    return (
        attempts.where("outcome <> 'ok'")
        .groupBy("tkey", (F.col("outcome") == "transient").alias("transient"))
        .agg(F.count(F.lit(1)).alias("failures"))
    )


def state_gauge(states: DataFrame) -> DataFrame:
    """One-hot breaker state per target: a row for each state with 1 for the current one."""
    options = F.array(*[F.lit(s) for s in BREAKER_STATES])
    rows = states.select("tkey", F.col("state").alias("_now"), F.explode(options).alias("state"))
    return rows.select("tkey", "state", (F.col("state") == F.col("_now")).cast("bigint").alias("value"))


def hit_ratio(lookups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return lookups.groupBy(*by).agg(F.count_if(F.col("hit")).alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def label_counts(targets: DataFrame) -> DataFrame:
    """Targets per label, and all targets under the empty label."""
    entry = F.explode(F.concat(F.array(F.lit("")), F.col("label_set"))).alias("label")
    return targets.select(entry).groupBy("label").agg(F.count(F.lit(1)).alias("targets"))


def label_index(targets: DataFrame) -> DataFrame:
    """Inverted index: distinct (label, tkey) rows, sorted by both across and within partitions.

    Some labels are on every target. As rows, a label's keys spread over as many partitions as they need.
    """
    postings = targets.select(F.explode("label_set").alias("label"), "tkey").distinct()
    return postings.repartitionByRange("label", "tkey").sortWithinPartitions("label", "tkey")


def _digest_words(text: Column) -> list[Column]:
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("bigint") for i in range(4)]


def state_hash(df: DataFrame, by: Sequence[str] = (), id_col: str = "id", version_col: str = "version", updated_col: str = "updated_at") -> DataFrame:
    """Fingerprint of a registry per group, with the latest change.

    Each row's ``id@version#updated`` is hashed; the words of the hashes are added up, together with the row count, and
    hashed again. Sums need no order, so they fold map-side with a few numbers of state however large a group is; any
    change of a row changes the fingerprint, repeated rows count as often as they occur.
    """
    part = F.concat(F.col(id_col), F.lit("@"), F.col(version_col), F.lit("#"), F.col(updated_col).cast("string"))
    words = [w.alias(f"_w{i}") for i, w in enumerate(_digest_words(part))]
    folded = df.select(*by, F.col(updated_col), *words).groupBy(*by).agg(
        *[F.sum(F.col(f"_w{i}").cast("decimal(20,0)")).alias(f"_w{i}") for i in range(4)],
        F.count(F.lit(1)).alias("items"),
        F.max(updated_col).alias("last_modified"),
    )
    text = F.concat_ws(":", F.col("items").cast("string"), *[F.coalesce(F.col(f"_w{i}").cast("string"), F.lit("0")) for i in range(4)])
    return folded.select(*by, F.sha2(text, 256).alias("etag"), "items", "last_modified")


def changed_groups(current: DataFrame, stored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups whose fingerprint differs from the stored one (nothing else needs rewriting)."""
    old = stored.select(*by, F.col("etag").alias("_old"))
    return current.join(old, list(by), "left").where(~F.col("etag").eqNullSafe(F.col("_old"))).drop("_old")


def range_hashes(df: DataFrame, by: Sequence[str] = (), id_col: str = "id", digits: int = 2, **columns: str) -> DataFrame:
    """Leaves of a hash tree: the fingerprint of each range of hashed ids (their first ``digits`` hexadecimal digits).

    A node further up covers the leaves whose range it begins, so ranges of fewer digits are the same call.
    """
    return state_hash(df.withColumn("range", F.left(F.sha2(F.col(id_col).cast("string"), 256), F.lit(digits))), [*by, "range"], id_col, **columns)


def changed_ranges(current: DataFrame, stored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ranges whose fingerprints differ, those of one side only included: the rows to look at are in them."""
    keys = [*by, "range"]
    old = stored.select(*keys, F.col("etag").alias("_old"))
    return current.join(old, keys, "full").where(~F.col("etag").eqNullSafe(F.col("_old"))).select(*keys)
