"""Audit rows, summaries, filters, listings and field history."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemahelm.functions.jsondiff import nested_diff_counts, with_diff_counts
from schemahelm.functions.typing import col_of
from schemahelm.operators.paging import keyset_page
from schemahelm.operators.slices import sorted_slices
from schemahelm.schemas import DEFAULT_TENANT, FIELD_KEY

AUDIT_ORDER = (("applied_at", "desc"), ("id", "desc"))
_PAYLOAD_ACTIONS = ("snapshot", "rollback")


def audit_rows(changes: DataFrame, actor: str = "", now: Column | None = None, keys: Sequence[str] = FIELD_KEY) -> DataFrame:
    """Audit rows of a diff's real changes.

    Both documents always carry the same sorted members, so the key-line counts follow from comparing the
    columns: every member of an added or deleted field, each differing member twice for an update.
    """
    keys = list(keys)
    attrs = sorted(c[4:] for c in changes.columns if c.startswith("new_") and f"old_{c[4:]}" in changes.columns)
    members = sorted([*keys, *attrs])
    doc = lambda side: F.to_json(
        F.struct(*[(F.col(c) if c in keys else F.col(f"{side}_{c}")).alias(c) for c in members]), {"ignoreNullFields": "false"}
    )
    kind = F.col("change_type")
    differing = reduce(
        lambda a, b: a + b,
        [F.when(F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")), F.lit(0)).otherwise(F.lit(1)) for c in attrs],
        F.lit(0),
    )
    size = F.lit(len(members))
    added = F.when(kind == "added", size).when(kind == "deleted", F.lit(0)).otherwise(differing).cast("bigint")
    removed = F.when(kind == "deleted", size).when(kind == "added", F.lit(0)).otherwise(differing).cast("bigint")
    tenant = F.col("tenant_id") if "tenant_id" in keys else F.lit(DEFAULT_TENANT)
    return changes.where(kind != "unchanged").select(
        tenant.alias("tenant_id"),
        F.lit(actor).alias("actor"),
        F.when(kind == "added", F.lit("add")).when(kind == "deleted", F.lit("delete")).otherwise(F.lit("update")).alias("action"),
        "table_name",
        "column_name",
        F.when(kind != "added", doc("old")).alias("before_json"),
        F.when(kind != "deleted", doc("new")).alias("after_json"),
        added.alias("added_count"),
        removed.alias("removed_count"),
        (added + removed).alias("change_count"),
        (now if now is not None else F.lit(None).cast("timestamp_ntz")).alias("applied_at"),
    )


def action_rows(actions: DataFrame, now: Column | None = None) -> DataFrame:
    """Audit rows of high-level actions (snapshot, rollback, scan, access changes).

    Input: ``tenant_id, actor, action`` and optionally ``table_name`` (default ``registry``),
    ``column_name`` (for example a version), ``summary`` and ``payload`` (JSON text).
    """
    have = actions.columns
    opt = lambda name, default=None: F.col(name) if name in have else F.lit(default).cast("string")
    zero = F.lit(0).cast("bigint")
    return actions.select(
        "tenant_id",
        "actor",
        "action",
        opt("table_name", None if "payload" in have else "registry").alias("table_name"),
        opt("column_name").alias("column_name"),
        F.nullif(opt("summary"), F.lit("")).alias("before_json"),
        opt("payload").alias("after_json"),
        zero.alias("added_count"),
        zero.alias("removed_count"),
        zero.alias("change_count"),
        (now if now is not None else F.lit(None).cast("timestamp_ntz")).alias("applied_at"),
    )


def audit_summary(action: Column | str, change_count: Column | str, added: Column | str, removed: Column | str, before: Column | str) -> Column:
    """Text shown for an audit row: its payload, ``diff unavailable``, or ``+a -r``."""
    counts = F.concat(F.lit("+"), col_of(added).cast("string"), F.lit(" -"), col_of(removed).cast("string"))
    return (
        F.when(col_of(action).isin(*_PAYLOAD_ACTIONS), F.coalesce(col_of(before), F.lit("{}")))
        .when(col_of(change_count) == 0, F.lit("diff unavailable"))
        .otherwise(counts)
    )


def backfill_audit_counts(audit: DataFrame) -> DataFrame:
    """Recompute the counts of rows whose change count is zero or missing."""
    todo = F.coalesce("change_count", F.lit(0)) == 0
    # Settled rows pass NULLs, which cost nothing to compare.
    df = audit.withColumn("_b", F.when(todo, F.col("before_json"))).withColumn("_a", F.when(todo, F.col("after_json")))
    df = with_diff_counts(df, "_b", "_a")
    added = F.when(todo, F.col("_counts.added")).otherwise(F.col("added_count").cast("bigint"))
    removed = F.when(todo, F.col("_counts.removed")).otherwise(F.col("removed_count").cast("bigint"))
    return df.withColumns(
        {
            "added_count": added,
            "removed_count": removed,
            "change_count": F.when(todo, F.col("_counts.added") + F.col("_counts.removed")).otherwise(
                F.col("change_count").cast("bigint")
            ),
        }
    ).drop("_a", "_b", "_counts")


def _instant(text: str) -> datetime:
    ts = datetime.fromisoformat(text)
    return ts.astimezone(timezone.utc).replace(tzinfo=None) if ts.tzinfo else ts


def _ntz(ts: datetime) -> Column:
    return F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz")


def filter_audit(
    audit: DataFrame,
    tenant: str | None = None,
    actor: str | None = None,
    table: str | None = None,
    column: str | None = None,
    action: str | None = None,
    from_ts: str | None = None,
    to_ts: str | None = None,
    min_changes: int | None = None,
    max_changes: int | None = None,
) -> DataFrame:
    """Audit filters, all of them plain comparisons that reach the scan.

    ``action`` is a comma list; ``to_ts`` includes the 24 hours after the instant; change bounds below zero
    count as zero.
    """
    df = audit
    for name, value in (("tenant_id", tenant), ("actor", actor), ("table_name", table), ("column_name", column)):
        if value:
            df = df.where(F.col(name) == value)
    actions = [a.strip() for a in (action or "").split(",") if a.strip()]
    if actions:
        df = df.where(F.col("action").isin(actions))
    if from_ts:
        df = df.where(F.col("applied_at") >= _ntz(_instant(from_ts)))
    if to_ts:
        df = df.where(F.col("applied_at") < _ntz(_instant(to_ts) + timedelta(hours=24)))
    if min_changes is not None:
        df = df.where(F.col("change_count") >= max(0, min_changes))
    if max_changes is not None:
        df = df.where(F.col("change_count") <= max(0, max_changes))
    return df


def resolve_actor(audit: DataFrame, users: DataFrame) -> DataFrame:
    """Actor id -> user name; an actor that is no user id stays as it is."""
    names = users.select(F.col("id").cast("string").alias("_id"), F.col("username").alias("_name"))
    joined = audit.join(names, F.col("actor") == F.col("_id"), "left")
    return joined.withColumn("actor", F.coalesce("_name", "actor")).drop("_id", "_name")


def audit_list(audit: DataFrame, users: DataFrame, limit: int = 50, after: dict | None = None, **filters) -> DataFrame:
    """One page of the audit log, newest first, with names and summaries.

    Filters and the cursor apply before the top-k, and only the page meets the user table.
    """
    page = keyset_page(filter_audit(audit, **filters), AUDIT_ORDER, after, limit)
    empty = F.lit("{}")
    return resolve_actor(page, users).select(
        "id",
        "actor",
        "action",
        F.coalesce("table_name", F.lit("")).alias("table_name"),
        F.coalesce("column_name", F.lit("")).alias("column_name"),
        F.coalesce("before_json", empty).alias("before_json"),
        F.coalesce("after_json", empty).alias("after_json"),
        audit_summary("action", "change_count", "added_count", "removed_count", "before_json").alias("summary"),
        "change_count",
        "applied_at",
        "more",
    )


def audit_get(audit: DataFrame, users: DataFrame, id: int) -> DataFrame:
    """One audit record; counts are recomputed where none were stored."""
    row = audit.where(F.col("id") == id)
    stored = F.col("added_count") + F.col("removed_count")
    recompute = (stored == 0) & ~F.col("action").isin(*_PAYLOAD_ACTIONS)
    row = row.withColumn("_counts", nested_diff_counts("before_json", "after_json"))
    added = F.when(recompute, F.col("_counts.added")).otherwise(F.col("added_count"))
    removed = F.when(recompute, F.col("_counts.removed")).otherwise(F.col("removed_count"))
    text = F.concat(F.lit("+"), added.cast("string"), F.lit(" -"), removed.cast("string"))
    payload = F.col("action").isin(*_PAYLOAD_ACTIONS)
    summary = F.when(payload, F.coalesce("before_json", F.lit(""))).otherwise(text)
    url = F.concat(F.lit("/v1/audit-logs/"), F.col("id").cast("string"), F.lit("/diff"))
    return resolve_actor(row, users).withColumn("summary", summary).withColumn("diff_url", url).drop("_counts")


def field_history(audit: DataFrame, keys: Sequence[str] = ("tenant_id", "table_name", "column_name")) -> DataFrame:
    """Per field: number of each change, the state before it, and the time since the last one.

    The log is cut into slices along (field, time, id), so a field that holds much of it, even of one instant, takes
    as many slices as its share asks for. Windows run per field and slice; one small row for each carries the count and the
    last state over to the next slice.
    """
    keys = list(keys)
    part = [*keys, "_slice"]
    order = ["applied_at", "id"]
    df = sorted_slices(audit.select("id", *keys, "action", "applied_at", "after_json"), [*keys, *order]).rows
    tail = F.struct("applied_at", "after_json")
    slices = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"), F.max_by(tail, F.struct(*order)).alias("_tail"))
    chain = Window.partitionBy(*keys).orderBy("_slice")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(
        *part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), F.lag("_tail").over(chain).alias("_prev")
    )
    local = Window.partitionBy(*part).orderBy(*order)
    rows = df.withColumn("_no", F.row_number().over(local)).withColumn("_own", F.lag(tail).over(local))
    prev = F.when(F.col("_no") == 1, F.col("_prev")).otherwise(F.col("_own"))
    # Null-safe: rows of actions have no table or column, and they are a history as well.
    held = carried.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(part)), "_offset", "_prev")
    met = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(part)])
    rows = rows.join(held, met, "left").withColumn("_before", prev)
    gap = F.unix_micros(F.col("applied_at").cast("timestamp")) - F.unix_micros(F.col("_before.applied_at").cast("timestamp"))
    return rows.select(
        "id",
        *keys,
        "action",
        "applied_at",
        (F.col("_offset") + F.col("_no")).cast("bigint").alias("change_no"),
        F.col("_before.after_json").alias("previous_state"),
        gap.alias("micros_since_last"),
    )
