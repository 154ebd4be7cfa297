"""Versioned registry snapshots stored as exploded rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemahelm.functions.text import next_semver
from schemahelm.operators.audit import action_rows
from schemahelm.operators.diff import diff, diff_summary
from schemahelm.operators.merge import Applied, apply
from schemahelm.schemas import FIELD_KEY, STAMPS

_META = ("tenant_id", "semver", "snapshot_id", "taken_at", "author")


def latest_snapshot(snapshots: DataFrame, tenants: DataFrame | None = None) -> DataFrame:
    """Latest version per tenant; tenants without any have ``0.0.0``."""
    latest = snapshots.groupBy("tenant_id").agg(
        F.max_by("semver", "snapshot_id").alias("semver"), F.max("snapshot_id").alias("snapshot_id")
    )
    if tenants is None:
        return latest
    joined = tenants.select("tenant_id").distinct().join(latest, "tenant_id", "left")
    return joined.withColumn("semver", F.coalesce("semver", F.lit("0.0.0"))).withColumn(
        "snapshot_id", F.coalesce("snapshot_id", F.lit(0).cast("bigint"))
    )


def list_snapshots(snapshots: DataFrame, n: int = 20, tenant: str | None = None) -> DataFrame:
    """The newest ``n`` snapshots per tenant. Field rows fold to snapshots before the ranking."""
    rows = snapshots if tenant is None else snapshots.where(F.col("tenant_id") == tenant)
    listed = rows.groupBy("tenant_id", "semver", "snapshot_id").agg(F.count(F.lit(1)).alias("fields"))
    newest = Window.partitionBy("tenant_id").orderBy(F.col("snapshot_id").desc())
    return listed.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn")


def get_snapshot(snapshots: DataFrame, tenant: str, semver: str) -> DataFrame:
    """One version; with the table partitioned by tenant and version only its files are read."""
    return snapshots.where((F.col("tenant_id") == tenant) & (F.col("semver") == semver))


class Created(NamedTuple):
    rows: DataFrame
    summary: DataFrame


def create_snapshots(fields: DataFrame, snapshots: DataFrame, bump: str = "patch", compare: Sequence[str] | str = "all") -> Created:
    """Next snapshot of every tenant that has fields: the rows to append, and one summary row per tenant.

    Rows hold the whole definition of a field, all columns of ``fields`` but the time stamps, whatever columns older
    snapshots have; a summary compares what both have. A tenant without fields gets none. The summary is ``+added -deleted`` against the tenant's latest
    snapshot, empty for the first one.
    """
    tenants = fields.select("tenant_id").distinct()
    last = latest_snapshot(snapshots, tenants)
    new = last.select(
        "tenant_id",
        next_semver("semver", bump).alias("semver"),
        (F.col("snapshot_id") + 1).alias("snapshot_id"),
        (F.col("semver") != "0.0.0").alias("_has_last"),
    )
    payload = [c for c in fields.columns if c not in _META and c not in STAMPS]
    shared = [c for c in payload if c in snapshots.columns]
    keys = [c for c in FIELD_KEY if c == "tenant_id" or c in shared]
    rows = fields.select("tenant_id", *payload).join(new.drop("_has_last"), "tenant_id")
    previous = snapshots.join(last.select("tenant_id", "semver"), ["tenant_id", "semver"], "left_semi").select("tenant_id", *shared)
    counts = diff_summary(diff(previous, fields.select("tenant_id", *shared), keys, compare), ["tenant_id"])
    text = F.concat(F.lit("+"), F.col("added").cast("string"), F.lit(" -"), F.col("deleted").cast("string"))
    summary = new.join(counts, "tenant_id", "left").select(
        "tenant_id", "semver", F.when(F.col("_has_last"), text).otherwise(F.lit("")).alias("summary")
    )
    return Created(rows, summary)


class RolledBack(NamedTuple):
    applied: Applied
    action: DataFrame


def rollback(current: DataFrame, snapshots: DataFrame, tenant: str, semver: str, actor: str = "", now: Column | None = None, compare: Sequence[str] | str = "all") -> RolledBack:
    """Apply a snapshot to a tenant's registry; the result carries the registry, its audit rows and the
    action row of the rollback itself.

    Fields are matched by their whole key, database included. Columns that the snapshot lacks keep their current values.
    """
    mine = current.where(F.col("tenant_id") == tenant)
    wanted = get_snapshot(snapshots, tenant, semver).drop("semver", "snapshot_id", "taken_at", "author")
    applied = apply(mine, wanted, actor, now, FIELD_KEY, compare)
    text = F.concat(F.lit("+"), F.col("added").cast("string"), F.lit(" -"), F.col("deleted").cast("string"))
    action = applied.summary.select(
        F.lit(tenant).alias("tenant_id"),
        F.lit(actor).alias("actor"),
        F.lit("rollback").alias("action"),
        F.lit(semver).alias("column_name"),
        text.alias("summary"),
    )
    return RolledBack(applied, action_rows(action, now))
