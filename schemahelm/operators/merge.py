"""Upserts, deletes and applied plans over registry tables.

An upsert is one full join on the whole key: each side is read and shuffled once, whatever the share of changed
rows. Deletes only filter the table by the change keys (an anti join), which streams the table where the keys
are small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemahelm.functions import typing as ty
from schemahelm.functions.text import dsn_has_database, semver_lt
from schemahelm.operators.diff import diff, diff_summary
from schemahelm.schemas import DEFAULT_PREFIX, FIELD_KEY, STAMPS
from schemahelm.session import cut_lineage, read_if_there
from schemahelm.sources.catalog import is_reserved


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str] = FIELD_KEY, now: Column | None = None) -> DataFrame:
    """``base`` with ``changes`` inserted or replaced by key.

    Each side is read once and meets the other in one full join. A replaced row keeps the ``created_at`` of the base; with
    ``now``, replaced and inserted rows get it as ``updated_at``, and inserted ones as ``created_at`` too. Columns that the
    changes lack are NULL in their rows, columns that the base lacks are NULL in untouched rows.
    """
    keys = list(keys)
    stamped = "created_at" in base.columns
    names = [*base.columns, *(c for c in changes.columns if c not in base.columns)]
    old = base.select(*keys, *(F.col(c).alias(f"old_{c}") for c in base.columns if c not in keys))
    new = changes.select(*keys, *(F.col(c).alias(f"new_{c}") for c in changes.columns if c not in keys), F.lit(True).alias("_new"))
    hit = F.col("_new").isNotNull()

    def column(c: str) -> Column:
        before = F.col(f"old_{c}") if c in base.columns else F.lit(None)
        after = F.col(f"new_{c}") if c in changes.columns else F.lit(None)
        if c == "created_at" and stamped:
            after = F.coalesce(before, after if now is None else now)
        elif c == "updated_at" and stamped and now is not None:
            after = now
        return F.when(hit, after).otherwise(before).alias(c)

    return old.join(new, keys, "full").select(*(F.col(c) if c in keys else column(c) for c in names))


def commit_upsert(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str] = FIELD_KEY, now: Column | None = None, partition: str = "tenant_id") -> None:
    """Upsert into a stored table, partitioned by ``partition``, which has to be one of the keys.

    Only partitions that occur in the changes are read and replaced, by a dynamic overwrite; files of all others stay as they
    are. The result is complete in the shared folder before the first file is replaced, so a run that breaks off can
    be repeated. A table that does not exist yet is created.
    """
    if partition not in keys:
        raise ValueError(f"{partition} is not one of the keys")
    stored = read_if_there(spark, path)
    if stored is None:
        stored = spark.createDataFrame([], changes.schema)
    touched = stored.join(changes.select(partition).distinct(), partition, "left_semi")
    merged = cut_lineage(upsert(touched, changes, keys, now), "commit")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def upsert_counts(base: DataFrame, changes: DataFrame, keys: Sequence[str] = FIELD_KEY, by: Sequence[str] = ()) -> DataFrame:
    """Rows an upsert inserts and updates; an existing key counts as updated even if nothing differs."""
    keys = list(keys)
    known = base.join(changes.select(*keys), keys, "left_semi").select(*keys).distinct().withColumn("_old", F.lit(True))
    old = F.col("_old").isNotNull()
    return changes.join(known, keys, "left").groupBy(*by).agg(
        F.count_if(~old).alias("inserted"), F.count_if(old).alias("updated")
    )


def delete_keys(base: DataFrame, keys_df: DataFrame, keys: Sequence[str] = FIELD_KEY) -> DataFrame:
    return base.join(keys_df.select(*keys), list(keys), "left_anti")


class Applied(NamedTuple):
    registry: DataFrame
    audit: DataFrame
    summary: DataFrame


class VersionTooOld(ValueError):
    """The registry schema is older than the document requires."""


def check_version(spark, required: str, current: str) -> None:
    """Refuse a document that needs a newer registry schema."""
    older = spark.range(1).select(semver_lt(F.lit(current), F.lit(required))).first()[0]
    if older is None:
        raise ValueError(f"invalid version: {current!r} or {required!r}")
    if older:
        raise VersionTooOld(f"registry schema {required} required, current {current}")


def apply(
    current: DataFrame,
    desired: DataFrame,
    actor: str = "",
    now: Column | None = None,
    keys: Sequence[str] = FIELD_KEY,
    compare: Sequence[str] | str = "all",
    dry_run: bool = False,
    by: Sequence[str] = (),
    required_version: str | None = None,
    current_version: str | None = None,
    materialize: bool = False,
) -> Applied | DataFrame:
    """Bring a registry to the desired state: diff, delete, upsert, audit rows and a summary.

    A dry run returns the summary only. Everything hangs on one diff, and the new registry is made from its rows without
    reading either side again; ``materialize`` writes it once to the shared folder, which pays off where several outputs
    are wanted from large tables. Columns that only the current registry has keep their values.
    """
    from schemahelm.operators.audit import audit_rows

    if required_version and current_version:
        check_version(current.sparkSession, required_version, current_version)
    changes = diff(current, desired, keys, compare)
    if materialize and not dry_run:
        changes = cut_lineage(changes, "diff")
    summary = diff_summary(changes, by)
    if dry_run:
        return summary
    keys = list(keys)
    return Applied(_after(changes, current.columns, desired.columns, keys, now), audit_rows(changes, actor, now, keys), summary)


def _after(changes: DataFrame, current: Sequence[str], desired: Sequence[str], keys: list[str], now: Column | None) -> DataFrame:
    """The registry after the changes: unchanged rows as they were, added and updated ones as desired."""
    stamped = all(c in current for c in STAMPS)
    changed = F.col("change_type") != "unchanged"

    def column(c: str) -> Column:
        if c in keys:
            return F.col(c)
        before = F.col(f"old_{c}") if c in current else F.lit(None)
        after = F.col(f"new_{c}") if c in desired else before
        if stamped and c == "created_at":
            after = F.coalesce(before, after if now is None else now)
        elif stamped and c == "updated_at" and now is not None:
            after = now
        return F.when(changed, after).otherwise(before).alias(c)

    names = [*current, *(c for c in desired if c not in current)]
    return changes.where("change_type <> 'deleted'").select(*map(column, names))


# --- database scans ---------------------------------------------------------------------------------------


def merge_validators(scan: DataFrame, existing: DataFrame, keys: Sequence[str] = FIELD_KEY, seen: str | None = None) -> DataFrame:
    """Keep configured validators on a rescan: the scanned value wins where it has one.

    The key has every column of the registry's key that the registry has, so equal names of two tenants or databases
    stay apart. ``seen`` names a column that is true where the registry has the key, else NULL; it comes from the same join.
    """
    keys = [k for k in keys if k in scan.columns]
    if not set(FIELD_KEY) & set(existing.columns) <= set(keys):
        raise ValueError(f"the scan needs the key columns of the registry: {sorted(set(FIELD_KEY) & set(existing.columns) - set(keys))}")
    configured = F.nullif(F.col("validator"), F.lit(""))
    rows = existing if seen else existing.where(configured.isNotNull())
    old = rows.groupBy(*keys).agg(F.max(configured).alias("_old"), *([F.lit(True).alias(seen)] if seen else []))
    found = F.nullif(F.col("validator"), F.lit("")) if "validator" in scan.columns else F.lit(None).cast("string")
    return (
        scan.join(old, keys, "left").withColumn("validator", F.coalesce(found, F.col("_old"), F.lit(""))).drop("_old")
    )


class Scan(NamedTuple):
    fields: DataFrame
    skipped: DataFrame
    summary: DataFrame
    errors: DataFrame


def scan_databases(
    scanned: DataFrame,
    existing: DataFrame,
    known_validators: Sequence[str],
    by: Sequence[str] = ("tenant_id", "db_id"),
    patterns: Sequence[str] | None = None,
) -> Scan:
    """Scan rows of any number of databases -> registry changes, skipped columns and counters per database.

    ``scanned`` comes from :func:`schemahelm.sources.catalog.scan_catalog` with the ``by`` columns.
    """
    keys = [*by, "table_name", "column_name"]
    # One row for each key of the registry, so this join keeps one row per scanned column.
    rows = merge_validators(scanned, existing, keys, seen="_known")
    unknown = (F.col("validator") != "") & ~F.col("validator").isin(list(known_validators))
    reason = F.when(is_reserved("table_name", patterns), F.lit("reserved")).when(unknown, F.lit("validator"))
    rows = rows.withColumn("reason", reason)
    kept, old = F.col("reason").isNull(), F.col("_known").isNotNull()
    per_table = rows.groupBy(*by, "table_name").agg(
        F.count_if(kept & ~old).alias("inserted"),
        F.count_if(kept & old).alias("updated"),
        F.count_if(~kept).alias("skipped"),
    )
    summary = per_table.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tables"),
        *[F.sum(c).alias(c) for c in ("inserted", "updated", "skipped")],
    )
    return Scan(
        rows.where(kept).drop("reason", "_known"),
        rows.where(~kept).select(*keys, "reason"),
        summary,
        rows.limit(0).select(*by, F.lit("").alias("error")),
    )


def scan_all(
    databases: DataFrame,
    scanned: DataFrame,
    existing: DataFrame,
    known_validators: Sequence[str],
    patterns: Sequence[str] | None = None,
) -> Scan:
    """One job over the catalogs of all databases; a bad database becomes an error row and stops nobody else.

    ``databases`` holds ``tenant_id, db_id, driver, dsn``.
    """
    by = ["tenant_id", "db_id"]
    error = F.when(
        ~dsn_has_database("driver", "dsn"), F.lit("monitored database DSN must include database name")
    ).when(~F.col("driver").isin("mysql", "postgres", "mongo"), F.concat(F.lit("unsupported driver: "), "driver"))
    # Written first: as a plan, the checks of addresses would move into the scans of both sides and run once a catalog row.
    checked = cut_lineage(databases.select(*by, error.alias("error")), "databases")
    bad = checked.where(F.col("error").isNotNull()).select(*by, "error")
    good = checked.where(F.col("error").isNull()).select(*by)
    result = scan_databases(scanned.join(good, by, "left_semi"), existing, known_validators, by, patterns)
    return result._replace(errors=bad)


def record_scan(tables: DataFrame, run_ts: str, target: str = "tkey") -> DataFrame:
    """Scan-history rows, one per target and table; append them partitioned by ``run_date``."""
    ts = F.to_timestamp_ntz(F.lit(run_ts))
    return tables.select(target, "table_name").distinct().select(
        F.col(target).alias("tenant_id"),
        F.col("table_name").alias("scan_id"),
        F.lit("ok").alias("status"),
        ts.alias("started_at"),
        ts.alias("finished_at"),
        F.to_date(ts).alias("run_date"),
    )


def ensure_databases(databases: DataFrame, fields: DataFrame, driver: str = "postgres") -> DataFrame:
    """Placeholder rows for database ids that fields refer to and nobody has registered."""
    ids = fields.select("tenant_id", ty.norm_db_id("db_id").alias("id")).distinct()
    return ids.join(databases.select("tenant_id", "id"), ["tenant_id", "id"], "left_anti").select(
        "tenant_id",
        "id",
        F.concat(F.lit("db_"), F.col("id").cast("string")).alias("name"),
        F.lit("mysql" if driver != "postgres" else "postgres").alias("driver"),
        F.lit("").alias("dsn"),
    )


def cascade_delete(fields: DataFrame, databases: DataFrame) -> DataFrame:
    """Fields whose database still exists."""
    live = databases.select("tenant_id", F.col("id").alias("db_id"))
    return fields.join(live, ["tenant_id", "db_id"], "left_semi")


# --- targets, indexes, widgets ----------------------------------------------------------------------------


def upsert_targets(targets: DataFrame, labels: DataFrame, changed: DataFrame, key: str = "tkey") -> tuple[DataFrame, DataFrame]:
    """Upsert targets; each changed target's label set is replaced as a whole.

    ``changed`` carries ``labels`` as an array; the label table has one row per (target, label).
    """
    rows = upsert(targets, changed.drop("labels"), [key])
    fresh = changed.select(key, F.explode("labels").alias("label")).distinct()
    return rows, labels.join(changed.select(key), key, "left_anti").unionByName(fresh)


def delete_targets(targets: DataFrame, labels: DataFrame, gone: DataFrame, key: str = "tkey") -> tuple[DataFrame, DataFrame]:
    return targets.join(gone.select(key), key, "left_anti"), labels.join(gone.select(key), key, "left_anti")


def set_default(targets: DataFrame, default_key: str, key: str = "tkey") -> DataFrame:
    """Exactly one default target."""
    return targets.withColumn("is_default", F.col(key).eqNullSafe(F.lit(default_key)))


def desired_indexes(fields: DataFrame, prefix: str = DEFAULT_PREFIX, keep: Sequence[str] = ()) -> DataFrame:
    """Unique and time-to-live index rows that the fields ask for."""
    extras = F.col("driver_extras") if "driver_extras" in fields.columns else F.lit(None).cast("string")
    unique = F.col("is_unique") | ty.extra_bool(extras, "unique")
    ttl = ty.extra_int32(extras, "ttlSeconds")
    name = lambda kind: F.concat(F.lit(prefix), "table_name", F.lit("_"), "column_name", F.lit(f"_{kind}"))
    no_ttl = F.lit(None).cast("int")
    entries = F.array_compact(
        F.array(
            F.when(unique, F.struct(name("unique").alias("index_name"), F.lit(True).alias("is_unique"), no_ttl.alias("expire_after"))),
            F.when(ttl > 0, F.struct(name("ttl").alias("index_name"), F.lit(False).alias("is_unique"), ttl.alias("expire_after"))),
        )
    )
    return fields.select(*keep, "table_name", "column_name", F.explode(entries).alias("_i")).select(
        *keep, "table_name", "column_name", "_i.*"
    )


def index_plan(desired: DataFrame, existing: DataFrame, prefix: str = DEFAULT_PREFIX, by: Sequence[str] = ()) -> DataFrame:
    """Index actions: own indexes (by name prefix) are dropped, every desired one is created; others stay."""
    own = F.col("index_name").startswith(F.concat(F.lit(prefix), F.col("table_name"), F.lit("_")))
    cols = [*by, "table_name", "index_name"]
    drops = existing.where(own).select(*cols).distinct().withColumn("action", F.lit("drop"))
    creates = desired.select(*cols).distinct().withColumn("action", F.lit("create"))
    return drops.unionByName(creates)


def apply_widget_changes(base: DataFrame, upserts: DataFrame, removes: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Apply a batch of widget upserts, then removes; with ``order`` the last upsert of an id wins."""
    rows = upserts
    if order is not None:
        rest = [c for c in base.columns if c != key]
        rows = upserts.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")
    return delete_keys(upsert(base, rows, [key]), removes, [key])
