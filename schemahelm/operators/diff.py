"""Registry diff, drift report, reconcile and set algebra.

A diff is a flat table: the key columns, ``change_type`` and every other column twice, as ``old_*`` and
``new_*``. Flat columns let Catalyst prune what a report does not read before the join shuffles it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemahelm.schemas import DIFF_ATTRIBUTES, DIFF_KEY, FIELD_KEY, STAMPS
from schemahelm.sources.catalog import is_reserved

MARKERS = {"added": "+", "deleted": "-", "updated": "±"}


def _same(name: str, left: Column, right: Column) -> Column:
    """Null-safe equality; a missing validator and an empty one are the same."""
    if name == "validator":
        return F.coalesce(left, F.lit("")) == F.coalesce(right, F.lit(""))
    return left.eqNullSafe(right)


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str] = DIFF_KEY, compare: Sequence[str] | str = "all") -> DataFrame:
    """Every key of either side with ``change_type`` added, deleted, updated or unchanged.

    ``compare`` names the attributes that make a row updated; ``"all"`` takes the whole definition, that is every
    shared column but the time stamps, and ``"reported"`` those that a drift report shows. Keys are expected to be unique per side (:func:`schemahelm.operators.quality.lint_registry` reports duplicates).
    """
    keys = list(keys)
    old_cols = [c for c in old.columns if c not in keys]
    new_cols = [c for c in new.columns if c not in keys]
    shared = [c for c in old_cols if c in new_cols]
    compare = {"all": [c for c in shared if c not in STAMPS], "reported": DIFF_ATTRIBUTES}.get(compare, compare) if isinstance(compare, str) else compare
    attrs = [c for c in compare if c in shared]
    left = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in old_cols], F.lit(True).alias("in_old"))
    right = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in new_cols], F.lit(True).alias("in_new"))
    same = reduce(lambda x, y: x & y, [_same(c, F.col(f"old_{c}"), F.col(f"new_{c}")) for c in attrs], F.lit(True))
    change = (
        F.when(F.col("in_old").isNull(), F.lit("added"))
        .when(F.col("in_new").isNull(), F.lit("deleted"))
        .when(same, F.lit("unchanged"))
        .otherwise(F.lit("updated"))
    )
    joined = left.join(right, keys, "full").withColumn("change_type", change)
    return joined.drop("in_old", "in_new")


def diff_report(changes: DataFrame) -> DataFrame:
    """One line per real change: marker, table, column and what differs."""
    old, new = (lambda c: F.col(f"old_{c}")), (lambda c: F.col(f"new_{c}"))
    shown_validator = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("none"))
    shown_default = lambda side: F.when(side("has_default"), F.coalesce(side("default_value"), F.lit(""))).otherwise(F.lit("none"))

    def part(label: str, differs: Column, before: Column, after: Column) -> Column:
        return F.when(differs, F.concat(F.lit(f"{label}: "), before.cast("string"), F.lit(" → "), after.cast("string")))

    differs = lambda c: ~_same(c, old(c), new(c))
    detail = F.concat_ws(
        ", ",
        part("type", differs("data_type"), old("data_type"), new("data_type")),
        part("validator", differs("validator"), shown_validator(old("validator")), shown_validator(new("validator"))),
        part("nullable", differs("is_nullable"), old("is_nullable"), new("is_nullable")),
        part("unique", differs("is_unique"), old("is_unique"), new("is_unique")),
        part("default", differs("default_value") | differs("has_default"), shown_default(old), shown_default(new)),
    )
    brackets = lambda c: F.concat(F.lit("("), c, F.lit(")"))
    kind = F.col("change_type")
    marker = F.when(kind == "added", F.lit("+")).when(kind == "deleted", F.lit("-")).otherwise(F.lit("±"))
    text = F.when(kind == "added", brackets(new("data_type"))).when(kind == "deleted", brackets(old("data_type"))).otherwise(detail)
    keys = [c for c in changes.columns if c != "change_type" and not c.startswith(("old_", "new_"))]
    rows = changes.where(kind != "unchanged").select(*keys, "change_type", marker.alias("marker"), text.alias("detail"))
    name = F.concat_ws(".", *[c for c in ("table_name", "column_name") if c in keys])
    return rows.withColumn("line", F.concat_ws(" ", "marker", name, "detail"))


def diff_summary(changes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per change type, overall or per group; folded map-side."""
    count = lambda kind: F.count_if(F.col("change_type") == kind).alias(kind)
    return changes.groupBy(*by).agg(*[count(k) for k in ("added", "deleted", "updated", "unchanged")])


def drift_gate(changes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``drift`` is true where anything differs."""
    return changes.groupBy(*by).agg(F.bool_or(F.col("change_type") != "unchanged").alias("drift"))


def ignore_tables(changes: DataFrame, patterns: Sequence[str] = (), reserved: Sequence[str] | None = None) -> DataFrame:
    """Drop changes of tables that match any pattern, and of reserved tables unless ``reserved`` is empty."""
    return changes.where(~(is_reserved("table_name", list(patterns)) | is_reserved("table_name", reserved)))


# --- reconcile --------------------------------------------------------------------------------------------

_RECONCILED = ("data_type", "is_nullable", "is_unique", "has_default", "default_value")


def _reason(m, t) -> Column:
    no_eq = lambda label, c: F.concat(F.lit(f"{label}: "), m(c).cast("string"), F.lit(" != "), t(c).cast("string"))
    return (
        F.when(~m("data_type").eqNullSafe(t("data_type")), no_eq("type", "data_type"))
        .when(~m("is_nullable").eqNullSafe(t("is_nullable")), no_eq("nullable", "is_nullable"))
        .when(~m("is_unique").eqNullSafe(t("is_unique")), no_eq("unique", "is_unique"))
        .when(~m("has_default").eqNullSafe(t("has_default")), F.lit("hasDefault mismatch"))
        .when(m("has_default") & (m("default_value") != t("default_value")), no_eq("default", "default_value"))
        .otherwise(F.lit("unknown diff"))
    )


def _folded(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Distinct definitions per key with the number of their ``copies``; equal ones become one row before anything is joined."""
    rows = df.groupBy(*keys, *_RECONCILED).agg(F.count(F.lit(1)).alias("copies"))
    return rows.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in (*_RECONCILED, "copies")], F.lit(True).alias(f"_{side}"))


def reconcile(meta: DataFrame, target: DataFrame, keys: Sequence[str] = DIFF_KEY) -> DataFrame:
    """Rows of ``status`` missing_in_target, missing_in_meta or mismatched, with the first difference.

    Where a key occurs several times in the target, a definition passes if any partner equals it; otherwise
    each differing partner is reported. Equal definitions of a key, such as a bare column name that very many tables
    share, are folded first, and ``pairs`` tells how many combinations of rows a reported line stands for. One full
    join of the folded sides gives all three kinds.
    """
    keys = list(keys)
    m, t = (lambda c: F.col(f"meta_{c}")), (lambda c: F.col(f"target_{c}"))
    joined = _folded(meta, keys, "meta").join(_folded(target, keys, "target"), keys, "full")
    default = lambda side: F.when(side("has_default"), side("default_value"))
    equal = reduce(lambda a, b: a & b, [m(c).eqNullSafe(t(c)) for c in _RECONCILED[:4]]) & default(m).eqNullSafe(default(t))
    both = F.col("_meta").isNotNull() & F.col("_target").isNotNull()
    # The window groups by the join key and more, so a shuffle join's partitioning serves it as it is. Its groups hold
    # the distinct definitions that one key has in the target.
    own = Window.partitionBy(*keys, *[f"meta_{c}" for c in _RECONCILED])
    rows = joined.withColumn("_passes", F.max(both & equal).over(own)).where(F.col("_meta").isNull() | ~F.col("_passes"))
    status = F.when(both, F.lit("mismatched")).when(F.col("_target").isNull(), F.lit("missing_in_target")).otherwise(F.lit("missing_in_meta"))
    return rows.select(
        *keys,
        status.alias("status"),
        F.when(both, _reason(m, t)).alias("reason"),
        (F.coalesce(m("copies"), F.lit(1)) * F.coalesce(t("copies"), F.lit(1))).alias("pairs"),
    )


def repair(meta: DataFrame, target: DataFrame, keys: Sequence[str] = DIFF_KEY) -> DataFrame:
    """Target definitions with the missing ones added from the metadata."""
    return target.unionByName(missing_fields(meta, target, keys), allowMissingColumns=True)


def missing_fields(meta: DataFrame, target: DataFrame, keys: Sequence[str] = DIFF_KEY) -> DataFrame:
    return meta.join(target.select(*keys), list(keys), "left_anti")


def reconcile_tables(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Row-level comparison of two data tables: keys, ``status`` and the names of differing columns.

    Equal rows are left out; the result grows with the differences, not with the tables.
    """
    keys = list(keys)
    columns = [c for c in (columns or left.columns) if c not in keys and c in right.columns]
    a = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in columns], F.lit(True).alias("_l"))
    b = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(True).alias("_r"))
    differing = F.array_compact(
        F.array(*[F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.lit(c)) for c in columns])
    )
    joined = a.join(b, keys, "full").withColumn("_d", differing)
    status = (
        F.when(F.col("_l").isNull(), F.lit("added"))
        .when(F.col("_r").isNull(), F.lit("deleted"))
        .when(F.size("_d") > 0, F.lit("updated"))
        .otherwise(F.lit("unchanged"))
    )
    rows = joined.withColumn("status", status).where("status <> 'unchanged'")
    return rows.select(*keys, "status", F.when(F.col("status") == "updated", F.array_join("_d", ",")).alias("differing"))


# --- snapshots, membership, sets --------------------------------------------------------------------------


def diff_snapshots(snapshots: DataFrame, tenant: str, a: str, b: str, keys: Sequence[str] = FIELD_KEY[1:]) -> DataFrame:
    """Diff of two versions of one tenant's registry; both reads prune to their own partitions."""
    side = lambda v: snapshots.where((F.col("tenant_id") == tenant) & (F.col("semver") == v)).drop("tenant_id", "semver", "snapshot_id")
    return diff(side(a), side(b), keys, compare="all")


def membership_delta(current: DataFrame, wanted: DataFrame, users: DataFrame, group: str = "role_id", member: str = "user_id", user_key: str = "id") -> DataFrame:
    """What replacing memberships means: ``add``, ``remove``, ``keep``, or ``unknown_user``."""
    key = [group, member]
    joined = (
        current.select(*key).distinct().withColumn("_cur", F.lit(True))
        .join(wanted.select(*key).distinct().withColumn("_new", F.lit(True)), key, "full")
    )
    known = users.select(F.col(user_key).alias(member)).distinct().withColumn("_known", F.lit(True))
    action = (
        F.when(F.col("_new").isNull(), F.lit("remove"))
        .when(F.col("_cur").isNotNull(), F.lit("keep"))
        .when(F.col("_known").isNull(), F.lit("unknown_user"))
        .otherwise(F.lit("add"))
    )
    return joined.join(known, member, "left").select(*key, action.alias("action"))


def label_intersect(*keys: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), keys)


def label_union(*keys: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.union(b), keys).distinct()


def label_except(every: DataFrame, excluded: DataFrame) -> DataFrame:
    return every.subtract(excluded)


def merge_fields(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("table_name", "column_name")) -> DataFrame:
    """Union of two field lists in which the new definition of a key wins.

    ``max_by`` folds map-side and keeps one row per key in memory, whatever the number of copies of a key.
    """
    keys = list(keys)
    rest = [c for c in old.columns if c not in keys]
    tagged = old.select(*keys, F.struct(*rest).alias("_row"), F.lit(0).alias("_rank")).unionByName(
        new.select(*keys, F.struct(*rest).alias("_row"), F.lit(1).alias("_rank"))
    )
    return tagged.groupBy(*keys).agg(F.max_by("_row", "_rank").alias("_row")).select(*keys, "_row.*")
