"""Snapshot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from schemahelm.operators import snapshot as s
from schemahelm.plans.registry import query


@query(
    "w6_latest_snapshot",
    """SELECT t.tenant_id, coalesce(max_by(s.semver, s.snapshot_id), '0.0.0') AS semver, coalesce(max(s.snapshot_id), 0) AS snapshot_id
 FROM (SELECT DISTINCT tenant_id FROM F_OLD UNION SELECT 'nobody') t LEFT JOIN F_SNAP s ON s.tenant_id = t.tenant_id GROUP BY t.tenant_id""",
)
def _(x):
    tenants = x.F_OLD.select("tenant_id").union(x.spark.range(1).select(F.lit("nobody")))
    return s.latest_snapshot(x.F_SNAP, tenants)


@query(
    "w6_list_snapshots",
    """SELECT tenant_id, semver, snapshot_id, count(*) AS fields FROM F_SNAP WHERE snapshot_id > 1 GROUP BY tenant_id, semver, snapshot_id""",
)
def _(x):
    return s.list_snapshots(x.F_SNAP, 2)


_HISTORY = "h AS (SELECT * FROM F_SNAP WHERE tenant_id <> 't6' AND NOT (tenant_id = 't2' AND snapshot_id = 3))"
_NEXT = """n AS (SELECT t.tenant_id, '0.0.' || (coalesce(max(h.snapshot_id), 0) + 1) AS semver, coalesce(max(h.snapshot_id), 0) AS last
 FROM (SELECT DISTINCT tenant_id FROM F_OLD WHERE tenant_id <> 't7') t LEFT JOIN h ON h.tenant_id = t.tenant_id GROUP BY t.tenant_id)"""


def _created(x):
    history = x.F_SNAP.where("tenant_id <> 't6' and not (tenant_id = 't2' and snapshot_id = 3)")
    return s.create_snapshots(x.F_OLD2.where("tenant_id <> 't7'"), history)


@query(
    "n1_create_snapshots",
    f"""WITH {_HISTORY}, {_NEXT} SELECT n.tenant_id, n.semver, n.last + 1 AS snapshot_id, f.* EXCLUDE (tenant_id) FROM n JOIN F_OLD2 f ON f.tenant_id = n.tenant_id""",
)
def _(x):
    return _created(x).rows


@query(
    "n1_snapshot_summary",
    f"""WITH {_HISTORY}, {_NEXT}, p AS (SELECT h.* FROM h JOIN n ON n.tenant_id = h.tenant_id AND n.last = h.snapshot_id),
 d AS (SELECT coalesce(p.tenant_id, f.tenant_id) AS tenant_id, count(*) FILTER (p.table_name IS NULL) AS added, count(*) FILTER (f.table_name IS NULL) AS deleted
  FROM p FULL JOIN (SELECT * FROM F_OLD2 WHERE tenant_id <> 't7') f ON f.tenant_id = p.tenant_id AND f.db_id = p.db_id AND f.table_name = p.table_name AND f.column_name = p.column_name GROUP BY 1)
 SELECT n.tenant_id, n.semver, CASE WHEN n.last = 0 THEN '' ELSE '+' || added || ' -' || deleted END AS summary FROM n LEFT JOIN d ON d.tenant_id = n.tenant_id""",
)
def _(x):
    return _created(x).summary


@query("n2_get_snapshot", "SELECT * FROM F_SNAP WHERE tenant_id = 't4' AND semver = '0.0.2'")
def _(x):
    return s.get_snapshot(x.F_SNAP, "t4", "0.0.2")


_MORE = "is_nullable, is_unique, has_default, default_value, validator, kind, driver_extras, label_key, widget, widget_config"


def _rolled(x):
    # Two databases of a tenant share tables and columns; the snapshots know nothing of ``note``.
    return s.rollback(x.F_NEW2.drop("k").withColumn("note", F.concat(F.lit("n"), "column_name")), x.F_SNAP.drop("k"), "t1", "0.0.2", "bob")


_SNAP2 = "s AS (SELECT * FROM F_SNAP WHERE tenant_id = 't1' AND semver = '0.0.2'), c AS (SELECT * FROM F_NEW2 WHERE tenant_id = 't1')"
_ON2 = "c.db_id = s.db_id AND c.table_name = s.table_name AND c.column_name = s.column_name"


@query(
    "n3_rollback_registry",
    f"""WITH {_SNAP2} SELECT s.tenant_id, s.db_id, s.table_name, s.column_name, s.data_type, {", ".join(f"s.{c}" for c in _MORE.split(", "))},
 CASE WHEN c.table_name IS NOT NULL THEN 'n' || c.column_name END AS note FROM s LEFT JOIN c ON {_ON2}""",
)
def _(x):
    return _rolled(x).applied.registry


@query(
    "n3_rollback_action",
    f"""WITH {_SNAP2} SELECT 't1' AS tenant_id, 'bob' AS actor, 'rollback' AS action, 'registry' AS table_name, '0.0.2' AS column_name,
 '+' || count(*) FILTER (c.table_name IS NULL) || ' -' || count(*) FILTER (s.table_name IS NULL) AS before_json FROM s FULL JOIN c ON {_ON2}""",
)
def _(x):
    return _rolled(x).action.select("tenant_id", "actor", "action", "table_name", "column_name", "before_json")


_DIFFERS = " OR ".join(
    f"coalesce(c.{c}, '') <> coalesce(s.{c}, '')" if c == "validator" else f"c.{c} IS DISTINCT FROM s.{c}" for c in ["data_type", *_MORE.split(", ")]
)


@query(
    "n3_rollback_audit",
    f"""WITH {_SNAP2} SELECT coalesce(s.table_name, c.table_name) AS table_name, coalesce(s.column_name, c.column_name) AS column_name,
 CASE WHEN c.table_name IS NULL THEN 'add' WHEN s.table_name IS NULL THEN 'delete' ELSE 'update' END AS action FROM s FULL JOIN c ON {_ON2}
 WHERE s.table_name IS NULL OR c.table_name IS NULL OR {_DIFFERS}""",
)
def _(x):
    return _rolled(x).applied.audit.select("table_name", "column_name", "action")
