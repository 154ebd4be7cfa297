"""Diff, drift and reconcile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from schemahelm.functions import jsondiff
from schemahelm.operators import diff as d
from schemahelm.plans.registry import query

_REPORTED = """o.data_type = n.data_type AND coalesce(o.validator,'') = coalesce(n.validator,'') AND o.is_nullable = n.is_nullable
 AND o.is_unique = n.is_unique AND o.has_default = n.has_default AND o.default_value IS NOT DISTINCT FROM n.default_value"""
_SHOWN = ["kind", "driver_extras", "label_key", "widget", "widget_config"]
_SAME = _REPORTED + " AND o.db_id = n.db_id" + "".join(f" AND o.{c} IS NOT DISTINCT FROM n.{c}" for c in _SHOWN)


def _diff_sql(same: str) -> str:
    both = ["db_id", "data_type", "validator", "is_nullable", "is_unique", "has_default", "default_value", *_SHOWN]
    sides = ", ".join(f"o.{c} AS old_{c}, n.{c} AS new_{c}" for c in both)
    return f"""WITH chg AS (
 SELECT coalesce(o.tenant_id, n.tenant_id) AS tenant_id, coalesce(o.table_name, n.table_name) AS table_name,
  coalesce(o.column_name, n.column_name) AS column_name,
  CASE WHEN o.table_name IS NULL THEN 'added' WHEN n.table_name IS NULL THEN 'deleted' WHEN {same} THEN 'unchanged' ELSE 'updated' END AS change_type, {sides}
 FROM F_OLDX o FULL JOIN F_NEWX n ON o.tenant_id = n.tenant_id AND o.table_name = n.table_name AND o.column_name = n.column_name)
"""


_DIFF = _diff_sql(_SAME)
_COLS = ["tenant_id", "table_name", "column_name", "change_type"]


def changes(x, compare="all"):
    return d.diff(x.F_OLDX.drop("k"), x.F_NEWX.drop("k"), compare=compare)


@query("d1_registry_diff", _DIFF + f"SELECT tenant_id, table_name, column_name, change_type, old_data_type, new_data_type, old_validator, new_validator, {', '.join(f'old_{c}, new_{c}' for c in _SHOWN)} FROM chg")
def _(x):
    return changes(x).select(*_COLS, "old_data_type", "new_data_type", "old_validator", "new_validator", *(f"{s}_{c}" for c in _SHOWN for s in ("old", "new")))


@query(
    "d2_drift_report",
    _diff_sql(_REPORTED)
    + """SELECT tenant_id, table_name, column_name, change_type, CASE change_type WHEN 'added' THEN '+' WHEN 'deleted' THEN '-' ELSE '±' END AS marker,
 CASE change_type WHEN 'added' THEN '(' || new_data_type || ')' WHEN 'deleted' THEN '(' || old_data_type || ')' ELSE concat_ws(', ',
  CASE WHEN old_data_type <> new_data_type THEN 'type: ' || old_data_type || ' → ' || new_data_type END,
  CASE WHEN coalesce(old_validator,'') <> coalesce(new_validator,'') THEN 'validator: ' || coalesce(nullif(old_validator,''),'none') || ' → ' || coalesce(nullif(new_validator,''),'none') END,
  CASE WHEN old_is_nullable <> new_is_nullable THEN 'nullable: ' || old_is_nullable || ' → ' || new_is_nullable END,
  CASE WHEN old_is_unique <> new_is_unique THEN 'unique: ' || old_is_unique || ' → ' || new_is_unique END,
  CASE WHEN old_default_value IS DISTINCT FROM new_default_value OR old_has_default <> new_has_default THEN
   'default: ' || CASE WHEN old_has_default THEN coalesce(old_default_value,'') ELSE 'none' END || ' → ' || CASE WHEN new_has_default THEN coalesce(new_default_value,'') ELSE 'none' END END) END AS detail
 FROM chg WHERE change_type <> 'unchanged'""",
)
def _(x):
    return d.diff_report(changes(x, "reported")).drop("line")


_COUNTS = ", ".join(f"count(*) FILTER (change_type = '{k}') AS {k}" for k in ("added", "deleted", "updated", "unchanged"))


@query("d3_diff_summary", _DIFF + f"SELECT tenant_id, {_COUNTS} FROM chg GROUP BY tenant_id")
def diff_summary(x):
    return d.diff_summary(changes(x), ["tenant_id"])


@query("d4_drift_gate", _DIFF + "SELECT table_name, bool_or(change_type <> 'unchanged') AS drift FROM chg GROUP BY table_name")
def _(x):
    return d.drift_gate(changes(x), ["table_name"])


@query(
    "d5_ignore_tables",
    _DIFF + "SELECT tenant_id, table_name, column_name, change_type FROM chg WHERE NOT regexp_matches(table_name, '^tbl_1') AND NOT regexp_matches(table_name, '7$')",
)
def _(x):
    return d.ignore_tables(changes(x), ["^tbl_1", "7$"]).select(*_COLS)


_REASON = """CASE WHEN m.data_type <> t.data_type THEN 'type: ' || m.data_type || ' != ' || t.data_type
 WHEN m.is_nullable <> t.is_nullable THEN 'nullable: ' || m.is_nullable || ' != ' || t.is_nullable
 WHEN m.is_unique <> t.is_unique THEN 'unique: ' || m.is_unique || ' != ' || t.is_unique
 WHEN m.has_default <> t.has_default THEN 'hasDefault mismatch'
 WHEN m.has_default AND m.default_value <> t.default_value THEN 'default: ' || m.default_value || ' != ' || t.default_value ELSE 'unknown diff' END"""
_EQUAL = """m.data_type = t.data_type AND m.is_nullable = t.is_nullable AND m.is_unique = t.is_unique AND m.has_default = t.has_default
 AND (NOT m.has_default OR m.default_value IS NOT DISTINCT FROM t.default_value)"""


def _reconcile_sql(keys: list[str], meta: str = "F_OLD", target: str = "F_NEW") -> str:
    on = " AND ".join(f"m.{k} = t.{k}" for k in keys)
    cols = lambda a: ", ".join(f"{a}.{k}" for k in keys)
    return f"""SELECT {cols('m')}, 'missing_in_target' AS status, CAST(NULL AS VARCHAR) AS reason, CAST(1 AS BIGINT) AS pairs FROM {meta} m WHERE NOT EXISTS (SELECT 1 FROM {target} t WHERE {on})
UNION ALL SELECT {cols('m')}, 'mismatched', {_REASON}, 1 FROM {meta} m JOIN {target} t ON {on}
 WHERE NOT EXISTS (SELECT 1 FROM {target} t WHERE {on} AND {_EQUAL})
UNION ALL SELECT {cols('t')}, 'missing_in_meta', NULL, 1 FROM {target} t WHERE NOT EXISTS (SELECT 1 FROM {meta} m WHERE {on})"""


@query("d7_reconcile", _reconcile_sql(["tenant_id", "table_name", "column_name"]))
def reconcile(x):
    return d.reconcile(x.F_OLD, x.F_NEW)


@query("d7_reconcile_by_column", _reconcile_sql(["column_name"]))
def _(x):
    return d.reconcile(x.F_OLD, x.F_NEW, ["column_name"])


_ATTRS = "data_type, is_nullable, is_unique, has_default, default_value"


@query(
    "d7_reconcile_shared_names",
    # Few names shared by very many tables: equal definitions first, then combinations with their multiplicity.
    f"""WITH om AS (SELECT 'c' || length(column_name) AS column_name, {_ATTRS} FROM F_OLD), nt AS (SELECT 'c' || length(column_name) AS column_name, {_ATTRS} FROM F_NEW WHERE data_type <> 'text'),
 m AS (SELECT *, count(*) AS copies FROM om GROUP BY column_name, {_ATTRS}), t AS (SELECT *, count(*) AS copies FROM nt GROUP BY column_name, {_ATTRS})
 SELECT m.column_name, 'mismatched' AS status, {_REASON} AS reason, CAST(m.copies * t.copies AS BIGINT) AS pairs FROM m JOIN t ON m.column_name = t.column_name
  WHERE NOT EXISTS (SELECT 1 FROM t WHERE m.column_name = t.column_name AND {_EQUAL})
 UNION ALL SELECT column_name, 'missing_in_target', NULL, copies FROM m WHERE column_name NOT IN (SELECT column_name FROM t)
 UNION ALL SELECT column_name, 'missing_in_meta', NULL, copies FROM t WHERE column_name NOT IN (SELECT column_name FROM m)""",
)
def _(x):
    shared = F.concat(F.lit("c"), F.length("column_name").cast("string"))
    return d.reconcile(x.F_OLD.withColumn("column_name", shared), x.F_NEW.where("data_type <> 'text'").withColumn("column_name", shared), ["column_name"])


@query(
    "d8_repair",
    """SELECT tenant_id, table_name, column_name, data_type FROM F_NEW UNION ALL SELECT o.tenant_id, o.table_name, o.column_name, o.data_type FROM F_OLD o
 WHERE NOT EXISTS (SELECT 1 FROM F_NEW n WHERE n.tenant_id = o.tenant_id AND n.table_name = o.table_name AND n.column_name = o.column_name)""",
)
def _(x):
    return d.repair(x.F_OLD, x.F_NEW).select("tenant_id", "table_name", "column_name", "data_type")


_ORDERS2 = """SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, o_orderstatus,
 CASE WHEN o_orderkey % 23 = 0 THEN '5-LOW' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 29 <> 0
 UNION ALL SELECT -o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 31 = 0"""


@query(
    "d9_reconcile_tables",
    f"""WITH r AS ({_ORDERS2}), j AS (SELECT coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey, l.o_orderkey AS lk, r.o_orderkey AS rk,
  concat_ws(',', CASE WHEN l.o_custkey IS DISTINCT FROM r.o_custkey THEN 'o_custkey' END, CASE WHEN l.o_orderstatus IS DISTINCT FROM r.o_orderstatus THEN 'o_orderstatus' END,
  CASE WHEN l.o_orderpriority IS DISTINCT FROM r.o_orderpriority THEN 'o_orderpriority' END) AS diffs FROM orders l FULL JOIN r ON l.o_orderkey = r.o_orderkey)
 SELECT o_orderkey, CASE WHEN lk IS NULL THEN 'added' WHEN rk IS NULL THEN 'deleted' ELSE 'updated' END AS status,
  CASE WHEN lk IS NOT NULL AND rk IS NOT NULL THEN diffs END AS differing FROM j WHERE lk IS NULL OR rk IS NULL OR diffs <> ''""",
)
def reconcile_tables(x):
    left = x.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    left.createOrReplaceTempView("orders")
    return d.reconcile_tables(left, x.spark.sql(_ORDERS2), ["o_orderkey"])


@query(
    "d10_json_diff_counts",
    # The documents have the members a and k before, and k after: one line each, a comma after all but the last.
    """WITH p AS (SELECT id, before_json, after_json, json_extract_string(before_json, '$.k') AS bk, json_extract_string(after_json, '$.k') AS ak FROM F_AUD)
 SELECT id, CAST(CASE WHEN after_json IS NULL THEN 0 WHEN before_json IS NULL THEN 1 WHEN bk = ak THEN 0 ELSE 1 END AS BIGINT) AS added,
  CAST(CASE WHEN before_json IS NULL THEN 0 WHEN after_json IS NULL THEN 2 WHEN bk = ak THEN 1 ELSE 2 END AS BIGINT) AS removed FROM p""",
)
def _(x):
    return jsondiff.with_diff_counts(x.F_AUD, "before_json", "after_json").select("id", "_counts.*")


@query(
    "d10_json_diff_counts_nested",
    # The same members one level down; an empty member object is a one-line "doc": {} that opens when filled.
    """WITH p AS (SELECT id, before_json, after_json, json_extract_string(before_json, '$.k') AS bk, json_extract_string(after_json, '$.k') AS ak FROM F_AUD)
 SELECT id, CAST(CASE WHEN after_json IS NULL THEN 1 WHEN before_json IS NULL THEN 2 WHEN bk = ak THEN 0 ELSE 1 END AS BIGINT) AS added,
  CAST(CASE WHEN before_json IS NULL THEN 1 WHEN after_json IS NULL THEN 3 WHEN bk = ak THEN 1 ELSE 2 END AS BIGINT) AS removed FROM p""",
)
def _(x):
    wrapped = lambda c: F.concat(F.lit('{"doc":'), F.coalesce(c, F.lit("{}")), F.lit("}"))
    docs = x.F_AUD.select("id", wrapped("before_json").alias("b"), wrapped("after_json").alias("a"))
    return jsondiff.with_diff_counts(docs, "b", "a").select("id", "_counts.*")


def _lines(*parts: str) -> str:
    return " || chr(10) || ".join(parts) + " || chr(10)"


_HEAD = ["'--- before'", "'+++ after'"]


@query(
    "d11_json_unified_diff",
    # Four shapes: only after, only before, same k, other k.
    f"""WITH p AS (SELECT id, before_json, after_json, json_extract_string(before_json, '$.k') AS bk, json_extract_string(after_json, '$.k') AS ak FROM F_AUD)
 SELECT id, CASE WHEN before_json IS NULL THEN {_lines(*_HEAD, "'@@ -1 +1,3 @@'", "'-'", "'+{'", """'+  "k": ' || ak""", "'+}'")}
  WHEN after_json IS NULL THEN {_lines(*_HEAD, "'@@ -1,4 +1 @@'", "'-{'", """'-  "a": 1,'""", """'-  "k": ' || bk""", "'-}'", "'+'")}
  WHEN ak = bk THEN {_lines(*_HEAD, "'@@ -1,4 +1,3 @@'", "' {'", """'-  "a": 1,'""", """'   "k": ' || bk""", "' }'")}
  ELSE {_lines(*_HEAD, "'@@ -1,4 +1,3 @@'", "' {'", """'-  "a": 1,'""", """'-  "k": ' || bk""", """'+  "k": ' || ak""", "' }'")} END AS unified FROM p""",
)
def _(x):
    return x.F_AUD.select("id", jsondiff.unified_diff("before_json", "after_json").alias("unified"))


@query(
    "d12_diff_snapshots",
    """WITH a AS (SELECT * FROM F_SNAP WHERE tenant_id = 't1' AND semver = '0.0.1'), b AS (SELECT * FROM F_SNAP WHERE tenant_id = 't1' AND semver = '0.0.3')
 SELECT coalesce(a.db_id, b.db_id) AS db_id, coalesce(a.table_name, b.table_name) AS table_name, coalesce(a.column_name, b.column_name) AS column_name,
  CASE WHEN a.table_name IS NULL THEN 'added' WHEN b.table_name IS NULL THEN 'deleted' WHEN a.data_type = b.data_type AND a.widget = b.widget THEN 'unchanged' ELSE 'updated' END AS change_type,
  a.data_type AS old_data_type, b.data_type AS new_data_type, a.widget AS old_widget, b.widget AS new_widget
 FROM a FULL JOIN b ON a.db_id = b.db_id AND a.table_name = b.table_name AND a.column_name = b.column_name""",
)
def _(x):
    return d.diff_snapshots(x.F_SNAP, "t1", "0.0.1", "0.0.3").select(
        "db_id", "table_name", "column_name", "change_type", "old_data_type", "new_data_type", "old_widget", "new_widget"
    )


_WANTED = """SELECT CASE WHEN user_id % 4 = 0 THEN user_id + 1000000 WHEN user_id % 4 = 1 THEN user_id + 1 ELSE user_id END AS user_id, role_id FROM F_UROLES"""


@query(
    "d13_membership_delta",
    f"""WITH w AS (SELECT DISTINCT * FROM ({_WANTED})), j AS (SELECT coalesce(c.role_id, w.role_id) AS role_id, coalesce(c.user_id, w.user_id) AS user_id,
  c.user_id AS cu, w.user_id AS wu FROM F_UROLES c FULL JOIN w ON c.role_id = w.role_id AND c.user_id = w.user_id)
 SELECT role_id, user_id, CASE WHEN wu IS NULL THEN 'remove' WHEN cu IS NOT NULL THEN 'keep' WHEN NOT EXISTS (SELECT 1 FROM F_USERS u WHERE u.id = j.user_id)
  THEN 'unknown_user' ELSE 'add' END AS action FROM j""",
)
def _(x):
    x.F_UROLES.createOrReplaceTempView("F_UROLES")
    return d.membership_delta(x.F_UROLES, x.spark.sql(_WANTED), x.F_USERS)


_HAS = lambda label: f"SELECT tkey FROM F_TGT WHERE list_contains(list_transform(string_split(lower(labels), ','), lambda l: l), '{label}')"


@query(
    "d14_label_algebra",
    f"""SELECT 'intersect' AS op, tkey FROM ({_HAS('tier=gold')} INTERSECT {_HAS('deprecated')})
 UNION ALL SELECT 'union', tkey FROM ({_HAS('tier=gold')} UNION {_HAS('deprecated')})
 UNION ALL SELECT 'except', tkey FROM (SELECT tkey FROM F_TGT EXCEPT {_HAS('deprecated')})""",
)
def _(x):
    from schemahelm.operators.routing import select_targets
    from schemahelm.sources.targets import split_labels

    t = split_labels(x.F_TGT)
    gold, old = (select_targets(t, q).select("tkey") for q in ("tier=gold", "deprecated"))
    parts = {
        "intersect": d.label_intersect(gold, old),
        "union": d.label_union(gold, old),
        "except": d.label_except(t.select("tkey"), old),
    }
    out = [df.select(F.lit(op).alias("op"), "tkey") for op, df in parts.items()]
    return out[0].union(out[1]).union(out[2])


@query(
    "d15_merge_fields",
    """SELECT tenant_id, table_name, column_name, data_type, validator FROM F_NEW UNION ALL
 SELECT o.tenant_id, o.table_name, o.column_name, o.data_type, o.validator FROM F_OLD o WHERE NOT EXISTS (SELECT 1 FROM F_NEW n WHERE n.tenant_id = o.tenant_id
  AND n.table_name = o.table_name AND n.column_name = o.column_name)""",
)
def _(x):
    cols = ["tenant_id", "table_name", "column_name", "data_type", "validator"]
    return d.merge_fields(x.F_OLD.select(*cols), x.F_NEW.select(*cols), ["tenant_id", "table_name", "column_name"])

