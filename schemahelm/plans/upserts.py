"""Upsert, apply, scan and evolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from schemahelm.operators import evolve, merge
from schemahelm.plans.changes import _DIFF, _SAME
from schemahelm.plans.registry import query, ts_text
from schemahelm.session import scratch_path
from schemahelm.sources import catalog as cat

_KEY = ["tenant_id", "db_id", "table_name", "column_name"]
_K = ", ".join(_KEY)
_ON = " AND ".join(f"o.{k} = n.{k}" for k in _KEY)
_BORN = "TIMESTAMP '2024-01-01 00:00:00'"
_NOW = "TIMESTAMP '2024-06-01 12:00:00'"


def _base(x):
    born = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return x.F_OLD.withColumn("created_at", born).withColumn("updated_at", born)


def _now():
    return F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")


_TS = lambda e: f"strftime({e}, '%Y-%m-%d %H:%M:%S.%f')"


@query(
    "m1_upsert",
    f"""SELECT {_K}, data_type, validator, {_TS(_BORN)} AS created_at, {_TS(_BORN)} AS updated_at FROM F_OLD o WHERE NOT EXISTS (SELECT 1 FROM F_NEW n WHERE {_ON})
 UNION ALL SELECT {_K}, data_type, validator, {_TS(f"CASE WHEN EXISTS (SELECT 1 FROM F_OLD o WHERE {_ON}) THEN {_BORN} ELSE {_NOW} END")}, {_TS(_NOW)} FROM F_NEW n""",
)
def _(x):
    df = merge.upsert(_base(x), x.F_NEW, now=_now())
    return df.select(*_KEY, "data_type", "validator", ts_text("created_at").alias("created_at"), ts_text("updated_at").alias("updated_at"))


@query(
    "m1_upsert_without_now",
    f"""SELECT {_K}, data_type, {_TS(_BORN)} AS created_at, {_TS(_BORN)} AS updated_at FROM F_OLD o WHERE NOT EXISTS (SELECT 1 FROM F_NEW n WHERE {_ON})
 UNION ALL SELECT {_K}, data_type, CASE WHEN EXISTS (SELECT 1 FROM F_OLD o WHERE {_ON}) THEN {_TS(_BORN)} END, NULL FROM F_NEW n""",
)
def _(x):
    df = merge.upsert(_base(x), x.F_NEW)
    return df.select(*_KEY, "data_type", ts_text("created_at").alias("created_at"), ts_text("updated_at").alias("updated_at"))


_SOME = "n.tenant_id IN ('t1', 't2', 't9')"


@query(
    "m1_commit",
    f"""WITH n AS (SELECT * FROM F_NEW n WHERE {_SOME} UNION ALL SELECT * REPLACE ('t9' AS tenant_id) FROM F_NEW WHERE tenant_id = 't3')
 SELECT {_K}, data_type, validator, {_TS(_BORN)} AS created_at, {_TS(_BORN)} AS updated_at FROM F_OLD o WHERE NOT EXISTS (SELECT 1 FROM n WHERE {_ON})
 UNION ALL SELECT {_K}, data_type, validator, {_TS(f"CASE WHEN EXISTS (SELECT 1 FROM F_OLD o WHERE {_ON}) THEN {_BORN} ELSE {_NOW} END")}, {_TS(_NOW)} FROM n""",
)
def _(x):
    # Two tenants of the stored registry change, and one is new.
    path = scratch_path(x.spark, "registry")
    _base(x).write.partitionBy("tenant_id").parquet(path)
    new = x.F_NEW.where("tenant_id IN ('t1', 't2')").unionByName(x.F_NEW.where("tenant_id = 't3'").withColumn("tenant_id", F.lit("t9")))
    merge.commit_upsert(x.spark, path, new, now=_now())
    df = x.spark.read.parquet(path)
    return df.select(*_KEY, "data_type", "validator", ts_text("created_at").alias("created_at"), ts_text("updated_at").alias("updated_at"))


@query(
    "m2_upsert_counts",
    f"""SELECT tenant_id, count(*) FILTER (NOT hit) AS inserted, count(*) FILTER (hit) AS updated FROM (SELECT n.tenant_id, EXISTS (SELECT 1 FROM F_OLD o WHERE {_ON}) AS hit FROM F_NEW n) GROUP BY tenant_id""",
)
def _(x):
    return merge.upsert_counts(x.F_OLD, x.F_NEW, by=["tenant_id"])


@query("m3_delete_keys", f"SELECT {_K} FROM F_OLD o WHERE NOT EXISTS (SELECT 1 FROM F_NEW n WHERE {_ON} AND n.is_nullable)")
def _(x):
    return merge.delete_keys(x.F_OLD, x.F_NEW.where("is_nullable")).select(*_KEY)


_WHOLE = "data_type, is_nullable, is_unique, has_default, default_value, kind, driver_extras, label_key, widget, widget_config"


@query(
    "m4_apply_registry",
    f"""SELECT {_K}, {_WHOLE}, coalesce(validator, '') AS validator, 'kept' AS note FROM F_NEW2 n WHERE EXISTS (SELECT 1 FROM F_OLD2 o WHERE {_ON})
 UNION ALL SELECT {_K}, {_WHOLE}, coalesce(validator, ''), NULL FROM F_NEW2 n WHERE NOT EXISTS (SELECT 1 FROM F_OLD2 o WHERE {_ON})""",
)
def _(x):
    # The current registry has a column that the document lacks.
    done = merge.apply(x.F_OLD2.drop("k").withColumn("note", F.lit("kept")), x.F_NEW2.drop("k"), "bob", _now())
    return done.registry.withColumn("validator", F.coalesce("validator", F.lit("")))


_CHG4 = f"""FROM F_OLD2 o FULL JOIN F_NEW2 n ON {_ON}"""


@query(
    "m4_apply_summary",
    f"""SELECT coalesce(o.db_id, n.db_id) AS db_id, count(*) FILTER (o.table_name IS NULL) AS added, count(*) FILTER (n.table_name IS NULL) AS deleted,
 count(*) FILTER (o.table_name IS NOT NULL AND n.table_name IS NOT NULL AND NOT ({_SAME})) AS updated,
 count(*) FILTER (o.table_name IS NOT NULL AND n.table_name IS NOT NULL AND ({_SAME})) AS unchanged {_CHG4} GROUP BY 1""",
)
def _(x):
    return merge.apply(x.F_OLD2.drop("k"), x.F_NEW2.drop("k"), by=["db_id"]).summary


@query(
    "m4_apply_dry_run",
    _DIFF + "SELECT " + ", ".join(f"count(*) FILTER (change_type = '{k}') AS {k}" for k in ("added", "deleted", "updated", "unchanged")) + " FROM chg",
)
def _(x):
    return merge.apply(x.F_OLDX.drop("k"), x.F_NEWX.drop("k"), dry_run=True, required_version="0.3", current_version="0.4")


@query(
    "m5_merge_validators",
    # Two databases with the same tables and columns keep their own validators.
    f"""WITH o AS (SELECT {_K}, CASE WHEN db_id > 50 THEN 'second' ELSE validator END AS validator FROM F_OLD2)
 SELECT {", ".join(f"n.{k}" for k in _KEY)}, coalesce(nullif(n.validator, ''), nullif(o.validator, ''), '') AS validator FROM F_NEW2 n LEFT JOIN o ON {_ON}""",
)
def _(x):
    existing = x.F_OLD2.withColumn("validator", F.when(F.col("db_id") > 50, F.lit("second")).otherwise(F.col("validator")))
    return merge.merge_validators(x.F_NEW2, existing).select(*_KEY, "validator")


# The catalog of a fleet: each table belongs to one of the databases; every fifth database has a broken address.
_FLEET = """SELECT 't' || CAST(length(table_name) % 3 AS STRING) AS tenant_id, CAST(1 + length(table_name) % 7 + ascii(substr(table_name, length(table_name), 1)) % 5 AS BIGINT) AS db_id, c.*
 FROM F_CAT c"""
_EXISTING = f"""SELECT tenant_id, db_id, table_name, column_name, CASE ordinal_position % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'exotic' ELSE '' END AS validator FROM ({_FLEET}) f WHERE ordinal_position <= 3"""
_DBS = """SELECT DISTINCT tenant_id, db_id, 'postgres' AS driver, CASE WHEN db_id % 5 = 0 THEN 'postgres://host' ELSE 'postgres://host/db' || CAST(db_id AS STRING) END AS dsn FROM ({fleet}) f"""
_SCAN = f"""WITH f AS ({_FLEET}), e AS ({_EXISTING}), s AS (SELECT f.tenant_id, f.db_id, f.table_name, f.column_name, coalesce(nullif(e.validator, ''), '') AS validator, e.table_name IS NOT NULL AS old
  FROM f LEFT JOIN e ON e.tenant_id = f.tenant_id AND e.db_id = f.db_id AND e.table_name = f.table_name AND e.column_name = f.column_name),
 r AS (SELECT *, CASE WHEN starts_with(table_name, 'meta_users') THEN 'reserved' WHEN validator NOT IN ('', 'email') THEN 'validator' END AS reason FROM s)
"""


def _fleet(x):
    x.F_CAT.createOrReplaceTempView("F_CAT")
    return x.spark.sql(_FLEET), x.spark.sql(_EXISTING)


def _scan(x):
    fleet, existing = _fleet(x)
    scanned = cat.scan_catalog(fleet, by=("tenant_id", "db_id")).withColumn("validator", F.lit(""))
    return scanned, existing


@query("m6_scan_fields", _SCAN + f"SELECT {_K}, validator FROM r WHERE reason IS NULL")
def _(x):
    return merge.scan_databases(*_scan(x), ["email"]).fields.select(*_KEY, "validator")


@query("m6_scan_skipped", _SCAN + f"SELECT {_K}, reason FROM r WHERE reason IS NOT NULL")
def _(x):
    return merge.scan_databases(*_scan(x), ["email"]).skipped


_SUMMARY = """count(DISTINCT table_name) AS tables, count(*) FILTER (reason IS NULL AND NOT old) AS inserted, count(*) FILTER (reason IS NULL AND old) AS updated, count(*) FILTER (reason IS NOT NULL) AS skipped"""


@query("m6_scan_summary", _SCAN + f"SELECT tenant_id, db_id, {_SUMMARY} FROM r GROUP BY tenant_id, db_id")
def _(x):
    return merge.scan_databases(*_scan(x), ["email"]).summary


def _fleet_scan(x):
    fleet, _ = _fleet(x)
    dbs = x.spark.sql(_DBS.format(fleet=_FLEET))
    return merge.scan_all(dbs, *_scan(x), ["email"])


@query("m7_scan_all_summary", _SCAN + f"SELECT tenant_id, db_id, {_SUMMARY} FROM r WHERE db_id % 5 <> 0 GROUP BY tenant_id, db_id")
def _(x):
    return _fleet_scan(x).summary


@query("m7_scan_all_errors", f"SELECT DISTINCT tenant_id, db_id, 'monitored database DSN must include database name' AS error FROM ({_FLEET}) f WHERE db_id % 5 = 0")
def _(x):
    return _fleet_scan(x).errors


@query(
    "m8_record_scan",
    """SELECT DISTINCT 'db:' || CAST(length(table_name) % 5 AS STRING) AS tenant_id, table_name AS scan_id, 'ok' AS status, '2024-03-01 02:00:00.000000' AS started_at,
 '2024-03-01 02:00:00.000000' AS finished_at, '2024-03-01' AS run_date FROM F_CAT""",
)
def _(x):
    tables = x.F_CAT.withColumn("tkey", F.concat(F.lit("db:"), (F.length("table_name") % 5).cast("string")))
    df = merge.record_scan(tables, "2024-03-01 02:00:00")
    return df.select(
        "tenant_id", "scan_id", "status", ts_text("started_at").alias("started_at"), ts_text("finished_at").alias("finished_at"),
        F.col("run_date").cast("string").alias("run_date"),
    )


_LIVE = """SELECT DISTINCT tenant_id, db_id AS id FROM F_OLD WHERE db_id % 2 = 1"""


@query(
    "m9_ensure_databases",
    f"""SELECT DISTINCT tenant_id, db_id AS id, 'db_' || db_id AS name, 'postgres' AS driver, '' AS dsn FROM F_OLD o WHERE NOT EXISTS (SELECT 1 FROM ({_LIVE}) l WHERE l.tenant_id = o.tenant_id AND l.id = o.db_id)""",
)
def _(x):
    x.F_OLD.createOrReplaceTempView("F_OLD")
    return merge.ensure_databases(x.spark.sql(_LIVE), x.F_OLD)


_PLAN = [
    evolve.Step("add", "region", "string", "emea"),
    evolve.Step("add", "o_custkey", "string"),
    evolve.Step("retype", "code", "int"),
    evolve.Step("not_null", "note", default="none"),
    evolve.Step("not_null", "flag"),
    evolve.Step("drop", "o_orderstatus"),
    evolve.Step("drop", "absent"),
]
_ORDERS = """SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 19 = 0 THEN 'x' ELSE CAST(o_orderkey % 50 AS STRING) END AS code,
 CASE WHEN o_orderkey % 3 = 0 THEN 'n' END AS note, CASE WHEN o_orderkey % 13 <> 0 THEN 'f' END AS flag FROM orders"""


def _evolved(x):
    x.orders.createOrReplaceTempView("orders")
    return evolve.evolve_table(x.spark.sql(_ORDERS), _PLAN)


@query(
    "m10_evolve_table",
    f"SELECT o_orderkey, o_custkey, CAST(code AS BIGINT) AS code, coalesce(note, 'none') AS note, flag, 'emea' AS region FROM ({_ORDERS}) o WHERE code <> 'x' AND flag IS NOT NULL",
)
def _(x):
    return _evolved(x).table.withColumn("code", F.col("code").cast("bigint"))


@query(
    "m10_evolve_rejects",
    f"""SELECT o_orderkey, concat_ws('; ', CASE WHEN code = 'x' THEN 'code: not int' END, CASE WHEN flag IS NULL THEN 'flag: null' END) AS reject_reason FROM ({_ORDERS}) o WHERE code = 'x' OR flag IS NULL""",
)
def _(x):
    return _evolved(x).rejects.select("o_orderkey", "reject_reason")


@query("m11_cascade_delete", f"SELECT {_K} FROM F_OLD WHERE db_id % 2 = 1")
def _(x):
    x.F_OLD.createOrReplaceTempView("F_OLD")
    return merge.cascade_delete(x.F_OLD, x.spark.sql(_LIVE)).select(*_KEY)


_OLD_LABELS = """SELECT tkey, unnest(string_split(labels, ',')) AS label FROM F_TGT"""
_CHANGED = """SELECT tkey, 'mysql' AS driver, false AS is_default FROM F_TGT WHERE right(tkey, 1) = '4' UNION ALL SELECT 'db:new', 'mongo', false"""


def _targets(x):
    rows = x.F_TGT.select("tkey", "driver", "is_default")
    labels = x.F_TGT.select("tkey", F.explode(F.split("labels", ",")).alias("label"))
    changed = rows.where(F.col("tkey").endswith("4")).withColumn("driver", F.lit("mysql")).withColumn("is_default", F.lit(False))
    changed = changed.unionByName(x.spark.createDataFrame([("db:new", "mongo", False)], rows.schema))
    changed = changed.withColumn("labels", F.array(F.lit("moved"), F.lit("tier=new")))
    return rows, labels, changed


@query("m12_upsert_targets", f"SELECT * FROM ({_CHANGED}) c UNION ALL SELECT tkey, driver, is_default FROM F_TGT WHERE right(tkey, 1) <> '4'")
def _(x):
    return merge.upsert_targets(*_targets(x))[0]


@query(
    "m12_replace_labels",
    f"""SELECT tkey, l AS label FROM ({_CHANGED}) c CROSS JOIN (VALUES ('moved'), ('tier=new')) AS v(l) UNION ALL SELECT tkey, label FROM ({_OLD_LABELS}) o WHERE right(tkey, 1) <> '4'""",
)
def _(x):
    return merge.upsert_targets(*_targets(x))[1]


@query("m12_delete_targets", f"SELECT tkey, label FROM ({_OLD_LABELS}) o WHERE right(tkey, 1) <> '4'")
def _(x):
    rows, labels, changed = _targets(x)
    return merge.delete_targets(rows, labels, changed)[1]


@query("m12_set_default", "SELECT tkey, tkey = 'db:3' AS is_default FROM F_TGT")
def _(x):
    return merge.set_default(x.F_TGT, "db:3").select("tkey", "is_default")


_WIDGET_UPS = """SELECT 'w' || CAST(user_id AS STRING) AS id, '2.' || CAST(event_id AS STRING) || '.0' AS version, event_id AS seq FROM events WHERE event_type <> 'error'"""


@query(
    "m14_widget_changes",
    f"""WITH u AS (SELECT id, max_by(version, seq) AS version FROM ({_WIDGET_UPS}) e GROUP BY id), d AS (SELECT DISTINCT 'w' || CAST(user_id AS VARCHAR) AS id FROM events WHERE event_type = 'error' AND user_id % 3 = 0)
 SELECT id, version FROM (SELECT * FROM u UNION ALL SELECT id, version FROM F_WID w WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.id = w.id)) a WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.id = a.id)""",
)
def _(x):
    x.events.createOrReplaceTempView("events")
    ups = x.spark.sql(_WIDGET_UPS)
    gone = x.events.where("event_type = 'error' and user_id % 3 = 0").select(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("id"))
    return merge.apply_widget_changes(x.F_WID.select("id", "version"), ups, gone, order="seq")
