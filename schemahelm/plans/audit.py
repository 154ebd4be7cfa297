"""Audit, paging and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from schemahelm.operators import audit as a
from schemahelm.operators import paging as p
from schemahelm.operators.diff import diff
from schemahelm.plans.changes import _DIFF
from schemahelm.plans.registry import joined, query, ts_sql, ts_text

_MEMBERS = [
    "column_name", "data_type", "db_id", "default_value", "driver_extras", "has_default", "is_nullable", "is_unique", "kind", "label_key", "table_name",
    "tenant_id", "validator", "widget", "widget_config",
]
_DOC = lambda side: "to_json({" + ", ".join(f"'{m}': {m if m in ('column_name', 'table_name', 'tenant_id') else side + '_' + m}" for m in _MEMBERS) + "})::VARCHAR"
_NDIFF = " + ".join(
    f"CASE WHEN old_{m} IS NOT DISTINCT FROM new_{m} THEN 0 ELSE 1 END" for m in _MEMBERS if m not in ("column_name", "table_name", "tenant_id")
)


@query(
    "a1_audit_rows",
    _DIFF
    + f"""SELECT tenant_id, 'bob' AS actor, CASE change_type WHEN 'added' THEN 'add' WHEN 'deleted' THEN 'delete' ELSE 'update' END AS action, table_name, column_name,
 CASE WHEN change_type <> 'added' THEN {_DOC('old')} END AS before_json, CASE WHEN change_type <> 'deleted' THEN {_DOC('new')} END AS after_json,
 CASE change_type WHEN 'added' THEN 15 WHEN 'deleted' THEN 0 ELSE {_NDIFF} END AS added_count, CASE change_type WHEN 'added' THEN 0 WHEN 'deleted' THEN 15 ELSE {_NDIFF} END AS removed_count,
 CASE WHEN change_type = 'updated' THEN 2 * ({_NDIFF}) ELSE 15 END AS change_count FROM chg WHERE change_type <> 'unchanged'""",
)
def _(x):
    keys = ["tenant_id", "table_name", "column_name"]
    return a.audit_rows(diff(x.F_OLDX.drop("k"), x.F_NEWX.drop("k"), keys), "bob", keys=keys).drop("applied_at")


@query(
    "a2_action_rows",
    """SELECT tenant_id, actor, 'scan' AS action, 'registry' AS table_name, 'v' || id AS column_name, CASE WHEN id % 2 = 0 THEN '+1 -0' END AS before_json, CAST(NULL AS VARCHAR) AS after_json,
 CAST(0 AS BIGINT) AS added_count, CAST(0 AS BIGINT) AS removed_count, CAST(0 AS BIGINT) AS change_count FROM F_AUD""",
)
def _(x):
    rows = x.F_AUD.select(
        "tenant_id",
        "actor",
        F.lit("scan").alias("action"),
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("column_name"),
        F.when(F.col("id") % 2 == 0, F.lit("+1 -0")).otherwise(F.lit("")).alias("summary"),
    )
    return a.action_rows(rows).drop("applied_at")


_RECOUNT = """q AS (SELECT *, json_extract_string(before_json, '$.k') AS bk, json_extract_string(after_json, '$.k') AS ak FROM F_AUD),
 c AS (SELECT *, CASE WHEN after_json IS NULL THEN 0 WHEN before_json IS NULL THEN 1 WHEN bk = ak THEN 0 ELSE 1 END AS xa,
  CASE WHEN before_json IS NULL THEN 0 WHEN after_json IS NULL THEN 2 WHEN bk = ak THEN 1 ELSE 2 END AS xr FROM q)"""


@query(
    "a3_backfill_counts",
    f"""WITH {_RECOUNT} SELECT id, CAST(CASE WHEN change_count = 0 THEN xa ELSE added_count END AS BIGINT) AS added_count, CAST(CASE WHEN change_count = 0 THEN xr ELSE removed_count END AS BIGINT) AS removed_count,
 CAST(CASE WHEN change_count = 0 THEN xa + xr ELSE change_count END AS BIGINT) AS change_count FROM c""",
)
def backfill(x):
    return a.backfill_audit_counts(x.F_AUD).select("id", "added_count", "removed_count", "change_count")


@query(
    "v9_filter_audit",
    """SELECT id, tenant_id, actor, action, CAST(change_count AS BIGINT) AS change_count FROM F_AUD WHERE tenant_id = 't1' AND action IN ('add', 'update') AND change_count BETWEEN 0 AND 3
 AND applied_at >= TIMESTAMP '2024-01-05 00:00:00' AND applied_at < TIMESTAMP '2024-02-21 06:00:00'""",
)
def _(x):
    df = a.filter_audit(
        x.F_AUD, tenant="t1", action="add, update,", from_ts="2024-01-05T00:00:00Z", to_ts="2024-02-20T08:00:00+02:00", min_changes=-4, max_changes=3
    )
    return df.select("id", "tenant_id", "actor", "action", F.col("change_count").cast("bigint").alias("change_count"))


@query(
    "j1_resolve_actor",
    "SELECT a.id, coalesce(u.username, a.actor) AS actor FROM F_AUD a LEFT JOIN F_USERS u ON CAST(u.id AS VARCHAR) = a.actor",
)
def _(x):
    return a.resolve_actor(x.F_AUD, x.F_USERS).select("id", "actor")


_SUMMARY = "CASE WHEN action = 'snapshot' THEN coalesce(before_json, '{}') WHEN change_count = 0 THEN 'diff unavailable' ELSE '+' || added_count || ' -' || removed_count END"
_LIST = f"""SELECT a.id, coalesce(u.username, a.actor) AS actor, a.action, a.table_name, a.column_name, coalesce(a.before_json, '{{}}') AS before_json, coalesce(a.after_json, '{{}}') AS after_json,
 {_SUMMARY} AS summary, CAST(a.change_count AS BIGINT) AS change_count, {ts_sql('a.applied_at')} AS applied_at, (SELECT count(*) FROM h) > 20 AS more
 FROM (SELECT * FROM h ORDER BY applied_at DESC, id DESC LIMIT 20) a LEFT JOIN F_USERS u ON CAST(u.id AS VARCHAR) = a.actor"""


def _listed(df):
    return df.withColumn("applied_at", ts_text("applied_at")).withColumn("change_count", F.col("change_count").cast("bigint"))


@query("a4_audit_list", f"WITH h AS (SELECT * FROM F_AUD WHERE tenant_id = 't1' AND change_count >= 1) {_LIST}")
def audit_list(x):
    return _listed(a.audit_list(x.F_AUD, x.F_USERS, limit=20, tenant="t1", min_changes=1))


@query(
    "a4_audit_list_next",
    f"WITH h AS (SELECT * FROM F_AUD WHERE tenant_id = 't2' AND (applied_at < TIMESTAMP '2024-01-20 00:00:00' OR (applied_at = TIMESTAMP '2024-01-20 00:00:00' AND id < 5))) {_LIST}",
)
def _(x):
    after = {"applied_at": "2024-01-20 00:00:00", "id": 5}
    return _listed(a.audit_list(x.F_AUD, x.F_USERS, limit=20, after=after, tenant="t2"))


@query(
    "a4_audit_list_all_recounted",
    f"""WITH {_RECOUNT}, h AS (SELECT * REPLACE (CASE WHEN change_count = 0 THEN xa ELSE added_count END AS added_count, CASE WHEN change_count = 0 THEN xr ELSE removed_count END AS removed_count,
 CASE WHEN change_count = 0 THEN xa + xr ELSE change_count END AS change_count) FROM c WHERE tenant_id = 't3') SELECT id, {_SUMMARY} AS summary FROM (SELECT * FROM h ORDER BY applied_at DESC, id DESC LIMIT 200)""",
)
def _(x):
    counted = a.backfill_audit_counts(x.F_AUD)
    return a.audit_list(counted, x.F_USERS, limit=200, tenant="t3").select("id", "summary")


@query(
    "a4_audit_get",
    f"""WITH {_RECOUNT} SELECT c.id, coalesce(u.username, c.actor) AS actor, CASE WHEN action = 'snapshot' THEN coalesce(before_json, '') WHEN added_count + removed_count = 0
  THEN '+' || xa || ' -' || xr ELSE '+' || added_count || ' -' || removed_count END AS summary, '/v1/audit-logs/' || c.id || '/diff' AS diff_url FROM c LEFT JOIN F_USERS u ON CAST(u.id AS VARCHAR) = c.actor
 WHERE c.id = (SELECT max(event_id) FROM events)""",
)
def _(x):
    top = x.events.agg(F.max("event_id")).first()[0]
    return a.audit_get(x.F_AUD, x.F_USERS, top).select("id", "actor", "summary", "diff_url")


_HISTORY = f"""SELECT id, tenant_id, table_name, column_name, action, {ts_sql('applied_at')} AS applied_at, row_number() OVER w AS change_no, lag(after_json) OVER w AS previous_state,
 CAST(epoch_us(applied_at) - epoch_us(lag(applied_at) OVER w) AS BIGINT) AS micros_since_last FROM F_AUD WINDOW w AS (PARTITION BY tenant_id, table_name, column_name ORDER BY applied_at, id)"""


@query("w9_field_history", _HISTORY)
def field_history(x):
    return a.field_history(x.F_AUD).withColumn("applied_at", ts_text("applied_at"))


# Rows of actions have neither table nor column.
_WITH_ACTIONS = "SELECT * REPLACE (CASE WHEN action = 'snapshot' THEN NULL ELSE table_name END AS table_name, CASE WHEN action = 'snapshot' THEN NULL ELSE column_name END AS column_name) FROM F_AUD"


@query("w9_history_of_actions", _HISTORY.replace("FROM F_AUD", f"FROM ({_WITH_ACTIONS}) a"))
def _(x):
    own = lambda c: F.when(F.col("action") != "snapshot", F.col(c)).alias(c)
    rows = x.F_AUD.select(*(own(c) if c in ("table_name", "column_name") else c for c in x.F_AUD.columns))
    return a.field_history(rows).withColumn("applied_at", ts_text("applied_at"))


# --- paging -----------------------------------------------------------------------------------------------


@query(
    "w1_keyset_page",
    "WITH h AS (SELECT tkey, driver FROM F_TGT WHERE tkey > 'db:1') SELECT *, (SELECT count(*) FROM h) > 5 AS more FROM (SELECT * FROM h ORDER BY tkey LIMIT 5) p",
)
def _(x):
    return p.keyset_page(x.F_TGT.select("tkey", "driver"), [("tkey", "asc")], {"tkey": "db:1"}, 5)


_NULLS = "SELECT tkey, CASE WHEN driver <> 'mongo' THEN driver END AS driver FROM F_TGT"


# NULL keys come first in ascending order and last in descending order.
@query(
    "w1_keyset_page_nulls",
    f"""WITH n AS ({_NULLS}), a AS (SELECT * FROM n WHERE (driver IS NULL AND tkey > 'db:2') OR driver IS NOT NULL), d AS (SELECT * FROM n WHERE driver < 'postgres' OR driver IS NULL OR (driver = 'postgres' AND tkey > 'db:3'))
 SELECT 'asc' AS direction, *, (SELECT count(*) FROM a) > 7 AS more FROM (SELECT * FROM a ORDER BY driver NULLS FIRST, tkey LIMIT 7)
 UNION ALL SELECT 'desc', *, (SELECT count(*) FROM d) > 200 FROM (SELECT * FROM d ORDER BY driver DESC NULLS LAST, tkey LIMIT 200)""",
)
def _(x):
    rows = x.F_TGT.select("tkey", F.when(F.col("driver") != "mongo", F.col("driver")).alias("driver"))
    up = p.keyset_page(rows, [("driver", "asc"), ("tkey", "asc")], {"driver": None, "tkey": "db:2"}, 7)
    down = p.keyset_page(rows, [("driver", "desc"), ("tkey", "asc")], {"driver": "postgres", "tkey": "db:3"}, 200)
    return up.select(F.lit("asc").alias("direction"), "tkey", "driver", "more").unionByName(down.select(F.lit("desc").alias("direction"), "tkey", "driver", "more"))


@query(
    "w2_deep_page",
    f"SELECT id, applied_at, table_name FROM (SELECT id, {ts_sql('applied_at')} AS applied_at, table_name, row_number() OVER (ORDER BY F_AUD.applied_at DESC, id) AS rn FROM F_AUD) WHERE rn > (SELECT count(*) // 2 FROM F_AUD) AND rn <= (SELECT count(*) // 2 FROM F_AUD) + 50",
)
def _(x):
    # A page in the middle of the log.
    log = x.F_AUD.select("id", "applied_at", "table_name")
    page = p.numbered_page(log, [("applied_at", "desc"), ("id", "asc")], log.count() // 2, 50)
    return page.withColumn("applied_at", ts_text("applied_at"))


@query(
    "w1_keyset_page_events",
    f"""WITH h AS (SELECT id, applied_at FROM F_AUD WHERE applied_at < TIMESTAMP '2024-01-10 00:00:00') SELECT id, {ts_sql('applied_at')} AS applied_at, (SELECT count(*) FROM h) > 200 AS more
 FROM (SELECT * FROM h ORDER BY applied_at DESC, id DESC LIMIT 200) p""",
)
def _(x):
    after = {"applied_at": "2024-01-10 00:00:00", "id": 0}
    page = p.keyset_page(x.F_AUD.select("id", "applied_at"), a.AUDIT_ORDER, after, 1000)
    return page.withColumn("applied_at", ts_text("applied_at"))


_USER_HITS = """h AS (SELECT id, username FROM F_USERS u WHERE tenant_id = 't1' AND lower(username) LIKE '%1%' AND NOT EXISTS (SELECT 1 FROM F_UROLES r WHERE r.user_id = u.id AND r.role_id = 2))"""


@query(
    "w2_user_page",
    f"""WITH {_USER_HITS}, p AS (SELECT * FROM h ORDER BY username DESC, id LIMIT 10 OFFSET 10)
 SELECT p.id, p.username, CASE WHEN p.id IS NOT NULL THEN coalesce((SELECT string_agg(r.name, ',' ORDER BY r.name) FROM F_UROLES ur JOIN F_ROLES r ON r.id = ur.role_id WHERE ur.user_id = p.id), '') END AS roles,
  t.total FROM (SELECT count(*) AS total FROM h) t LEFT JOIN p ON true""",
)
def _(x):
    return p.user_page(x.F_USERS, x.F_UROLES, x.F_ROLES, "t1", page=2, per_page=10, order="desc", term="1", without_role=2)


@query("w2_past_the_end", f"WITH {_USER_HITS} SELECT NULL::BIGINT AS id, NULL::VARCHAR AS username, NULL::VARCHAR AS roles, count(*) AS total FROM h")
def _(x):
    return p.user_page(x.F_USERS, x.F_UROLES, x.F_ROLES, "t1", page=10**6, per_page=10, order="desc", term="1", without_role=2)


@query(
    "w3_page_role_names",
    """WITH p AS (SELECT id, username FROM F_USERS WHERE tenant_id = 't0' ORDER BY username, id LIMIT 20)
 SELECT p.id, p.username, coalesce((SELECT string_agg(r.name, ',' ORDER BY r.name) FROM F_UROLES ur JOIN F_ROLES r ON r.id = ur.role_id WHERE ur.user_id = p.id), '') AS roles FROM p""",
)
def _(x):
    return p.user_page(x.F_USERS, x.F_UROLES, x.F_ROLES, "t0").drop("total")


def widget_arrays(x):
    split = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))
    return x.F_WID.withColumn("scopes", split("scopes")).withColumn("tenants", split("tenants"))


_VISIBLE = """(scopes LIKE '%tenant%' OR scopes LIKE '%system%') AND NOT (scopes LIKE '%tenant%' AND tenants <> '' AND NOT list_contains(string_split(tenants, ','), 't2'))"""


@query(
    "w5_list_widgets",
    f"""WITH h AS (SELECT id, name FROM F_WID WHERE {_VISIBLE} AND (lower(id) LIKE '%1%' OR lower(name) LIKE '%1%')) SELECT id, name, (SELECT count(*) FROM h) AS total FROM h ORDER BY id LIMIT 50 OFFSET 10""",
)
def _(x):
    return p.list_widgets(widget_arrays(x), ["tenant", "system"], "t2", "1", offset=10).select("id", "name", "total")


@query("w8_list_failed", "SELECT id, name, data AS payload, CAST(3 AS BIGINT) AS attempts FROM F_EVT WHERE failing_attempts >= 3")
def _(x):
    dlq = x.F_EVT.where("failing_attempts >= 3").select("id", "name", F.col("data").alias("payload"), F.lit(3).cast("bigint").alias("attempts"))
    return p.list_failed(dlq)


@query("w8_current_version", "SELECT coalesce(max(p_size), 0) AS version FROM part")
def _(x):
    return p.current_version(x.part.select(F.col("p_size").alias("version")))


@query("v10_search", "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%9%'")
def _(x):
    return p.search(x.customer, "9", ["c_name"]).select("c_custkey", "c_name")


@query("v10_search_arrays", "SELECT id, scopes FROM F_WID WHERE lower(name) LIKE '%ten%' OR scopes LIKE '%ten%'")
def _(x):
    return p.search(widget_arrays(x), "TEN", ["name"], ["scopes"]).select("id", joined("scopes").alias("scopes"))
