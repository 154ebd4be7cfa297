"""Input views of the registered queries, derived from the driver tables.

Every text is valid in Spark SQL and in the oracle's dialect and covers whole tables, so the views grow with
the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {}

VIEWS["F_OLD"] = """
SELECT 't' || CAST(o_custkey % 8 AS STRING) AS tenant_id, CAST(1 + o_custkey % 5 AS BIGINT) AS db_id,
       'tbl_' || CAST(o_custkey AS STRING) AS table_name, 'col_' || CAST(o_orderkey AS STRING) AS column_name,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'varchar(255)' WHEN '2-HIGH' THEN 'int' WHEN '3-MEDIUM' THEN 'decimal'
            WHEN '4-NOT SPECIFIED' THEN 'timestamp' ELSE 'text' END AS data_type,
       o_orderkey % 3 = 0 AS is_nullable, o_orderkey % 10 = 0 AS is_unique, o_orderkey % 4 = 0 AS has_default,
       CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus END AS default_value,
       CASE o_orderkey % 6 WHEN 0 THEN 'email' WHEN 1 THEN 'number' WHEN 2 THEN 'uuid' WHEN 3 THEN 'regex' ELSE '' END AS validator
FROM orders"""

VIEWS["F_NEW"] = """
SELECT tenant_id, db_id, table_name, column_name,
       CASE WHEN k % 7 = 0 THEN 'bigint' ELSE data_type END AS data_type, is_nullable, is_unique, has_default, default_value,
       CASE WHEN k % 5 = 0 THEN '' ELSE validator END AS validator
FROM (SELECT f.*, CAST(substr(column_name, 5) AS BIGINT) AS k FROM F_OLD f) x WHERE k % 11 <> 0
UNION ALL
SELECT tenant_id, db_id, table_name, 'new_' || substr(column_name, 5), 'text', true, false, false, CAST(NULL AS STRING), ''
FROM F_OLD WHERE CAST(substr(column_name, 5) AS BIGINT) % 13 = 0"""

# The same two registries with the whole definitions; some of the new ones differ only in what is shown.
VIEWS["F_OLDX"] = """
SELECT f.*, CASE WHEN data_type IN ('int', 'decimal') THEN 'number' ELSE 'string' END AS kind,
       CASE WHEN k % 8 = 0 THEN '{"ttlSeconds":' || CAST(k % 60 AS STRING) || '}' END AS driver_extras,
       CASE WHEN k % 3 = 0 THEN 'label.' || column_name END AS label_key, CASE k % 4 WHEN 0 THEN 'core://auto' WHEN 1 THEN 'plugin://text' ELSE '' END AS widget,
       '{"rows":' || CAST(k % 5 AS STRING) || '}' AS widget_config
FROM (SELECT f.*, CAST(substr(column_name, 5) AS BIGINT) AS k FROM F_OLD f) f"""

VIEWS["F_NEWX"] = """
SELECT f.*, CASE WHEN k % 27 = 1 THEN 'any' WHEN data_type IN ('int', 'decimal', 'bigint') THEN 'number' ELSE 'string' END AS kind,
       CASE WHEN k % 8 = 0 AND k % 24 <> 0 THEN '{"ttlSeconds":' || CAST(k % 60 AS STRING) || '}' END AS driver_extras,
       CASE WHEN k % 3 = 0 THEN 'label.' || column_name WHEN k % 19 = 1 THEN 'label.other' END AS label_key,
       CASE k % 4 WHEN 0 THEN 'core://auto' WHEN 1 THEN 'plugin://text' ELSE CASE WHEN k % 17 = 0 THEN 'plugin://select' ELSE '' END END AS widget,
       '{"rows":' || CAST(CASE WHEN k % 23 = 0 THEN 9 ELSE k % 5 END AS STRING) || '}' AS widget_config
FROM (SELECT f.*, CAST(substr(column_name, 5) AS BIGINT) AS k FROM F_NEW f) f"""

# Two databases of a tenant that share tables and columns.
VIEWS["F_OLD2"] = """
SELECT * FROM F_OLDX UNION ALL
SELECT tenant_id, db_id + 50, table_name, column_name, 'text', is_nullable, is_unique, has_default, default_value, validator, k, kind, driver_extras, label_key, 'second', widget_config
FROM F_OLDX WHERE k % 4 = 0"""

VIEWS["F_NEW2"] = """
SELECT * FROM F_NEWX UNION ALL
SELECT tenant_id, db_id + 50, table_name, column_name, data_type, is_nullable, is_unique, has_default, default_value, validator, k, kind, driver_extras, label_key, 'changed', widget_config
FROM F_NEWX WHERE k % 8 = 0"""

_CAT_TABLE = """CASE WHEN l_orderkey % 17 = 0 THEN 'meta_users_' WHEN l_orderkey % 19 = 0 THEN 'pg_stat_' ELSE 'tbl_' END || CAST(l_orderkey AS STRING)"""

VIEWS["F_CAT"] = f"""
SELECT 'public' AS table_schema, {_CAT_TABLE} AS table_name,
       'col_' || CAST(l_linenumber AS STRING) AS column_name, CAST(l_linenumber AS BIGINT) AS ordinal_position,
       CASE l_linenumber % 4 WHEN 0 THEN 'bigint' WHEN 1 THEN 'character varying' WHEN 2 THEN 'jsonb' ELSE 'date' END AS data_type,
       CASE WHEN l_linenumber % 2 = 0 THEN 'YES' ELSE 'NO' END AS is_nullable,
       CASE WHEN l_linenumber % 3 = 0 THEN 'now()' END AS column_default
FROM lineitem GROUP BY l_orderkey, l_linenumber"""

VIEWS["F_IDX"] = f"""
SELECT {_CAT_TABLE} AS table_name,
       'idx_' || CAST(l_linenumber % 3 AS STRING) AS index_name, 'col_' || CAST(l_linenumber AS STRING) AS column_name
FROM lineitem GROUP BY l_orderkey, l_linenumber"""

VIEWS["F_DOC"] = """
SELECT event_type AS collection, event_id AS doc_id,
       '{"id":' || CAST(event_id AS STRING) || ',"k":' || CASE WHEN event_id % 50 = 0 THEN '"n/a"' ELSE CAST(event_id % 97 AS STRING) END
       || CASE WHEN event_id % 3 = 0 THEN ',"tag":"x"' ELSE '' END || CASE WHEN event_id % 4 = 0 THEN ',"ok":true' ELSE '' END || ',"v":1.5}' AS doc
FROM events"""

VIEWS["F_AUD"] = """
SELECT event_id AS id, 't' || CAST(user_id % 4 AS STRING) AS tenant_id, CAST(user_id AS STRING) AS actor,
       CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'snapshot' ELSE 'update' END AS action,
       'tbl_' || CAST(user_id % 10 AS STRING) AS table_name, 'col_' || CAST(event_id % 7 AS STRING) AS column_name,
       CASE WHEN event_type = 'signup' THEN CAST(NULL AS STRING) ELSE '{"a":1,"k":' || CAST(event_id % 5 AS STRING) || '}' END AS before_json,
       CASE WHEN event_type = 'error' THEN CAST(NULL AS STRING) ELSE props END AS after_json,
       CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 4 END AS added_count,
       CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 2 END AS removed_count,
       CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 4 + event_id % 2 END AS change_count, ts AS applied_at
FROM events"""

VIEWS["F_TGT"] = """
SELECT 'db:' || CAST(s_suppkey AS STRING) AS tkey, CASE s_suppkey % 3 WHEN 0 THEN 'postgres' WHEN 1 THEN 'mysql' ELSE 'mongo' END AS driver,
       'Region=' || r_name || ',nation=' || n_name || CASE WHEN s_acctbal > 5000 THEN ',tier=gold' ELSE ',tier=silver' END
       || CASE WHEN s_suppkey % 7 = 0 THEN ',Deprecated' ELSE '' END AS labels, s_suppkey = 0 AS is_default
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

VIEWS["F_REQ"] = """
SELECT event_id AS request_id, 'tenant:' || CAST(user_id AS STRING) AS hash_source,
       CASE WHEN event_id % 20 = 0 THEN 'db:' || CAST(event_id % 10 AS STRING) END AS explicit_key,
       CASE event_id % 3 WHEN 0 THEN 'tier=gold' WHEN 1 THEN 'tier=silver' ELSE 'tier=none' END AS prefer_label, ts
FROM events"""

VIEWS["F_USERS"] = """
SELECT c_custkey AS id, 't' || CAST(c_nationkey % 4 AS STRING) AS tenant_id, c_name AS username FROM customer"""

VIEWS["F_ROLES"] = """
SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, lower(r_name) AS name FROM region"""

VIEWS["F_UROLES"] = """
SELECT DISTINCT o_custkey AS user_id, CAST(1 + o_orderkey % 5 AS BIGINT) AS role_id FROM orders WHERE o_orderkey % 3 = 0"""

VIEWS["F_POLICIES"] = """
SELECT CAST(v.role_id AS BIGINT) AS role_id, v.path AS path, v.method AS method
FROM (VALUES (1,'/v1/*','*'), (2,'/v1/databases','GET'), (2,'/v1/databases/:id','PUT'), (3,'/v1/custom-fields','GET'),
             (3,'/v1/custom-fields/:name','DELETE'), (4,'/v1/snapshots','POST'), (2,'/v1/(x','GET'), (3,'/v1/a.b','*'), (4,'/v1/[z','*'),
             (5,'/v1/q+/*','*'), (3,'/v1/own/*/part','GET'), (4,'/v1/own/v:ver/x','GET')) AS v(role_id, path, method)
UNION ALL
SELECT CAST(1 + s_suppkey % 5 AS BIGINT), CASE s_suppkey % 3 WHEN 0 THEN '/v1/databases/' || CAST(s_suppkey AS STRING) WHEN 1 THEN '/v1/targets/' || CAST(s_suppkey AS STRING) || '/*'
       ELSE '/v1/targets/' || CAST(s_suppkey AS STRING) || '/:part' END, CASE s_suppkey % 2 WHEN 0 THEN 'GET' ELSE 'PUT' END
FROM supplier"""

VIEWS["F_API"] = """
SELECT event_id AS request_id, 't' || CAST(user_id % 4 AS STRING) AS tenant, user_id,
       CASE event_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'PUT' ELSE 'POST' END AS method,
       CASE event_id % 4 WHEN 0 THEN '/v1/databases' WHEN 1 THEN '/v1/databases/' || CAST(user_id AS STRING)
            WHEN 2 THEN CASE event_id % 96 WHEN 2 THEN '/v1/(x' WHEN 6 THEN '/v1/aXb' WHEN 10 THEN '/v1/a.b' WHEN 14 THEN '/v1/[z' WHEN 18 THEN '/v1/q+/a/b'
                 WHEN 22 THEN '/v1/own/a/b/part' WHEN 26 THEN '/v1/own/v7/x' WHEN 30 THEN '/v1/own/v/x' WHEN 34 THEN '/v1/own/part' WHEN 38 THEN '/v1/q' ELSE '/v1/custom-fields' END
            ELSE '/v1/snapshots' END AS path,
       CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status, CAST(event_id % 1200 AS DOUBLE) / 100 AS duration_s, ts
FROM events"""

VIEWS["F_WID"] = """
SELECT 'w' || CAST(p_partkey AS STRING) AS id, p_name AS name, '1.' || CAST(p_size AS STRING) || '.0' AS version,
       CASE p_partkey % 3 WHEN 0 THEN 'system' WHEN 1 THEN 'tenant' ELSE 'system,tenant' END AS scopes,
       CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 't1' ELSE 't1,t2' END AS tenants, p_partkey % 5 AS updated_seq
FROM part"""

VIEWS["F_WEV"] = """
SELECT event_id AS seq, 'w' || CAST(user_id AS STRING) AS id, ts,
       CASE event_type WHEN 'error' THEN 'remove' WHEN 'view' THEN 'bogus' ELSE 'upsert' END AS change_type,
       '2.' || CAST(event_id AS STRING) || '.0' AS version
FROM events"""

VIEWS["F_EVT"] = """
SELECT event_id AS id, 'cf.field.' || event_type AS name, ts, props AS data, event_id % 5 AS failing_attempts FROM events"""

VIEWS["F_HLT"] = """
SELECT event_id AS seq, 'db:' || CAST(user_id % 10 AS STRING) AS tkey, ts,
       CASE WHEN event_type <> 'error' THEN 'ok' WHEN event_id % 25 = 0 THEN 'permanent' ELSE 'transient' END AS outcome
FROM events"""

VIEWS["F_DEF"] = """
SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'mysql' ELSE 'postgres' END AS driver,
       CASE p_partkey % 6 WHEN 0 THEN 'date' WHEN 1 THEN 'time' WHEN 2 THEN 'datetime' WHEN 3 THEN 'varchar' WHEN 4 THEN 'text' ELSE 'timestamp' END AS col_type,
       CASE p_partkey % 3 WHEN 0 THEN 'expression' WHEN 1 THEN 'literal' ELSE 'none' END AS mode,
       CASE p_partkey % 5 WHEN 0 THEN 'CURRENT_TIMESTAMP' WHEN 1 THEN 'curdate()' WHEN 2 THEN '2024-01-02 03:04:05' WHEN 3 THEN 'NOW()' ELSE p_name END AS raw,
       p_partkey % 7 = 0 AS on_update
FROM part"""

VIEWS["F_SNAP"] = """
SELECT tenant_id, '0.0.' || CAST(s.n AS STRING) AS semver, CAST(s.n AS BIGINT) AS snapshot_id, db_id, table_name, column_name,
       CASE WHEN s.n = 3 AND has_default THEN 'bigint' ELSE data_type END AS data_type, is_nullable, is_unique, has_default, default_value,
       validator, k, kind, driver_extras, label_key, CASE WHEN s.n = 3 AND k % 7 = 1 THEN 'plugin://shown' ELSE widget END AS widget, widget_config
FROM F_OLD2 CROSS JOIN (VALUES (1), (2), (3)) AS s(n)
WHERE k % (s.n + 3) <> 0"""

VIEWS["F_REG"] = """
SELECT c_custkey AS doc_id, '{"version":"' || CASE WHEN c_custkey % 2 = 0 THEN '0.1' ELSE '0.3' END || '","fields":[{"table":"t'
       || CAST(c_custkey AS STRING) || '","column":"email","type":"varchar(255)","placeholder":"p","validator":"email"},{"table":"t'
       || CAST(c_custkey AS STRING) || '","column":"rating","type":"int"}]}' AS doc
FROM customer"""

# Views that read other views.
_NEEDS = {
    "F_NEW": ["F_OLD"], "F_OLDX": ["F_OLD"], "F_NEWX": ["F_OLD", "F_NEW"], "F_OLD2": ["F_OLD", "F_OLDX"],
    "F_NEW2": ["F_OLD", "F_NEW", "F_NEWX"], "F_SNAP": ["F_OLD", "F_OLDX", "F_OLD2"],
}


def with_views(sql: str) -> str:
    """Put the views that a statement mentions into its WITH clause."""
    used = [name for name in VIEWS if name in sql]
    for name in list(used):
        used = [*_NEEDS.get(name, []), *used]
    names = list(dict.fromkeys(used))
    if not names:
        return sql
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    return f"WITH {ctes},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"


class Inputs:
    """Tables and views of one data folder as DataFrames (``x.orders``, ``x.F_OLD``)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._frames: dict[str, DataFrame] = {}

    def path(self, table: str) -> str:
        return f"{self.sf_dir.rstrip('/')}/{table}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in (*TABLES, *VIEWS):
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self._view(name) if name in VIEWS else self.spark.read.parquet(self.path(name))
        return self._frames[name]

    def _view(self, name: str) -> DataFrame:
        sql = VIEWS[name]
        for used in [*TABLES, *_NEEDS.get(name, [])]:
            if used in sql:
                getattr(self, used).createOrReplaceTempView(used)
        return self.spark.sql(sql)
