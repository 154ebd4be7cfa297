"""Role, permission and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from schemahelm.operators import access as a
from schemahelm.operators import metrics
from schemahelm.plans.registry import query

# Every special character stands for itself; a whole segment * is any rest, :name the rest of a segment.
_LITERAL = r"regexp_replace(p.path, '([][.+*?(){}|^$\\])', '\\\1', 'g')"
_RX = rf"'^' || regexp_replace(regexp_replace({_LITERAL}, '/\\\*(/|$)', '/.*\1', 'g'), ':[^/]+', '[^/]+', 'g') || '$'"


def _match(path: str, method: str) -> str:
    return f"(p.method = '*' OR p.method = {method}) AND regexp_matches({path}, {_RX})"


@query("j2_role_policies", "SELECT r.name AS role, p.path, p.method FROM F_ROLES r JOIN F_POLICIES p ON p.role_id = r.id")
def _(x):
    return a.role_policies(x.F_ROLES, x.F_POLICIES)


_HELD = "SELECT u.tenant_id, u.id AS user_id, u.username, r.name AS role FROM F_USERS u JOIN F_UROLES ur ON ur.user_id = u.id JOIN F_ROLES r ON r.id = ur.role_id"


@query("j3_roles_of", f"{_HELD} WHERE u.tenant_id = 't2'")
def _(x):
    return a.roles_of(x.F_USERS, x.F_UROLES, x.F_ROLES, "t2")


@query("j3_roles_of_user", f"{_HELD} WHERE u.id = 7 OR u.username = 'Customer#000000010'")
def _(x):
    by_id = a.roles_of(x.F_USERS, x.F_UROLES, x.F_ROLES, user="7")
    return by_id.unionByName(a.roles_of(x.F_USERS, x.F_UROLES, x.F_ROLES, user="Customer#000000010"))


@query("j4_users_without_role", "SELECT id, tenant_id, username FROM F_USERS u WHERE NOT EXISTS (SELECT 1 FROM F_UROLES r WHERE r.user_id = u.id AND r.role_id = 3)")
def _(x):
    return a.users_without_role(x.F_USERS, x.F_UROLES, 3)


_OWN = "SELECT id AS u, '/v1/snapshots' AS path, 'GET' AS method FROM F_USERS WHERE id % 50 = 0 UNION SELECT id, '/v1/own/' || CAST(id % 3 AS VARCHAR), 'PUT' FROM F_USERS WHERE id % 100 = 0"


@query(
    "j5_effective_permissions",
    f"""SELECT DISTINCT ur.user_id, p.path, p.method FROM F_UROLES ur JOIN F_POLICIES p ON p.role_id = ur.role_id UNION SELECT u, path, method FROM ({_OWN})""",
)
def effective_permissions(x):
    own = x.F_USERS.where("id % 50 = 0").select(F.col("id").alias("user_id"), F.lit("/v1/snapshots").alias("path"), F.lit("GET").alias("method"))
    more = x.F_USERS.where("id % 100 = 0").select(F.col("id").alias("user_id"), F.concat(F.lit("/v1/own/"), (F.col("id") % 3).cast("string")).alias("path"), F.lit("PUT").alias("method"))
    return a.user_permissions(*a.effective_permissions(x.F_UROLES, x.F_POLICIES, own.unionByName(more)))


@query(
    "j5_users_of_permission",
    f"""SELECT path, method, count(DISTINCT user_id) AS users FROM (SELECT ur.user_id, p.path, p.method FROM F_UROLES ur JOIN F_POLICIES p ON p.role_id = ur.role_id
 UNION SELECT u, path, method FROM ({_OWN})) GROUP BY path, method""",
)
def _(x):
    own = x.F_USERS.where("id % 50 = 0").select(F.col("id").alias("user_id"), F.lit("/v1/snapshots").alias("path"), F.lit("GET").alias("method"))
    more = x.F_USERS.where("id % 100 = 0").select(F.col("id").alias("user_id"), F.concat(F.lit("/v1/own/"), (F.col("id") % 3).cast("string")).alias("path"), F.lit("PUT").alias("method"))
    return a.users_of_permissions(*a.effective_permissions(x.F_UROLES, x.F_POLICIES, own.unionByName(more)))


@query(
    "j5_role_resources",
    f"""SELECT DISTINCT r.path, r.method, p.role_id FROM (SELECT DISTINCT path, method FROM F_API) r JOIN F_POLICIES p ON {_match('r.path', 'r.method')}""",
)
def _(x):
    return a.policy_hits(x.F_API, x.F_POLICIES)


_CAPS = ", ".join(f"('{c}', '{p}', '{m}')" for c, p, m in a.CAPABILITIES)


@query(
    "j6_capabilities",
    f"""WITH m AS (SELECT * FROM (VALUES {_CAPS}) AS v(capability, cpath, cmethod)), ok AS (SELECT DISTINCT p.role_id, m.capability FROM m JOIN F_POLICIES p ON {_match('m.cpath', 'm.cmethod')}),
 uk AS (SELECT DISTINCT ur.user_id, ok.capability FROM F_UROLES ur JOIN ok ON ok.role_id = ur.role_id)
 SELECT u.id AS user_id, m.capability, uk.user_id IS NOT NULL AS allowed FROM F_USERS u CROSS JOIN m LEFT JOIN uk ON uk.user_id = u.id AND uk.capability = m.capability""",
)
def _(x):
    return a.capabilities(x.F_USERS, x.F_UROLES, x.F_POLICIES)


# More capabilities than a long has bits; each of the later ones is granted by one policy only.
_WIDE = [(f"c{i}", f"/v1/own/{i}", "GET") for i in range(70)]


@query(
    "j6_capabilities_wide",
    """WITH pol AS (SELECT role_id, path FROM F_POLICIES UNION ALL SELECT DISTINCT 1 + o_orderkey % 5, '/v1/own/' || CAST(o_orderkey % 70 AS VARCHAR) FROM orders WHERE o_orderkey % 7 = 0),
 m AS (SELECT 'c' || i AS capability, '/v1/own/' || i AS path FROM range(70) t(i)),
 ok AS (SELECT DISTINCT ur.user_id, m.capability FROM F_UROLES ur JOIN pol ON pol.role_id = ur.role_id JOIN m ON m.path = pol.path OR pol.path = '/v1/*')
 SELECT u.id AS user_id, m.capability, ok.user_id IS NOT NULL AS allowed FROM F_USERS u CROSS JOIN m LEFT JOIN ok ON ok.user_id = u.id AND ok.capability = m.capability""",
)
def _(x):
    own = x.orders.where("o_orderkey % 7 = 0").select(
        (1 + F.col("o_orderkey") % 5).alias("role_id"), F.concat(F.lit("/v1/own/"), (F.col("o_orderkey") % 70).cast("string")).alias("path"), F.lit("GET").alias("method")
    )
    return a.capabilities(x.F_USERS, x.F_UROLES, x.F_POLICIES.unionByName(own.distinct()), _WIDE)


@query(
    "j7_enforce_log",
    f"""WITH h AS (SELECT DISTINCT r.path, r.method, p.role_id FROM (SELECT DISTINCT path, method FROM F_API) r JOIN F_POLICIES p ON {_match('r.path', 'r.method')})
 SELECT request_id, EXISTS (SELECT 1 FROM h JOIN F_UROLES ur ON ur.role_id = h.role_id WHERE h.path = q.path AND h.method = q.method AND ur.user_id = q.user_id) AS allowed FROM F_API q""",
)
def enforce(x):
    return a.enforce_log(x.F_API, x.F_UROLES, x.F_POLICIES).select("request_id", "allowed")


@query("j9_role_members", "SELECT u.id, u.username FROM F_USERS u JOIN F_UROLES ur ON ur.user_id = u.id WHERE ur.role_id = 2 AND u.tenant_id = 't1'")
def _(x):
    return a.role_members(x.F_USERS, x.F_UROLES, 2, "t1")


_FIELDS = "SELECT DISTINCT 't' || CAST(user_id % 3 AS STRING) AS tenant_id, 'tbl_' || CAST(event_id % 6 AS STRING) AS table_name, 'col_' || CAST(event_id % 7 AS STRING) AS column_name, CASE WHEN event_id % 7 = 0 THEN 'int' WHEN user_id % 3 = 1 THEN 'uuid' ELSE 'text' END AS data_type FROM events WHERE event_id % 6 <> 2"


def _lookups(x):
    x.events.createOrReplaceTempView("events")
    return a.lookup_fields(x.F_AUD, x.spark.sql(_FIELDS))


@query(
    "j10_lookup_fields",
    f"SELECT id, f.data_type, f.table_name IS NOT NULL AS hit FROM F_AUD a LEFT JOIN ({_FIELDS}) f ON f.tenant_id = a.tenant_id AND f.table_name = a.table_name AND f.column_name = a.column_name",
)
def _(x):
    return _lookups(x).select("id", "data_type", "hit")


@query(
    "g11_hit_ratio",
    f"""SELECT a.table_name, count(f.table_name) AS hits, count(*) - count(f.table_name) AS misses FROM F_AUD a LEFT JOIN ({_FIELDS}) f ON f.tenant_id = a.tenant_id AND f.table_name = a.table_name AND f.column_name = a.column_name GROUP BY a.table_name""",
)
def _(x):
    return metrics.hit_ratio(_lookups(x), ["table_name"])


@query("g2_role_member_counts", "SELECT u.tenant_id, ur.role_id, count(*) AS members FROM F_UROLES ur JOIN F_USERS u ON u.id = ur.user_id GROUP BY u.tenant_id, ur.role_id")
def _(x):
    return a.role_member_counts(x.F_USERS, x.F_UROLES)


@query(
    "g3_list_roles",
    """SELECT r.id AS role_id, r.name AS role, p.path, p.method, (SELECT count(*) FROM F_UROLES ur JOIN F_USERS u ON u.id = ur.user_id WHERE ur.role_id = r.id AND u.tenant_id = 't1') AS members
 FROM F_ROLES r LEFT JOIN F_POLICIES p ON p.role_id = r.id""",
)
def _(x):
    return a.list_roles(x.F_ROLES, x.F_POLICIES, x.F_USERS, x.F_UROLES, "t1")


@query(
    "g13_deletable_roles",
    "SELECT id, name FROM (SELECT * FROM F_ROLES UNION ALL SELECT n_nationkey + 100, lower(n_name) FROM nation) r WHERE id NOT IN (SELECT role_id FROM F_UROLES) AND id NOT IN (SELECT role_id FROM F_POLICIES)",
)
def _(x):
    extra = x.nation.select((F.col("n_nationkey") + 100).cast("bigint").alias("id"), F.lower("n_name").alias("name"))
    return a.deletable_roles(x.F_ROLES.unionByName(extra), x.F_POLICIES, x.F_UROLES)


_VIEWED = "SELECT c_custkey AS user_id, CAST(c_nationkey AS BIGINT) AS id, 'postgres://h/' || c_name AS dsn FROM customer"


@query(
    "p30_mask_secrets",
    f"""WITH v AS ({_VIEWED}), w AS (SELECT DISTINCT v.user_id, v.id FROM v JOIN F_UROLES ur ON ur.user_id = v.user_id JOIN F_POLICIES p ON p.role_id = ur.role_id
  AND (({_match("'/v1/databases'", "'POST'")}) OR ({_match("'/v1/databases/' || v.id", "'PUT'")}) OR ({_match("'/v1/databases/' || v.id", "'DELETE'")})))
 SELECT v.user_id, v.id, CASE WHEN w.user_id IS NOT NULL THEN v.dsn ELSE '' END AS dsn FROM v LEFT JOIN w ON w.user_id = v.user_id AND w.id = v.id""",
)
def _(x):
    x.customer.createOrReplaceTempView("customer")
    return a.mask_secrets(x.spark.sql(_VIEWED), x.F_UROLES, x.F_POLICIES)
