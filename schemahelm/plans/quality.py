"""Row validation and lint queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemahelm.operators import quality as q
from schemahelm.plans.registry import query

_EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
# Customer rows with contact columns of mixed quality.
_CONTACTS = """SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_name || '@x' WHEN c_custkey % 5 = 0 THEN NULL ELSE lower(c_name) || '@mail.test' END AS email,
 CASE WHEN c_custkey % 4 = 0 THEN 'n/a' ELSE CAST(c_custkey AS STRING) || '.5' END AS score,
 CASE WHEN c_custkey % 6 = 0 THEN 'no-uuid' ELSE '00000000-0000-4000-8000-' || lpad(CAST(c_custkey AS STRING), 12, '0') END AS ref, upper(c_name) AS shout, c_custkey % 100 AS slot FROM customer"""


def _viol(table: str, column: str, rule: str, cond: str, source: str, key: str, value: str | None = None) -> str:
    return f"SELECT '{table}' AS table_name, CAST({key} AS VARCHAR) AS row_key, '{column}' AS column_name, '{rule}' AS rule, CAST({value or column} AS VARCHAR) AS value FROM {source} WHERE {cond}"


_V2 = [
    _viol("customer", "email", "email", f"email IS NOT NULL AND NOT regexp_matches(email, '{_EMAIL}')", "d", "c_custkey"),
    _viol("customer", "score", "number", "score IS NOT NULL AND TRY_CAST(score AS DOUBLE) IS NULL", "d", "c_custkey"),
    _viol("customer", "ref", "uuid", f"NOT regexp_matches(ref, '{_UUID}')", "d", "c_custkey"),
    _viol("customer", "c_name", "uppercase", "c_name <> upper(c_name)", "d", "c_custkey"),
]
_V2_RULES = [
    {"column": "email", "validator": "email"},
    {"column": "score", "validator": "number"},
    {"column": "ref", "validator": "uuid"},
    {"column": "shout", "validator": "uppercase"},
    {"column": "c_name", "validator": "uppercase"},
    {"column": "slot", "validator": "none"},
]


def _contacts(x):
    x.customer.createOrReplaceTempView("customer")
    return x.spark.sql(_CONTACTS)


@query("v2_validate_rows", f"WITH d AS ({_CONTACTS}) " + " UNION ALL ".join(_V2))
def validate_rows(x):
    return q.validate_rows(_contacts(x), _V2_RULES, ["c_custkey"], "customer")


@query(
    "v2_validate_texts",
    _viol("pages", "url", "regex", "NOT regexp_matches(url, '^https://')", "pages", "page_id")
    + " UNION ALL "
    + _viol("documents", "text", "regex", "NOT regexp_matches(text, '[.]')", "documents", "doc_id")
    + " UNION ALL "
    + _viol("documents", "lang", "uppercase", "lang <> upper(lang)", "documents", "doc_id"),
)
def _(x):
    pages = q.validate_rows(x.pages, [{"column": "url", "validator": "regex", "pattern": "^https://"}], ["page_id"], "pages")
    rules = [{"column": "text", "validator": "regex", "pattern": "[.]"}, {"column": "lang", "validator": "uppercase"}]
    return pages.unionByName(q.validate_rows(x.documents, rules, ["doc_id"], "documents"))


_V3_RULES = [
    {"column": "o_custkey", "unique": True, "nullable": False},
    {"column": "o_orderpriority", "base": "enum", "enums": ["1-urgent", "2-high"]},
    {"column": "o_orderstatus", "base": "varchar", "length": 0, "nullable": False},
]
_ORDERS_V3 = " UNION ALL ".join(
    [
        _viol("orders", "o_custkey", "unique", "o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1)", "orders", "o_orderkey"),
        _viol("orders", "o_orderpriority", "enum", "lower(o_orderpriority) NOT IN ('1-urgent', '2-high')", "orders", "o_orderkey"),
    ]
)
_CUST_V3 = " UNION ALL ".join(
    [
        _viol("customer", "email", "not_null", "email IS NULL", "d", "c_custkey"),
        _viol("customer", "c_name", "max_length", "length(c_name) > 17", "d", "c_custkey"),
        _viol("customer", "score", "type", "TRY_CAST(score AS DOUBLE) IS NULL", "d", "c_custkey"),
    ]
)
_CUST_RULES = [
    {"column": "email", "nullable": False},
    {"column": "c_name", "base": "varchar", "length": 17},
    {"column": "score", "base": "double"},
]


@query("v3_structural_rules", f"WITH d AS ({_CONTACTS}) {_ORDERS_V3} UNION ALL {_CUST_V3}")
def structural(x):
    orders = q.validate_rows(x.orders, _V3_RULES, ["o_orderkey"], "orders")
    return orders.unionByName(q.validate_rows(_contacts(x), _CUST_RULES, ["c_custkey"], "customer"))


@query(
    "v4_violation_summary",
    f"""WITH d AS ({_CONTACTS}), v AS ({_ORDERS_V3} UNION ALL {_CUST_V3}), t AS (SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer)
 SELECT v.table_name, v.column_name, v.rule, count(*) AS violations, t.n AS row_count, round(count(*) / t.n, 6) AS rate FROM v JOIN t ON t.table_name = v.table_name GROUP BY v.table_name, v.column_name, v.rule, t.n""",
)
def _(x):
    totals = reduce(
        DataFrame.unionByName,
        [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in (("orders", x.orders), ("customer", x.customer))],
    )
    return q.violation_summary(structural(x), totals)


_REGISTRY_RULES = """SELECT 'customer' AS table_name, n.column_name, CASE n.column_name WHEN 'email' THEN 'email' ELSE '' END AS validator, CASE n.column_name WHEN 'slot' THEN 'int' ELSE 'varchar(17)' END AS data_type,
 n.column_name <> 'email' AS is_nullable, n.column_name = 'ref' AS is_unique FROM (SELECT DISTINCT CASE n_nationkey % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'c_name' WHEN 2 THEN 'ref' ELSE 'absent' END AS column_name FROM nation) n"""


@query(
    "v2_rules_from_registry",
    f"WITH d AS ({_CONTACTS}) "
    + " UNION ALL ".join(
        [
            _V2[0],
            _viol("customer", "email", "not_null", "email IS NULL", "d", "c_custkey"),
            _viol("customer", "email", "max_length", "length(email) > 17", "d", "c_custkey"),
            _viol("customer", "c_name", "max_length", "length(c_name) > 17", "d", "c_custkey"),
            _viol("customer", "ref", "max_length", "length(ref) > 17", "d", "c_custkey"),
            _viol("customer", "ref", "unique", "ref IN (SELECT ref FROM d GROUP BY ref HAVING count(*) > 1)", "d", "c_custkey"),
        ]
    ),
)
def _(x):
    x.nation.createOrReplaceTempView("nation")
    data = _contacts(x)
    return q.validate_rows(data, q.rules_for(x.spark.sql(_REGISTRY_RULES), "customer", data.columns), ["c_custkey"], "customer")


_APPLIES = " UNION ALL ".join(
    f"SELECT table_name, column_name, '{name}' AS validator_id FROM F_OLD" + ("" if "*" in types else f" WHERE lower(data_type) IN ({', '.join(repr(t) for t in types)})")
    for name, types in q.VALIDATOR_TYPES.items()
)
_CORP = " UNION ALL SELECT table_name, column_name, 'corp' FROM F_OLD WHERE lower(data_type) = 'text' AND (starts_with(table_name, 'tbl_1') OR table_name = 'tbl_7')"


@query("v5_applicable_validators", _APPLIES + _CORP)
def _(x):
    catalogue = {**q.VALIDATOR_TYPES, "corp": ["text"]}
    df = q.applicable_validators(x.F_OLD, catalogue, {"corp": ["TBL_1*", "tbl_7"]})
    return df.select("table_name", "column_name", "validator_id")


_LINTED = """SELECT tenant_id, db_id, CASE WHEN tenant_id = 't2' THEN 'meta_roles' ELSE table_name END AS table_name, column_name, CASE WHEN has_default THEN 'exotic' ELSE validator END AS validator,
 CASE WHEN is_unique THEN '' WHEN is_nullable THEN 'core://auto' WHEN has_default THEN 'plugin://w5' ELSE 'plugin://nowhere' END AS widget FROM F_OLD UNION ALL
 SELECT tenant_id, db_id, table_name, column_name, '', 'plugin://select' FROM F_OLD WHERE data_type = 'text' AND tenant_id = 't1'"""


@query(
    "v6_lint_registry",
    f"""WITH f AS ({_LINTED}) SELECT tenant_id, db_id, table_name, column_name, 'reserved_table' AS issue FROM f WHERE starts_with(table_name, 'meta_roles')
 UNION ALL SELECT tenant_id, db_id, table_name, column_name, 'unknown_validator' FROM f WHERE validator = 'exotic'
 UNION ALL SELECT tenant_id, db_id, table_name, column_name, 'missing_display' FROM f WHERE widget = ''
 UNION ALL SELECT tenant_id, db_id, table_name, column_name, 'unknown_widget' FROM f WHERE widget = 'plugin://nowhere'
 UNION ALL SELECT tenant_id, db_id, table_name, column_name, 'duplicate_key' FROM f GROUP BY ALL HAVING count(*) > 1""".replace("GROUP BY ALL", "GROUP BY tenant_id, db_id, table_name, column_name"),
)
def _(x):
    x.F_OLD.createOrReplaceTempView("F_OLD")
    return q.lint_registry(x.spark.sql(_LINTED), x.F_WID)


_NAMED = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(c_name) WHEN 1 THEN c_name WHEN 2 THEN 'no' ELSE 'bad name!' END AS name FROM customer"""


@query(
    "v7_lint_names",
    f"""WITH n AS ({_NAMED}) SELECT c_custkey, 'role' AS kind, CASE WHEN NOT regexp_full_match(name, '[a-z0-9_#-]{{1,64}}') OR name LIKE '%#%' THEN 'invalid role name' END AS error FROM n
 UNION ALL SELECT c_custkey, 'username', CASE WHEN length(name) NOT BETWEEN 3 AND 64 OR NOT regexp_full_match(name, '[a-zA-Z0-9._-]+') THEN 'invalid username' END FROM n
 UNION ALL SELECT c_custkey, 'password', CASE WHEN length(name) NOT BETWEEN 8 AND 128 THEN 'invalid password' END FROM n
 UNION ALL SELECT c_custkey, 'label', CASE WHEN NOT regexp_full_match(name || '=x', '[a-zA-Z0-9._:/-]{{1,63}}=x') THEN 'invalid label' END FROM n
 UNION ALL SELECT c_custkey, 'identifier', CASE WHEN NOT regexp_full_match(name, '[A-Za-z0-9_.]+') THEN 'invalid identifier' END FROM n""",
)
def _(x):
    x.customer.createOrReplaceTempView("customer")
    n = x.spark.sql(_NAMED)
    shaped = {
        "role": n,
        "username": n.withColumnRenamed("name", "username"),
        "password": n.withColumnRenamed("name", "password"),
        "label": n.withColumn("label", F.concat("name", F.lit("=x"))),
        "identifier": n,
    }
    parts = [q.lint_entities(df, kind).select("c_custkey", F.lit(kind).alias("kind"), "error") for kind, df in shaped.items()]
    return reduce(DataFrame.unionByName, parts)


_ENTITIES = """SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/v1/' || CAST(page_id AS STRING) WHEN 1 THEN 'v1' ELSE '/v1/*' END AS path, CASE page_id % 5 WHEN 0 THEN 'get' WHEN 1 THEN '*' ELSE 'GET' END AS method,
 CASE page_id % 4 WHEN 0 THEN '' ELSE 'https' END AS driver, CASE page_id % 7 WHEN 0 THEN 'https:///db' WHEN 1 THEN 'https://h/' WHEN 2 THEN 'http://h/db' ELSE 'https://u@h/db' END AS dsn FROM pages"""


@query(
    "v7_lint_policies_dsn",
    f"""WITH n AS ({_ENTITIES}) SELECT page_id, 'policy' AS kind, CASE WHEN page_id % 3 = 1 THEN 'invalid path' WHEN method NOT IN ('GET') THEN 'invalid method' END AS error FROM n
 UNION ALL SELECT page_id, 'dsn', CASE WHEN driver = '' THEN 'driver and dsn required' WHEN page_id % 7 = 2 THEN 'https dsn must start with https://' WHEN page_id % 7 = 0 THEN 'dsn missing host'
  WHEN page_id % 7 = 1 THEN 'dsn missing database' END FROM n""",
)
def _(x):
    x.pages.createOrReplaceTempView("pages")
    n = x.spark.sql(_ENTITIES)
    return reduce(
        DataFrame.unionByName, [q.lint_entities(n, k).select("page_id", F.lit(k).alias("kind"), "error") for k in ("policy", "dsn")]
    )


_REQUESTS = """SELECT tenant_id, CASE WHEN k % 9 = 0 THEN 0 WHEN k % 10 = 0 THEN db_id + 50 ELSE db_id END AS db_id, CASE WHEN k % 7 = 0 THEN 'meta_users_x' WHEN k % 8 = 0 THEN 'ghost' ELSE table_name END AS table_name,
 column_name, CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'plugin://nowhere' WHEN 2 THEN 'text' WHEN 3 THEN 'plugin://w5' ELSE 'core://auto' END AS widget
 FROM (SELECT *, CAST(substr(column_name, 5) AS BIGINT) AS k FROM F_NEW) n"""
_REQ_DBS = "SELECT DISTINCT tenant_id, db_id AS id FROM F_OLD"
_REQ_TABLES = "SELECT DISTINCT tenant_id, db_id, upper(table_name) AS table_name FROM F_OLD"


@query(
    "v8_check_requests",
    f"""WITH r AS ({_REQUESTS}) SELECT tenant_id, db_id, table_name, column_name, widget, concat_ws(',', CASE WHEN starts_with(table_name, 'meta_users') THEN 'reserved_table' END,
  CASE WHEN widget = '' THEN 'widget_required' WHEN widget = 'plugin://nowhere' THEN 'unknown_widget' END,
  CASE WHEN db_id <= 0 THEN 'db_id_invalid' WHEN NOT EXISTS (SELECT 1 FROM ({_REQ_DBS}) d WHERE d.tenant_id = r.tenant_id AND d.id = r.db_id) THEN 'db_missing' END,
  CASE WHEN NOT EXISTS (SELECT 1 FROM F_OLD t WHERE t.tenant_id = r.tenant_id AND t.db_id = r.db_id AND t.table_name = r.table_name) THEN 'table_missing' END,
  CASE WHEN EXISTS (SELECT 1 FROM F_OLD o WHERE o.tenant_id = r.tenant_id AND o.db_id = r.db_id AND o.table_name = r.table_name AND o.column_name = r.column_name) THEN 'duplicate_field' END) AS errors FROM r""",
)
def _(x):
    x.F_OLD.createOrReplaceTempView("F_OLD")
    x.F_NEW.createOrReplaceTempView("F_NEW")
    requests, dbs, tables = (x.spark.sql(t) for t in (_REQUESTS, _REQ_DBS, _REQ_TABLES))
    return q.check_requests(requests, dbs, tables, x.F_OLD, x.F_WID)


@query(
    "g12_exists_flags",
    """SELECT tenant_id, db_id, table_name, column_name, EXISTS (SELECT 1 FROM F_OLD o WHERE o.tenant_id = n.tenant_id AND o.db_id = n.db_id AND o.table_name = n.table_name AND o.column_name = n.column_name) AS found FROM F_NEW n""",
)
def _(x):
    keys = ["tenant_id", "db_id", "table_name", "column_name"]
    return q.exists_flags(x.F_NEW.select(*keys), x.F_OLD, keys)


@query("u1_custom_validator", _viol("customer", "c_name", "ends_odd", "CAST(right(c_name, 1) AS INT) % 2 = 0", "customer", "c_custkey"))
def _(x):
    if q.get_validator("ends_odd") is None:
        q.register_validator("ends_odd", lambda c, p: F.right(c, F.lit(1)).try_cast("int") % 2 == 1)
    return q.validate_rows(x.customer, [{"column": "c_name", "validator": "ends_odd"}], ["c_custkey"], "customer")
