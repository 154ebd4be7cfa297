"""Typing, identifier and text function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from schemahelm.functions import jsondiff, text as tx
from schemahelm.functions import typing as ty
from schemahelm.operators.audit import audit_summary
from schemahelm.operators.jsonschema import build_jsonschema, schema_properties
from schemahelm.operators.merge import desired_indexes, index_plan
from schemahelm.plans.registry import case_sql, joined, query, ts_sql, ts_text
from schemahelm.sources.registry import backfill_kinds

_SQL_KIND = case_sql("lower(trim(data_type))", ty.SQL_KINDS, "'any'")
_BASE = "CASE WHEN instr(data_type, '(') > 0 THEN split_part(data_type, '(', 1) ELSE data_type END"
_KEY = ["table_name", "column_name"]


@query("p1_sql_kind", f"SELECT table_name, column_name, data_type, {_SQL_KIND} AS kind, {case_sql(_BASE, ty.SQL_KINDS, chr(39) + 'any' + chr(39))} AS kind_stripped FROM F_OLD")
def _(x):
    return x.F_OLD.select(*_KEY, "data_type", ty.sql_kind("data_type").alias("kind"), ty.sql_kind("data_type", strip=True).alias("kind_stripped"))


_MONGO_NAMES = [n for names in ty.MONGO_KINDS.values() for n in names] + ["weird"]


def _nth_sql(values: list[str], col: str = "event_id") -> str:
    return f"CASE {col} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _nth(values: list[str], col: str = "event_id"):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(col) % len(values) + 1).cast("int"))


@query(
    "p2_mongo_kind",
    f"SELECT doc_id, t AS bson, {case_sql('lower(t)', ty.MONGO_KINDS, chr(39) + 'any' + chr(39))} AS kind FROM (SELECT doc_id, {_nth_sql(_MONGO_NAMES, 'doc_id')} AS t FROM F_DOC)",
)
def _(x):
    t = _nth(_MONGO_NAMES, "doc_id")
    return x.F_DOC.select("doc_id", t.alias("bson"), ty.mongo_kind(t).alias("kind"))


_STORE = "CASE WHEN is_unique THEN 'mongo' ELSE 'sql' END"
_MONGO_KIND = case_sql("lower(trim(data_type))", ty.MONGO_KINDS, "'any'")


@query("p3_guess_kind", f"SELECT table_name, column_name, CASE WHEN is_unique THEN {_MONGO_KIND} ELSE {_SQL_KIND} END AS kind FROM F_OLD")
def _(x):
    store = F.when(F.col("is_unique"), F.lit("mongo")).otherwise(F.lit("sql"))
    return x.F_OLD.select(*_KEY, ty.guess_kind(store, "data_type").alias("kind"))


@query(
    "p4_physical_type",
    "SELECT table_name, column_name, 'postgres:' || lower(trim(data_type)) AS sql_type, CASE WHEN is_unique THEN 'mongodb:any' ELSE 'mongodb:' || data_type END AS mongo_type FROM F_OLD",
)
def _(x):
    blank = F.when(F.col("is_unique"), F.lit(" ")).otherwise(F.col("data_type"))
    return x.F_OLD.select(
        *_KEY,
        ty.physical_type(F.lit(" Postgres"), "data_type").alias("sql_type"),
        ty.physical_type(F.lit("mongo"), blank).alias("mongo_type"),
    )


@query("p5_store_kind", "SELECT tkey, CASE WHEN driver = 'mongo' THEN 'mongo' ELSE 'sql' END AS store_kind FROM F_TGT")
def _(x):
    return x.F_TGT.select("tkey", ty.store_kind("driver").alias("store_kind"))


@query(
    "p6_backfill_kinds",
    f"""SELECT table_name, column_name, 'sql' AS store_kind, CASE WHEN has_default THEN 'preset' ELSE {_SQL_KIND} END AS kind, 'mysql:' || data_type AS physical_type FROM F_OLD""",
)
def _(x):
    stored = x.F_OLD.withColumn("kind", F.when(F.col("has_default"), F.lit("preset")).otherwise(F.lit(" ")))
    return backfill_kinds(stored, "mysql").select(*_KEY, "store_kind", "kind", "physical_type")


@query("p7_ddl_type", f"SELECT table_name, column_name, CASE WHEN {_BASE} = 'varchar' THEN 'VARCHAR(255)' ELSE {_BASE} END AS ddl FROM F_OLD")
def _(x):
    return x.F_OLD.select(*_KEY, ty.normalize_ddl_type(F.lit("mysql"), ty.parse_type("data_type")["base"]).alias("ddl"))


_TYPES = ["varchar(255)", "enum('a', 'b','c')", "decimal(10,2)", " Text ", "set(x,y)", "tinyint(1)", "int"]
_PARSED = ["varchar", "enum", "decimal", "text", "set", "tinyint", "int"]
_LENGTHS = ["255", "", "10", "", "", "1", ""]
_ENUMS = ["", "a,b,c", "", "", "x,y", "", ""]


def _typed(x):
    k = F.substring("column_name", 5, 20).cast("bigint") % len(_TYPES)
    return x.F_OLD.withColumn("_k", k).withColumn("_t", _nth(_TYPES, "_k"))


def _typed_sql(select: str) -> str:
    return f"SELECT table_name, column_name, {select} FROM (SELECT *, CAST(substr(column_name, 5) AS BIGINT) AS k FROM F_OLD)"


@query(
    "p8_parse_type",
    _typed_sql(f"{_nth_sql(_PARSED, 'k')} AS base, TRY_CAST({_nth_sql(_LENGTHS, 'k')} AS BIGINT) AS length, {_nth_sql(_ENUMS, 'k')} AS enums"),
)
def _(x):
    p = ty.parse_type("_t")
    return _typed(x).select(*_KEY, p["base"].alias("base"), p["length"].cast("bigint").alias("length"), F.coalesce(joined(p["enums"]), F.lit("")).alias("enums"))


@query("p9_policy_type", _typed_sql(f"{_nth_sql(['varchar', 'enum', 'decimal', 'text', 'set', 'boolean', 'int'], 'k')} AS policy_type, CASE data_type WHEN 'timestamp' THEN 'datetime' WHEN 'varchar(255)' THEN 'varchar' ELSE data_type END AS stored_policy_type"))
def _(x):
    p, q = ty.parse_type("_t"), ty.parse_type("data_type")
    my = F.lit("mysql")
    return _typed(x).select(
        *_KEY,
        ty.policy_type(my, p["base"], p["length"]).alias("policy_type"),
        ty.policy_type(my, q["base"], q["length"]).alias("stored_policy_type"),
    )


@query("p10_validator_name", "SELECT table_name, column_name, CASE WHEN trim(validator) = '' THEN 'none' ELSE lower(validator) END AS validator FROM F_OLD")
def _(x):
    return x.F_OLD.select(*_KEY, ty.norm_validator("validator").alias("validator"))


_EXTRAS_SQL = """CASE WHEN has_default THEN '{"allowNull":true,"array_items":{"kind":"Int"},"ttlSeconds":"60","unique":"TRUE"}' WHEN is_unique THEN '{"ttlSeconds":30,"required":1,"array_items":{"physical_type":"mongodb:bool"}}' ELSE NULL END"""
_BSON_IN = _nth_sql([f"mongodb:{n}" for n in ["array", "string", "int64", "objectId", "date", "weird", "binary", "decimal128"]], "CAST(substr(column_name, 5) AS BIGINT)")
_BSON_OUT = _nth_sql(["array", "string", "long", "objectId", "date", "string", "binData", "decimal"], "CAST(substr(column_name, 5) AS BIGINT)")


def _doc_fields(x):
    x.F_OLD.createOrReplaceTempView("F_OLD")
    return x.spark.sql(f"SELECT *, {_EXTRAS_SQL} AS driver_extras, {_BSON_IN} AS physical_type FROM F_OLD")


@query(
    "p11_bson_type",
    f"""SELECT table_name, column_name, {_BSON_OUT} AS bson, CASE WHEN is_nullable OR has_default THEN {_BSON_OUT} || ',null' ELSE {_BSON_OUT} END AS declared,
 CASE WHEN has_default THEN 'int' WHEN is_unique THEN 'bool' END AS item FROM F_OLD""",
)
def _(x):
    bson = ty.bson_type("physical_type", "data_type")
    return _doc_fields(x).select(
        *_KEY,
        bson.alias("bson"),
        joined(ty.nullable_bson_type("is_nullable", "driver_extras", bson)).alias("declared"),
        ty.array_item_type("driver_extras").alias("item"),
    )


@query(
    "p12_build_jsonschema",
    f"""WITH p AS (SELECT tenant_id, db_id, table_name, column_name, is_nullable, {_BSON_OUT} AS b, is_nullable OR has_default AS nul,
  CASE WHEN has_default THEN 'int' WHEN is_unique THEN 'bool' END AS item FROM F_OLD),
 e AS (SELECT *, '"' || column_name || '":{{"bsonType":' || CASE WHEN nul THEN '["' || b || '","null"]' ELSE '"' || b || '"' END
  || CASE WHEN b = 'array' AND item IS NOT NULL THEN ',"items":{{"bsonType":"' || item || '"}}' ELSE '' END || '}}' AS entry FROM p)
 SELECT tenant_id, db_id, table_name, '{{"$jsonSchema":{{"bsonType":"object","properties":{{' || string_agg(entry, ',' ORDER BY column_name) || '}}' ||
  coalesce(',"required":[' || string_agg('"' || column_name || '"', ',' ORDER BY column_name) FILTER (NOT is_nullable) || ']', '') || '}}}}' AS validator
 FROM e GROUP BY tenant_id, db_id, table_name""",
)
def _(x):
    return build_jsonschema(_doc_fields(x))


@query(
    "p12_schema_properties",
    f"""WITH p AS (SELECT tenant_id, db_id, table_name, column_name, is_nullable, {_BSON_OUT} AS b, is_nullable OR has_default AS nul,
  CASE WHEN has_default THEN 'int' WHEN is_unique THEN 'bool' END AS item FROM F_OLD)
 SELECT tenant_id, db_id, table_name, column_name, '{{"bsonType":' || CASE WHEN nul THEN '["' || b || '","null"]' ELSE '"' || b || '"' END
  || CASE WHEN b = 'array' AND item IS NOT NULL THEN ',"items":{{"bsonType":"' || item || '"}}' ELSE '' END || '}}' AS property, NOT is_nullable AS required FROM p""",
)
def _(x):
    return schema_properties(_doc_fields(x), ["tenant_id", "db_id", "table_name"])


_DESIRED = """SELECT table_name, column_name, 'meta_' || table_name || '_' || column_name || '_unique' AS index_name, true AS is_unique, CAST(NULL AS INT) AS expire_after
 FROM F_OLD WHERE is_unique OR has_default UNION ALL SELECT table_name, column_name, 'meta_' || table_name || '_' || column_name || '_ttl', false,
 CASE WHEN has_default THEN 60 ELSE 30 END FROM F_OLD WHERE is_unique OR has_default"""


@query("p13_desired_indexes", _DESIRED)
def _(x):
    return desired_indexes(_doc_fields(x))


_EXISTING = """SELECT table_name, column_name, CASE WHEN is_nullable THEN 'meta_' || table_name || '_' || column_name || '_unique' ELSE 'other_' || column_name END AS index_name
 FROM F_OLD WHERE is_unique"""


@query(
    "m13_index_plan",
    f"""SELECT DISTINCT table_name, index_name, 'drop' AS action FROM ({_EXISTING}) e WHERE starts_with(index_name, 'meta_' || table_name || '_')
 UNION ALL SELECT DISTINCT table_name, index_name, 'create' FROM ({_DESIRED}) d""",
)
def _(x):
    return index_plan(desired_indexes(_doc_fields(x)), x.spark.sql(_EXISTING))


@query(
    "p14_extras",
    """SELECT doc_id, doc_id % 4 = 0 AS ok, CASE WHEN doc_id % 50 <> 0 THEN doc_id % 97 END AS k, CAST(NULL AS BIGINT) AS v FROM F_DOC""",
)
def _(x):
    return x.F_DOC.select(
        "doc_id",
        ty.extra_bool("doc", "ok").alias("ok"),
        ty.extra_int32("doc", "k").cast("bigint").alias("k"),
        ty.extra_int32("doc", "v").cast("bigint").alias("v"),
    )


_RAW_WIDGETS = ["", " Text", "core://default", "core://text-input", "core://date-input", "number", "bool", "plugin://X", "custom", "json"]
_CANON = [
    "core://auto", "plugin://text-input", "core://auto", "plugin://text-input", "plugin://date-input", "plugin://number-input",
    "plugin://checkbox", "plugin://x", "plugin://custom", "plugin://json-editor",
]


@query("p15_canon_widget", f"SELECT p_partkey, {_nth_sql(_CANON, 'p_partkey')} AS widget, 'plugin://w' || p_partkey AS own FROM part")
def _(x):
    own = F.concat(F.lit("W"), F.col("p_partkey").cast("string"))
    return x.part.select("p_partkey", ty.canon_widget(_nth(_RAW_WIDGETS, "p_partkey")).alias("widget"), ty.canon_widget(own).alias("own"))


@query("p19_db_id", "SELECT table_name, column_name, CASE WHEN db_id - 1 = 0 THEN 1 ELSE db_id - 1 END AS db_id FROM F_OLD")
def _(x):
    return x.F_OLD.select(*_KEY, ty.norm_db_id(F.col("db_id") - 1).alias("db_id"))


@query(
    "p20_parse_time",
    f"""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 1 THEN {ts_sql("date_trunc('second', ts)")} ELSE {ts_sql('ts')} END AS parsed FROM events""",
)
def _(x):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    raw = (
        F.when(F.col("event_id") % 4 == 0, F.concat(iso, F.lit("Z")))
        .when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .otherwise(F.lit("not a time"))
    )
    return x.events.select("event_id", ts_text(tx.parse_time(raw)).alias("parsed"))


@query("p25_norm_path", "SELECT request_id, regexp_replace(path, '[0-9]+', ':id', 'g') AS path FROM F_API")
def _(x):
    return x.F_API.select("request_id", tx.norm_path("path").alias("path"))


@query(
    "p26_normalize_json",
    r"""SELECT id, CASE WHEN before_json IS NULL THEN NULL ELSE '{' || chr(10) || '  "a": 1,' || chr(10) || '  "k": ' || json_extract_string(before_json, '$.k') || chr(10) || '}' END AS doc FROM F_AUD""",
)
def _(x):
    return x.F_AUD.select("id", jsondiff.normalize_json("before_json").alias("doc"))


@query(
    "p27_audit_summary",
    """SELECT id, CASE WHEN action = 'snapshot' THEN coalesce(before_json, '{}') WHEN change_count = 0 THEN 'diff unavailable' ELSE '+' || added_count || ' -' || removed_count END AS summary FROM F_AUD""",
)
def _(x):
    return x.F_AUD.select("id", audit_summary("action", "change_count", "added_count", "removed_count", "before_json").alias("summary"))


@query(
    "p28_semver",
    """SELECT tenant_id, table_name, column_name, semver, '0.0.' || (snapshot_id + 1) AS patch, '0.1.0' AS minor, '1.0.0' AS major, snapshot_id < 2 AS older FROM F_SNAP""",
)
def _(x):
    return x.F_SNAP.select(
        "tenant_id",
        *_KEY,
        "semver",
        *[tx.next_semver("semver", b).alias(b) for b in ("patch", "minor", "major")],
        tx.semver_lt("semver", F.lit("0.0.2")).alias("older"),
    )


_DSN = """CASE page_id % 5 WHEN 0 THEN 'postgres' WHEN 1 THEN 'mysql' WHEN 2 THEN 'mongodb+srv' WHEN 3 THEN 'mongodb' ELSE 'redis' END
 || '://' || CASE WHEN page_id % 7 = 0 THEN 'host/' WHEN page_id % 7 = 1 THEN 'host/?authSource=adm' ELSE substr(url, instr(url, '://') + 3) END"""


@query(
    "p29_dsn_inventory",
    f"""WITH q AS (SELECT page_id, {_DSN} AS dsn FROM pages), r AS (SELECT *, CASE page_id % 5 WHEN 0 THEN 'postgres' WHEN 1 THEN 'mysql' WHEN 2 THEN 'mongo' WHEN 3 THEN 'mongo' END AS driver,
  regexp_extract(dsn, '^[a-z+]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(dsn, '([^/]*)$', 1) AS rest, dsn LIKE '%?authSource=adm' AS auth FROM q)
 SELECT page_id, driver, CASE driver WHEN 'mysql' THEN rest <> '' AND rest NOT LIKE '?%' WHEN 'postgres' THEN path NOT IN ('', '/') OR dsn LIKE '%dbname=%'
  WHEN 'mongo' THEN path NOT IN ('', '/') OR auth ELSE false END AS has_database,
  CASE driver WHEN 'postgres' THEN 'public' WHEN 'mysql' THEN split_part(rest, '?', 1) WHEN 'mongo' THEN CASE WHEN trim(path, '/') <> '' THEN trim(path, '/') WHEN auth THEN 'adm' ELSE '' END ELSE '' END AS db_schema FROM r""",
)
def _(x):
    x.pages.createOrReplaceTempView("pages")
    rows = x.spark.sql(f"SELECT page_id, {_DSN} AS dsn FROM pages")
    rows = rows.withColumn("driver", tx.dsn_driver("dsn"))
    return rows.select(
        "page_id", "driver", tx.dsn_has_database("driver", "dsn").alias("has_database"), tx.dsn_schema("driver", "dsn").alias("db_schema")
    )


_FNV_SQL = (
    "list_reduce(list_transform(string_split({c}, ''), lambda ch: ord(ch)::BIGINT), "
    "lambda h, b: (xor(h, b) * 16777619) % 4294967296, 2166136261::BIGINT)"
)


@query("p31_fnv1a32", f"SELECT request_id, {_FNV_SQL.format(c='hash_source')} AS hash FROM F_REQ")
def _(x):
    return x.F_REQ.select("request_id", tx.fnv1a32("hash_source").alias("hash"))
