"""Catalog, document, registry and target source queries."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from schemahelm.functions.typing import MONGO_KINDS, SQL_KINDS
from schemahelm.plans.registry import case_sql, joined, query
from schemahelm.session import scratch_path
from schemahelm.sources import catalog as cat
from schemahelm.sources import documents as docs
from schemahelm.sources import profile, registry, targets

_KIND = case_sql("lower(trim(data_type))", SQL_KINDS, "'any'")
_UNIQ = """u AS (SELECT DISTINCT table_name, column_name FROM (SELECT table_name, index_name, min(column_name) AS column_name, count(*) AS n FROM F_IDX GROUP BY ALL) WHERE n = 1)"""
_UNIQ = _UNIQ.replace("GROUP BY ALL", "GROUP BY table_name, index_name")


def _scan_sql(physical: str) -> str:
    return f"""WITH {_UNIQ} SELECT c.table_name, c.column_name, c.data_type, 'sql' AS store_kind, {_KIND} AS kind, {physical} AS physical_type,
 is_nullable = 'YES' AS is_nullable, column_default IS NOT NULL AS has_default, column_default AS default_value, ordinal_position, u.table_name IS NOT NULL AS is_unique
 FROM F_CAT c LEFT JOIN u ON u.table_name = c.table_name AND u.column_name = c.column_name"""


def _column_type():
    wide = F.when(F.col("data_type") == "bigint", F.lit("BIGINT(20)")).when(F.col("data_type") == "date", F.lit(""))
    return wide.otherwise(F.col("data_type"))


@query("s1_scan_catalog_mysql", _scan_sql("'mysql:' || CASE c.data_type WHEN 'bigint' THEN 'bigint(20)' ELSE c.data_type END"))
def _(x):
    return cat.scan_catalog(x.F_CAT.withColumn("column_type", _column_type()), x.F_IDX, "mysql")


@query("s2_scan_catalog_postgres", _scan_sql("'postgres:' || c.data_type"))
def _(x):
    return cat.scan_catalog(x.F_CAT, x.F_IDX, "postgres", schema="public")


@query("s3_scan_minimal", f"SELECT table_name, column_name, data_type, 'sql' AS store_kind, {_KIND} AS kind, 'postgres:' || data_type AS physical_type FROM F_CAT")
def _(x):
    return cat.scan_catalog(x.F_CAT, minimal=True)


@query("s4_single_column_uniques", f"WITH {_UNIQ} SELECT table_name, column_name FROM u")
def _(x):
    return cat.single_column_uniques(x.F_IDX)


_DOC_FIELDS = """t AS (SELECT collection, count(*) AS docs, count(*) FILTER (doc_id % 50 = 0) AS na, count(*) FILTER (doc_id % 50 <> 0) AS num,
   count(*) FILTER (doc_id % 3 = 0) AS tags, count(*) FILTER (doc_id % 4 = 0) AS oks FROM F_DOC GROUP BY collection),
 f AS (SELECT collection AS table_name, 'id' AS column_name, 'int' AS data_type, false AS is_nullable FROM t
  UNION ALL SELECT collection, 'k', CASE WHEN na > 0 THEN 'string' ELSE 'int' END, false FROM t
  UNION ALL SELECT collection, 'v', 'double', false FROM t
  UNION ALL SELECT collection, 'tag', 'string', tags < docs FROM t WHERE tags > 0
  UNION ALL SELECT collection, 'ok', 'bool', oks < docs FROM t WHERE oks > 0)"""
_DOC_KIND = case_sql("data_type", MONGO_KINDS, "'any'")


@query(
    "s5_infer_document_schema",
    f"WITH {_DOC_FIELDS} SELECT table_name, column_name, data_type, 'mongo' AS store_kind, {_DOC_KIND} AS kind, 'mongodb:' || data_type AS physical_type, is_nullable, false AS is_unique, false AS has_default FROM f",
)
def document_schema(x):
    return docs.infer_document_schema(x.F_DOC)


_VALIDATOR = """SELECT collection || '_' || CAST(doc_id AS STRING) AS collection, '{"bsonType":"object","properties":{"id":{"bsonType":"' || CASE WHEN doc_id % 2 = 0 THEN 'int64' ELSE 'objectId' END
 || '"},"n":{"bsonType":["' || CASE WHEN doc_id % 3 = 0 THEN 'decimal128' ELSE 'bool' END || '"]},"d":{"bsonType":["string","null"],"default":' || CAST(doc_id AS STRING) || '}},"required":["id"' ||
 CASE WHEN doc_id % 5 = 0 THEN ',"d"' ELSE '' END || ']}' AS validator, doc_id FROM F_DOC"""


@query(
    "s6_fields_from_jsonschema",
    f"""WITH v AS ({_VALIDATOR}), f AS (SELECT collection AS table_name, 'id' AS column_name, CASE WHEN doc_id % 2 = 0 THEN 'long' ELSE 'string' END AS data_type, false AS is_nullable, false AS has_default, CAST(NULL AS VARCHAR) AS default_value FROM v
  UNION ALL SELECT collection, 'n', CASE WHEN doc_id % 3 = 0 THEN 'decimal' ELSE 'bool' END, true, false, NULL FROM v
  UNION ALL SELECT collection, 'd', 'string', doc_id % 5 <> 0, true, CAST(doc_id AS VARCHAR) FROM v)
 SELECT table_name, column_name, data_type, 'mongo' AS store_kind, {_DOC_KIND} AS kind, 'mongodb:' || data_type AS physical_type, is_nullable, false AS is_unique, has_default, default_value FROM f""",
)
def _(x):
    x.F_DOC.createOrReplaceTempView("F_DOC")
    return docs.fields_from_jsonschema(x.spark.sql(_VALIDATOR))


_DOC_IDX = """SELECT DISTINCT collection AS table_name, 'u_' || c.name AS index_name, c.name AS column_name FROM F_DOC CROSS JOIN (VALUES ('id'), ('email')) AS c(name)
 UNION ALL SELECT DISTINCT collection, 'pair', c.name FROM F_DOC CROSS JOIN (VALUES ('k'), ('v')) AS c(name)"""


@query(
    "s7_merge_unique_indexes",
    f"""WITH {_DOC_FIELDS} SELECT table_name, column_name, data_type, {_DOC_KIND} AS kind, is_nullable, column_name = 'id' AS is_unique FROM f
 UNION ALL SELECT collection, 'email', 'string', 'string', true, true FROM t""",
)
def _(x):
    x.F_DOC.createOrReplaceTempView("F_DOC")
    fields = cat.mark_unique(document_schema(x), x.spark.sql(_DOC_IDX), add_missing=True)
    return fields.select("table_name", "column_name", "data_type", "kind", "is_nullable", "is_unique")


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    rows = [
        f"""SELECT '{table}' AS table_name, '{c}' AS column_name, '{t}' AS data_type, count(*) AS row_count, count(*) - count({c}) AS null_count, count(*) > count({c}) AS is_nullable,
 {"false" if "<" in t else f"count({c}) > 0 AND count(DISTINCT {c}) = count({c})"} AS is_unique FROM {table}"""
        for c, t in columns.items()
    ]
    return " UNION ALL ".join(rows)


_PROFILED = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
_PROFILED = {t: dict(c.split() for c in columns.split(", ")) for t, columns in _PROFILED.items()}


@query("s8_profile_tables", " UNION ALL ".join(_profile_sql(t, c) for t, c in _PROFILED.items()))
def _(x):
    return profile.profile_tables({t: getattr(x, t) for t in _PROFILED})


_CATALOG = """SELECT DISTINCT table_schema, table_name, CASE WHEN length(table_name) % 2 = 0 THEN 'comment of ' || table_name END AS comment,
 CASE WHEN table_name LIKE '%3' THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type FROM F_CAT"""
_SCHEMAS = """SELECT DISTINCT CASE WHEN table_name LIKE '%5' THEN 'sales' WHEN table_name LIKE '%6' THEN 'pg_temp_3' WHEN table_name LIKE '%7' THEN 'information_schema'
 WHEN table_name LIKE '%8' THEN '' ELSE 'public' END AS table_schema, CASE WHEN table_name LIKE '%11' THEN 'schema_migrations' ELSE table_name END AS table_name,
 CASE WHEN table_name LIKE '%3' THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type FROM F_CAT"""


def _sql_on_catalog(x, sql):
    x.F_CAT.createOrReplaceTempView("F_CAT")
    return x.spark.sql(sql)


@query("s9_list_tables", f"SELECT table_name, coalesce(comment, '') AS comment FROM ({_CATALOG}) c WHERE table_type = 'BASE TABLE'")
def _(x):
    return cat.list_tables(_sql_on_catalog(x, _CATALOG), "public", base_only=True)


@query(
    "s10_qualify_tables",
    f"""SELECT table_schema, table_name, table_type, CASE WHEN table_schema IN ('', 'public') THEN table_name ELSE table_schema || '.' || table_name END AS qualified FROM ({_SCHEMAS}) s
 WHERE table_type = 'BASE TABLE' AND table_schema NOT IN ('information_schema', 'pg_temp_3')""",
)
def _(x):
    return cat.qualify_tables(_sql_on_catalog(x, _SCHEMAS))


@query(
    "s11_filter_tables",
    f"""SELECT table_schema, table_name FROM ({_SCHEMAS}) s WHERE table_schema NOT IN ('information_schema', 'pg_temp_3') AND table_name <> 'schema_migrations'
 AND NOT starts_with(table_name, 'meta_') AND NOT starts_with(table_name, 'pg_')""",
)
def _(x):
    return cat.filter_tables(_sql_on_catalog(x, _SCHEMAS), "postgres").select("table_schema", "table_name")


@query("s11_filter_tables_mysql", f"SELECT table_schema, table_name FROM ({_SCHEMAS}) s WHERE table_name <> 'schema_migrations' AND NOT starts_with(table_name, 'meta_')")
def _(x):
    return cat.filter_tables(_sql_on_catalog(x, _SCHEMAS), "mysql").select("table_schema", "table_name")


@query(
    "v1_reserved_tables",
    "SELECT DISTINCT table_name, regexp_matches(table_name, '^meta_users') AS reserved FROM F_CAT",
)
def _(x):
    return x.F_CAT.select("table_name", cat.is_reserved("table_name").alias("reserved")).distinct()


_REG_COLS = "tenant_id, db_id, table_name, column_name, data_type"


@query("s12_load_registry", f"SELECT {_REG_COLS}, 'sql' AS store_kind, {_KIND} AS kind, 'postgres:' || lower(data_type) AS physical_type FROM F_OLD WHERE tenant_id = 't3' AND db_id = 2")
def _(x):
    df = registry.load_registry(x.F_OLD, tenant="t3", db_id=2)
    return df.select(*_REG_COLS.split(", "), "store_kind", "kind", "physical_type")


@query("s12_load_registry_all", f"SELECT {_REG_COLS}, {_KIND} AS kind FROM F_OLD")
def _(x):
    return registry.load_registry(x.F_OLD).select(*_REG_COLS.split(", "), "kind")


@query(
    "s13_read_source_auto",
    f"""WITH t AS (SELECT * FROM F_NEW WHERE NOT (tenant_id = 't1' AND db_id = 2) AND tenant_id <> 't5') SELECT {_REG_COLS}, validator FROM t
 UNION ALL SELECT {_REG_COLS}, validator FROM F_OLD o WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.tenant_id = o.tenant_id AND t.db_id = o.db_id)""",
)
def _(x):
    target = x.F_NEW.where("not (tenant_id = 't1' and db_id = 2) and tenant_id <> 't5'")
    return registry.list_fields(target, x.F_OLD).select(*_REG_COLS.split(", "), "validator")


@query(
    "s14_read_registry_docs",
    """SELECT doc_id, 't' || doc_id AS table_name, 'email' AS column_name, 'varchar(255)' AS data_type, 'email' AS validator, 'text' AS widget,
  CASE WHEN doc_id % 2 = 0 THEN 'p' END AS placeholder_key, false AS has_default FROM F_REG
 UNION ALL SELECT doc_id, 't' || doc_id, 'rating', 'int', '', CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'text' END, NULL, false FROM F_REG""",
)
def _(x):
    df = registry.read_registry_docs(x.F_REG, keep=("doc_id",))
    return df.select("doc_id", "table_name", "column_name", "data_type", "validator", "widget", "placeholder_key", "has_default")


@query("s15_export_registry", f"SELECT {_REG_COLS}, '0.3' AS version FROM F_OLD WHERE tenant_id = 't2'")
def _(x):
    return registry.export_registry(x.F_OLD, "t2")


@query("s15_export_registry_full", f"SELECT {_REG_COLS}, validator, is_nullable, is_unique, CASE WHEN has_default THEN coalesce(default_value, '') END AS default_value, '0.3' AS version FROM F_OLD")
def _(x):
    return registry.export_registry(x.F_OLD, full=True).withColumn("default_value", F.col("default.value")).drop("default")


@query("s16_export_files", f"SELECT {_REG_COLS}, '0.3' AS version FROM F_OLD")
def _(x):
    path = registry.export_files(x.F_OLD, scratch_path(x.spark, "export"), "20240102T030405", full=False)
    return x.spark.read.schema("tenant_id string, db_id bigint, table_name string, column_name string, data_type string, version string").json(path)


_WIDGET_JSON = """SELECT '{"id":"' || CASE WHEN p_partkey % 9 = 0 THEN 'same' ELSE 'w' || CAST(p_partkey AS STRING) END || '","name":"' || CASE WHEN p_partkey % 7 = 1 THEN '' ELSE 'n' END
 || '","version":"1.0.' || CAST(p_size AS STRING) || '","type":"widget"' || CASE WHEN p_partkey % 2 = 0 THEN ',"scopes":["tenant"]' ELSE '' END || '}' AS value,
 CASE WHEN p_partkey % 5 = 0 THEN '.hidden.json' WHEN p_partkey % 5 = 1 THEN 'w' || CAST(p_partkey AS STRING) || '.json~' ELSE 'w' || CAST(p_partkey AS STRING) || '.json' END AS file FROM part"""


@query(
    "s17_parse_widgets",
    f"""SELECT file, json_extract_string(value, '$.id') AS id, CASE WHEN json_extract(value, '$.scopes') IS NULL THEN 'system' ELSE 'tenant' END AS scopes,
 CASE WHEN json_extract_string(value, '$.name') = '' THEN 'invalid widget: id, name, type required' END AS error FROM ({_WIDGET_JSON}) w WHERE NOT starts_with(file, '.') AND NOT ends_with(file, '~')""",
)
def _(x):
    x.part.createOrReplaceTempView("part")
    rows = targets.parse_widgets(x.spark.sql(_WIDGET_JSON))
    return rows.select("file", "id", joined("scopes").alias("scopes"), "error")


def write_widget_files(rows):
    """One JSON widget file per key (the first column), named by it, with a line for each row; returns the folder.

    Tasks write their files themselves: Spark's writer takes a folder, a copy under another name and a move for each, 33 ms a file.
    """
    spark, key = rows.sparkSession, rows.columns[0]
    path = scratch_path(spark, "folder")
    folder = path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path)
    name = F.coalesce(F.col(key).cast("string"), F.lit("none")).alias("name")
    line = F.to_json(F.struct("id", F.lit("n").alias("name"), F.lit("widget").alias("type"))).alias("line")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        lines = ((n, x) for batch in batches for n, x in zip(*(batch.column(c).to_pylist() for c in ("name", "line"))))
        files = 0
        for file, own in groupby(lines, itemgetter(0)):
            with store.open_output_stream(f"{root}/{file}.json") as sink:
                for _, x in own:
                    sink.write(x.encode() + b"\n")
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    # A given number of parts, which Spark does not merge because the rows are small: a file costs far more than its row.
    parts = 4 * spark.sparkContext.defaultParallelism
    placed = rows.select(name, line).repartition(parts, "name").sortWithinPartitions("name")
    placed.mapInArrow(write, "files bigint").agg(F.sum("files")).collect()
    return path


@query(
    "s17_load_widgets",
    """SELECT 'w' || s_suppkey AS id, 'system' AS scopes, CAST(NULL AS VARCHAR) AS error FROM supplier WHERE s_suppkey % 9 <> 0 UNION ALL SELECT 'same', NULL, 'duplicate widget id same' FROM supplier WHERE s_suppkey % 9 = 0""",
)
def _(x):
    name = F.when(F.col("s_suppkey") % 9 == 0, F.lit("same")).otherwise(F.concat(F.lit("w"), F.col("s_suppkey").cast("string")))
    widgets, errors = targets.load_widgets(x.spark, write_widget_files(x.supplier.select("s_suppkey", name.alias("id"))))
    ok = widgets.select("id", joined("scopes").alias("scopes"), F.lit(None).cast("string").alias("error"))
    return ok.unionByName(errors.select("id", F.lit(None).cast("string").alias("scopes"), "error"))


_LABEL_ROWS = """SELECT s_suppkey, 'db:' || CAST(s_suppkey AS STRING) AS tkey, c.l AS label FROM supplier CROSS JOIN (VALUES ('b=2'), ('a=1'), ('zone')) AS c(l)
 WHERE NOT (c.l = 'zone' AND s_suppkey % 2 = 0) AND s_suppkey % 10 <> 3"""


@query(
    "s18_load_targets",
    f"""SELECT t.tkey, t.driver, coalesce(string_agg(l.label, ',' ORDER BY l.label), '') AS labels, t.is_default FROM F_TGT t LEFT JOIN ({_LABEL_ROWS}) l ON l.tkey = t.tkey
 GROUP BY t.tkey, t.driver, t.is_default""",
)
def _(x):
    x.supplier.createOrReplaceTempView("supplier")
    labels = x.spark.sql(_LABEL_ROWS).drop("s_suppkey")
    return targets.load_targets(x.F_TGT.drop("labels"), labels).withColumn("labels", joined("labels"))


@query("s18_default_target", "SELECT min(tkey) AS tkey FROM F_TGT WHERE is_default HAVING count(*) > 0 UNION ALL SELECT 'none' WHERE NOT EXISTS (SELECT 1 FROM F_TGT WHERE is_default)")
def _(x):
    found = targets.default_target(x.F_TGT)
    return found.unionByName(x.F_TGT.agg(F.bool_or("is_default").alias("d")).where("not d").select(F.lit("none").alias("tkey")))


_DATABASES = """SELECT CAST(n_nationkey AS BIGINT) AS id, 't' || CAST(n_regionkey AS STRING) AS tenant_id, n_name AS name FROM nation"""


@query("s19_list_databases", f"SELECT id, tenant_id, name FROM ({_DATABASES}) d WHERE tenant_id = 't2'")
def _(x):
    x.nation.createOrReplaceTempView("nation")
    return cat.list_databases(x.spark.sql(_DATABASES), "t2")
