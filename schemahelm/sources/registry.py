"""Registry tables as sources and sinks: load, read-source choice, document ingest, export, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemahelm.functions import typing as ty

REGISTRY_VERSION = "0.3"


def load_registry(fields: DataFrame, tenant: str | None = None, db_id: int | None = None, table: str | None = None, driver: str = "postgres") -> DataFrame:
    """Registry rows with store kind, kind and physical type filled in where blank.

    The filters sit directly on the source, so a table partitioned by tenant reads only its partitions.
    """
    df = fields
    if tenant is not None:
        df = df.where(F.col("tenant_id") == tenant)
    if db_id is not None:
        df = df.where(F.col("db_id") == db_id)
    if table is not None:
        df = df.where(F.col("table_name") == table)
    return backfill_kinds(df, driver)


def backfill_kinds(fields: DataFrame, driver: str = "") -> DataFrame:
    """Fill blank ``store_kind``, ``kind`` and ``physical_type``; present values stay."""
    have = fields.columns
    present = lambda name: F.nullif(F.trim(F.col(name)), F.lit("")) if name in have else F.lit(None).cast("string")
    store = F.coalesce(present("store_kind"), ty.store_kind(F.lit(driver)))
    df = fields.withColumn("store_kind", store)
    kind = F.coalesce(present("kind"), ty.guess_kind("store_kind", "data_type"))
    physical = F.coalesce(present("physical_type"), ty.physical_type(F.lit(driver), "data_type", "store_kind"))
    return df.withColumn("kind", kind).withColumn("physical_type", physical)


def list_fields(target: DataFrame, meta: DataFrame, source: str = "auto", db_key: tuple[str, ...] = ("tenant_id", "db_id")) -> DataFrame:
    """Fields from the target databases, the metadata store, or ``auto``: databases whose target is empty
    fall back to the metadata store."""
    if source == "target":
        return target
    if source == "meta":
        return meta
    if source != "auto":
        raise ValueError(f"unknown read source: {source}")
    answered = target.select(*db_key).distinct()
    return target.unionByName(meta.join(answered, list(db_key), "left_anti"), allowMissingColumns=True)


_DOC = (
    "struct<version: string, fields: array<struct<table: string, `column`: string, type: string, "
    "placeholder: string, validator: string, nullable: boolean, `unique`: boolean, default: variant, "
    "display: struct<labelKey: string, widget: string, placeholderKey: string, widgetConfig: variant>>>>"
)


def read_registry_docs(docs: DataFrame, json_col: str = "doc", keep: tuple[str, ...] = ()) -> DataFrame:
    """Field rows of many registry documents, upgraded to the current version.

    Version 0.1 (or none): a placeholder becomes a text widget. 0.2: a default is a plain non-empty text.
    0.3: a default is a scalar or ``{enabled, value}``, and a missing widget is ``text``.
    """
    rows = docs.select(*keep, F.from_json(json_col, _DOC).alias("_d"))
    rows = rows.select(*keep, F.coalesce("_d.version", F.lit("")).alias("_v"), F.explode("_d.fields").alias("_f"))
    v1, v2 = F.col("_v").isin("", "0.1"), F.col("_v") == "0.2"
    f = F.col("_f")
    default = f["default"]
    kind = F.schema_of_variant(default)
    structured = kind.startswith("OBJECT<")
    scalar = default.isNotNull() & (kind != "VOID") & ~structured & ~kind.startswith("ARRAY")
    text = F.try_variant_get(default, "$", "string")
    enabled = F.when(structured, F.coalesce(F.try_variant_get(default, "$.enabled", "boolean"), F.lit(False))).otherwise(scalar)
    value = F.when(structured, F.coalesce(F.try_variant_get(default, "$.value", "string"), F.lit(""))).otherwise(text)
    has_default = F.when(v1, F.lit(False)).when(v2, F.coalesce(text, F.lit("")) != "").otherwise(F.coalesce(enabled, F.lit(False)))
    placeholder = F.nullif(f["placeholder"], F.lit(""))
    shown = f["display"]
    widget = (
        F.when(v1, F.when(placeholder.isNotNull(), F.lit("text")))
        .when(v2, shown["widget"])
        .otherwise(F.coalesce(F.nullif(shown["widget"], F.lit("")), F.lit("text")))
    )
    flag = lambda name: F.when(v1, F.lit(False)).otherwise(F.coalesce(f[name], F.lit(False)))
    return rows.select(
        *keep,
        f["table"].alias("table_name"),
        f["column"].alias("column_name"),
        f["type"].alias("data_type"),
        F.coalesce(f["validator"], F.lit("")).alias("validator"),
        flag("nullable").alias("is_nullable"),
        flag("unique").alias("is_unique"),
        has_default.alias("has_default"),
        F.when(has_default, F.when(v2, text).otherwise(value)).alias("default_value"),
        F.when(~v1, shown["labelKey"]).alias("label_key"),
        widget.alias("widget"),
        F.when(v1, placeholder).otherwise(shown["placeholderKey"]).alias("placeholder_key"),
        F.when(~v1, F.to_json(shown["widgetConfig"])).alias("widget_config"),
        F.lit(REGISTRY_VERSION).alias("version"),
    )


def export_registry(fields: DataFrame, tenant: str | None = None, full: bool = False) -> DataFrame:
    """Registry export rows, ordered by database, table and column."""
    df = fields if tenant is None else fields.where(F.col("tenant_id") == tenant)
    columns = ["tenant_id", "db_id", "table_name", "column_name", "data_type"]
    if full:
        extra = ["validator", "is_nullable", "is_unique", "widget", "label_key", "placeholder_key", "widget_config"]
        columns += [c for c in extra if c in fields.columns]
        default = F.when(
            F.col("has_default"), F.struct(F.lit(True).alias("enabled"), F.coalesce("default_value", F.lit("")).alias("value"))
        )
        df = df.select(*columns, default.alias("default"))
    else:
        df = df.select(*columns)
    return df.withColumn("version", F.lit(REGISTRY_VERSION))


def export_files(fields: DataFrame, path: str, run_ts: str, full: bool = True, format: str = "json") -> str:
    """Write one export under ``path/run_ts`` on any Hadoop file system, a folder per tenant; never overwrites.

    Rows are range-partitioned and sorted within files, so a tenant with most rows spreads over many files.
    """
    target = f"{path.rstrip('/')}/snapshot_{run_ts}"
    order = ["tenant_id", "db_id", "table_name", "column_name"]
    rows = export_registry(fields, full=full).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode("errorifexists").partitionBy("tenant_id").format(format).save(target)
    return target
