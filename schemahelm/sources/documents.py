"""Field rows of document stores: inferred from JSON documents, or read from JSON-Schema validators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemahelm.functions import typing as ty

_MEMBERS = "map<string,variant>"


def member_type(value: Column) -> Column:
    """Document type of a JSON value: integers by width, extended-JSON wrappers by their tag."""
    kind = F.schema_of_variant(value)
    small = F.try_variant_get(value, "$", "int").isNotNull()
    return (
        F.when(kind == "STRING", F.lit("string"))
        .when(kind == "BOOLEAN", F.lit("bool"))
        .when(kind == "BIGINT", F.when(small, F.lit("int")).otherwise(F.lit("long")))
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), F.lit("double"))
        .when(kind.rlike(r"^OBJECT<`?\$date"), F.lit("date"))
        .when(kind.rlike(r"^OBJECT<`?\$numberDecimal"), F.lit("decimal"))
        .when(kind.rlike(r"^OBJECT<`?\$numberLong"), F.lit("long"))
        .otherwise(F.lit("string"))
    )


def infer_document_schema(docs: DataFrame, collection_col: str = "collection", json_col: str = "doc", by: Sequence[str] = ()) -> DataFrame:
    """One field row per (collection, member): its only type, or ``string`` when several occur.

    Reads all documents once: beside its members every document gives a nameless one, whose count is that of the
    collection's documents. Counts are folded map-side, so a collection that holds most documents sends a handful
    of rows per task. A member is nullable when some document lacks it.
    """
    key = [*by, collection_col]
    members = F.coalesce(F.map_entries(F.from_json(json_col, _MEMBERS)), F.array().cast("array<struct<key:string,value:variant>>"))
    each = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("variant").alias("value"))), members)
    rows = docs.select(*key, F.explode(each).alias("_m")).select(*key, F.col("_m.key").alias("column_name"), F.col("_m.value").alias("_value"))
    typed = rows.select(*key, "column_name", F.when(F.col("column_name").isNotNull(), member_type(F.col("_value"))).alias("_type"))
    per_type = typed.groupBy(*key, "column_name", "_type").agg(F.count(F.lit(1)).alias("_n"))
    fields = per_type.groupBy(*key, "column_name").agg(
        F.count(F.lit(1)).alias("_types"), F.min("_type").alias("_only"), F.sum("_n").alias("_present")
    )
    # The distinct members of a collection.
    whole = Window.partitionBy(*key)
    fields = fields.withColumn("_docs", F.max(F.when(F.col("column_name").isNull(), F.col("_present"))).over(whole))
    data_type = F.when(F.col("_types") == 1, F.col("_only")).otherwise(F.lit("string"))
    return fields.where(F.col("column_name").isNotNull()).select(
        *by,
        F.col(collection_col).alias("table_name"),
        "column_name",
        data_type.alias("data_type"),
        F.lit("mongo").alias("store_kind"),
        ty.mongo_kind(data_type).alias("kind"),
        F.concat(F.lit("mongodb:"), data_type).alias("physical_type"),
        (F.col("_present") < F.col("_docs")).alias("is_nullable"),
        F.lit(False).alias("is_unique"),
        F.lit(False).alias("has_default"),
    )


def fields_from_jsonschema(validators: DataFrame, collection_col: str = "collection", json_col: str = "validator", by: Sequence[str] = ()) -> DataFrame:
    """Field rows from collection validators: properties, required members, defaults."""
    schema = "struct<properties: map<string,variant>, required: array<string>>"
    parsed = validators.select(*by, F.col(collection_col).alias("table_name"), F.from_json(json_col, schema).alias("_s"))
    props = parsed.select(
        *by,
        "table_name",
        F.coalesce(F.col("_s.required"), F.array().cast("array<string>")).alias("_required"),
        F.explode("_s.properties").alias("column_name", "_p"),
    )
    declared = F.try_variant_get("_p", "$.bsonType", "variant")
    listed = F.try_variant_get(declared, "$", "array<string>")
    name = F.when(F.schema_of_variant(declared) == "STRING", F.try_variant_get(declared, "$", "string")).when(
        F.size(listed) == 1, F.get(listed, F.lit(0))
    )
    data_type = ty.lookup(F.coalesce(name, F.lit("")), ty.SCHEMA_TYPES, F.lit("string"))
    default = F.try_variant_get("_p", "$.default", "string")
    has_default = F.try_variant_get("_p", "$.default", "variant").isNotNull()
    return props.select(
        *by,
        "table_name",
        "column_name",
        data_type.alias("data_type"),
        F.lit("mongo").alias("store_kind"),
        ty.mongo_kind(data_type).alias("kind"),
        F.concat(F.lit("mongodb:"), data_type).alias("physical_type"),
        (~F.array_contains("_required", F.col("column_name"))).alias("is_nullable"),
        F.lit(False).alias("is_unique"),
        has_default.alias("has_default"),
        default.alias("default_value"),
    )
