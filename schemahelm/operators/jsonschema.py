"""Collection validators (JSON Schema) from registry fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemahelm.functions import typing as ty
from schemahelm.schemas import FIELD_KEY


def _extras(fields: DataFrame) -> Column:
    return F.col("driver_extras") if "driver_extras" in fields.columns else F.lit(None).cast("string")


def schema_properties(fields: DataFrame, keep: Sequence[str] = ("table_name",)) -> DataFrame:
    """One row per field: the JSON of its property and whether the member is required."""
    extras = _extras(fields)
    physical = F.col("physical_type") if "physical_type" in fields.columns else F.lit("")
    parts = fields.select(
        *keep,
        "column_name",
        ty.bson_type(physical, "data_type").alias("_bson"),
        ty.array_item_type(extras).alias("_item"),
        (F.col("is_nullable") | ty.extra_bool(extras, "allowNull")).alias("_null"),
        (~F.col("is_nullable") | ty.extra_bool(extras, "required")).alias("required"),
    )
    quoted = F.concat(F.lit('"'), "_bson", F.lit('"'))
    declared = F.when(F.col("_null"), F.concat(F.lit("["), quoted, F.lit(',"null"]'))).otherwise(quoted)
    has_items = (F.col("_bson") == "array") & F.col("_item").isNotNull()
    items = F.when(has_items, F.concat(F.lit(',"items":{"bsonType":"'), "_item", F.lit('"}'))).otherwise(F.lit(""))
    prop = F.concat(F.lit('{"bsonType":'), declared, items, F.lit("}"))
    return parts.select(*keep, "column_name", prop.alias("property"), "required")


def build_jsonschema(fields: DataFrame, keep: Sequence[str] = FIELD_KEY[:3]) -> DataFrame:
    """Validator document per collection: its properties and required members, sorted by name.

    ``keep`` identifies a collection (by default tenant, database and table). The document is one text and has to hold all
    members of its collection; :func:`schema_properties` gives the same as rows, without that bound.
    """
    keep = list(keep)
    name = F.to_json(F.array("column_name"))
    name = F.substring(name, F.lit(2), F.length(name) - 2)
    entry = F.concat(name, F.lit(":"), F.col("property"))
    grouped = schema_properties(fields, keep).groupBy(*keep).agg(
        F.array_sort(F.collect_set(F.struct(F.col("column_name").alias("k"), entry.alias("e")))).alias("_props"),
        F.array_sort(F.collect_set(F.when(F.col("required"), name))).alias("_req"),
    )
    props = F.array_join(F.transform("_props", lambda x: x["e"]), ",")
    required = F.when(F.size("_req") > 0, F.concat(F.lit(',"required":['), F.array_join("_req", ","), F.lit("]"))).otherwise(F.lit(""))
    doc = F.concat(F.lit('{"$jsonSchema":{"bsonType":"object","properties":{'), props, F.lit("}"), required, F.lit("}}"))
    return grouped.select(*keep, doc.alias("validator"))
