"""Canonical schemas of the registry tables."""

from __future__ import annotations

from pyspark.sql import types as T

FIELDS = T.StructType(
    [
        T.StructField("tenant_id", T.StringType(), False),
        T.StructField("db_id", T.LongType(), False),
        T.StructField("table_name", T.StringType(), False),
        T.StructField("column_name", T.StringType(), False),
        T.StructField("data_type", T.StringType(), False),
        T.StructField("store_kind", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("physical_type", T.StringType()),
        T.StructField("driver_extras", T.StringType()),
        T.StructField("label_key", T.StringType()),
        T.StructField("widget", T.StringType()),
        T.StructField("widget_config", T.StringType()),
        T.StructField("placeholder_key", T.StringType()),
        T.StructField("is_nullable", T.BooleanType(), False),
        T.StructField("is_unique", T.BooleanType(), False),
        T.StructField("has_default", T.BooleanType(), False),
        T.StructField("default_value", T.StringType()),
        T.StructField("validator", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

AUDIT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("tenant_id", T.StringType(), False),
        T.StructField("actor", T.StringType(), False),
        T.StructField("action", T.StringType(), False),
        T.StructField("table_name", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("before_json", T.StringType()),
        T.StructField("after_json", T.StringType()),
        T.StructField("added_count", T.LongType(), False),
        T.StructField("removed_count", T.LongType(), False),
        T.StructField("change_count", T.LongType(), False),
        T.StructField("applied_at", T.TimestampNTZType()),
    ]
)

WIDGET = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("scopes", T.ArrayType(T.StringType())),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("description", T.StringType()),
        T.StructField("capabilities", T.ArrayType(T.StringType())),
        T.StructField("homepage", T.StringType()),
        T.StructField("meta", T.StringType()),
        T.StructField("tenants", T.ArrayType(T.StringType())),
    ]
)

# Key of a field row, and the identity used when two registries are compared.
FIELD_KEY = ("tenant_id", "db_id", "table_name", "column_name")
DIFF_KEY = ("tenant_id", "table_name", "column_name")

# Attributes that make a field "updated" in a drift report.
DIFF_ATTRIBUTES = ("data_type", "validator", "is_nullable", "is_unique", "has_default", "default_value")

# Bookkeeping, no part of a definition.
STAMPS = ("created_at", "updated_at")

# Prefix of the registry's own tables; every operator that needs it takes it as a parameter.
DEFAULT_PREFIX = "meta_"
DEFAULT_TENANT = "default"
