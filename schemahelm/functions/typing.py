"""Type and identifier normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------
# SQL type name -> logical kind
SQL_KINDS = {
    "string": ["varchar", "character varying", "text", "char", "character", "uuid", "bpchar"],
    "integer": ["int", "integer", "int4", "int2", "smallint", "mediumint", "bigint", "int8"],
    "decimal": ["decimal", "numeric", "number"],
    "number": ["double", "double precision", "float", "float4", "float8", "real"],
    "datetime": [
        "date", "datetime", "timestamp", "timestamp without time zone", "timestamp with time zone",
        "time", "time without time zone", "time with time zone",
    ],
    "object": ["json", "jsonb"],
    "binary": ["bytea", "blob", "binary", "varbinary"],
    "boolean": ["boolean", "bool"],
}

# BSON type name -> logical kind
MONGO_KINDS = {
    "string": ["string"],
    "integer": ["int", "int32", "long", "int64"],
    "number": ["double"],
    "decimal": ["decimal", "decimal128"],
    "boolean": ["bool", "boolean"],
    "datetime": ["date", "timestamp"],
    "object": ["object"],
    "array": ["array"],
    "objectId": ["objectid"],
    "binary": ["binary"],
    "uuid": ["uuid"],
    "regex": ["regex", "regular expression"],
}

# physical type -> BSON type written into a collection validator
BSON_TYPES = {
    "string": ["varchar", "string"],
    "regex": ["regex"],
    "binData": ["binary"],
    "int": ["int", "int32", "integer"],
    "long": ["long", "int64"],
    "double": ["double", "number", "float", "float64"],
    "decimal": ["decimal", "decimal128"],
    "bool": ["bool", "boolean"],
    "date": ["date", "datetime"],
    "timestamp": ["timestamp"],
    "object": ["object", "document"],
    "array": ["array"],
    "objectId": ["objectid"],
}

# validator document type -> scanned type
SCHEMA_TYPES = {
    "double": ["double"],
    "string": ["string"],
    "bool": ["bool", "boolean"],
    "int": ["int", "int32"],
    "long": ["long", "int64"],
    "decimal": ["decimal", "decimal128"],
    "date": ["date"],
}

# shorthand widget name -> widget id
WIDGET_NAMES = {
    "plugin://text-input": ["text", "textinput", "text-input"],
    "plugin://number-input": ["number", "number-input", "numeric"],
    "plugin://textarea": ["textarea"],
    "plugin://checkbox": ["checkbox", "bool"],
    "plugin://date-input": ["date", "date-input"],
    "plugin://time-input": ["time", "time-input"],
    "plugin://datetime-input": ["datetime", "datetime-input"],
    "plugin://json-editor": ["json", "json-editor"],
    "plugin://select": ["select"],
    "plugin://multiselect": ["multiselect"],
    "plugin://password-input": ["password", "password-input"],
    "plugin://email-input": ["email", "email-input"],
    "plugin://url-input": ["url", "url-input"],
    "plugin://uuid-input": ["uuid", "uuid-input"],
}
# --- end of fixed values ----------------------------------------------------------------------------------


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(value: Column, table: dict[str, list[str]], default: Column) -> Column:
    """Reverse lookup in a small table, compiled to one CASE (stays in generated code)."""
    branches = [(value.isin(names), F.lit(result)) for result, names in table.items()]
    expr = F.when(*branches[0])
    for cond, result in branches[1:]:
        expr = expr.when(cond, result)
    return expr.otherwise(default)


def let(value: Column, fn) -> Column:
    """Bind a value that ``fn`` uses several times, so that it is computed once per row."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def folded(c: Column | str) -> Column:
    return F.lower(F.trim(col_of(c)))


def blank(c: Column | str) -> Column:
    """NULL or only spaces."""
    return F.coalesce(F.trim(col_of(c)), F.lit("")) == ""


def sql_kind(data_type: Column | str, strip: bool = False) -> Column:
    """Logical kind of a SQL type; ``strip`` ignores a ``(length)`` suffix, which otherwise makes it ``any``."""
    name = parse_type(data_type)["base"] if strip else folded(data_type)
    return lookup(name, SQL_KINDS, F.lit("any"))


def mongo_kind(data_type: Column | str) -> Column:
    return lookup(folded(data_type), MONGO_KINDS, F.lit("any"))


def guess_kind(store: Column | str, data_type: Column | str) -> Column:
    return F.when(folded(store) == "mongo", mongo_kind(data_type)).otherwise(sql_kind(data_type))


def store_kind(driver: Column | str) -> Column:
    return F.when(folded(driver).isin("mongo", "mongodb"), F.lit("mongo")).otherwise(F.lit("sql"))


def physical_type(driver: Column | str, data_type: Column | str, store: Column | str | None = None) -> Column:
    """``driver:type`` for SQL stores, ``mongodb:type`` for document stores."""
    drv, typ = folded(driver), folded(data_type)
    sql = F.when(drv == "", typ).otherwise(F.concat(drv, F.lit(":"), typ))
    kind = folded(store) if store is not None else store_kind(driver)
    raw = F.trim(col_of(data_type))
    mongo = F.concat(F.lit("mongodb:"), F.when(raw == "", F.lit("any")).otherwise(raw))
    return F.when(kind == "mongo", mongo).otherwise(sql)


def normalize_ddl_type(driver: Column | str, data_type: Column | str) -> Column:
    typ = col_of(data_type)
    return F.when((col_of(driver) == "mysql") & (folded(typ) == "varchar"), F.lit("VARCHAR(255)")).otherwise(typ)


def parse_type(data_type: Column | str) -> Column:
    """Split type text into ``struct(base, length, enums)``."""
    s = folded(data_type)
    has_args = s.contains("(") & s.endswith(")")
    base = F.when(has_args, F.substring_index(s, "(", 1)).otherwise(s)
    inner = F.regexp_extract(s, r"^[^(]*\((.*)\)$", 1)
    listed = has_args & base.isin("enum", "set")
    enums = F.when(listed, F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]+|['\"]+$", "")))
    first = F.trim(F.substring_index(inner, ",", 1))
    length = F.when(has_args & ~base.isin("enum", "set") & first.rlike(r"^[+-]?[0-9]+$"), first.try_cast("int"))
    return F.struct(base.alias("base"), length.alias("length"), enums.alias("enums"))


def policy_type(driver: Column | str, base: Column | str, length: Column | str) -> Column:
    """Type name as the widget rules see it."""
    t = folded(base)
    t = F.when(F.instr(t, "(") > 1, F.substring_index(t, "(", 1)).otherwise(t)
    mysql = col_of(driver) == "mysql"
    return (
        F.when(mysql & (t == "tinyint") & F.coalesce(col_of(length) == 1, F.lit(False)), F.lit("boolean"))
        .when(mysql & (t == "timestamp"), F.lit("datetime"))
        .otherwise(t)
    )


def norm_validator(validator: Column | str) -> Column:
    return F.coalesce(F.nullif(folded(validator), F.lit("")), F.lit("none"))


def norm_db_id(db_id: Column | str) -> Column:
    return F.when(col_of(db_id) == 0, F.lit(1).cast("bigint")).otherwise(col_of(db_id).cast("bigint"))


def canon_widget(raw: Column | str) -> Column:
    """Fully qualified widget id: shorthand names first, then the legacy ``core://`` ids."""
    s = F.coalesce(folded(raw), F.lit(""))
    full = (
        F.when(s == "", F.lit("core://auto"))
        .when(s.contains("://"), s)
        .otherwise(lookup(s, WIDGET_NAMES, F.concat(F.lit("plugin://"), s)))
    )
    return (
        F.when(full.isin("core://default", "core://auto"), F.lit("core://auto"))
        .when(full == "core://text-input", F.lit("plugin://text-input"))
        .when(full == "core://date-input", F.lit("plugin://date-input"))
        .otherwise(full)
    )


# --- dynamic extras (JSON text) ---------------------------------------------------------------------------


def _extra(extras: Column | str, key: str, read) -> Column:
    """``read(value, type name)`` of one member; the text is parsed once, and rows without extras skip it."""
    text = col_of(extras)
    value = F.try_variant_get(F.try_parse_json(text), f"$.{key}", "variant")
    typed = F.struct(value.alias("v"), F.schema_of_variant(value).alias("t"))
    return F.when(text.contains(f'"{key}"'), let(typed, lambda x: read(x["v"], x["t"])))


def extra_bool(extras: Column | str, key: str) -> Column:
    """JSON ``true``, or the texts ``true`` (any case) and ``1``; everything else is false."""

    def read(value: Column, kind: Column) -> Column:
        text = F.try_variant_get(value, "$", "string")
        return F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).when(
            kind == "STRING", (F.lower(text) == "true") | (text == "1")
        )

    return F.coalesce(_extra(extras, key, read), F.lit(False))


def extra_int32(extras: Column | str, key: str) -> Column:
    """Whole number in the 32-bit range from a JSON number or decimal text, else NULL."""

    def read(value: Column, kind: Column) -> Column:
        text = F.try_variant_get(value, "$", "string")
        number = F.try_variant_get(value, "$", "double")
        in_range = (number >= -2147483648.0) & (number <= 2147483647.0) & (F.floor(number) == number)
        numeric = kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT")
        return F.when(numeric & in_range, number.try_cast("int")).when(
            (kind == "STRING") & text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int")
        )

    return _extra(extras, key, read)


def bson_type(physical: Column | str, data_type: Column | str | None = None) -> Column:
    """BSON type of a field from its physical type, falling back to its data type."""
    pt = F.coalesce(folded(physical), F.lit(""))
    pt = F.regexp_replace(pt, "^mongodb:", "")
    if data_type is not None:
        pt = F.when(pt == "", F.coalesce(folded(data_type), F.lit(""))).otherwise(pt)
    return lookup(pt, BSON_TYPES, F.lit("string"))


def array_item_type(extras: Column | str) -> Column:
    """BSON type of the items of an array field, from ``extras.array_items``; NULL when not declared."""

    def read(items: Column, _: Column) -> Column:
        def named(member: str) -> Column:
            value = F.try_variant_get(items, f"$.{member}", "variant")
            return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))

        return F.coalesce(named("physical_type"), named("kind"))

    return let(_extra(extras, "array_items", read), lambda name: F.when(name.isNotNull(), bson_type(name)))


def nullable_bson_type(fields_nullable: Column | str, extras: Column | str, bson: Column) -> Column:
    """``[type, null]`` when the field may be null."""
    may_be_null = col_of(fields_nullable) | extra_bool(extras, "allowNull")
    return F.when(may_be_null, F.array(bson, F.lit("null"))).otherwise(F.array(bson))
