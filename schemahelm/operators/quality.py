"""Validators, row validation by registry rules, and lint checks over the registry itself."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemahelm.functions import typing as ty
from schemahelm.schemas import FIELD_KEY
from schemahelm.sources.catalog import is_reserved

# --- fixed values -----------------------------------------------------------------------------------------
# validator -> column types it applies to
VALIDATOR_TYPES = {
    "none": ["*"],
    "email": ["varchar", "text"],
    "number": ["int", "bigint", "decimal", "float", "double"],
    "uuid": ["uuid", "varchar"],
    "regex": ["varchar", "text"],
}
ROLE_NAME = "^[a-z0-9_-]{1,64}$"
USER_NAME = "^[a-zA-Z0-9._-]+$"
LABEL = r"^[a-zA-Z0-9._\-:/]{1,63}=[a-zA-Z0-9._\-:/]{1,63}$"
IDENTIFIER = "^[A-Za-z0-9_.]+$"
POLICY_METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE"]
# --- end of fixed values ----------------------------------------------------------------------------------

EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

Validator = Callable[[Column, dict], Column]
_VALIDATORS: dict[str, Validator] = {}


class ValidatorExists(ValueError):
    """A validator of that name is registered already."""


def register_validator(name: str, check: Validator) -> None:
    """Add a validator: ``check(column, params)`` gives a boolean column that is true for valid values.

    The check may be a built-in expression or a vectorised ``pandas_udf`` applied to the column.
    """
    if name in _VALIDATORS:
        raise ValidatorExists(f"validator already registered: {name}")
    _VALIDATORS[name] = check


def get_validator(name: str) -> Validator | None:
    return _VALIDATORS.get(name)


def registered_validators() -> list[str]:
    return sorted(_VALIDATORS)


register_validator("none", lambda c, p: F.lit(True))
register_validator("email", lambda c, p: c.cast("string").rlike(EMAIL))
register_validator("number", lambda c, p: c.try_cast("double").isNotNull())
register_validator("uuid", lambda c, p: c.cast("string").rlike(UUID))
register_validator("regex", lambda c, p: c.cast("string").rlike(p.get("pattern", "^.*$")))
register_validator("uppercase", lambda c, p: c.cast("string") == F.upper(c.cast("string")))


# --- rows against rules -----------------------------------------------------------------------------------


def rules_for(fields: DataFrame, table: str, columns: Sequence[str], tenant: str | None = None, db_id: int | None = None) -> list[dict]:
    """Registry rules of one data table, as driver-side configuration: one rule per column.

    ``tenant`` and ``db_id`` choose among equal table names. A column with several definitions left is an error, as
    either would be an arbitrary choice.
    """
    typ = ty.parse_type("data_type")
    opt = lambda c: F.col(c) if c in fields.columns else F.lit(None)
    rows = fields.where((F.col("table_name") == table) & F.col("column_name").isin(list(columns)))
    if tenant is not None:
        rows = rows.where(F.col("tenant_id") == tenant)
    if db_id is not None:
        rows = rows.where(F.col("db_id") == db_id)
    rule = F.struct(
        F.col("column_name").alias("column"),
        F.coalesce("validator", F.lit("")).alias("validator"),
        opt("validator_params").cast("string").alias("pattern"),
        F.col("is_nullable").alias("nullable"),
        F.col("is_unique").alias("unique"),
        typ["base"].alias("base"),
        typ["length"].alias("length"),
        typ["enums"].alias("enums"),
    )
    found = rows.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), F.first(rule).alias("rule")).collect()
    several = sorted(r["column_name"] for r in found if r["n"] > 1)
    if several:
        raise ValueError(f"several definitions of {table}: {', '.join(several)}; name the tenant and the database")
    return [r["rule"].asDict() for r in found]


# --- fixed values: type names that a text can be tested for by a cast
_CASTS = {
    "int": ["int", "integer", "int4", "smallint", "int2", "mediumint"],
    "bigint": ["bigint", "int8"],
    "double": ["double", "double precision", "float", "float4", "float8", "real"],
    "decimal(38,10)": ["decimal", "numeric", "number"],
    "date": ["date"],
    "timestamp": ["datetime", "timestamp"],
    "boolean": ["bool", "boolean"],
}


def _cast_type(base: str | None) -> str | None:
    return next((target for target, names in _CASTS.items() if base in names), None)


def _malformed(spark: SparkSession, patterns: Sequence[str]) -> set[str]:
    """Those of the rules' patterns that are no regular expressions: few, and tried on one empty text."""
    bad = set()
    for pattern in set(patterns):
        try:
            spark.range(1).select(F.lit("").rlike(pattern)).collect()
        except Exception as error:  # noqa: BLE001 - the kind of error depends on where the pattern is compiled
            if "regex" not in str(error).lower() and "PatternSyntax" not in str(error):
                raise
            bad.add(pattern)
    return bad


def _checks(df: DataFrame, rule: dict) -> list[tuple[str, Column]]:
    """(rule name, failing condition) of one column, apart from uniqueness."""
    c = F.col(rule["column"])
    present = c.isNotNull()
    checks: list[tuple[str, Column]] = []
    name = rule.get("validator") or ""
    check = get_validator(name) if name not in ("", "none") else None
    if check is not None:
        params = {"pattern": rule["pattern"]} if rule.get("pattern") else {}
        checks.append((name, present & ~F.coalesce(check(c, params), F.lit(False))))
    if rule.get("nullable") is False:
        checks.append(("not_null", c.isNull()))
    if rule.get("enums"):
        checks.append(("enum", present & ~F.lower(c.cast("string")).isin(rule["enums"])))
    if rule.get("length") and (rule.get("base") or "").endswith(("char", "character", "text", "character varying")):
        checks.append(("max_length", present & (F.length(c.cast("string")) > rule["length"])))
    target = _cast_type(rule.get("base"))
    if target and dict(df.dtypes)[rule["column"]] == "string":
        checks.append(("type", present & c.try_cast(target).isNull()))
    return checks


def validate_rows(data: DataFrame, rules: Sequence[dict], key: Sequence[str], table: str) -> DataFrame:
    """One row per violation: ``table_name``, the key as text, ``column_name``, ``rule``, ``value``.

    A rule is a dict with ``column`` and any of ``validator, pattern, nullable, unique, base, length, enums``
    (see :func:`rules_for`). All row rules are checked in one pass. All unique rules are one more: values are counted by
    column, and rows with a repeated one are looked up by (column, value). A rule whose pattern is no regular expression
    is a violation itself: one row with an empty key, the rule ``pattern`` and the pattern as its value.
    """
    bad = _malformed(data.sparkSession, [r["pattern"] for r in rules if r.get("pattern")])
    broken = [(r["column"], r["pattern"]) for r in rules if r.get("pattern") in bad]
    rules = [{**r, "validator": None} if r.get("pattern") in bad else r for r in rules]
    row_key = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    entries = []
    for rule in rules:
        for name, failing in _checks(data, rule):
            entries.append(
                F.when(
                    failing,
                    F.struct(
                        F.lit(rule["column"]).alias("column_name"),
                        F.lit(name).alias("rule"),
                        F.col(rule["column"]).cast("string").alias("value"),
                    ),
                )
            )
    out = []
    if entries:
        found = F.filter(F.array(*entries), lambda x: x.isNotNull())
        out.append(data.select(row_key.alias("row_key"), F.explode(found).alias("_v")).select("row_key", "_v.*"))
    unique = [r["column"] for r in rules if r.get("unique")]
    if unique:
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in unique])
        values = data.select(row_key.alias("row_key"), F.explode(pairs).alias("_v")).select("row_key", "_v.*").where("value IS NOT NULL")
        repeated = values.groupBy("column_name", "value").count().where("count > 1").select("column_name", "value")
        found = values.join(repeated, ["column_name", "value"], "left_semi")
        out.append(found.select("row_key", "column_name", F.lit("unique").alias("rule"), "value"))
    if broken:
        told = data.sparkSession.createDataFrame(broken, "column_name string, value string")
        out.append(told.select(F.lit("").alias("row_key"), "column_name", F.lit("pattern").alias("rule"), "value"))
    if not out:
        schema = "table_name string, row_key string, column_name string, rule string, value string"
        return data.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, out).select(F.lit(table).alias("table_name"), "row_key", "column_name", "rule", "value")


def violation_summary(violations: DataFrame, totals: DataFrame) -> DataFrame:
    """Violations per table, column and rule, with their share of the table's rows."""
    counted = violations.groupBy("table_name", "column_name", "rule").agg(F.count(F.lit(1)).alias("violations"))
    rate = F.round(F.col("violations") / F.col("row_count"), 6)
    return counted.join(totals, "table_name").select(
        "table_name", "column_name", "rule", "violations", "row_count", rate.alias("rate")
    )


# --- checks over the registry -----------------------------------------------------------------------------


def matches_table(table: Column, patterns: Sequence[str]) -> Column:
    """Exact names or ``prefix*``, ignoring case; no pattern matches every table."""
    if not patterns:
        return F.lit(True)
    t = F.lower(table)
    hits = [t.startswith(p.lower()[:-1]) if p.endswith("*") else t == p.lower() for p in patterns]
    return (table == "") | reduce(lambda a, b: a | b, hits)


def applicable_validators(fields: DataFrame, catalogue: dict[str, Sequence[str]] | None = None, tables: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Each field with every validator that fits its type and table (a row-local expansion, no join)."""
    fits = []
    for name, types in (catalogue or VALIDATOR_TYPES).items():
        typed = F.lit(True) if "*" in types else F.lower("data_type").isin([t.lower() for t in types])
        fits.append(F.when(typed & matches_table(F.col("table_name"), (tables or {}).get(name, ())), F.lit(name)))
    return fields.withColumn("validator_id", F.explode(F.array_compact(F.array(*fits))))


def lint_registry(fields: DataFrame, widgets: DataFrame | None = None, patterns: Sequence[str] | None = None, keys: Sequence[str] = FIELD_KEY) -> DataFrame:
    """Registry problems as rows ``key..., issue``: missing display, reserved table, unknown validator,
    unknown widget, duplicate key."""
    from schemahelm.operators.policy import BUILTIN_WIDGETS

    keys = list(keys)
    unknown = ~F.coalesce("validator", F.lit("")).isin("", *registered_validators())
    flags = [
        F.when(is_reserved("table_name", patterns), F.lit("reserved_table")),
        F.when(unknown, F.lit("unknown_validator")),
    ]
    if "widget" in fields.columns:
        flags.append(F.when(F.coalesce("widget", F.lit("")) == "", F.lit("missing_display")))
    issues = [fields.select(*keys, F.explode(F.array_compact(F.array(*flags))).alias("issue"))]
    if "widget" in fields.columns and widgets is not None:
        wanted = fields.where(F.coalesce("widget", F.lit("")) != "").select(*keys, "widget")
        plugin = F.lower(F.regexp_extract("widget", "^plugin://(.+)$", 1))
        wanted = wanted.where(F.col("widget") != "core://auto").withColumn("_w", plugin)
        open_ids = wanted.where(~F.col("_w").isin(BUILTIN_WIDGETS))
        known = widgets.select(F.lower("id").alias("_w")).distinct()
        issues.append(open_ids.join(known, "_w", "left_anti").select(*keys, F.lit("unknown_widget").alias("issue")))
    dup = fields.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("duplicate_key").alias("issue"))
    return reduce(DataFrame.unionByName, [*issues, dup])


def lint_entities(df: DataFrame, kind: str) -> DataFrame:
    """Name and form rules of access and routing entities; adds ``error`` (NULL when fine).

    Kinds and their columns: role ``name``; username ``username``; password ``password``; policy ``path,
    method``; label ``label``; dsn ``driver, dsn``; identifier ``name``.
    """
    c = F.col
    rules = {
        "role": lambda: F.when(~c("name").rlike(ROLE_NAME), F.lit("invalid role name")),
        "username": lambda: F.when(
            ~F.length("username").between(3, 64) | ~c("username").rlike(USER_NAME), F.lit("invalid username")
        ),
        "password": lambda: F.when(~F.length("password").between(8, 128), F.lit("invalid password")),
        "policy": lambda: F.when(~c("path").startswith("/") | (F.length("path") > 128), F.lit("invalid path")).when(
            ~c("method").isin(POLICY_METHODS), F.lit("invalid method")
        ),
        "label": lambda: F.when(~c("label").rlike(LABEL), F.lit("invalid label")),
        "dsn": lambda: _dsn_error(),
        "identifier": lambda: F.when(~c("name").rlike(IDENTIFIER), F.lit("invalid identifier")),
    }
    if kind not in rules:
        raise ValueError(f"unknown kind: {kind}")
    return df.withColumn("error", rules[kind]())


def _dsn_error() -> Column:
    driver, dsn = F.coalesce("driver", F.lit("")), F.coalesce("dsn", F.lit(""))
    scheme = F.regexp_extract(dsn, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    host = F.regexp_extract(dsn, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    path = F.regexp_extract(dsn, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return (
        F.when((driver == "") | (dsn == ""), F.lit("driver and dsn required"))
        .when(scheme != driver, F.concat(driver, F.lit(" dsn must start with "), driver, F.lit("://")))
        .when(host == "", F.lit("dsn missing host"))
        .when(path.isin("", "/"), F.lit("dsn missing database"))
    )


def check_requests(requests: DataFrame, databases: DataFrame, tables: DataFrame, fields: DataFrame, widgets: DataFrame, patterns: Sequence[str] | None = None) -> DataFrame:
    """Preconditions of field-creation requests, all at once: ``errors`` holds the codes joined by commas.

    Requests carry ``tenant_id, db_id, table_name, column_name, widget``. Reference sides are reduced to
    their distinct keys, so every join keeps one row per request.
    """
    from schemahelm.operators.policy import BUILTIN_WIDGETS

    def flagged(df: DataFrame, cols: list[Column], flag: str) -> DataFrame:
        return df.select(*cols).distinct().withColumn(flag, F.lit(True))

    lower_table = F.lower("table_name").alias("_table")
    dbs = flagged(databases, [F.col("tenant_id"), F.col("id").alias("db_id")], "_db")
    tbl = flagged(tables, [F.col("tenant_id"), F.col("db_id"), lower_table], "_tbl")
    old = flagged(fields, [F.col(k) for k in FIELD_KEY], "_dup")
    wid = flagged(widgets, [F.lower("id").alias("_w")], "_wid")
    canon = ty.canon_widget("widget")
    df = requests.withColumn("_table", F.lower("table_name")).withColumn("_canon", canon)
    df = df.withColumn("_w", F.regexp_extract("_canon", "^plugin://(.+)$", 1))
    df = (
        df.join(dbs, ["tenant_id", "db_id"], "left")
        .join(tbl, ["tenant_id", "db_id", "_table"], "left")
        .join(old, list(FIELD_KEY), "left")
        .join(wid, "_w", "left")
    )
    known_widget = (F.col("_canon") == "core://auto") | F.col("_w").isin(BUILTIN_WIDGETS) | F.col("_wid").isNotNull()
    errors = F.array_compact(
        F.array(
            F.when(is_reserved("table_name", patterns), F.lit("reserved_table")),
            F.when(F.coalesce("widget", F.lit("")) == "", F.lit("widget_required")).when(~known_widget, F.lit("unknown_widget")),
            F.when(F.coalesce("db_id", F.lit(0)) <= 0, F.lit("db_id_invalid")).when(F.col("_db").isNull(), F.lit("db_missing")),
            F.when(F.col("_tbl").isNull(), F.lit("table_missing")),
            F.when(F.col("_dup").isNotNull(), F.lit("duplicate_field")),
        )
    )
    return df.withColumn("errors", F.array_join(errors, ",")).drop("_table", "_canon", "_w", "_db", "_tbl", "_dup", "_wid")


def exists_flags(requests: DataFrame, reference: DataFrame, keys: Sequence[str], flag: str = "found") -> DataFrame:
    """Batch existence probe: requests with a boolean."""
    known = reference.select(*keys).distinct().withColumn(flag, F.lit(True))
    return requests.join(known, list(keys), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
