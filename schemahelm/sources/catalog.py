"""Catalog scans: information-schema rows of any number of databases -> field rows.

Every function accepts the rows of one database or of a whole fleet; ``by`` names the columns that tell
databases apart (for example ``("tenant_id", "db_id")``) and becomes part of every join and group key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemahelm.functions import typing as ty
from schemahelm.schemas import DEFAULT_PREFIX

# --- fixed values -----------------------------------------------------------------------------------------
# tables left out of listings, per driver
EXCLUDED_SCHEMAS = {"postgres": ["pg_catalog", "information_schema", "pg_toast"]}
EXCLUDED_TABLES = {
    "postgres": ["schema_migrations", "goose_db_version", "flyway_schema_history"],
    "mysql": ["schema_migrations", "goose_db_version", "flyway_schema_history"],
}
EXCLUDED_PREFIXES = {"postgres": ["pg_temp_"]}
EXCLUDED_PATTERNS = {"postgres": ["^pg_.*"]}
# registry tables that scans skip, after the table prefix
RESERVED_TABLES = [
    "audit_logs", "events_failed", "registry_", "role_", "roles", "user_", "users", "monitored_databases",
]
# --- end of fixed values ----------------------------------------------------------------------------------


def read_catalog(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """Catalog rows of one database over JDBC, read in parallel ranges when a numeric column is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column and bounds:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return reader.load()


def scan_catalog(
    columns: DataFrame,
    uniques: DataFrame | None = None,
    driver: str = "postgres",
    prefix: str = DEFAULT_PREFIX,
    schema: str | None = None,
    minimal: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Field rows from catalog column rows.

    The physical type comes from ``column_type`` where the dialect has one (MySQL) and is not blank, else
    from ``data_type``; the registry's own field table is left out. ``uniques`` holds index rows for
    :func:`mark_unique`. ``minimal`` keeps table, column and type with the derived kinds only.
    """
    rows = columns.where(F.col("table_name") != F.lit(prefix + "custom_fields"))
    if schema is not None:
        rows = rows.where(F.col("table_schema") == schema)
    detailed = F.col("column_type") if driver == "mysql" and "column_type" in columns.columns else F.lit(None).cast("string")
    physical = F.coalesce(F.nullif(detailed, F.lit("")), F.col("data_type"))
    drv = F.lit(driver)
    derived = [
        ty.store_kind(drv).alias("store_kind"),
        ty.sql_kind("data_type").alias("kind"),
        ty.physical_type(drv, F.col("data_type") if minimal else physical, F.lit("sql")).alias("physical_type"),
    ]
    if minimal:
        return rows.select(*by, "table_name", "column_name", "data_type", *derived)
    fields = rows.select(
        *by,
        "table_name",
        "column_name",
        "data_type",
        *derived,
        (F.col("is_nullable") == "YES").alias("is_nullable"),
        F.col("column_default").isNotNull().alias("has_default"),
        F.col("column_default").alias("default_value"),
        "ordinal_position",
    )
    if uniques is None:
        return fields.withColumn("is_unique", F.lit(False))
    return mark_unique(fields, uniques, by=by)


def single_column_uniques(index_columns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Columns covered alone by a unique index; one row per column."""
    key = [*by, "table_name"]
    return (
        index_columns.groupBy(*key, "index_name")
        .agg(F.count(F.lit(1)).alias("n"), F.min("column_name").alias("column_name"))
        .where(F.col("n") == 1)
        .select(*key, "column_name")
        .distinct()
    )


def mark_unique(fields: DataFrame, index_columns: DataFrame, add_missing: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Set ``is_unique`` from index rows; an index over several columns makes none of them unique.

    ``add_missing`` also adds indexed columns nobody has seen, as nullable document strings.
    """
    key = [*by, "table_name", "column_name"]
    uniq = single_column_uniques(index_columns, by).withColumn("_hit", F.lit(True))
    how = "full" if add_missing else "left"
    joined = fields.drop("is_unique").withColumn("_seen", F.lit(True)).join(uniq, key, how)
    joined = joined.withColumn("is_unique", F.coalesce(F.col("_hit"), F.lit(False)))
    if add_missing:
        unseen = F.col("_seen").isNull()
        filler = {
            "data_type": F.lit("string"),
            "store_kind": F.lit("mongo"),
            "kind": F.lit("string"),
            "physical_type": F.lit("mongodb:string"),
            "is_nullable": F.lit(True),
            "has_default": F.lit(False),
        }
        for name, value in filler.items():
            if name in fields.columns:
                joined = joined.withColumn(name, F.when(unseen, value).otherwise(F.col(name)))
    return joined.drop("_hit", "_seen")


def list_tables(tables: DataFrame, schema: str, base_only: bool = False) -> DataFrame:
    """Tables of a schema with their comments."""
    rows = tables.where(F.col("table_schema") == schema)
    if base_only:
        rows = rows.where(F.col("table_type") == "BASE TABLE")
    return rows.select("table_name", F.coalesce("comment", F.lit("")).alias("comment")).orderBy("table_name")


def qualify_tables(tables: DataFrame, driver: str = "postgres") -> DataFrame:
    """Base tables with a qualified name; the public and the empty schema stay unqualified."""
    rows = tables.where(F.col("table_type") == "BASE TABLE")
    if driver == "postgres":
        rows = rows.where(~F.col("table_schema").isin(EXCLUDED_SCHEMAS["postgres"])).where(
            ~F.col("table_schema").startswith("pg_temp_")
        )
    plain = F.coalesce("table_schema", F.lit("")).isin("", "public")
    return rows.withColumn(
        "qualified",
        F.when(plain, F.col("table_name")).otherwise(F.concat("table_schema", F.lit("."), "table_name")),
    )


def is_excluded(driver: str, schema: Column, table: Column, prefix: str = DEFAULT_PREFIX) -> Column:
    """Exclusion rule of a driver: schema list, exact names, prefixes (also on the schema), patterns."""
    drv = driver.lower()
    if drv not in ("postgres", "mysql"):
        return F.lit(False)
    name = F.lower(table)
    folder = F.lower(F.coalesce(schema, F.lit("")))
    hit = F.coalesce(schema, F.lit("")).isin(EXCLUDED_SCHEMAS.get(drv, [])) | name.isin(EXCLUDED_TABLES[drv])
    for p in [prefix, *EXCLUDED_PREFIXES.get(drv, [])]:
        if p:
            hit = hit | name.startswith(p.lower()) | folder.startswith(p.lower())
    for rx in EXCLUDED_PATTERNS.get(drv, []):
        hit = hit | name.rlike(rx)
    return hit


def filter_tables(tables: DataFrame, driver: str, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    schema = F.col("table_schema") if "table_schema" in tables.columns else F.lit("")
    return tables.where(~is_excluded(driver, schema, F.col("table_name"), prefix))


def reserved_patterns(prefix: str = DEFAULT_PREFIX, override: str | None = None, legacy: Sequence[str] = ()) -> list[str]:
    """Patterns of reserved tables: a comma list overrides all, legacy exact names are anchored."""
    if override:
        return [p.strip() for p in override.split(",") if p.strip()]
    if legacy:
        return [f"^{name}$" for name in legacy]
    return [f"^{prefix}{name}" for name in RESERVED_TABLES]


def is_reserved(table: Column | str, patterns: Sequence[str] | None = None) -> Column:
    """Any pattern found anywhere in the name (anchors belong to the pattern)."""
    c = ty.col_of(table)
    hit = F.lit(False)
    for p in reserved_patterns() if patterns is None else patterns:
        hit = hit | c.rlike(p)
    return hit


def list_databases(databases: DataFrame, tenant: str | None = None) -> DataFrame:
    """Monitored databases of one tenant or all, ordered by id."""
    rows = databases if tenant is None else databases.where(F.col("tenant_id") == tenant)
    return rows.orderBy("id")
