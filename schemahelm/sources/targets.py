"""Routing targets with labels, and widget definition files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemahelm.functions.labels import label_set
from schemahelm.schemas import WIDGET
from schemahelm.session import cut_lineage


def load_targets(targets: DataFrame, labels: DataFrame, key: str = "tkey") -> DataFrame:
    """Targets with their sorted label array, from the two relational tables.

    (target, label) is the primary key of the label table; duplicates are folded map-side.
    """
    sets = labels.groupBy(key).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    empty = F.array().cast("array<string>")
    return targets.join(sets, key, "left").withColumn("labels", F.coalesce("labels", empty))


def default_target(targets: DataFrame, key: str = "tkey") -> DataFrame:
    """Key of the default target; no row when none is set."""
    return targets.where("is_default").agg(F.min(key).alias(key)).where(F.col(key).isNotNull())


def split_labels(targets: DataFrame, column: str = "labels") -> DataFrame:
    """Comma-joined label text -> raw label array ``labels`` and normalised ``label_set``."""
    raw = F.when(F.coalesce(column, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(column, ","))
    return targets.withColumn(column, raw).withColumn("label_set", label_set(column))


def ignored_file(name: Column) -> Column:
    """Editor leftovers and hidden files."""
    return name.rlike(r"^\.") | name.rlike(r"(~|\.swp|\.swx|\.tmp|\.partial|4913)$") | name.rlike(r"^#.*#$")


def load_widgets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Widget files of a folder -> (widgets, errors).

    A file must hold one JSON object with id, name and type ``widget``; scopes default to ``system``. All
    files that share an id are reported as errors instead of letting one of them win silently. The rows are written
    first, so each file is read once.
    """
    text = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    return split_duplicates(cut_lineage(parse_widgets(text.select("value", F.col("_metadata.file_name").alias("file"))), "widgets"))


def split_duplicates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed widget rows -> (valid widgets, errors including every file of a repeated id)."""
    dup = rows.where(F.col("error").isNull()).groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    tagged = rows.join(dup, "id", "left").withColumn(
        "error", F.coalesce("error", F.when(F.col("_n").isNotNull(), F.concat(F.lit("duplicate widget id "), "id")))
    )
    widgets = tagged.where(F.col("error").isNull()).drop("error", "_n")
    return widgets, tagged.where(F.col("error").isNotNull()).select("file", "id", "error")


def parse_widgets(files: DataFrame) -> DataFrame:
    """Rows of (value, file) -> widget columns plus ``error`` (NULL when valid)."""
    schema = ", ".join(
        f"`{f.name}`: {'variant' if f.name == 'meta' else f.dataType.simpleString()}" for f in WIDGET.fields if f.name != "tenants"
    )
    # Editor leftovers never reach the parser.
    kept = files.where(~ignored_file(F.col("file")))
    w = F.from_json("value", f"struct<{schema}>")
    rows = kept.select("file", w.alias("w")).select("file", "w.*")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    valid = filled("id") & filled("name") & (F.coalesce("type", F.lit("")) == "widget")
    empty = F.coalesce(F.size("scopes"), F.lit(0)) <= 0
    return (
        rows.withColumn("scopes", F.when(empty, F.array(F.lit("system"))).otherwise(F.col("scopes")))
        .withColumn("meta", F.to_json("meta"))
        .withColumn("error", F.when(~valid, F.lit("invalid widget: id, name, type required")))
    )
