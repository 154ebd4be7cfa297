"""Small document tables for the corpus tests."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark: SparkSession, rows: list[tuple], schema: str = DOCS) -> DataFrame:
    """Rows (doc_id, text[, lang, source]) as a table in several partitions."""
    if schema == DOCS:
        rows = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "s0")), len(r[1] or "")) for r in rows]
    return spark.createDataFrame(rows, schema).repartition(3)


def empty(spark: SparkSession, schema: str = DOCS) -> DataFrame:
    return spark.createDataFrame([], schema)


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def rows_of(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def documents(sf_dir: str) -> pd.DataFrame:
    return pd.read_parquet(f"{sf_dir}/documents.parquet")
