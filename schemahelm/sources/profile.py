"""Measured scan of data tables: type, nulls and uniqueness per column."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NESTED = ("array", "map", "struct", "variant")
_SCHEMA = "table_name string, column_name string, data_type string, row_count bigint, null_count bigint, is_nullable boolean, is_unique boolean"
#: Columns with fewer distinct values than this share of their values are refuted in a part of the hash space first.
_LIKELY, _PART = 0.5, 64
#: Rows that are looked at first, the length of the values compared there, and tables that are scanned side by side.
_HEAD, _SHORT, _ABREAST = 1024, 64, 4
#: Types whose values differ exactly where their texts do.
_BY_TEXT = ("string", "tinyint", "smallint", "int", "bigint", "boolean", "date", "decimal")


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column: ``table_name, column_name, data_type, row_count, null_count, is_nullable, is_unique``.

    Exact, though values are hardly ever shuffled. A value that is twice among a table's first rows refutes uniqueness, and the
    column needs no more than counting. One pass counts rows, nulls and, roughly, distinct values. Then 64-bit hashes of
    the values are counted: hashes that all occur once prove a column unique. A hash that occurs again is only a
    suspicion; the rows that have it are looked at, and two equal values among them refute uniqueness. A column that seems to repeat
    its values is suspected in a small part of the hash space first. Columns of nested types are counted and never unique.
    """
    spark = next(iter(tables.values())).sparkSession
    with ThreadPoolExecutor(_ABREAST) as pool:
        found = list(pool.map(lambda table: _profile(*table), tables.items()))
    return spark.createDataFrame([row for rows in found for row in rows], _SCHEMA)


def _twice_in_head(df: DataFrame, quoted: dict[str, Column], columns: Sequence[str]) -> set[str]:
    """Those of the columns that have a short value twice in the first rows: a proof, whatever the other rows hold."""
    if not columns:
        return set()
    texts = [quoted[c].cast("string") for c in columns]
    head = df.select(*(F.when(F.length(t) <= _SHORT, t).alias(f"v{i}") for i, t in enumerate(texts))).head(_HEAD)
    return {c for i, c in enumerate(columns) if any(n > 1 for v, n in Counter(r[i] for r in head).items() if v is not None)}


def _profile(name: str, df: DataFrame) -> list[tuple]:
    """The rows of one table, as many as it has columns."""
    types = dict(df.dtypes)
    plain = [c for c, t in types.items() if not t.startswith(_NESTED)]
    quoted = {c: F.col(f"`{c.replace('`', '``')}`") for c in types}
    refuted = _twice_in_head(df, quoted, [c for c in plain if types[c].startswith(_BY_TEXT)])
    open_ = [c for c in plain if c not in refuted]
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.count(quoted[c]).alias(f"n{i}") for i, c in enumerate(types)),
        *(F.approx_count_distinct(quoted[c]).alias(f"d{i}") for i, c in enumerate(types) if c in open_),
    ).first()
    present = {c: counts[f"n{i}"] for i, c in enumerate(types)}
    seen = {c: counts[f"d{i}"] for i, c in enumerate(types) if c in open_}
    full = [c for c in open_ if present[c] > 0 and seen[c] >= _LIKELY * present[c]]
    some = [c for c in open_ if present[c] > 0 and c not in full]
    refuted |= _repeated(df, quoted, some, _PART)
    refuted |= _repeated(df, quoted, full + [c for c in some if c not in refuted], 1)
    rows = counts["rows"]
    return [
        (name, c, t, rows, rows - present[c], present[c] < rows, c in plain and present[c] > 0 and c not in refuted) for c, t in types.items()
    ]


def _repeated(df: DataFrame, quoted: dict[str, Column], columns: Sequence[str], part: int) -> set[str]:
    """Those of the columns that have a value twice, as far as a ``part``-th of the hash space shows it (1: all of it)."""
    if not columns:
        return set()
    hashes = F.array(*(F.struct(F.lit(i).alias("i"), F.when(quoted[c].isNotNull(), F.xxhash64(quoted[c])).alias("h")) for i, c in enumerate(columns)))
    each = df.select(F.inline(F.filter(hashes, lambda x: x["h"].isNotNull() & (F.pmod(x["h"], F.lit(part)) == 0))))
    most = each.groupBy("i", "h").agg(F.count(F.lit(1)).alias("n")).groupBy("i").agg(F.max("n").alias("n"), F.max_by("h", "n").alias("h"))
    # At most a row for each column.
    suspects = {columns[r["i"]]: r["h"] for r in most.where("n > 1").collect()}
    if not suspects:
        return set()
    names = list(suspects)
    values = F.array(*(F.struct(F.lit(i).alias("i"), F.when(F.xxhash64(quoted[c]) == suspects[c], quoted[c].cast("string")).alias("v")) for i, c in enumerate(names)))
    met = df.select(F.inline(F.filter(values, lambda x: x["v"].isNotNull()))).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    proven = {names[r["i"]] for r in met.select("i").distinct().collect()}
    # Different values of one hash decide nothing; all values of such a column are counted.
    unclear = [c for c in names if c not in proven] if part == 1 else []
    return proven | {c for c in unclear if not df.where(quoted[c].isNotNull()).groupBy(quoted[c]).count().where("count > 1").isEmpty()}
