"""Ordered slices of a table: the common base of scans along an order, ranks and deep pages.

The rows are range-partitioned by the whole sort order, so a key with much of the table is spread over as many slices as its
share asks for, and written once under the number of their slice. Every later pass sees the same slices, works inside
one of them, and carries one small summary per slice over to the next.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemahelm.session import scratch_path


@dataclass(frozen=True)
class Slices:
    """``rows`` with their ``_slice``, a folder each; ``order`` sorts them within and across slices."""

    rows: DataFrame
    order: tuple[Column, ...]

    def directory(self) -> DataFrame:
        """A row for each slice: _slice, n, before (rows in the slices before it)."""
        sizes = self.rows.groupBy("_slice").agg(F.count(F.lit(1)).alias("n"))
        # As many rows as there are slices.
        ahead = Window.partitionBy(F.lit(1)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        return sizes.select("_slice", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).cast("bigint").alias("before"))

    def ranked(self, index: str) -> DataFrame:
        """Rows with their zero-based position in the order."""
        local = F.row_number().over(Window.partitionBy("_slice").orderBy(*self.order)) - 1
        shift = self.directory().select("_slice", "before")
        return self.rows.withColumn("_local", local).join(shift, "_slice").withColumn(index, (F.col("_local") + F.col("before")).cast("bigint")).drop("_local", "before", "_slice")

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows at the positions from ``offset`` on, at most ``limit``, with ``_pos``; only slices that hold some are read."""
        end = offset + limit
        # Two numbers for each slice that the page touches.
        touched = self.directory().where((F.col("before") < end) & (F.col("before") + F.col("n") > offset)).select("_slice", "before").collect()
        here = self.rows.where(F.col("_slice").isin([r["_slice"] for r in touched]) if touched else F.lit(False))
        shift = F.create_map(*(F.lit(x) for r in touched for x in (r["_slice"], r["before"]))) if touched else F.create_map(F.lit(0), F.lit(0))
        local = F.row_number().over(Window.partitionBy("_slice").orderBy(*self.order)) - 1
        placed = here.withColumn("_pos", (local + F.element_at(shift, F.col("_slice"))).cast("bigint")).drop("_slice")
        return placed.where((F.col("_pos") >= offset) & (F.col("_pos") < end))


def sorted_slices(df: DataFrame, order: Sequence[Column | str], slices: int | None = None) -> Slices:
    """``df`` in slices by ``order``, which should tell all rows apart: equal ones share a slice."""
    order = tuple(F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order)
    dealt = df.repartitionByRange(slices, *order) if slices else df.repartitionByRange(*order)
    path = scratch_path(df.sparkSession, "slices")
    sliced = dealt.withColumn("_slice", F.spark_partition_id())
    sliced.write.partitionBy("_slice").parquet(path)
    return Slices(df.sparkSession.read.schema(sliced.schema).parquet(path), order)
