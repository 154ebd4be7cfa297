"""Helpers shared by the corpus operators: row keys, byte-wise words, hashes and bounded Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemahelm.session import cut_lineage

#: Arrow batches are cut to about this many bytes of text before Python touches them.
SLICE_BYTES = 4 << 20
#: Entries of a per-task word cache before it is emptied.
CACHE_WORDS = 400_000

SPACE = b"\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and go on from the files, so that several readers share the work."""
    return cut_lineage(df, name)


def table_types(df: DataFrame) -> str:
    """The columns of ``df`` as a schema string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def row_key() -> Column:
    """64-bit fingerprint of a document's id and text."""
    return F.xxhash64("doc_id", "text")


def without_rows(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` without the documents whose (row_key, doc_id) is in ``bad``; all columns as they are.

    Written first, the list has a known size: Spark broadcasts it if it is small, else both sides meet in a shuffle.
    """
    bad = stash(bad.select(F.col("row_key").alias("__bad_key"), F.col("doc_id").alias("__bad_id")).distinct(), "bad")
    keyed = docs.withColumn("__row_key", row_key())
    met = (F.col("__row_key") == F.col("__bad_key")) & keyed["doc_id"].eqNullSafe(F.col("__bad_id"))
    return keyed.join(bad, met, "left_anti").select(*docs.columns)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts sum to about ``limit`` bytes; a longer text is a part of its own."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """Word -> unsigned 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multiplier of the rolling shingle hash.
_BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a 64-bit hash over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, by position; empty if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + words[j : j + n]
    return mix(out + np.uint64(k))
