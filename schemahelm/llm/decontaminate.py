"""Benchmark decontamination by a prefix-filtered set join.

Every window of an item is the set of its word shingles, and a document holds the window only if it holds all of
them: at a containment of 1 the necessary prefix of a set is its one rarest shingle. Shingles are ordered by how
many documents have them, counted over all documents. Documents give up only the places where some prefix shingle
occurs, with the words around; these meet the windows in a join on the shingle. A place whose words before or after
are too few for the window (length and positional bounds) is dropped, and the rest is compared word by word.

Both passes over the documents look shingles up in a bit map of bounded size, so the benchmark may be of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from schemahelm.llm.bitmap import bitmap, has_bits
from schemahelm.llm.common import WordHashes, raw, row_key, shingle_hashes, slices, stash, without_rows

#: Bytes to words: A-Z to lower case, other ASCII than digits and letters to spaces, all else as it is.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def item_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """Items (item_id, text) -> item_id, words (space-joined), length, k (words of a shingle), shingles (hashes by offset)."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            out = []
            for item, text in zip(pdf["item_id"], pdf["text"]):
                words = words_of(text.encode())
                n = min(window, len(words))
                h = hashes.array(words)
                for i in range(len(words) - n + 1 if n else 0):
                    k = min(shingle, n)
                    out.append((item, b" ".join(words[i : i + n]).decode(), n, k, shingle_hashes(h[i : i + n], k).view(np.int64)))
            yield pd.DataFrame(out, columns=["item_id", "words", "length", "k", "shingles"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").dropna().distinct()
    return items.mapInPandas(compute, "item_id string, words string, length int, k int, shingles array<bigint>").distinct()


def _document_counts(docs: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """How many documents have each of the given shingles (h), over all documents."""
    held = bitmap(shingles, F.col("h"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch):
                found = [np.empty(0, np.uint64)]
                for text in raw(part.column("text")):
                    h = hashes.array(words_of(text))
                    for k in sizes:
                        s = shingle_hashes(h, k)
                        found.append(np.unique(s[has_bits(held.value, s)]))
                values, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select("text").mapInArrow(compute, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("docs"))


def _prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Distinct windows with their rarest shingle: h, offset, length, k, words. Windows with a shingle that no document has go."""
    each = windows.select("words", "length", "k", "shingles").distinct().select(
        "words", "length", "k", F.posexplode("shingles").alias("offset", "h")
    )
    ranked = each.join(counts, "h", "left").groupBy("words", "length", "k").agg(
        F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "h", "offset")).alias("p")
    )
    return ranked.where("p.docs > 0").select("words", "length", "k", F.col("p.h").alias("h"), F.col("p.offset").alias("offset"))


def _places(docs: DataFrame, prefixes: DataFrame, window: int, sizes: list[int]) -> DataFrame:
    """A row for each document (pos null) with its number of words, and one for each place of a prefix shingle."""
    held = bitmap(prefixes, F.col("h"))
    fields = ["row", "row_key", "doc_id", "n_words", "h", "pos", "before", "around"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch):
                n_words, at, h_at, pos, before, around = [], [], [], [], [], []
                for i, text in enumerate(raw(part.column("text"))):
                    words = words_of(text)
                    n_words.append(len(words))
                    h = hashes.array(words)
                    for k in sizes:
                        s = shingle_hashes(h, k)
                        for p in np.flatnonzero(has_bits(held.value, s)).tolist():
                            first = max(0, p - (window - k))
                            at.append(i)
                            h_at.append(s[p])
                            pos.append(p)
                            before.append(p - first)
                            around.append(b" ".join(words[first : p + window]))
                none = lambda t: pa.nulls(part.num_rows, t)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("row_key"), part.column("doc_id"), pa.array(n_words, pa.int64()), none(pa.int64()), none(pa.int32()),
                     none(pa.int32()), none(pa.string())], fields,
                )
                if at:
                    at = pa.array(at, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row").take(at), part.column("row_key").take(at), part.column("doc_id").take(at), pa.array(n_words, pa.int64()).take(at),
                         pa.array(np.array(h_at, np.uint64).view(np.int64)), pa.array(pos, pa.int32()), pa.array(before, pa.int32()),
                         pa.array(around, pa.binary()).cast(pa.string())], fields,
                    )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.monotonically_increasing_id().alias("row"), row_key().alias("row_key"), "doc_id", "text").mapInArrow(
        compute, f"row bigint, row_key bigint, doc_id {id_type}, n_words bigint, h bigint, pos int, before int, around string"
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 5, one_in: int = 20) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text) and items (item_id, text) -> (report, spans).

    report: row (of this run), row_key (of id and text), doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row for each document.
    spans: row, doc_id, item_id, start, length: every occurrence of a window, in words.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A document is contaminated if
    at least one word in ``one_in`` is inside a window. Null and empty texts have no words; items without an id or words
    take no part; repeated item ids are one item with the windows of all their texts; repeated documents are judged
    alike, each for itself, and a null doc_id is kept as it is. Other columns are not read.
    """
    windows = stash(item_windows(benchmark, window, shingle), "windows")
    # At most ``shingle`` numbers.
    sizes = sorted(r["k"] for r in windows.select("k").distinct().collect())
    shingles = windows.select(F.explode("shingles").alias("h"))
    prefixes = stash(_prefixes(windows, _document_counts(docs, shingles, sizes)), "prefixes")
    places = stash(_places(docs, prefixes, window, sizes), "places")

    met = places.where("pos IS NOT NULL").join(prefixes, "h")
    met = met.where("offset <= before").withColumn("seen", F.split("around", " "))
    met = met.where(F.size("seen") - F.col("before") >= F.col("length") - F.col("offset"))
    same = F.array_join(F.slice("seen", F.col("before") - F.col("offset") + 1, F.col("length")), " ") == F.col("words")
    hits = met.where(same).select("row", "doc_id", (F.col("pos") - F.col("offset")).alias("start"), "length", "words").distinct()

    # A document has at most as many windows as words, so a group here is bounded by one text.
    order = Window.partitionBy("row").orderBy("start", "length")
    spans = hits.select("row", "start", "length").distinct()
    end = F.col("start") + F.col("length")
    reached = F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gained = spans.select("row", F.greatest(F.lit(0), end - F.greatest("start", reached)).alias("gain"))
    hit_words = gained.groupBy("row").agg(F.sum("gain").alias("n_hit"))

    by_item = hits.join(windows.select("words", "item_id").distinct(), "words")
    items = by_item.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))

    report = places.where("pos IS NULL").select("row", "row_key", "doc_id", "n_words").join(hit_words.join(items, "row"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    report = report.select(
        "row", "row_key", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"),
    )
    # size() of a missing list is -1 under some settings.
    report = report.withColumn("n_items", F.greatest("n_items", F.lit(0).cast("bigint")))
    return report, by_item.select("row", "doc_id", "item_id", "start", "length").distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 5, one_in: int = 20) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that are not contaminated; see ``contamination``."""
    report, _ = contamination(docs, benchmark, window, shingle, one_in)
    return without_rows(docs, report.where("contaminated"))
