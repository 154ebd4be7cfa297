"""Language identification by words first, and by ever shorter character n-grams for words never seen.

Training counts the words of all labelled documents by language. Known words score by their smoothed log frequency in
each language. An unseen word falls back to the longest n-grams of it that are known in any language and scores by their
mean log frequency, so that it weighs as much as one word. A text's scores are sums over its words; the score of the
prediction is its share after exponentiation. Every counted word and n-gram is kept, in tables that the documents'
distinct words are joined with; only the most frequent words are held in memory too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from schemahelm.llm.common import CACHE_WORDS, crc32_of_id, slices, stash, table_types

#: ASCII letters and all bytes of other characters stay, the rest separates.
_LETTER_BYTES = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Marks belong to the letter before them.
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
GRAMS = (4, 3, 2, 1)


def tokens_of(text: str) -> list[bytes]:
    """Lower-cased runs of ASCII letters and non-ASCII characters; ``words_in`` takes the words out of a run."""
    return text.lower().encode("utf-8", "replace").translate(_LETTER_BYTES).split()


def words_in(token: bytes) -> list[str]:
    return [token.decode()] if token.isascii() else _WORDS.findall(token.decode("utf-8", "replace"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(text, lang) -> lang, word, n over all rows; partial counts are made per task and shuffled by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows: Counter = Counter()
            for lang, counts in seen.items():
                for token, n in counts.items():
                    for word in words_in(token):
                        rows[lang, word] += n
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.string()), pa.array(list(rows.values()), pa.int64())],
                ["lang", "word", "n"],
            )

        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    seen.setdefault(lang, Counter()).update(tokens_of(text))
                if sum(map(len, seen.values())) > CACHE_WORDS:
                    yield out()
        yield out()

    return docs.select("lang", "text").dropna().mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _most_frequent(counted: DataFrame, most: int, key: str = "word") -> list[Row]:
    """Rows of the keys that are most frequent and not seen once only, at most ``most``.

    A histogram of the frequencies (sixteenths of a doubling, and within each 64 slots by hash) tells where to cut, so
    that no task sends more than what stays.
    """
    slot = F.floor(F.log2(F.col("n").cast("double")) * 16) * 64 + F.pmod(F.xxhash64(key), F.lit(64))
    found = counted.where("n > 1").withColumn("slot", slot).persist()
    try:
        cut, kept = None, 0
        # At most 64 rows for each sixteenth of a doubling.
        for r in sorted(found.groupBy("slot").count().collect(), reverse=True):
            if kept + r["count"] > most:
                break
            cut, kept = r["slot"], kept + r["count"]
        return [] if cut is None else found.where(F.col("slot") >= cut).orderBy(F.desc("n"), key).collect()  # at most ``most`` rows
    finally:
        found.unpersist()


@dataclass(frozen=True)
class LanguageTables:
    """Every counted word and n-gram with its smoothed log frequencies, ``s0`` and on in the order of ``langs``, as written tables."""

    langs: list[str]
    words: DataFrame
    grams: dict[int, DataFrame]
    #: Places and log frequencies of the most frequent words, copied from ``words``: they need no join.
    frequent: tuple[dict[str, int], np.ndarray]


def _grams(word: str, n: int) -> Column:
    """All n-grams of a padded word, but for a mere end of it, which tells nothing."""
    p = F.concat(F.lit("^"), F.col(word), F.lit("$"))
    every = F.transform(F.sequence(F.lit(1), F.length(p) - (n - 1)), lambda i: F.substr(p, i, F.lit(n)))
    return F.filter(F.when(F.length(p) >= n, every), lambda g: ~g.isin("^", "$"))


def count_tables(docs: DataFrame, most: int = 100_000) -> LanguageTables:
    """Counts of all rows of (text, lang). ``most`` words are held in memory besides, which changes no result."""
    counts = stash(word_counts(docs), "lang_counts")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    each = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)]

    def table_of(rows: DataFrame, key: str) -> DataFrame:
        found = stash(rows.groupBy(key).agg(F.sum("n").alias("n"), *each), f"lang_{key}s")
        whole = found.agg(F.count("*").alias("keys"), *(F.sum(f"n{i}").alias(f"n{i}") for i in range(len(langs)))).first()
        logs = [F.log((F.col(f"n{i}") + 0.5) / F.lit((whole[f"n{i}"] or 0) + 0.5 * max(1, whole["keys"]))).alias(f"s{i}") for i in range(len(langs))]
        return found.select(key, "n", *logs)

    words = table_of(counts, "word")
    grams = {n: table_of(counts.select("lang", "n", F.explode(_grams("word", n)).alias("gram")), "gram") for n in GRAMS}
    rows = _most_frequent(words, most)
    logs = np.array([[r[f"s{i}"] for i in range(len(langs))] for r in rows], float).reshape(len(rows), len(langs))
    return LanguageTables(langs, words, grams, ({r["word"]: i for i, r in enumerate(rows)}, logs))


def _word_scores(words: DataFrame, tables: LanguageTables) -> DataFrame:
    """Distinct words -> word, s0 and on: their own scores, else the mean of their longest n-grams that are known."""
    scores = [f"s{i}" for i in range(len(tables.langs))]
    met = stash(words.join(tables.words.select("word", *scores), "word", "left"), "lang_met")
    found, left = met.where("s0 IS NOT NULL"), met.where("s0 IS NULL").select("word")
    for n in GRAMS:
        if left.isEmpty():
            break
        parts = left.select("word", F.explode(_grams("word", n)).alias("gram")).join(tables.grams[n].select("gram", *scores), "gram")
        mean = stash(parts.groupBy("word").agg(*(F.avg(x).alias(x) for x in scores)), "lang_mean")
        found = found.unionByName(mean)
        left = stash(left.join(mean.select("word"), "word", "left_anti"), "lang_left")
    return found


def predict(docs: DataFrame, tables: LanguageTables, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` plus ``lang_pred`` and ``score`` of the whole ``text``; a text without letters is ``und`` with 0.

    Frequent words are summed while the texts are read. Of the others, a row's distinct words are joined with their scores.
    """
    width = len(tables.langs)
    held = docs.sparkSession.sparkContext.broadcast(tables.frequent)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, logs = held.value
        place: dict[bytes, int] = {}
        # By token: scores of its frequent words, then how many words there are; its other words.
        known, others = np.zeros((1 << 12, width + 1)), []
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = [tokens_of(t) if t else [] for t in part.column("_text").to_pylist()]
                if len(place) > CACHE_WORDS:
                    place.clear()
                    others.clear()
                for token in set().union(*texts) if texts else ():
                    if token not in place:
                        at = place[token] = len(place)
                        if at >= len(known):
                            known = np.concatenate([known, np.zeros_like(known)])
                        words = words_in(token)
                        known[at, :width] = sum((logs[places[w]] for w in words if w in places), np.zeros(width))
                        known[at, width] = len(words)
                        others.append([w for w in words if w not in places])
                totals, rest, times = [], [], []
                for tokens in texts:
                    at = [place[t] for t in tokens]
                    totals.append(known[np.array(at, np.int64)].sum(axis=0))
                    seen = Counter(w for i in at for w in others[i])
                    rest.append(list(seen))
                    times.append(list(seen.values()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.array([x.tolist() for x in totals], pa.list_(pa.float64())), pa.array(rest, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))],
                    [*columns, "_totals", "_words", "_times"],
                )

    texts = docs.select(*columns, F.col("text").alias("_text"))
    types = f"{table_types(docs.select(*columns))}, _totals array<double>, _words array<string>, _times array<bigint>"
    # Row numbers hold once they are written.
    rows = stash(texts.mapInArrow(read, types).withColumn("_row", F.monotonically_increasing_id()), "lang_rows")
    if not width:
        return rows.select(*columns, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    pairs = rows.select("_row", F.explode(F.arrays_zip("_words", "_times")).alias("p")).select("_row", F.col("p._words").alias("word"), F.col("p._times").alias("times"))
    scores = _word_scores(pairs.select("word").distinct(), tables)
    sums = pairs.join(scores, "word").groupBy("_row").agg(*(F.sum(F.col("times") * F.col(f"s{i}")).alias(f"s{i}") for i in range(width)))
    total = F.array(*(F.get("_totals", F.lit(i)) + F.coalesce(f"s{i}", F.lit(0.0)) for i in range(width)))
    judged = rows.drop("_words", "_times").join(sums, "_row", "left").withColumn("_all", total).withColumn("_best", F.array_max("_all"))
    some = F.get("_totals", F.lit(width)) > 0
    best = F.element_at(F.array(*map(F.lit, tables.langs)), F.array_position("_all", F.col("_best")).cast("int"))
    share = 1 / F.aggregate("_all", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_best")))
    return judged.select(*columns, F.when(some, best).otherwise("und").alias("lang_pred"), F.when(some, share).otherwise(0.0).alias("score"))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) -> doc_id, held_out, lang_pred, score; one row for each document.

    Learns from rows outside the held-out fold (crc32 of the id modulo 3 is 1) that have a text and a language; a null
    id is in no fold and not learnt from. Null texts and texts without letters are ``und``, as is everything if nothing can be
    learnt. Ties go to the first language by name. Repeated rows count as often as they come; other columns are not read.
    """
    fold = crc32_of_id(F.col("doc_id")) % 3
    tables = count_tables(docs.where(fold != 1))
    held_out = F.coalesce(fold == 1, F.lit(False))
    return predict(docs, tables, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
