"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Every text becomes a short vector of transformed statistics. Per class, the count, the sums and the sums of
products of the vectors are added up over all labelled rows, so the fit needs one small aggregate whatever the
size of the corpus. The class covariances are shrunk towards their pooled covariance and towards its diagonal;
their Cholesky factors are computed once and shipped with the model. A score is the logistic of the difference
of the two classes' log-densities plus the log prior odds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemahelm.llm.common import crc32_of_id, raw, slices, stash, table_types

FEATURES = (
    "log_words", "word_length", "distinct_words", "repeated_neighbours", "top_word", "symbols", "marked_words",
    "capitals", "digits", "bars", "exclamations", "stops", "lines", "distinct_lines", "entropy", "high_bytes",
)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*+/<=>@\\^_`{|}~")] = True


def document_statistics(text: bytes) -> list[float]:
    """Transformed statistics of a whole text, in the order of ``FEATURES``; an empty text has zeros throughout."""
    if not text.strip():
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    words = text.split()
    n = len(words)
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = counts[counts > 0] / size
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()))
    same = sum(map(bytes.__eq__, words[1:], words[:-1]))
    marked = sum(1 for w in seen for _ in range(seen[w]) if _SYMBOLS[w[-1]]) if counts[_SYMBOLS].any() else 0
    # Shares of very short texts say little: they are taken as if some plain words and letters more were there.
    root = lambda part, whole, more: float(np.sqrt(part / (whole + more)))
    return [
        float(np.log1p(n)),
        float(np.log((size + 60) / (n + 10))),
        # Distinct words grow as a power of the length; the exponent barely depends on it.
        float(np.log(len(seen) + 10) / np.log(n + 10)),
        root(same, n, 10),
        root(max(seen.values()) - 1, n, 10),
        root(int(counts[_SYMBOLS].sum()), size, 60),
        root(marked, n, 10),
        root(int(counts[65:91].sum()), letters, 60),
        root(int(counts[48:58].sum()), size, 60),
        root(int(counts[124]), n, 10),
        root(int(counts[33]), n, 10),
        root(int(counts[46] + counts[63] + counts[33]), n, 10),
        float(np.log1p(n / len(lines))),
        (len(set(lines)) + 2) / (len(lines) + 2),
        float(-(share * np.log(share)).sum()) * size / (size + 60),
        root(int(counts[128:].sum()), size, 60),
    ]


def with_statistics(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` plus ``stats`` (array of doubles) of the whole ``text`` column."""
    d = len(FEATURES)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                values = np.array([document_statistics(t) for t in raw(part.column("_text"))], float).reshape(-1)
                offsets = pa.array(np.arange(0, part.num_rows * d + 1, d), pa.int32())
                stats = pa.ListArray.from_arrays(offsets, pa.array(values))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), stats], [*columns, "stats"])

    kept = docs.select(*columns, F.col("text").alias("_text"))
    return kept.mapInArrow(compute, f"{table_types(docs.select(*columns))}, stats array<double>")


@dataclass(frozen=True)
class QuadraticDiscriminant:
    """Class means, inverse Cholesky factors and log-determinants over standardised features."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    log_odds: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        density = [
            -0.5 * (((z - m) @ w.T) ** 2).sum(axis=1) - 0.5 * d for m, w, d in zip(self.means, self.whiten, self.log_det)
        ]
        logit = np.clip(density[1] - density[0] + self.log_odds, -500, 500)
        return 1.0 / (1.0 + np.exp(-logit))


def _moments(rows: DataFrame) -> DataFrame:
    """Partial (label, n, sums, products) of rows (label, stats): one small row per batch and label."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("stats").flatten()).reshape(batch.num_rows, -1)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            for label in np.unique(y).tolist():
                own = x[y == label]
                t = total.setdefault(label, [0, 0.0, 0.0])
                t[0] += len(own)
                t[1] = t[1] + own.sum(axis=0)
                t[2] = t[2] + own.T @ own
        for label, (n, s, p) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([label], pa.int32()), pa.array([n]), pa.array([s.tolist()]), pa.array([p.ravel().tolist()])], ["label", "n", "s", "p"]
            )

    partial = rows.mapInArrow(add, "label int, n bigint, s array<double>, p array<double>")
    total = lambda c, d: F.array(*[F.sum(F.col(c)[i]) for i in range(d)])
    d = len(FEATURES)
    return partial.groupBy("label").agg(F.sum("n").alias("n"), total("s", d).alias("s"), total("p", d * d).alias("p"))


def fit(rows: DataFrame, shrinkage: float = 0.1, ridge: float = 1e-3) -> QuadraticDiscriminant:
    """Fit on all rows (label 0 or 1, stats).

    ``shrinkage`` is the weight of the pooled covariance in each class covariance (a class with few rows gets more of
    it), ``ridge`` that of its diagonal. With no rows, or those of one class only, the other class takes the pooled
    figures and scores are the smoothed share of label 1.
    """
    d = len(FEATURES)
    n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in _moments(rows).collect():  # at most two rows
        n[r["label"]], s[r["label"]], p[r["label"]] = r["n"], r["s"], np.reshape(r["p"], (d, d))
    total = max(n.sum(), 1.0)
    center = s.sum(axis=0) / total
    var = np.maximum(np.diag(p.sum(axis=0)) / total - center**2, 0.0)
    scale = np.where(var > 1e-12, np.sqrt(var), 1.0)
    means, covs = np.zeros((2, d)), np.zeros((2, d, d))
    for c in (0, 1):
        if n[c]:
            m = s[c] / n[c]
            means[c] = (m - center) / scale
            covs[c] = (p[c] / n[c] - np.outer(m, m)) / np.outer(scale, scale)
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / total
    pooled = pooled + ridge * np.eye(d)
    if not n.all():
        means[:] = 0.0
    whiten, log_det = np.zeros((2, d, d)), np.zeros(2)
    for c in (0, 1):
        a = max(shrinkage, d / (d + n[c])) if n.all() else 1.0
        cov = (1 - a) * covs[c] + a * pooled
        cov = (1 - ridge) * cov + ridge * np.diag(np.maximum(np.diag(cov), ridge))
        factor = np.linalg.cholesky(cov + ridge * np.eye(d))
        whiten[c] = np.linalg.inv(factor)
        log_det[c] = 2.0 * np.log(np.diag(factor)).sum()
    return QuadraticDiscriminant(center, scale, means, whiten, log_det, float(np.log((n[1] + 1) / (n[0] + 1))))


def score(rows: DataFrame, model: QuadraticDiscriminant, threshold: float = 0.3) -> DataFrame:
    """Rows with ``stats`` -> the other columns plus ``score`` and ``predicted``."""
    columns = [c for c in rows.columns if c != "stats"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("stats").flatten()).reshape(-1, len(FEATURES))
            got = model.scores(x)
            predicted = pa.array((got >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(got), predicted], [*columns, "score", "predicted"]
            )

    return rows.mapInArrow(compute, f"{table_types(rows.select(*columns))}, score double, predicted int")


def training_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of documents outside the held-out fold, once for each distinct (document, quality) label.

    Labels that are null or neither 0 nor 1, and ids without a document, take no part.
    """
    seen = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    return stats.where(crc32_of_id(F.col("doc_id")) % 5 != 0).join(seen, "doc_id").select("label", "stats")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(crc32_of_id(F.col(doc_id)) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, text) and labels (doc_id, quality) -> doc_id, held_out, score, predicted; one row for each document.

    Null and empty texts have zero statistics and still get a score; a null id is in no fold and never trains; repeated
    rows are scored alike; without usable labels every score is 0.5. Other columns of either table are not read.
    """
    stats = stash(with_statistics(docs, ["doc_id"]), "quality")
    model = fit(training_rows(stats, labels))
    return score(stats, model, threshold).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the classifier does not reject."""
    stats = stash(with_statistics(docs, ["doc_id"]), "quality")
    model = fit(training_rows(stats, labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = np.array([document_statistics(t) for t in raw(part.column("text"))], float)
                yield part.filter(pa.array(model.scores(x.reshape(-1, len(FEATURES))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
