import random
import zlib

import numpy as np
import pytest
from helpers import empty, frame, rows_of, words

from schemahelm.llm import quality

LABELS = "doc_id bigint, quality int, toxic int"


def test_held_out_accuracy_on_the_tables(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in rows_of(quality.classify(docs, labels))}
    assert len(got) == docs.count()
    marks = {r["doc_id"]: r["quality"] for r in rows_of(labels)}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [i for i in marks if i in got and got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == marks[i] for i in held]) >= 0.9


def plain_fit(x, y, shrinkage=0.1, ridge=1e-3):
    """The same estimates from the whole matrix."""
    d = x.shape[1]
    center, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale**2 > 1e-12, scale, 1.0)
    z = (x - center) / scale
    covs = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).mean() * covs[c] for c in (0, 1)) + ridge * np.eye(d)
    out = []
    for c in (0, 1):
        a = max(shrinkage, d / (d + (y == c).sum()))
        cov = (1 - a) * covs[c] + a * pooled
        cov = (1 - ridge) * cov + ridge * np.diag(np.maximum(np.diag(cov), ridge)) + ridge * np.eye(d)
        r = z - z[y == c].mean(axis=0)
        out.append(-0.5 * np.einsum("ij,jk,ik->i", r, np.linalg.inv(cov), r) - 0.5 * np.linalg.slogdet(cov)[1])
    odds = np.log(((y == 1).sum() + 1) / ((y == 0).sum() + 1))
    return 1 / (1 + np.exp(-np.clip(out[1] - out[0] + odds, -500, 500)))


def test_fit_from_moments_is_the_plain_fit(spark):
    rng = random.Random(1)
    texts = [" ".join(words(rng, rng.randrange(5, 90))) + ("!! ## %" if i % 3 == 0 else ".") for i in range(200)]
    docs = frame(spark, [(i, t) for i, t in enumerate(texts)])
    stats = quality.with_statistics(docs, ["doc_id"])
    rows = sorted(rows_of(stats), key=lambda r: r["doc_id"])
    x, y = np.array([r["stats"] for r in rows]), np.array([int(i % 3 != 0) for i in range(200)])
    labelled = stats.selectExpr("int(doc_id % 3 != 0) AS label", "stats")
    assert np.allclose(quality.fit(labelled).scores(x), plain_fit(x, y), atol=1e-6)


def test_whole_texts_count():
    start = b"good words here " * 400
    assert quality.document_statistics(start) != quality.document_statistics(start + b"### $$$ " * 50)
    assert quality.document_statistics(b"") == quality.document_statistics(b" \n") == [0.0] * len(quality.FEATURES)
    assert np.isfinite(quality.document_statistics(b"x")).all() and np.isfinite(quality.document_statistics(b"a" * 10**6)).all()


def test_edge_cases(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "text"), (4, "word " * 50_000)]
    odd = frame(spark, [(1, 1, 0), (1, 0, 0), (1, 1, 0), (2, None, 0), (None, 1, 0), (99, 1, 1), (4, 7, 0)], LABELS)
    for labels in (odd, empty(spark, LABELS), frame(spark, [(i, 1, 0) for i in range(5)], LABELS)):
        got = rows_of(quality.classify(frame(spark, rows), labels))
        assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
        assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert all(r["score"] == pytest.approx(0.5) for r in rows_of(quality.classify(frame(spark, rows), empty(spark, LABELS))))
    assert rows_of(quality.classify(empty(spark), odd)) == []
    extra = frame(spark, [(1, "a b", 1, 2.0)], "doc_id bigint, text string, label int, stats double")
    kept = quality.keep_good(extra, empty(spark, LABELS))
    assert kept.columns == extra.columns and len(rows_of(kept)) == 1
