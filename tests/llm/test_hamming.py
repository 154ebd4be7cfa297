import random

import pytest
from helpers import empty, frame, rows_of

from schemahelm.llm import hamming, queries

CODES = "id bigint, code bigint"


def brute_force(rows, asked, k):
    out = []
    rows = set(rows)
    for q, code in set(asked):
        near = sorted((((code ^ c) & (2**64 - 1)).bit_count(), i) for i, c in rows if i != q)[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


def search(spark, rows, asked, k):
    got = rows_of(hamming.top_k(frame(spark, rows, CODES), frame(spark, asked, CODES), k))
    return sorted((r["query_id"], r["rank"], r["neighbor_id"], r["distance"]) for r in got)


def test_ties_copies_and_clusters_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(hamming, "PROBES", 50)
    rng = random.Random(1)
    codes = [rng.getrandbits(64) - 2**63 for _ in range(60)]
    rows = []
    for i in range(900):
        code = codes[0] if i % 3 == 0 else codes[rng.randrange(60)]
        for _ in range(rng.randrange(6) if i % 3 else 0):
            code ^= 1 << rng.randrange(63)
        rows.append((i, code))
    asked = [r for r in rows if r[0] % 20 == 0]
    assert search(spark, rows, asked, 7) == brute_force(rows, asked, 7)


@pytest.mark.parametrize("n", [1, 5, 1500])
def test_far_neighbours_are_exact(spark, n):
    rng = random.Random(n)
    codes = [rng.getrandbits(64) - 2**63 for _ in range(n)]
    codes += [c ^ 1 << 40 for c in codes] + [c ^ 3 for c in codes]
    rows = list(enumerate(codes))
    assert search(spark, rows, rows[::97], 5) == brute_force(rows, rows[::97], 5)


def test_hot_segment_and_an_outlier(spark):
    rng = random.Random(4)
    rows = [(i, (7 << 48) + rng.getrandbits(12)) for i in range(400)] + [(i, rng.getrandbits(63)) for i in range(400, 600)] + [(600, -1), (601, 0)]
    asked = rows[::50] + rows[600:]
    assert search(spark, rows, asked, 10) == brute_force(rows, asked, 10)


def test_queries_outside_the_index_and_other_columns(spark):
    rows = [(i, i * 977) for i in range(50)]
    vectors = frame(spark, [(i, c, 1, 2) for i, c in rows], "id bigint, code bigint, q int, distance int")
    asked = frame(spark, [(1000, -5, 3), (1001, 1 << 62, 3)], "id bigint, code bigint, found int")
    got = sorted((r["query_id"], r["rank"], r["neighbor_id"], r["distance"]) for r in rows_of(hamming.top_k(vectors, asked, 4)))
    assert got == brute_force(rows, [(1000, -5), (1001, 1 << 62)], 4)


def test_edge_cases(spark):
    rows = [(1, 5), (1, 5), (2, None), (None, 5), (3, 4), (4, -1)]
    assert search(spark, rows, rows, 10) == brute_force([(1, 5), (3, 4), (4, -1)], [(1, 5), (3, 4), (4, -1)], 10)
    assert search(spark, [(1, 5)], [(1, 5)], 3) == []
    assert rows_of(hamming.top_k(empty(spark, CODES), empty(spark, CODES))) == []
    assert rows_of(hamming.top_k(frame(spark, rows, CODES), empty(spark, CODES))) == []


def test_codes_are_signs(spark):
    rng = random.Random(2)
    vectors = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)] + [[0.0] * 64, [1.0] * 64, [1.0] * 3, None]
    got = frame(spark, [(i, v) for i, v in enumerate(vectors)], "id bigint, v array<double>").select("id", hamming.sign_code(hamming.F.col("v")).alias("code"))
    for r in rows_of(got):
        v = vectors[r["id"]]
        want = None if v is None or len(v) != 64 else sum(1 << i for i, x in enumerate(v) if x > 0)
        assert (None if r["code"] is None else r["code"] & (2**64 - 1)) == want


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r["id"], r["code"]) for r in rows_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(hamming.F.col("vec_id").alias("id"), hamming.sign_code(hamming.F.col("embedding")).alias("code")))]
    got = sorted((r["query_id"], r["rank"], r["neighbor_id"], r["distance"]) for r in rows_of(queries.op8_hamming(spark, sf_dir)))
    assert got == brute_force(rows, [r for r in rows if r[0] % 20 == 0], 10)
