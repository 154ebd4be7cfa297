import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from helpers import documents, empty, frame, rows_of, words
from pyspark.sql import functions as F

from schemahelm.llm import components as components_module
from schemahelm.llm import near_dup
from schemahelm.llm.bitmap import bitmap, has_bits
from schemahelm.llm.common import stash
from schemahelm.llm.components import components


def brute_force(docs: list[tuple[int, str | None]], k: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (size of the set, least reachable id), by an index over all shingles and all pairs of each."""
    sets = {}
    for i, text in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = {p for v in inverted.values() for p in combinations(sorted(v), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def assert_same(spark, docs, k):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(near_dup.near_duplicates(frame(spark, docs), k))}
    assert got == brute_force(docs, k)


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = documents(sf_dir)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(near_dup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4))}
    assert got == brute_force(list(zip(docs.doc_id, docs.text)), 4)


def test_chains_short_texts_and_a_shared_passage(spark):
    rng = random.Random(3)
    docs: list[tuple[int, str | None]] = []
    base = words(rng, 300, 10**6)
    # A chain: neighbours are linked, ends are not.
    for step in range(12):
        for i in range(4):
            base[(step * 25 + i * 6) % 300] = f"new{step}x{i}"
        docs.append((len(docs) + 100, " ".join(base)))
    # Many near copies of one short text, and a passage that unlike texts share.
    short, passage = words(rng, 40, 10**6), words(rng, 50, 10**6)
    for _ in range(60):
        copy = list(short)
        copy[rng.randrange(40)] = f"c{rng.random()}"
        docs.append((len(docs) + 100, " ".join(copy)))
        docs.append((len(docs) + 100, " ".join(words(rng, 30, 10**6) + passage + words(rng, rng.randrange(60), 10**6))))
    # Sets of four and five shingles.
    docs += [(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, "A B  c\td e f g"), (4, "x y"), (5, "X y"), (6, "x y z")]
    docs += [(7, None), (8, ""), (9, " \n "), (10, None)]
    assert_same(spark, docs, 4)


@pytest.mark.parametrize("rounds", [0, 1])
def test_rare_values_find_what_centres_leave(spark, monkeypatch, rounds):
    monkeypatch.setattr(near_dup, "ROUNDS", rounds)
    monkeypatch.setattr(near_dup, "SHORT", 1)
    rng = random.Random(5)
    docs = []
    for group in range(3):
        base = words(rng, 120, 10**6)
        for n in range(15):
            copy = list(base)
            for _ in range(1 + n % 5):
                copy[rng.randrange(120)] = f"c{rng.random()}"
            docs.append((len(docs), " ".join(copy)))
    assert_same(spark, docs, 4)


def test_runs_are_certain_for_sets_within_the_sketch(spark):
    """Any two sets at the threshold share a list key as long as both are whole sketches."""
    rng = np.random.default_rng(1)
    for shared in range(4, 50):
        for _ in range(20):
            values = np.unique(rng.integers(0, 2**63, shared + shared // 4).astype(np.uint64))
            own = np.zeros(len(values), int)
            apart = rng.permutation(len(values))[: shared // 4]
            own[apart] = rng.integers(1, 3, len(apart))
            keys = []
            for side in (1, 2):
                s = values[(own == 0) | (own == side)]
                got = set(near_dup.shingle_hashes(s, 3)) if len(s) >= 5 else set()
                keys.append(got | (set(near_dup.shingle_hashes(s, 2)) if len(s) <= 5 else set()))
            assert keys[0] & keys[1]


def test_null_and_repeated_rows(spark):
    text = "one two three four five six seven eight nine"
    rows = [(None, text), (5, text), (5, text), (3, text), (None, "quite another text with its own words here and there")]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in rows_of(near_dup.near_duplicates(frame(spark, rows), 4))), key=repr)
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (None, 3, False), (None, None, True)]


def test_empty_table_and_extra_columns(spark):
    assert rows_of(near_dup.near_duplicates(empty(spark), 4)) == []
    docs = frame(spark, [(1, "a b c d e", 0, 7, 9), (2, "a b c d e", 0, 7, 9)], "doc_id bigint, text string, node int, row int, sketch int")
    assert sorted(r["component_id"] for r in rows_of(near_dup.near_duplicates(docs, 4))) == [1, 1]
    kept = near_dup.keep_first(docs, 4)
    assert kept.columns == docs.columns and [r["doc_id"] for r in rows_of(kept)] == [1]


def test_threshold_below_the_bound(spark):
    with pytest.raises(ValueError):
        near_dup.near_duplicates(empty(spark), 4, 70, 100)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["comp"] for r in rows_of(components(spark.createDataFrame(edges, "u bigint, v bigint")))}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)}


def test_links_between_sets_below_and_above_the_sketch(spark):
    rng = random.Random(11)
    docs: list[tuple[int, str | None]] = []
    for n, cut in [(64, 1), (65, 1), (68, 4), (72, 8), (75, 14), (79, 15), (80, 16), (81, 17), (80, 17), (60, 8), (90, 15)]:
        base = words(rng, n + 3, 10**9)
        docs += [(len(docs), " ".join(base)), (len(docs) + 1, " ".join(base[: n + 3 - cut]))]
    assert_same(spark, docs, 4)


def test_stars_take_one_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components_module, "stash", lambda df, name: written.append(name) or stash(df, name))
    edges = [(i, 5) for i in range(6, 40)] + [(i, 50) for i in range(51, 60)] + [(7, 5), (5, 5)]
    got = {r["node"]: r["comp"] for r in rows_of(components(spark.createDataFrame(edges, "u bigint, v bigint")))}
    assert got == {i: 5 if i < 50 else 50 for i in [*range(5, 40), *range(50, 60)]}
    assert len(written) == 1


def test_bitmap_is_gathered_in_one_job(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.sparkContext.setJobGroup("bits", "bits")
    try:
        rows = spark.range(2000).withColumn("h", F.xxhash64("id"))
        bits = bitmap(rows, F.col("h"))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("bits"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    assert has_bits(bits.value, np.array([r["h"] for r in rows.collect()], np.int64)).all()
    assert 0 < jobs < 16
