import random
import zlib
from collections import defaultdict

import pytest
from helpers import documents, empty, frame, rows_of, words

from schemahelm.llm import kd_shards


def check(got, docs, shards):
    """Sizes, checksums, gapless slots; returns bytes by shard."""
    assert len(got) == len(docs)
    slots, weight = defaultdict(list), defaultdict(int)
    want = sorted((str(d[0]), len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in docs)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        weight[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return weight


def test_whole_table_is_cut_evenly(spark, sf_dir):
    docs = documents(sf_dir)
    rows = list(zip(docs.doc_id, docs.text))
    weight = check(rows_of(kd_shards.shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))), rows, 16)
    whole, largest = sum(weight.values()), max(len(t.encode()) for t in docs.text)
    assert set(weight) == set(range(16)) and max(weight.values()) - whole / 16 <= largest


def test_equal_texts_stay_together_and_a_hot_group_is_split(spark):
    rng = random.Random(6)
    hot = " ".join(words(rng, 120))
    docs = [(i, hot if i % 3 == 0 else " ".join(words(rng, rng.randrange(20, 120))), rng.choice(["en", "de", None]), rng.choice("abc")) for i in range(900)]
    docs += [(2000 + i, docs[1 + 3 * (i // 2)][1], "fr", "zz") for i in range(80)]
    got = rows_of(kd_shards.shard(frame(spark, docs), 8))
    weight = check(got, docs, 8)
    mean = sum(weight.values()) / 8
    assert all(abs(w - mean) < 0.05 * mean for w in weight.values())
    homes = defaultdict(set)
    for r in got:
        homes[r["text_crc32"], r["size"]].add(r["shard"])
    spread = [k for k, v in homes.items() if len(v) > 1]
    assert spread == [(zlib.crc32(hot.encode()), len(hot) + 1)]


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_any_number_of_leaves(spark, shards):
    docs = [(i, "x" * (i % 50), "en", f"s{i % 4}") for i in range(300)]
    weight = check(rows_of(kd_shards.shard(frame(spark, docs), shards)), docs, shards)
    assert max(weight.values()) - min(weight.values()) <= 0.1 * sum(weight.values()) / shards + 100


def test_edge_cases(spark):
    assert rows_of(kd_shards.shard(empty(spark))) == []
    docs = [(None, None, None, None), (1, "", None, "a"), (1, "", None, "a"), (2, "äö€", "de", None)]
    check(rows_of(kd_shards.shard(frame(spark, docs), 2)), docs, 2)
    extra = frame(spark, [(1, "a", "en", "s", 3, 4)], "doc_id bigint, text string, lang string, source string, shard int, w int")
    assert len(rows_of(kd_shards.shard(extra))) == 1
    by_bytes = rows_of(kd_shards.shard(frame(spark, [(i, "x" * 99) for i in range(40)]), target_bytes=1000))
    assert {r["shard"] for r in by_bytes} == set(range(4))
