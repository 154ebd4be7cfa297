import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import documents, empty, frame, rows_of, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from schemahelm.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  Two  SPACES ", "tabs\tand\nlines\n\n", "it's WE'LL i'd", "İstanbul ΟΔΟΣ éÅ", "<|endoftext|> x", "<|ENDOFTEXT|> Y", "a<|startoftext|>b", "x" * 5000,
       "émigré Naïve 漢字 かな \U0001f600 ok.", "\x1c fs \x85 nel\xa0nb　wide", "1 22 333.", "end.,. x.. 'y', (z). U.S.A. é. 9,", "\x00 zero"]


def plain_pieces(docs, capacity=4096):
    tok, out = Tokenizer.from_file(PATH), []
    for i, text in docs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            out.append((i, k, at, len(own), zlib.crc32(own.tobytes())))
    return out


def check_places(rows, capacity, length="length"):
    """Sequences of at most the capacity (or one longer row), offsets without a gap; returns their number."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r[length]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity or len(places) == 1
    return len(by)


def test_parts_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 60)  # the cache drops its older half all the time
    tok, encoder = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    assert encoder.by_parts
    rng = random.Random(0)
    texts = ODD + ["".join(rng.choice(" \n\tabE.,é1'$́") for _ in range(rng.randrange(80))) for _ in range(800)]
    for i in range(0, 2 * len(texts), 50):
        own = (texts * 2)[i : i + 50]
        for text, got in zip(own, encoder.encode([t.encode() for t in own])):
            assert np.frombuffer(got, encoder.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_distinct_parts_are_looked_up_once():
    tok, encoder, asked = Tokenizer.from_file(PATH), packing.WordEncoder(PATH), []
    ids = encoder._ids
    encoder._ids = lambda parts: asked.append(parts) or ids(parts)
    texts = ["Stem stem. stem*** (stem stem,\nstem'.;", "stem!! stéM. stéM stem###### a<|endoftext|>. 9."] * 50
    got = encoder.encode([t.encode() for t in texts])
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    # Marks at the end make no other part, and copies none at all.
    assert len(asked) == 1 and len(asked[0]) == len(set(asked[0]))
    assert asked[0].count(b"stem") == 1 and b"stem." not in encoder.young and b"stem***" not in encoder.young


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    assert not encoder.by_parts
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode([t.encode() for t in ODD])] == [tok.encode(t, add_special_tokens=False).ids for t in ODD]


def test_query_on_a_whole_table(spark, sf_dir):
    docs = documents(sf_dir)
    want = plain_pieces(zip(docs["doc_id"].tolist(), docs["text"]))
    got = rows_of(queries.op12_pack(spark, sf_dir))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    least = -(-sum(r[3] for r in want) // 4096)
    assert check_places(got, 4096) <= least + 1


def test_many_cells(spark):
    rng = random.Random(4)
    rows = [(rng.choice([rng.randrange(1, 4097), rng.randrange(1, 700), 4096, 1]), i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "length int, id int").repartition(4)
    got = rows_of(packing.pack(df, cell=200, crossings=30))
    assert sorted((r["length"], r["id"]) for r in got) == sorted(rows)
    assert check_places(got, 4096) <= 1.004 * sum(n for n, _ in rows) / 4096 + 1


def test_large_and_equal_pieces(spark):
    df = spark.createDataFrame([(60,)] * 150 + [(33,)] * 300 + [(100,)] * 5 + [(130,), (None,)], "length int")
    got = rows_of(packing.pack(df, capacity=100, cell=100))
    placed = [r for r in got if r["length"] is not None]
    assert len(got) == 457 and [r["sequence_id"] for r in got if r["length"] is None] == [None]
    # A 33 beside each 60 and the rest by threes, but for what the five cells cannot share.
    assert 150 + 50 + 6 <= check_places(placed, 100) <= 150 + 50 + 6 + 5


def test_bound_and_crossing():
    sizes = np.array([60] * 5 + [40] * 3 + [30])
    assert packing.lower_bound(sizes, 100) == 5 and packing.lower_bound(np.array([51] * 4), 100) == 4
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 90, 300)
    a, b = packing.founders(rng, sizes, 100, 2)
    for _ in range(30):
        child = packing.crossed(rng, a, b, sizes, 100)
        fills = np.bincount(child, sizes)
        assert fills.sum() == sizes.sum() and fills.max() <= 100 and fills.min() > 0
    first = packing.fitness(a, sizes)
    assert packing.fitness(packing.evolve(rng, [a, b], sizes, 100, 0, 200)[0], sizes) < first


def test_sequences_hold_the_documents(spark):
    docs = [(i, " ".join(words(random.Random(i), 40))) for i in range(60)] + [(100, " ".join(words(random.Random(0), 900))), (700, None)]
    packed = packing.pack(packing.pieces(frame(spark, docs), PATH, capacity=256, ids=True), capacity=256).cache()
    whole = {r["sequence_id"]: np.frombuffer(bytes(r["ids"]), "<u4") for r in rows_of(packing.sequences(packed))}
    found = {}
    for r in sorted(rows_of(packed), key=lambda r: r["piece"]):
        own = whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        found.setdefault(r["doc_id"], []).extend(own.tolist())
    tok = Tokenizer.from_file(PATH)
    docs = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in docs}
    assert found == docs and max(map(len, whole.values())) <= 256


def test_edges(spark):
    assert rows_of(packing.pack(packing.pieces(empty(spark), PATH))) == []
    docs = [(1, None), (2, ""), (None, "no id"), (3, "same"), (3, "same")]
    got = rows_of(packing.pack(packing.pieces(frame(spark, docs), PATH)))
    assert sorted(r["length"] for r in got) == [1, 1, 2, 2, 3] and check_places(got, 4096) == 1
    extra = frame(spark, [(1, "a", 2, 3)], "doc_id bigint, text string, offset int, size int")
    packed = packing.pack(extra.withColumn("length", F.lit(5)))
    assert packed.columns == ["doc_id", "text", "size", "length", "sequence_id", "offset"] and rows_of(packed)[0]["offset"] == 0


@pytest.mark.parametrize("capacity", [1, 2])
def test_tiny_sequences(spark, capacity):
    got = rows_of(packing.pack(packing.pieces(frame(spark, [(1, "a b c"), (2, None)]), PATH, capacity=capacity), capacity=capacity))
    assert sum(r["length"] for r in got) == 5 and check_places(got, capacity) == (5 if capacity == 1 else 3)
