import hashlib
import random
import re

from helpers import documents, empty, frame, rows_of, words

from schemahelm.llm import decontaminate

ITEMS = "item_id bigint, text string"


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = split(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                met = windows.get(tuple(w[i : i + n]))
                if met:
                    hit.update(range(i, i + n))
                    found |= met
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def report(docs, items):
    got, spans = decontaminate.contamination(docs, items)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r[c] for c in names) for r in rows_of(got)), key=repr), spans


def test_whole_table(spark, sf_dir):
    import pandas as pd

    docs, items = documents(sf_dir), pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    got, _ = report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    want = brute_force(zip(docs.doc_id, docs.text), zip(items.item_id, items.text))
    assert got == want
    assert any(r[5] for r in want)


def test_small_cases(spark):
    rng = random.Random(2)
    long, other = words(rng, 40), words(rng, 13)
    items = [(1, " ".join(long)), (2, "Only, three WORDS"), (3, None), (4, "..."), (10, " ".join(long[5:25])), (7, "loneword"), (7, " ".join(other)), (2, "Only, three WORDS")]
    docs = [
        (1, " ".join(words(rng, 50) + long[3:30] + words(rng, 50))),
        (2, " ".join(long[:12])),  # one word short of a window
        (3, "Said: only three--words, twice: ONLY THREE WORDS! and Loneword"),
        (4, None), (5, ""), (6, "?!"), (None, " ".join(long)), (8, " ".join(long * 3)), (8, " ".join(long * 3)),
        (9, " ".join(words(rng, 3000) + other)), (10, "only three"), (11, " ".join(other[:-1] + ["x"] + other)),
    ]
    got, spans = report(frame(spark, docs), frame(spark, items, ITEMS))
    assert got == brute_force(docs, [x for x in items if x[1]])
    span = [r for r in rows_of(spans) if r["doc_id"] == 1]
    assert {r["item_id"] for r in span} == {"1", "10"} and all(r["length"] == 13 for r in span)


def test_drop_keeps_columns_and_clean_rows(spark):
    docs = frame(spark, [(1, "the exact words of an item are right here in this very line of text", 5), (2, "clean", 6), (2, "clean", 6), (None, None, 7)], "doc_id bigint, text string, row_key int")
    items = frame(spark, [(1, "the exact words of an item are right here in this very line of text")], ITEMS)
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(repr, ((r["doc_id"], r["row_key"]) for r in rows_of(kept)))) == ["(2, 6)", "(2, 6)", "(None, 7)"]


def test_empty_tables(spark):
    got, _ = report(empty(spark), frame(spark, [(1, "a b c")], ITEMS))
    assert got == []
    got, spans = report(frame(spark, [(1, "a b c")]), empty(spark, ITEMS))
    assert got == [(1, 3, 0, 0, hashlib.sha256(b"").hexdigest(), False)] and rows_of(spans) == []
