import math
import random
import zlib
from collections import Counter

from helpers import documents, empty, frame, rows_of

from schemahelm.llm import langid


def test_held_out_accuracy_on_the_tables(spark, sf_dir):
    docs = documents(sf_dir)
    got = {r["doc_id"]: r for r in rows_of(langid.identify(spark.read.parquet(f"{sf_dir}/documents.parquet")))}
    assert len(got) == len(docs)
    right = []
    for i, lang in zip(docs.doc_id, docs.lang):
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if r["held_out"]:
            right.append(r["lang_pred"] == lang)
    assert sum(right) / len(right) >= 0.95


def in_training(n):
    return [i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 != 1][:n]


def test_edge_cases(spark):
    a, b, c, d = in_training(4)
    schema = "doc_id bigint, text string, lang string, lang_pred int"
    rows = [(a, "alpha beta alpha beta", "x", 1), (b, "gamma delta gamma delta", "y", 1), (c, None, "x", 1), (d, "alpha", None, 1), (None, "gamma", "x", 1),
            (5000, "123 ... ", "x", 1), (5000, "123 ... ", "x", 1), (5001, "", "x", 1), (5002, "“—” ١٢", "y", 1), (5003, "GAMMA, Gamma!", "x", 1)]
    got = rows_of(langid.identify(frame(spark, rows, schema)))
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (c, 5000, 5001, 5002))
    assert by[5003]["lang_pred"] == "y" and by[None]["lang_pred"] == "y" and by[None]["held_out"] is False and by[d]["lang_pred"] == "x"
    assert rows_of(langid.identify(empty(spark, schema))) == []
    unlabelled = rows_of(langid.identify(frame(spark, [(1, "words", None, 0)], schema)))
    assert [r["lang_pred"] for r in unlabelled] == ["und"]


def test_runs_of_letters():
    assert langid.tokens_of("Über-Straße 2x ABC") == ["über".encode(), "straße".encode(), b"x", b"abc"]
    assert langid.words_in("naïve—“é".encode()) == ["naïve", "é"]
    # Marks stay with their letters, digits and numerals are none.
    assert langid.words_in("नमस्ते²cafe\u0301、ที่½".encode()) == ["नमस्ते", "cafe\u0301", "ที่"]


def plain(rows, docs):
    """Shares by language of each text, from plain counts of all words and n-grams."""
    grams = lambda w, n: [g for g in (f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)) if g not in "^$"]
    langs = sorted({lang for _, lang in rows})
    counts = {n: {} for n in (0, *langid.GRAMS)}
    for text, lang in rows:
        for w in text.split():
            for n, keys in [(0, [w]), *((n, grams(w, n)) for n in langid.GRAMS)]:
                for k in keys:
                    counts[n].setdefault(k, Counter())[lang] += 1
    whole = {n: {x: sum(c[x] for c in counts[n].values()) for x in langs} for n in counts}
    score = lambda n, k: [math.log((counts[n][k][x] + 0.5) / (whole[n][x] + 0.5 * len(counts[n]))) for x in langs]

    def of(w):
        for n, keys in [(0, [w]), *((n, grams(w, n)) for n in langid.GRAMS)]:
            found = [score(n, k) for k in keys if k in counts[n]]
            if found:
                return [sum(x) / len(found) for x in zip(*found)]
        return [0.0] * len(langs)

    for text in docs:
        total = [sum(x) for x in zip(*map(of, text.split()))]
        share = [math.exp(x - max(total)) for x in total]
        yield langs[share.index(max(share))], max(share) / sum(share)


def test_no_word_or_n_gram_is_cut(spark):
    """Few or many words in memory, rare ones of a small language included: the plain counts decide."""
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 7)))
    rows = [(" ".join(word("abcdefgh") for _ in range(60)), "big") for _ in range(30)] + [(" ".join(word("efghijkl") for _ in range(12)), "small") for _ in range(3)]
    texts = [t for t, _ in rows[-3:]] + [rows[-1][0].split()[0], rows[0][0].split()[5], "zzzz", "efijx lkq"] + [" ".join(word("cdefghij") for _ in range(4)) for _ in range(20)]
    docs = frame(spark, list(enumerate(texts)), "doc_id bigint, text string")
    want = list(plain(rows, texts))
    for most in (0, 50, 100_000):
        tables = langid.count_tables(frame(spark, rows, "text string, lang string"), most)
        assert len(tables.frequent[0]) <= most
        got = {r["doc_id"]: r for r in rows_of(langid.predict(docs, tables, ["doc_id"]))}
        assert [got[i]["lang_pred"] for i in range(len(texts))] == [x for x, _ in want]
        assert all(abs(got[i]["score"] - x) < 1e-9 for i, (_, x) in enumerate(want))
