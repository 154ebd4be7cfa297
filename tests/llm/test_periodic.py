import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import documents, empty, frame, rows_of

from schemahelm.llm import periodic, queries


def plain_runs(w, least=6, exponent=4):
    """Every maximal stretch of every period, those with a smaller period left out."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        same = [i for i in range(len(w) - q) if w[i] == w[i + q]]
        for k, s in enumerate(same):
            if k and same[k - 1] == s - 1:
                continue
            e = k
            while e + 1 < len(same) and same[e + 1] == same[e] + 1:
                e += 1
            end = same[e] + 1 + q
            if end - s >= max(least, exponent * q) and not any(s0 <= s and end <= e0 and q0 < q for s0, e0, q0 in out):
                out.append((s, end, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_rows(doc_id, text, loops=True):
    """The query's row of one document."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if loops and h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    dropped = {i for s, e, q in runs for i in range(s + q, e)}
    best = (None,) * 3
    for s, e, q in runs:
        if best[0] is None or (e - s) * best[2] > best[1] * q:
            best = (s, e - s, q)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    return (doc_id, len(runs), *best, milli, sha(listed), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def repetitive(rng, n, k):
    w = []
    while len(w) < n:
        unit = [f"w{rng.randrange(k)}" for _ in range(rng.randrange(1, 10))]
        w += unit * rng.choice([1, 1, 2, 3, 4, 5, 9]) + unit[: rng.randrange(len(unit) + 1)]
    return w * rng.choice([1, 1, 1, 4])


@pytest.mark.parametrize("seed", range(4))
def test_grammar_derives_its_words(seed):
    rng = random.Random(seed)
    for _ in range(50):
        words = [rng.randrange(5) for _ in range(rng.randrange(1, 200))] * rng.choice([1, 2, 5])
        g = periodic.re_pair(words)
        spell = lambda x: [x] if x < g.first else [y for part in g.rules[x - g.first] for y in spell(part)]
        assert [y for x in g.start for y in spell(x)] == words
        for i in range(len(g.rules)):
            x = g.first + i
            assert words[g.place[x] : g.place[x] + g.size[x]] == spell(x)
        # No pair is left that occurs twice without overlap, but for three equal symbols in a row.
        seen = {}
        for i, pair in enumerate(zip(g.start, g.start[1:])):
            assert pair not in seen or seen[pair] == i - 1, pair
            seen.setdefault(pair, i)


@pytest.mark.parametrize("least, exponent", [(6, 4), (5, 4), (9, 5)])
def test_runs_against_brute_force(least, exponent):
    rng = random.Random(least)
    for _ in range(250):
        w = repetitive(rng, rng.randrange(1, 90), rng.choice([1, 2, 3, 6]))
        ids = {}
        numbers = [ids.setdefault(x, len(ids)) for x in w]
        want = plain_runs(w, least, exponent)
        assert periodic.runs_by_grammar(numbers, least, exponent) == want
        raw = [x.encode() for x in w]
        assert periodic._batch_runs([raw, [], raw[:3], raw], least, exponent) == [want, [], plain_runs(w[:3], least, exponent), want]


def test_long_periods_and_long_runs():
    rng = random.Random(3)
    unit = [rng.randrange(3000) for _ in range(2500)]
    assert periodic.runs_by_grammar([9000, *unit * 7, 9001]) == [(1, 17_501, 2500)]
    assert periodic.runs_by_grammar([4] * 200_000) == [(0, 200_000, 1)]
    noise = [rng.randrange(2) for _ in range(3000)]
    assert periodic.runs_by_grammar(noise * 4) == plain_runs(noise * 4)


def test_stretches_keep_every_run():
    rng = random.Random(9)
    texts = [[f"n{rng.randrange(40)}" for _ in range(200)] + repetitive(rng, 40, 3) for _ in range(20)]
    flat = [x for t in texts for x in t]
    ids = {x: i for i, x in enumerate(dict.fromkeys(flat))}
    text = np.repeat(np.arange(20), [len(t) for t in texts])
    parts = periodic.stretches(np.array([ids[x] for x in flat]), text)
    begin = 0
    for t in texts:
        for s, e, _ in plain_runs(t):
            assert any(a <= begin + s and begin + e <= b for a, b in parts)
        begin += len(t)
    assert sum(b - a for a, b in parts) < len(flat)


def test_query_on_a_whole_table(spark, sf_dir):
    docs = documents(sf_dir)
    want = [plain_rows(i, t) for i, t in zip(docs["doc_id"].tolist(), docs["text"])]
    got = [tuple(r.values()) for r in rows_of(queries.op13_periodic_runs(spark, sf_dir))]
    assert sorted(got) == sorted(want)
    assert sum(r[1] for r in got) > 10


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n\t "), (None, "a b " * 9), (5, "x y z " * 5), (5, "x y z " * 5), (6, "é漢 b é漢 b " * 4), (7, "q " * 50_000)]
    got = rows_of(periodic.periodic_runs(frame(spark, docs)))
    by = {(r["doc_id"], r["n_words"]): r for r in got}
    assert len(got) == len(docs) and sum(r["doc_id"] == 5 for r in got) == 2
    assert by[1, 0]["runs"] == by[3, 0]["runs"] == [] and by[2, 0]["strongest"] is None and by[1, 0]["collapsed"] == ""
    assert by[None, 18]["strongest"].asDict() == {"start": 0, "length": 18, "period": 2} and by[None, 18]["collapsed"] == "a b"
    assert by[6, 8]["collapsed"] == "é漢 b" and by[7, 50_000]["collapsed"] == "q"
    assert rows_of(periodic.periodic_runs(empty(spark))) == []
    assert rows_of(periodic.with_loops(frame(spark, [(None, "a b"), (1, None), (2, "  ")]))) != []
    extra = frame(spark, [(1, "a a a a a a", 3, 4)], "doc_id bigint, text string, start int, runs int")
    assert rows_of(periodic.periodic_runs(extra))[0]["collapsed"] == "a"
    with pytest.raises(ValueError):
        periodic.periodic_runs(empty(spark), exponent=3)
