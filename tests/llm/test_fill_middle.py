import hashlib
import random
import re

import pytest
from helpers import documents, empty, frame, rows_of

from schemahelm.llm import fill_middle, queries


def plain(doc_id, text, seed=7, rate=100, spm=50):
    """The result by lists of lines."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    hexes = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexes[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in fill_middle.MARKS) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def odd_texts(rng):
    made = ["", None, "\n", "\n\n\n", "one line", "a\r\nb\r\n", "é漢\U0001f600\n" * 400, "x" * 5000 + "\n" + "y" * 5000, "has <P> mark\nb", "<<S\n>P>\n<", "a\x00b\nc"]
    made += ["".join(rng.choice("ab é漢\U0001f600<>PSM\n\n") for _ in range(rng.randrange(900))) for _ in range(150)]
    return made


@pytest.mark.parametrize("block", [1, 3, 16, 256])
def test_tree_finds_every_unit_end(block):
    rng = random.Random(block)
    for text in [t for t in odd_texts(rng) if t is not None][:60]:
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        tree = fill_middle.UnitTree(text.encode(), block)
        assert (tree.units, tree.points) == (len(lines), len(text))
        for k in range(len(lines) + 1):
            head = "".join(lines[:k])
            assert tree.end(k) == (len(head.encode()), len(head))


@pytest.mark.parametrize("rate, spm", [(100, 50), (60, 0), (100, 100), (0, 50)])
def test_against_lists_of_lines(spark, rate, spm):
    texts = odd_texts(random.Random(5))
    docs = [*enumerate(texts), (None, "no\nid\nat all\n"), (3, texts[3]), (12, texts[12]), (12, texts[12]), (999, "w\n" * 300_000)]
    got = fill_middle.fill_middle(frame(spark, docs), rate=rate, spm_rate=spm)
    back = got.withColumn("back", fill_middle.restored(got["output"], got["form"]))
    rows = [tuple(r.values()) for r in rows_of(back)]
    key = lambda r: (r[0] is not None, r[0] or 0, r[5])
    assert sorted((r[:6] for r in rows), key=key) == sorted((plain(i, t, 7, rate, spm) for i, t in docs), key=key)
    assert sorted((r[5], r[6]) for r in rows) == sorted((plain(i, t, 7, rate, spm)[5], t or "") for i, t in docs)


def test_query_on_a_whole_table(spark, sf_dir):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = documents(sf_dir)
    want = []
    for i, t in zip(docs["doc_id"].tolist(), docs["text"]):
        r = plain(i, t)
        want.append((*r[:5], sha(r[5]), sha(t or "")))
    assert sorted(tuple(r.values()) for r in rows_of(queries.op11_fill_middle(spark, sf_dir))) == sorted(want)


def test_edges(spark):
    assert rows_of(fill_middle.fill_middle(empty(spark))) == []
    extra = frame(spark, [("k", "a\nb\n", 3, "x")], "doc_id string, text string, n int, output string")
    assert rows_of(fill_middle.fill_middle(extra))[0]["n"] == 2
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "<", "<M>"), ("", "<S>", "<M>"), ("ab", "ba", "c")):
        with pytest.raises(ValueError):
            fill_middle.fill_middle(empty(spark), marks=marks)
