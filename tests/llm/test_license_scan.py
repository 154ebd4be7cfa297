import math
import random
from collections import Counter

import pytest
from helpers import empty, frame, rows_of

from schemahelm.llm import license_scan

FILES = "path string, text string, cosine int"
PROSE = "\n".join(f"some line number {i} of plain prose about this and that and the work under way" for i in range(30))


def scan(spark, rows):
    files = frame(spark, [(p, t, 1) for p, t in rows], FILES).drop("cosine")
    return {r["path"]: (r["licence"], r["origin"], r["licence_path"]) for r in rows_of(license_scan.scan(files))}


@pytest.mark.parametrize("name", list(license_scan.TEMPLATES))
def test_headers_are_found_anywhere(spark, name):
    for text in license_scan.TEMPLATES[name]:
        # A template may name the licence of another's header; the named one is the best.
        got = scan(spark, [("/a/x.py", f"{PROSE}\n# {text}\n{PROSE}"), ("/a/y.py", PROSE), ("/a/z.c", f"/* {text.upper()} */")])
        assert got == {"/a/x.py": (name, "header", None), "/a/y.py": (None, "none", None), "/a/z.c": (name, "header", None)}


def test_nearest_ancestor_wins(spark):
    mit, gpl = license_scan.TEMPLATES["MIT"][0], license_scan.TEMPLATES["GPL-3.0"][0]
    got = scan(spark, [
        ("/p/LICENSE", mit), ("/p/src/a.c", PROSE), ("/p/src/vendor/COPYING.txt", gpl), ("/p/src/vendor/deep/er/b.c", PROSE),
        ("/p/src/vendor/c.c", "// Licensed under CC BY-NC 4.0."), ("/q/d.c", PROSE), ("/p/license", PROSE), ("/px/e.c", PROSE), ("f.c", PROSE), ("p/g.c", ""),
    ])
    assert got == {
        "/p/LICENSE": ("MIT", "licence_file", None), "/p/src/a.c": ("MIT", "inherited", "/p"), "/p/src/vendor/COPYING.txt": ("GPL-3.0", "licence_file", None),
        "/p/src/vendor/deep/er/b.c": ("GPL-3.0", "inherited", "/p/src/vendor"), "/p/src/vendor/c.c": ("CC-BY-NC-4.0", "header", None),
        "/q/d.c": (None, "none", None), "/p/license": ("MIT", "inherited", "/p"), "/px/e.c": (None, "none", None), "f.c": (None, "none", None),
        "p/g.c": ("MIT", "inherited", "/p"),
    }


def test_two_licence_files_and_a_root_file(spark):
    mit, gpl = license_scan.TEMPLATES["MIT"][0], license_scan.TEMPLATES["GPL-3.0"][0]
    got = scan(spark, [("/d/LICENSE", mit), ("/d/COPYING", gpl), ("/d/x", None), ("/LICENSE", gpl), ("/y", "")])
    assert got["/d/x"][0] == "GPL-3.0" and got["/y"] == ("GPL-3.0", "inherited", "/")  # equal cosines: the first name


def test_edge_cases(spark):
    rows = [(None, license_scan.TEMPLATES["MIT"][0], 5), (None, None, 5), ("", "x", 5), ("/", "", 5), ("/a/b", "x", 5), ("/a/b", "x", 5), ("/a/c", "word " * 200_000, 5)]
    got = rows_of(license_scan.scan(frame(spark, rows, "path string, text string, _dir int")))
    assert len(got) == len(rows) and all(r["_dir"] == 5 for r in got)
    assert sorted((r["licence"] or "") for r in got) == [""] * 6 + ["MIT"]
    assert rows_of(license_scan.scan(empty(spark, "path string, text string"))) == []


def test_the_gate_drops_no_match():
    """With and without the rare-term gate, files get the same licence."""
    counts = {t.decode(): 900 for t in license_scan.template_terms() if t in (b"the", b"of", b"this", b"is", b"under", b"work", b"by")}
    matcher = license_scan.Matcher(1000, counts)
    assert matcher.common_most < 0.6
    open_ = license_scan.Matcher(1000, counts)
    open_.rare = set(open_.idf)
    for texts in license_scan.TEMPLATES.values():
        for t in texts:
            for text in (t, t[: len(t) // 2], PROSE, f"{PROSE}\n{t}"):
                assert matcher.file(text.encode(), 0.6)[1] == open_.file(text.encode(), 0.6)[1]


def test_document_paths(spark):
    docs = frame(spark, [(0, "a"), (1234, "b"), (1200, "c"), (3000, "d", "en", None), (None, "e")])
    got = {r["doc_id"]: r["path"] for r in rows_of(license_scan.document_paths(docs))}
    assert got == {0: "/s0/0/LICENSE", 1234: "/s0/1/12/1234", 1200: "/s0/1/12/LICENSE", 3000: "/unknown/3/LICENSE", None: None}


def test_common_words_on_a_header_weigh_by_their_files(spark):
    """Words that are in most files do not hide a header, whatever the number of files."""
    header = "Released under the quite ordinary everyday MIT License"
    licence_terms = {"released": 0.01, "under": 0.3, "the": 0.9, "mit": 0.01, "license": 0.01}
    for n in (1_000, 10_000_000):
        matcher = license_scan.Matcher(n, {t: int(x * n) for t, x in licence_terms.items()})
        common = {t: matcher.idf_of(n // 2) for t in (b"quite", b"ordinary", b"everyday")}
        found = matcher.candidates(header.encode(), 0.6)
        cosine, licence = matcher.judge(found, common, 0.6)
        assert licence == "MIT" and cosine > 0.9
    # The frequencies are those of the files: the same line among files that have its words, and among others.
    line = "# MIT quite ordinary everyday license"
    cosines = []
    for filler in ("quite ordinary everyday prose", "some other kind of prose"):
        files = frame(spark, [("/x", line, 1), *((f"/f{i}", filler, 1) for i in range(60))], FILES).drop("cosine")
        counts = {bytes(r["term"]): r["n"] for r in license_scan.term_counts(files).collect()}
        assert counts[b""] == 61 and counts[b"quite"] == (61 if "quite" in filler else 1) and counts[b"mit"] == 1
        cosines.append({r["path"]: r["cosine"] for r in rows_of(license_scan.scan(files, 0.3))}["/x"])
    assert cosines[0] > cosines[1] + 0.1


@pytest.mark.parametrize("name", list(license_scan.TEMPLATES))
def test_statements_within_a_line_and_over_many(name):
    """A statement is found in a text without line breaks and wrapped after every second word."""
    matcher = license_scan.Matcher(1000, {t.decode(): 300 for t in license_scan.template_terms() if t in (b"the", b"of", b"this", b"is", b"under", b"work", b"by")})
    prose = PROSE.replace("\n", " ")
    for text in license_scan.TEMPLATES[name]:
        words = text.split()
        wrapped = "".join(f" * {' '.join(words[i : i + 2])}\n" for i in range(0, len(words), 2))
        for whole in (f"{prose} {text} {prose}", f"{PROSE}\n{wrapped}{PROSE}"):
            cosine, licence = matcher.file(whole.encode(), 0.6)
            assert licence == name and cosine > 0.999
    assert matcher.file(prose.encode(), 0.6)[1] is None


def test_windows_are_those_of_brute_force():
    rng = random.Random(3)
    matcher = license_scan.Matcher(1000, {t.decode(): rng.randrange(200) for t in license_scan.template_terms()})
    pool = [t for name in ("MIT", "CC-BY-4.0") for x in license_scan.TEMPLATES[name] for t in license_scan.terms_of(x.encode())]
    for _ in range(40):
        terms = [rng.choice(pool) if rng.random() < 0.5 else f"w{rng.randrange(9)}".encode() for _ in range(60)]
        best = 0.0
        for i, row in enumerate(matcher.rows):
            for a in range(len(terms)):
                for b in range(a + 1, min(a + 2 * matcher.lengths[i], len(terms)) + 1):
                    v = {t: (1 + math.log(n)) * (matcher.idf.get(t) or matcher.idf_of(0)) for t, n in Counter(terms[a:b]).items()}
                    best = max(best, sum(x * row.get(t, 0) for t, x in v.items()) / math.sqrt(sum(x * x for x in v.values())))
        got = matcher.file(b" ".join(terms), 0.6)[0]
        assert abs(got - best) < 1e-9 if best >= 0.6 else got < 0.6


def test_a_cosine_that_was_not_computed_is_null(spark):
    files = frame(spark, [("/a", "plain words", 1), ("/b", None, 1), ("/c", license_scan.TEMPLATES["MIT"][0], 1)], FILES).drop("cosine")
    assert {r["path"]: r["cosine"] for r in rows_of(license_scan.scan(files))} == {"/a": None, "/b": None, "/c": 1.0}


def test_columns_of_any_name(spark):
    schema = "path string, text string, cosine string, licence int, _home int, _parts int, rest int, __row int, `a b` int, `x.y` int"
    rows = [("/a/LICENSE", "This file is licensed under the MIT License.", "old", 1, 2, 7, 3, 4, 5, 6), ("/a/b.c", "int main;", "old", 1, 2, 7, 3, 4, 5, 6)]
    got = license_scan.scan(frame(spark, rows, schema))
    assert got.columns == ["path", "_home", "_parts", "rest", "__row", "a b", "x.y", "cosine", "licence", "origin", "licence_path"]
    assert all((r["_home"], r["_parts"], r["rest"], r["__row"], r["a b"], r["x.y"]) == (2, 7, 3, 4, 5, 6) for r in rows_of(got))
