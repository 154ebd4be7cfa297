import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import empty, frame, rows_of, words
from tokenizers import Tokenizer

from schemahelm.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(docs):
    tok, out, start = Tokenizer.from_file(PATH), [], 0
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


ODD = ["", " ", "  two  spaces ", "tabs\tand\nlines\n\n  indented", "it's  we'll I'd nbsp em", "a　b c", "<|endoftext|> inside <|endoftext|>", "x" * 5000,
       "émigré naïve 漢字 かな \U0001f600 ok", "\x1c fs \x85 nel", " lead", "trail ", "a  b", "1 22 333", "\r\n win \r\n", "end. x, y,. 'z'. U.S.A. é. 9, a.b. ,. . \nq.\n,"]


def test_parts_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(token_files, "PARTS", 60)  # the cache drops its older half all the time
    tok, encoder = Tokenizer.from_file(PATH), token_files.Encoder(PATH, 2)
    rng = random.Random(0)
    texts = ODD + ["".join(rng.choice(" \n\tab.é1'") for _ in range(rng.randrange(60))) for _ in range(500)]
    texts += [" ".join(rng.choice(["ab", "Ab,", "c.", "é,", ",", "9.", "it's,"]) for _ in range(30)) for _ in range(100)]
    for i in range(0, 2 * len(texts), 40):
        own = (texts * 2)[i : i + 40]
        for text, got in zip(own, encoder.encode(own)):
            assert np.frombuffer(got, "<u2").tolist() == [*tok.encode(text, add_special_tokens=False).ids, 2], repr(text)


def test_distinct_parts_are_looked_up_once():
    tok, encoder, asked = Tokenizer.from_file(PATH), token_files.Encoder(PATH, 2), []
    ids = encoder._ids
    encoder._ids = lambda parts: asked.append(parts) or ids(parts)
    texts = ["Stem stem. stem*** stem,\nstem'.; it's. stem", "stem!! stéM. stéM stem###### a<|endoftext|>. 9.\nstem"] * 50
    got = encoder.encode(texts)
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in got] == [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    # Marks at the end make no other part, and copies none at all; the second call is of texts with other white space.
    assert len(asked[0]) == len(set(asked[0])) and sum(map(len, asked[1:])) == 0
    assert asked[0].count(b"stem") == 1 and b"stem." not in encoder.young and b"stem***" not in encoder.young


def test_files_and_report(spark, tmp_path):
    rng = random.Random(1)
    docs = [(i * 3, rng.choice(ODD) + " ".join(words(rng, rng.randrange(300)))) for i in range(120)] + [(1, None), (None, "no id")]
    docs.append((7, " ".join(words(rng, 20_000))))
    got = sorted((tuple(r.values()) for r in rows_of(token_files.token_index(frame(spark, docs), PATH, length=64, folder=str(tmp_path)))), key=lambda r: r[1])
    assert got == plain(docs)
    files = sorted(p for p in tmp_path.iterdir() if p.suffix == ".arrows")
    assert not [p for p in tmp_path.iterdir() if ".index." in p.name]
    tokens = 0
    for p in files:
        f = token_files.TokenFile(f"file://{tmp_path}", str(p))
        for i in range(len(f)):
            ids, mask = f[i]
            assert len(ids) == len(mask) == 64 and (i + 1 == len(f) or mask.false_count == 0)
            tokens += mask.true_count
        if len(f):
            # A view of the mapped file, not a copy.
            assert not f[0][0].flags.owndata and f.batches[0].column("ids").type == token_files.pa.list_(token_files.pa.uint16(), 64)
    assert tokens == sum(r[2] for r in got)


def test_repeated_rows_and_empty_table(spark):
    docs = [(4, "same text"), (4, "same text"), (4, "other")]
    got = rows_of(token_files.token_index(frame(spark, docs), PATH))
    assert sorted(r["n_tokens"] for r in got) == sorted(r[2] for r in plain(docs))
    assert sorted(r["start"] for r in got)[0] == 0
    assert rows_of(token_files.token_index(empty(spark), PATH)) == []
    extra = frame(spark, [(1, "a b", 3, 4)], "doc_id bigint, text string, start int, h int")
    assert [r["n_tokens"] for r in rows_of(token_files.token_index(extra, PATH))] == [plain([(1, "a b")])[0][2]]


@pytest.mark.parametrize("end_id, dtype", [(2, "<u2"), (70_000, "<u4")])
def test_width_follows_the_vocabulary(end_id, dtype):
    assert token_files.Encoder(PATH, end_id).dtype == np.dtype(dtype)
