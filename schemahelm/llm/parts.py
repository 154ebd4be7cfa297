"""Token ids of many texts by their distinct parts, so that Python touches a part once for each slice of text."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

#: Marks, and Latin letters as a regular expression names them.
_MARKS = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
_LETTERS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
#: Marks that are cut off at the end of a part, at most.
_TAIL = 4
#: Words that are encoded as one text; few, as each starts with its part of the whole.
LINES = 128


def joined_ids(
    parts: pa.Array, ids_of: Callable[[list[bytes]], list[bytes]], tails_of: Callable[[list[str]], list[bytes]], whole: list[str]
) -> list[bytes]:
    """Lists of parts of text -> the ids of each list's parts, back to back.

    ``ids_of`` is asked once for each distinct part. Marks that end a part, after a Latin letter, are a word of their own: their ids
    come from ``tails_of``, unless the part holds one of the texts ``whole``.
    """
    words = parts.flatten().dictionary_encode()
    if not len(words):
        return [b""] * len(parts)
    distinct, empty = words.dictionary, pa.scalar(b"", pa.large_binary())
    stems, flat = pc.ascii_rtrim(distinct, _MARKS), distinct.cast(pa.large_binary())
    marks = pc.subtract(pc.binary_length(distinct), pc.binary_length(stems))
    cut = pc.and_(pc.less_equal(marks, _TAIL), pc.match_substring_regex(stems, rf"[{_LETTERS}]\z"))
    for x in whole:
        cut = pc.and_not(cut, pc.match_substring(distinct, x))
    stems, tails = pc.if_else(cut, stems, distinct).dictionary_encode(), pa.repeat(empty, len(distinct))
    for n in range(1, _TAIL + 1):
        tails = pc.if_else(pc.and_(cut, pc.equal(marks, n)), pc.binary_slice(flat, -n), tails)
    tails = tails.dictionary_encode()
    of_stems = pa.array(ids_of(stems.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
    of_tails = pa.array(tails_of([x.decode() for x in tails.dictionary.to_pylist()]), pa.large_binary())
    each = pc.binary_join_element_wise(of_stems.take(stems.indices), of_tails.take(tails.indices), empty)
    ids = each.take(words.indices)
    ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[parts.offsets.to_numpy()].tolist()
    data = ids.buffers()[2].to_pybytes()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


class LatinWords:
    """Ids of words of Latin letters by a tokenizer's model alone: no other step of a byte-level tokenizer would change or cut them.

    The words come in lower case if the tokenizer lower-cases. ``edges`` tells which tokens begin (``opens``) or end a word.
    """

    def __init__(self, tokenizer: Tokenizer, edges: np.ndarray, opens: bool, lead: str = ""):
        own = json.loads(tokenizer.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
        self.tokenizer = Tokenizer.from_str(json.dumps(own))
        self.edges, self.opens = edges, opens
        # Bytes as the letters that stand for them in the vocabulary: printable ones are themselves, the others follow each other.
        alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
        others = iter([c for c in alphabet if ord(c) > 255])
        self.letters = {b: chr(b) if chr(b) in alphabet else next(others) for b in range(256)}
        self.lead = self._mapped(lead)

    def _mapped(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.letters)

    @staticmethod
    def fits(word: str) -> bool:
        return word.isalpha() and (word.isascii() or max(word) < "ɐ")

    def encode(self, words: list[str], dtype: np.dtype) -> list[bytes] | None:
        """Ids of each word, the lead in front; None if they cannot be told apart."""
        out: list[bytes] = []
        width, lead = dtype.itemsize, self.lead
        mapped = [lead + (w if w.isascii() else self._mapped(w)) for w in words]
        groups = [" ".join(mapped[i : i + LINES]) for i in range(0, len(mapped), LINES)]
        for at, e in zip(range(0, len(words), LINES), self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)):
            ids = np.array(e.ids, dtype)
            flat, edges = ids.tobytes(), np.flatnonzero(self.edges[ids])
            if len(edges) != min(LINES, len(words) - at):
                return None
            ends = [*(edges * width).tolist(), len(flat)] if self.opens else [0, *((edges + 1) * width).tolist()]
            out += [flat[a:b] for a, b in zip(ends, ends[1:])]
        return out
