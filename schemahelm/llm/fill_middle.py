"""Fill-in-the-middle transformation of whole texts, cut at units.

A text is laid out as fixed blocks of its UTF-8 bytes. Two Fenwick trees over the blocks hold how many units end and how many
code points begin in each. The end of the k-th unit is found by binary lifting: the descent skips the longest stretch of
blocks that holds fewer than k unit ends, with the code points of what it skips, and the boundary is then located inside
one block. Only the two cuts of a text are ever looked up, and no list of its units is made.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemahelm.llm.common import raw, slices

#: Bytes of a block.
BLOCK = 256
#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")


class UnitTree:
    """Fenwick trees over the blocks of a text: ends of units (line breaks) and starts of code points."""

    def __init__(self, text: bytes, block: int = BLOCK):
        self.text, self.block = np.frombuffer(text, np.uint8), block
        starts = np.arange(0, len(text), block)
        self.size = 1 << max(len(starts) - 1, 0).bit_length()
        self.sums = np.zeros((2, self.size + 1), np.int64)
        if len(starts):
            self.sums[0, 1 : len(starts) + 1] = np.add.reduceat(self.text == 10, starts, dtype=np.int64)
            self.sums[1, 1 : len(starts) + 1] = np.add.reduceat(self._leads(self.text), starts, dtype=np.int64)
        # The last unit may lack its line break.
        self.units = int(self.sums[0].sum()) + (len(text) > 0 and text[-1] != 10)
        self.points = int(self.sums[1].sum())
        step = 1
        while step < self.size:
            at = np.arange(2 * step, self.size + 1, 2 * step)
            self.sums[:, at] += self.sums[:, at - step]
            step *= 2

    @staticmethod
    def _leads(part: np.ndarray) -> np.ndarray:
        return (part & 0xC0) != 0x80

    def end(self, k: int) -> tuple[int, int]:
        """(byte, code points before it) where the ``k``-th unit ends."""
        if k <= 0:
            return 0, 0
        if k >= self.units:
            return len(self.text), self.points
        at, points, step = 0, 0, self.size
        while step:
            if at + step <= self.size and self.sums[0, at + step] < k:
                at += step
                k -= int(self.sums[0, at])
                points += int(self.sums[1, at])
            step //= 2
        part = self.text[at * self.block : (at + 1) * self.block]
        here = int(np.flatnonzero(part == 10)[k - 1]) + 1
        return at * self.block + here, points + int(np.count_nonzero(self._leads(part[:here])))


def _marks(marks: tuple[str, str, str]) -> tuple[bytes, bytes, bytes]:
    """The marks as bytes; one that begins as another ends could not be found again for certain."""
    p, s, m = (x.encode() for x in marks)
    for a in (p, s, m):
        for b in (p, s, m):
            inside = a in b and a is not b
            if not a or inside or any(a[:i] == b[-i:] for i in range(1, min(len(a), len(b)) + (a is not b))):
                raise ValueError(f"marks must be distinct and must not overlap: {marks}")
    return p, s, m


def rearrange(
    text: bytes, draws: tuple[int, int, int, int], rate: int, spm_rate: int, marks: tuple[bytes, bytes, bytes]
) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, prefix_chars, middle_chars, output) of one text."""
    p, s, m = marks
    tree = UnitTree(text)
    n = tree.units
    if not text or any(x in text for x in marks) or draws[2] % 100 >= rate:
        return n, "plain", None, None, text
    (a, before), (b, upto) = map(tree.end, sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    form = "spm" if draws[3] % 100 < spm_rate else "psm"
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    parts = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    return n, form, before, upto - before, b"".join(parts)


def fill_middle(
    docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """(doc_id, text) -> doc_id, n (lines), form, prefix_chars, middle_chars, output; one row for each row.

    ``rate`` percent of the texts are cut at two seeded line ends into prefix, middle and suffix; ``spm_rate`` percent of these
    have the suffix first (spm), the others the prefix (psm). Draws come from a hash of the seed and the id, so runs agree
    and repeated rows have one result. Null and empty texts, and texts that contain a mark, stay as they are (plain, no
    counts); a null id draws as an empty one. Other columns are not read.
    """
    as_bytes = _marks(marks)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out: list[list] = [[], [], [], [], []]
                for key, text in zip(part.column("key").to_pylist(), raw(part.column("text"))):
                    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
                    draws = tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))
                    for column, value in zip(out, rearrange(text, draws, rate, spm_rate, as_bytes)):
                        column.append(value)
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                made = [pa.array(x, t) for x, t in zip(out, types)]
                made[-1] = made[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *made], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
                )

    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(
        compute, f"doc_id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    parts = F.split(output, "|".join(re.escape(x) for x in marks), -1)
    prefix, suffix = (F.when(form == "psm", parts[i]).otherwise(parts[j]) for i, j in ((1, 2), (2, 1)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))
