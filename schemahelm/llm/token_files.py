"""Token ids as Arrow files of equal-length sequences.

Documents are sorted by id into shards. A shard is one Arrow stream file whose record batches hold two fixed-size-list
columns: ``ids`` (unsigned integers, as narrow as the vocabulary allows) and ``mask`` (true for a token of a document,
false for the filling of the last sequence). The lists lie back to back in one buffer, so sequence ``i`` of a mapped
file is a slice of memory. A second file beside it, the index, has a row for each document with its place in the shard.

Encoding a piece of text costs far more than looking it up, and words repeat: texts are cut before every single space
that stands between two characters that are no white space. The pre-tokenizer always begins a new word there, so the
ids of the parts, joined, are those of the whole text, and parts seen before come from a bounded cache that lives as long
as the Python worker. Arrow cuts the texts and puts the ids together, so that Python handles the distinct parts of a slice only.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemahelm.llm.common import slices
from schemahelm.llm.parts import LatinWords, joined_ids
from schemahelm.session import scratch_path

#: Sequences in one record batch, tokens in one sequence.
BATCH, LENGTH = 64, 2048
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space that is not one space or line break between two other characters.
_WIDE = r"\A[ \n]|[ \n]\z|[ \n][ \n]|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Parts that are encoded as the lines of one text.
LINES = 2048
#: Bytes of text that are encoded together; each distinct part of them is looked up once.
SLICE = 4 << 20
#: Parts of a worker's cache, about 200 bytes each; its older half goes when the younger one is full.
PARTS = 1_600_000


class Encoder:
    """Ids of whole texts as little-endian bytes of ``dtype``, by looking up parts of text in a cache.

    Tokenizers with another pre-tokenizer than the byte-level one encode whole texts.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        parts = json.loads(self.tokenizer.to_str())
        before = parts["pre_tokenizer"] or {}
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.cuts = (
            parts["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
            and len(self.line) == 1 and not any(x["content"].isalpha() for x in parts["added_tokens"])
        )
        # Ids by part. A part that opens a text or a line has a line break in front, and its id; others follow a space and are kept
        # without it.
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.marks = [x["content"] for x in parts["added_tokens"]]
        if self.cuts:
            opening = np.zeros(max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1, bool)
            opening[[i for word, i in self.tokenizer.get_vocab().items() if word[0] == "Ġ"]] = True
            self.latin = LatinWords(self.tokenizer, opening, opens=True, lead=" ")

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of parts without white space but for one space in front, many of them as the lines of one text.

        A line break before a part is a token of its own, and no such part has its id.
        """
        out: list[bytes] = []
        width = self.dtype.itemsize
        groups = [words[i : i + LINES] for i in range(0, len(words), LINES)]
        for lines, flat in zip(groups, self._bytes(["\n".join(g) for g in groups])):
            ids = np.frombuffer(flat, self.dtype)
            ends = np.flatnonzero(ids == self.line[0])
            if len(ends) != len(lines) - 1:
                out += self._bytes(lines)
                continue
            ends = [-1, *ends.tolist(), len(ids)]
            out += [flat[(a + 1) * width : b * width] for a, b in zip(ends, ends[1:])]
        return out

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """Ids of these parts, which the younger half of the cache does not have yet."""
        line = np.array(self.line, self.dtype).tobytes()
        found = list(map(self.old.get, new))
        groups: tuple[dict[int, str], ...] = ({}, {}, {})
        for i, x in enumerate(new):
            if found[i] is None:
                text = x.decode()
                if LatinWords.fits(text):
                    groups[0][i] = text
                    continue
                lead, bare = ("", text[1:]) if text[:1] == "\n" else (" " if text else "", text)
                groups[1 if bare.split() == [bare] else 2][i] = lead + bare
        latin, words, odd = ([*g.values()] for g in groups)
        made = self.latin.encode(latin, self.dtype)
        for at, ids in zip(groups, (self._words([f" {x}" for x in latin]) if made is None else made, self._words(words), self._bytes(odd))):
            for i, x in zip(at, ids):
                found[i] = line + x if new[i][:1] == b"\n" else x
        self.young.update(zip(new, found))
        return found

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct parts."""
        if len(self.young) > PARTS // 2:
            self.young, self.old = {}, self.young
        found = list(map(self.young.get, parts))
        new = iter(self._learn([x for x, ids in zip(parts, found) if ids is None]))
        return [next(new) if ids is None else ids for ids in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, the end id last."""
        if not self.cuts:
            return [x + self.end for x in self._bytes(texts)]
        whole = pa.array(texts, pa.large_string())
        wide = pc.match_substring_regex(whole, _WIDE)
        # Where all white space is single and between words, line breaks are cuts as well: each is a token of its own, and the
        # word after it has no space in front.
        opened = pc.utf8_replace_slice(whole.filter(pc.invert(wide)), 0, 0, "\n")
        even = pc.split_pattern(pc.replace_substring(opened, "\n", " \n"), " ")
        other = [_CUT.split(t) for t in whole.filter(wide).to_pylist()]
        other = pa.array([[f"\n{p[0]}", *p[1:]] for p in other], pa.list_(pa.large_string()))
        made = [iter(joined_ids(x, self._ids, self._bytes, self.marks)) for x in (even, other)]
        # The line break in front was none of the text.
        width = self.dtype.itemsize
        return [next(made[x])[width:] + self.end for x in wide.to_pylist()]


@lru_cache(maxsize=1)
def _encoder(path: str, end_id: int) -> Encoder:
    """One for each worker: what a task has looked up, the next one knows."""
    return Encoder(path, end_id)


def _writer(sink, length: int, dtype: np.dtype) -> pa.ipc.RecordBatchStreamWriter:
    schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
    return pa.ipc.new_stream(sink, schema)


def _flush(writer, ids: np.ndarray, length: int) -> None:
    """Write ids as sequences; the last is filled up with zeros."""
    n = -(-len(ids) // length)
    full = np.zeros(n * length, ids.dtype)
    full[: len(ids)] = ids
    mask = np.arange(n * length) < len(ids)
    lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (full, mask)]
    writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=pa.schema([("ids", lists[0].type), ("mask", lists[1].type)])))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """(doc_id, text) -> a row for each file: shard, path, n_docs, n_tokens; shards are in ascending order of ids.

    Files are written under another name and moved when they are complete, so a task that runs again leaves the same.
    Documents of one id are ordered by their text's hash. Null texts are empty: they have the end id alone.
    """
    # Sorting by the hash as well splits an id that many rows have.
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    placed = placed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    id_type = pa.int64() if dict(docs.dtypes)["doc_id"] == "bigint" else None

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        encoder = _encoder(tokenizer, end_id)
        path, own = f"{root}/ids-{shard:06d}.arrows", f".{uuid.uuid4().hex}"
        ids_of, n_of, left, at = [], [], np.empty(0, encoder.dtype), 0
        with store.open_output_stream(path + own) as sink, _writer(sink, length, encoder.dtype) as writer:
            for batch in batches:
                for part in slices(batch, limit=SLICE):
                    encoded = encoder.encode(part.column("text").to_pylist())
                    ids_of.append(part.column("doc_id"))
                    n_of.append(np.array([len(x) for x in encoded], np.int64) // encoder.dtype.itemsize)
                    at += int(n_of[-1].sum())
                    left = np.concatenate([left, np.frombuffer(b"".join(encoded), encoder.dtype)])
                    step = BATCH * length
                    while len(left) >= step:
                        _flush(writer, left[:step], length)
                        left = left[step:]
            if len(left):
                _flush(writer, left, length)
        n = np.concatenate(n_of) if n_of else np.empty(0, np.int64)
        index = pa.table({
            "doc_id": pa.chunked_array(ids_of) if ids_of else pa.chunked_array([], id_type or pa.null()),
            "start": pa.array(np.cumsum(n) - n), "n_tokens": pa.array(n),
        })
        with store.open_output_stream(f"{path}.index{own}") as sink, pa.ipc.new_stream(sink, index.schema) as writer:
            writer.write_table(index)
        for name in (path, f"{path}.index"):
            store.move(name + own, name)
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([path]), pa.array([len(n)], pa.int64()), pa.array([at], pa.int64())],
            ["shard", "path", "n_docs", "n_tokens"],
        )

    return placed.select("doc_id", "text").mapInArrow(write, "shard int, path string, n_docs bigint, n_tokens bigint")


class TokenFile:
    """A token file, mapped where the store allows it: ``file[i]`` is sequence ``i`` as (ids, mask) without a copy."""

    def __init__(self, folder: str, path: str):
        store, _ = fs.FileSystem.from_uri(folder)
        source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_stream(path)
        with pa.ipc.open_stream(source) as reader:
            self.batches = list(reader)
        with store.open_input_stream(f"{path}.index") as f, pa.ipc.open_stream(f) as reader:
            self.index = reader.read_all()
        self._first = np.cumsum([0, *(b.num_rows for b in self.batches)])

    def __len__(self) -> int:
        return int(self._first[-1])

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        b = int(np.searchsorted(self._first, i, "right")) - 1
        row = self.batches[b].slice(i - int(self._first[b]), 1)
        return row.column("ids").flatten().to_numpy(), row.column("mask").flatten()

    def documents(self) -> Iterator[tuple[object, int, np.ndarray]]:
        """(doc_id, start in the shard, ids) of each document, batch by batch."""
        have, taken, batches = np.empty(0, np.uint16), 0, iter(self.batches)
        for doc_id, start, n in zip(*(self.index.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens"))):
            parts = []
            while n > len(have) - taken:
                parts.append(have[taken:])
                n -= len(have) - taken
                batch = next(batches)
                ids, mask = batch.column("ids").flatten(), batch.column("mask").flatten()
                have, taken = ids.filter(mask).to_numpy() if mask.false_count else ids.to_numpy(), 0
            parts.append(have[taken : taken + n])
            taken += n
            yield doc_id, start, np.concatenate([p for p in parts if len(p)] or [have[:0]])


def read_token_files(spark: SparkSession, files: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """Files as ``write_token_files`` lists them -> doc_id, start (over all shards), n_tokens, ids_crc32 of each document."""
    listed = files.collect()  # one row for each file
    before = 0
    rows = []
    for r in sorted(listed, key=lambda r: r["shard"]):
        if r["n_docs"]:
            rows.append((r["shard"], r["path"], before))
        before += r["n_tokens"]
    if not rows:
        return spark.createDataFrame([], f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for path, base in zip(pdf["path"], pdf["base"]):
                out = []
                for doc_id, start, ids in TokenFile(folder, path).documents():
                    out.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                        out = []
                yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.createDataFrame(rows, "shard int, path string, base bigint").repartitionByRange(len(rows), "shard")
    return shards.mapInPandas(read, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_index(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH, folder: str | None = None) -> DataFrame:
    """Encode every whole text of (doc_id, text), write the files, read them back; a row for each document.

    Columns: doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32. Null ids come first;
    repeated rows are documents of their own; other columns are not read; an empty table gives no file rows.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    folder = folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder)
    files = write_token_files(docs, folder, tokenizer, end_id, length)
    return read_token_files(spark, files, folder, dict(docs.dtypes)["doc_id"])
