"""Packing of documents' tokens into as few sequences as possible, by a grouping genetic algorithm on islands.

Pieces are dealt into cells of about ``CELL`` pieces by a hash of a row number, so a cell's size does not depend on the
table's. Each cell is packed by several islands: populations of packings, a task row each. A generation crosses two packings by
groups: whole well-filled bins of one are injected into the other, bins of the other that hold a piece twice are dissolved,
and the displaced pieces are put by best fit, largest first. After an epoch the best packing of an island replaces the worst of
the next island in the ring. Cells that meet their lower bound are finished; fitness prefers fewer, then fuller bins.

What a cell cannot fill is left in its emptiest bins; their pieces are dealt anew and packed together, level by level, while
this shrinks them.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from schemahelm.llm.common import raw, slices, stash
from schemahelm.llm.parts import LatinWords, joined_ids

#: Tokens of a sequence; pieces of a cell, on average.
CAPACITY, CELL = 4096, 2000
#: Populations of a cell and packings of each.
ISLANDS, POPULATION = 3, 8
#: Rounds, with a migration between them, and crossings of an island in a round.
EPOCHS, CROSSINGS = 3, 80
#: Bins filled less than this share are packed again with those of other cells.
LOOSE = 0.97
#: Words of a worker's cache before its older half is dropped, about 200 bytes each.
WORDS = 1_600_000
_LINES = 2048
#: Bytes of text that are encoded together; each distinct part of them is looked up once.
SLICE = 8 << 20


class WordEncoder:
    """Ids of whole texts, by looking up parts between white space in a cache that lives as long as the worker.

    This fits tokenizers that drop white space and lower-case; others encode whole texts. Lower-casing the ASCII letters first, a
    text's parts are cut where the pre-tokenizer cuts as well. Parts are cut, counted and put together again by Arrow. New parts
    made of letters are encoded many at a time, told apart by the token that ends a word, and marks at the end of a part are a word of
    their own.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4")
        suffix = parts["model"].get("end_of_word_suffix")
        steps = [x.get("type") for x in (parts["normalizer"] or {}).get("normalizers", [])]
        cut = [x.get("behavior") for x in (parts["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.marks = [x["content"] for x in parts["added_tokens"]]
        self.by_parts = steps == ["NFC", "Replace", "Lowercase"] and cut[:1] == ["Removed"] and bool(suffix) and not any(map(str.isalpha, self.marks))
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.ends[[i for word, i in vocabulary.items() if word.endswith(suffix)]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        if self.by_parts:
            self.latin = LatinWords(self.tokenizer, self.ends, opens=False)

    def _texts(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, many as one text; each has one token that ends a word, its last."""
        out: list[bytes] = []
        width = self.dtype.itemsize
        groups = [words[i : i + _LINES] for i in range(0, len(words), _LINES)]
        for group, ids in zip(groups, self._texts([" ".join(g) for g in groups])):
            ends = (np.flatnonzero(self.ends[np.frombuffer(ids, self.dtype)]) + 1).tolist()
            if len(ends) != len(group):
                out += self._texts(group)
                continue
            out += [ids[a * width : b * width] for a, b in zip([0, *ends], ends)]
        return out

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """Ids of these parts, which the younger half of the cache does not have yet."""
        found = list(map(self.old.get, new))
        groups: tuple[dict[int, str], ...] = ({}, {}, {})
        for i, x in enumerate(new):
            if found[i] is None:
                text = x.decode()
                groups[0 if LatinWords.fits(text) and text.islower() else 1 if text.isalpha() else 2][i] = text
        latin, words, odd = ([*g.values()] for g in groups)
        made = self.latin.encode(latin, self.dtype)
        for at, ids in zip(groups, (self._words(latin) if made is None else made, self._words(words), self._texts(odd))):
            for i, x in zip(at, ids):
                found[i] = x
        self.young.update(zip(new, found))
        return found

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct parts; white space at an end of a text leaves an empty one."""
        if len(self.young) > WORDS // 2:
            self.young, self.old = {}, self.young
        found = list(map(self.young.get, parts))
        new = iter(self._learn([x for x, ids in zip(parts, found) if ids is None]))
        return [next(new) if ids is None else ids for ids in found]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, without an end id."""
        if not self.by_parts:
            return self._texts([t.decode() for t in texts])
        whole = pa.array(texts, pa.large_string())
        cut = pc.ascii_lower(whole)
        for m in self.marks:
            # A mark in other letters is no mark, so such texts keep theirs.
            marked = pc.match_substring(cut, m.lower())
            if marked.true_count:
                cut = pc.if_else(marked, whole, cut)
        return joined_ids(pc.ascii_split_whitespace(cut), self._ids, self._texts, self.marks)


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32 [, ids]: the tokens of whole texts with the end id last.

    Only documents of more than ``capacity`` tokens are cut, the last piece may be shorter. Null and empty texts have the end
    id alone; repeated rows are documents of their own; other columns are not read. ``ids`` adds the ids (unsigned 32-bit,
    little-endian).
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                of, out = [], [[], [], [], [], []]
                for i, words in enumerate(encoder.encode(raw(part.column("text")))):
                    whole = np.frombuffer(words, encoder.dtype).astype("<u4").tobytes() + end
                    for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                        own = whole[at : at + 4 * capacity]
                        of.append(i)
                        for column, value in zip(out, (k, at // 4, len(own) // 4, zlib.crc32(own), own)):
                            column.append(value)
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ["piece", "start", "length", "ids_crc32", "ids"][: 5 if ids else 4]
                made = [pa.array(x, t) for x, t, _ in zip(out, types, names)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(of, pa.int64())), *made], ["doc_id", *names])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if ids else "")
    return docs.select("doc_id", "text").mapInArrow(compute, schema)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: by the total, and by the pieces over half a bin that smaller ones must be put beside."""
    best = -(-int(sizes.sum()) // capacity)
    for least in np.unique(sizes[2 * sizes <= capacity]).tolist() or [1]:
        alone = int(np.count_nonzero(sizes > capacity - least))
        large = sizes[(2 * sizes > capacity) & (sizes <= capacity - least)]
        small = int(sizes[(sizes >= least) & (2 * sizes <= capacity)].sum())
        best = max(best, alone + len(large) + max(0, -(-(small - (len(large) * capacity - int(large.sum()))) // capacity)))
    return best


def best_fit(order: np.ndarray, sizes: np.ndarray, bins: np.ndarray, fills: np.ndarray, capacity: int) -> np.ndarray:
    """Puts the pieces of ``order`` one by one into the fullest bin that still takes them, else into a new one."""
    step = len(sizes) + len(fills) + 1
    spaces = sorted((capacity - f) * step + i for i, f in enumerate(fills.tolist()) if f < capacity)
    fresh, size_of = len(fills), sizes[order].tolist()
    put = []
    for size in size_of:
        at = bisect_left(spaces, size * step)
        if at < len(spaces):
            space, bin_ = divmod(spaces.pop(at), step)
        else:
            space, bin_ = capacity, fresh
            fresh += 1
        put.append(bin_)
        if space > size:
            insort(spaces, (space - size) * step + bin_)
    bins[order] = put
    return bins


def fitness(bins: np.ndarray, sizes: np.ndarray) -> tuple[int, float]:
    """Smaller is better: the number of bins, then the sum of squared fills, as full bins beside one that is nearly empty are best."""
    fills = np.bincount(bins, sizes)
    return len(fills), -float((fills * fills).sum())


def crossed(rng: np.random.Generator, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """``a`` with well-filled bins of ``b`` injected; what they displace is put anew by best fit, largest first."""
    fills_b = np.bincount(b, sizes)
    well = np.argsort(-fills_b, kind="stable")[: max(1, len(fills_b) // 2)]
    chosen = np.zeros(len(fills_b), bool)
    chosen[rng.permutation(well)[: max(1, len(well) // 2)]] = True
    injected = chosen[b]
    fills_a = np.bincount(a, sizes)
    broken = np.zeros(len(fills_a), bool)
    broken[a[injected]] = True
    # Some bins with space left are dissolved as well, the emptier the likelier, so that their pieces may fill others.
    loose = np.flatnonzero(fills_a < capacity)
    if len(loose):
        space = capacity - fills_a[loose]
        broken[rng.choice(loose, min(len(loose), int(rng.integers(1, 9))), replace=False, p=space / space.sum())] = True
    displaced = np.flatnonzero(broken[a] & ~injected)
    kept = ~broken[a] & ~injected
    child = np.empty(len(a), np.int64)
    names_a, child[kept] = np.unique(a[kept], return_inverse=True)
    names_b, at = np.unique(b[injected], return_inverse=True)
    child[injected] = at + len(names_a)
    fills = np.concatenate([fills_a[names_a], fills_b[names_b]]).astype(np.int64)
    return best_fit(displaced[np.argsort(-sizes[displaced], kind="stable")], sizes, child, fills, capacity)


def founders(rng: np.random.Generator, sizes: np.ndarray, capacity: int, count: int) -> list[np.ndarray]:
    """First packings: best fit in random orders."""
    none = np.empty(0, np.int64)
    return [best_fit(rng.permutation(len(sizes)), sizes, np.empty(len(sizes), np.int64), none, capacity) for _ in range(count)]


def evolve(rng: np.random.Generator, population: list[np.ndarray], sizes: np.ndarray, capacity: int, bound: int, crossings: int) -> list[np.ndarray]:
    """Crosses winners of small tournaments; a better child replaces the worst. The best comes first in the result."""
    scored = sorted(((fitness(x, sizes), x) for x in population), key=lambda s: s[0])
    for _ in range(crossings):
        if scored[0][0][0] <= bound or len(scored) < 2:
            break
        i, j = sorted(rng.choice(len(scored), 2, replace=False))
        child = crossed(rng, scored[i][1], scored[j][1], sizes, capacity)
        score = fitness(child, sizes)
        if score < scored[-1][0] and all(score != s for s, _ in scored):
            scored[-1] = (score, child)
            scored.sort(key=lambda s: s[0])
    return [x for _, x in scored]


_STATE = "cell bigint, island int, sizes array<int>, population array<int>, best array<int>, bins bigint, fullness double, bound bigint"
_COLUMNS = [x.split()[0] for x in _STATE.split(", ")]


def _state(cell: int, island: int, sizes: np.ndarray, population: list[np.ndarray], bound: int) -> tuple:
    flat = np.concatenate(population).astype(np.int32)
    return cell, island, sizes.astype(np.int32), flat, population[0].astype(np.int32), *fitness(population[0], sizes), bound


def _spread(df: DataFrame, islands: int) -> DataFrame:
    """Islands are little data but long work: at most 64 of them a task, and fewer while there are idle cores."""
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, islands // 64)
    return df.repartition(max(1, min(islands, tasks)), "cell", "island")


def _found(cells: DataFrame, n: int, capacity: int, islands: int, population: int) -> DataFrame:
    """Cells (cell, sizes) -> a state for each island, with its founders."""

    def compute(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for cell, island, sizes in zip(pdf["cell"], pdf["island"], pdf["sizes"]):
                sizes = np.asarray(sizes, np.int64)
                rng = np.random.default_rng([int(cell), int(island)])
                first = sorted(founders(rng, sizes, capacity, population), key=lambda x: fitness(x, sizes))
                out.append(_state(cell, island, sizes, first, lower_bound(sizes, capacity)))
            yield pd.DataFrame(out, columns=_COLUMNS)

    each = cells.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    return _spread(each, n * islands).mapInPandas(compute, _STATE)


def _epoch(states: DataFrame, n: int, capacity: int, epoch: int, islands: int, crossings: int) -> DataFrame:
    """One round of every island; before it, the best of the island before it in the ring takes the place of its worst."""
    guests = states.select("cell", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("best").alias("guest"))
    met = _spread(states.join(guests, ["cell", "island"]).select(*_COLUMNS, "guest"), n * islands)

    def compute(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for row in pdf.itertuples(index=False):
                sizes = np.asarray(row.sizes, np.int64)
                members = list(np.asarray(row.population, np.int64).reshape(-1, len(sizes)))
                if epoch:
                    members[-1] = np.asarray(row.guest, np.int64)
                rng = np.random.default_rng([int(row.cell), int(row.island), epoch])
                evolved = evolve(rng, members, sizes, capacity, int(row.bound), crossings)
                out.append(_state(row.cell, row.island, sizes, evolved, row.bound))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return met.mapInPandas(compute, _STATE)


def _solve(cells: DataFrame, n: int, capacity: int, islands: int, population: int, epochs: int, crossings: int) -> DataFrame:
    """Cells (cell, sizes) -> the best packing of each: cell, best (the bin of each piece)."""
    states, finished = stash(_found(cells, n, capacity, islands, population), "founders"), []
    for epoch in range(epochs):
        met = states.groupBy("cell").agg(F.min("bins").alias("bins"), F.max("bound").alias("bound")).where("bins <= bound").select("cell")
        finished.append(states.join(met, "cell", "left_semi"))
        states = stash(_epoch(states.join(met, "cell", "left_anti"), n, capacity, epoch, islands, crossings), "islands")
    for x in finished:
        states = states.unionByName(x)
    return states.groupBy("cell").agg(F.min_by("best", F.struct("bins", "fullness", "island")).alias("best"))


def pack(
    rows: DataFrame, length: str = "length", capacity: int = CAPACITY, cell: int = CELL, islands: int = ISLANDS,
    population: int = POPULATION, epochs: int = EPOCHS, crossings: int = CROSSINGS,
) -> DataFrame:
    """Rows with a ``length`` of at least 1 -> all their columns, sequence_id and offset.

    A sequence holds at most ``capacity``, or one longer row; offsets follow each other without a gap. Repeated rows are packed
    one by one; null lengths count as nothing and get null places; an empty table stays empty. Numbers of sequences are
    unique, not consecutive. Columns of the two new names are replaced, others may have any name.
    """
    kept = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    numbered = rows.select(F.struct(*(rows[c] for c in kept)).alias("row"), rows[length].cast("int").alias("size"))
    numbered = stash(numbered.withColumn("id", F.monotonically_increasing_id()), "pieces")
    # Sequences are numbered by level above 56 bits, then by cell and bin, or by the row that fills one alone.
    alone = numbered.where(F.col("size") >= capacity)
    placed = [alone.select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left, level = numbered.where(F.col("size") < capacity).select("id", "size"), 1
    count = left.count()
    while count:
        n = -(-count // cell)
        dealt = left.groupBy(F.pmod(F.xxhash64("id", F.lit(level)), F.lit(n)).alias("cell")).agg(
            F.sort_array(F.collect_list(F.struct("id", "size"))).alias("pieces")
        )
        dealt = stash(dealt, "cells")
        best = _solve(dealt.select("cell", F.col("pieces.size").alias("sizes")), n, capacity, islands, population, epochs, crossings)
        put = dealt.join(best, "cell").select("cell", F.inline(F.arrays_zip(F.col("pieces.id").alias("id"), F.col("pieces.size").alias("size"), F.col("best").alias("bin"))))
        bin_ = Window.partitionBy("cell", "bin")
        put = stash(
            put.select(
                "id", "size",
                (F.lit(level << 56) + F.col("cell") * F.lit(1 << 20) + F.col("bin")).alias("sequence_id"),
                (F.sum("size").over(bin_.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("offset"),
                F.sum("size").over(bin_).alias("fill"),
            ),
            "placed",
        )
        loose = F.col("fill") < LOOSE * capacity
        again = put.where(loose).count() if n > 1 else 0
        if 2 * again > count:
            again = 0  # hardly any bin is full: packing them anew would not change that
        done = put.where(~loose) if again else put
        placed.append(done.select("id", "sequence_id", "offset"))
        left, count, level = put.where(loose).select("id", "size"), again, level + 1
    where = placed[0]
    for x in placed[1:]:
        where = where.unionByName(x)
    return numbered.select("row", "id").join(where, "id", "left").select("row.*", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """Placed pieces with their ``ids`` -> sequence_id, n_tokens, ids (unsigned 32-bit, little-endian) of each whole sequence."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    made = packed.where(F.col("sequence_id").isNotNull()).groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    return made.select("sequence_id", "n_tokens", F.reduce("parts", F.lit(b""), lambda x, p: F.concat(x, p["ids"])).alias("ids"))
