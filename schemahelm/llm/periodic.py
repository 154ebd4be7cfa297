"""Runs of repeating words in whole texts, found on a grammar of the text.

A run is a stretch of words with smallest period q that is at least ``exponent`` periods (and ``least`` words) long and that no
neighbouring word extends.

1. Candidate stretches: inside such a run every pair of neighbouring words occurs at least ``exponent`` - 1 times, so texts are
   cut at rarer pairs, and counted again, until nothing changes. A run lies whole inside one stretch.
2. Re-Pair: the most frequent pair of neighbouring symbols becomes a nonterminal until no pair occurs twice.
3. A run either crosses the boundary of the two sides of a nonterminal that derives it, or a boundary between two symbols
   of the start rule. Each nonterminal's boundary is searched once, on one of its occurrences: a run that crosses it has two
   whole periods on one side, so its first pair of words there recurs one period on, and common extensions to both
   sides give its ends inside the nonterminal.
4. What was found is translated to every position that the derivation gives the nonterminal. Runs cut off by the ends
   of a nonterminal are parts of a run found further up; per period, only maximal intervals stay.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemahelm.llm.common import crc32_of_id, raw, slices

LEAST, EXPONENT = 6, 4


class WordIds(dict):
    """Word -> number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


@dataclass
class Grammar:
    """Rule ``i`` makes symbol ``first + i`` of two symbols; ``size`` and ``place`` (of one occurrence) are those of all symbols."""

    first: int
    rules: list[tuple[int, int]]
    start: list[int]
    size: list[int]
    place: list[int]


def re_pair(words: list[int]) -> Grammar:
    """Grammar of a sequence of numbers from 0 on.

    All occurrences of a pair arise in one pass, so its list is complete when it is queued. Counts in the queue may be
    too high, as overlapping and vanished occurrences count until the pair is drawn; it then goes back with its true count.
    """
    n, first = len(words), max(words, default=-1) + 1
    symbols: list[int | None] = list(words)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i in range(n - 1):
        places[words[i], words[i + 1]].append(i)
    queue = [(-len(v), i, pair) for i, (pair, v) in enumerate(places.items()) if len(v) > 1]
    heapify(queue)
    number = len(places)
    rules: list[tuple[int, int]] = []
    size, place = [1] * first, [0] * first
    while queue:
        count, order, pair = heappop(queue)
        a, b = pair
        live, taken = [], -1
        for i in places[pair]:
            if symbols[i] == a and i != taken and (j := after[i]) < n and symbols[j] == b:
                live.append(i)
                taken = j
        if len(live) < 2:
            del places[pair]
            continue
        if len(live) < -count and queue and -queue[0][0] > len(live):
            places[pair] = [i for i in places[pair] if symbols[i] == a]
            heappush(queue, (-len(live), order, pair))
            continue
        del places[pair]
        made = first + len(rules)
        rules.append(pair)
        size.append(size[a] + size[b])
        place.append(live[0])
        touched = set()
        for i in live:
            j = after[i]
            k, left = after[j], before[i]
            symbols[i], symbols[j] = made, None
            after[i] = k
            if k < n:
                before[k] = i
                pair = (made, symbols[k])
                places[pair].append(i)
                touched.add(pair)
            if left >= 0:
                pair = (symbols[left], made)
                places[pair].append(left)
                touched.add(pair)
        for pair in sorted(touched, key=lambda p: places[p][0]):
            if len(places[pair]) > 1:
                number += 1
                heappush(queue, (-len(places[pair]), number, pair))
            else:
                del places[pair]
    return Grammar(first, rules, [s for s in symbols if s is not None], size, place)


def common(words: list[int], a: int, b: int, end: int) -> int:
    """Length of the common extension of positions ``a`` < ``b``, that of ``b`` ending before ``end``."""
    n, step, grow = 0, 1, True
    while step and b + n < end:
        k = min(step, end - b - n)
        if words[a + n : a + n + k] == words[b + n : b + n + k]:
            n += k
            step = step * 2 if grow else step // 2
        else:
            grow = False
            step //= 2
    return n


#: Least period, and the length of the word groups that then must recur: pairs for periods below 8, and so on.
_GROUPS = ((1, 2), (8, 8), (64, 64))


class Boundaries:
    """Search of runs that cross a boundary; ``words`` may hold separators, numbers that occur once."""

    def __init__(self, words: list[int], least: int = LEAST, exponent: int = EXPONENT):
        self.n, self.least, self.exponent = len(words), least, exponent
        self.sides = [(x, self._recurring(x)) for x in (words, words[::-1])]

    @staticmethod
    def _recurring(words: list[int]) -> list[tuple[list[int], dict[int, list[int]]]]:
        """For each size of groups (powers of two): the number of each group of neighbouring words, and the places of each number."""
        out, names, width = [], words, 1
        for least, size in _GROUPS:
            if len(words) < EXPONENT * least:
                break  # too short for such a period
            while width < size:
                numbers: dict[tuple[int, int], int] = {}
                names = [numbers.setdefault(pair, len(numbers)) for pair in zip(names, names[width:])]
                width *= 2
            places: dict[int, list[int]] = defaultdict(list)
            for i, name in enumerate(names):
                places[name].append(i)
            out.append((names, places))
        return out

    def _after(self, side: int, low: int, at: int, high: int) -> Iterator[tuple[int, int, int]]:
        """Runs (start, end, period) inside [low, high) with two periods after ``at`` and at least a word before it.

        Periods are tried in ascending order. Where two of them fit into a stretch of smaller period found before, they are
        its multiples, so the next one tried reaches beyond that stretch.
        """
        (words, groups), back, n = self.sides[side], self.sides[1 - side][0], self.n
        reach = at
        for (least, size), (names, recur), bound in zip(_GROUPS, groups, (*(x for x, _ in _GROUPS[1:]), n)):
            if at + max(size, 2 * least) > high:
                return
            places = recur[names[at]]
            i = bisect_left(places, at + least)
            while i < len(places) and (q := places[i] - at) < bound:
                if at + 2 * q > high:
                    return
                if at + 2 * q <= reach:
                    i = bisect_left(places, at + (reach - at) // 2 + 1, i + 1)
                    continue
                right = common(words, at, at + q, high)
                if right >= q:
                    reach = at + q + right
                    left = common(back, n - at - q, n - at, n - low)
                    if left and reach - at + left >= max(self.least, self.exponent * q):
                        yield at - left, reach, q
                i += 1

    def crossing(self, low: int, at: int, high: int) -> set[tuple[int, int, int]]:
        """All runs inside [low, high) that cross ``at``."""
        n = self.n
        found = set(self._after(0, low, at, high))
        found.update((n - e, n - s, q) for s, e, q in self._after(1, n - high, n - at, n - low))
        return found


def maximal(found: Iterator[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Intervals (start, end, period) that no other of their period contains, by start and period."""
    out, period, reach = [], 0, 0
    for s, e, q in sorted(set(found), key=lambda r: (r[2], r[0], -r[1])):
        if q != period or e > reach:
            out.append((s, e, q))
            period, reach = q, e
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_by_grammar(words: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of a sequence of numbers from 0 on."""
    grammar, search = re_pair(words), Boundaries(words, least, exponent)
    first, size = grammar.first, grammar.size
    own: list[list[tuple[int, int, int]]] = []
    useful: list[bool] = []
    for i, (a, b) in enumerate(grammar.rules):
        here, n = grammar.place[first + i], size[first + i]
        found = search.crossing(here, here + size[a], here + n) if n >= least else ()
        own.append([(s - here, e - here, q) for s, e, q in found])
        useful.append(bool(own[-1]) or any(x >= first and useful[x - first] for x in (a, b)))
    found, starts, at = set(), defaultdict(list), 0
    for k, x in enumerate(grammar.start):
        if k:
            found |= search.crossing(0, at, len(words))
        if x >= first and useful[x - first]:
            starts[x].append(at)
        at += size[x]
    for i in range(len(grammar.rules) - 1, -1, -1):
        a, b = grammar.rules[i]
        for at in starts.pop(first + i, ()):
            found.update((at + s, at + e, q) for s, e, q in own[i])
            for x, shift in ((a, 0), (b, size[a])):
                if x >= first and useful[x - first]:
                    starts[x].append(at + shift)
    return maximal(found)


def stretches(words: np.ndarray, text: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """Parts [start, end) of a batch of words that may hold runs; ``text`` numbers the texts that the words are of."""
    at, group = np.arange(len(words)), text
    while len(at):
        w, t = words[at], text[at][:-1]
        joined = group[1:] == group[:-1]
        _, pair = np.unique(w[:-1][joined] * (int(w.max()) + 1) + w[1:][joined], return_inverse=True)
        _, pair, counts = np.unique(t[joined] * (int(pair.max(initial=0)) + 1) + pair, return_inverse=True, return_counts=True)
        holds = joined.copy()
        holds[joined] = counts[pair] >= exponent - 1
        parts = np.concatenate([[0], np.cumsum(~holds)])
        keep = np.bincount(parts)[parts] >= least
        if keep.all() and (holds == joined).all():
            break
        at, group = at[keep], parts[keep]
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(at)]
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(edges, edges[1:]) if b > a]


def text_runs(parts: list[tuple[int, list[int]]], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) of one text, of whose stretches ``parts`` has the first word's place and the words."""
    numbers = WordIds()
    joined: list[int] = []
    shifts, begins = [], []
    for start, words in parts:
        if joined:
            numbers[object()] = len(numbers)  # a separator is equal to nothing
            joined.append(len(numbers) - 1)
        begins.append(len(joined))
        shifts.append(start - len(joined))
        joined.extend(map(numbers.__getitem__, words))
    found = runs_by_grammar(joined, least, exponent)
    shift = [shifts[bisect_right(begins, s) - 1] for s, _, _ in found]
    return [(s + d, e + d, q) for (s, e, q), d in zip(found, shift)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that follow the first period of a run, joined by one space."""
    kept, at = [], 0
    for s, e in sorted((s + q, e) for s, e, q in runs):
        if s > at:
            kept.extend(words[at:s])
        at = max(at, e)
    return b" ".join(kept + words[at:] if runs else words)


def _batch_runs(texts: list[list[bytes]], least: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each text of a batch."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = WordIds()
    words = np.concatenate([np.fromiter(map(ids.__getitem__, t), np.int64, len(t)) for t in texts])
    text, begin = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    parts: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for s, e in stretches(words, text, least, exponent):
        t = int(text[s])
        parts[t].append((s - int(begin[t]), words[s:e].tolist()))
    return [text_runs(parts[i], least, exponent) if i in parts else [] for i in range(len(texts))]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, runs, strongest, collapsed; one row for each row.

    ``runs`` has a (start, length, period) for each run, by start and period; ``strongest`` is the one with the greatest length
    for its period (ties: smallest start, then period), null without runs. ``collapsed`` has the words, joined by one space,
    without those that any run holds after its first period. Null, empty and blank texts have no words; repeated rows
    have one result each; other columns are not read. Shorter runs than four periods need another search.
    """
    if exponent < 4 or least < 5:
        raise ValueError("runs must have at least four periods and five words")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [t.split() for t in raw(part.column("text"))]
                found = _batch_runs(texts, least, exponent)
                rows = [[{"start": s, "length": e - s, "period": q} for s, e, q in runs] for runs in found]
                best = [max(r, key=lambda x: (Fraction(x["length"], x["period"]), -x["start"], -x["period"]), default=None) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(rows, pa.list_(_RUN)), pa.array(best, _RUN),
                     pa.array([collapsed(t, r) for t, r in zip(texts, found)], pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "strongest", "collapsed"],
                )

    id_type, run = docs.schema["doc_id"].dataType.simpleString(), "struct<start: bigint, length: bigint, period: bigint>"
    return docs.select("doc_id", "text").mapInArrow(
        compute, f"doc_id {id_type}, n_words bigint, runs array<{run}>, strongest {run}, collapsed string"
    )


def with_loops(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where the texts of one id in ten (crc32 of the id divisible by 10) end in a loop of their own words.

    With g a tenth of that crc32 and n words, the words from g % n on repeat the first 1 + (n - g % n) / (3 + g % 8) of them.
    Other texts, and all those without words, are as they were; a null id has no crc32.
    """
    h = crc32_of_id(F.col("doc_id"))
    g = F.floor(h / 10)

    def looped(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        loop = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, a + (i - a) % p))
        return F.concat_ws(" ", F.slice(words, 1, a), loop)

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"))
    return chosen.select("doc_id", F.when(F.size("w") > 0, looped(F.col("w"))).otherwise(F.col("text")).alias("text"))
