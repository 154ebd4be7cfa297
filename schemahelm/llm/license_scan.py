"""Licence scan: sparse TF-IDF cosine to licence templates, then inheritance from the nearest ancestor directory.

Windows of a file's terms, over line breaks and up to twice as long as the template, are compared with the templates: a
file's own licence is that of its best window, if the cosine reaches the threshold. Document frequencies of all terms are
counted over all files, and joined with the terms of the windows that can reach it. A file with a licence file's name passes its licence on to all below its directory: every other file
without a licence of its own joins its chain of ancestor directories with those of the licence files and takes the deepest.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemahelm.llm.common import CACHE_WORDS, raw, slices, stash

#: Short statements of use, as they stand in file headers; several for a licence are alternatives.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3.",
    ),
    "LGPL-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1.",),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the conditions are met.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, all rights are waived and the work is dedicated to the public domain under CC0 1.0.",),
}
LICENCE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)(\.[a-z]+)?$"
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def template_terms() -> list[bytes]:
    return sorted({w for texts in TEMPLATES.values() for t in texts for w in terms_of(t.encode())})


def term_counts(files: DataFrame) -> DataFrame:
    """term, n: in how many files each term of any file occurs; the empty term has the number of files. Partial counts are made per task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])
            seen.clear()
            return rows

        for batch in batches:
            for part in slices(batch):
                for text in raw(part.column("text")):
                    seen[b""] += 1
                    seen.update(set(terms_of(text)))
                    if len(seen) > CACHE_WORDS:
                        yield out()
        yield out()

    return files.select("text").mapInArrow(count, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


class Matcher:
    """Cosine of windows' TF-IDF vectors to the templates'. ``counts`` are the files of each term; a term without is in none."""

    def __init__(self, n_files: int, counts: dict[str, int], threshold: float = 0.6):
        self.n_files = n_files
        self.idf = {t: self.idf_of(counts.get(t.decode(), 0)) for t in template_terms()}
        self.names, self.rows, self.lengths = [], [], []
        for name, texts in TEMPLATES.items():
            for t in texts:
                v = {t: (1 + math.log(n)) * self.idf[t] for t, n in Counter(terms_of(t.encode())).items()}
                norm = math.sqrt(sum(x * x for x in v.values()))
                self.names.append(name)
                self.lengths.append(len(terms_of(t.encode())))
                self.rows.append({k: x / norm for k, x in v.items()})
        self.postings: dict[bytes, list[tuple[int, float]]] = {}
        for i, row in enumerate(self.rows):
            for t, x in row.items():
                self.postings.setdefault(t, []).append((i, x))
        # The other terms of a template alone stay below the threshold, so that what reaches it has one of these.
        self.rare: set[bytes] = set()
        for row in self.rows:
            left = sum(x * x for x in row.values())
            for t in sorted(row, key=lambda t: (-self.idf[t], t)):
                if left < (threshold * 0.999) ** 2:
                    break
                self.rare.add(t)
                left -= row[t] ** 2
        self.common_most = max(math.sqrt(sum(x * x for t, x in row.items() if t not in self.rare)) for row in self.rows)

    def idf_of(self, n: int) -> float:
        return math.log((self.n_files + 1) / (n + 1)) + 1.0

    def windows(self, terms: list[bytes], others: dict[bytes, float], other: float, least: float) -> Iterator[tuple[float, int, int, int]]:
        """(cosine, template, first, last) of windows that begin and end with a term of the template and hold one of the rare ones.

        A window has at most twice the template's terms, whatever the line breaks. ``others``: inverse document frequencies of terms of no
        template, ``other`` that of those not in it. What a template's terms near by cannot bring to ``least`` is passed over.
        """
        if self.rare.isdisjoint(terms):
            return
        places = [p for p, t in enumerate(terms) if t in self.idf]
        before = [-1] * len(self.rows)  # by template, its last rare term so far: windows with that one have been looked at
        for k, p in enumerate(places):
            if terms[p] not in self.rare:
                continue
            for i, _ in self.postings[terms[p]]:
                row, most = self.rows[i], 2 * self.lengths[i]
                low = max(before[i], p - most)
                before[i] = p
                first, end = k, bisect.bisect_left(places, p + most, k)
                while first > 0 and places[first - 1] > low:
                    first -= 1
                near = {terms[q] for q in places[first:end]} & row.keys()
                # No window has a better cosine than the template's norm over the terms that it holds.
                if math.sqrt(sum(row[t] ** 2 for t in near)) < least:
                    continue
                for a in places[first : k + 1]:
                    if terms[a] not in row:
                        continue
                    times: dict[bytes, int] = {}
                    norm = dot = 0.0
                    for q in range(a, min(a + most, len(terms))):
                        t = terms[q]
                        n = times[t] = times.get(t, 0) + 1
                        weight = self.idf.get(t) or others.get(t, other)
                        new, old = (1 + math.log(n)) * weight, (1 + math.log(n - 1)) * weight if n > 1 else 0.0
                        norm += new * new - old * old
                        if t in row:
                            dot += (new - old) * row[t]
                            if q >= p:
                                yield dot / math.sqrt(norm), i, a, q

    def candidates(self, text: bytes, threshold: float) -> list[list[bytes]]:
        """Runs of terms: the windows that reach the threshold if their other terms weigh the least that they can, joined where they overlap."""
        terms = terms_of(text)
        # No term is in more than all files, so none weighs less than 1.
        spans = sorted({(a, q) for x, _, a, q in self.windows(terms, {}, 1.0, threshold - 1e-9) if x >= threshold - 1e-9})
        runs: list[list[int]] = []
        for a, q in spans:
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], q)
            else:
                runs.append([a, q])
        return [terms[a : q + 1] for a, q in runs]

    def judge(self, found: list[list[bytes]], others: dict[bytes, float], threshold: float) -> tuple[float, str | None]:
        """Best cosine of the candidates' windows, and the licence if that reaches the threshold."""
        each = ((x, self.names[i]) for terms in found for x, i, _, _ in self.windows(terms, others, self.idf_of(0), 0.0))
        top, name = max(each, default=(0.0, ""))
        return top, name if top >= threshold else None

    def file(self, text: bytes, threshold: float) -> tuple[float, str | None]:
        """Best cosine and licence of a text whose terms are in no file, but for those of the templates."""
        return self.judge(self.candidates(text, threshold), {}, threshold)


def own_licences(files: DataFrame, threshold: float) -> DataFrame:
    """(path, text) and other columns -> path, the others, cosine, licence (null below the threshold).

    Texts are read twice: to count all terms and to find candidates. Only the terms of these are joined with the counts.
    """
    counts = stash(term_counts(files), "term_counts")
    wanted = [bytearray(t) for t in (b"", *template_terms())]
    known = {bytes(r["term"]).decode(): r["n"] for r in counts.where(F.col("term").isin(wanted)).collect()}  # at most the templates' terms
    matcher = Matcher(known.pop("", 0), known, threshold)
    others = [c for c in files.columns if c not in ("path", "text")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [matcher.candidates(t, threshold) for t in raw(part.column("text"))]
                words = [list({t for x in f for t in x if t not in matcher.idf}) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("path"), *(part.column(c) for c in others), pa.array([[b" ".join(x) for x in f] for f in found], pa.list_(pa.binary())), pa.array(words, pa.list_(pa.binary()))],
                    ["path", *others, "__found", "__words"],
                )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = []
            for found, terms, n in zip(*(batch.column(c).to_pylist() for c in ("__found", "__terms", "__n"))):
                idf = {t: matcher.idf_of(k) for t, k in zip(terms or (), n or ())}
                judged.append(matcher.judge([x.split() for x in found], idf, threshold))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__row"), pa.array([x[0] for x in judged], pa.float64()), pa.array([x[1] for x in judged], pa.string())],
                ["__row", "cosine", "licence"],
            )

    binaries = T.ArrayType(T.BinaryType())
    kept = files.select("path", *others).schema.fields
    schema = T.StructType([*kept, T.StructField("__found", binaries), T.StructField("__words", binaries)])
    rows = files.select("path", *others, "text").mapInArrow(find, schema).withColumn("__row", F.monotonically_increasing_id())
    # Row numbers hold once they are written.
    rows = stash(rows, "candidates")
    found = rows.where(F.size("__found") > 0).select("__row", "__found", "__words")
    words = found.select("__row", F.explode("__words").alias("term"))
    # Counts of the candidates' terms first: few, while a common line's terms are in many rows.
    counted = stash(counts.join(words.select("term").distinct(), "term"), "candidate_terms")
    weighed = words.join(counted, "term").groupBy("__row").agg(F.collect_list(F.struct("term", "n")).alias("t"))
    weighed = weighed.select("__row", F.col("t.term").alias("__terms"), F.col("t.n").alias("__n"))
    judged = found.select("__row", "__found").join(weighed, "__row", "left").mapInArrow(judge, "__row bigint, cosine double, licence string")
    return rows.join(judged, "__row", "left").select("path", *others, "cosine", "licence")


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def _directory(parts: Column, depth: Column | int) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, depth), "/"))


def scan(files: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(path, text) and other columns -> path, the others, cosine, licence, origin, licence_path; a row for each file.

    ``origin``: header (a licence of its own), licence_file (the file is one itself), inherited (``licence_path`` is the
    directory that it is from) or none. Two licence files in one directory: the better cosine, then the first name.
    ``cosine`` is null where it was not computed, as no window of the file could reach the threshold whatever its other terms weigh.
    Null and empty texts have no licence of their own; a null path has no directory and inherits nothing; repeated rows are judged alike.
    Other columns named like those of the result are replaced; any other name is free.
    """
    # The other columns travel as one, so that no name of theirs can clash.
    others = [c for c in files.columns if c not in ("path", "text", "cosine", "licence", "origin", "licence_path")]
    rest = F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in others)) if others else F.lit(None)
    packed = files.select("path", "text", rest.alias("rest"))
    rows = stash(own_licences(packed if others else packed.drop("rest"), threshold), "licences").withColumn("_parts", _parts(F.col("path")))
    name, depth = F.element_at("_parts", -1), F.size("_parts") - 1
    is_file = F.coalesce(name.rlike(LICENCE_NAMES), F.lit(False))
    known = rows.where(is_file & F.col("licence").isNotNull()).select(_directory(F.col("_parts"), depth).alias("_dir"), depth.alias("_depth"), "licence", "cosine", "path")
    best = F.min(F.struct((-F.round("cosine", 6)).alias("c"), "path", "licence"))
    known = known.groupBy("_dir", "_depth").agg(best.alias("b")).select("_dir", "_depth", F.col("b.licence").alias("_given"))
    # The chain of ancestors is made once for each directory that has files, not for each file.
    home = _directory(F.col("_parts"), depth)
    rows = rows.withColumn("_home", F.when(F.col("path").isNotNull() & (F.size("_parts") > 0), home))
    homes = rows.where("licence IS NULL AND _home IS NOT NULL").select("_home").distinct()
    above = F.explode(F.transform(F.sequence(F.lit(0), F.size(_parts(F.col("_home")))), lambda d: _directory(_parts(F.col("_home")), d.cast("int"))))
    chain = homes.withColumn("_dir", above).join(known, "_dir")
    nearest = chain.groupBy("_home").agg(F.max(F.struct("_depth", "_given", "_dir")).alias("n"))
    nearest = nearest.select("_home", F.col("n._given").alias("_given"), F.col("n._dir").alias("_from"))
    joined = rows.join(nearest, "_home", "left")
    own = F.col("licence").isNotNull()
    origin = F.when(own & is_file, "licence_file").when(own, "header").when(F.col("_given").isNotNull(), "inherited").otherwise("none")
    return joined.select(
        "path", *(["rest.*"] if others else []), F.round("cosine", 6).alias("cosine"), F.coalesce("licence", "_given").alias("licence"), origin.alias("origin"),
        F.when(~own, F.col("_from")).alias("licence_path"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: /source/thousands/hundreds/number; each directory's first document stands for its licence file.

    A document whose number ends in 00 is /source/thousands/hundreds/LICENSE, one that ends in 000 /source/thousands/LICENSE.
    """
    n = F.col("doc_id")
    part = lambda by: F.expr(f"doc_id div {by}").cast("string")
    root = F.concat(F.lit("/"), F.coalesce("source", F.lit("unknown")), F.lit("/"), part(1000))
    path = (
        F.when(n % 1000 == 0, F.concat(root, F.lit("/LICENSE")))
        .when(n % 100 == 0, F.concat(root, F.lit("/"), part(100), F.lit("/LICENSE")))
        .otherwise(F.concat(root, F.lit("/"), part(100), F.lit("/"), n.cast("string")))
    )
    return docs.select("doc_id", path.alias("path"), "text")
