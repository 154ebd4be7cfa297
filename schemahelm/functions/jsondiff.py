"""Stable JSON text and key-level diff counts.

Flat objects are compared as sets of key lines by built-in functions: their keys are sorted and unique, so
the lines that a line diff keeps are exactly the common ones. Documents with nested values go through a
vectorised helper based on the standard library's ``difflib``.
"""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemahelm.functions.typing import col_of, let

def _object(doc: Column) -> Column:
    """Members of a JSON object as a map of JSON texts; NULL when the text is no object."""

    def members(v: Column) -> Column:
        as_map = F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, x: F.to_json(x))
        return F.when(F.schema_of_variant(v).startswith("OBJECT<"), as_map)

    return let(F.try_parse_json(doc), members)


def is_flat(doc: Column | str) -> Column:
    """NULL, blank, or a JSON object without nested members."""
    d = col_of(doc)
    nested = F.exists(F.map_values(_object(d)), lambda v: v.rlike(r"^(\{.+\}|\[.+\])$"))
    return F.coalesce(F.trim(d), F.lit("")).isin("") | F.coalesce(~nested, F.lit(False))


def _key_lines(doc: Column) -> Column:
    """The member lines of a flat object in key order; every line but the last ends with a comma.

    Lines are only compared, so key and value are joined by a character that neither can contain.
    """
    none = F.array().cast("array<string>")

    def lines(entries: Column) -> Column:
        n = F.size(entries)
        text = lambda e: F.concat(e["key"], F.lit("\x01"), e["value"])
        head = F.transform(F.slice(entries, F.lit(1), n - 1), lambda e: F.concat(text(e), F.lit(",")))
        return F.when(n > 0, F.concat(head, F.transform(F.slice(entries, n, F.lit(1)), text))).otherwise(none)

    return F.coalesce(let(F.array_sort(F.map_entries(_object(doc))), lines), none)


def _counts(added: Column, removed: Column) -> Column:
    return F.struct(added.cast("bigint").alias("added"), removed.cast("bigint").alias("removed"))


def flat_diff_counts(before: Column | str, after: Column | str) -> Column:
    """``struct(added, removed)`` of key lines between two flat JSON objects, inside the JVM."""
    pair = F.struct(_key_lines(col_of(before)).alias("b"), _key_lines(col_of(after)).alias("a"))
    return let(
        pair, lambda p: _counts(F.size(F.array_except(p["a"], p["b"])), F.size(F.array_except(p["b"], p["a"])))
    )


# --- helpers that run inside Arrow batches ----------------------------------------------------------------


def _stable(text: str | None) -> str:
    text = text or ""
    try:
        return json.dumps(json.loads(text), indent=2, sort_keys=True, ensure_ascii=False)
    except ValueError:
        return text


def _unified(before: str | None, after: str | None) -> list[str]:
    a = _stable(before).split("\n")
    b = _stable(after).split("\n")
    return list(difflib.unified_diff(a, b, "before", "after", n=3, lineterm=""))


def _key_counts(before: str | None, after: str | None) -> tuple[int, int]:
    """Key lines a line diff adds and removes."""
    a, b = _stable(before).split("\n"), _stable(after).split("\n")
    if a == b:
        return 0, 0
    added = removed = 0
    for tag, a0, a1, b0, b1 in difflib.SequenceMatcher(None, a, b).get_opcodes():
        if tag != "equal":
            removed += sum('":' in x and not x.startswith("--") for x in a[a0:a1])
            added += sum('":' in x and not x.startswith("++") for x in b[b0:b1])
    return added, removed


#: Types of values whose JSON text is the same in every writer.
_PLAIN = ("BIGINT", "STRING", "BOOLEAN", "VOID")


def _plain_text(doc: Column) -> Column:
    """Stable text of a flat object of whole numbers, plain strings, truth values and nulls; NULL for anything else."""

    def text(v: Column) -> Column:
        members = F.map_entries(F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, x: F.when(F.schema_of_variant(x).isin(*_PLAIN), F.to_json(x))))
        simple = lambda e: ~e["key"].rlike(r'["\\\x00-\x1f]') & F.coalesce(~e["value"].contains("\\"), F.lit(False))
        lines = F.transform(F.array_sort(members), lambda e: F.concat(F.lit('  "'), e["key"], F.lit('": '), e["value"]))
        whole = F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}"))
        return F.when(F.schema_of_variant(v).startswith("OBJECT<") & (F.size(members) > 0) & F.forall(members, simple), whole)

    return let(F.try_parse_json(doc), text)


def normalize_json(doc: Column | str) -> Column:
    """Sorted keys, two-space indentation; text that is no JSON stays as it is.

    Flat objects of plain values are written inside the JVM; the helper gets only what is left.
    """

    @F.pandas_udf("string")
    def stable(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else _stable(v))

    native = _plain_text(col_of(doc))
    return F.coalesce(native, stable(F.when(native.isNull(), col_of(doc))))


def nested_diff_counts(before: Column | str, after: Column | str) -> Column:
    """``struct(added, removed)`` for documents of any shape."""

    @F.pandas_udf("added bigint, removed bigint")
    def count(b: pd.Series, a: pd.Series) -> pd.DataFrame:
        pairs = [_key_counts(x, y) for x, y in zip(b, a)]
        return pd.DataFrame(pairs, columns=["added", "removed"])

    return count(col_of(before), col_of(after))


def unified_diff(before: Column | str, after: Column | str) -> Column:
    """Unified diff text of two JSON documents, three lines of context."""

    @F.pandas_udf("string")
    def diff(b: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series(["".join(x + "\n" for x in _unified(p, q)) for p, q in zip(b, a)], dtype=object)

    return diff(col_of(before), col_of(after))


def with_diff_counts(df: DataFrame, before: str, after: str, out: str = "_counts") -> DataFrame:
    """Add ``struct(added, removed)``.

    Flat pairs are counted natively. The helper is fed only the other pairs; flat ones reach it as NULLs, which it
    answers at once.
    """
    native = flat_diff_counts(before, after)
    flat = is_flat(before) & is_flat(after)
    slow = nested_diff_counts(F.when(~flat, F.col(before)), F.when(~flat, F.col(after)))
    return df.withColumn(out, F.when(flat, native).otherwise(slow))
