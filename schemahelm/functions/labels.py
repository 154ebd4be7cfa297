"""Label normalisation and matching on string arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemahelm.functions.typing import col_of, folded


def norm_label(text: Column | str) -> Column:
    """Trim, lower-case and keep only letters, digits and ``- _ . /``."""
    return F.regexp_replace(folded(text), r"[^a-z0-9\-_./]", "")


def label_kv(key: Column | str, value: Column | str) -> Column:
    """``k=v`` of the normalised parts; NULL when either part is empty."""
    k, v = norm_label(key), norm_label(value)
    return F.when((k != "") & (v != ""), F.concat(k, F.lit("="), v))


def label_set(labels: Column | str) -> Column:
    """Sorted distinct labels in lower case, plus the bare key of every ``k=v``."""
    low = F.filter(F.transform(col_of(labels), folded), lambda x: x != "")
    keyed = F.filter(low, lambda x: x.contains("="))
    bare = F.transform(keyed, lambda x: F.substring_index(x, "=", 1))
    return F.array_sort(F.array_distinct(F.concat(low, bare)))


def labels_from_map(source: Column | str, mapping: dict[str, str], fixed: dict[str, str] | None = None, ignore_case: bool = False) -> Column:
    """Labels from a map column (headers, metadata, claims): ``source key -> label name``, plus fixed labels.

    Each hit gives ``label=value`` and the bare label name; order follows the mapping, duplicates go.
    ``ignore_case`` compares source keys without case, as header names are.
    """
    src = col_of(source)

    def value_of(key: str) -> Column:
        if not ignore_case:
            return src[key]
        return F.get(F.map_values(F.map_filter(src, lambda k, v: F.lower(k) == key.lower())), F.lit(0))

    pairs = [(F.lit(name), value_of(key)) for key, name in mapping.items()]
    pairs += [(F.lit(name), F.lit(value)) for name, value in (fixed or {}).items()]
    parts = []
    for name, value in pairs:
        kv = label_kv(name, value)
        parts.append(F.when(kv.isNotNull(), F.array(kv, name)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<string>")


def has_label(label_set_col: Column | str, label: str) -> Column:
    return F.array_contains(col_of(label_set_col), F.lit(label.lower()))


def has_all_labels(labels: Column | str, wanted: list[str]) -> Column:
    """True when the (raw) label array holds every wanted label exactly as written."""
    if not wanted:
        return F.lit(True)
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), col_of(labels))) == 0


def has_any_label(label_set_col: Column | str, wanted: list[str]) -> Column:
    if not wanted:
        return F.lit(False)
    return F.arrays_overlap(col_of(label_set_col), F.array(*[F.lit(w.lower()) for w in wanted]))
