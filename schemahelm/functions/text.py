"""Text helpers: timestamps, versions, paths, connection strings, hashes, signatures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from schemahelm.functions.typing import col_of, lookup

# --- fixed values -----------------------------------------------------------------------------------------
# accepted timestamp layouts, tried in this order
TIME_LAYOUTS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS]",
]
# connection scheme -> driver
SCHEME_DRIVERS = {
    "postgres": ["postgres", "postgresql"],
    "mongo": ["mongodb", "mongodb+srv"],
    "mysql": ["mysql"],
}
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
# --- end of fixed values ----------------------------------------------------------------------------------


def parse_time(text: Column | str) -> Column:
    """First layout that fits, else NULL."""
    return F.coalesce(*[F.try_to_timestamp(col_of(text), F.lit(layout)) for layout in TIME_LAYOUTS])


def norm_path(path: Column | str) -> Column:
    return F.regexp_replace(col_of(path), r"\d+", ":id")


def _semver_parts(version: Column) -> list[Column]:
    pattern = r"^\s*([+-]?\d+)\.([+-]?\d+)\.([+-]?\d+)"
    return [F.regexp_extract(version, pattern, i).try_cast("bigint") for i in (1, 2, 3)]


def next_semver(version: Column | str, bump: str = "patch") -> Column:
    """Next version; text that is no version stays as it is."""
    v = col_of(version)
    major, minor, patch = _semver_parts(v)
    zero = F.lit(0)
    bumped = {
        "major": (major + 1, zero, zero),
        "minor": (major, minor + 1, zero),
    }.get(bump, (major, minor, patch + 1))
    text = F.concat_ws(".", *[p.cast("string") for p in bumped])
    return F.when(patch.isNotNull(), text).otherwise(v)


def _semver_order(version: Column) -> Column:
    """Sortable struct of a version; NULL for text that is no version."""
    pattern = r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(version, pattern, i), F.lit("")), F.lit("0")).try_cast("bigint")
    pre = F.regexp_extract(version, pattern, 4)
    idents = F.transform(
        F.split(pre, r"\."),
        lambda x: F.struct(
            (~x.rlike(r"^\d+$")).alias("alpha"),
            F.when(x.rlike(r"^\d+$"), x.try_cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("num"),
            F.when(x.rlike(r"^\d+$"), F.lit("")).otherwise(x).alias("txt"),
        ),
    )
    return F.when(
        version.rlike(pattern),
        F.struct(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), (pre == "").alias("release"), idents.alias("pre")),
    )


def semver_lt(a: Column | str, b: Column | str) -> Column:
    """``a < b``; NULL when either side is no version."""
    return _semver_order(col_of(a)) < _semver_order(col_of(b))


# --- connection strings -----------------------------------------------------------------------------------


def dsn_driver(dsn: Column | str) -> Column:
    scheme = F.lower(F.regexp_extract(col_of(dsn), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return lookup(scheme, SCHEME_DRIVERS, F.lit(None).cast("string"))


def _dsn_path(dsn: Column) -> Column:
    return F.regexp_extract(dsn, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _auth_source(dsn: Column) -> Column:
    return F.regexp_extract(dsn, r"\?(?:[^#]*&)?authSource=([^&#]*)", 1)


def dsn_has_database(driver: Column | str, dsn: Column | str) -> Column:
    """Does the connection string name a database?"""
    drv, d = col_of(driver), col_of(dsn)
    rest = F.substring_index(d, "/", -1)
    named = F.regexp_replace(_dsn_path(d), "^/", "") != ""
    return F.coalesce(
        F.when(drv == "mysql", d.contains("/") & (rest != "") & ~rest.startswith("?"))
        .when(drv == "postgres", d.contains("dbname=") | named)
        .when(drv == "mongo", named | (_auth_source(d) != "")),
        F.lit(False),
    )


def dsn_schema(driver: Column | str, dsn: Column | str) -> Column:
    drv, d = col_of(driver), col_of(dsn)
    path = F.regexp_replace(_dsn_path(d), "^/+|/+$", "")
    return F.coalesce(
        F.when(drv == "mysql", F.substring_index(F.substring_index(d, "/", -1), "?", 1))
        .when(drv == "mongo", F.when(path != "", path).otherwise(_auth_source(d)))
        .when(drv == "postgres", F.lit("public")),
        F.lit(""),
    )


# --- hashes -----------------------------------------------------------------------------------------------


def fnv1a32(text: Column | str) -> Column:
    """FNV-1a (32 bit) over the UTF-8 bytes, without leaving the JVM."""
    # Read as Latin-1, every byte is one character whose code is the byte.
    octets = F.filter(F.split(F.decode(F.encode(col_of(text), "UTF-8"), "ISO-8859-1"), ""), lambda x: x != "")
    return F.aggregate(
        octets,
        F.lit(FNV_OFFSET).cast("bigint"),
        lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("bigint")) * F.lit(FNV_PRIME).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint")),
    )


def hmac_sha256(payload: Column | str, secret: str) -> Column:
    """``sha256=<hex>`` signature of a payload (HMAC: two nested digests over padded keys), inside the JVM."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda byte: F.unhex(F.lit(bytes(b ^ byte for b in key).hex()))
    inner = F.sha2(F.concat(pad(0x36), F.encode(col_of(payload), "UTF-8")), 256)
    return F.concat(F.lit("sha256="), F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256))
