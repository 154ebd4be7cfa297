"""Paging, searching and short lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemahelm.operators.slices import sorted_slices

DEFAULT_LIMIT = 50
MAX_LIMIT = 200


def clamp_limit(limit: int | None, default: int = DEFAULT_LIMIT, top: int = MAX_LIMIT) -> int:
    return default if not limit or limit <= 0 else min(limit, top)


def _sorts(order: Sequence[tuple[str, str]]) -> list[Column]:
    return [F.col(c).desc() if d == "desc" else F.col(c).asc() for c, d in order]


def after_cursor(order: Sequence[tuple[str, str]], after: dict, types: dict[str, str]) -> Column:
    """Rows strictly behind the cursor in a lexicographic order; NULLs are the smallest values, as in the sort."""
    cases, same = [], F.lit(True)
    for name, direction in order:
        column, value = F.col(name), F.lit(after[name]).cast(types[name])
        if direction == "desc":
            beyond = F.lit(False) if after[name] is None else F.coalesce(column < value, F.lit(True))
        else:
            beyond = column.isNotNull() if after[name] is None else F.coalesce(column > value, F.lit(False))
        cases.append(same & beyond)
        same = same & column.eqNullSafe(value)
    return reduce(lambda a, b: a | b, cases)


def keyset_page(df: DataFrame, order: Sequence[tuple[str, str]], after: dict | None = None, limit: int | None = None) -> DataFrame:
    """The page behind ``after`` (values of the order columns of the last row seen), with a ``more`` flag.

    Runs as a bounded top-k per partition; the flag comes from one extra row, so the only unpartitioned
    window sees at most ``limit + 1`` rows.
    """
    n = clamp_limit(limit)
    rows = df if after is None else df.where(after_cursor(order, after, dict(df.dtypes)))
    page = rows.orderBy(*_sorts(order)).limit(n + 1)
    # A constant key: the page is already cut to n + 1 rows.
    whole = Window.partitionBy(F.lit(1))
    ranked = page.withColumn("_rn", F.row_number().over(whole.orderBy(*_sorts(order))))
    return ranked.withColumn("more", F.max("_rn").over(whole) > n).where(F.col("_rn") <= n).drop("_rn")


def numbered_page(df: DataFrame, order: Sequence[tuple[str, str]], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in an order that tells all rows apart.

    The first page is a bounded top-k. For others the rows are range-partitioned once, and the row counts of the partitions
    tell which of them hold the page: no task sees the rows before it.
    """
    if offset <= 0:
        return df.orderBy(*_sorts(order)).limit(limit)
    return sorted_slices(df, _sorts(order)).page(offset, limit).drop("_pos")


def search(df: DataFrame, q: str, columns: Sequence[str] = (), arrays: Sequence[str] = ()) -> DataFrame:
    """Case-insensitive substring search over text columns and string arrays; an empty query keeps all."""
    if not q:
        return df
    needle = q.lower()
    hits = [F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False)) for c in columns]
    hits += [F.coalesce(F.exists(F.col(c), lambda x: F.lower(x).contains(needle)), F.lit(False)) for c in arrays]
    return df.where(reduce(lambda a, b: a | b, hits, F.lit(False)))


def user_filter(users: DataFrame, tenant: str, term: str = "", without_role: int = 0, user_roles: DataFrame | None = None) -> DataFrame:
    rows = search(users.where(F.col("tenant_id") == tenant), term, ["username"])
    if without_role > 0 and user_roles is not None:
        holders = user_roles.where(F.col("role_id") == without_role).select(F.col("user_id").alias("id"))
        rows = rows.join(holders, "id", "left_anti")
    return rows


def user_page(
    users: DataFrame,
    user_roles: DataFrame,
    roles: DataFrame,
    tenant: str,
    page: int = 1,
    per_page: int = 20,
    sort: str = "username",
    order: str = "asc",
    term: str = "",
    without_role: int = 0,
) -> DataFrame:
    """A numbered page of users with their role names and the total number of hits.

    Ties are broken by id so that pages never overlap. Role names are gathered for the page only.
    """
    if sort not in ("username", "created_at"):
        raise ValueError("sort must be one of [username, created_at]")
    if order.lower() not in ("asc", "desc"):
        raise ValueError("order must be one of [asc, desc]")
    per = clamp_limit(per_page, default=20)
    hits = user_filter(users, tenant, term, without_role, user_roles)
    keys = [(sort, order.lower()), ("id", "asc")]
    rows = numbered_page(hits.select("id", *dict.fromkeys(["username", sort])), keys, (max(page, 1) - 1) * per, per).select("id", "username")
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    # At most ``per`` users: their memberships are few, and names per user are distinct role names.
    named = user_roles.join(F.broadcast(rows.select(F.col("id").alias("user_id"))), "user_id", "left_semi").join(
        roles.select(F.col("id").alias("role_id"), F.col("name").alias("role")), "role_id"
    )
    names = named.groupBy(F.col("user_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
    return _with_total(rows.join(names, "id", "left").withColumn("roles", F.coalesce("roles", F.lit(""))), total)


def _with_total(rows: DataFrame, total: DataFrame) -> DataFrame:
    """The page with the one-row ``total``; a page past the end is one row that has nothing but the total."""
    one = total.withColumn("_one", F.lit(1)).join(rows.withColumn("_one", F.lit(1)), "_one", "left")
    return one.select(*rows.columns, "total")


def widget_filter(widgets: DataFrame, scopes: Sequence[str] = (), tenant: str = "", q: str = "") -> DataFrame:
    """Widgets of any of the scopes, visible to the tenant, matching the query.

    A widget with tenant scope and a tenant list is visible to the listed tenants only.
    """
    df = widgets
    if scopes:
        df = df.where(F.arrays_overlap("scopes", F.array(*[F.lit(s) for s in scopes])))
    if tenant:
        listed = F.coalesce(F.size("tenants"), F.lit(0)) > 0
        hidden = F.array_contains("scopes", "tenant") & listed & ~F.array_contains("tenants", tenant)
        df = df.where(~hidden)
    return search(df, q, [c for c in ("id", "name", "description") if c in df.columns])


def list_widgets(widgets: DataFrame, scopes: Sequence[str] = (), tenant: str = "", q: str = "", limit: int = 0, offset: int = 0) -> DataFrame:
    """A page of widgets by id, with the total number of hits."""
    hits = widget_filter(widgets, scopes, tenant, q)
    rows = numbered_page(hits, [("id", "asc")], offset, clamp_limit(limit))
    return _with_total(rows, hits.agg(F.count(F.lit(1)).alias("total")))


def list_failed(dlq: DataFrame) -> DataFrame:
    """Failed events by id."""
    return dlq.orderBy("id")


def current_version(versions: DataFrame, column: str = "version") -> DataFrame:
    """Latest schema version; 0 where none has been applied."""
    return versions.agg(F.coalesce(F.max(column), F.lit(0)).alias(column))
