"""Column defaults: unification of the request forms, normalisation per type, resolution to a clause."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemahelm.functions.text import TIME_LAYOUTS
from schemahelm.functions.typing import blank, col_of, folded

# --- fixed values -----------------------------------------------------------------------------------------
SQL_EXPRESSIONS = [
    "CURRENT_TIMESTAMP", "NOW()", "UTC_TIMESTAMP()", "CURRENT_DATE", "CURRENT_TIME", "CURDATE()", "CURTIME()",
]
MYSQL_EXPRESSIONS = ["CURRENT_TIMESTAMP", "NOW()", "UTC_TIMESTAMP()", "CURRENT_DATE", "CURRENT_TIME"]
POSTGRES_EXPRESSIONS = ["CURRENT_TIMESTAMP", "NOW()", "CURRENT_DATE", "CURRENT_TIME"]
TEMPORAL_TYPE = "timestamp|datetime|date|time"
MYSQL_NO_DEFAULT_TYPE = "text|blob|geometry|json"
ON_UPDATE_WARNING = "ON UPDATE is not allowed for this type; removed."
NOT_SUPPORTED = "default not supported for column type"
MONGO_EXPRESSION = "expression default is not supported for MongoDB"
# --- end of fixed values ----------------------------------------------------------------------------------


def _temporal(col_type: Column) -> Column:
    return folded(col_type).rlike(TEMPORAL_TYPE)


def _timestamp_call(expr: Column) -> Column:
    return expr.startswith("CURRENT_TIMESTAMP(")


def _canonical(raw: Column) -> Column:
    up = F.upper(F.trim(raw))
    return F.when(up == "CURDATE()", F.lit("CURRENT_DATE")).when(up == "CURTIME()", F.lit("CURRENT_TIME")).otherwise(up)


def is_sql_expression(raw: Column | str) -> Column:
    up = F.upper(F.trim(F.coalesce(col_of(raw), F.lit(""))))
    return up.isin(SQL_EXPRESSIONS) | _timestamp_call(up)


def unify_default(structured: Column | str, flat: Column | str, legacy: Column | str) -> Column:
    """One ``struct(mode, raw, on_update)`` from the three request forms.

    ``structured`` is ``struct(mode, raw, on_update)``; ``flat`` the same with any part NULL when absent;
    ``legacy`` is ``struct(has_default, value)``, whose mode follows from the text.
    """
    s, f, g = col_of(structured), col_of(flat), col_of(legacy)
    no = F.lit(False)

    def form(mode: Column, raw: Column, on_update: Column) -> Column:
        return F.struct(
            mode.alias("mode"), F.coalesce(raw, F.lit("")).alias("raw"), F.coalesce(on_update, no).alias("on_update")
        )

    flat_given = f["mode"].isNotNull() | f["raw"].isNotNull() | f["on_update"].isNotNull()
    flat_mode = F.coalesce(F.nullif(F.lower(f["mode"]), F.lit("")), F.lit("none"))
    legacy_mode = F.when(is_sql_expression(g["value"]), F.lit("expression")).otherwise(F.lit("literal"))
    return (
        F.when(F.coalesce(s["mode"] != "", no), form(F.lower(s["mode"]), s["raw"], s["on_update"]))
        .when(flat_given, form(flat_mode, f["raw"], f["on_update"]))
        .when(F.coalesce(g["has_default"], no), form(legacy_mode, g["value"], no))
        .otherwise(form(F.lit("none"), F.lit(""), no))
    )


def _mysql_allowed(expr: Column, col_type: Column) -> Column:
    fits_type = _temporal(col_type) | expr.isin("CURRENT_DATE", "CURRENT_TIME")
    return fits_type & (expr.isin(MYSQL_EXPRESSIONS) | _timestamp_call(expr))


def _literal_time(raw: Column) -> Column:
    """Timestamp of a literal in any accepted layout (a bare time of day counts as day zero)."""
    s = F.trim(raw)
    layouts = [*TIME_LAYOUTS, "yyyy-MM-dd"]
    bare_time = F.when(
        s.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$"),
        F.try_to_timestamp(F.concat(F.lit("0001-01-01 "), s), F.lit("yyyy-MM-dd HH:mm:ss")),
    )
    parsed = [F.try_to_timestamp(s, F.lit(layout)) for layout in layouts]
    return F.coalesce(*parsed, bare_time)


def _literal_part(raw: Column, date: bool) -> Column:
    """Date or time text of a literal; a value with a zone keeps its own wall clock."""
    s = F.trim(raw)
    wall = F.regexp_replace(s, r"(Z|[+-]\d\d:\d\d)$", "")
    wall = F.when(s.contains("T"), wall).otherwise(s)
    bare = s.rlike(r"^\d\d:\d\d:\d\d$")
    if date:
        return F.when(bare, F.lit("0000-01-01")).otherwise(F.substring(wall, 1, 10))
    return F.when(bare, s).when(F.length(wall) > 10, F.substring(wall, 12, 8)).otherwise(F.lit("00:00:00"))


def normalize_default(driver: Column | str, col_type: Column | str, mode: Column | str, raw: Column | str, on_update: Column | str) -> Column:
    """``struct(mode, raw, on_update, action, warning)`` after mapping, clearing or trimming for the type.

    Actions: ``as-is`` nothing to do, ``mapped`` rewritten to fit, ``cleared`` dropped because the type or
    the database cannot hold it.
    """
    drv, typ, m, r = col_of(driver), F.lower(col_of(col_type)), col_of(mode), F.coalesce(col_of(raw), F.lit(""))
    upd = F.coalesce(col_of(on_update), F.lit(False))
    up = _canonical(r)
    now_like = up.isin("CURRENT_TIMESTAMP", "NOW()") | _timestamp_call(up)
    mysql = drv == "mysql"
    is_expr = m == "expression"

    # What an expression default becomes: NULL keeps the text, '' clears, other text replaces it.
    def temporal_target(target: str) -> Column:
        return F.when(now_like | (up == target), F.lit(target)).otherwise(F.lit(""))

    stamp = typ.isin("datetime", "timestamp")
    target = (
        F.when(~is_expr, F.lit(None).cast("string"))
        .when(typ == "date", temporal_target("CURRENT_DATE"))
        .when(typ == "time", temporal_target("CURRENT_TIME"))
        .when(mysql & (~stamp | ~_mysql_allowed(up, col_of(col_type))), F.lit(""))
    )
    cleared = target == ""
    expr_mapped = is_expr & typ.isin("date", "time") & now_like

    literal = (m == "literal") & (F.trim(r) != "") & typ.isin("date", "time") & _literal_time(r).isNotNull()
    literal_text = F.when(typ == "date", _literal_part(r, True)).otherwise(_literal_part(r, False))

    out_mode = F.when(cleared, F.lit("none")).otherwise(m)
    out_raw = F.when(target.isNotNull(), target).when(literal, literal_text).otherwise(r)
    rewritten = target.isNotNull() | literal
    kept_upd = F.when(rewritten, F.lit(False)).otherwise(upd)
    drop_upd = mysql & (typ.isin("date", "time") | ~_temporal(col_of(col_type))) & kept_upd
    action = (
        F.when(F.coalesce(cleared, F.lit(False)), F.lit("cleared"))
        .when(expr_mapped | literal | drop_upd, F.lit("mapped"))
        .otherwise(F.lit("as-is"))
    )
    return F.struct(
        out_mode.alias("mode"),
        out_raw.alias("raw"),
        (kept_upd & ~drop_upd).alias("on_update"),
        action.alias("action"),
        F.when(drop_upd, F.lit(ON_UPDATE_WARNING)).alias("warning"),
    )


def resolve_default(driver: Column | str, col_type: Column | str, mode: Column | str, raw: Column | str, on_update: Column | str) -> Column:
    """``struct(clause, on_update_clause, norm, has_default, error)`` of a default; errors stay in the row."""
    drv, typ, m, r = col_of(driver), col_of(col_type), col_of(mode), F.coalesce(col_of(raw), F.lit(""))
    upd = F.coalesce(col_of(on_update), F.lit(False))
    is_expr = m == "expression"
    absent = (m == "none") | blank(r)
    mysql, postgres, mongo = drv == "mysql", drv == "postgres", drv.isin("mongo", "mongodb")

    my_expr = _canonical(r)
    pg_expr = F.trim(r)
    unsupported = lambda expr: F.concat(F.lit("unsupported expression for "), typ, F.lit(": "), expr)
    error = F.when(absent, F.lit(None).cast("string")).otherwise(
        F.when(mysql & folded(typ).rlike(MYSQL_NO_DEFAULT_TYPE), F.lit(NOT_SUPPORTED))
        .when(mysql & is_expr & ~_mysql_allowed(my_expr, typ), unsupported(my_expr))
        .when(postgres & is_expr & ~F.upper(pg_expr).isin(POSTGRES_EXPRESSIONS), unsupported(pg_expr))
        .when(mongo & is_expr, F.lit(MONGO_EXPRESSION))
        .when(~(mysql | postgres | mongo), F.lit("unknown driver"))
    )
    quoted = F.concat(F.lit("'"), F.replace(F.trim(r), F.lit("'"), F.lit("''")), F.lit("'"))
    literal = F.when(postgres & _temporal(typ), F.concat(quoted, F.lit("::timestamp"))).when(mongo, F.trim(r)).otherwise(quoted)
    norm = F.when(is_expr, F.when(mysql, my_expr).otherwise(pg_expr)).otherwise(literal)
    lower_type = F.lower(typ)
    wrap = mysql & is_expr & (
        ((lower_type == "date") & (my_expr == "CURRENT_DATE")) | ((lower_type == "time") & (my_expr == "CURRENT_TIME"))
    )
    shown = F.when(wrap, F.concat(F.lit("("), norm, F.lit(")"))).otherwise(norm)
    ok = ~absent & error.isNull()
    clause = F.when(ok & ~mongo, F.concat(F.lit(" DEFAULT "), shown)).otherwise(F.lit(""))
    stamped = ok & mysql & is_expr & upd & lower_type.isin("datetime", "timestamp")
    return F.struct(
        clause.alias("clause"),
        F.when(stamped, F.lit(" ON UPDATE CURRENT_TIMESTAMP")).otherwise(F.lit("")).alias("on_update_clause"),
        F.when(ok, norm).alias("norm"),
        ok.alias("has_default"),
        error.alias("error"),
    )
