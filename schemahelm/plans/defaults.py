"""Default-value queries. The oracles state the rules as plain CASE tables over the request forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from schemahelm.functions import defaults as df
from schemahelm.plans.registry import query

_FORMS = """CASE id % 4 WHEN 0 THEN mode END AS s_mode, CASE id % 4 WHEN 0 THEN raw END AS s_raw, CASE id % 4 WHEN 0 THEN on_update END AS s_upd,
 CASE id % 4 WHEN 1 THEN upper(mode) END AS f_mode, CASE WHEN id % 4 IN (1, 2) AND id % 3 <> 0 THEN raw END AS f_raw, CAST(NULL AS BOOLEAN) AS f_upd,
 id % 8 = 3 AS has_default, raw AS value"""
_IS_EXPR = "upper(trim(value)) IN ('CURRENT_TIMESTAMP', 'NOW()', 'UTC_TIMESTAMP()', 'CURRENT_DATE', 'CURRENT_TIME', 'CURDATE()', 'CURTIME()')"


@query(
    "p22_unify_default",
    f"""WITH q AS (SELECT id, {_FORMS} FROM F_DEF)
 SELECT id, CASE WHEN s_mode IS NOT NULL THEN s_mode WHEN f_mode IS NOT NULL OR f_raw IS NOT NULL THEN coalesce(lower(f_mode), 'none')
   WHEN has_default THEN CASE WHEN {_IS_EXPR} THEN 'expression' ELSE 'literal' END ELSE 'none' END AS mode,
  CASE WHEN s_mode IS NOT NULL THEN s_raw WHEN f_mode IS NOT NULL OR f_raw IS NOT NULL THEN coalesce(f_raw, '') WHEN has_default THEN value ELSE '' END AS raw,
  CASE WHEN s_mode IS NOT NULL THEN s_upd ELSE false END AS on_update FROM q""",
)
def _(x):
    x.F_DEF.createOrReplaceTempView("F_DEF")
    q = x.spark.sql(f"SELECT id, {_FORMS} FROM F_DEF")
    form = lambda p: F.struct(F.col(f"{p}_mode").alias("mode"), F.col(f"{p}_raw").alias("raw"), F.col(f"{p}_upd").alias("on_update"))
    return q.select("id", df.unify_default(form("s"), form("f"), F.struct("has_default", "value")).alias("d")).select("id", "d.*")


_UP = """CASE upper(trim(raw)) WHEN 'CURDATE()' THEN 'CURRENT_DATE' WHEN 'CURTIME()' THEN 'CURRENT_TIME' ELSE upper(trim(raw)) END"""
_NORM = f"""WITH q AS (SELECT *, {_UP} AS up, CASE WHEN {_UP} IN ('CURRENT_TIMESTAMP', 'NOW()') THEN true ELSE false END AS nowish,
   regexp_full_match(trim(raw), '\\d\\d\\d\\d-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d') AS stamp FROM F_DEF),
 r AS (SELECT *, CASE WHEN mode <> 'expression' THEN 'keep'
   WHEN col_type = 'date' THEN CASE WHEN nowish THEN 'map' WHEN up = 'CURRENT_DATE' THEN 'canon' ELSE 'clear' END
   WHEN col_type = 'time' THEN CASE WHEN nowish THEN 'map' WHEN up = 'CURRENT_TIME' THEN 'canon' ELSE 'clear' END
   WHEN driver = 'mysql' AND col_type IN ('datetime', 'timestamp') THEN CASE WHEN nowish OR up IN ('CURRENT_DATE', 'CURRENT_TIME') THEN 'keep' ELSE 'clear' END
   WHEN driver = 'mysql' THEN 'clear' ELSE 'keep' END AS fate,
   mode = 'literal' AND stamp AND col_type IN ('date', 'time') AS cut FROM q),
 s AS (SELECT *, on_update AND fate = 'keep' AND NOT cut AS kept, driver = 'mysql' AND col_type NOT IN ('datetime', 'timestamp') AS no_upd FROM r)
"""


@query(
    "p23_normalize_default",
    _NORM
    + """SELECT id, CASE fate WHEN 'clear' THEN 'none' ELSE mode END AS mode,
  CASE WHEN fate = 'clear' THEN '' WHEN fate IN ('map', 'canon') THEN 'CURRENT_' || upper(col_type) WHEN cut AND col_type = 'date' THEN substr(trim(raw), 1, 10)
   WHEN cut THEN substr(trim(raw), 12, 8) ELSE raw END AS raw, kept AND NOT no_upd AS on_update,
  CASE WHEN fate = 'clear' THEN 'cleared' WHEN fate = 'map' OR cut OR (kept AND no_upd) THEN 'mapped' ELSE 'as-is' END AS action,
  CASE WHEN kept AND no_upd THEN 'ON UPDATE is not allowed for this type; removed.' END AS warning FROM s""",
)
def _(x):
    n = df.normalize_default("driver", "col_type", "mode", "raw", "on_update")
    return x.F_DEF.select("id", n.alias("n")).select("id", "n.*")


_Q = "'''' || replace(trim(raw), '''', '''''') || ''''"


@query(
    "p24_resolve_default",
    f"""WITH q AS (SELECT *, {_UP} AS up, mode = 'none' OR trim(raw) = '' AS absent, col_type IN ('date', 'time', 'datetime', 'timestamp') AS temporal FROM F_DEF),
 r AS (SELECT *, CASE WHEN absent THEN NULL WHEN driver = 'mysql' AND col_type = 'text' THEN 'default not supported for column type'
   WHEN driver = 'mysql' AND mode = 'expression' AND NOT ((temporal OR up IN ('CURRENT_DATE', 'CURRENT_TIME')) AND up IN ('CURRENT_TIMESTAMP', 'NOW()', 'CURRENT_DATE', 'CURRENT_TIME'))
    THEN 'unsupported expression for ' || col_type || ': ' || up
   WHEN driver = 'postgres' AND mode = 'expression' AND upper(trim(raw)) NOT IN ('CURRENT_TIMESTAMP', 'NOW()', 'CURRENT_DATE', 'CURRENT_TIME')
    THEN 'unsupported expression for ' || col_type || ': ' || trim(raw) END AS error FROM q),
 s AS (SELECT *, NOT absent AND error IS NULL AS ok, CASE WHEN mode = 'expression' THEN CASE WHEN driver = 'mysql' THEN up ELSE trim(raw) END
   WHEN driver = 'postgres' AND temporal THEN {_Q} || '::timestamp' ELSE {_Q} END AS text,
   driver = 'mysql' AND mode = 'expression' AND ((col_type = 'date' AND up = 'CURRENT_DATE') OR (col_type = 'time' AND up = 'CURRENT_TIME')) AS wrap FROM r)
 SELECT id, CASE WHEN ok THEN ' DEFAULT ' || CASE WHEN wrap THEN '(' || text || ')' ELSE text END ELSE '' END AS clause,
  CASE WHEN ok AND driver = 'mysql' AND mode = 'expression' AND on_update AND col_type IN ('datetime', 'timestamp') THEN ' ON UPDATE CURRENT_TIMESTAMP' ELSE '' END AS on_update_clause,
  CASE WHEN ok THEN text END AS norm, ok AS has_default, error FROM s""",
)
def _(x):
    n = df.resolve_default("driver", "col_type", "mode", "raw", "on_update")
    return x.F_DEF.select("id", n.alias("n")).select("id", "n.*")
