"""Widget rule queries. The oracles restate the shipped rules as CASE expressions over raw type names."""

from __future__ import annotations

from pyspark.sql import functions as F

from schemahelm.operators import policy as p
from schemahelm.plans.registry import joined, query

# Registry fields with types and names that reach every shipped rule.
_RICH = """SELECT tenant_id, table_name, column_name, validator, k, CASE WHEN k % 31 = 0 THEN 'user_Password' ELSE 'c' || CAST(k AS STRING) END AS name,
 CASE k % 16 WHEN 0 THEN 'varchar(255)' WHEN 1 THEN 'varchar(500)' WHEN 2 THEN 'text' WHEN 3 THEN 'tinyint(1)' WHEN 4 THEN 'tinyint(4)' WHEN 5 THEN 'enum(''a'',''b'')' WHEN 6 THEN 'set(x, y)' WHEN 7 THEN 'date'
  WHEN 8 THEN 'time' WHEN 9 THEN 'timestamp' WHEN 10 THEN 'jsonb' WHEN 11 THEN 'bigint' WHEN 12 THEN 'decimal(10,2)' WHEN 13 THEN 'varchar' WHEN 14 THEN 'geometry' ELSE 'datetime' END AS data_type,
 CASE k % 3 WHEN 0 THEN 'core://auto' WHEN 1 THEN 'plugin://w5' ELSE 'plugin://select' END AS widget
 FROM (SELECT *, CAST(substr(column_name, 5) AS BIGINT) AS k FROM F_OLD) f"""


def _rich(x):
    x.F_OLD.createOrReplaceTempView("F_OLD")
    return x.spark.sql(_RICH).withColumnRenamed("column_name", "key").withColumnRenamed("name", "column_name")


_TYPE_WIDGET = """CASE k % 16 WHEN 3 THEN 'checkbox' WHEN 5 THEN 'select' WHEN 6 THEN 'multiselect' WHEN 7 THEN 'date-input' WHEN 8 THEN 'time-input' WHEN 9 THEN 'datetime-input' WHEN 15 THEN 'datetime-input'
 WHEN 10 THEN 'json-editor' WHEN 11 THEN 'number-input' WHEN 12 THEN 'number-input' ELSE CASE WHEN k % 16 IN (0, 1, 2, 13) AND k % 31 = 0 THEN 'password-input' WHEN k % 16 = 1 THEN 'textarea' ELSE 'text-input' END END"""
_RESOLVED = f"""'plugin://' || CASE validator WHEN 'email' THEN 'email-input' WHEN 'uuid' THEN 'uuid-input' WHEN 'regex' THEN 'text-input' ELSE {_TYPE_WIDGET} END"""


@query("r1_classify", f"SELECT table_name, column_name AS key, {_RESOLVED} AS resolved FROM ({_RICH}) r")
def classify(x):
    return p.classify(_rich(x), driver="mysql").select("table_name", "key", "resolved")


_OWN_RULES = [
    p.Rule("own", "plugin://w3", validator=["number"]),
    p.Rule("gone", "plugin://nowhere", types=["date"]),
    p.Rule("core", "core://raw", types=["jsonb"], driver=["MySQL"]),
    p.Rule("other", "core://never", driver=["postgres"]),
    p.Rule("long", "plugin://textarea", length_min=100),
]


@query(
    "r1_classify_unknown_plugin",
    f"""SELECT table_name, column_name AS key, CASE WHEN validator = 'number' THEN CASE WHEN EXISTS (SELECT 1 FROM F_WID WHERE id = 'w3') THEN 'plugin://w3' ELSE 'plugin://text-input' END WHEN k % 16 = 7 THEN 'plugin://text-input'
 WHEN k % 16 = 10 THEN 'core://raw' WHEN k % 16 IN (0, 1) THEN 'plugin://textarea' ELSE 'plugin://text-input' END AS resolved FROM ({_RICH}) r""",
)
def _(x):
    known = p.known_plugins(_OWN_RULES, x.F_WID)
    return p.classify(_rich(x), _OWN_RULES, known, "mysql").select("table_name", "key", "resolved")


_FIRST_RULE = """CASE validator WHEN 'email' THEN 'email' WHEN 'uuid' THEN 'uuid' WHEN 'regex' THEN 'regex' ELSE CASE k % 16 WHEN 3 THEN 'boolean' WHEN 5 THEN 'enum' WHEN 6 THEN 'set' WHEN 7 THEN 'date' WHEN 8 THEN 'time'
 WHEN 9 THEN 'datetime' WHEN 15 THEN 'datetime' WHEN 10 THEN 'json' WHEN 11 THEN 'int-like' WHEN 12 THEN 'decimal-like' ELSE CASE WHEN k % 16 IN (0, 1, 2, 13) AND k % 31 = 0 THEN 'password' WHEN k % 16 IN (0, 13) THEN 'string-short'
 WHEN k % 16 = 1 THEN 'string-long' ELSE 'fallback' END END END"""


@query("w7_first_matching_rule", f"SELECT table_name, column_name AS key, {_FIRST_RULE} AS rule_id FROM ({_RICH}) r")
def _(x):
    return p.matched_rule(_rich(x), driver="mysql").select("table_name", "key", "rule_id")


_BY_TYPE = f"""CASE WHEN k % 16 IN (0, 1, 2, 13) THEN list_concat(CASE WHEN k % 31 = 0 THEN ['password-input'] ELSE [] END, CASE k % 16 WHEN 1 THEN ['textarea'] WHEN 2 THEN [] ELSE ['text-input'] END)
 WHEN k % 16 IN (4, 14) THEN [] ELSE [{_TYPE_WIDGET}] END"""
_ALL_HITS = f"""list_concat(CASE validator WHEN 'email' THEN ['email-input'] WHEN 'uuid' THEN ['uuid-input'] WHEN 'regex' THEN ['text-input'] ELSE [] END, {_BY_TYPE}, ['text-input'])"""


def _suggest_sql(top: int) -> str:
    # Distinct in order of first appearance, cut after ``top`` (every shipped rule stops).
    return f"""SELECT table_name, column_name AS key, 'core://auto,' || array_to_string(list_transform(list_slice(list_filter(h, lambda w, i: list_position(h, w) = i), 1, {top}), lambda w: 'plugin://' || w), ',') AS suggestions
 FROM (SELECT *, {_ALL_HITS} AS h FROM ({_RICH}) r) q"""


@query("r2_suggest", _suggest_sql(6))
def _(x):
    return p.suggest(_rich(x), driver="mysql").select("table_name", "key", joined("suggestions").alias("suggestions"))


@query("r2_suggest_top_one", _suggest_sql(1))
def _(x):
    return p.suggest(_rich(x), top=1, driver="mysql").select("table_name", "key", joined("suggestions").alias("suggestions"))


_CONFIG = f"""CASE {_FIRST_RULE} WHEN 'email' THEN '{{"placeholder":"name@example.com"}}' WHEN 'uuid' THEN '{{"casing":"lower"}}' WHEN 'regex' THEN '{{"pattern":".*"}}'
 WHEN 'boolean' THEN '{{"falseLabel":"No","trueLabel":"Yes"}}' WHEN 'enum' THEN '{{"options":"a,b"}}' WHEN 'set' THEN '{{"options":"x,y"}}' WHEN 'date' THEN '{{"format":"YYYY-MM-DD"}}' WHEN 'time' THEN '{{"format":"HH:mm:ss"}}'
 WHEN 'datetime' THEN '{{"format":"YYYY-MM-DD HH:mm:ss","withTimezone":"false"}}' WHEN 'json' THEN '{{"mode":"code"}}' WHEN 'int-like' THEN '{{"step":1}}' WHEN 'decimal-like' THEN '{{"step":"0.01"}}'
 WHEN 'password' THEN '{{"reveal":false}}' WHEN 'string-short' THEN '{{"maxLength":"255"}}' WHEN 'string-long' THEN '{{"maxLength":"500","rows":5,"softWrap":true}}' ELSE '{{}}' END"""


@query("r3_render_config", f"SELECT table_name, column_name AS key, {_CONFIG} AS config FROM ({_RICH}) r")
def _(x):
    return p.render_config(_rich(x), driver="mysql").select("table_name", "key", "config")


@query("r4_resolve_widgets", f"SELECT table_name, column_name AS key, CASE WHEN widget = 'core://auto' THEN {_RESOLVED} ELSE widget END AS widget_resolved FROM ({_RICH}) r")
def resolve_widgets(x):
    known = p.known_plugins(p.DEFAULT_RULES, x.F_WID)
    return p.resolve_widgets(_rich(x), known=known, driver="mysql").select("table_name", "key", "widget_resolved")


@query(
    "r5_widget_known",
    """WITH q AS (SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'TextArea' ELSE 'W' || user_id END AS widget_id FROM events GROUP BY user_id) SELECT user_id, widget_id,
 user_id % 3 = 0 OR EXISTS (SELECT 1 FROM F_WID w WHERE w.id = lower(q.widget_id)) AS known FROM q""",
)
def _(x):
    own = F.concat(F.lit("W"), F.col("user_id").cast("string"))
    asked = x.events.select("user_id").distinct().withColumn("widget_id", F.when(F.col("user_id") % 3 == 0, F.lit("TextArea")).otherwise(own))
    return p.widget_known(asked, x.F_WID)
