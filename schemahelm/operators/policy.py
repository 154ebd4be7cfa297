"""Widget rules: ordered first-match classification compiled to column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemahelm.functions import typing as ty

FALLBACK = "plugin://text-input"


@dataclass(frozen=True)
class Rule:
    """One rule; an empty condition does not restrict."""

    id: str
    widget: str
    validator: Sequence[str] = ()
    types: Sequence[str] = ()
    driver: Sequence[str] = ()
    length_min: int | None = None
    length_max: int | None = None
    name_regex: str = ""
    config: dict = field(default_factory=dict)
    stop: bool = True


# --- fixed values -----------------------------------------------------------------------------------------
BUILTIN_WIDGETS = [
    "text-input", "textarea", "number-input", "checkbox", "date-input", "time-input", "datetime-input",
    "json-editor", "select", "multiselect", "password-input", "email-input", "url-input", "uuid-input",
]
SUGGEST_TOP = 6
_ENUM = '{{ join .EnumValues "," }}'
DEFAULT_RULES = [
    Rule("email", "plugin://email-input", validator=["email"], config={"placeholder": "name@example.com"}),
    Rule("url", "plugin://url-input", validator=["url"], config={"placeholder": "https://"}),
    Rule("uuid", "plugin://uuid-input", validator=["uuid"], config={"casing": "lower"}),
    Rule("regex", "plugin://text-input", validator=["regex"], config={"pattern": ".*"}),
    Rule("boolean", "plugin://checkbox", types=["bool", "boolean", "tinyint(1)"], config={"trueLabel": "Yes", "falseLabel": "No"}),
    Rule("enum", "plugin://select", types=["enum"], config={"options": _ENUM}),
    Rule("set", "plugin://multiselect", types=["set"], config={"options": _ENUM}),
    Rule("date", "plugin://date-input", types=["date"], config={"format": "YYYY-MM-DD"}),
    Rule("time", "plugin://time-input", types=["time"], config={"format": "HH:mm:ss"}),
    Rule(
        "datetime", "plugin://datetime-input", types=["datetime", "timestamp", "timestamptz"],
        config={"format": "YYYY-MM-DD HH:mm:ss", "withTimezone": '{{ eq .Type "timestamptz" }}'},
    ),
    Rule("json", "plugin://json-editor", types=["json", "jsonb"], config={"mode": "code"}),
    Rule("int-like", "plugin://number-input", types=["int", "integer", "bigint", "smallint"], config={"step": 1}),
    Rule("decimal-like", "plugin://number-input", types=["decimal", "numeric", "float", "double", "real"], config={"step": "0.01"}),
    Rule(
        "password", "plugin://password-input", name_regex="(?i)(password|passwd|secret)",
        types=["varchar", "char", "text", "mediumtext", "longtext"], config={"reveal": False},
    ),
    Rule("string-short", "plugin://text-input", types=["varchar", "char"], length_max=255, config={"maxLength": "{{ or .Length 255 }}"}),
    Rule(
        "string-long", "plugin://textarea", types=["varchar", "char", "text", "mediumtext", "longtext"], length_min=256,
        config={"rows": 5, "maxLength": "{{ .Length }}", "softWrap": True},
    ),
    Rule("fallback", "plugin://text-input"),
]
# --- end of fixed values ----------------------------------------------------------------------------------


def rule_context(fields: DataFrame, driver: str = "postgres") -> DataFrame:
    """Add what rules look at: ``r_driver, r_type, r_validator, r_length, r_enums, r_name``."""
    drv = F.col("driver") if "driver" in fields.columns else F.lit(driver)
    typ = ty.parse_type("data_type")
    return fields.withColumns(
        {
            "r_driver": F.lower(drv),
            "r_type": ty.policy_type(drv, typ["base"], typ["length"]),
            "r_validator": ty.norm_validator("validator"),
            "r_length": typ["length"],
            "r_enums": typ["enums"],
            "r_name": F.col("column_name"),
        }
    )


_CONTEXT = ["r_driver", "r_type", "r_validator", "r_length", "r_enums", "r_name"]


def matches(rule: Rule) -> Column:
    """Condition of one rule over the context columns.

    A minimum length needs a known length; a maximum lets an unknown length pass.
    """
    conds = []
    for values, name in ((rule.driver, "r_driver"), (rule.validator, "r_validator"), (rule.types, "r_type")):
        if values:
            conds.append(F.col(name).isin([v.strip().lower() for v in values]))
    length = F.col("r_length")
    if rule.length_min is not None:
        conds.append(length.isNotNull() & (length >= rule.length_min))
    if rule.length_max is not None:
        conds.append(length.isNull() | (length <= rule.length_max))
    if rule.name_regex:
        conds.append(F.col("r_name").rlike(rule.name_regex))
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def known_plugins(rules: Sequence[Rule], widgets: DataFrame) -> set[str]:
    """Which plug-in widgets of the rules exist in a widget table (reads at most one row per rule)."""
    wanted = {r.widget.removeprefix("plugin://").lower() for r in rules if r.widget.startswith("plugin://")}
    open_ids = sorted(wanted - set(BUILTIN_WIDGETS))
    if not open_ids:
        return set(wanted)
    rows = widgets.where(F.col("id").isin(open_ids)).select("id").distinct().collect()
    return (wanted & set(BUILTIN_WIDGETS)) | {r[0] for r in rows}


def _usable(widget: str, known: set[str] | None) -> bool:
    if known is None or not widget.startswith("plugin://"):
        return True
    name = widget.removeprefix("plugin://").lower()
    return name in known or name in BUILTIN_WIDGETS


def _first_match(rules: Sequence[Rule], value) -> Column | None:
    chain = None
    for rule in rules:
        chain = (F if chain is None else chain).when(matches(rule), value(rule))
    return chain


def classify(fields: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, known: set[str] | None = None, driver: str = "postgres", out: str = "resolved") -> DataFrame:
    """First matching rule's widget; an unknown plug-in falls back to the text input.

    All rules become one CASE expression over the row.
    """
    chain = _first_match(rules, lambda r: F.lit(r.widget if _usable(r.widget, known) else FALLBACK))
    widget = F.lit(FALLBACK) if chain is None else chain.otherwise(F.lit(FALLBACK))
    return rule_context(fields, driver).withColumn(out, widget).drop(*_CONTEXT)


def matched_rule(fields: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, driver: str = "postgres", out: str = "rule_id") -> DataFrame:
    """Id of the first matching rule."""
    return rule_context(fields, driver).withColumn(out, _first_match(rules, lambda r: F.lit(r.id))).drop(*_CONTEXT)


def suggest(fields: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, top: int = SUGGEST_TOP, driver: str = "postgres", out: str = "suggestions") -> DataFrame:
    """Ordered distinct widgets of all matching rules after ``core://auto``.

    A matching rule with ``stop`` ends the list once ``top`` widgets are on it.
    """
    entries = F.array(
        *[F.struct(matches(r).alias("hit"), F.lit(r.widget).alias("widget"), F.lit(r.stop).alias("stop")) for r in rules]
    )
    start = F.struct(F.array().cast("array<string>").alias("list"), F.lit(False).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        grown = F.when(F.array_contains(acc["list"], x["widget"]), acc["list"]).otherwise(F.array_append(acc["list"], x["widget"]))
        ends = x["stop"] & (F.size(grown) >= top)
        return F.when(acc["done"] | ~x["hit"], acc).otherwise(F.struct(grown.alias("list"), ends.alias("done")))

    found = F.aggregate(F.filter(entries, lambda x: x["hit"]), start, step, lambda acc: acc["list"])
    listed = F.when(F.size(found) == 0, F.array(F.lit(FALLBACK))).otherwise(found)
    return rule_context(fields, driver).withColumn(out, F.concat(F.array(F.lit("core://auto")), listed)).drop(*_CONTEXT)


# --- config templates -------------------------------------------------------------------------------------

_ATTR = {"Driver": "r_driver", "Type": "r_type", "Validator": "r_validator", "Length": "r_length", "Name": "r_name", "EnumValues": "r_enums"}
_FORMS = [
    (re.compile(r'^\{\{\s*join \.(\w+) "([^"]*)"\s*\}\}$'), lambda c, arg: F.array_join(F.coalesce(c, F.array().cast("array<string>")), arg)),
    (re.compile(r"^\{\{\s*or \.(\w+) (\S+)\s*\}\}$"), lambda c, arg: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(arg.strip('"')))),
    (re.compile(r'^\{\{\s*eq \.(\w+) "([^"]*)"\s*\}\}$'), lambda c, arg: (c.cast("string") == arg).cast("string")),
    (re.compile(r"^\{\{\s*\.(\w+)()\s*\}\}$"), lambda c, arg: c.cast("string")),
]


def _config_value(value) -> Column:
    if isinstance(value, str):
        for form, build in _FORMS:
            hit = form.match(value)
            if hit and hit[1] in _ATTR:
                return build(F.col(_ATTR[hit[1]]), hit[2])
    return F.lit(value)


def render_config(fields: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, known: set[str] | None = None, driver: str = "postgres", out: str = "config") -> DataFrame:
    """JSON configuration of the first matching rule, its templates filled from the row (keys sorted)."""

    def rendered(rule: Rule) -> Column:
        if not rule.config or not _usable(rule.widget, known):
            return F.lit("{}")
        return F.to_json(F.struct(*[_config_value(rule.config[k]).alias(k) for k in sorted(rule.config)]))

    chain = _first_match(rules, rendered)
    text = F.lit("{}") if chain is None else chain.otherwise(F.lit("{}"))
    return rule_context(fields, driver).withColumn(out, text).drop(*_CONTEXT)


def resolve_widgets(fields: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, known: set[str] | None = None, driver: str = "postgres") -> DataFrame:
    """``widget_resolved``: the rules' choice for automatic widgets, the configured widget otherwise."""
    df = classify(fields, rules, known, driver, out="_auto")
    return df.withColumn("widget_resolved", F.when(F.col("widget") == "core://auto", F.col("_auto")).otherwise(F.col("widget"))).drop("_auto")


def widget_known(df: DataFrame, widgets: DataFrame, column: str = "widget_id", out: str = "known") -> DataFrame:
    """Is a widget id built in or registered? Ids are compared in lower case."""
    ids = widgets.select(F.col("id").alias("_w")).distinct().withColumn("_hit", F.lit(True))
    low = F.lower(F.col(column))
    joined = df.join(ids, low == F.col("_w"), "left")
    return joined.withColumn(out, low.isin(BUILTIN_WIDGETS) | F.col("_hit").isNotNull()).drop("_w", "_hit")
