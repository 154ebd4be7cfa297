"""Label, selector and routing queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemahelm.functions import labels as lb
from schemahelm.operators import metrics
from schemahelm.operators import routing as r
from schemahelm.plans.registry import joined, query
from schemahelm.plans.types import _FNV_SQL
from schemahelm.sources.targets import split_labels

_SET = "list_sort(list_distinct(list_concat(string_split(lower(labels), ','), list_transform(list_filter(string_split(lower(labels), ','), lambda l: l LIKE '%=%'), lambda l: split_part(l, '=', 1)))))"
_T = f"t AS (SELECT tkey, driver, labels, {_SET} AS ls FROM F_TGT)"


def targets(x):
    return split_labels(x.F_TGT)


@query(
    "p16_norm_label",
    "SELECT s_suppkey, regexp_replace(lower(trim(s_name)), '[^a-z0-9_./-]', '', 'g') AS norm, 'region=' || regexp_replace(lower(s_name), '[^a-z0-9_./-]', '', 'g') AS kv, CAST(NULL AS VARCHAR) AS no_kv FROM supplier",
)
def _(x):
    name = F.concat(F.lit("  "), "s_name", F.lit("! "))
    return x.supplier.select(
        "s_suppkey", lb.norm_label(name).alias("norm"), lb.label_kv(F.lit("Region"), name).alias("kv"), lb.label_kv(F.lit("!"), name).alias("no_kv")
    )


@query("p17_label_set", f"WITH {_T} SELECT tkey, array_to_string(ls, ',') AS labels FROM t")
def _(x):
    return targets(x).select("tkey", joined("label_set").alias("labels"))


@query(
    "p18_labels_from_map",
    """SELECT request_id, 'tier=' || replace(prefer_label, '=', '') || ',tier' || CASE WHEN explicit_key IS NOT NULL THEN ',key=' || replace(explicit_key, ':', '') || ',key' ELSE '' END || ',app=core,app' AS labels FROM F_REQ""",
)
def _(x):
    source = F.create_map(F.lit("X-Tier"), "prefer_label", F.lit("X-Key"), "explicit_key", F.lit("X-Again"), "prefer_label")
    labels = lb.labels_from_map(source, {"X-Tier": "tier", "X-Key": "key", "X-Again": "tier", "X-None": "none"}, {"app": "Core"})
    return x.F_REQ.select("request_id", joined(labels).alias("labels"))


@query("v11_has_all_labels", "SELECT tkey FROM F_TGT WHERE list_contains(string_split(labels, ','), 'tier=gold') AND list_contains(string_split(labels, ','), 'Deprecated')")
def _(x):
    return targets(x).where(lb.has_all_labels("labels", ["tier=gold", "Deprecated"])).select("tkey")


_HAS = lambda label: f"list_contains(ls, '{label}')"
_SELECTORS = {
    "Tier=Gold": _HAS("tier=gold"),
    "region=asia, TIER in (gold,silver) ,!deprecated": f"{_HAS('region=asia')} AND ({_HAS('tier=gold')} OR {_HAS('tier=silver')}) AND NOT {_HAS('deprecated')}",
    "!deprecated": f"NOT {_HAS('deprecated')}",
    "deprecated": _HAS("deprecated"),
    "region": "true",
    "region=asia|region=europe,tier=gold": f"{_HAS('region=asia')} OR ({_HAS('region=europe')} AND {_HAS('tier=gold')})",
    "": "true",
    "tier in ()": "false",
    "unknown": "false",
    "region=asia|": "true",
}


@query(
    "l1_selectors",
    f"WITH {_T} " + " UNION ALL ".join(f"SELECT {i} AS q, tkey FROM t WHERE {cond}" for i, cond in enumerate(_SELECTORS.values())),
)
def _(x):
    t = targets(x)
    return reduce(DataFrame.unionByName, [r.select_targets(t, s).select(F.lit(i).alias("q"), "tkey") for i, s in enumerate(_SELECTORS)])


@query("l1_selector_from_labels", f"WITH {_T} SELECT tkey FROM t WHERE {_HAS('tier=gold')} AND {_HAS('deprecated')}")
def _(x):
    return r.select_targets(targets(x), ["tier=gold", "", "deprecated"]).select("tkey")


@query(
    "l2_find_labels",
    f"""WITH {_T} SELECT 'one' AS how, tkey FROM t WHERE {_HAS('deprecated')} UNION ALL SELECT 'all', tkey FROM t WHERE {_HAS('tier=gold')} AND {_HAS('region=asia')}
 UNION ALL SELECT 'any', tkey FROM t WHERE {_HAS('region=africa')} OR {_HAS('region=asia')}""",
)
def _(x):
    t = targets(x)
    found = {
        "one": r.find_label(t, "Deprecated"),
        "all": r.find_all(t, "tier=GOLD", "Region=Asia"),
        "any": r.find_any(t, "region=AFRICA", "region=ASIA", "none"),
        "nothing": r.find_all(t).unionByName(r.find_any(t)),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(how).alias("how"), "tkey") for how, df in found.items()])


_CAND = f"{_T}, c AS (SELECT tkey, ls, row_number() OVER (ORDER BY tkey) - 1 AS idx, count(*) OVER () AS n FROM t WHERE NOT {_HAS('deprecated')})"


@query("l4_route_first", f"WITH {_CAND} SELECT request_id, (SELECT min(tkey) FROM c) AS chosen FROM F_REQ")
def _(x):
    return r.route(x.F_REQ, targets(x), "first", "!deprecated").select("request_id", "chosen")


@query(
    "l4_route_prefer",
    f"""WITH {_CAND}, l AS (SELECT DISTINCT prefer_label FROM F_REQ), b AS (SELECT prefer_label, EXISTS (SELECT 1 FROM t WHERE list_contains(ls, prefer_label)) AS held,
  (SELECT min(tkey) FROM c WHERE list_contains(c.ls, prefer_label)) AS best FROM l) SELECT request_id, CASE WHEN held THEN coalesce(best, (SELECT min(tkey) FROM c)) END AS chosen FROM F_REQ r JOIN b ON b.prefer_label = r.prefer_label""",
)
def _(x):
    return r.route(x.F_REQ, targets(x), "prefer", "!deprecated").select("request_id", "chosen")


@query(
    "l4_route_hash",
    f"WITH {_CAND}, h AS (SELECT request_id, {_FNV_SQL.format(c='hash_source')} AS h FROM F_REQ) SELECT request_id, c.tkey AS chosen FROM h JOIN c ON c.idx = h.h % c.n",
)
def route_hash(x):
    return r.route(x.F_REQ, targets(x), "hash", "!deprecated").select("request_id", "chosen")


@query(
    "l5_resolve_target",
    f"""WITH {_CAND}, q AS (SELECT request_id, explicit_key, CASE WHEN request_id % 3 <> 2 THEN (SELECT min(tkey) FROM c) END AS pick, CASE WHEN request_id % 4 = 0 THEN '' ELSE CAST(request_id % 13 AS VARCHAR) END AS tenant FROM F_REQ)
 SELECT request_id, coalesce((SELECT tkey FROM t WHERE t.tkey = q.explicit_key), pick, (SELECT tkey FROM t WHERE tenant <> '' AND t.tkey = 'db:' || q.tenant), 'db:default') AS resolved FROM q""",
)
def _(x):
    t = targets(x)
    reqs = x.F_REQ.withColumn("tenant_id", F.when(F.col("request_id") % 4 == 0, F.lit("")).otherwise((F.col("request_id") % 13).cast("string")))
    routed = r.route(reqs, t, "first", "!deprecated").withColumn("chosen", F.when(F.col("request_id") % 3 != 2, F.col("chosen")))
    return r.resolve_target(routed, t, tenant_prefix="db:", default_key="db:default").select("request_id", "resolved")


_ORDERS = f"""{_T}, u AS (SELECT * FROM t WHERE tkey <> 'db:2'), r AS (SELECT request_id, prefer_label AS want, (SELECT tkey FROM u WHERE u.tkey = q.explicit_key) AS pri FROM F_REQ q),
 d AS (SELECT DISTINCT pri, want FROM r),
 o AS (SELECT d.pri, d.want, u.tkey, row_number() OVER (PARTITION BY d.pri, d.want ORDER BY CASE WHEN u.tkey = d.pri THEN 0 WHEN list_contains(u.ls, d.want) THEN 1 ELSE 2 END, u.tkey) AS position
  FROM d JOIN u ON u.tkey IS NOT DISTINCT FROM d.pri OR list_contains(u.ls, d.want) OR NOT {_HAS('deprecated')})"""


def _shut(x):
    return x.spark.createDataFrame([("db:2",)], "tkey string")


@query("l6_candidates", f"WITH {_ORDERS} SELECT pri AS \"primary\", want, CAST(position AS INTEGER) AS position, tkey FROM o")
def _(x):
    return r.candidates(x.F_REQ, targets(x), "!deprecated", _shut(x))


@query(
    "l6_candidate_at",
    f"WITH {_ORDERS} SELECT r.request_id, o.tkey FROM r LEFT JOIN o ON o.pri IS NOT DISTINCT FROM r.pri AND o.want = r.want AND o.position = 1 + r.request_id % 30",
)
def _(x):
    return r.candidate_at(x.F_REQ, targets(x), 1 + F.col("request_id") % 30, "!deprecated", _shut(x)).select("request_id", "tkey")


@query("l7_for_each_target", f"WITH {_T} SELECT tkey, CAST(len(ls) AS BIGINT) AS n_labels FROM t WHERE {_HAS('tier=gold')}")
def _(x):
    def job(row: dict) -> dict:
        return {"tkey": row["tkey"], "n_labels": len(row["label_set"])}

    return r.for_each_target(targets(x), "tier=gold", job, "tkey string, n_labels bigint")


_ATTEMPTS = """SELECT CAST(floor(seq / 5) AS BIGINT) AS request_id, seq AS attempt_no, tkey, outcome, seq % 7 <> 3 AS available FROM F_HLT"""


@query(
    "l8_attempt_outcome",
    f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY attempt_no) AS rn FROM ({_ATTEMPTS}) q WHERE available), m AS (SELECT * FROM a WHERE rn <= 3),
 e AS (SELECT request_id, min(rn) FILTER (outcome <> 'transient') AS fin, count(*) AS n FROM m GROUP BY request_id)
 SELECT e.request_id, CASE WHEN fin IS NULL THEN 'exhausted' WHEN m.outcome = 'ok' THEN 'ok' ELSE 'failed' END AS status, coalesce(fin, n) AS attempts, m.tkey,
  CAST(CASE coalesce(fin - 1, n) WHEN 0 THEN 0 WHEN 1 THEN 100 WHEN 2 THEN 300 ELSE 550 END AS BIGINT) AS waited_ms FROM e LEFT JOIN m ON m.request_id = e.request_id AND m.rn = e.fin""",
)
def _(x):
    x.F_HLT.createOrReplaceTempView("F_HLT")
    return r.attempt_outcome(x.spark.sql(_ATTEMPTS), 3, base_ms=100, max_ms=250)


@query("u4_classify_errors", "SELECT seq, seq % 6 < 4 AS transient, seq % 6 < 4 AS retryable FROM F_HLT")
def _(x):
    codes = F.array(*[F.lit(c) for c in [*r.TRANSIENT_ERRORS, "syntax", "constraint"]])
    code = F.get(codes, (F.col("seq") % 6).cast("int"))
    return x.F_HLT.select("seq", r.classify_errors(code).alias("c")).select("seq", "c.*")


@query("g4_label_counts", f"WITH {_T} SELECT label, count(*) AS targets FROM (SELECT unnest(list_concat([''], ls)) AS label FROM t) GROUP BY label")
def _(x):
    return metrics.label_counts(targets(x))


@query("g5_label_index", f"WITH {_T} SELECT DISTINCT unnest(ls) AS label, tkey FROM t")
def _(x):
    return metrics.label_index(targets(x))
