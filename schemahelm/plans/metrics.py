"""Counter, histogram and fingerprint queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from schemahelm.operators import metrics as m
from schemahelm.plans.registry import query


@query("g1_fields_per_table", "SELECT table_name, count(*) AS fields FROM F_OLD GROUP BY table_name")
def _(x):
    return m.fields_per_table(x.F_OLD)


@query("g14_distinct_tables", "SELECT tenant_id, count(DISTINCT table_name) AS tables FROM F_OLD GROUP BY tenant_id")
def _(x):
    return m.count_distinct_tables(x.F_OLD, ["tenant_id"])


_WORDS = ", ".join(f"sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS w{i}" for i in range(4))


@query(
    "g6_state_hash",
    f"""WITH q AS (SELECT scopes, updated_seq, sha256(id || '@' || version || '#' || updated_seq) AS h FROM F_WID), g AS (SELECT scopes, {_WORDS}, count(*) AS items, max(updated_seq) AS last_modified FROM q GROUP BY scopes)
 SELECT scopes, sha256(items || ':' || w0 || ':' || w1 || ':' || w2 || ':' || w3) AS etag, items, last_modified FROM g""",
)
def _(x):
    return m.state_hash(x.F_WID, ["scopes"], updated_col="updated_seq")


@query(
    "g6_changed_groups",
    "SELECT scopes FROM F_WID GROUP BY scopes HAVING bool_or(id LIKE '%7' AND scopes <> 'tenant')",
)
def _(x):
    old = m.state_hash(x.F_WID, ["scopes"], updated_col="updated_seq")
    bumped = F.when(F.col("id").endswith("7") & (F.col("scopes") != "tenant"), F.lit("9.9.9")).otherwise(F.col("version"))
    new = m.state_hash(x.F_WID.withColumn("version", bumped), ["scopes"], updated_col="updated_seq")
    return m.changed_groups(new, old, ["scopes"]).select("scopes")


@query(
    "g6_changed_ranges",
    """SELECT DISTINCT scopes, left(sha256(id), 1) AS "range" FROM F_WID WHERE id LIKE '%7' AND scopes <> 'tenant' UNION SELECT DISTINCT scopes, left(sha256(id), 1) FROM F_WID WHERE id LIKE '%33'""",
)
def _(x):
    # Some widgets have a new version, others are gone.
    old = m.range_hashes(x.F_WID, ["scopes"], digits=1, updated_col="updated_seq")
    bumped = F.when(F.col("id").endswith("7") & (F.col("scopes") != "tenant"), F.lit("9.9.9")).otherwise(F.col("version"))
    new = m.range_hashes(x.F_WID.withColumn("version", bumped).where(~F.col("id").endswith("33")), ["scopes"], digits=1, updated_col="updated_seq")
    return m.changed_ranges(new, old, ["scopes"])


_PATH = "regexp_replace(path, '[0-9]+', ':id', 'g')"


@query("g7_request_counts", f"SELECT tenant, method, {_PATH} AS path, CAST(status AS VARCHAR) AS status, count(*) AS requests FROM F_API GROUP BY 1, 2, 3, 4")
def _(x):
    return m.request_counts(x.F_API)


@query(
    "g8_latency_histogram",
    f"""WITH b AS (SELECT * FROM (VALUES {', '.join(f"('{v:g}', {v})" for v in m.LATENCY_BUCKETS)}, ('+Inf', CAST('Infinity' AS DOUBLE))) AS v(le, bound)), q AS (SELECT tenant, method, {_PATH} AS path, duration_s FROM F_API)
 SELECT tenant, method, path, le, count(*) FILTER (duration_s <= bound) AS cumulative, round(sum(duration_s), 2) AS sum, count(*) AS count FROM q CROSS JOIN b GROUP BY tenant, method, path, le""",
)
def _(x):
    return m.latency_histogram(x.F_API)


@query("g9_audit_counts", "SELECT action, count(*) AS events FROM F_AUD GROUP BY action")
def _(x):
    return m.audit_counts(x.F_AUD)


@query("g9_apply_errors", "SELECT 'tbl_' || (user_id % 10) AS table_name, CASE event_id % 3 WHEN 0 THEN 'timeout' ELSE 'conflict' END AS error, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def _(x):
    errors = x.events.where("event_type = 'error'").select(
        F.concat(F.lit("tbl_"), (F.col("user_id") % 10).cast("string")).alias("table_name"),
        F.when(F.col("event_id") % 3 == 0, F.lit("timeout")).otherwise(F.lit("conflict")).alias("error"),
    )
    return m.apply_error_counts(errors)


@query("g10_failure_counts", "SELECT tkey, outcome = 'transient' AS transient, count(*) AS failures FROM F_HLT WHERE outcome <> 'ok' GROUP BY 1, 2")
def _(x):
    return m.failure_counts(x.F_HLT)


@query(
    "g10_state_gauge",
    """WITH l AS (SELECT tkey, max_by(outcome, seq) AS o FROM F_HLT GROUP BY tkey), s AS (SELECT tkey, CASE o WHEN 'ok' THEN 'closed' WHEN 'permanent' THEN 'open' ELSE 'half_open' END AS now FROM l)
 SELECT tkey, v.state, CAST(v.state = now AS BIGINT) AS value FROM s CROSS JOIN (VALUES ('closed'), ('open'), ('half_open')) AS v(state)""",
)
def _(x):
    last = x.F_HLT.groupBy("tkey").agg(F.max_by("outcome", "seq").alias("o"))
    state = F.when(F.col("o") == "ok", F.lit("closed")).when(F.col("o") == "permanent", F.lit("open")).otherwise(F.lit("half_open"))
    return m.state_gauge(last.select("tkey", state.alias("state")))
