"""Streaming queries, each drained with an ``availableNow`` trigger over the driver's event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemahelm.operators import breaker as b
from schemahelm.operators import merge
from schemahelm.operators.diff import diff
from schemahelm.operators.slices import sorted_slices
from schemahelm.plans.changes import _DIFF
from schemahelm.plans.upserts import _SCAN, _SUMMARY, _scan
from schemahelm.plans.fixtures import VIEWS
from schemahelm.plans.labels import targets
from schemahelm.plans.registry import query, ts_sql, ts_text
from schemahelm.plans.scans import write_widget_files
from schemahelm.session import scratch_path
from schemahelm.streaming import events as ev
from schemahelm.streaming import state as st


def stream_of(x, table: str, view: str) -> DataFrame:
    """A view over the stream of one table's files."""
    schema = getattr(x, table).schema
    source = x.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(x.sf_dir)
    source.createOrReplaceTempView(table)
    return x.spark.sql(VIEWS[view])


def in_batches(df: DataFrame, order: list[str], batches: int) -> DataFrame:
    """A stream of ``df`` along ``order``, in about as many micro-batches: the file source takes one file after the other."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "batches")
    whole = sorted_slices(df, order, batches).rows
    for i in range(batches):
        whole.where(F.col("_slice") == i).drop("_slice").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drain(running) -> None:
    running.awaitTermination()


def flaky(rows, attempt):
    """Test sender: a row fails as often as it says."""
    return ["refused" if n >= attempt else None for n in rows["failing_attempts"]]


def dead(rows, attempt):
    return ["down"] * len(rows)


_NOW = "TIMESTAMP '2024-06-01 12:00:00'"


_ATTRS = ["data_type", "db_id", "default_value", "driver_extras", "has_default", "is_nullable", "is_unique", "kind", "label_key", "validator", "widget", "widget_config"]
_SIDE = lambda s: "{" + ", ".join(["'table_name': table_name", "'column_name': column_name", *(f"'{c}': {s}_{c}" for c in _ATTRS)]) + "}"


@query(
    "t1_change_events",
    _DIFF
    + f"""SELECT CASE change_type WHEN 'added' THEN 'cf.field.created' WHEN 'deleted' THEN 'cf.field.deleted' ELSE 'cf.field.updated' END AS name, {ts_sql(_NOW)} AS time,
 table_name || '.' || column_name AS id, CASE change_type WHEN 'added' THEN to_json({_SIDE('new')})::VARCHAR WHEN 'deleted' THEN to_json({{'table': table_name, 'column': column_name}})::VARCHAR
  ELSE to_json({{'before': {_SIDE('old')}, 'after': {_SIDE('new')}}})::VARCHAR END AS data FROM chg WHERE change_type <> 'unchanged'""",
)
def _(x):
    now = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")
    out = ev.change_events(diff(x.F_OLDX.drop("k"), x.F_NEWX.drop("k")), now)
    return out.select("name", ts_text("time").alias("time"), "id", "data")


@query(
    "t1_scan_events",
    _SCAN
    + f"""SELECT 'cf.scan' AS name, {ts_sql(_NOW)} AS time, CAST(db_id AS VARCHAR) AS id, '{{"total":' || (inserted + updated + skipped) || ',"inserted":' || inserted || ',"updated":' || updated
 || ',"skipped":' || skipped || ',"db_id":' || db_id || ',"tables":' || tables || '}}' AS data FROM (SELECT tenant_id, db_id, {_SUMMARY} FROM r GROUP BY tenant_id, db_id)""",
)
def _(x):
    now = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")
    out = ev.scan_events(merge.scan_databases(*_scan(x), ["email"]).summary, now)
    return out.select("name", ts_text("time").alias("time"), "id", "data")


_PAYLOAD = """'{"name":"' || name || '","time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '","data":' || replace(data, ' ', '') || ',"id":"' || id || '"}'"""


def _with_time_text(df):
    return df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"))


@query("s20_event_payload", f"SELECT CAST(id AS VARCHAR) AS key, {_PAYLOAD} AS value FROM F_EVT")
def _(x):
    path = scratch_path(x.spark, "sink")
    events = _with_time_text(stream_of(x, "events", "F_EVT"))
    _drain(ev.write_events(events, "parquet", {"path": path}, scratch_path(x.spark, "cp")).trigger(availableNow=True).start())
    return x.spark.read.parquet(path)


def _pad(key: bytes, byte: int) -> str:
    return bytes(b ^ byte for b in key.ljust(64, b"\0")).hex()


_SECRET = "k3y"
_INNER = f"sha256(unhex('{_pad(_SECRET.encode(), 0x36)}') || encode(payload))"
_SIGNED = f"'sha256=' || sha256(unhex('{_pad(_SECRET.encode(), 0x5C)}') || unhex({_INNER}))"


@query("s21_sign_events", f"SELECT id, payload, {_SIGNED} AS signature FROM (SELECT id, {_PAYLOAD} AS payload FROM F_EVT) e")
def _(x):
    return ev.sign_events(_with_time_text(x.F_EVT), _SECRET).select("id", "payload", "signature")


def _fanout(x):
    work, dlq = scratch_path(x.spark, "work"), scratch_path(x.spark, "dlq")
    events = stream_of(x, "events", "F_EVT")
    sinks = [ev.Sink("flaky", flaky), ev.Sink("down", dead)]
    _drain(ev.run_fanout(events, sinks, work, dlq, scratch_path(x.spark, "cp"), 3, delay=0.0))
    return work, dlq


@query(
    "t2_fanout",
    """SELECT 'flaky' AS sink, id, CAST(least(failing_attempts + 1, 3) AS BIGINT) AS attempts, failing_attempts < 3 AS delivered FROM F_EVT UNION ALL SELECT 'down', id, 3, false FROM F_EVT""",
)
def fanout(x):
    work, _ = _fanout(x)
    return x.spark.read.parquet(f"{work}/log").select("sink", "id", "attempts", "delivered")


@query(
    "s22_dead_letters",
    """SELECT 'flaky' AS sink, id, name, CAST(3 AS BIGINT) AS attempts, 'refused' AS last_error FROM F_EVT WHERE failing_attempts >= 3 UNION ALL SELECT 'down', id, name, 3, 'down' FROM F_EVT""",
)
def _(x):
    _, dlq = _fanout(x)
    return x.spark.read.parquet(dlq).select("sink", "id", "name", "attempts", "last_error")


@query(
    "t3_retry_dlq",
    """SELECT id // 10 AS id, failing_attempts = 3 AS delivered, CASE WHEN failing_attempts = 3 THEN 3 ELSE 4 END AS attempts FROM F_EVT WHERE failing_attempts >= 3""",
)
def _(x):
    dlq = x.F_EVT.where("failing_attempts >= 3").select(
        # Letters that share their id.
        F.lit("flaky").alias("sink"), F.col("id").cast("string").alias("letter"), F.floor(F.col("id") / 10).alias("id"), "name", "data", (F.col("failing_attempts") - 3).alias("failing_attempts"), F.lit(3).alias("attempts"),
        F.lit("refused").alias("last_error"),
    )
    path = scratch_path(x.spark, "dead")
    dlq.write.parquet(path)
    left, sent = ev.retry_dlq(x.spark, path, ev.Sink("flaky", flaky))
    # What is still open is what failed.
    left = ev.open_letters(x.spark, path).join(left.select("letter"), "letter", "left_semi")
    flag = lambda df, ok: df.select("id", F.lit(ok).alias("delivered"), "attempts")
    return flag(sent, True).unionByName(flag(left, False))


@query(
    "t4_widget_state",
    """WITH l AS (SELECT id, max_by(change_type, seq) AS c, max_by(version, seq) AS version FROM F_WEV WHERE change_type <> 'bogus' GROUP BY id)
 SELECT id, version FROM l WHERE c = 'upsert' UNION ALL SELECT id, version FROM F_WID w WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.id = w.id)""",
)
def widget_state(x):
    path = scratch_path(x.spark, "widgets")
    _drain(st.widget_state(stream_of(x, "events", "F_WEV"), path, scratch_path(x.spark, "cp")))
    return st.current_widgets(x.F_WID.select("id", "version"), x.spark.read.parquet(path))


@query(
    "t4_widget_reload",
    """WITH e AS (SELECT seq, id, CASE WHEN seq % 1000 = 500 THEN 'reload' ELSE change_type END AS change_type, version FROM F_WEV), r AS (SELECT max(seq) AS place FROM e WHERE change_type = 'reload'),
 a AS (SELECT id, seq, change_type, version FROM e WHERE change_type IN ('upsert', 'remove') UNION ALL SELECT id, (SELECT place FROM r), 'upsert', version FROM F_WID WHERE (SELECT place FROM r) IS NOT NULL),
 l AS (SELECT id, max_by(change_type, seq) AS c, max_by(version, seq) AS version FROM a GROUP BY id) SELECT id, version FROM l WHERE c = 'upsert'""",
)
def _(x):
    events = x.F_WEV.withColumn("change_type", F.when(F.col("seq") % 1000 == 500, F.lit("reload")).otherwise(F.col("change_type")))
    return st.latest_changes(events, x.F_WID.select("id", "version")).where("change_type = 'upsert'").select("id", "version")


@query(
    "t5_directory_changes",
    """SELECT 'changed' AS change, 'w' || s_suppkey AS id FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 'removed', 'gone' || s_suppkey FROM supplier WHERE s_suppkey % 5 = 0""",
)
def _(x):
    # One widget file per supplier; the previous poll knew a third of them, and others that are gone now.
    path = write_widget_files(x.supplier.select("s_suppkey", F.concat(F.lit("w"), F.col("s_suppkey").cast("string")).alias("id")))
    key = F.regexp_extract("file_path", r"/([0-9]+)\.json$", 1)
    known = st.directory_files(x.spark, path).where(key.cast("int") % 3 == 0).withColumn("id", F.concat(F.lit("w"), key))
    gone = x.supplier.where("s_suppkey % 5 = 0").select(
        F.concat(F.lit("/gone/"), F.col("s_suppkey").cast("string"), F.lit(".json")).alias("file_path"),
        F.current_timestamp().alias("modified"),
        F.lit(1).cast("bigint").alias("size"),
        F.concat(F.lit("gone"), F.col("s_suppkey").cast("string")).alias("id"),
    )
    changed, removed, _ = st.directory_changes(x.spark, path, known.unionByName(gone))
    return changed.select(F.lit("changed").alias("change"), "id").unionByName(removed.select(F.lit("removed").alias("change"), "id"))


@query("t6_apply_if_new", "SELECT tkey, 'v2' AS version FROM F_TGT WHERE right(tkey, 1) <> '3'")
def _(x):
    path = scratch_path(x.spark, "config")
    fetched = [("v1", x.F_TGT), ("v1", x.F_TGT.limit(0)), ("v2", x.F_TGT.where("right(tkey, 1) <> '3'")), ("v2", x.F_TGT)]
    for version, config in fetched:
        st.apply_if_new(config.select("tkey"), version, path)
    return st.current_config(x.spark, path).withColumn("version", F.lit(st.stored_version(x.spark, path)))


@query("t6_prune_states", "SELECT DISTINCT h.tkey FROM F_HLT h WHERE EXISTS (SELECT 1 FROM F_TGT t WHERE t.tkey = h.tkey AND t.labels LIKE '%tier=gold%')")
def _(x):
    states = x.F_HLT.select("tkey").distinct()
    return b.prune_states(states, targets(x).where(F.array_contains("label_set", "tier=gold")))


_POLICY = b.BreakerPolicy(open_after=2, open_seconds=3 * 3600)
_OPENED = "epoch_us(n.ts) + 10800000000"
# One attempt after the other per key: the state before decides whether the attempt is made.
_BREAKER = f"""n AS (SELECT *, row_number() OVER (PARTITION BY tkey ORDER BY ts, seq) AS rn FROM F_HLT),
 s AS (SELECT CAST(NULL AS BIGINT) AS seq, tkey, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS seen, CAST(NULL AS BOOLEAN) AS made, CAST(0 AS BIGINT) AS f, CAST(-1 AS BIGINT) AS until FROM n WHERE rn = 1
  UNION ALL
  SELECT n.seq, n.tkey, n.rn, CASE WHEN s.until = -1 THEN 'closed' WHEN epoch_us(n.ts) < s.until THEN 'open' ELSE 'half_open' END, s.until = -1 OR epoch_us(n.ts) >= s.until,
   CASE WHEN s.until <> -1 THEN 0 WHEN n.outcome = 'transient' AND s.f + 1 < 2 THEN s.f + 1 ELSE 0 END,
   CASE WHEN s.until <> -1 AND epoch_us(n.ts) < s.until THEN s.until WHEN n.outcome = 'ok' THEN -1 WHEN s.until <> -1 THEN {_OPENED}
    WHEN n.outcome = 'permanent' OR s.f + 1 >= 2 THEN {_OPENED} ELSE -1 END
  FROM s JOIN n ON n.tkey = s.tkey AND n.rn = s.rn + 1)"""
_BREAKER_ROWS = "SELECT seq, tkey, seen, made, CASE WHEN until = -1 THEN 'closed' ELSE 'open' END AS state FROM s WHERE rn > 0"


@query("t7_breaker_states", "WITH RECURSIVE " + _BREAKER + " " + _BREAKER_ROWS)
def breaker(x):
    return b.breaker_states(x.F_HLT, _POLICY)[0].drop("outcome")


@query("t7_breaker_final", "WITH RECURSIVE " + _BREAKER + " SELECT tkey, max_by(f, rn) AS failures, max_by(until, rn) AS open_until_us FROM s GROUP BY tkey")
def _(x):
    return b.breaker_states(x.F_HLT, _POLICY)[1]


@query("t7_breaker_stream", "WITH RECURSIVE " + _BREAKER + " " + _BREAKER_ROWS)
def _(x):
    return _breaker_rows(x).where("seq IS NOT NULL").select("seq", "tkey", "seen", "made", "state")


def _breaker_rows(x):
    path = scratch_path(x.spark, "breaker")
    _drain(st.breaker_stream(in_batches(x.F_HLT, ["ts", "seq"], 4), _POLICY, path, scratch_path(x.spark, "cp")))
    return x.spark.read.parquet(f"{path}/rows")


@query("t7_breaker_hot", "WITH RECURSIVE " + _BREAKER.replace("FROM F_HLT", "FROM (SELECT seq, CASE WHEN seq % 3 > 0 THEN 'hot' ELSE tkey END AS tkey, CASE WHEN seq % 3 = 1 THEN TIMESTAMP '2024-01-15 00:00:00' ELSE ts END AS ts, outcome FROM F_HLT)") + " " + _BREAKER_ROWS)
def _(x):
    # Two thirds of the log are of one key, half of them of one instant.
    hot = x.F_HLT.withColumn("tkey", F.when(F.col("seq") % 3 > 0, F.lit("hot")).otherwise(F.col("tkey")))
    hot = hot.withColumn("ts", F.when(F.col("seq") % 3 == 1, F.lit("2024-01-15 00:00:00").cast(x.F_HLT.schema["ts"].dataType)).otherwise(F.col("ts")))
    return b.breaker_states(hot, b.BreakerPolicy(open_after=2, open_seconds=3 * 3600, slices=16))[0].drop("outcome")


@query("t9_field_gauge", "SELECT table_name, count(*) AS fields FROM F_OLD GROUP BY table_name")
def _(x):
    path = scratch_path(x.spark, "gauge")
    _drain(st.field_gauge_stream(stream_of(x, "orders", "F_OLD"), path, scratch_path(x.spark, "cp"), every=None))
    gauges = x.spark.read.parquet(path)
    last = gauges.agg(F.max("batch_id")).first()[0]
    return gauges.where(F.col("batch_id") == last).select("table_name", "fields")


@query(
    "t10_request_rate",
    f"""WITH q AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM F_API) SELECT {ts_sql('w')} AS window_start, tenant, method, count(*) AS requests, count(*) FILTER (status >= 500) AS errors FROM q
 WHERE w + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM q) - INTERVAL 10 MINUTE GROUP BY w, tenant, method""",
)
def _(x):
    path = scratch_path(x.spark, "rate")
    _drain(st.append_stream(st.request_rate(stream_of(x, "events", "F_API")), path, scratch_path(x.spark, "cp")))
    return x.spark.read.parquet(path).withColumn("window_start", ts_text("window_start"))


@query(
    "t11_diff_notifications",
    """SELECT count(*) FILTER (k % 3 = 1) AS added, CAST(0 AS BIGINT) AS deleted, count(*) FILTER (k % 3 = 2) AS updated, count(*) FILTER (k % 3 = 0) AS unchanged FROM (SELECT CAST(substr(column_name, 5) AS BIGINT) AS k FROM F_OLD)""",
)
def _(x):
    path = scratch_path(x.spark, "notes")
    k = F.substring("column_name", 5, 20).cast("bigint") % 3
    desired = stream_of(x, "orders", "F_OLD")
    x.orders.createOrReplaceTempView("orders")
    current = x.F_OLD.where(k != 1).withColumn("data_type", F.when(k == 2, F.lit("other")).otherwise(F.col("data_type")))
    keys = ["tenant_id", "table_name", "column_name"]
    _drain(st.diff_notifications(desired, lambda: current, path, scratch_path(x.spark, "cp"), keys))
    notes = x.spark.read.parquet(path)
    return notes.agg(*[F.sum(c).alias(c) for c in ("added", "deleted", "updated", "unchanged")])
