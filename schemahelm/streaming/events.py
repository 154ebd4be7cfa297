"""Change events, sinks with retries, dead letters and their re-dispatch."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from schemahelm.functions.text import hmac_sha256
from schemahelm.session import read_if_there

# --- fixed values: event names of registry changes
EVENT_NAMES = {"added": "cf.field.created", "updated": "cf.field.updated", "deleted": "cf.field.deleted"}
SCAN_EVENT = "cf.scan"


def change_events(changes: DataFrame, now: Column) -> DataFrame:
    """Events of a diff's real changes: ``name, time, data, id``; works on batches and streams.

    The data of a created field is its definition, of an updated one ``{before, after}``, of a deleted one its
    table and column.
    """
    kind = F.col("change_type")
    name = F.when(kind == "added", F.lit(EVENT_NAMES["added"])).when(kind == "deleted", F.lit(EVENT_NAMES["deleted"]))
    attrs = sorted(c[4:] for c in changes.columns if c.startswith("new_") and f"old_{c[4:]}" in changes.columns)
    side = lambda s: F.struct("table_name", "column_name", *[F.col(f"{s}_{c}").alias(c) for c in attrs])
    text = lambda *fields: F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    data = (
        F.when(kind == "added", F.to_json(side("new"), {"ignoreNullFields": "false"}))
        .when(kind == "deleted", text(F.col("table_name").alias("table"), F.col("column_name").alias("column")))
        .otherwise(text(side("old").alias("before"), side("new").alias("after")))
    )
    return changes.where(kind != "unchanged").select(
        name.otherwise(F.lit(EVENT_NAMES["updated"])).alias("name"),
        now.alias("time"),
        data.alias("data"),
        F.concat_ws(".", "table_name", "column_name").alias("id"),
    )


def scan_events(summary: DataFrame, now: Column) -> DataFrame:
    """One event per scanned database: its id, and its counters as data."""
    data = F.struct(
        (F.col("inserted") + F.col("updated") + F.col("skipped")).alias("total"), "inserted", "updated", "skipped", "db_id", "tables"
    )
    return summary.select(
        F.lit(SCAN_EVENT).alias("name"), now.alias("time"), F.to_json(data).alias("data"), F.col("db_id").cast("string").alias("id")
    )


def event_payload(events: DataFrame) -> DataFrame:
    """Events with their JSON ``payload``; ``data`` that is JSON text is embedded, not quoted."""
    body = F.struct("name", F.col("ts" if "ts" in events.columns else "time").alias("time"), F.try_parse_json("data").alias("data"), F.col("id").cast("string").alias("id"))
    return events.withColumn("payload", F.to_json(body))


def sign_events(events: DataFrame, secret: str) -> DataFrame:
    """Payload and its HMAC-SHA256 signature for a push sink."""
    return event_payload(events).withColumn("signature", hmac_sha256("payload", secret))


def write_events(stream: DataFrame, format: str, options: dict[str, str], checkpoint: str) -> DataStreamWriter:
    """Writer of JSON events keyed by id, for Kafka or any other stream sink; the caller starts it."""
    rows = event_payload(stream).select(F.col("id").cast("string").alias("key"), F.col("payload").alias("value"))
    return rows.writeStream.format(format).options(**options).option("checkpointLocation", checkpoint).outputMode("append")


@dataclass(frozen=True)
class Sink:
    """A named sender: ``send(rows, attempt)`` gets a pandas batch and returns one error text or None per row."""

    name: str
    send: Callable[[pd.DataFrame, int], Sequence[str | None]]


def _send_once(events: DataFrame, sink: Sink, attempt: int) -> DataFrame:
    schema = T.StructType([*events.schema.fields, T.StructField("error", T.StringType())])
    send = sink.send

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(error=pd.Series(list(send(batch, attempt)), index=batch.index, dtype=object))

    return events.mapInPandas(run, schema)


def numbered_batch(batch: DataFrame, work: str, batch_id: int) -> DataFrame:
    """The rows of a micro-batch with ``delivery``, a number of each that is the same when the batch is repeated.

    The batch is written once; a mark that appears after it tells that it is complete.
    """
    spark = batch.sparkSession
    path, mark = (f"{work}/{kind}/batch_id={batch_id}" for kind in ("batches", "numbered"))
    if read_if_there(spark, mark) is None:
        batch.withColumn("delivery", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(mark)
    return spark.read.parquet(path)


def deliver(events: DataFrame, sink: Sink, work: str, max_attempts: int = 3, delay: float = 1.0, max_delay: float = 0.0, jitter: float = 0.2) -> DataFrame:
    """Send a batch with retries; returns every event with ``attempts`` and ``error`` (NULL when delivered).

    Attempts are rounds over what is still failing, each written to ``work`` before it is judged: a send is
    not repeated because its result is read twice, and the job waits once per round, not per event. ``work`` belongs to
    one batch and sink. When the batch is repeated, its own log is read first and what was delivered is not sent again: by its
    ``delivery`` number where the events have one (see :func:`numbered_batch`), as ids may repeat, else by its id.
    """
    key = "delivery" if "delivery" in events.columns else "id"
    spark = events.sparkSession
    log = read_if_there(spark, work)
    done = None if log is None else log.where(F.col("error").isNull())
    pending = events if done is None else events.join(done.select(key), key, "left_anti")
    run = 0 if log is None else log.agg(F.max("run")).first()[0] + 1
    for attempt in range(1, max_attempts + 1):
        path = f"{work}/run={run}/attempt={attempt}"
        _send_once(pending, sink, attempt).write.mode("overwrite").parquet(path)
        sent = spark.read.parquet(path)
        pending = sent.where(F.col("error").isNotNull()).drop("error")
        if attempt == max_attempts or pending.isEmpty():
            break
        wait = delay * 2 ** (attempt - 1)
        wait = min(wait, max_delay) if max_delay > 0 else wait
        # Seeded, so that sinks that failed together do not come back together, and a repeated batch waits as long.
        time.sleep(wait * (1 + jitter * random.Random(f"{work}:{attempt}").uniform(-1, 1)))
    rounds = spark.read.parquet(work).withColumnRenamed("attempt", "attempts")
    # Delivered rows of every round of any run, failed rows of this run's last round.
    settled = F.col("error").isNull() | ((F.col("run") == run) & (F.col("attempts") == attempt))
    return rounds.where(settled).drop("run").withColumn("attempts", F.col("attempts").cast("bigint"))


def dead_letters(outcome: DataFrame, sink: str) -> DataFrame:
    """Dead-letter rows of undelivered events: ``sink, [letter,] id, name, payload, attempts, last_error``."""
    failed = event_payload(outcome.where(F.col("error").isNotNull()))
    own = ["letter"] if "letter" in outcome.columns else []
    return failed.select(
        F.lit(sink).alias("sink"), *own, "id", "name", "payload", "attempts", F.col("error").alias("last_error")
    )


def write_dlq(outcome: DataFrame, sink: str, path: str, batch_id: int) -> None:
    """Store dead letters of a micro-batch, each with a ``letter`` of its own; replaying the batch replaces them."""
    number = F.col("delivery") if "delivery" in outcome.columns else F.monotonically_increasing_id()
    letters = dead_letters(outcome.withColumn("letter", F.concat_ws(":", F.lit(str(batch_id)), number.cast("string"))), sink)
    letters.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}/from_sink={sink}")


def run_fanout(stream: DataFrame, sinks: Sequence[Sink], work: str, dlq: str, checkpoint: str, max_attempts: int = 3, delay: float = 1.0, max_delay: float = 0.0, available_now: bool = True):
    """Send every event of a stream to all sinks, with retries and dead letters; returns the running query.

    Sinks are served side by side. Everything a micro-batch writes lies under its batch id, so a repeated batch overwrites
    its own results.
    """

    def dispatch(batch: DataFrame, batch_id: int) -> None:
        batch = numbered_batch(batch, work, batch_id)
        def one(sink: Sink) -> None:
            outcome = deliver(batch, sink, f"{work}/sends/batch_id={batch_id}/to={sink.name}", max_attempts, delay, max_delay)
            log = outcome.select(F.lit(sink.name).alias("sink"), "id", "attempts", F.col("error").isNull().alias("delivered"))
            log.write.mode("overwrite").parquet(f"{work}/log/batch_id={batch_id}/to={sink.name}")
            write_dlq(outcome, sink.name, dlq, batch_id)

        # Side by side: a sink that is down or waits does not hold up the others.
        with ThreadPoolExecutor(len(sinks) or 1) as pool:
            list(pool.map(one, sinks))

    writer = stream.writeStream.foreachBatch(dispatch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def open_letters(spark: SparkSession, dlq: str) -> DataFrame:
    """Dead letters that no retry has delivered, with the attempts and the last error of all retries so far.

    Letters are told apart by ``letter``; a store without that column has one letter for each id.
    """
    letters = spark.read.parquet(dlq)
    tried = read_if_there(spark, f"{dlq}.retries")
    if tried is None:
        return letters
    key = ["sink", "letter" if "letter" in letters.columns else "id"]
    seen = tried.groupBy(*key).agg(
        F.bool_or(F.col("error").isNull()).alias("_done"), F.count(F.lit(1)).alias("_more"), F.max_by("error", "retry").alias("_error")
    )
    rows = letters.join(seen, key, "left").where(~F.coalesce("_done", F.lit(False)))
    attempts = (F.col("attempts") + F.coalesce("_more", F.lit(0))).cast(letters.schema["attempts"].dataType)
    return rows.withColumn("attempts", attempts).withColumn("last_error", F.coalesce("_error", "last_error")).select(letters.columns)


def retry_dlq(spark: SparkSession, dlq: str, sink: Sink) -> tuple[DataFrame, DataFrame]:
    """Send the open dead letters of a sink once more -> (still failing, delivered).

    The outcome is added to the log beside the store as one more retry, which takes delivered letters out of it; a
    retry that breaks off leaves no log, and its letters stay open.
    """
    log = f"{dlq}.retries"
    past = read_if_there(spark, log)
    retry = 0 if past is None else past.agg(F.max("retry")).first()[0] + 1
    pending = open_letters(spark, dlq).where(F.col("sink") == sink.name)
    _send_once(pending, sink, 1).write.mode("overwrite").parquet(f"{log}/retry={retry}")
    sent = spark.read.parquet(f"{log}/retry={retry}")
    failed = F.col("error").isNotNull()
    remaining = sent.where(failed).withColumn("last_error", F.col("error")).withColumn("attempts", F.col("attempts") + 1)
    return remaining.drop("error"), sent.where(~failed).drop("error")
