"""Circuit breaker states of an attempt log.

A key's breaker depends on everything before, yet one hot key must not become one task. The log is cut into slices along
(key, time, number). Each key's part of a slice is summarised on its own: for every state the breaker may be in at its start, the
state at its end. The summaries are short (an open breaker can only stay open for so long, and neighbouring cases that
end alike are merged) and are chained per key; then each part is replayed from its known start.

In a stream, a key's state is a keyed value of the stream itself, and a timer tells when an open breaker may be probed.

A state is ``closed`` with a failure count, or ``open`` until a time. Attempts while open are not made. The
first attempt at or after that time is the half-open probe: success closes, any failure opens again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from schemahelm.operators.slices import sorted_slices
from schemahelm.session import cut_lineage

NOT_OPEN = -1


@dataclass(frozen=True)
class BreakerPolicy:
    open_after: int = 3
    open_seconds: int = 60
    slices: int | None = None

    @property
    def counts(self) -> int:
        """Distinguishable failure counts of a closed breaker."""
        return max(self.open_after, 1)


def _after(failures: int, outcome: str, ts: int, policy: BreakerPolicy) -> tuple[int, int]:
    """State after an attempt that was made by a closed breaker."""
    if outcome == "ok":
        return 0, NOT_OPEN
    reached = outcome != "transient" or (policy.open_after > 0 and failures + 1 >= policy.open_after)
    if reached:
        return 0, ts + policy.open_seconds * 1_000_000
    return (failures + 1 if policy.open_after > 0 else 0), NOT_OPEN


def _after_probe(outcome: str, ts: int, policy: BreakerPolicy) -> tuple[int, int]:
    return (0, NOT_OPEN) if outcome == "ok" else (0, ts + policy.open_seconds * 1_000_000)


def _summarise(ts: list[int], outcome: list[str], policy: BreakerPolicy, horizon: int = NOT_OPEN) -> dict:
    """End state of a slice for every start state, by going backwards over its rows.

    A breaker that was opened before the slice is open until ``horizon`` or the open time after the first row at most.
    """
    n, m = len(ts), policy.counts
    closed = [[(f, NOT_OPEN) for f in range(m)]]
    probe: list[tuple[int, int]] = [(0, 0)] * n

    def onwards(state: tuple[int, int], i: int) -> tuple[int, int]:
        """End state from ``state`` right before row ``i``; rows from ``i`` on are solved."""
        if state[1] == NOT_OPEN:
            return closed[n - i][state[0]]
        lo, hi = i, n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if ts[mid] < state[1] else (lo, mid)
        return probe[lo] if lo < n else state

    for i in range(n - 1, -1, -1):
        probe[i] = onwards(_after_probe(outcome[i], ts[i], policy), i + 1)
        closed.append([onwards(_after(f, outcome[i], ts[i], policy), i + 1) for f in range(m)])
    bounds: list[int] = []
    ends: list[tuple[int, int]] = []
    horizon = max(horizon, ts[0] + policy.open_seconds * 1_000_000)
    for t, end in zip(ts, probe):
        if bounds and bounds[-1] >= horizon:
            break
        # Runs of probe positions that end alike become one entry.
        if bounds and end == ends[-1]:
            bounds[-1] = t
        else:
            bounds.append(t)
            ends.append(end)
    start = closed[-1]
    return {
        "closed_f": [s[0] for s in start],
        "closed_until": [s[1] for s in start],
        "bounds": bounds,
        "probe_f": [s[0] for s in ends],
        "probe_until": [s[1] for s in ends],
    }


def _chain(pdf: pd.DataFrame, failures: int, until: int) -> list[tuple[int, int]]:
    """Start state of each slice of one key."""
    starts = []
    for row in pdf.itertuples():
        starts.append((failures, until))
        if until == NOT_OPEN:
            failures, until = row.closed_f[failures], row.closed_until[failures]
        else:
            hit = next((j for j, b in enumerate(row.bounds) if b >= until), None)
            if hit is not None:
                failures, until = row.probe_f[hit], row.probe_until[hit]
    return [*starts, (failures, until)]


def replay(pdf: pd.DataFrame, failures: int, until: int, policy: BreakerPolicy) -> tuple[pd.DataFrame, int, int]:
    """Attempts of one key (seq, tkey, us, outcome) with ``seen``, ``made`` and ``state``, and the state after them."""
    pdf = pdf.sort_values(["us", "seq"])
    seen, made, after = [], [], []
    for t, outcome in zip(pdf["us"].tolist(), pdf["outcome"].tolist()):
        blocked = until != NOT_OPEN and t < until
        seen.append("open" if blocked else "closed" if until == NOT_OPEN else "half_open")
        made.append(not blocked)
        if not blocked:
            probing = until != NOT_OPEN
            failures, until = _after_probe(outcome, t, policy) if probing else _after(failures, outcome, t, policy)
        after.append("closed" if until == NOT_OPEN else "open")
    return pdf[["seq", "tkey", "us", "outcome"]].assign(seen=seen, made=made, state=after), failures, until


def breaker_states(attempts: DataFrame, policy: BreakerPolicy, initial: DataFrame | None = None, materialize: bool = False) -> tuple[DataFrame, DataFrame]:
    """Attempt log (``seq, tkey, ts, outcome``) -> (rows, final state per key).

    Rows gain ``seen`` (state at the call: closed, open, half_open), ``made`` (was the call let through) and
    ``state`` (after it). ``initial`` carries ``tkey, failures, open_until_us`` from an earlier run. ``materialize`` writes the small
    table of slice starts once, for callers that use both results.
    """
    log = attempts.select("seq", "tkey", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "outcome")
    log = sorted_slices(log, ["tkey", "us", "seq"], policy.slices).rows.withColumn("slice", F.col("_slice").cast("bigint")).drop("_slice")
    told = log.withColumn("horizon", F.lit(NOT_OPEN).cast("bigint"))
    if initial is not None:
        told = log.join(initial.select("tkey", F.col("open_until_us").alias("horizon")), "tkey", "left").fillna({"horizon": NOT_OPEN})

    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "seq"])
        ends = _summarise(pdf["us"].tolist(), pdf["outcome"].tolist(), policy, int(pdf["horizon"].iloc[0]))
        return pd.DataFrame([{"tkey": key[0], "slice": key[1], **ends}])

    schema = "tkey string, slice bigint, closed_f array<int>, closed_until array<bigint>, bounds array<bigint>, probe_f array<int>, probe_until array<bigint>"
    summaries = told.groupBy("tkey", "slice").applyInPandas(summarise, schema)
    if initial is None:
        begun = summaries.withColumn("failures", F.lit(0)).withColumn("open_until_us", F.lit(NOT_OPEN).cast("bigint"))
    else:
        begun = summaries.join(initial.select("tkey", "failures", "open_until_us"), "tkey", "left").fillna(
            {"failures": 0, "open_until_us": NOT_OPEN}
        )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slice")
        states = _chain(pdf, int(pdf["failures"].iloc[0]), int(pdf["open_until_us"].iloc[0]))
        slices = [*pdf["slice"].tolist(), None]
        rows = [(pdf["tkey"].iloc[0], s, f, u) for s, (f, u) in zip(slices, states)]
        return pd.DataFrame(rows, columns=["tkey", "slice", "failures", "open_until_us"]).astype({"slice": "Int64"})

    starts = begun.groupBy("tkey").applyInPandas(chain, "tkey string, slice bigint, failures int, open_until_us bigint")
    if materialize:
        starts = cut_lineage(starts, "breaker")
    final = starts.where(F.col("slice").isNull()).drop("slice")

    def rerun(pdf: pd.DataFrame) -> pd.DataFrame:
        return replay(pdf, int(pdf["failures"].iloc[0]), int(pdf["open_until_us"].iloc[0]), policy)[0].drop(columns="us")

    placed = log.join(starts.where(F.col("slice").isNotNull()), ["tkey", "slice"])
    rows = placed.groupBy("tkey", "slice").applyInPandas(rerun, "seq bigint, tkey string, outcome string, seen string, made boolean, state string")
    return rows, final


class BreakerProcessor(StatefulProcessor):
    """Keyed breaker of a stream: a value for each key that occurs, and a timer while its breaker is open."""

    def __init__(self, policy: BreakerPolicy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("breaker", "failures int, open_until bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        failures, until = self.value.get() if self.value.exists() else (0, NOT_OPEN)
        batch = pd.concat(list(rows), ignore_index=True)
        done, failures, after = replay(batch, int(failures), int(until), self.policy)
        self.value.update((failures, after))
        if after != until:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if after != NOT_OPEN:
                self.handle.registerTimer(-(-after // 1000))
        yield done

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # Nobody has asked since: the next attempt will be a probe. The state itself already says so.
        _, until = self.value.get()
        row = {"seq": None, "tkey": key[0], "us": until, "outcome": None, "seen": "open", "made": None, "state": "half_open"}
        yield pd.DataFrame([row]).astype({"seq": "Int64", "made": "boolean"})

    def close(self) -> None:
        pass


STREAM_ROW = "seq bigint, tkey string, us bigint, outcome string, seen string, made boolean, state string"


def keyed_breaker(attempts: DataFrame, policy: BreakerPolicy, late: str = "1 hour") -> DataFrame:
    """Attempt stream (``seq, tkey, ts, outcome``) -> rows as of :func:`breaker_states`, with their time ``us``.

    A key's state lives in the state store, so a micro-batch writes only keys that occur in it. While a breaker is open, a timer
    waits for the stream to pass the end of that time; if no attempt of the key comes first, a row without ``seq`` reports it
    as half-open. Attempts of a micro-batch are put in order by time; those of a later one count as later, and those
    that come more than ``late`` behind the stream are dropped.
    """
    timed = attempts.select("seq", "tkey", F.col("ts").cast("timestamp").alias("ts"), "outcome").withWatermark("ts", late)
    log = timed.withColumn("us", F.unix_micros("ts"))
    return log.groupBy("tkey").transformWithStateInPandas(BreakerProcessor(policy), STREAM_ROW, "append", "eventTime")


def prune_states(states: DataFrame, targets: DataFrame, key: str = "tkey") -> DataFrame:
    """Drop the state of targets that no longer exist."""
    return states.join(targets.select(key), key, "left_semi")
