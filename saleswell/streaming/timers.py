"""The sync queue with clocks of its own: retries become ready and unanswered events are released by timers.

Each event's state holds all queue fields.  An event that is handed out must be answered within the stale limit, or
a timer puts it back; one that failed waits for its ``retry_at`` and a timer announces it.  Timers run on event time, so
a replay of the log gives what happened.

A call into Python costs far more than a row, so the events of ``BLOCK`` neighbouring ids share one group state, which
holds each one's fields and timer and times out at the first of the timers.  Each event still goes by its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from saleswell import config

FIELDS = "qb_status string, retry_count int, retry_at bigint, last_attempt_at bigint, error_code string, error_message string, txn_id string, txn_type string"
OUTPUT = f"event_id bigint, step int, what string, at_ms bigint, {FIELDS}"
NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
INPUT = ["at_ms", "seq", "kind", "success", "error_code", "error_message", "txn_id", "txn_type"]
START = ("pending", 0, 0, None, None, None, None, None)
HELD = f"events array<struct<event_id:bigint,timer:bigint,state:struct<step:int,{FIELDS.replace(' ', ':').replace(',:', ',')}>>>"
BLOCK = 1024  # ids: bounds what one group holds
STALE_MS = config.STALE_IN_FLIGHT_SECONDS * 1000


def _text(x) -> str | None:
    return x if isinstance(x, str) and x else None


def _answer(held: tuple, row: tuple) -> tuple[tuple, str]:
    """The state after a row (mark: the event is handed out; result: its answer) and what happened."""
    step, status, count, retry_at, attempt, code, message, txn, kind = held
    at, _, what, success, error, said, txn_id, txn_type = row
    at = int(at)
    if what == "mark":
        if status in ("pending", "in_flight"):
            status, attempt = "in_flight", at
        else:
            what = "not eligible"
    elif success:
        status, code, message, attempt = "applied", None, None, at
        txn, kind = _text(txn_id), _text(txn_type) or kind
    else:
        count, attempt = count + 1, at
        code, message = _text(error) or "UNKNOWN", _text(said) or "sync failed"
        again = code not in config.NON_RETRYABLE_CODES and count < config.MAX_RETRIES
        ladder = config.RETRY_DELAYS_SECONDS
        wait = ladder[min(count - 1, len(ladder) - 1)] * 1000 if again else 0
        status, retry_at = ("pending" if again else "error"), at + wait
    return (step + 1, status, count, retry_at, attempt, code, message, txn, kind), what


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The rows of a block's events, each event's in order, then the timers that have come up."""
    held = {e: (timer, tuple(s)) for e, timer, s in state.get[0]} if state.exists else {}
    out = []
    if not state.hasTimedOut:
        rows = [r for f in frames for r in zip(f["event_id"].astype(object).where(f["event_id"].notna(), None).tolist(), *(f[c].tolist() for c in INPUT))]
        for event, *row in sorted(rows, key=lambda r: r[1:3]):
            now, what = _answer(held[event][1] if event in held else (0, *START), row)
            step, status, count, retry_at, attempt = now[:5]
            held[event] = attempt + STALE_MS if status == "in_flight" else retry_at if status == "pending" and retry_at else None, now
            out.append((event, step, what, int(row[0]), *now[1:]))
    mark = state.getCurrentWatermarkMs()
    for event, (timer, (step, status, count, retry_at, *rest)) in held.items():
        if timer is not None and timer < mark:
            what = "ready"
            if status == "in_flight":
                what, status, retry_at = "released", "pending", timer
            held[event] = None, (step + 1, status, count, retry_at, *rest)
            out.append((event, step + 1, what, timer, status, count, retry_at, *rest))
    state.update(([(event, timer, now) for event, (timer, now) in held.items()],))
    ahead = [timer for timer, _ in held.values() if timer is not None]
    if ahead:
        state.setTimeoutTimestamp(min(ahead))
    yield pd.DataFrame(out, columns=NAMES, dtype=object)


def queue_with_timers(log: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """``event_id, seq, at_ms, kind, success, error_code, error_message, txn_id, txn_type`` -> state after each row and each timer."""
    timed = log.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", delay)
    blocks = timed.withColumn("block", F.floor(F.col("event_id") / BLOCK)).groupBy("block")
    return blocks.applyInPandasWithState(_advance, OUTPUT, HELD, "append", GroupStateTimeout.EventTimeTimeout)


def latest(changes: DataFrame) -> DataFrame:
    """The last state of every event."""
    return changes.groupBy("event_id").agg(F.max_by(F.struct(*NAMES[1:]), "step").alias("s")).select("event_id", "s.*")
