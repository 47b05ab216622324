"""Keyed state machines: the inventory ledger and the sync queue.

State is small per key (one number per location, one queue record), lives in
RocksDB and is updated row by row inside the tasks of Spark's own grouping.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from saleswell import config

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEDGER_OUTPUT = (
    "sku string, seq bigint, line_id string, location_id bigint, delta double, on_hand double, accepted boolean, reason string"
)
QUEUE_OUTPUT = "event_id bigint, seq bigint, qb_status string, retry_count int, retry_at bigint, error_code string"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """Rows of one key within one micro-batch, which the trigger limits bound."""
    frames = list(rows)
    return pd.concat(frames, ignore_index=True).sort_values(by, kind="stable") if frames else pd.DataFrame()


class LedgerProcessor(StatefulProcessor):
    """Balances of one SKU.  Keyed by SKU so both legs of a transfer meet.

    A change that would take a location below zero is rejected and leaves the
    state alone; a tiny negative within the tolerance becomes zero.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._balance = handle.getMapState("balance", "location_id bigint", "on_hand double")

    def _get(self, loc: int) -> float:
        return float(self._balance.getValue((loc,))[0]) if self._balance.containsKey((loc,)) else 0.0

    def _moves(self, r) -> list[tuple[int, float]]:
        if r.mode == "transfer":
            return [(int(r.from_location_id), -float(r.qty)), (int(r.to_location_id), float(r.qty))]
        loc = int(r.location_id)
        return [(loc, float(r.new_qty) - self._get(loc) if r.mode == "set" else float(r.qty))]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in _ordered(rows, ["seq", "line_id"]).itertuples(index=False):
            moves = self._moves(r)
            fits = all(self._get(loc) + d >= -config.BALANCE_EPSILON for loc, d in moves)
            for loc, delta in moves:
                if fits:
                    self._balance.updateValue((loc,), (max(self._get(loc) + delta, 0.0),))
                out.append((key[0], int(r.seq), r.line_id, loc, delta, self._get(loc), fits, None if fits else "below zero"))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LEDGER_OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def ledger_stream(requests: DataFrame) -> DataFrame:
    """``sku, seq, line_id, mode, qty, new_qty, location ids`` -> applied or rejected movements.

    Limit the source (``maxFilesPerTrigger``): a micro-batch is ordered per SKU
    in memory, so its size is the bound.

    Rejection is per line of a SKU; an event over several SKUs that must be all
    or nothing needs its rejected event ids voided downstream.
    """
    return requests.groupBy("sku").transformWithStateInPandas(
        LedgerProcessor(), outputStructType=LEDGER_OUTPUT, outputMode="Append", timeMode="None"
    )


class QueueProcessor(StatefulProcessor):
    """Sync state of one event: retry ladder, retry limit, codes that never retry."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "qb_status string, retry_count int, retry_at bigint, error_code string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, count, retry_at, code = self._state.get() if self._state.exists() else ("pending", 0, 0, None)
        out = []
        for r in _ordered(rows, ["at_ms", "seq"]).itertuples(index=False):
            if r.success:
                status, code = "applied", None
            else:
                count += 1
                code = r.error_code if isinstance(r.error_code, str) and r.error_code else "UNKNOWN"
                wanted = True if r.retryable is None or pd.isna(r.retryable) else bool(r.retryable)
                again = wanted and code not in config.NON_RETRYABLE_CODES and count < config.MAX_RETRIES
                ladder = config.RETRY_DELAYS_SECONDS
                wait = ladder[min(count - 1, len(ladder) - 1)] * 1000 if again else 0
                status, retry_at = ("pending" if again else "error"), int(r.at_ms) + wait
            out.append((key[0], int(r.seq), status, count, retry_at, code))
        self._state.update((status, count, retry_at, code))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in QUEUE_OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def queue_stream(results: DataFrame) -> DataFrame:
    """Result rows -> queue state after each of them."""
    return results.groupBy("event_id").transformWithStateInPandas(
        QueueProcessor(), outputStructType=QUEUE_OUTPUT, outputMode="Append", timeMode="None"
    )
