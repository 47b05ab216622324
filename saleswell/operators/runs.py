"""Runs that measure themselves: counts taken while writing, a run log and an action audit.

Row counts and sums come from observed metrics of the very write, so nothing is computed
twice for the log.  Times are the caller's: ``now`` is a function.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from saleswell.operators import maintenance

AUDIT = "timestamp string, action string, outcome string, actor string, path string, method string, details string"


def measured(df: DataFrame, write: Callable[[DataFrame], None], **measures: Column) -> dict[str, Any]:
    """Write ``df`` and return ``row_count`` and the measures of what was written, from that one pass.

    ``write`` must consume the whole frame in one action; the first action is the one measured.
    """
    seen = Observation(f"run-{uuid.uuid4().hex}")
    write(df.observe(seen, F.count(F.lit(1)).alias("row_count"), *[m.alias(name) for name, m in measures.items()]))
    return dict(seen.get)


def logged(
    df: DataFrame, write: Callable[[DataFrame], None], log: str, run_date: dt.date, now: Callable[[], dt.datetime],
    query_id: str = "", document_id: str = "", **measures: Column,
) -> dict[str, Any]:
    """A measured write with one record in the run log, whether it succeeds or fails; a failure is raised again."""
    spark, started = df.sparkSession, now()
    try:
        out = measured(df, write, **measures)
    except Exception as error:
        maintenance.log_run(spark, log, run_date, "failed", 0, started, now(), query_id, document_id, str(error))
        raise
    maintenance.log_run(spark, log, run_date, "success", out["row_count"], started, now(), query_id, document_id)
    return out


def read_log(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.parquet(log)


def record_action(
    spark: SparkSession, path: str, at: str, action: str, outcome: str, actor: str, request_path: str = "", method: str = "", details: Mapping[str, Any] | None = None,
) -> None:
    """Append one entry to the action audit, JSON lines."""
    row = (at, action, outcome, actor, request_path, method, json.dumps(dict(details or {}), sort_keys=True))
    spark.createDataFrame([row], AUDIT).coalesce(1).write.mode("append").json(path)


def audited(
    spark: SparkSession, path: str, at: Callable[[], str], action: str, actor: str, do: Callable[[], Mapping[str, Any]], request_path: str = "", method: str = "",
) -> Mapping[str, Any]:
    """Do something and leave an audit entry: its result as details, or the error, which is raised again."""
    try:
        out = do()
    except Exception as error:
        record_action(spark, path, at(), action, "error", actor, request_path, method, {"error": str(error)})
        raise
    record_action(spark, path, at(), action, "ok", actor, request_path, method, out)
    return out
