"""Sessions of users of any size.

A session window binds a user to one task.  Here a user's events are cut into days: gaps are looked up inside a
day, only the first event of a day asks the day before it (from a table with one row per user and day), and the
number of an event's session is a running count of gaps, block by block.  Events then group by (user, session), so a
user with a third of all events is spread like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from saleswell.operators.ordered import running_sum


def numbered(events: DataFrame, user: str, time: str, tie: str, gap: str = "30 minutes", name: str = "session") -> DataFrame:
    """Events with the number of their session within the user; a pause of ``gap`` or more begins a new one."""
    day = F.col(time).cast("date")
    tagged = events.withColumn("_day", day)
    inside = Window.partitionBy(user, "_day").orderBy(time, tie)
    ends = tagged.groupBy(user, "_day").agg(F.max(time).alias("_last"))
    days = Window.partitionBy(user).orderBy("_day")
    before = ends.select(F.col(user).alias("_user"), F.col("_day").alias("_on"), F.lag("_last").over(days).alias("_before"))
    placed = tagged.withColumn("_prev", F.lag(time).over(inside)).join(before, (F.col("_user").eqNullSafe(F.col(user))) & (F.col("_on") == F.col("_day")))
    previous = F.coalesce("_prev", "_before")
    fresh = F.when(previous.isNull() | (F.col(time) - previous >= F.expr(f"INTERVAL '{gap}'")), 1).otherwise(0)
    marked = placed.withColumn("_fresh", fresh.cast("bigint")).drop("_user", "_on", "_prev", "_before", "_day")
    return running_sum(marked, [user], [time, tie], day, "_fresh", name).drop("_fresh")


def sessions(events: DataFrame, user: str, time: str, tie: str, measures: Sequence[Column], gap: str = "30 minutes") -> DataFrame:
    """``user, session_start, session_end`` (last event plus ``gap``) and the measures of every session."""
    one = numbered(events, user, time, tie, gap)
    out = one.groupBy(user, "session").agg(F.min(time).alias("session_start"), (F.max(time) + F.expr(f"INTERVAL '{gap}'")).alias("session_end"), *measures)
    return out.drop("session")
