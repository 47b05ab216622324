"""URL filtering against dated lists: which entries were active when a page was fetched.

List entries are events (list, kind, value, action add/remove, day).  An entry key's
events become validity intervals [day added, day of its next event); of several
events of a key on one day an add counts.  A capture is looked up under all keys it can fall under: its
host, the host's domain suffixes, and its directory prefixes.

The as-of join is an equality join on (key, month) with the interval as the rest of
the condition: intervals are cut at month starts, so a key with very many captures is spread over its months (and
split further by the skew join), and a capture meets the intervals of its month only.  Each distinct (url, day) is evaluated once.

A page is blocked when a block entry is active and no allow entry is.  Null urls
or days, and urls without a scheme and host, match nothing.  Entries with a null field are ignored.  Repeated captures
are answered one by one; extra columns of the captures are kept, but give way to the result's where names clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from saleswell.llm.common import free_name

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?"


def host_of(url: Column) -> Column:
    """Lower-cased host; empty where there is none."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def directories(host: Column, url: Column) -> Column:
    """host/, host/a/, host/a/b/ ... for the directories of the path."""
    parts = F.split(F.regexp_extract(url, PATH, 1), "/")
    up_to = lambda k: F.concat(host, F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), up_to)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, value, valid_from, valid_to): half-open, open end null; intervals of a key never overlap."""
    key = ["list", "kind", "value"]
    days = (
        entries.where("list is not null and kind is not null and value is not null and action in ('add', 'remove') and day is not null")
        .groupBy(*key, "day").agg(F.bool_or(F.col("action") == "add").alias("adds"))
    )
    # At most one row for each day of a key is left, so a key's window is bounded by the calendar.
    order = Window.partitionBy(*key).orderBy("day")
    return days.withColumn("valid_to", F.lead("day").over(order)).where("adds").select(*key, F.col("day").alias("valid_from"), "valid_to")


def as_of_matches(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(url, fetched_on, list, kind, value) for each distinct capture and entry active on its day."""
    month = lambda c: F.trunc(c, "month")
    asked = captures.select("url", "fetched_on").where("url is not null and fetched_on is not null").distinct().withColumn("host", host_of(F.col("url"))).where("host <> ''")
    keyed = asked.select(
        "url", "fetched_on", month("fetched_on").alias("month"),
        F.explode(F.concat(
            F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("value"))),
            F.transform(suffixes(F.col("host")), lambda v: F.struct(F.lit("domain").alias("kind"), v.alias("value"))),
            F.transform(directories(F.col("host"), F.col("url")), lambda v: F.struct(F.lit("prefix").alias("kind"), v.alias("value"))),
        )).alias("k"),
    ).select("url", "fetched_on", "month", "k.kind", "k.value")
    last = F.lit(captures.agg(F.max("fetched_on")).first()[0]).cast("date")
    pieces = (
        intervals(entries).where(F.col("valid_from") <= last)
        .withColumn("month", F.explode(F.sequence(month("valid_from"), month(F.least(F.coalesce("valid_to", last), last)), F.expr("interval 1 month"))))
    )
    on = ["kind", "value", "month"]
    active = (F.col("fetched_on") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to")))
    return keyed.join(pieces, on).where(active).select("url", "fetched_on", "list", "kind", "value")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (url, fetched_on, ...) with host, n_block, n_allow, blocked and rule (the first active block entry)."""
    captures = captures.drop("host", "n_block", "n_allow", "blocked", "rule")
    own = [free_name(c, captures) for c in ("__url", "__day", "__block", "__allow", "__rule")]
    found = as_of_matches(captures, entries).groupBy(F.col("url").alias(own[0]), F.col("fetched_on").alias(own[1])).agg(
        F.count_if(F.col("list") == "block").alias(own[2]),
        F.count_if(F.col("list") == "allow").alias(own[3]),
        F.min(F.when(F.col("list") == "block", F.concat("kind", F.lit(":"), "value"))).alias(own[4]),
    )
    joined = captures.join(found, (captures["url"] == found[own[0]]) & (captures["fetched_on"] == found[own[1]]), "left")
    n_block, n_allow = F.coalesce(found[own[2]], F.lit(0)), F.coalesce(found[own[3]], F.lit(0))
    return joined.select(
        *[captures[c] for c in captures.columns], F.coalesce(host_of(captures["url"]), F.lit("")).alias("host"),
        n_block.alias("n_block"), n_allow.alias("n_allow"), ((n_block > 0) & (n_allow == 0)).alias("blocked"), found[own[4]].alias("rule"),
    )
