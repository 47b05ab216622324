"""Reconciliation of our parts with the accounting item list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from saleswell.config import PARITY_TOLERANCE
from saleswell.functions.accounts import accounts_match, canonical_path
from saleswell.functions.keys import candidate_keys, item_key, leaf_key
from saleswell.functions.numeric import same_number

# Field -> (our column, their column, kind).
PARITY_FIELDS = {
    "quantity": ("on_hand", "quantity", "number"),
    "income_account": ("income_account", "income_account", "account"),
    "cogs_account": ("cogs_account", "cogs_account", "account"),
    "asset_account": ("asset_account", "asset_account", "account"),
    "purchase_cost": ("cost", "purchase_cost", "number"),
    "sales_price": ("price", "sales_price", "number"),
}


def item_lookup(items: DataFrame) -> DataFrame:
    """``key -> item``: full name and leaf; one item per key, by name order."""
    keys = F.array_compact(F.array(item_key(F.col("item_full_name")), leaf_key(F.col("item_full_name"))))
    pairs = items.select("item_full_name", F.explode(F.array_distinct(keys)).alias("key")).where("key <> ''")
    return pairs.groupBy("key").agg(F.min("item_full_name").alias("item_full_name"))


def match_items(parts: DataFrame, items: DataFrame) -> DataFrame:
    """Best item per part: ``sku, matched_name`` (NULL when nothing matches).

    Candidate keys become rows with a priority and meet the lookup in one
    equi-join; the best hit is a combinable ``min_by``.
    """
    keyed = parts.select("sku", F.posexplode_outer(candidate_keys(F.col("item_full_name"), F.col("sku"))).alias("priority", "key"))
    hits = keyed.join(item_lookup(items).withColumnRenamed("item_full_name", "_name"), "key", "left")
    return hits.groupBy("sku").agg(
        F.min_by("_name", F.when(F.col("_name").isNotNull(), F.col("priority"))).alias("matched_name")
    )


def missing_in_items(parts: DataFrame, matches: DataFrame) -> DataFrame:
    return parts.join(matches.where(F.col("matched_name").isNull()), "sku", "left_semi")


def missing_in_parts(items: DataFrame, matches: DataFrame) -> DataFrame:
    used = matches.where(F.col("matched_name").isNotNull()).select(F.col("matched_name").alias("item_full_name")).distinct()
    return items.join(used, "item_full_name", "left_anti")


def compare_fields(
    parts: DataFrame, items: DataFrame, matches: DataFrame, onhand: DataFrame, mode: str = "strict",
    fields: Sequence[str] = tuple(PARITY_FIELDS),
) -> DataFrame:
    """Long form over matched parts: ``sku, field, our_value, their_value, delta, is_match``.

    ``onhand`` gives ``sku, on_hand``; it is matched without regard to case.
    """
    stock = onhand.groupBy(item_key(F.col("sku")).alias("_k")).agg(F.sum("on_hand").alias("on_hand"))
    ours = (
        parts.join(matches.where(F.col("matched_name").isNotNull()), "sku")
        .withColumn("_k", item_key(F.col("sku")))
        .join(stock, "_k", "left")
        .withColumn("on_hand", F.coalesce("on_hand", F.lit(0.0)))
    )
    theirs = items.select("item_full_name", F.struct(*[F.col(PARITY_FIELDS[f][1]).alias(f) for f in fields]).alias("t"))
    theirs = theirs.withColumnRenamed("item_full_name", "matched_name")
    both = ours.join(theirs, "matched_name")
    # Paths are cleaned once per row, as columns of their own, and only then compared.
    paths = {}
    for field in fields:
        ours_col, _, kind = PARITY_FIELDS[field]
        if kind == "account":
            paths[f"_a_{field}"], paths[f"_b_{field}"] = canonical_path(F.col(ours_col)), canonical_path(F.col(f"t.{field}"))
    both = both.withColumns(paths)
    records = []
    for field in fields:
        ours_col, _, kind = PARITY_FIELDS[field]
        a, b = F.col(ours_col), F.col(f"t.{field}")
        if kind == "number":
            ok, av, bv, delta = same_number(a, b, PARITY_TOLERANCE), a.cast("string"), b.cast("string"), b - a
        else:
            pa, pb = F.col(f"_a_{field}"), F.col(f"_b_{field}")
            ok = accounts_match(pa, pb, field, mode)
            av, bv, delta = F.array_join(pa, ":"), F.array_join(pb, ":"), F.lit(None).cast("double")
        records.append(F.struct(
            F.lit(field).alias("field"), av.alias("our_value"), bv.alias("their_value"), delta.alias("delta"), ok.alias("is_match")
        ))
    return both.select("sku", F.col("matched_name").alias("item_full_name"), F.inline(F.array(*records)))


def field_stats(compared: DataFrame) -> DataFrame:
    return compared.groupBy("field").agg(
        F.count("*").alias("compared"), F.count_if("is_match").alias("matched"), F.count_if(~F.col("is_match")).alias("mismatched")
    )


def all_match_count(compared: DataFrame) -> DataFrame:
    per = compared.groupBy("sku").agg(F.bool_and("is_match").alias("all_match"))
    return per.agg(F.count("*").alias("matched_parts"), F.count_if("all_match").alias("all_fields_match"))


def known_item_lines(lines: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines whose item exists (by any candidate key), and the lines that do not."""
    # Names are matched once for each distinct pair; lines then find their pair, without being exploded themselves.
    keys = item_lookup(items).select("key")
    pairs = lines.select(F.col("item_full_name").alias("_name"), F.col("sku").alias("_sku")).distinct()
    keyed = pairs.select("_name", "_sku", F.explode(candidate_keys(F.col("_name"), F.col("_sku"))).alias("key"))
    hit = keyed.join(keys, "key", "left_semi").select("_name", "_sku").distinct()
    same = lines["item_full_name"].eqNullSafe(hit["_name"]) & lines["sku"].eqNullSafe(hit["_sku"])
    return lines.join(hit, same, "left_semi"), lines.join(hit, same, "left_anti")


def difference(left: DataFrame, right: DataFrame, key: Column | str) -> DataFrame:
    """Rows of ``left`` whose key ``right`` does not have."""
    return left.join(right.select(key).distinct(), key, "left_anti")
