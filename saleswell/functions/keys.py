"""SKU, item and header keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def normalize_sku(col: Column, case: str = "upper", trim: bool = True) -> Column:
    """The feeds disagree on SKU case; every join states which rule it uses."""
    out = F.trim(col) if trim else col
    if case == "upper":
        return F.upper(out)
    if case == "lower":
        return F.lower(out)
    if case == "keep":
        return out
    raise ValueError(f"case must be upper, lower or keep: {case!r}")


def canonical_sku(variant_sku: Column, product_name: Column, product_sku: Column) -> Column:
    """Variant SKU, else product name, else product SKU; blanks do not count."""
    blank = F.lit("")
    first = F.coalesce(*[F.nullif(c, blank) for c in (variant_sku, product_name, product_sku)])
    return normalize_sku(first)


def has_prefix(col: Column, prefixes: Sequence[str]) -> Column:
    """Case-insensitive: does the value start with any of these?"""
    lowered = F.lower(col)
    return reduce(lambda a, b: a | b, [lowered.startswith(p.lower()) for p in prefixes])


def item_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def leaf_key(name: Column) -> Column:
    """Key of the part after the last ``:``; NULL when there is no parent."""
    leaf = F.trim(F.substring_index(name, ":", -1))
    return F.when(F.contains(name, F.lit(":")) & (leaf != ""), F.lower(leaf))


def candidate_keys(full_name: Column, sku: Column) -> Column:
    """Lookup keys of an item, best first: full name, its leaf, SKU, its leaf."""
    keys = F.array(item_key(full_name), leaf_key(full_name), item_key(sku), leaf_key(sku))
    return F.filter(keys, lambda k: k.isNotNull() & (k != ""))


def header_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]", "")


def is_inventory_part(item_type: Column) -> Column:
    key = header_key(item_type)
    return F.contains(key, F.lit("inventorypart")) & ~F.contains(key, F.lit("inventoryassembly"))


def resolve_headers(
    headers: Sequence[str], wanted: dict[str, Sequence[str]], required: Sequence[str] = (), allow_partial: bool = False
) -> dict[str, str]:
    """Match messy headers to fields; ``{found header: field}`` for withColumnsRenamed.

    Case and punctuation don't count, the first candidate found wins, and of headers alike the last.  A missing
    required field raises, unless ``allow_partial``.
    """
    squash = lambda h: "".join(ch for ch in h.lower() if ch.isalnum())
    by_key = {squash(h): h for h in headers}
    found = {
        field: next((by_key[squash(c)] for c in names if squash(c) in by_key), None)
        for field, names in wanted.items()
    }
    missing = [f for f in required if not found.get(f)]
    if missing and not allow_partial:
        raise ValueError(f"required columns missing: {missing}; headers: {list(headers)}")
    return {header: field for field, header in found.items() if header}


def with_fields(df: DataFrame, wanted: dict[str, Sequence[str]], required: Sequence[str] = (), allow_partial: bool = False) -> DataFrame:
    """The wanted fields of a file with messy headers, in their order; fields that it lacks are NULL."""
    found = {field: header for header, field in resolve_headers(df.columns, wanted, required, allow_partial).items()}
    quoted = lambda h: F.col("`" + h.replace("`", "``") + "`")
    return df.select(*[(quoted(found[f]) if f in found else F.lit(None).cast("string")).alias(f) for f in wanted])
