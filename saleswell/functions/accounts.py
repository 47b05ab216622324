"""Account paths: canonical form, comparison, prefixes, error parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Spellings that denote the same account segment.
PATH_REPAIRS = (
    ("\u00c2\u00b7", "\u00b7"),
    ("\u00e2\u20ac\u2122", "'"),
)
SEGMENT_REPLACEMENTS = (
    ("&", " and "),
    ("cog's", "cogs"),
)
# Decorations stripped from a segment.
HASH_SUFFIX = "-[0-9a-f]{6}$"
NUMBER_PREFIX = "^\\d+\\s*[\u00b7\\-]\\s*"
EDGE_MARKS = "^[ \\-\u00b7]+|[ \\-\u00b7]+$"

ACCOUNT_ROLES = ("income_account", "cogs_account", "asset_account")


def path_segments(path: Column) -> Column:
    """Trimmed, non-empty segments of ``a : b : c``."""
    parts = F.transform(F.split(F.coalesce(path, F.lit("")), ":"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def _segment(seg: Column, abbreviations: tuple[tuple[str, str], ...]) -> Column:
    out = F.lower(seg)
    for old, new in (*SEGMENT_REPLACEMENTS, *abbreviations):
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, HASH_SUFFIX, "")
    out = F.regexp_replace(out, NUMBER_PREFIX, "")
    return F.regexp_replace(F.regexp_replace(out, r"\s+", " "), EDGE_MARKS, "")


def canonical_path(path: Column, abbreviations: tuple[tuple[str, str], ...] = ()) -> Column:
    """Comparable segments; ``abbreviations`` are a deployment's own (long, short) names."""
    for bad, good in PATH_REPAIRS:
        path = F.replace(path, F.lit(bad), F.lit(good))
    parts = F.transform(path_segments(path), lambda s: _segment(s, abbreviations))
    return F.filter(parts, lambda s: s != "")


def accounts_match(ours: Column, theirs: Column, role: str, mode: str = "strict") -> Column:
    """Compare two canonical paths (arrays).

    ``strict`` is equality; ``normalized`` also equates inventory-asset labels;
    ``hierarchy`` accepts parent/child and per-role root rules.
    """
    equal = ours == theirs
    if mode == "strict":
        return equal
    filled = (F.size(ours) > 0) & (F.size(theirs) > 0)
    if role == "asset_account":
        label = F.lit("inventory asset")
        return equal | (
            filled & (F.try_element_at(ours, F.lit(-1)) == label) & (F.try_element_at(theirs, F.lit(-1)) == label)
        )
    if mode == "normalized":
        return equal
    if mode != "hierarchy":
        raise ValueError(f"mode must be strict, normalized or hierarchy: {mode!r}")
    shared = F.least(F.size(ours), F.size(theirs))
    related = filled & (F.slice(ours, F.lit(1), shared) == F.slice(theirs, F.lit(1), shared))
    root = F.lit(False)
    if role == "cogs_account":
        root = filled & (F.get(ours, F.lit(0)) == "cogs") & (F.get(theirs, F.lit(0)) == "cogs")
    elif role == "income_account":
        root = (
            (F.size(ours) >= 2) & (F.size(theirs) >= 2)
            & (F.slice(ours, 1, 2) == F.slice(theirs, 1, 2))
        )
    return F.coalesce(equal | related | root, F.lit(False))


def path_prefixes(path: Column) -> Column:
    """``a:b:c`` -> ``[a, a:b, a:b:c]``."""
    parts = path_segments(path)
    depth = F.size(parts)
    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.array_join(F.slice(parts, F.lit(1), i), ":"))


def account_key(path: Column) -> Column:
    return F.lower(F.array_join(path_segments(path), ":"))


# Fixed value: how the accounting side reports an unknown account.
_REF = r'(?i)invalid reference to quickbooks (?:post |cogs )?account\s+"'


def missing_account(message: Column) -> Column:
    """Account named by an invalid-reference message, or empty."""
    in_item = F.regexp_extract(message, _REF + r'(.+?)"\s+in the item ?inventory', 1)
    generic = F.regexp_extract(message, _REF + r'(.+)"', 1)
    return F.trim(F.coalesce(F.nullif(in_item, F.lit("")), generic, F.lit("")))


def infer_account_type(missing: Column, income: Column, cogs: Column, asset: Column) -> Column:
    """Type of a missing account from the item's own accounts, then from its name."""
    key = account_key(missing)
    within = lambda path: F.array_contains(
        F.transform(path_prefixes(path), lambda p: F.lower(p)), key
    )
    return (
        F.when(key == "", None)
        .when(within(income), "Income")
        .when(within(cogs), "CostOfGoodsSold")
        .when(within(asset), "OtherCurrentAsset")
        .when(key.startswith("cog"), "CostOfGoodsSold")
        .when(F.contains(key, F.lit("inventory asset")) | key.endswith("asset"), "OtherCurrentAsset")
        .otherwise("Income")
    )
