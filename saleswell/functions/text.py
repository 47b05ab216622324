"""Text repair, list-name truncation and deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from saleswell.config import LIST_HASH_LEN, LIST_NAME_MAX, UUID_URL_NAMESPACE_HEX

# Mis-decoded byte pairs and typographic marks, and what they stand for.
TEXT_REPAIRS = (
    ("\u00c2\u00b7", "\u00b7"),
    ("\u00e2\u20ac\u2122", "'"),
    ("\u00e2\u20ac\u02dc", "'"),
    ("\u00e2\u20ac\u0153", '"'),
    ("\u00e2\u20ac\u009d", '"'),
    ("\u2019", "'"),
    ("\u2018", "'"),
    ("\u201c", '"'),
    ("\u201d", '"'),
    ("\u00a0", " "),
)
# Fixed value: characters XML 1.0 does not allow.
INVALID_XML = "[^\\x{9}\\x{A}\\x{D}\\x{20}-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]"


def sanitize_text(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for bad, good in TEXT_REPAIRS:
        out = F.replace(out, F.lit(bad), F.lit(good))
    return F.regexp_replace(out, INVALID_XML, "")


def truncate_name(text: Column, limit: int = LIST_NAME_MAX) -> Column:
    """Names over the limit keep a prefix plus a short hash of the whole name."""
    clean = F.trim(sanitize_text(text))
    keep = limit - LIST_HASH_LEN - 1
    digest = F.upper(F.substring(F.sha1(clean), 1, LIST_HASH_LEN))
    short = F.concat(F.substring(clean, 1, keep), F.lit("-"), digest)
    return F.when(F.length(clean) <= limit, clean).otherwise(short)


def name_uuid(seed: Column) -> Column:
    """RFC 4122 version 5 identifier of a seed in the URL namespace."""
    raw = F.concat(F.unhex(F.lit(UUID_URL_NAMESPACE_HEX)), F.encode(seed, "utf-8"))
    h = F.substring(F.sha1(raw), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def parse_timestamp(text: Column) -> Column:
    """ISO (``Z`` allowed) or ``dd.MM.yyyy``; anything else is NULL.

    Dotted dates, told by their length and dots, are turned round to ISO first, so there is one cast and no
    pattern or failing format parse per row.
    """
    piece = lambda at, n: F.substring(text, at, n)
    dotted = (F.length(text) == 10) & (piece(3, 1) == ".") & (piece(6, 1) == ".")
    return F.when(dotted, F.concat(piece(7, 4), F.lit("-"), piece(4, 2), F.lit("-"), piece(1, 2))).otherwise(text).try_cast("timestamp")


def parse_ordinal_date(text: Column) -> Column:
    """``5th Jan 2026`` or ``5 January 2026``."""
    plain = F.regexp_replace(F.trim(text), r"^(\d{1,2})(st|nd|rd|th)?\s+(\w{3})\w*\s+(\d{4})$", "$1 $3 $4")
    return F.to_date(F.try_to_timestamp(F.initcap(plain), F.lit("d MMM yyyy")))
