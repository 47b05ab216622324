"""Money, ratios and tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from saleswell.config import PARITY_TOLERANCE

MONEY = "decimal(18,2)"


def money(value: Column) -> Column:
    """Exact cents; sums of these never depend on row order."""
    return value.cast(MONEY)


def as_double(value: Column, digits: int = 2) -> Column:
    """Round an exact amount once, at the edge."""
    return F.round(value, digits).cast("double")


def round_half_up(value: Column, digits: int) -> Column:
    """Round a ratio half-up on its decimal digits, not on its binary ones."""
    return F.round(value.cast("decimal(28,8)"), digits).cast("double")


def ratio(num: Column, den: Column, scale: float = 1.0, digits: int | None = 2) -> Column:
    """num / den * scale, NULL on a zero or missing denominator."""
    value = F.try_divide(num.cast("double"), den.cast("double"))
    if scale != 1.0:
        value = value * F.lit(float(scale))
    return value if digits is None else round_half_up(value, digits)


def pct_change(current: Column, previous: Column, digits: int | None = 1) -> Column:
    """Change against the size of the base, so a negative base keeps the sign right."""
    return ratio(current - previous, F.abs(previous), 100.0, digits)


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def floor_zero(value: Column) -> Column:
    return F.greatest(value, F.lit(0))


def parse_number(text: Column, default: float | None = 0.0) -> Column:
    """``"$1,234.50 "`` -> 1234.50; blank, junk and non-finite -> default."""
    clean = F.regexp_replace(F.trim(text), r"[$,\s]", "")
    value = clean.try_cast("double")
    finite = F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)
    return finite if default is None else F.coalesce(finite, F.lit(float(default)))


def parse_decimal(text: Column) -> Column:
    """Exact twin of :func:`parse_number` for money columns."""
    clean = F.regexp_replace(F.trim(text), r"[$,\s]", "")
    return F.coalesce(clean.try_cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)"))


def parse_bool(text: Column) -> Column:
    token = F.lower(F.trim(text))
    return (
        F.when(token.isin("true", "1", "yes", "y"), F.lit(True))
        .when(token.isin("false", "0", "no", "n"), F.lit(False))
    )


def number_text(value: Column) -> Column:
    """Shortest plain text of a number: no exponent, no trailing zeros."""
    text = value.cast("decimal(28,8)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def same_number(a: Column, b: Column, tolerance: float = PARITY_TOLERANCE) -> Column:
    """Equal within tolerance; two NULLs are equal, one NULL is not."""
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.abs(a - b) <= F.lit(tolerance)).otherwise(a.isNull() & b.isNull())
