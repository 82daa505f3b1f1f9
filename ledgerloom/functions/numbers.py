"""Numbers that arrive as text: cleaning and the ratios built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.schema import AMOUNT

_WIDE = "decimal(38,10)"
_MASKED = r"\*\*\*\.\*\*"  # fixed value: how the export prints a margin it cannot show


def _without_commas(c: Column) -> Column:
    return F.translate(c.cast("string"), ",", "")


def clean_number_value(c: Column, to: T.DataType | str = AMOUNT) -> Column:
    """Strip thousands separators; text that is no number becomes null."""
    return _without_commas(c).try_cast(to)


def clean_number_sales(c: Column, to: T.DataType | str = AMOUNT) -> Column:
    """B1: as B3, but an empty cell counts as zero while null stays null."""
    text = c.cast("string")
    return F.when(text == "", F.lit(0).cast(to)).otherwise(clean_number_value(text, to))


def clean_number_inventory(c: Column, to: T.DataType | str = AMOUNT, truncate: bool = False) -> Column:
    """B2: as B3 with null and bad text as zero; optionally cut toward zero to a whole number."""
    value = _without_commas(c).try_cast(_WIDE)
    if truncate:
        value = value.try_cast("bigint")
    return F.coalesce(value.try_cast(to), F.lit(0).cast(to))


def scrub_masked_percent(c: Column) -> Column:
    """Percentage text to double; masked or bad values become null."""
    text = c.cast("string")
    return F.when(~text.rlike(_MASKED), text.try_cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """``numerator / denominator * scale`` where the denominator is positive, otherwise 0.

    Both sides go to double first, so the result does not depend on decimal scales.
    """
    value = numerator.cast("double") / denominator.cast("double")
    if scale != 1.0:
        value = value * F.lit(scale)
    return F.when(denominator > 0, value).otherwise(F.lit(0.0))


def unit_price_by_qty(subtotal: Column, quantity: Column) -> Column:
    """Average price actually paid per unit."""
    return ratio_or_zero(subtotal, quantity)


def margin_pct(profit: Column, sales: Column) -> Column:
    """Profit in percent of sales, 0 when there are no (or negative) sales."""
    return ratio_or_zero(profit, sales, 100.0)


def try_ratio(numerator: Column, denominator: Column) -> Column:
    """Double ratio that is null when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def sum_or_zero(c: Column) -> Column:
    """Sum that is 0, not null, when every value is null."""
    return F.coalesce(F.sum(c), F.lit(0))
