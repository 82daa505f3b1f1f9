"""Row filters, projections and named sorts of the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.schema import present

# --- fixed values: what the filters are called ----------------------------------------
ALL = "全部"
STOCK_STATUS = {
    "全部": "all",
    "有庫存": "in_stock",
    "庫存不足": "low_stock",
    "無庫存": "no_stock",
}
# --- end of fixed values ---------------------------------------------------------------


def filter_product(df: DataFrame, pattern: str | None, literal: bool = False) -> DataFrame:
    """Product code contains the pattern, ignoring case; null codes never match.

    The pattern is a regular expression unless ``literal``; empty means no filter.
    """
    if not pattern:
        return df
    code = F.col("product_code")
    if literal:
        return df.filter(F.lower(code).contains(pattern.lower()))
    return df.filter(code.rlike(f"(?i){pattern}"))


def filter_in(
    df: DataFrame, column: str, values: Sequence[str] | None, skip_empty_column: bool = True
) -> DataFrame:
    """Rows whose value is chosen; no filter for "all" or when the column is absent.

    A column that is null on every row filters nothing either, at the price of one more
    look at that column; without ``skip_empty_column`` it leaves no row.
    """
    if values is None or ALL in values or column not in df.columns:
        return df
    chosen = F.col(column).isin(list(values))
    if skip_empty_column:
        chosen = chosen | (df.agg(F.count(column)).scalar() == 0)
    return df.filter(chosen)


def stock_status(on_hand: str = "on_hand", safety: str = "safety_stock") -> Column:
    """``no_stock``, ``low_stock`` (below the safety stock) or ``in_stock``."""
    qty = F.col(on_hand)
    return (
        F.when(qty <= 0, F.lit("no_stock"))
        .when(qty < F.col(safety), F.lit("low_stock"))
        .when(qty > 0, F.lit("in_stock"))
    )


def filter_stock(df: DataFrame, status: str) -> DataFrame:
    """D3: by stock status; ``in_stock`` includes rows that are low."""
    qty = F.col("on_hand")
    conditions = {
        "in_stock": qty > 0,
        "low_stock": (qty > 0) & (qty < F.col("safety_stock")),
        "no_stock": qty <= 0,
    }
    name = STOCK_STATUS.get(status, status)
    if name == "all":
        return df
    return df.filter(conditions[name])


def option_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct non-null values of a column, sorted."""
    return df.select(column).dropna().distinct().orderBy(column)


def project_existing(
    df: DataFrame, columns: Sequence[str], optional: Sequence[str] = ()
) -> DataFrame:
    """The listed columns that exist, in order, with optional ones at the end."""
    return df.select(*present(df, [*columns, *[c for c in optional if c not in columns]]))


def sort_by(df: DataFrame, option: str, tie: Sequence[str] = ("product_code", "row_no")) -> DataFrame:
    """Named sort; descending unless the option ends in ``_asc``, nulls last.

    This holds for code and name as well.  Equal keys are ordered by ``tie``.
    """
    ascending = option.endswith("_asc")
    column = option.removesuffix("_asc")
    if column not in df.columns:
        return df
    key = F.col(f"`{column}`")
    first = key.asc_nulls_last() if ascending else key.desc_nulls_last()
    return df.orderBy(first, *[F.col(c).asc_nulls_last() for c in present(df, tie) if c != column])
