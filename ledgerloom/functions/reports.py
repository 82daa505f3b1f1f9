"""Report text for money, growth and margin columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: headings of the month comparison report ---------------------------
COMPARISON_HEADINGS = {
    "ym": "月份",
    "total_amount": "總銷售額",
    "sales_growth_pct": "銷售成長",
    "gross_profit": "總毛利",
    "profit_growth_pct": "毛利成長",
    "margin_pct": "毛利率",
    "margin_change": "毛利率變化",
}
RANKING_HEADINGS = {
    "rank": "排名",
    "product_code": "產品代號",
    "product_name": "產品名稱",
    "vendor_short": "廠商簡稱",
    "stock": "庫存",
    "total_quantity": "總數量",
    "sales_quantity": "銷售數量",
    "total_amount": "總金額(元)",
    "sales_amount": "銷售金額(元)",
}
MONTH_HEADINGS = {"quantity": "數量", "amount": "金額(元)"}
# --- end of fixed values --------------------------------------------------------------


def money_text(c: Column, symbol: str = "") -> Column:
    text = F.format_number(c.cast("decimal(38,4)"), 2)
    return F.concat(F.lit(symbol), text) if symbol else text


def percent_text(c: Column, signed: bool = False) -> Column:
    """``1.23%`` or ``+1.23%``; null stays null."""
    pattern = "%+.2f%%" if signed else "%.2f%%"
    return F.when(c.isNotNull(), F.format_string(pattern, c.cast("double")))


def format_report(
    df: DataFrame,
    money: Sequence[str] = (),
    growth: Sequence[str] = (),
    percent: Sequence[str] = (),
    headings: Mapping[str, str] | None = None,
    symbol: str = "",
) -> DataFrame:
    """Text columns for display, renamed and ordered by ``headings`` when given."""
    text = {c: money_text(F.col(f"`{c}`"), symbol) for c in money if c in df.columns}
    text |= {c: percent_text(F.col(c), signed=True) for c in growth if c in df.columns}
    text |= {c: percent_text(F.col(c)) for c in percent if c in df.columns}
    shown = df.withColumns(text) if text else df
    if headings is None:
        return shown
    return shown.select(*[F.col(f"`{c}`").alias(h) for c, h in headings.items() if c in shown.columns])


def format_comparison(monthly: DataFrame) -> DataFrame:
    """The month-over-month table as it is shown."""
    return format_report(
        monthly,
        money=("total_amount", "gross_profit"),
        growth=("sales_growth_pct", "profit_growth_pct", "margin_change"),
        percent=("margin_pct",),
        headings=COMPARISON_HEADINGS,
        symbol="$",
    )


def format_ranking(ranked: DataFrame, months: Sequence[str] = ()) -> DataFrame:
    """A product ranking as it is shown: months ascending, quantity before amount."""
    headings = dict(RANKING_HEADINGS)
    for m in sorted(months):
        headings |= {f"{m}_{what}": f"{m}_{shown}" for what, shown in MONTH_HEADINGS.items()}
    amounts = [c for c in headings if c.endswith("_amount")]
    return format_report(ranked, money=amounts, headings=headings)
