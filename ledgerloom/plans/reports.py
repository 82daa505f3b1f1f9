"""The three report paths, composed from the operators.

Every function returns a dictionary of lazy tables.  ``month_report`` runs jobs while it is called: what headers inherit is
written, and the month columns are found in the data unless they are named.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ledgerloom.functions.reports import format_comparison
from ledgerloom.operators import filters, inventory, metrics, products
from ledgerloom.operators.cleaning import report_calendar
from ledgerloom.operators.hierarchy import fill_by_order_id, fill_order_info, order_headers
from ledgerloom.schema import present


def sales_dashboard(
    sales: DataFrame, stock: DataFrame | None = None, pattern: str | None = None,
    periods: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Sales path: KPIs, trends, top lists and the product summary with stock."""
    daily = metrics.daily_sales(sales)
    summary = (
        products.product_summary_by_period(sales, periods, pattern, ordered=False)
        if periods else products.product_summary(sales, pattern, ordered=False)
    )
    if stock is not None:
        summary = inventory.add_stock(summary, stock)
    summary = products.order_period_columns(summary, periods)
    tables = {
        "kpis": metrics.sales_kpis(sales),
        "daily": daily,
        "rolling": metrics.rolling_7(daily),
        "customers": metrics.top_customers(sales),
        "products": metrics.top_products(sales),
        "margins": metrics.top_margin_products(sales),
        "summary": filters.sort_by(summary, "subtotal"),
    }
    if "category_major" in sales.columns:
        tables["categories"] = metrics.daily_by_category(sales)
    if pattern:
        tables["transactions"] = filters.filter_product(fill_order_info(sales), pattern)
    return tables


def month_report(
    sales: DataFrame, stock: DataFrame | None = None, months: Sequence[str] | None = None, raw_date: str | None = None,
    fallback: str = "table", run_month: str | None = None,
) -> dict[str, DataFrame]:
    """Month path: orders, lines, month tables, rankings.

    Orders come from the header rows alone.  Only the lines need the fill, and of the order columns only the date (and its
    text ``raw_date``) enters it.  Where the whole date column fails, or is missing, months come from the file names, else
    from ``run_month``; see :func:`ledgerloom.operators.cleaning.report_calendar`.  ``months`` are shown as columns, by
    default all.
    """
    orders = report_calendar(order_headers(sales), "order_date", raw_date, fallback, run_month)
    dates = present(sales, ["order_date", *([raw_date] if raw_date else [])])
    filled = fill_by_order_id(sales, dates) if dates else sales
    lines = report_calendar(filled, "order_date", raw_date, fallback, run_month).filter("product_code is not null")
    monthly = metrics.monthly_report(orders)
    growth = metrics.month_over_month(monthly)
    tables = {
        "orders": orders,
        "lines": lines,
        "totals": metrics.order_kpis(orders),
        "margin": metrics.avg_order_margin(orders),
        "files": metrics.file_summary(sales),
        "monthly": monthly,
        "growth": growth,
        "growth_text": format_comparison(growth),
        "days": metrics.month_day_matrix(orders),
        "largest": metrics.largest_orders(orders),
        "top": products.top_n_products(lines),
    }
    if stock is not None:
        ranked = inventory.all_sku_sales(stock, lines, months, sized_by=sales)
        tables["ranking"] = ranked
        tables["ranking_text"] = products.flag_unsold(ranked)
        tables["coverage"] = metrics.coverage_counts(orders, lines, ranked)
    else:
        tables["ranking"] = products.rank_sold_products(lines, months, sized_by=sales)
        tables["coverage"] = metrics.coverage_counts(orders, lines)
    return tables


def stock_view(
    stock: DataFrame,
    sales: DataFrame | None = None,
    periods: Sequence[str] = (),
    status: str = "all",
    majors: Sequence[str] | None = None,
    mids: Sequence[str] | None = None,
    vendors: Sequence[str] | None = None,
    sort: str = "product_code",
) -> dict[str, DataFrame]:
    """Inventory and integrated path: filtered stock, its KPIs, and sales next to it."""
    chosen = filters.filter_in(stock, "category_major", majors)
    chosen = filters.filter_in(chosen, "category_mid", mids)
    chosen = filters.filter_in(chosen, "vendor_short", vendors)
    tables = {}
    if sales is not None:
        tables["unsold"] = inventory.unsold_stock(chosen, sales, periods or None)
        tables["unsold_totals"] = inventory.unsold_totals(chosen, sales, periods or None)
    chosen = filters.filter_stock(chosen, status)
    tables |= {
        "kpis": inventory.inventory_kpis(chosen),
        "categories": inventory.category_counts(chosen),
        "vendors": inventory.top_vendors(chosen),
    }
    table = chosen
    if sales is not None and periods:
        table = inventory.inventory_with_period_sales(table, sales, periods)
    summary = None if sales is None else products.product_summary(sales, ordered=False)
    table = inventory.inventory_with_sales(table, summary)
    return tables | {"table": filters.sort_by(table, sort)}
