"""KPIs, trends, top-k lists and month reports.

Order amounts stand on header rows only, so sums over order columns always run on the
unfilled rows or on deduplicated orders, never after a fill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import margin_pct, sum_or_zero, try_ratio
from ledgerloom.operators.hierarchy import order_headers
from ledgerloom.schema import ROW_NO, SOURCE_FILE

# Which columns carry amount and profit, on header rows and on lines.
BASIS = {
    "header": ("total_amount", "gross_profit"),
    "line": ("subtotal", "product_profit"),
}


def sales_kpis(sales: DataFrame) -> DataFrame:
    """Sales, profit, number of orders and margin of the raw (unfilled) rows."""
    totals = sales.agg(
        sum_or_zero(F.col("total_amount")).alias("total_sales"),
        sum_or_zero(F.col("gross_profit")).alias("total_profit"),
        F.count_distinct("order_no").alias("total_orders"),
    )
    return totals.withColumn("margin_pct", margin_pct(F.col("total_profit"), F.col("total_sales")))


def order_kpis(orders: DataFrame) -> DataFrame:
    """Sales and profit over deduplicated orders."""
    return orders.agg(
        sum_or_zero(F.col("total_amount")).alias("total_amount"),
        sum_or_zero(F.col("gross_profit")).alias("gross_profit"),
    )


def avg_order_margin(orders: DataFrame) -> DataFrame:
    """Plain mean of the orders' margins; the ratio of sums when there is no margin column."""
    if "margin_pct" in orders.columns:
        return orders.agg(F.avg("margin_pct").alias("avg_margin_pct"))
    return order_kpis(orders).select(
        margin_pct(F.col("gross_profit"), F.col("total_amount")).alias("avg_margin_pct")
    )


def daily_sales(sales: DataFrame) -> DataFrame:
    """Sales per day, in date order; rows without a date are left out."""
    return (
        sales.filter(F.col("order_date").isNotNull())
        .groupBy(F.col("order_date").alias("date"))
        .agg(sum_or_zero(F.col("total_amount")).alias("sales"))
        .orderBy("date")
    )


def rolling_7(daily: DataFrame) -> DataFrame:
    """E5: mean of the last seven days on record, only when more than seven exist.

    The window has no key: its input has one row per calendar day, so it stays small
    whatever the number of sales.
    """
    week = W.orderBy("date").rowsBetween(-6, 0)
    return (
        daily.withColumns({
            "avg_7": F.when(
                F.count(F.lit(1)).over(week) == 7, F.sum("sales").over(week).cast("double") / F.lit(7.0)
            ),
            "_days": F.count(F.lit(1)).over(W.partitionBy()),
        })
        .filter("_days > 7")
        .drop("_days")
    )


def top_customers(sales: DataFrame, n: int = 10) -> DataFrame:
    """Customers by sales."""
    return _top_by_amount(sales, "customer_name", "total_amount", n)


def top_products(sales: DataFrame, n: int = 10, basis: str = "header") -> DataFrame:
    """Products by sales; on ``header`` basis the order amount counts for the product
    on the header row, on ``line`` basis every line counts for its own product."""
    return _top_by_amount(sales, "product_name", BASIS[basis][0], n)


def _top_by_amount(sales: DataFrame, key: str, amount: str, n: int) -> DataFrame:
    return (
        sales.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(sum_or_zero(F.col(amount)).alias("total_amount"))
        .orderBy(F.desc("total_amount"), key)
        .limit(n)
    )


def top_margin_products(sales: DataFrame, n: int = 10, basis: str = "header") -> DataFrame:
    """Products with positive sales by margin."""
    amount, profit = BASIS[basis]
    return (
        sales.filter(F.col("product_name").isNotNull())
        .groupBy("product_name")
        .agg(
            sum_or_zero(F.col(amount)).alias("total_amount"),
            sum_or_zero(F.col(profit)).alias("gross_profit"),
        )
        .filter(F.col("total_amount") > 0)
        .withColumn("margin_pct", margin_pct(F.col("gross_profit"), F.col("total_amount")))
        .orderBy(F.desc("margin_pct"), "product_name")
        .limit(n)
    )


def daily_by_category(sales: DataFrame) -> DataFrame:
    """Sales per day and category; nulls in either are left out."""
    return (
        sales.dropna(subset=["order_date", "category_major"])
        .groupBy(F.col("order_date").alias("date"), F.col("category_major").alias("category"))
        .agg(sum_or_zero(F.col("total_amount")).alias("sales"))
    )


def file_summary(sales: DataFrame) -> DataFrame:
    """Sales and profit of each file's own deduplicated orders, 0 without orders."""
    first = W.partitionBy(SOURCE_FILE, "order_no").orderBy(ROW_NO)
    orders = (
        sales.filter(F.col("order_no").isNotNull())
        .withColumn("_nth", F.row_number().over(first))
        .filter("_nth = 1")
        .select(SOURCE_FILE, "total_amount", "gross_profit")
    )
    files = sales.select(SOURCE_FILE).distinct()
    return (
        orders.unionByName(files, allowMissingColumns=True)
        .groupBy(SOURCE_FILE)
        .agg(
            sum_or_zero(F.col("total_amount")).alias("total_amount"),
            sum_or_zero(F.col("gross_profit")).alias("gross_profit"),
        )
    )


def monthly_report(orders: DataFrame) -> DataFrame:
    """Sales, profit and margin per month; no margin for a month with zero sales."""
    return (
        orders.filter(F.col("ym").isNotNull())
        .groupBy("ym")
        .agg(
            sum_or_zero(F.col("total_amount")).alias("total_amount"),
            sum_or_zero(F.col("gross_profit")).alias("gross_profit"),
        )
        .withColumn("margin_pct", try_ratio(F.col("gross_profit"), F.col("total_amount")) * 100.0)
        .orderBy("ym")
    )


def month_over_month(monthly: DataFrame) -> DataFrame:
    """Growth of sales and profit and change of margin against the month before.

    Only when there is more than one month.  One row per month, so the window without
    a key is small.
    """
    order = W.orderBy("ym")

    def growth(c: str):
        before = F.lag(c).over(order)
        return try_ratio(F.col(c) - before, before) * 100.0

    return (
        monthly.withColumns({
            "sales_growth_pct": growth("total_amount"),
            "profit_growth_pct": growth("gross_profit"),
            "margin_change": F.col("margin_pct") - F.lag("margin_pct").over(order),
            "_months": F.count(F.lit(1)).over(W.partitionBy()),
        })
        .filter("_months > 1")
        .drop("_months")
    )


def month_day_matrix(orders: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    """Sales by month and day of month, only when there is more than one month.

    Long form by default; with ``months`` one column per month.
    """
    cells = (
        orders.filter(F.col("order_date").isNotNull())
        .groupBy(F.date_format("order_date", "yyyy-MM").alias("ym"), F.dayofmonth("order_date").alias("day"))
        .agg(sum_or_zero(F.col("total_amount")).alias("sales"))
    )
    everything = W.partitionBy()
    several = (
        cells.withColumn("_several", F.min("ym").over(everything) < F.max("ym").over(everything))
        .filter("_several")
        .drop("_several")
    )
    if months is None:
        return several
    return several.groupBy("day").pivot("ym", list(months)).agg(F.sum("sales")).orderBy("day")


def coverage_counts(
    orders: DataFrame, lines: DataFrame, sku_sales: DataFrame | None = None
) -> DataFrame:
    """What was processed: orders, lines, months; SKUs sold, not sold, and stuck in stock."""
    parts = [
        orders.agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("ym").alias("months")),
        lines.agg(F.count(F.lit(1)).alias("lines")),
    ]
    if sku_sales is not None:
        sold = F.col("sales_quantity")
        parts.append(sku_sales.agg(
            F.count(F.lit(1)).alias("skus"),
            F.count_if(sold > 0).alias("skus_with_sales"),
            F.count_if(sold == 0).alias("skus_without_sales"),
            F.count_if((sold == 0) & (F.col("stock") > 0)).alias("unsold_with_stock"),
        ))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def largest_orders(orders: DataFrame, n: int = 5) -> DataFrame:
    """The biggest orders."""
    return (
        orders.select("order_no", "total_amount")
        .orderBy(F.desc_nulls_last("total_amount"), "order_no")
        .limit(n)
    )


def order_total(orders: DataFrame) -> DataFrame:
    """The total that the biggest orders are read against."""
    return orders.agg(sum_or_zero(F.col("total_amount")).alias("total_amount"))


def sample_values(orders: DataFrame, n: int = 5, seed: int | None = None) -> DataFrame:
    """A few random amounts and profits for inspection.

    The orders with the smallest hash of seed and number: the same ones whatever the partitions, and again after a failure.
    Every task keeps its n smallest, so n rows a task are all that moves.
    """
    drawn = F.md5(F.concat(F.lit(f"{seed or 0}|"), F.coalesce("order_no", F.lit(""))).cast("binary"))
    place = [c for c in ("order_no", "source_file", "row_no") if c in orders.columns]
    chosen = orders.withColumn("_drawn", drawn).orderBy("_drawn", *place).limit(n)
    return chosen.select("total_amount", "gross_profit")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def dedup_totals(sales: DataFrame) -> DataFrame:
    """Order totals before and after keeping the first row per order number."""
    headers = sales.filter(F.col("order_no").isNotNull())
    before = headers.agg(
        F.count(F.lit(1)).alias("rows_before"), sum_or_zero(F.col("total_amount")).alias("total_before")
    )
    after = order_headers(sales).agg(
        F.count(F.lit(1)).alias("rows_after"), sum_or_zero(F.col("total_amount")).alias("total_after")
    )
    merged = before.unionByName(after, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])
