"""Stock figures and the lookups between sales and stock.

No side is marked for broadcast: both sides are at product grain and already
partitioned by product code when they come from an aggregation, and adaptive execution
turns the join into a broadcast join when it measures a side to be small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import sum_or_zero, try_ratio
from ledgerloom.operators.cleaning import fill_defaults
from ledgerloom.operators.ordered import number_rows
from ledgerloom.operators.products import (
    MONTHS, gathered_rows, months_in, period_columns, pivot_months, product_totals, show_months,
)
from ledgerloom.schema import PERIOD, ROW_NO, SOURCE_FILE, present
from ledgerloom.storage import materialize


def latest_per_sku(inventory: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per product code: the last one wins when a code is repeated, also across snapshots (by name)."""
    known = inventory.filter(F.col("product_code").isNotNull())
    place = F.struct(*present(inventory, (SOURCE_FILE, ROW_NO)))
    return known.groupBy("product_code").agg(*[F.max_by(c, place).alias(c) for c in columns])


def _lookup(
    left: DataFrame, inventory: DataFrame, columns: Sequence[str], on_duplicate: str
) -> DataFrame:
    """Left lookup by product code; ``expand`` repeats a row per inventory row of its code.

    When expanding, the side that may hold one code very often is kept as the streamed
    side of each join, so that adaptive execution can split it.
    """
    if on_duplicate == "last":
        return left.join(latest_per_sku(inventory, columns), "product_code", "left")
    found = inventory.filter(F.col("product_code").isNotNull()).select("product_code", *columns)
    matched = found.join(left, "product_code", "inner").select(*left.columns, *columns)
    alone = left.join(found.select("product_code").distinct(), "product_code", "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def add_stock(summary: DataFrame, inventory: DataFrame) -> DataFrame:
    """stock on hand per product, 0 when the product is not in the inventory."""
    stock = inventory.select("product_code", F.col("on_hand").alias("stock"), *present(inventory, (SOURCE_FILE, ROW_NO)))
    return fill_defaults(_lookup(summary, stock, ["stock"], "last"))


def compare_stock(summary: DataFrame, inventory: DataFrame, on_duplicate: str = "last") -> DataFrame:
    """stock next to quantity sold, and their difference."""
    stock = inventory.select("product_code", F.col("on_hand").alias("stock"), *present(inventory, (SOURCE_FILE, ROW_NO)))
    joined = fill_defaults(_lookup(summary, stock, ["stock"], on_duplicate))
    return joined.withColumn("stock_diff", F.col("stock") - F.col("quantity"))


def compare_totals(compared: DataFrame) -> DataFrame:
    """products found in stock, with enough stock, with too little, and without."""
    stocked = F.col("stock") > 0
    return compared.agg(
        F.count(F.lit(1)).alias("products"),
        F.count_if(stocked).alias("matched"),
        F.count_if(stocked & (F.col("stock") >= F.col("quantity"))).alias("enough"),
        F.count_if(stocked & (F.col("stock") < F.col("quantity"))).alias("short"),
        F.count_if(~stocked).alias("unmatched"),
    )


def add_vendor(ranked: DataFrame, inventory: DataFrame, on_duplicate: str = "last") -> DataFrame:
    """stock and vendor per product, 0 and ``N/A`` when unknown."""
    found = inventory.select("product_code", F.col("on_hand").alias("stock"), "vendor_short", *present(inventory, (SOURCE_FILE, ROW_NO)))
    return fill_defaults(_lookup(ranked, found, ["stock", "vendor_short"], on_duplicate))


def sold_codes(sales: DataFrame, periods: Sequence[str] | None = None) -> DataFrame:
    """The distinct product codes sold in the chosen periods."""
    chosen = sales if periods is None else sales.filter(F.col(PERIOD).isin(list(periods)))
    return chosen.select("product_code").dropna().distinct()


def unsold_stock(
    inventory: DataFrame, sales: DataFrame, periods: Sequence[str] | None = None, ordered: bool = True
) -> DataFrame:
    """stocked products not sold in the periods, by stock value descending."""
    unsold = (
        inventory.filter(F.col("on_hand") > 0)
        .join(sold_codes(sales, periods), "product_code", "left_anti")
        .withColumn("stock_value", F.col("on_hand") * F.col("unit_cost"))
    )
    shown = present(unsold, (
        "product_code", "product_name", "on_hand", "unit", "unit_cost", "stock_value",
        "vendor_short", "category_major", "category_mid", "last_in",
    ))
    if not ordered:
        return unsold.select(*shown)
    return unsold.orderBy(F.desc("stock_value"), "product_code", ROW_NO).select(*shown)


def unsold_totals(
    inventory: DataFrame, sales: DataFrame, periods: Sequence[str] | None = None
) -> DataFrame:
    """number, share (null for an empty inventory) and value of the unsold products."""
    sold = sold_codes(sales, periods).withColumn("_sold", F.lit(True))
    unsold = (F.col("on_hand") > 0) & F.col("_sold").isNull()
    totals = inventory.join(sold, "product_code", "left").agg(
        F.count(F.lit(1)).alias("skus"),
        F.count_if(unsold).alias("unsold_skus"),
        sum_or_zero(F.when(unsold, F.col("on_hand") * F.col("unit_cost"))).alias("unsold_value"),
    )
    return totals.withColumn(
        "unsold_share_pct", try_ratio(F.col("unsold_skus"), F.col("skus")) * 100.0
    )


def inventory_with_sales(inventory: DataFrame, summary: DataFrame | None) -> DataFrame:
    """quantity, paid price and amount sold next to every SKU; zeros without sales."""
    if summary is None:
        return inventory.withColumns({
            "sales_quantity": F.lit(0).cast("decimal(18,4)"),
            "sales_unit_price": F.lit(0.0),
            "sales_subtotal": F.lit(0).cast("decimal(18,4)"),
        })
    sold = summary.select(
        "product_code",
        F.col("quantity").alias("sales_quantity"),
        F.col("unit_price_by_qty").alias("sales_unit_price"),
        F.col("subtotal").alias("sales_subtotal"),
    )
    joined = inventory.join(sold, "product_code", "left")
    return joined.select(*inventory.columns, *[
        F.coalesce(c, F.lit(0)).alias(c)
        for c in ("sales_quantity", "sales_unit_price", "sales_subtotal")
    ])


def inventory_with_period_sales(
    inventory: DataFrame, lines: DataFrame, periods: Sequence[str]
) -> DataFrame:
    """quantity and amount of each listed period next to every SKU, 0 if none."""
    chosen = lines.filter(F.col(PERIOD).isin(list(periods))).withColumn("ym", F.col(PERIOD))
    pivot = pivot_months(chosen, periods, ["product_code"])
    joined = inventory.join(pivot, "product_code", "left")
    return joined.select(*inventory.columns, *[
        F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in period_columns(periods)
    ])


def sku_sales(
    inventory: DataFrame, lines: DataFrame, months: Sequence[str] | None = (), on_duplicate: str = "last"
) -> DataFrame:
    """Every SKU with stock, vendor, quantity and amount sold, and month columns."""
    table, months, _ = _skus_sold(inventory, lines, months, on_duplicate, None)
    return show_months(table, months, "sales_quantity", "sales_amount") if MONTHS in table.columns else table


def _skus_sold(
    inventory: DataFrame, lines: DataFrame, months: Sequence[str] | None, on_duplicate: str, sized_by: DataFrame | None
) -> tuple[DataFrame, Sequence[str], int | None]:
    """:func:`sku_sales` with the months still in their map, the months to show, and a number of products sold at most."""
    columns = ["product_name", "stock", "vendor_short"]
    named = inventory.withColumn("stock", F.col("on_hand"))
    if on_duplicate == "last":
        skus = latest_per_sku(named, columns)
    else:
        skus = named.select("product_code", *columns)
    rows = None
    if months is not None and not months:
        sold = product_totals(lines, ["product_code"], "sales_quantity", "sales_amount")
    else:
        sold, rows = gathered_rows(lines, ["product_code"], sized_by)
        sold = sold.withColumnsRenamed({"quantity": "sales_quantity", "subtotal": "sales_amount"})
        if months is None:
            sold = materialize(sold, "months")
            months = months_in(sold)
    shown = [F.col(c) if c == MONTHS else F.coalesce(c, F.lit(0)).alias(c) for c in sold.columns if c != "product_code"]
    joined = skus.join(sold, "product_code", "left").select("product_code", *columns, *shown)
    return fill_defaults(joined), months, rows


def all_sku_sales(
    inventory: DataFrame, lines: DataFrame, months: Sequence[str] | None = None, on_duplicate: str = "last",
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """:func:`sku_sales` with rank 1..n by amount over the whole inventory, by default with all months.

    ``sized_by`` as in :func:`ledgerloom.operators.products.gather_months`.
    """
    table, months, rows = _skus_sold(inventory, lines, months, on_duplicate, sized_by)
    order = [F.desc("sales_amount"), F.asc("product_code"), F.asc("stock")]
    if MONTHS not in table.columns:
        return number_rows(table, order)
    ranked = number_rows(table, order, rows=max(rows, inventory.count()))
    return show_months(ranked, months, "sales_quantity", "sales_amount")


def inventory_kpis(inventory: DataFrame) -> DataFrame:
    """SKUs, units and value in stock, and how many SKUs are below their safety stock."""
    qty = F.col("on_hand")
    return inventory.agg(
        F.count(F.lit(1)).alias("skus"),
        sum_or_zero(qty).alias("total_stock"),
        sum_or_zero(qty * F.col("unit_cost")).alias("stock_value"),
        F.count_if((qty > 0) & (qty < F.col("safety_stock"))).alias("low_stock"),
    )


def category_counts(inventory: DataFrame) -> DataFrame:
    """SKUs per main category, most first."""
    return _counts(inventory, "category_major", "skus")


def top_vendors(inventory: DataFrame, n: int = 20) -> DataFrame:
    """Vendors with the most SKUs."""
    return _counts(inventory, "vendor_short", "skus").limit(n)


def _counts(df: DataFrame, column: str, name: str) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias(name))
        .orderBy(F.desc(name), column)
    )
