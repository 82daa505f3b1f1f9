"""One query per operator, over the tables derived from the test data.

Each entry takes (session, folder) and returns a table; dates leave as ISO text so that
every engine prints them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import dates, names, numbers, reports
from ledgerloom.operators import cleaning, filters, hierarchy, inventory, metrics, products, quality
from ledgerloom.operators.ordered import number_rows
from ledgerloom.plans import landing
from ledgerloom.plans.reports import month_report
from ledgerloom.schema import PERIOD, POSITION, ROW_NO, SOURCE_FILE, check_contract, resolve_aliases
from ledgerloom.sources import exports
from ledgerloom.storage import materialize
from ledgerloom.streaming.incremental import land_and_wait, read_uploads

Query = Callable[[SparkSession, str], DataFrame]

# Months shown as columns and used as filters (the data covers 1995-01 to 2001-08).
MONTHS = ("1997-11", "1997-12", "1998-01", "1998-02")
UNSOLD_PERIODS = ("1998-01",)
CATEGORIES = ("SMALL", "LARGE")
PATTERN = "P1.*5$"

QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return register


def _iso(df: DataFrame) -> DataFrame:
    found = [c for c, t in df.dtypes if t == "date"]
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in found}) if found else df


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.derive_calendar(hierarchy.order_headers(landing.sales(spark, sf)))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with the month of their order; only the date goes through the fill."""
    filled = hierarchy.fill_by_order_id(landing.sales(spark, sf), ["order_date"])
    return cleaning.derive_calendar(filled).filter(F.col("product_code").isNotNull())


def gapped_sales(spark: SparkSession, sf: str) -> DataFrame:
    """Sales rows made harder: leading orphans, repeated order numbers, blank header
    customers, lines with a customer of their own."""
    order_key = F.substring("order_no", 3, 18).cast("bigint")
    return landing.sales(spark, sf).withColumns({
        "order_no": F.when(
            F.col("order_no").isNotNull() & (F.col(ROW_NO) > 3),
            F.concat(F.lit("R"), (order_key % 97).cast("string")),
        ),
        "customer_name": F.when(
            F.col("order_no").isNotNull(),
            F.when(F.col(ROW_NO) % 3 != 0, F.col("customer_name")),
        ).otherwise(F.when(F.col(ROW_NO) % 11 == 0, F.concat(F.lit("own "), F.col(ROW_NO).cast("string")))),
    })


# --- sources, sinks, catalogue ----------------------------------------------------------

_READ_BACK = (SOURCE_FILE, "order_no", "product_code", "quantity", "subtotal", "customer_name", "total_amount")


@query("a1_read_sales")
def _(spark, sf):
    rows = exports.read_sales(spark, landing.export_folder(spark, sf, "sales"))
    return hierarchy.fill_order_info(rows, ["order_no", "customer_name", "total_amount"]).select(*_READ_BACK)


@query("a2_read_inventory")
def _(spark, sf):
    stock = exports.read_inventory(spark, landing.export_folder(spark, sf, "inventory"))
    return inventory.latest_per_sku(stock, ["product_name", "on_hand", "unit_cost", "vendor_short"])


@query("a1_row_order")
def _(spark, sf):
    """Exports of one name in two folders, one of them appended to: every row at its place in its own export."""
    rows = exports.read_sales(spark, landing.twin_exports(spark, sf))
    rows = rows.select(SOURCE_FILE, ROW_NO, PERIOD, "order_no", "product_code", "subtotal")
    placed = number_rows(rows, [F.col(ROW_NO).asc()], [SOURCE_FILE], "place", rows=rows.count())
    return placed.select(SOURCE_FILE, "place", PERIOD, "order_no", "product_code", "subtotal")


@query("a2_read_inventory_rows")
def _(spark, sf):
    stock = exports.read_inventory(spark, landing.export_folder(spark, sf, "inventory"))
    placed = number_rows(stock, [F.col(ROW_NO).asc()], name="place")
    return placed.select("place", "product_code", "product_name", "on_hand", "unit_cost", "vendor_short", "margin_pct")


@query("a3_file_catalog")
def _(spark, sf):
    listed = exports.file_catalog(spark, landing.export_folder(spark, sf, "sales"), order="name")
    return listed.select("name", (F.col("bytes") > 0).alias("has_bytes"), F.col("modified").isNotNull().alias("has_time"))


@query("a4_overlay_catalog")
def _(spark, sf):
    history = exports.file_catalog(spark, landing.export_folder(spark, sf, "sales"))
    active = history.filter(names.period_from_filename(F.col("name")).isin(list(MONTHS)))
    both = exports.overlay_catalog(active.withColumn("side", F.lit("active")), history.withColumn("side", F.lit("history")))
    return both.select("name", "side")


@query("a5_period_from_filename")
def _(spark, sf):
    files = landing.sales_text(spark, sf).groupBy(SOURCE_FILE).agg(F.count(F.lit(1)).alias("n"))
    return files.withColumn("period", names.period_from_filename(F.col(SOURCE_FILE)))


@query("a6_snapshot_date_from_filename")
def _(spark, sf):
    files = landing.inventory_text(spark, sf).groupBy(SOURCE_FILE).agg(F.count(F.lit(1)).alias("n"))
    return files.withColumn("snapshot_date", names.snapshot_date_from_filename(F.col(SOURCE_FILE)))


@query("a7_period_fallback")
def _(spark, sf):
    undated = landing.sales_text(spark, sf).withColumn("ym", F.lit(None).cast("string"))
    return cleaning.apply_period_fallback(undated).groupBy("ym").agg(F.count(F.lit(1)).alias("n"))


@query("a7_month_report_undated")
def _(spark, sf):
    """The month report of a table without a date column: months come from the file names."""
    report = month_report(landing.sales(spark, sf).drop("order_date"))
    return report["monthly"].join(report["lines"].groupBy("ym").agg(F.count(F.lit(1)).alias("lines")), "ym")


@query("a8_union_periods")
def _(spark, sf):
    sales = landing.sales(spark, sf).drop(PERIOD)
    headers = sales.filter(F.col("order_no").isNotNull())
    lines = sales.filter(F.col("order_no").isNull()).drop("order_no", "customer_name", "total_amount")
    return (
        exports.union_periods([headers, lines])
        .groupBy(PERIOD)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("customer_name").alias("customers"),
            numbers.sum_or_zero(F.col("subtotal")).alias("subtotal"),
        )
    )


@query("a9_select_periods_latest")
def _(spark, sf):
    return _period_totals(exports.select_periods(landing.sales(spark, sf), "latest"))


@query("a9_select_periods_one")
def _(spark, sf):
    """One period of the landed CSV: only its files are opened."""
    return _period_totals(exports.read_sales(spark, landing.export_folder(spark, sf, "sales"), periods=[MONTHS[0]]))


@query("a9_latest_export")
def _(spark, sf):
    """The newest export by a catalogue whose times follow the names, so that they are the same everywhere."""
    folder = landing.export_folder(spark, sf, "sales")
    stamped = F.to_timestamp(F.substring("name", 7, 8), "yyyyMMdd")
    catalog = exports.file_catalog(spark, folder).withColumn("modified", stamped)
    newest = exports.latest_export(exports.read_sales(spark, folder), catalog)
    return newest.select(SOURCE_FILE, "order_no", "product_code", "quantity", "subtotal")


@query("a9_select_periods_many")
def _(spark, sf):
    return _period_totals(exports.select_periods(landing.sales(spark, sf), "many", MONTHS))


def _period_totals(df: DataFrame) -> DataFrame:
    return df.groupBy(PERIOD).agg(
        F.count(F.lit(1)).alias("n"), numbers.sum_or_zero(F.col("subtotal")).alias("subtotal")
    )


@query("a10_write_csv")
def _(spark, sf):
    unsold = inventory.unsold_stock(landing.inventory(spark, sf), landing.sales(spark, sf), UNSOLD_PERIODS)
    path = landing.table_folder(spark, sf, "unsold_csv")
    exports.write_csv(unsold, path)
    return spark.read.option("header", True).schema(unsold.schema).csv(path)


@query("a11_preview")
def _(spark, sf):
    return exports.preview(landing.sales(spark, sf), 10).select(*POSITION, "order_no", "product_code", "quantity", "subtotal")


@query("a11_describe_columns")
def _(spark, sf):
    return exports.describe_columns(landing.sales(spark, sf))


@query("a12_profile")
def _(spark, sf):
    columns = ["quantity", "unit_price", "subtotal", "total_amount"]
    shown = quality.profile(landing.sales(spark, sf), columns)
    rounded = ("mean", "std", "min", "p25", "p50", "p75", "max")
    return shown.withColumns({c: F.round(c, 4) for c in rounded})


@query("a13_land_incremental")
def _(spark, sf):
    target = landing.table_folder(spark, sf, "incremental")
    land_and_wait(
        spark, landing.export_folder(spark, sf, "sales"), target, f"{target}-state",
        landing.export_header(spark, sf, "sales"),
    )
    landed = spark.read.parquet(target).withColumn(PERIOD, F.col(PERIOD).cast("string"))
    return landed.groupBy(PERIOD).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("order_no").alias("orders"),
        numbers.sum_or_zero(F.col("total_amount")).alias("total_amount"),
        numbers.sum_or_zero(F.col("subtotal")).alias("subtotal"),
    )


@query("a13_replaced_uploads")
def _(spark, sf):
    rows = read_uploads(spark, *landing.uploads(spark, sf, MONTHS))
    return _period_totals(rows)


# --- cleaning and scalar expressions ----------------------------------------------------


@query("b1_clean_number_sales")
def _(spark, sf):
    text = landing.sales_text(spark, sf)
    amount = F.when(F.col(ROW_NO) % 13 == 0, F.lit("")).when(F.col(ROW_NO) % 17 == 0, F.lit("n/a"))
    amount = amount.otherwise(F.col("total_amount"))
    return text.select(*POSITION, numbers.clean_number_sales(amount, "decimal(18,2)").alias("total_amount"))


@query("b2_clean_number_inventory")
def _(spark, sf):
    text = landing.inventory_text(spark, sf)
    raw = F.when(F.col(ROW_NO) % 13 == 0, F.lit("x")).otherwise(F.concat("on_hand", F.lit(".75")))
    return text.select(
        ROW_NO,
        numbers.clean_number_inventory(raw, "bigint", truncate=True).alias("on_hand"),
        numbers.clean_number_inventory(F.col("unit_cost"), "decimal(18,4)", truncate=True).alias("unit_cost_cut"),
    )


@query("b3_clean_number_value")
def _(spark, sf):
    text = landing.sales_text(spark, sf)
    amount = F.when(F.col(ROW_NO) % 13 == 0, F.lit("")).otherwise(F.col("total_amount"))
    return text.select(*POSITION, numbers.clean_number_value(amount, "double").alias("total_amount"))


@query("b4_scrub_masked_percent")
def _(spark, sf):
    return landing.inventory_text(spark, sf).select(
        ROW_NO, numbers.scrub_masked_percent(F.col("margin_pct")).alias("margin_pct")
    )


def _date_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every order's date in one of ten spellings."""
    day, key = F.col("o_orderdate"), F.col("o_orderkey") % 10
    roc = (F.year(day) - 1911).cast("string")
    text = (
        F.when(key == 0, F.concat(roc, F.date_format(day, ".MM.dd")))
        .when(key == 1, F.concat(roc, F.date_format(day, "/MM/dd")))
        .when(key == 2, F.concat(roc, F.date_format(day, "-MM-dd")))
        .when(key == 3, F.date_format(day, "yyyy-MM-dd"))
        .when(key == 4, F.date_format(day, "yyyy/MM/dd"))
        .when(key == 5, F.date_format(day, "yyyy.MM.dd"))
        .when(key == 6, F.date_format(day, "yyyyMMdd"))
        .when(key == 7, F.date_format(day, "MM/dd/yyyy"))
        .when(key == 8, F.concat(roc, F.lit(".02.31")))
    )
    return landing.base(spark, sf, "orders").select("o_orderkey", text.alias("date_text"))


@query("b5_parse_sales_date")
def _(spark, sf):
    parsed = dates.parse_sales_date(F.col("date_text"))
    return _iso(_date_texts(spark, sf).select("o_orderkey", parsed.alias("order_date")))


@query("b6_minguo_to_date")
def _(spark, sf):
    parsed = dates.minguo_to_date(F.col("date_text"))
    return _iso(_date_texts(spark, sf).select("o_orderkey", parsed.alias("order_date")))


@query("b7_parse_date_by_sample")
def _(spark, sf):
    parsed = dates.parse_report_date(F.col("date_text"))
    dated = _date_texts(spark, sf).withColumn("order_date", parsed)
    return _iso(cleaning.derive_calendar(dated).select("o_orderkey", "order_date", "ym"))


@query("b8_derive_calendar")
def _(spark, sf):
    dated = _date_texts(spark, sf).withColumn("order_date", dates.parse_sales_date(F.col("date_text")))
    found = cleaning.derive_calendar(dated, raw="date_text").groupBy("year", "month", "ym")
    return found.agg(F.count(F.lit(1)).alias("n")).fillna(0, ["year", "month"])


@query("b9_check_contract")
def _(spark, sf):
    checked = check_contract(cleaning.derive_calendar(landing.sales(spark, sf)), "sales")
    return checked.select(
        "kind", F.size("missing").cast("bigint").alias("n_missing"), "rows", "usable_rows", "accepted"
    )


@query("b10_resolve_aliases")
def _(spark, sf):
    foreign = landing.sales(spark, sf).withColumnsRenamed(
        {"product_code": "SKU", "quantity": "qty", "subtotal": "amount", "product_name": "商品名稱"}
    )
    return products.top_n_products(resolve_aliases(foreign), 50)


@query("b11_unit_price_by_qty")
def _(spark, sf):
    qty = F.when(F.col(ROW_NO) % 13 == 0, F.lit(0)).otherwise(F.col("quantity"))
    price = numbers.unit_price_by_qty(F.col("subtotal"), qty)
    return landing.sales(spark, sf).select(*POSITION, price.alias("unit_price_by_qty"))


@query("b12_margin_pct")
def _(spark, sf):
    orders = _orders(spark, sf)
    return orders.select("order_no", numbers.margin_pct(F.col("gross_profit"), F.col("total_amount")).alias("margin_pct"))


@query("b13_canonical_key")
def _(spark, sf):
    lines = landing.base(spark, sf, "lineitem").select(
        names.canonical_key(F.col("l_partkey")).alias("key"), F.lit(1).alias("one")
    )
    parts = landing.base(spark, sf, "part").select(
        names.canonical_key(F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" "))).alias("key")
    )
    return lines.join(parts, "key").groupBy("key").agg(F.count("one").alias("n"))


@query("b14_fill_defaults")
def _(spark, sf):
    stock = landing.inventory(spark, sf)
    missing = F.col(ROW_NO) % 4 == 0
    return cleaning.fill_defaults(stock.select(
        ROW_NO,
        F.when(~missing, F.col("on_hand")).alias("stock"),
        F.when(~missing, F.col("vendor_short")).alias("vendor_short"),
        F.when(~missing, F.col("unit_cost")).alias("unit_cost"),
    ), zero=True)


@query("b15_format_report")
def _(spark, sf):
    monthly = metrics.monthly_report(_orders(spark, sf))
    return reports.format_report(
        monthly, money=("total_amount", "gross_profit"), percent=("margin_pct",), symbol="$"
    )


@query("b16_flag_unsold")
def _(spark, sf):
    return products.flag_unsold(inventory.sku_sales(landing.inventory(spark, sf), landing.sales(spark, sf)))


@query("b17_quality_stats")
def _(spark, sf):
    return quality.quality_stats(landing.sales(spark, sf), ["order_no", "order_date", "total_amount", "subtotal"])


@query("b17_damaged_rows")
def _(spark, sf):
    """Line breaks in cells: read by lines each makes two damaged rows, read as quoted cells none."""
    folder = landing.damaged_exports(spark, sf)
    by_line = quality.damaged_stats(exports.read_landed(spark, folder, "sales", damaged="keep"))
    whole = quality.damaged_stats(exports.read_landed(spark, folder, "sales", damaged="keep", multi_line=True))
    return by_line.withColumn("read_as", F.lit("lines")).unionByName(whole.withColumn("read_as", F.lit("quoted cells")))


@query("b17_overflow_stats")
def _(spark, sf):
    """Amounts, some of them empty, words, or beyond the 18 digits of their type."""
    text, n = landing.sales_text(spark, sf), F.col(ROW_NO)
    amount = (
        F.when(n % 13 == 0, F.lit("n/a")).when(n % 17 == 0, F.lit("")).when(n % 19 == 0, F.lit("9" * 17 + ".00"))
        .otherwise(F.col("subtotal"))
    )
    return quality.overflow_stats(text.withColumn("subtotal", amount), ["subtotal", "total_amount"], "sales")


@query("b17_date_parse_stats")
def _(spark, sf):
    return quality.date_parse_stats(_date_texts(spark, sf), "date_text")


@query("b17_stock_stats")
def _(spark, sf):
    return quality.stock_stats(landing.inventory(spark, sf))


# --- header/line hierarchy --------------------------------------------------------------


@query("c1_mark_headers")
def _(spark, sf):
    return hierarchy.mark_headers(gapped_sales(spark, sf)).select(*POSITION, "is_header")


@query("c2_fill_order_info")
def _(spark, sf):
    filled = hierarchy.fill_order_info(
        gapped_sales(spark, sf), ["order_no", "order_date", "customer_name", "total_amount"]
    )
    return _iso(filled.select(*POSITION, "order_no", "order_date", "customer_name", "total_amount"))


@query("c3_fill_by_order_id")
def _(spark, sf):
    filled = hierarchy.fill_by_order_id(
        gapped_sales(spark, sf), ["order_no", "order_date", "customer_name", "total_amount"]
    )
    return _iso(filled.select(*POSITION, "order_no", "order_date", "customer_name", "total_amount"))


@query("c4_split_levels_orders")
def _(spark, sf):
    orders, _ = hierarchy.split_levels(gapped_sales(spark, sf))
    return _iso(orders.select(*POSITION, "order_no", "order_date", "customer_name", "total_amount"))


@query("c4_split_levels_lines")
def _(spark, sf):
    _, lines = hierarchy.split_levels(gapped_sales(spark, sf), header_products="drop")
    return lines.select(*POSITION, "product_code", "quantity", "subtotal")


@query("c4_split_rule")
def _(spark, sf):
    sales = landing.sales(spark, sf)
    return hierarchy.split_rule(hierarchy.fill_order_info(sales, ["order_no"]), unfilled=sales)


def _paired_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every row an order of its own, but each 20th is the line of the row above it; only such lines have a product."""
    n = F.col(ROW_NO)
    line = n % 20 == 0
    number = F.concat(F.lit("Q"), F.when(line, n - 1).otherwise(n).cast("string"), F.lit("-"), F.col(SOURCE_FILE))
    return landing.sales(spark, sf).withColumns({
        "order_no": number, "product_code": F.when(line | (n % 20 != 19), F.col("product_code")),
    })


@query("c4_split_by_product_column")
def _(spark, sf):
    """All rows have an order number and few repeat: the product column tells orders from lines."""
    paired = _paired_rows(spark, sf)
    orders, lines = hierarchy.split_levels(paired, "auto", "drop")
    one = orders.select(*POSITION, "order_no", F.lit("order").alias("level"))
    return one.unionByName(lines.select(*POSITION, "order_no", F.lit("line").alias("level")))


@query("c4_split_by_first_row")
def _(spark, sf):
    """A filled table: the first row of every order number is the order, the rest are lines."""
    sales = landing.sales(spark, sf)
    filled = hierarchy.fill_order_info(sales, ["order_no"])
    orders, lines = hierarchy.split_levels(filled, "auto", "drop", unfilled=sales)
    one = orders.select(*POSITION, "order_no", F.lit("order").alias("level"))
    return one.unionByName(lines.select(*POSITION, "order_no", F.lit("line").alias("level")))


@query("c4_split_header_products")
def _(spark, sf):
    """Header rows with a product count as orders and as lines; the table's own rule is the header mark."""
    orders, lines = hierarchy.split_levels(gapped_sales(spark, sf), "auto", "keep")
    one = orders.groupBy().agg(F.lit("order").alias("level"), F.count(F.lit(1)).alias("n"), F.count("order_no").alias("numbered"))
    two = lines.groupBy().agg(F.lit("line").alias("level"), F.count(F.lit(1)).alias("n"), F.count("order_no").alias("numbered"))
    return one.unionByName(two)


@query("c5_dedup_orders")
def _(spark, sf):
    return hierarchy.order_headers(gapped_sales(spark, sf)).select(*POSITION, "order_no", "total_amount")


@query("c6_assign_parent")
def _(spark, sf):
    parent = F.coalesce("parent_row_no", F.lit(-1)).alias("parent_row_no")
    return hierarchy.assign_parent(gapped_sales(spark, sf)).select(*POSITION, parent)


@query("c6_parent_coverage")
def _(spark, sf):
    return hierarchy.parent_coverage(hierarchy.assign_parent(gapped_sales(spark, sf)))


@query("c7_hierarchy_profile")
def _(spark, sf):
    return hierarchy.hierarchy_profile(gapped_sales(spark, sf))


# --- filters, projections, sorts --------------------------------------------------------


@query("d1_filter_product")
def _(spark, sf):
    return filters.filter_product(landing.sales(spark, sf), PATTERN.lower()).select(
        *POSITION, "product_code", "subtotal"
    )


@query("d2_filter_in")
def _(spark, sf):
    return filters.filter_in(landing.inventory(spark, sf), "category_major", CATEGORIES).select(
        ROW_NO, "product_code", "category_major"
    )


@query("d3_filter_stock")
def _(spark, sf):
    return filters.filter_stock(landing.inventory(spark, sf), "庫存不足").select(
        ROW_NO, "product_code", "on_hand", "safety_stock"
    )


@query("d3_stock_status")
def _(spark, sf):
    status = landing.inventory(spark, sf).select(filters.stock_status().alias("stock_status"))
    return status.groupBy("stock_status").agg(F.count(F.lit(1)).alias("n"))


@query("d4_option_values")
def _(spark, sf):
    return filters.option_values(landing.inventory(spark, sf), "vendor_short")


@query("d5_project_existing")
def _(spark, sf):
    return filters.project_existing(
        landing.inventory(spark, sf), ["product_code", "product_name", "warehouse", "on_hand"], ["vendor_short"]
    )


@query("d6_sort_by")
def _(spark, sf):
    return filters.sort_by(landing.inventory(spark, sf), "on_hand").select(ROW_NO, "product_code", "on_hand")


# --- aggregations, windows, pivots, top-k -----------------------------------------------


@query("e1_sales_kpis")
def _(spark, sf):
    return metrics.sales_kpis(landing.sales(spark, sf))


@query("e2_order_kpis")
def _(spark, sf):
    return metrics.order_kpis(hierarchy.order_headers(gapped_sales(spark, sf)))


@query("e3_avg_order_margin")
def _(spark, sf):
    orders = _orders(spark, sf)
    margin = numbers.margin_pct(F.col("gross_profit"), F.col("total_amount")).cast("decimal(18,8)")
    return metrics.avg_order_margin(orders.withColumn("margin_pct", margin)).select(
        F.round(F.col("avg_margin_pct").cast("double"), 6).alias("avg_margin_pct")
    )


@query("e3_ratio_of_sums")
def _(spark, sf):
    return metrics.avg_order_margin(_orders(spark, sf))


@query("e4_daily_sales")
def _(spark, sf):
    return _iso(metrics.daily_sales(landing.sales(spark, sf)))


@query("e5_rolling_7")
def _(spark, sf):
    return _iso(metrics.rolling_7(metrics.daily_sales(landing.sales(spark, sf))))


@query("e6_top_customers")
def _(spark, sf):
    return metrics.top_customers(landing.sales(spark, sf))


@query("e7_top_products")
def _(spark, sf):
    return metrics.top_products(landing.sales(spark, sf))


@query("e7_top_products_by_line")
def _(spark, sf):
    return metrics.top_products(landing.sales(spark, sf), basis="line")


@query("e8_top_margin_products")
def _(spark, sf):
    return metrics.top_margin_products(landing.sales(spark, sf))


@query("e9_daily_by_category")
def _(spark, sf):
    return _iso(metrics.daily_by_category(landing.sales(spark, sf)))


@query("e10_product_summary")
def _(spark, sf):
    return products.product_summary(landing.sales(spark, sf))


@query("e11_product_summary_by_period")
def _(spark, sf):
    return _plain(products.product_summary_by_period(landing.sales(spark, sf), MONTHS))


def _plain(df: DataFrame) -> DataFrame:
    """Period columns as ``m1997_11_quantity``."""
    return df.withColumnsRenamed({
        c: "m" + c.replace("-", "_") for c in df.columns if c[:4].isdigit()
    })


@query("e12_order_period_columns")
def _(spark, sf):
    table = products.product_summary_by_period(landing.sales(spark, sf), MONTHS, ordered=False)
    return _plain(products.order_period_columns(table, MONTHS))


@query("e13_file_summary")
def _(spark, sf):
    return metrics.file_summary(gapped_sales(spark, sf))


@query("e14_monthly_report")
def _(spark, sf):
    return metrics.monthly_report(_orders(spark, sf))


@query("e15_month_over_month")
def _(spark, sf):
    return metrics.month_over_month(metrics.monthly_report(_orders(spark, sf)))


@query("e16_month_day_matrix")
def _(spark, sf):
    return metrics.month_day_matrix(_orders(spark, sf)).withColumn("day", F.col("day").cast("bigint"))


@query("e17_rank_sold_products")
def _(spark, sf):
    stock = landing.inventory(spark, sf)
    return _plain(products.rank_sold_products(
        _lines(spark, sf), sized_by=landing.sales(spark, sf), lookup=lambda ranked: inventory.add_vendor(ranked, stock)
    ))


@query("e18_top_n_products")
def _(spark, sf):
    return products.top_n_products(landing.sales(spark, sf), 50)


@query("e19_all_sku_sales")
def _(spark, sf):
    return _plain(inventory.all_sku_sales(landing.inventory(spark, sf), _lines(spark, sf), sized_by=landing.sales(spark, sf)))


@query("e20_inventory_kpis")
def _(spark, sf):
    return inventory.inventory_kpis(landing.inventory(spark, sf))


@query("e21_category_counts")
def _(spark, sf):
    return inventory.category_counts(landing.inventory(spark, sf))


@query("e22_top_vendors")
def _(spark, sf):
    return inventory.top_vendors(landing.inventory(spark, sf))


@query("e23_coverage_counts")
def _(spark, sf):
    lines = landing.sales(spark, sf).filter(F.col("product_code").isNotNull())
    skus = inventory.sku_sales(landing.inventory(spark, sf), lines)
    return metrics.coverage_counts(_orders(spark, sf), lines, skus)


@query("e24_largest_orders")
def _(spark, sf):
    return metrics.largest_orders(_orders(spark, sf))


@query("e24_order_total")
def _(spark, sf):
    return metrics.order_total(_orders(spark, sf))


@query("e25_sample_values")
def _(spark, sf):
    return metrics.sample_values(_orders(spark, sf), seed=7)


@query("e26_duplicate_keys")
def _(spark, sf):
    headers = gapped_sales(spark, sf).filter(F.col("order_no").isNotNull())
    return metrics.duplicate_keys(headers, ["order_no"])


@query("e26_dedup_totals")
def _(spark, sf):
    return metrics.dedup_totals(gapped_sales(spark, sf))


# --- joins --------------------------------------------------------------------------------


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return products.product_summary(landing.sales(spark, sf), ordered=False)


@query("f1_add_stock")
def _(spark, sf):
    return inventory.add_stock(_summary(spark, sf), landing.inventory(spark, sf))


@query("f2_compare_stock")
def _(spark, sf):
    return inventory.compare_stock(_summary(spark, sf), landing.inventory(spark, sf)).select(
        "product_code", "quantity", "stock", "stock_diff"
    )


@query("f2_compare_stock_expand")
def _(spark, sf):
    compared = inventory.compare_stock(_summary(spark, sf), landing.inventory(spark, sf), "expand")
    return compared.select("product_code", "quantity", "stock", "stock_diff")


@query("f2_compare_totals")
def _(spark, sf):
    return inventory.compare_totals(
        inventory.compare_stock(_summary(spark, sf), landing.inventory(spark, sf))
    )


@query("f3_add_vendor")
def _(spark, sf):
    sold = products.product_summary(landing.sales(spark, sf), ordered=False).select("product_code", "subtotal")
    return inventory.add_vendor(sold, landing.inventory(spark, sf))


@query("f4_unsold_stock")
def _(spark, sf):
    return inventory.unsold_stock(landing.inventory(spark, sf), landing.sales(spark, sf), UNSOLD_PERIODS)


@query("f4_unsold_totals")
def _(spark, sf):
    return inventory.unsold_totals(landing.inventory(spark, sf), landing.sales(spark, sf), UNSOLD_PERIODS)


@query("f5_inventory_with_sales")
def _(spark, sf):
    table = inventory.inventory_with_sales(landing.inventory(spark, sf), _summary(spark, sf))
    return table.select(ROW_NO, "product_code", "on_hand", "sales_quantity", "sales_unit_price", "sales_subtotal")


@query("f6_inventory_with_period_sales")
def _(spark, sf):
    table = inventory.inventory_with_period_sales(landing.inventory(spark, sf), landing.sales(spark, sf), MONTHS)
    return _plain(table.select(ROW_NO, "product_code", *[F.col(f"`{c}`") for c in products.period_columns(MONTHS)]))


@query("f7_attach_months")
def _(spark, sf):
    lines = materialize(products.gather_months(_lines(spark, sf), sized_by=landing.sales(spark, sf)), "months")
    ranked = products.rank_sold_products(lines, ())
    return _plain(products.attach_months(ranked, products.pivot_months(lines)))
