from datetime import date, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import cleaning, filters, inventory, metrics, products, quality
from ledgerloom.plans import reports
from ledgerloom.functions.reports import format_comparison

SALES = (
    "source_file string, row_no long, period string, order_no string, order_date date, customer_name string, "
    "total_amount decimal(18,2), gross_profit decimal(18,4), product_code string, product_name string, unit string, "
    "quantity decimal(18,4), unit_price decimal(18,4), subtotal decimal(18,4), cost_value decimal(18,4), category_major string"
)
STOCK = (
    "row_no long, product_code string, product_name string, on_hand long, safety_stock decimal(18,4), "
    "unit_cost decimal(18,4), vendor_short string, category_major string, category_mid string"
)


def line(file, n, order=None, day=None, customer=None, total=None, profit=None, code=None, name=None, qty=None, price=None, sub=None, cat=None):
    d = lambda v: None if v is None else D(str(v))
    period = f"{file[1:5]}-{file[5:7]}"
    return (file, n, period, order, day, customer, d(total), d(profit), code, name, "EA" if code else None,
            d(qty), d(price), d(sub), d(sub), cat)


@pytest.fixture(scope="module")
def sales(spark):
    jan, feb = date(2025, 1, 5), date(2025, 2, 6)
    return spark.createDataFrame([
        line("f202501", 1, code="A", name="orphan", qty=1, price=1, sub=1),
        line("f202501", 2, "S1", jan, "cust", 100, 20, "A", "apple", 2, 10, 20, "x"),
        line("f202501", 3, code="B", name=None, qty=0, price=5, sub=0),
        line("f202501", 4, code="B", name="bean", qty=4, price=15, sub=60),
        line("f202501", 5, "S2", jan, "other", 50, -10),
        line("f202502", 1, "S1", feb, "cust", 999, 9, "A", "apple two", 3, 20, 50, "x"),
        line("f202502", 2, "S3", feb, None, 200, 50, "C", "cake", 5, 8, 40, None),
        line("f202502", 3, code=None, name="no code", qty=5, sub=7),
    ], SALES).cache()


@pytest.fixture(scope="module")
def stock(spark):
    return spark.createDataFrame([
        (1, "A", "apple", 5, 10, D("2.5"), "v1", "x", "m"),
        (2, "B", "bean", 0, 10, D("1"), None, "y", "m"),
        (3, "Z", "zinc", 30, 10, D("4"), "v2", "y", None),
        (4, "A", "apple new", 9, 10, D("3"), "v9", "x", "m"),
        (5, None, "blank", 3, 10, D("1"), "v2", None, None),
    ], STOCK.replace("safety_stock decimal(18,4)", "safety_stock int")).withColumn(
        "safety_stock", F.col("safety_stock").cast("decimal(18,4)")
    ).cache()


def as_dict(df, key, *values):
    return {r[key]: tuple(r[v] for v in values) for r in df.collect()}


def test_kpis(sales):
    row = metrics.sales_kpis(sales).first()
    assert (row.total_sales, row.total_profit, row.total_orders) == (1349, 69, 3)
    assert row.margin_pct == pytest.approx(69 / 1349 * 100)
    empty = metrics.sales_kpis(sales.filter("false")).first()
    assert (empty.total_sales, empty.total_orders, empty.margin_pct) == (0, 0, 0.0)


def test_orders_and_months(sales):
    from ledgerloom.operators.hierarchy import order_headers

    orders = cleaning.derive_calendar(order_headers(sales))
    assert tuple(metrics.order_kpis(orders).first()) == (350, 60)
    monthly = metrics.monthly_report(orders)
    assert as_dict(monthly, "ym", "total_amount", "gross_profit") == {"2025-01": (150, 10), "2025-02": (200, 50)}
    growth = metrics.month_over_month(monthly).orderBy("ym").collect()
    assert growth[0].sales_growth_pct is None
    assert growth[1].sales_growth_pct == pytest.approx(100 / 3)
    assert growth[1].margin_change == pytest.approx(25 - 10 / 150 * 100)
    assert metrics.month_over_month(monthly.limit(1)).count() == 0
    text = format_comparison(metrics.month_over_month(monthly)).collect()
    assert text[0]["總銷售額"] == "$150.00" and text[0]["銷售成長"] is None
    assert text[1]["銷售成長"] == "+33.33%" and text[1]["毛利率"] == "25.00%"
    assert as_dict(metrics.file_summary(sales), "source_file", "total_amount") == {"f202501": (150,), "f202502": (1199,)}
    totals = metrics.dedup_totals(sales).first()
    assert (totals.rows_before, totals.rows_after, totals.total_before, totals.total_after) == (4, 3, 1349, 350)
    assert [r.order_no for r in metrics.largest_orders(orders, 2).collect()] == ["S3", "S1"]
    assert metrics.month_day_matrix(orders).count() == 2
    assert metrics.month_day_matrix(orders.filter("ym = '2025-01'")).count() == 0
    wide = metrics.month_day_matrix(orders, ["2025-01", "2025-02"]).collect()
    assert [(r.day, r["2025-01"], r["2025-02"]) for r in wide] == [(5, 150, None), (6, None, 200)]
    assert metrics.sample_values(orders, 2, 1).count() == 2


def test_growth_after_a_month_without_sales(spark):
    monthly = spark.createDataFrame(
        [("2025-01", D(0), D(0)), ("2025-02", D(5), D(1))], "ym string, total_amount decimal(28,2), gross_profit decimal(28,4)"
    ).withColumn("margin_pct", F.lit(0.0))
    assert metrics.month_over_month(monthly).orderBy("ym").collect()[1].sales_growth_pct is None


def test_margin_mean(spark, sales):
    orders = spark.createDataFrame([(10.0,), (None,), (20.0,)], "margin_pct double")
    assert metrics.avg_order_margin(orders).first()[0] == 15.0
    assert metrics.avg_order_margin(sales.filter("order_no = 'S3'")).first()[0] == 25.0


@pytest.mark.parametrize("days,rows,filled", [(6, 0, 0), (7, 0, 0), (8, 8, 2)])
def test_rolling(spark, days, rows, filled):
    start = date(2025, 1, 1)
    daily = spark.createDataFrame(
        [(start + timedelta(days=i * (3 if i > 4 else 1)), D(i)) for i in range(days)], "date date, sales decimal(28,2)"
    )
    got = metrics.rolling_7(daily).orderBy("date").collect()
    assert len(got) == rows
    assert [r.avg_7 for r in got if r.avg_7 is not None] == [3.0, 4.0][:filled]


def test_top_lists(sales):
    assert [(r.customer_name, r.total_amount) for r in metrics.top_customers(sales).collect()] == [("cust", 1099), ("other", 50)]
    header = as_dict(metrics.top_products(sales), "product_name", "total_amount")
    assert header == {"apple two": (999,), "cake": (200,), "apple": (100,), "orphan": (0,), "bean": (0,), "no code": (0,)}
    assert [r.product_name for r in metrics.top_products(sales, 2, "line").collect()] == ["bean", "apple two"]
    margins = metrics.top_margin_products(sales).collect()
    assert [(r.product_name, r.margin_pct) for r in margins][:2] == [("cake", 25.0), ("apple", 20.0)]
    assert as_dict(metrics.daily_by_category(sales), "date", "category", "sales") == {
        date(2025, 1, 5): ("x", 100), date(2025, 2, 6): ("x", 999),
    }
    assert metrics.daily_sales(sales).count() == 2


def test_product_summary(sales):
    got = products.product_summary(sales).collect()
    assert [r.product_code for r in got] == ["A", "B", "C"]
    assert got[0].product_name == "orphan" and got[1].product_name == "bean"
    assert (got[0].quantity, got[0].subtotal, got[0].unit_price) == (6, 71, pytest.approx(31 / 3))
    assert got[0].unit_price_by_qty == pytest.approx(71 / 6)
    assert [r.product_code for r in products.product_summary(sales, "a|c").collect()] == ["A", "C"]
    bare = products.product_summary(sales.select("source_file", "row_no", "product_code", "quantity"))
    assert bare.columns == ["product_code", "quantity"]
    free = sales.filter("product_code = 'B' and quantity = 0")
    assert products.product_summary(free).first().unit_price_by_qty == 0.0


def test_period_columns(sales):
    periods = ["2025-02", "2025-01", "2024-12"]
    table = products.product_summary_by_period(sales, periods)
    rows = as_dict(table, "product_code", "2025-01_quantity", "2025-02_quantity", "2025-02_amount", "2024-12_amount")
    assert rows == {"A": (3, 3, 50, 0), "B": (4, 0, 0, 0), "C": (0, 5, 40, 0)}
    for r in table.collect():
        assert r["2025-01_quantity"] + r["2025-02_quantity"] == r.quantity
    sorted_columns = products.order_period_columns(table, periods).columns
    assert sorted_columns.index("2024-12_amount") < sorted_columns.index("2025-02_quantity") < sorted_columns.index("subtotal")
    assert products.order_period_columns(table, periods, "integrated").columns[-6:] == products.period_columns(periods)


def test_rankings(sales, stock):
    lines = cleaning.derive_calendar(sales.withColumn("order_date", F.coalesce("order_date", F.lit(date(2025, 1, 9)))))
    ranked = products.rank_sold_products(lines, ["2025-01"]).orderBy("rank").collect()
    assert [(r["rank"], r.product_code, r.total_amount) for r in ranked] == [
        (1, "B", 60), (2, "A", 50), (3, "C", 40), (4, "A", 20), (5, "A", 1)]
    top = products.top_n_products(lines, 2).orderBy("rank").collect()
    assert [(r["rank"], r.product_name) for r in top] == [(1, "bean"), (2, "apple two")]
    joined = products.attach_months(
        products.rank_sold_products(lines), products.pivot_months(lines.filter("product_code = 'A'"), ["2025-02"])
    )
    assert {(r.product_name, r["2025-02_amount"]) for r in joined.collect()} == {
        ("bean", 0), ("apple two", 50), ("cake", 0), ("apple", 0), ("orphan", 0)}
    every = inventory.all_sku_sales(stock, lines, ["2025-01"]).orderBy("rank").collect()
    assert [(r["rank"], r.product_code, r.stock, r.vendor_short, r.sales_quantity, r["2025-01_amount"]) for r in every] == [
        (1, "A", 9, "v9", 6, 21), (2, "B", 0, "N/A", 4, 60), (3, "Z", 30, "v2", 0, 0)]
    expanded = inventory.all_sku_sales(stock, lines, on_duplicate="expand")
    assert expanded.count() == 5 and expanded.filter("product_code = 'A'").count() == 2
    flagged = as_dict(products.flag_unsold(inventory.sku_sales(stock, lines)), "product_code", "is_unsold", "product_name")
    assert flagged["Z"] == (True, "zinc ⚠️ 未銷售") and flagged["B"] == (False, "bean")


def test_lookups(spark, sales, stock):
    summary = products.product_summary(sales, ordered=False)
    assert as_dict(inventory.add_stock(summary, stock), "product_code", "stock") == {"A": (9,), "B": (0,), "C": (0,)}
    compared = inventory.compare_stock(summary, stock)
    assert as_dict(compared, "product_code", "stock_diff") == {"A": (3,), "B": (-4,), "C": (-5,)}
    assert tuple(inventory.compare_totals(compared).first()) == (3, 1, 1, 0, 2)
    expanded = inventory.compare_stock(summary, stock, "expand").collect()
    assert sorted((r.product_code, r.stock) for r in expanded) == [("A", 5), ("A", 9), ("B", 0), ("C", 0)]
    vendors = as_dict(inventory.add_vendor(summary, stock), "product_code", "vendor_short")
    assert vendors == {"A": ("v9",), "B": ("N/A",), "C": ("N/A",)}


def test_unsold(sales, stock):
    unsold = inventory.unsold_stock(stock, sales, ["2025-01"])
    assert [(r.product_name, r.stock_value) for r in unsold.collect()] == [("zinc", 120), ("blank", 3)]
    totals = inventory.unsold_totals(stock, sales).first()
    assert (totals.skus, totals.unsold_skus, totals.unsold_value, totals.unsold_share_pct) == (5, 2, 123, 40.0)
    nothing = inventory.unsold_totals(stock.filter("false"), sales).first()
    assert (nothing.skus, nothing.unsold_share_pct) == (0, None)


def test_inventory_enrichment(sales, stock):
    summary = products.product_summary(sales, ordered=False)
    table = inventory.inventory_with_sales(stock, summary)
    assert sorted((r.row_no, r.sales_quantity, r.sales_subtotal) for r in table.collect()) == [
        (1, 6, 71), (2, 4, 60), (3, 0, 0), (4, 6, 71), (5, 0, 0)]
    off = inventory.inventory_with_sales(stock, None).agg(F.sum("sales_quantity"), F.sum("sales_unit_price")).first()
    assert tuple(off) == (0, 0)
    periods = inventory.inventory_with_period_sales(stock, sales, ["2025-02"])
    assert as_dict(periods.filter("row_no > 1"), "row_no", "2025-02_quantity") == {2: (0,), 3: (0,), 4: (3,), 5: (0,)}


def test_stock_figures(stock):
    row = inventory.inventory_kpis(stock).first()
    assert (row.skus, row.total_stock, row.stock_value, row.low_stock) == (5, 47, D("162.5"), 3)
    assert [tuple(r) for r in inventory.category_counts(stock).collect()] == [("x", 2), ("y", 2)]
    assert [tuple(r) for r in inventory.top_vendors(stock, 2).collect()] == [("v2", 2), ("v1", 1)]
    assert quality.stock_stats(stock).first().in_stock == 4


def test_coverage(sales, stock):
    from ledgerloom.operators.hierarchy import order_headers

    orders = cleaning.derive_calendar(order_headers(sales))
    row = metrics.coverage_counts(orders, sales, inventory.sku_sales(stock, sales)).first()
    assert row.asDict() == {
        "orders": 3, "months": 2, "lines": 8, "skus": 3, "skus_with_sales": 2, "skus_without_sales": 1, "unsold_with_stock": 1}


def test_filters(spark, stock):
    codes = spark.createDataFrame([("a.b",), ("axb",), (None,), ("A",)], "product_code string")
    assert [r[0] for r in filters.filter_product(codes, "A.B").collect()] == ["a.b", "axb"]
    assert [r[0] for r in filters.filter_product(codes, "A.B", literal=True).collect()] == ["a.b"]
    assert filters.filter_product(codes, "").count() == 4
    assert filters.filter_in(stock, "category_major", ["x"]).count() == 2
    assert filters.filter_in(stock, "category_major", ["全部", "x"]).count() == 5
    assert filters.filter_in(stock, "absent", ["x"]).count() == 5
    blank = stock.withColumn("category_major", F.lit(None).cast("string"))
    assert filters.filter_in(blank, "category_major", ["x"]).count() == 5
    assert filters.filter_in(blank, "category_major", ["x"], skip_empty_column=False).count() == 0
    assert filters.filter_in(stock, "category_major", ["x"], skip_empty_column=False).count() == 2
    counts = [filters.filter_stock(stock, s).count() for s in ("全部", "有庫存", "庫存不足", "無庫存")]
    assert counts == [5, 4, 3, 1]
    assert [r[0] for r in filters.option_values(stock, "vendor_short").collect()] == ["v1", "v2", "v9"]
    shown = filters.project_existing(stock, ["on_hand", "absent", "product_code"], ["vendor_short", "gone"])
    assert shown.columns == ["on_hand", "product_code", "vendor_short"]
    assert [r.row_no for r in filters.sort_by(stock, "product_code").collect()] == [3, 2, 1, 4, 5]
    assert [r.row_no for r in filters.sort_by(stock, "on_hand_asc").collect()] == [2, 5, 1, 4, 3]
    assert filters.sort_by(stock, "absent") is stock


def test_defaults(spark):
    df = spark.createDataFrame([(None, None, None, None)], "stock long, vendor_short string, a double, t string")
    assert tuple(cleaning.fill_defaults(df).first()) == (0, "N/A", None, None)
    assert tuple(cleaning.fill_defaults(df, zero=True).first()) == (0, "N/A", 0.0, None)


def test_quantiles(spark):
    import pandas as pd

    values = [(float(i * i % 97), float(i) if i % 3 else None) for i in range(500)]
    df = spark.createDataFrame(values, "a double, b double")
    want = pd.DataFrame(values, columns=["a", "b"]).describe()
    for r in quality.profile(df).collect():
        assert [r["count"], r.mean, r["std"], r["min"], r.p25, r.p50, r.p75, r["max"]] == pytest.approx(list(want[r["column"]]))


def test_quality(spark):
    landed = spark.createDataFrame([("114.01.01",), ("x",), ("",), (None,), ("y",)], "order_date string")
    row = quality.date_parse_stats(landed).first()
    assert (row.dates, row.parsed, row.suspicious) == (3, 1, True)
    assert sorted(r[0] for r in quality.unparsed_dates(landed).collect()) == ["x", "y"]
    assert quality.quality_stats(landed).first().order_date_nulls == 1


def test_report_paths(sales, stock):
    board = reports.sales_dashboard(sales, stock, "A", ["2025-01", "2025-02"])
    assert board["kpis"].first().total_orders == 3
    assert [r.product_code for r in board["summary"].collect()] == ["A"]
    assert board["summary"].first().stock == 9
    assert board["transactions"].count() == 3
    months = reports.month_report(sales, stock, ["2025-01"])
    total = months["totals"].first().total_amount
    assert total == sum(r.total_amount for r in months["monthly"].collect()) == 350
    assert months["coverage"].first().lines == 6
    assert months["ranking_text"].filter("is_unsold").count() == 1
    assert months["growth_text"].count() == 2
    view = reports.stock_view(stock, sales, ["2025-02"], status="有庫存", sort="sales_subtotal")
    assert [r.row_no for r in view["table"].collect()] == [1, 4, 3, 5]
    assert view["kpis"].first().skus == 4
    assert view["unsold_totals"].first().unsold_skus == 2


@pytest.mark.parametrize("n", [1, 13])
def test_summary_does_not_depend_on_layout(sales, partitions, n):
    want = products.product_summary(sales).collect()
    partitions(n)
    assert products.product_summary(sales.repartition(n)).collect() == want
