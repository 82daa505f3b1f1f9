from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import dates, names, numbers, reports


def apply(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("c"))).collect()]


def test_sales_numbers(spark):
    got = apply(spark, ["1,200", "", None, "x", "-3.5", ",", " 7 "], numbers.clean_number_sales)
    assert got == [1200, 0, None, None, Decimal("-3.5"), None, 7]


def test_value_numbers(spark):
    got = apply(spark, ["9,603", "", None, "x"], lambda c: numbers.clean_number_value(c, "double"))
    assert got == [9603.0, None, None, None]


def test_inventory_numbers(spark):
    cut = lambda c: numbers.clean_number_inventory(c, "bigint", truncate=True)
    assert apply(spark, ["1,200.9", None, "x", "-12.9"], cut) == [1200, 0, 0, -12]
    whole = apply(spark, ["1,200.9", None], numbers.clean_number_inventory)
    assert whole == [Decimal("1200.9"), 0]


def test_masked_percent(spark):
    assert apply(spark, ["***.**", "12.5", None, "x"], numbers.scrub_masked_percent) == [None, 12.5, None, None]


def test_sales_dates(spark):
    cells = {
        "112.01.15": date(2023, 1, 15), "114/03/31": date(2025, 3, 31), "112-01-15": date(2023, 1, 15),
        "2025-01-15": date(2025, 1, 15), "2025/01/15": date(2025, 1, 15), "2025.01.15": date(2025, 1, 15),
        "20250115": date(2025, 1, 15), "03/04/2025": date(2025, 3, 4), "31/12/2025": date(2025, 12, 31),
        "112.02.30": None, "": None, None: None, "2025-01-15 00:00:00": date(2025, 1, 15), "99.1.5": date(2010, 1, 5),
        "113.02.29": date(2024, 2, 29), "112.02.29": None, "02/30/2025": None, "abc": None, "1.2.3.4": None,
    }
    assert apply(spark, list(cells), dates.parse_sales_date) == list(cells.values())


def test_minguo(spark):
    cells = {
        "114.03.31": date(2025, 3, 31), "114/3/1": date(2025, 3, 1), "114-03-31": date(2025, 3, 31),
        "114.03": None, "114.13.01": None, "2025.01.15": None, "x.y.z": None, None: None, "114.03/31": None,
    }
    assert apply(spark, list(cells), dates.minguo_to_date) == list(cells.values())


def test_calendar_text(spark):
    assert apply(spark, ["114.03.31", "1.2", None], dates.roc_year) == [2025, 1912, None]
    assert apply(spark, ["114.03.99", "x", None], dates.roc_month) == [3, None, None]
    both = lambda c: dates.year_month_text(dates.roc_year(c), dates.roc_month(c))
    assert apply(spark, ["114.3.99", "114"], both) == ["2025-03", None]


def test_file_names(spark):
    assert apply(spark, ["a_20250101_20250131.xlsx", "a_b.xlsx"], names.period_from_filename) == ["2025-01", "a_b.xlsx"]
    dated = lambda c: names.snapshot_date_from_filename(c, F.to_timestamp(F.lit("2024-05-06 07:08:09")))
    assert apply(spark, ["BC_x_20250331.xlsx", "BC_x_331.xlsx"], dated) == ["2025/03/31", "2024/05/06"]
    assert apply(spark, ["BC_x_331.xlsx"], names.snapshot_date_from_filename) == [None]
    first, second = apply(spark, ["x_20250301_y", "none"], names.period_fallback)
    assert first == "2025-03"
    assert second == date.today().strftime("%Y-%m")


def test_keys(spark):
    assert apply(spark, [7, None], names.canonical_key, "bigint") == ["7", None]
    assert apply(spark, [" P1 "], names.canonical_key) == ["P1"]


def test_ratios(spark):
    rows = spark.createDataFrame(
        [(10, 4), (10, 0), (10, -5), (None, 5)], "a int, b int"
    ).select(F.col("a").cast("decimal(18,4)"), F.col("b").cast("decimal(18,4)"))
    got = rows.select(numbers.unit_price_by_qty(F.col("a"), F.col("b")), numbers.margin_pct(F.col("a"), F.col("b")))
    assert [tuple(r) for r in got.collect()] == [(2.5, 250.0), (0.0, 0.0), (0.0, 0.0), (None, None)]


def test_report_text(spark):
    row = spark.createDataFrame(
        [(1234.5, 1.234, -0.5, None)], "m double, g double, p double, n double"
    )
    shown = reports.format_report(row, money=("m",), growth=("g", "n"), percent=("p",), symbol="$")
    assert tuple(shown.first()) == ("$1,234.50", "+1.23%", "-0.50%", None)
    named = reports.format_report(row, money=("m",), headings={"p": "P", "missing": "X", "m": "M"})
    assert named.columns == ["P", "M"]
    assert named.first()["M"] == "1,234.50"


def test_ranking_text(spark):
    row = spark.createDataFrame(
        [(1, "A", 2, 1234.5, 3, 6.0)], "rank int, product_code string, stock int, total_amount double, `2025-01_quantity` int, `2025-01_amount` double"
    )
    shown = reports.format_ranking(row, ["2025-01"])
    assert shown.columns == ["排名", "產品代號", "庫存", "總金額(元)", "2025-01_數量", "2025-01_金額(元)"]
    assert tuple(shown.first()) == (1, "A", 2, "1,234.50", 3, "6.00")
