import os
import time
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import cleaning, hierarchy
from ledgerloom.schema import check_contract, headings, resolve_aliases, standardize, typed_schema
from ledgerloom.sources import exports
from ledgerloom.streaming.incremental import land_and_wait

HEADER = "銷貨單號,銷貨日期,客戶名稱,總計金額,毛利,產品代號,產品名稱,數量,單位,單價,小計,成本總值\n"


def write_export(path, rows):
    path.write_text(HEADER + "".join(",".join(r) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def row(n, order=""):
    amount = '"1,200.50"' if order else ""
    return [order, "114.03.31" if order else "", "客戶" if order else "", amount, "5" if order else "",
            f"P{n}", "茶", str(n), "包", "2", '"1,000"', "1"]


def test_read_sales(spark, tmp_path):
    path = write_export(tmp_path / "銷貨單 毛利_20250301_20250331.csv", [row(1, "S1"), row(2), row(3, "S2")])
    got = exports.read_sales(spark, path).orderBy("row_no").collect()
    assert [r.product_code for r in got] == ["P1", "P2", "P3"]
    assert got[0].total_amount == D("1200.50") and got[0].subtotal == 1000
    assert str(got[0].order_date) == "2025-03-31" and got[1].order_date is None
    assert {r.source_file for r in got} == {"銷貨單 毛利_20250301_20250331.csv"}
    assert {r.period for r in got} == {"2025-03"}


def test_row_order_of_a_file_cut_into_blocks(spark, tmp_path):
    n = 3000
    path = write_export(tmp_path / "a_20250101_x.csv", [row(i, f"S{i}" if i % 7 == 0 else "") for i in range(n)])
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        rows = exports.read_sales(spark, path)
        assert rows.rdd.getNumPartitions() > 10
        got = rows.orderBy("row_no").collect()
        assert [r.product_code for r in got] == [f"P{i}" for i in range(n)]
        assert len({r.row_no for r in got}) == n
        filled = hierarchy.fill_order_info(rows, ["order_no"], bucket_rows=64).collect()
        assert all(r.order_no == f"S{int(r.product_code[1:]) // 7 * 7}" for r in filled)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_parquet_export_in_parts(spark, tmp_path):
    folder = str(tmp_path / "big_20250201_x.parquet")
    table = spark.range(1000).select(F.concat(F.lit("P"), "id").alias("產品代號"), F.col("id").cast("string").alias("數量"))
    table.repartitionByRange(5, F.col("數量").cast("int")).sortWithinPartitions(F.col("數量").cast("int")).write.parquet(folder)
    rows = exports.read_sales(spark, folder, "parquet")
    assert [r.product_code for r in rows.orderBy("row_no").collect()] == [f"P{i}" for i in range(1000)]
    assert rows.select("source_file", "period").distinct().collect() == [("big_20250201_x.parquet", "2025-02")]


def test_export_names_with_special_characters(spark, tmp_path):
    odd = "銷 a+b%41#_20250101_x.csv"
    path = tmp_path / "in"
    path.mkdir()
    write_export(path / odd, [row(1)])
    assert exports.read_sales(spark, str(path)).first().source_file == odd
    table = spark.createDataFrame([(odd, "P1")], "source_file string, `產品代號` string")
    folder = str(tmp_path / "table")
    table.write.partitionBy("source_file").option("header", True).csv(folder)
    assert exports.read_sales(spark, folder).first().source_file == odd


def test_other_header_is_refused(spark, tmp_path):
    write_export(tmp_path / "a.csv", [row(1)])
    (tmp_path / "b.csv").write_text(HEADER.replace("銷貨單號,銷貨日期", "銷貨日期,銷貨單號") + ",".join(row(1)) + "\n")
    with pytest.raises(Exception, match="header"):
        exports.read_sales(spark, str(tmp_path)).collect()


def test_read_inventory(spark, tmp_path):
    (tmp_path / "BC_x_20250331.csv").write_text(
        '產品代號,數量,成本單價,毛利率,廠商簡稱\nA,"1,200.9",2.75,***.**,v\nB,x,,12.5,\n', encoding="utf-8"
    )
    got = exports.read_inventory(spark, str(tmp_path)).orderBy("product_code").collect()
    assert [(r.on_hand, r.unit_cost, r.margin_pct, r.vendor_short) for r in got] == [(1200, D("2.75"), None, "v"), (0, 0, 12.5, None)]
    cut = exports.read_inventory(spark, str(tmp_path), truncate_all=True).orderBy("product_code").first()
    assert cut.unit_cost == 2
    missing = exports.read_inventory(spark, str(tmp_path / "nowhere"))
    assert missing.count() == 0 and "on_hand" in missing.columns


def test_catalog(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for i, name in enumerate(("b.xlsx", "a.xlsx", "c.txt", "帳 1+%41.xlsx")):
        (folder / name).write_text("x")
        os.utime(folder / name, (time.time() - i * 1000,) * 2)
    names = lambda df: [r.name for r in df.collect()]
    assert names(exports.file_catalog(spark, str(folder))) == ["b.xlsx", "a.xlsx", "帳 1+%41.xlsx"]
    assert names(exports.file_catalog(spark, str(folder), order="name")) == ["a.xlsx", "b.xlsx", "帳 1+%41.xlsx"]
    assert names(exports.file_catalog(spark, str(tmp_path / "none"))) == []
    active = exports.file_catalog(spark, str(folder)).filter("name = 'a.xlsx'")
    assert names(exports.overlay_catalog(active, exports.file_catalog(spark, str(folder)))) == ["a.xlsx", "b.xlsx", "帳 1+%41.xlsx"]
    rows = spark.createDataFrame([("a.xlsx", 1), ("b.xlsx", 2)], "source_file string, v int")
    assert [r.v for r in exports.latest_export(rows, exports.file_catalog(spark, str(folder))).collect()] == [2]


def test_periods(spark):
    one = spark.createDataFrame([("x_20250101_y", 1, "a")], "source_file string, row_no long, unit string")
    two = spark.createDataFrame([("x_20250201_y", 1, 5)], "source_file string, row_no long, quantity int")
    both = exports.union_periods([one, two])
    assert sorted((r.period, r.unit or "", r.quantity or 0) for r in both.collect()) == [("2025-01", "a", 0), ("2025-02", "", 5)]
    assert [r.period for r in exports.select_periods(both).collect()] == ["2025-02"]
    assert [r.period for r in exports.select_periods(both, "one", ["2025-01"]).collect()] == ["2025-01"]
    assert exports.select_periods(both, "many", ["2025-01", "2025-02", "x"]).count() == 2
    with pytest.raises(ValueError):
        exports.select_periods(both, "one", [])
    with pytest.raises(ValueError):
        exports.union_periods([])


def test_csv_and_preview(spark, tmp_path):
    df = spark.createDataFrame([("茶", 2), ("b", 1)], "name string, n int").coalesce(1)
    exports.write_csv(df, str(tmp_path / "out"))
    text = [f.read_text() for f in (tmp_path / "out").glob("part-*.csv")]
    assert text == ["name,n\n茶,2\nb,1\n"]
    assert exports.preview(df, 1).count() == 1
    assert [tuple(r) for r in exports.describe_columns(df).collect()] == [(0, "name", "string", 2), (1, "n", "int", 2)]


def test_contract_and_aliases(spark):
    good = spark.createDataFrame([("S1", "2025-01", None, 1, 1)], "order_no string, ym string, order_date date, total_amount int, gross_profit int")
    row = check_contract(good, "sales").first()
    assert row.accepted and row.usable_rows == 1 and "customer_code" in row.missing and row.missing_critical == []
    assert not check_contract(good.withColumn("order_no", F.lit(None).cast("string")), "sales").first().accepted
    assert check_contract(good.drop("gross_profit"), "sales").first().missing_critical == ["gross_profit"]
    stock = spark.createDataFrame([("A", 1)], "product_code string, on_hand int")
    assert not check_contract(stock, "inventory").first().accepted
    foreign = spark.createDataFrame([("A", "x", 2, 3)], "SKU string, `商品名稱` string, qty int, amount int")
    named = resolve_aliases(foreign)
    assert tuple(named.select("product_code", "product_name", "quantity", "subtotal").first()) == ("A", "x", 2, 3)
    assert resolve_aliases(named).columns == named.columns


def test_schema(spark):
    assert len(headings("inventory")) == 28
    assert len(headings("sales")) == 17 + 22 + 1
    assert typed_schema("inventory")["on_hand"].dataType.simpleString() == "bigint"
    df = spark.createDataFrame([("a", "b")], "`銷貨單號` string, other string")
    assert standardize(df, "sales").columns == ["order_no", "other"]


def test_incremental_landing(spark, tmp_path):
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    header = HEADER.strip().split(",")
    write_export(source / "s_20250101_x.csv", [row(i, "S1" if i == 0 else "") for i in range(20)])
    land_and_wait(spark, str(source), target, state, header)
    assert spark.read.parquet(target).count() == 20
    write_export(source / "s_20250201_x.csv", [row(i, "S2" if i == 0 else "") for i in range(5)])
    land_and_wait(spark, str(source), target, state, header)
    land_and_wait(spark, str(source), target, state, header)
    landed = spark.read.parquet(target)
    assert {(r.period, r["count"]) for r in landed.groupBy("period").count().collect()} == {("2025-01", 20), ("2025-02", 5)}
    filled = hierarchy.fill_order_info(landed, ["order_no"])
    assert filled.groupBy("order_no").count().count() == 2
    assert [r.product_code for r in landed.filter("period = '2025-01'").orderBy("row_no").collect()] == [f"P{i}" for i in range(20)]


def test_repeated_batch_lands_once(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    write_export(source / "s_20250101_x.csv", [row(i, "S") for i in range(4)])
    header = HEADER.strip().split(",")
    for attempt in ("first", "again"):  # a lost state folder repeats the batch under the same number
        land_and_wait(spark, str(source), target, str(tmp_path / attempt), header)
    assert spark.read.parquet(target).count() == 4


def test_shared_folder(spark):
    from types import SimpleNamespace as Fake

    from ledgerloom.storage import broadcast_if_small, shared_folder

    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    bare = Fake(get=lambda key, default: default)
    local = Fake(conf=bare, sparkContext=Fake(master="local[2]", applicationId="app"))
    assert shared_folder(local) == shared_folder(local)
    with pytest.raises(RuntimeError):
        shared_folder(Fake(conf=bare, sparkContext=Fake(master="yarn", applicationId="app")))
    df = spark.range(10)
    assert broadcast_if_small(df, 9) is df
    assert broadcast_if_small(df, 10) is not df


def test_period_fallback_fills_only_missing_months(spark):
    df = spark.createDataFrame([("a_20250301_b", None), ("a_20250301_b", "2024-01")], "source_file string, ym string")
    assert sorted(r.ym for r in cleaning.apply_period_fallback(df).collect()) == ["2024-01", "2025-03"]
