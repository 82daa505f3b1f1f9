"""Row positions of part files and snapshot dates of names."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.names import snapshot_date_from_filename
from ledgerloom.operators.quality import damaged_stats
from ledgerloom.sources.exports import file_catalog, latest_export, preview, read_sales, stamp_position
from ledgerloom.streaming.incremental import land_and_wait, land_uploads, read_uploads


def _parts(spark, folder, names):
    import shutil

    folder.mkdir()
    for i, name in enumerate(names):
        out = str(folder.parent / f"one-{i}")
        spark.range(2).select((F.col("id") + 10 * i).alias("v")).coalesce(1).write.csv(out, header=True)
        made = next((folder.parent / f"one-{i}").glob("part-*.csv"))
        shutil.copy(made, folder / name)
    read = spark.read.option("header", True).csv(str(folder))
    return stamp_position(spark, read, "csv")


def test_large_part_numbers_and_pieces_keep_their_order(spark, tmp_path):
    names = ["part-00000-x.c000.csv", "part-00000-x.c001.csv", "part-65536-x.c000.csv", "part-131072-x.c000.csv"]
    rows = _parts(spark, tmp_path / "export", names).orderBy("row_no").collect()
    assert [r["v"] for r in rows] == ["0", "1", "10", "11", "20", "21", "30", "31"]
    assert len({r["row_no"] for r in rows}) == 8


def test_part_numbers_of_any_size_keep_their_order(spark, tmp_path):
    names = ["part-00002-x.csv", "part-1048576-x.csv", "part-99999999-x.csv"]
    rows = _parts(spark, tmp_path / "export", names).orderBy("row_no").collect()
    assert [r["v"] for r in rows] == ["0", "1", "10", "11", "20", "21"]


def _write(folder, name, rows, age):
    import os
    import time

    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("產品代號,數量\n" + "".join(f"{r},1\n" for r in rows), encoding="utf-8")
    os.utime(folder / name, (time.time() - age,) * 2)


def test_same_names_in_two_folders_are_two_exports(spark, tmp_path):
    _write(tmp_path / "in" / "a", "x_20250101_e.csv", ["A0", "A1"], 5)
    _write(tmp_path / "in" / "b", "x_20250101_e.csv", ["B0", "B1"], 5)
    rows = read_sales(spark, str(tmp_path / "in")).orderBy("source_file", "row_no").collect()
    assert [(r["source_file"], r["product_code"], r["period"]) for r in rows] == [
        ("a/x_20250101_e.csv", "A0", "2025-01"), ("a/x_20250101_e.csv", "A1", "2025-01"),
        ("b/x_20250101_e.csv", "B0", "2025-01"), ("b/x_20250101_e.csv", "B1", "2025-01"),
    ]
    # Roots given one by one keep the bare name.
    one = read_sales(spark, [str(tmp_path / "in" / "a" / "x_20250101_e.csv")])
    assert {r["source_file"] for r in one.collect()} == {"x_20250101_e.csv"}


def test_a_folder_appended_to_keeps_each_write_together(spark, tmp_path):
    folder = tmp_path / "in" / "x_20250101_e.csv"
    for part, rows in ((0, ["A0", "A1"]), (1, ["A2"])):
        _write(folder, f"part-0000{part}-ffff-c000.csv", rows, 50)
    for part, rows in ((0, ["B0"]), (1, ["B1", "B2"])):
        _write(folder, f"part-0000{part}-aaaa-c000.csv", rows, 5)
    rows = read_sales(spark, str(tmp_path / "in")).orderBy("row_no").collect()
    assert [r["product_code"] for r in rows] == ["A0", "A1", "A2", "B0", "B1", "B2"]
    assert {r["source_file"] for r in rows} == {"x_20250101_e.csv"} and len({r["row_no"] for r in rows}) == 6
    catalog = file_catalog(spark, str(tmp_path / "in")).collect()
    assert [(r["name"], r["files"]) for r in catalog] == [("x_20250101_e.csv", 4)]


def test_periods_open_their_files_only(spark, tmp_path):
    for month in ("01", "02", "03"):
        _write(tmp_path / "in", f"x_2025{month}01_[e].csv", [f"M{month}"], 5)
    got = read_sales(spark, str(tmp_path / "in"), periods=["2025-01", "2025-03"])
    scan = re.search(r"FileScan csv.*InMemoryFileIndex\((\d+) paths\)", got._jdf.queryExecution().executedPlan().toString())
    assert scan and scan.group(1) == "2"
    assert sorted(r["product_code"] for r in got.collect()) == ["M01", "M03"]
    assert [r["product_code"] for r in read_sales(spark, str(tmp_path / "in"), periods="latest").collect()] == ["M03"]
    with pytest.raises(ValueError, match="2024-01"):
        read_sales(spark, str(tmp_path / "in"), periods=["2025-01", "2024-01"])


BROKEN = '產品代號,產品名稱,數量\nP0,a,1\nP1,"two\nlines",2\nP2,short\nP3,b,3\nP4,c,4,more\n'


def test_damaged_rows_stop_a_read_or_are_kept(spark, tmp_path):
    (tmp_path / "x_20250101_e.csv").write_text(BROKEN, encoding="utf-8")
    path = str(tmp_path / "x_20250101_e.csv")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_sales(spark, path).select("product_code").collect()
    kept = read_sales(spark, path, damaged="keep")
    rows = kept.orderBy("row_no").collect()
    assert [r["product_code"] for r in rows if r["damaged_text"] is None] == ["P0", "P3"]
    assert tuple(damaged_stats(kept).first()) == (6, 4)
    whole = read_sales(spark, path, damaged="keep", multi_line=True).orderBy("row_no").collect()
    assert [(r["product_code"], r["product_name"]) for r in whole if r["damaged_text"] is None] == [
        ("P0", "a"), ("P1", "two\nlines"), ("P3", "b")
    ]
    with pytest.raises(ValueError):
        read_sales(spark, path, damaged="drop")


def test_damaged_rows_in_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x_20250101_e.csv").write_text(BROKEN, encoding="utf-8")
    header = ["產品代號", "產品名稱", "數量"]
    with pytest.raises(Exception, match="(?i)malformed"):
        land_and_wait(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), header)
    land_and_wait(spark, str(tmp_path / "in"), str(tmp_path / "kept"), str(tmp_path / "state2"), header, damaged="keep")
    assert tuple(damaged_stats(spark.read.parquet(str(tmp_path / "kept"))).first()) == (6, 4)


def test_replaced_uploads_show_their_new_rows_once(spark, tmp_path, monkeypatch):
    source, target, ledger = (str(tmp_path / n) for n in ("in", "out", "ledger"))

    def rows():
        return sorted(r["product_code"] for r in read_uploads(spark, target, ledger).collect())

    _write(tmp_path / "in", "x_20250101_e.csv", ["A0", "A1"], 50)
    _write(tmp_path / "in", "y_20250201_e.csv", ["B0"], 50)
    assert land_uploads(spark, source, target, ledger) == 2 and rows() == ["A0", "A1", "B0"]
    assert land_uploads(spark, source, target, ledger) == 0 and rows() == ["A0", "A1", "B0"]
    _write(tmp_path / "in", "x_20250101_e.csv", ["A7"], 20)
    # The run dies after its rows are written and before the ledger is.
    from ledgerloom.streaming import incremental

    def dies(*_):
        raise RuntimeError("killed")

    real = incremental.DataFrame.coalesce
    with monkeypatch.context() as broken:
        broken.setattr(type(spark.range(1)), "coalesce", dies)
        with pytest.raises(RuntimeError):
            land_uploads(spark, source, target, ledger)
    assert "A7" not in rows() and real is incremental.DataFrame.coalesce
    assert land_uploads(spark, source, target, ledger) == 1 and rows() == ["A7", "B0"]
    # An upload that is now empty shows nothing.
    _write(tmp_path / "in", "y_20250201_e.csv", [], 10)
    assert land_uploads(spark, source, target, ledger) == 1 and rows() == ["A7"]


def test_an_empty_catalogue_has_no_newest_export(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "source_file string, v int")
    with pytest.raises(Exception, match="no export"):
        latest_export(rows, file_catalog(spark, str(tmp_path))).collect()


def test_snapshot_date_needs_digits(spark):
    rows = spark.createDataFrame([("BC_x_20250331.csv",), ("BC_stock.csv",), ("BC_x_20250331.xlsx",)], "f string")
    got = [r[0] for r in rows.select(snapshot_date_from_filename(F.col("f"))).collect()]
    assert got == ["2025/03/31", None, "2025/03/31"]


def test_preview_is_in_file_order(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2)], "source_file string, row_no long")
    assert [r["row_no"] for r in preview(rows, 2).collect()] == [1, 2]
