"""Twin exports: rows are dealt once, straight from the numbered lines, and numbered in tasks that follow their number."""

import glob
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_landing import expected, fresh  # noqa: F401

from ledgerloom import storage
from ledgerloom.operators.ordered import number_rows
from ledgerloom.plans import landing
from ledgerloom.plans.checks import QUERIES
from ledgerloom.sources import exports
from ledgerloom.storage import session_folder


@pytest.mark.parametrize("landed", [False, True])
def test_twin_exports_keep_every_row_in_its_place(spark, fresh, landed):  # noqa: F811
    if landed:
        landing.sales_text(spark, fresh)
    folder = landing.twin_exports(spark, fresh)
    assert os.path.exists(landing.table_folder(spark, fresh, "sales_text")) == landed
    files = glob.glob(f"{folder}/*/*/part-*")
    assert files and all(f.endswith(".csv.gz") for f in files)
    rows = exports.read_sales(spark, folder).select("source_file", "row_no", "order_no", "product_code").collect()
    seen, got = defaultdict(int), []
    for r in sorted(rows, key=lambda r: (r.source_file, r.row_no)):
        seen[r.source_file] += 1
        got.append((r.source_file, seen[r.source_file], r.order_no, r.product_code))
    want = [(f"a/{f}", n, o, p) for f, n, o, p in expected(spark, fresh)]
    want += [(f"b/{f}", n // 2, o, p) for f, n, o, p in expected(spark, fresh) if n % 2 == 0]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_numbering_moves_what_is_shown_and_follows_the_rows(spark, fresh, monkeypatch):  # noqa: F811
    monkeypatch.setattr(storage, "TASK_ROWS", 500)
    known = set(glob.glob(f"{session_folder(spark)}/place-*"))
    placed = QUERIES["a1_row_order"](spark, fresh)
    (written,) = set(glob.glob(f"{session_folder(spark)}/place-*")) - known
    stretches = spark.read.parquet(written)
    assert set(stretches.columns) == {*placed.columns, "row_no", "_part", "_at"} - {"place"}
    lines = landing.base(spark, fresh, "lineitem").count()
    assert stretches.select("_part").distinct().count() > lines // 500 > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_number_rows_in_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 100)
    df = spark.range(3000).select((F.col("id") % 7).alias("k"), "id").repartition(5)
    got = number_rows(df, [F.desc("id")], ["k"], "nth", rows=3000)
    counts = [(3000 - k + 6) // 7 for k in range(7)]
    assert all(r.nth == counts[r.k] - r.id // 7 for r in got.collect()) and got.count() == 3000
