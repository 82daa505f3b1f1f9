"""The derived export tables: what is moved and written for them grows with the orders' keys, not with copies of all lines."""

import glob
import os
import random
import re
import shutil
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom import storage
from ledgerloom.operators import ordered
from ledgerloom.plans import landing
from ledgerloom.schema import ROW_NO, SOURCE_FILE
from ledgerloom.sources import exports
from ledgerloom.storage import session_folder

SF = "/root/testdata/sf0.001"


@pytest.fixture
def fresh(tmp_path):
    """The tables under a path that no landing has seen."""
    folder = tmp_path / "sf"
    shutil.copytree(SF, folder)
    return str(folder)


def expected(spark, sf):
    """(file, row number, order on header rows) by a plain window over the joined lines."""
    joined = landing.base(spark, sf, "lineitem").join(landing.base(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey"))
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    found = joined.select(F.date_format("o_orderdate", "yyyyMM").alias("m"), *keys).collect()
    out, n, last = [], defaultdict(int), None
    for r in sorted(found, key=lambda r: tuple(r)):
        n[r.m] += 1
        header = (r.m, r.l_orderkey) != last
        last = (r.m, r.l_orderkey)
        out.append((f"sales_{r.m}01_end.csv", n[r.m], f"SO{r.l_orderkey}" if header else None, f"P{r.l_partkey}"))
    return sorted(out, key=str)


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_landed_rows_without_a_written_copy_of_the_lines(spark, fresh, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        known = set(glob.glob(f"{session_folder(spark)}/*"))
        got = landing.sales(spark, fresh).select(SOURCE_FILE, ROW_NO, "order_no", "product_code").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(tuple, got), key=str) == expected(spark, fresh)
    working = [f for f in set(glob.glob(f"{session_folder(spark)}/*")) - known if not os.path.basename(f).startswith("landing-")]
    orders = landing.base(spark, fresh, "orders").count()
    assert working and all(spark.read.parquet(f).count() <= orders for f in working)


def test_exports_written_without_the_landed_table_keep_row_order(spark, fresh):
    rows = exports.read_sales(spark, landing.export_folder(spark, fresh, "sales"))
    assert not os.path.exists(landing.table_folder(spark, fresh, "sales_text"))
    read = rows.select(SOURCE_FILE, ROW_NO, "order_no", "product_code").collect()
    seen, got = defaultdict(int), []
    for r in sorted(read, key=lambda r: (r.source_file, r.row_no)):
        seen[r.source_file] += 1
        got.append((r.source_file, seen[r.source_file], r.order_no, r.product_code))
    assert sorted(got, key=str) == expected(spark, fresh)


@pytest.mark.parametrize("limit", [200_000, 1])
def test_running_total_over_stretches(spark, monkeypatch, limit):
    small = ordered.broadcast_if_small
    monkeypatch.setattr(ordered, "broadcast_if_small", lambda df: small(df, limit))
    rng = random.Random(limit)
    rows = [(rng.choice("ab"), n * 7, rng.randrange(5)) for n in range(500)]
    model, total = {}, defaultdict(int)
    for k, n, v in rows:
        model[(k, n)] = total[k]
        total[k] += v
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "k string, n long, v long").repartition(6)
    got = ordered.running_total(df, "v", [F.col("n").asc()], ["k"])
    assert {(r.k, r.n): r.before for r in got.collect()} == model
    whole = ordered.running_total(df, "v", [F.col("n").asc()]).orderBy("n").collect()
    assert [r.before for r in whole] == [sum(v for _, _, v in rows[:i]) for i in range(len(rows))]


def test_lines_are_sorted_once_in_tasks_that_follow_their_number(spark, fresh, monkeypatch, capsys):
    """With a fixed number of shuffle partitions the sorts of all lines would outgrow a task's memory and spill."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(storage, "TASK_ROWS", 500, raising=False)
    look = getattr(landing, "hashed_lookup", None)
    monkeypatch.setattr(landing, "hashed_lookup", lambda df: look(df, 0), raising=False)
    try:
        landing._numbered_lines(spark, fresh).explain()
        plan = capsys.readouterr().out
        got = landing.sales(spark, fresh).select(SOURCE_FILE, ROW_NO, "order_no", "product_code").collect()
        rows = exports.read_sales(spark, landing.export_folder(spark, fresh, "sales")).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Sort [l_orderkey#") == 1 and "Sort [l_partkey#" not in plan
    tasks = -(-landing.base(spark, fresh, "lineitem").count() // 500)
    assert tasks > 4 and f", {tasks}), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, got), key=str) == expected(spark, fresh) and rows == len(got)


def test_number_of_tasks_and_kind_of_lookup(spark, capsys):
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert storage.tasks_for(spark, 0) == 1 and storage.tasks_for(spark, 10 * storage.LEAST_TASK_ROWS) == asked
    assert storage.tasks_for(spark, 100 * storage.TASK_ROWS + 1) == 101
    keys = spark.range(100)
    for limit, hashed in ((10, True), (100, False)):
        spark.range(1000).join(storage.hashed_lookup(keys, limit), "id").explain()
        assert ("ShuffledHashJoin" in capsys.readouterr().out) == hashed


def test_lookup_too_large_for_a_task_is_not_hashed(spark, monkeypatch, capsys):
    monkeypatch.setattr(storage, "TASK_ROWS", 20)
    spark.range(1000).join(storage.hashed_lookup(spark.range(100), 10), "id").explain()
    assert "ShuffledHashJoin" not in capsys.readouterr().out


def test_gathering_follows_the_lines_and_moves_subtotals_only(spark, fresh, monkeypatch, capsys):
    """The writer sorts what a gathering task holds; raw price and discount need not travel beyond their order."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(storage, "TASK_ROWS", 500)
    try:
        with monkeypatch.context() as unwritten:
            unwritten.setattr(landing, "_written", lambda spark, sf_dir, name, build, by=(): build())
            landing.sales(spark, fresh).explain()
            plan = capsys.readouterr().out
            assert not {"l_extendedprice", "disc"} & set(landing._numbered_lines(spark, fresh).columns)
        got = landing.sales_text(spark, fresh).select("product_code", "subtotal").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    tasks = -(-landing.base(spark, fresh, "lineitem").count() // 500)
    assert re.search(rf"hashpartitioning\(month_no#\d+, {tasks}\), REBALANCE_PARTITIONS_BY_COL", plan)
    plain = landing.base(spark, fresh, "lineitem").selectExpr(
        "concat('P', cast(l_partkey as string)) as product_code",
        "cast(cast(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))) as decimal(18,4)) as string) as s",
    ).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain))


def test_exports_of_landed_text_are_sorted_in_tasks_that_follow_its_rows(spark, fresh, monkeypatch):
    """Once the text is landed, exports come from it: its wide rows must not be dealt to a fixed number of tasks."""
    monkeypatch.setattr(storage, "TEXT_TASK_ROWS", 500, raising=False)
    text = landing.sales_text(spark, fresh)
    folder = landing.export_folder(spark, fresh, "sales")
    tasks = {os.path.basename(f)[:10] for f in glob.glob(f"{folder}/*/part-*")}
    assert len(tasks) > int(spark.conf.get("spark.sql.shuffle.partitions")) and len(tasks) >= text.count() // 500 - 1
    seen, got = defaultdict(int), []
    for r in exports.read_sales(spark, folder).orderBy(SOURCE_FILE, ROW_NO).collect():
        seen[r.source_file] += 1
        got.append((r.source_file, seen[r.source_file], r.order_no, r.product_code))
    assert sorted(got, key=str) == expected(spark, fresh)
