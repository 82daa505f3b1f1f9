"""Months, fills and levels of large tables: narrow rows move, a product's months as one map, and wide rows come last."""

import glob
import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom import storage
from ledgerloom.operators import cleaning, hierarchy, inventory, products
from ledgerloom.storage import session_folder

SCHEMA = "product_code string, product_name string, ym string, quantity decimal(18,4), subtotal decimal(18,4)"


@pytest.fixture
def shuffled(spark):
    """Joins as of large tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def sales_rows(spark):
    """Rows of two exports, every fourth one a header, all with a product."""
    return spark.range(60).selectExpr(
        "concat('sales_20250', id % 2 + 1, '01_end.csv') as source_file", "id div 2 as row_no",
        "case when id div 2 % 4 = 0 then concat('S', id) end as order_no", "concat('P', id) as product_code",
        "cast(id as decimal(18,4)) as quantity", "cast(id as decimal(18,4)) as subtotal",
    )


def random_lines(seed, size=900):
    """Lines of 40 products, one of which holds half of them; some without code, name, month or amount."""
    rng = random.Random(seed)
    out = []
    for _ in range(size):
        p = 0 if rng.random() < 0.5 else rng.randrange(40)
        code = None if rng.random() < 0.03 else f"P{p}"
        name = None if rng.random() < 0.03 else f"n{p % 7}"
        ym = None if rng.random() < 0.1 else f"20{rng.randrange(20, 24)}-{rng.randrange(1, 13):02d}"
        amount = None if rng.random() < 0.1 else Decimal(rng.randrange(-50, 900)) / 4
        out.append((code, name, ym, Decimal(rng.randrange(9)), amount))
    return out


def model(rows):
    totals, cells = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for code, name, ym, quantity, amount in rows:
        if code is None or name is None:
            continue
        for held in (totals[(code, name)], cells[(code, name, ym)]):
            held[0] += quantity
            held[1] += amount or 0
    return totals, cells


@pytest.mark.parametrize("most", [60, storage.TASK_ROWS])
def test_ranked_products_with_all_months(spark, monkeypatch, shuffled, most):
    monkeypatch.setattr(storage, "TASK_ROWS", most)
    monkeypatch.setattr(products, "TASK_ROWS", most, raising=False)
    rows = random_lines(most)
    lines = spark.createDataFrame(rows, SCHEMA).repartition(3)
    totals, cells = model(rows)
    months = sorted({ym for _, _, ym in cells if ym})
    ranked = products.rank_sold_products(lines)
    assert ranked.columns == ["product_code", "product_name", "total_quantity", "total_amount", *products.period_columns(months), "rank"]
    got = ranked.orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(totals) + 1))
    want = sorted(totals, key=lambda k: (-totals[k][1], *k))
    assert [(r.product_code, r.product_name, r.total_quantity, r.total_amount) for r in got] == [(*k, *totals[k]) for k in want]
    joined = products.attach_months(products.rank_sold_products(lines, ()), products.pivot_months(lines))
    gathered = storage.materialize(products.gather_months(lines), "months")
    reused = products.attach_months(products.rank_sold_products(gathered, ()), products.pivot_months(gathered))
    named = products.pivot_months(lines, months[3:5] + ["1999-01"]).collect()
    for r in [*got, *joined.collect(), *reused.collect()]:
        k = (r.product_code, r.product_name)
        assert [r[c] for c in products.period_columns(months)] == [v for m in months for v in cells.get((*k, m), [0, 0])]
    assert joined.count() == reused.count() == len(named) == len(totals)
    for r in named:
        k = (r.product_code, r.product_name)
        assert [r[c] for c in products.period_columns(["1999-01", months[3]])] == [0, 0, *cells.get((*k, months[3]), [0, 0])]


def test_months_move_as_one_map(spark, shuffled, capsys):
    """Two columns per month, most of them 0, must be in no shuffle and no written table."""
    lines = spark.createDataFrame(random_lines(1), SCHEMA)
    known = set(glob.glob(f"{session_folder(spark)}/*"))
    ranked = products.rank_sold_products(lines)
    pivot = products.pivot_months(lines)
    written = set(glob.glob(f"{session_folder(spark)}/*")) - known
    assert written and all(len(spark.read.parquet(f).columns) < 10 for f in written)
    products.attach_months(ranked.select("product_code", "product_name", "rank"), pivot).explain("formatted")
    plan = capsys.readouterr().out
    wide = [p for p in plan.split("\n\n") if "Exchange" in p.split("\n")[0] and "2021-05_amount" in p]
    assert not wide and "pivotfirst" not in plan and "SortMergeJoin" not in plan


def test_vendors_are_looked_up_before_the_months_become_columns(spark, shuffled, capsys):
    rows = random_lines(3)
    stock = spark.createDataFrame(
        [(i, f"P{i}", i * 2, None if i % 5 == 0 else f"v{i}") for i in range(30)],
        "row_no long, product_code string, on_hand long, vendor_short string",
    )
    lines = spark.createDataFrame(rows, SCHEMA)
    plain = inventory.add_vendor(products.rank_sold_products(lines), stock)
    looked = products.rank_sold_products(lines, lookup=lambda ranked: inventory.add_vendor(ranked, stock))
    assert looked.columns == plain.columns and sorted(map(str, looked.collect())) == sorted(map(str, plain.collect()))
    capsys.readouterr()
    looked.explain("formatted")
    plan = capsys.readouterr().out
    assert not [p for p in plan.split("\n\n") if "Exchange" in p.split("\n")[0] and "2021-05_amount" in p]


def test_skus_with_all_months(spark, shuffled):
    rows = random_lines(2)
    lines = spark.createDataFrame(rows, SCHEMA)
    stock = spark.createDataFrame(
        [(i, f"P{i}", f"n{i}", i, "v") for i in range(20, 60)],
        "row_no long, product_code string, product_name string, on_hand long, vendor_short string",
    )
    cells = defaultdict(lambda: [0, 0])
    for code, _, ym, quantity, amount in rows:
        cells[(code, ym)][0] += quantity
        cells[(code, ym)][1] += amount or 0
    months = sorted({ym for code, ym in cells if code and ym})
    known = set(glob.glob(f"{session_folder(spark)}/*"))
    ranked = inventory.all_sku_sales(stock, lines)
    written = set(glob.glob(f"{session_folder(spark)}/*")) - known
    assert written and all(len(spark.read.parquet(f).columns) < 12 for f in written)
    got = ranked.collect()
    assert sorted(r.product_code for r in got) == sorted(f"P{i}" for i in range(20, 60))
    for r in got:
        assert [r[c] for c in products.period_columns(months)] == [v for m in months for v in cells.get((r.product_code, m), [0, 0])]


@pytest.mark.parametrize("fill", [hierarchy.fill_order_info, hierarchy.fill_by_order_id])
def test_fill_in_tasks_that_follow_the_rows(spark, monkeypatch, capsys, fill):
    """With a fixed number of shuffle partitions the sorts of a fill would outgrow a task's memory and spill."""
    monkeypatch.setattr(storage, "TASK_ROWS", 100)
    df = spark.range(2000).selectExpr(
        "concat('f', id % 3) as source_file", "id as row_no", "case when id % 5 = 0 then concat('S', id) end as order_no",
        "case when id % 5 = 0 then id end as total_amount",
    )
    filled = fill(df, ["total_amount"], bucket_rows=50)
    filled.explain()
    assert ", 20), REPARTITION_BY_NUM" in capsys.readouterr().out
    last, want = {}, {}
    for i in range(2000):
        last[i % 3] = i if i % 5 == 0 else last.get(i % 3)
        want[i] = last[i % 3]
    assert {r.row_no: r.total_amount for r in filled.collect()} == want


def test_files_without_a_repeated_order_inherit_nothing(spark, monkeypatch):
    """Only rows of files in which an order number comes twice are filled to find what its headers inherit."""
    seen = []
    whole = hierarchy.forward_fill
    monkeypatch.setattr(hierarchy, "forward_fill", lambda df, *a, **k: (seen.append(df), whole(df, *a, **k))[1])
    df = spark.createDataFrame(
        [("f", 1, "A", 5), ("f", 2, None, None), ("g", 1, "B", 7), ("g", 2, "C", 8), ("g", 3, "B", None), ("g", 4, None, None)],
        "source_file string, row_no long, order_no string, total_amount long",
    )
    got = hierarchy.fill_by_order_id(df, ["total_amount"]).collect()
    assert {(r.source_file, r.row_no): r.total_amount for r in got} == {
        ("f", 1): 5, ("f", 2): 5, ("g", 1): 7, ("g", 2): 8, ("g", 3): 7, ("g", 4): 7}
    assert {r.source_file for r in seen[0].collect()} == {"g"}


def test_report_without_dates_needs_no_count_of_them(spark, sales_rows, capsys):
    """No column can give a month: that the switch to the file names is on need not be found by reading the table."""
    dated = cleaning.report_calendar(sales_rows, "order_date", None, "table")
    dated.explain()
    assert "ubquery" not in capsys.readouterr().out
    assert {(r.year, r.month, r.ym) for r in dated.collect()} == {(2025, 1, "2025-01"), (2025, 2, "2025-02")}
    assert cleaning.report_calendar(sales_rows.filter("false"), "order_date", None, "table").count() == 0


def test_split_by_own_rule_moves_no_product_columns(spark, sales_rows, shuffled, capsys):
    filled = hierarchy.fill_order_info(sales_rows, ["order_no"])
    plain = [t.select("source_file", "row_no", "order_no") for t in hierarchy.split_levels(filled, "auto", "drop")]
    found = [t.select("source_file", "row_no", "order_no") for t in hierarchy.split_levels(filled, "auto", "drop", unfilled=sales_rows)]
    assert [sorted(map(tuple, t.collect())) for t in found] == [sorted(map(tuple, t.collect())) for t in plain]
    assert hierarchy.split_rule(filled, sales_rows).first() == hierarchy.split_rule(filled).first()
    for t in found:
        t.explain("formatted")
    assert "subtotal" not in capsys.readouterr().out
    sparse = sales_rows.withColumn("quantity", F.when(F.col("row_no") % 2 == 0, F.col("quantity")))
    ordered = sparse.withColumn("order_no", F.concat("source_file", F.col("row_no").cast("string")))
    assert hierarchy.split_rule(ordered, sparse).first().rule == hierarchy.split_rule(ordered).first().rule == "quantity"
