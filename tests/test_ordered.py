import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import hierarchy
from ledgerloom.operators.ordered import number_rows, previous_value

SCHEMA = "source_file string, row_no long, order_no string, customer_name string, total_amount decimal(18,2), product_code string"


def random_rows(seed, files=3, size=400, orders=40):
    """Sparse rows with orphans, repeated orders, blank headers and lines with own values."""
    rng = random.Random(seed)
    out = []
    for f in range(files):
        for n in range(size):
            header = n > 5 and rng.random() < 0.2
            order = f"S{rng.randrange(orders)}" if header else None
            customer = f"c{n}" if rng.random() < (0.6 if header else 0.08) else None
            amount = rng.randrange(1000) if header and rng.random() < 0.9 else None
            product = f"p{rng.randrange(9)}" if rng.random() < 0.9 else None
            out.append((f"f{f}", n * 3 + 1, order, customer, amount, product))
    rng.shuffle(out)
    return out


def model_fill(rows, by_order):
    """Row-by-row reading of the rules, as plain Python."""
    out = {}
    file = None
    held = {}
    for f, n, order, customer, amount, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        if f != file:
            file, current, held = f, None, {}
        if order is not None:
            current = order if by_order else n
        state = held.setdefault(current, [None, None, None])
        for i, v in enumerate((order, customer, amount)):
            if v is not None:
                state[i] = v
        known = current is not None or not by_order
        out[(f, n)] = tuple(state) if known else (None, None, None)
    return out


def frame(spark, rows):
    typed = [(*r[:4], None if r[4] is None else Decimal(r[4]), r[5]) for r in rows]
    return spark.createDataFrame(typed, SCHEMA)


@pytest.mark.parametrize("bucket", [1, 7, 97, 1 << 18])
@pytest.mark.parametrize("by_order", [False, True])
def test_fill_matches_model(spark, bucket, by_order):
    rows = random_rows(bucket)
    fill = hierarchy.fill_by_order_id if by_order else hierarchy.fill_order_info
    got = fill(frame(spark, rows), bucket_rows=bucket).collect()
    assert {(r.source_file, r.row_no): (r.order_no, r.customer_name, r.total_amount) for r in got} == model_fill(rows, by_order)
    assert len(got) == len(rows)


@pytest.mark.parametrize("n", [1, 4, 13])
def test_fill_does_not_depend_on_layout(spark, partitions, n):
    partitions(n)
    rows = random_rows(5)
    got = hierarchy.fill_by_order_id(frame(spark, rows).repartition(n), bucket_rows=50).collect()
    assert {(r.source_file, r.row_no): (r.order_no, r.customer_name, r.total_amount) for r in got} == model_fill(rows, True)


def test_fill_by_order_without_repeats(spark):
    rows = [(f, n, o and o + f, c, a, p) for f, n, o, c, a, p in random_rows(9, size=120)]
    seen = {}
    unique = []
    for f, n, o, c, a, p in sorted(rows, key=lambda r: (r[0], r[1])):
        if o is not None:
            seen[o] = seen.get(o, 0) + 1
            o = f"{o}-{seen[o]}"
        unique.append((f, n, o, c, a, p))
    assert hierarchy.repeated_orders(frame(spark, unique)).isEmpty()
    got = hierarchy.fill_by_order_id(frame(spark, unique), bucket_rows=16).collect()
    assert {(r.source_file, r.row_no): (r.order_no, r.customer_name, r.total_amount) for r in got} == model_fill(unique, True)


@pytest.mark.parametrize("by_order", [False, True])
def test_fill_with_one_order_holding_most_rows(spark, by_order):
    rows = random_rows(4, files=2, size=60)
    start = max(r[1] for r in rows) + 1
    rows += [("f0", start, "HOT", "first", 7, "p"), ("f0", start + 2500, "HOT", None, None, "p")]
    rows += [("f0", start + i, None, "own" if i == 900 else None, None, "p") for i in range(1, 2500)]
    rows += [("f0", start + 2500 + i, None, None, None, "p") for i in range(1, 500)]
    fill = hierarchy.fill_by_order_id if by_order else hierarchy.fill_order_info
    got = fill(frame(spark, rows), bucket_rows=100).collect()
    assert {(r.source_file, r.row_no): (r.order_no, r.customer_name, r.total_amount) for r in got} == model_fill(rows, by_order)


def test_fill_without_order_number(spark):
    df = spark.createDataFrame(
        [("f", 1, None), ("f", 2, "a"), ("f", 3, None), ("g", 1, None)],
        "source_file string, row_no long, customer_name string",
    )
    got = hierarchy.fill_order_info(df, bucket_rows=2).orderBy("source_file", "row_no").collect()
    assert [r.customer_name for r in got] == [None, "a", "a", None]


@pytest.mark.parametrize("bucket", [1, 10, 1 << 18])
def test_parents_and_profile(spark, bucket):
    rows = random_rows(3)
    df = frame(spark, rows)
    parent, above, expected = {}, {}, [0, 0, 0, 0]
    file = None
    for f, n, order, *_ in sorted(rows, key=lambda r: (r[0], r[1])):
        if f != file:
            file, head, before = f, None, None
        header = order is not None
        head = n if header else head
        parent[(f, n)] = head
        above[(f, n)] = before
        expected[0 if header else 1] += 1
        expected[2] += bool(header and before)
        expected[3] += bool(not header and before is False)
        before = header
    got = hierarchy.assign_parent(df, bucket_rows=bucket)
    assert {(r.source_file, r.row_no): r.parent_row_no for r in got.collect()} == parent
    orphans = sum(v is None for v in parent.values())
    coverage = hierarchy.parent_coverage(got).first()
    assert coverage.orphan_lines == orphans
    assert coverage.assigned_lines == expected[1] - orphans
    marked = previous_value(hierarchy.mark_headers(df), "is_header", "above", bucket_rows=bucket)
    assert {(r.source_file, r.row_no): r.above for r in marked.collect()} == above
    assert list(hierarchy.hierarchy_profile(df, bucket_rows=bucket).first()) == expected


@pytest.mark.parametrize("n", [1, 4, 13])
def test_number_rows(spark, partitions, n):
    partitions(n)
    rng = random.Random(n)
    rows = [(rng.choice("aaab"), rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(7)
    ranked = number_rows(df, [F.desc("v"), F.asc("i")])
    want = sorted(rows, key=lambda r: (-r[1], r[2]))
    assert [tuple(r)[:3] for r in ranked.orderBy("rank").collect()] == want
    assert sorted(r.rank for r in ranked.collect()) == list(range(1, 2001))
    per_key = number_rows(df, [F.desc("v"), F.asc("i")], ["k"], "nth").collect()
    for key in "ab":
        got = [(r.v, r.i) for r in sorted((r for r in per_key if r.k == key), key=lambda r: r.nth)]
        assert got == [(v, i) for k, v, i in want if k == key]
        assert sorted(r.nth for r in per_key if r.k == key) == list(range(1, len(got) + 1))


def test_number_rows_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr("ledgerloom.storage.broadcast_if_small.__defaults__", (0,))
    df = spark.range(500).select((F.col("id") % 5).alias("k"), "id")
    got = number_rows(df, [F.asc("id")], ["k"], "nth")
    assert got.filter("nth != id div 5 + 1").count() == 0
    assert got.count() == 500


def test_number_no_rows(spark):
    assert number_rows(spark.range(0), [F.asc("id")]).collect() == []


def test_first_per_order(spark):
    df = spark.createDataFrame(
        [("f2", 1, "A", 5), ("f1", 9, "A", 7), ("f1", 3, "B", 1), ("f1", 4, "B", 2), ("f1", 5, None, 3)],
        "source_file string, row_no long, order_no string, total_amount int",
    )
    assert {(r.order_no, r.total_amount) for r in hierarchy.order_headers(df).collect()} == {("A", 7), ("B", 1)}


def split_frame(spark):
    return spark.createDataFrame(
        [("f", 1, None, "p0", 1), ("f", 2, "A", "p1", 2), ("f", 3, None, "p2", 3), ("f", 4, "B", None, None),
         ("f", 5, "A", "p3", 4)],
        "source_file string, row_no long, order_no string, product_code string, quantity int",
    )


def test_split_levels(spark):
    orders, lines = hierarchy.split_levels(split_frame(spark))
    assert sorted((r.order_no, r.row_no) for r in orders.collect()) == [("A", 2), ("B", 4)]
    assert sorted(r.product_code for r in lines.collect()) == ["p0", "p1", "p2", "p3"]
    _, dropped = hierarchy.split_levels(split_frame(spark), header_products="drop")
    assert sorted(r.product_code for r in dropped.collect()) == ["p0", "p2"]


def test_split_levels_of_filled_table(spark):
    rows = [("f", 1, "A", "p1"), ("f", 2, "A", "p2"), ("f", 3, "B", "p3")]
    filled = spark.createDataFrame(rows, "source_file string, row_no long, order_no string, product_code string")
    assert hierarchy.split_rule(filled).first().rule == "first_row"
    orders, lines = hierarchy.split_levels(filled, "first_row", "drop")
    assert sorted(r.row_no for r in orders.collect()) == [1, 3]
    assert [r.product_code for r in lines.collect()] == ["p2"]


def test_split_rule_by_product_column(spark):
    rows = [("f", i, f"S{i}", None if i % 2 else f"p{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "source_file string, row_no long, order_no string, product_code string")
    assert hierarchy.split_rule(df).first().rule == "product_code"
    orders, lines = hierarchy.split_levels(df, "product_code", "drop")
    assert (orders.count(), lines.count()) == (10, 10)
    assert hierarchy.split_rule(split_frame(spark)).first().rule == "header"


def test_samples(spark):
    got = hierarchy.hierarchy_samples(split_frame(spark), 1).collect()
    assert [r.row_no for r in got] == [2, 1]
