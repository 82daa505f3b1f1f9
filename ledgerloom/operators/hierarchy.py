"""Header and line rows of the sparse sales layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators.ordered import BUCKET_ROWS, forward_fill, previous_value
from ledgerloom.schema import LINE_COLUMNS, ORDER_COLUMNS, PERIOD, ROW_NO, SOURCE_FILE, present
from ledgerloom.storage import broadcast_if_small, materialize

_CALENDAR = ("year", "month", "ym")
_SPLIT_COLUMNS = ("product_code", "product_name", "quantity", "unit_price", "subtotal")


def mark_headers(df: DataFrame) -> DataFrame:
    """A row is an order header exactly when it carries an order number."""
    return df.withColumn("is_header", F.col("order_no").isNotNull())


def fill_order_info(
    df: DataFrame, columns: Sequence[str] | None = None, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Give every row the order values of the header above it, inside its file.

    Values never cross a header or a file; rows before the first header only see each
    other.  Name the ``columns`` you need: the others then never enter the shuffle.
    """
    columns = present(df, ORDER_COLUMNS) if columns is None else list(columns)
    reset = F.col("order_no").isNotNull() if "order_no" in df.columns else None
    return forward_fill(df, columns, reset=reset, bucket_rows=bucket_rows)


def fill_by_order_id(
    df: DataFrame, columns: Sequence[str] | None = None, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """As C2, but rows of the same order number in a file share their values.

    A second header of the same order inherits what it leaves blank.  Rows before the first header belong to no order and
    get nulls.  What a header inherits is found on the rows that bring values of their own alone (headers, few lines);
    with it the headers are completed, and one fill from header to header does all rows.
    """
    columns = present(df, ORDER_COLUMNS) if columns is None else list(columns)
    header = F.col("order_no").isNotNull()
    rows = df.count()
    inherited = _inherited_by_headers(df, columns, bucket_rows, rows)
    headers = df.filter(header).join(inherited, [SOURCE_FILE, ROW_NO], "left").select(*[
        F.coalesce(F.col(c), F.col(f"_earlier_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns
    ])
    filled = forward_fill(
        headers.unionByName(df.filter(~header)), columns, reset=header, reset_position="_head", bucket_rows=bucket_rows, rows=rows,
    )
    return filled.select(*[
        F.when(F.col("_head").isNotNull(), F.col(c)).alias(c) if c in columns else F.col(c)
        for c in df.columns
    ])


def _inherited_by_headers(df: DataFrame, columns: Sequence[str], bucket_rows: int, rows: int) -> DataFrame:
    """Per header of a repeated order (file, row number) the last values of that order's runs above it.

    A run is a header with the rows up to the next header.  Only rows with a value of their own can be the last to bring
    one; a fill over those gives each run's last values, and a fill over the runs of each order what the next inherits.
    Only files in which an order number is repeated take part.  Written once: it is small, and the steps of the fill over
    all rows read it several times.
    """
    valued = F.col("order_no").isNotNull()
    for c in columns:
        valued = valued | F.col(c).isNotNull()
    several = materialize(repeated_orders(df).select(SOURCE_FILE, F.col("order_no").alias("_order")), "repeated")
    files = broadcast_if_small(several.select(SOURCE_FILE).distinct())
    carried = forward_fill(
        df.filter(valued).join(files, SOURCE_FILE, "left_semi").select(SOURCE_FILE, ROW_NO, *dict.fromkeys(["order_no", *columns])).withColumn("_order", F.col("order_no")),
        [*columns, "_order"], reset=F.col("order_no").isNotNull(), reset_position="_head", bucket_rows=bucket_rows,
        rows=rows,
    )
    keys = [SOURCE_FILE, "_order"]
    last = F.max(F.struct(ROW_NO, *columns)).alias("_last")
    ends = (
        carried.filter("_order is not null").groupBy(*keys, "_head").agg(last)
        .select(*keys, "_head", *[F.col("_last")[c].alias(c) for c in columns])
    )
    above = forward_fill(
        materialize(ends.join(several, keys, "left_semi"), "runs"), columns, keys=keys, order_by="_head", bucket_rows=bucket_rows, only_above=True,
        rows=rows,
    )
    given = above.select(SOURCE_FILE, F.col("_head").alias(ROW_NO), *[F.col(c).alias(f"_earlier_{c}") for c in columns])
    return materialize(given, "inherited")


def repeated_orders(df: DataFrame) -> DataFrame:
    """Order numbers with more than one header in the same file."""
    headers = df.filter(F.col("order_no").isNotNull())
    return headers.groupBy(SOURCE_FILE, "order_no").count().filter("count > 1")


def first_per_order(df: DataFrame) -> DataFrame:
    """The first row of every order number; rows without one count as one order.

    Spark keeps the best row per key on the map side too, so an order number repeated
    over a large share of the table does not gather in one task.
    """
    first = W.partitionBy("order_no").orderBy(SOURCE_FILE, ROW_NO)
    return df.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")


def order_headers(df: DataFrame) -> DataFrame:
    """Deduplicated orders straight from the header rows: no fill, no window over files."""
    return first_per_order(df.filter(F.col("order_no").isNotNull()))


def _split_columns(df: DataFrame, unfilled: DataFrame | None) -> list[str]:
    """Product columns that may tell orders from lines: the first one filled in only some rows, once it is known."""
    checked = present(df, _SPLIT_COLUMNS)
    if unfilled is None or not checked:
        return checked
    found = unfilled.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in checked]).first()
    return [c for c in checked if 1 <= found[c] < found["rows"]][:1]


def split_rule(df: DataFrame, unfilled: DataFrame | None = None) -> DataFrame:
    """C4: how a table without ``is_header`` tells orders from lines, as one row.

    ``header`` when only some rows have an order number; otherwise the first product
    column filled in only some rows, provided the number of orders is within 10 % of
    the rows of the order rows seen; otherwise ``first_row`` of every order.

    ``unfilled`` is the same rows before a fill that left their product columns as they are: these are counted there when
    this is called, so that they need not follow the order numbers through the fill.
    """
    return _split_rule(df, _split_columns(df, unfilled))


def _split_rule(df: DataFrame, checked: Sequence[str]) -> DataFrame:
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("order_no").alias("order_rows"),
        F.count_distinct("order_no").alias("orders"),
        *[F.count(c).alias(f"_{c}") for c in checked],
    )
    close = F.abs(F.col("orders") - F.col("order_rows")) < F.col("rows") * 0.1
    by_column = F.coalesce(
        *[F.when(F.col(f"_{c}").between(1, F.col("rows") - 1), F.lit(c)) for c in checked],
        F.lit(None).cast("string"),
    )
    rule = (
        F.when(F.col("order_rows").between(1, F.col("rows") - 1), F.lit("header"))
        .when(close & by_column.isNotNull(), by_column)
        .otherwise(F.lit("first_row"))
    )
    return facts.select("rows", "order_rows", "orders", rule.alias("rule"))


def split_levels(
    df: DataFrame, rule: str | None = None, header_products: str = "keep", unfilled: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """C4: orders table and lines table.

    ``rule`` is one of the values of :func:`split_rule`, or ``auto``: the table's own rule is then a value inside the plan, and
    no job runs before a table is read (but those of ``unfilled``).  Without a rule the header mark of C1 decides.  With ``header_products='keep'``
    every row that carries a product is a line, also a header row; ``'drop'`` takes non-header rows only.  ``unfilled`` as
    in :func:`split_rule`.
    """
    if rule == "auto":
        marked = _mark_by_own_rule(df, unfilled)
    elif "is_header" in df.columns and rule is None:
        marked = df
    elif rule in (None, "header"):
        marked = mark_headers(df)
    elif rule == "first_row":
        marked = _mark_first_rows(df)
    else:
        marked = df.withColumn("is_header", F.col(rule).isNull())
    calendar = present(df, _CALENDAR)
    position = present(df, (SOURCE_FILE, ROW_NO, PERIOD))
    orders = first_per_order(
        marked.filter("is_header").select(*position, *present(df, ORDER_COLUMNS), *calendar)
    )
    is_line = F.col("product_code").isNotNull() if header_products == "keep" else ~F.col("is_header")
    context = [c for c in ("order_no", "order_date", "customer_name") if c in df.columns]
    lines = marked.filter(is_line).select(
        *position, *context, *[c for c in present(df, LINE_COLUMNS) if c not in context], *calendar
    )
    return orders, lines


def _mark_by_own_rule(df: DataFrame, unfilled: DataFrame | None = None) -> DataFrame:
    """Header mark after the rule that :func:`split_rule` finds, without knowing it while the plan is built."""
    checked = _split_columns(df, unfilled)
    rule = _split_rule(df, checked).select("rule").scalar()
    by_column = F.lit(False)
    for c in checked:
        by_column = by_column | ((rule == c) & F.col(c).isNull())
    marked = _mark_first_rows(df.drop("is_header"))
    own = F.when(rule == "header", F.col("order_no").isNotNull()).when(rule == "first_row", F.col("is_header"))
    return marked.withColumn("is_header", F.coalesce(own, by_column))


def _mark_first_rows(df: DataFrame) -> DataFrame:
    """Header mark on the first row of every order number, by joining positions back."""
    firsts = (
        first_per_order(df.select(SOURCE_FILE, ROW_NO, "order_no"))
        .select(SOURCE_FILE, ROW_NO, F.lit(True).alias("_is_first"))
    )
    return (
        df.join(firsts, [SOURCE_FILE, ROW_NO], "left")
        .withColumn("is_header", F.coalesce("_is_first", F.lit(False)))
        .drop("_is_first")
    )


def assign_parent(df: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Row number of the header each row belongs to, null before the first header."""
    return forward_fill(
        df, [], reset=F.col("order_no").isNotNull(), reset_position="parent_row_no",
        bucket_rows=bucket_rows,
    )


def parent_coverage(assigned: DataFrame) -> DataFrame:
    """Lines with and without a header above them."""
    is_line = F.col("order_no").isNull()
    return assigned.agg(
        F.count_if(is_line & F.col("parent_row_no").isNotNull()).alias("assigned_lines"),
        F.count_if(is_line & F.col("parent_row_no").isNull()).alias("orphan_lines"),
    )


def hierarchy_profile(df: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Header and line rows, and how often two of a kind follow each other in a file."""
    marked = mark_headers(df).select(SOURCE_FILE, ROW_NO, "is_header")
    followed = previous_value(marked, "is_header", "_above", bucket_rows=bucket_rows)
    header, above = F.col("is_header"), F.col("_above")
    return followed.agg(
        F.count_if(header).alias("header_rows"),
        F.count_if(~header).alias("line_rows"),
        F.count_if(header & above).alias("consecutive_headers"),
        F.count_if(~header & ~above).alias("consecutive_lines"),
    )


def hierarchy_samples(df: DataFrame, n: int = 2) -> DataFrame:
    """First header rows and first line rows, with the columns that show the layout."""
    shown = present(df, (
        "order_no", "customer_order_no", "order_date", "customer_name",
        "product_code", "product_name", "quantity", "unit_price",
    ))
    marked = mark_headers(df).select(SOURCE_FILE, ROW_NO, "is_header", *shown)
    headers = marked.filter("is_header").orderBy(SOURCE_FILE, ROW_NO).limit(n)
    lines = marked.filter("not is_header").orderBy(SOURCE_FILE, ROW_NO).limit(n)
    return headers.unionByName(lines)
