"""Data-quality figures: null counts, date parsing, value ranges, exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.dates import parse_sales_date
from ledgerloom.schema import DAMAGED, FIELDS, PERIOD, ROW_NO, SOURCE_FILE, SPARK_TYPES
from ledgerloom.storage import materialize


def quality_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows and null counts of the chosen columns, in one pass."""
    columns = df.columns if columns is None else list(columns)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns],
    )


def damaged_stats(landed: DataFrame) -> DataFrame:
    """Rows, and how many of them do not fit the header of their file (read with ``damaged="keep"``)."""
    # Spark refuses to read nothing but the damaged text from a file: one more column is looked at.
    beside = next(c for c in landed.columns if c not in (DAMAGED, SOURCE_FILE, ROW_NO, PERIOD))
    damaged = F.when(F.col(DAMAGED).isNotNull(), F.coalesce(F.col(f"`{beside}`").cast("string"), F.lit("")))
    return landed.agg(F.count(F.lit(1)).alias("rows"), F.count(damaged).alias("damaged"))


def overflow_stats(landed: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """Per column of a landed table the cells that are null, no number, and numbers too large for their type."""
    kinds = {f.name: SPARK_TYPES[f.kind] for f in FIELDS[kind]}
    stats = []
    for c in columns:
        text = F.replace(F.col(c), F.lit(","), F.lit(""))
        number, fits = text.try_cast("double").isNotNull(), text.try_cast(kinds[c].simpleString()).isNotNull()
        empty = F.col(c).isNull() | (F.trim(c) == "")
        stats += [
            F.count_if(empty).alias(f"{c}_empty"), F.count_if(~empty & ~number).alias(f"{c}_bad"),
            F.count_if(~empty & number & ~fits).alias(f"{c}_overflow"),
        ]
    return landed.agg(F.count(F.lit(1)).alias("rows"), *stats)


def date_parse_stats(landed: DataFrame, column: str = "order_date") -> DataFrame:
    """How many of the filled date cells could be parsed, and whether it is under half."""
    filled = F.col(column).isNotNull() & (F.trim(column) != "")
    parsed = parse_sales_date(F.col(column)).isNotNull()
    stats = landed.agg(
        F.count_if(filled).alias("dates"),
        F.count_if(filled & parsed).alias("parsed"),
    )
    share = F.try_divide(F.col("parsed").cast("double"), F.col("dates").cast("double"))
    return stats.withColumn("parsed_share", share).withColumn(
        "suspicious", F.coalesce(F.col("parsed_share") < 0.5, F.lit(False))
    )


def unparsed_dates(landed: DataFrame, column: str = "order_date", n: int = 5) -> DataFrame:
    """A few date cells that could not be parsed."""
    text = F.col(column)
    return landed.filter(
        text.isNotNull() & (F.trim(text) != "") & parse_sales_date(text).isNull()
    ).select(column).limit(n)


def stock_stats(inventory: DataFrame) -> DataFrame:
    """SKUs, SKUs in stock, and smallest, largest and mean stock."""
    qty = F.col("on_hand")
    return inventory.agg(
        F.count(F.lit(1)).alias("skus"),
        F.count_if(qty > 0).alias("in_stock"),
        F.min(qty).alias("min_stock"),
        F.max(qty).alias("max_stock"),
        F.try_divide(F.sum(qty).cast("double"), F.count(qty).cast("double")).alias("mean_stock"),
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t.startswith(("decimal", "int", "bigint", "double", "float"))]


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """Exact linear-interpolation quantiles, one row per column.

    Built-in exact percentiles hold every distinct value of a column in one task.  Here
    equal values are counted first, the (column, value) pairs are range-partitioned, and
    running counts tell which value covers each wanted rank.
    """
    values = (
        df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot([], list(columns), "column", "value")
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    stretches = materialize(
        values.repartitionByRange("column", "value").withColumn("_part", F.spark_partition_id()),
        "quantiles",
    )
    # One row per (column, stretch): columns x shuffle partitions at most.
    weights = stretches.groupBy("column", "_part").agg(F.sum("n").alias("_weight"))
    by_column = W.partitionBy("column")
    before = by_column.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = weights.select(
        "column",
        "_part",
        F.coalesce(F.sum("_weight").over(before), F.lit(0)).alias("_offset"),
        F.sum("_weight").over(by_column).alias("_total"),
    )
    inside = W.partitionBy("column", "_part").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    covered = (
        stretches.withColumn("_upto", F.sum("n").over(inside))
        .join(offsets, ["column", "_part"])
        .withColumns({
            "_last": F.col("_offset") + F.col("_upto") - 1,
            "_first": F.col("_offset") + F.col("_upto") - F.col("n"),
        })
    )
    picks = []
    for i, p in enumerate(probabilities):
        rank = (F.col("_total") - 1) * F.lit(float(p))
        for edge, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            hit = (F.col("_first") <= at) & (at <= F.col("_last"))
            picks.append(F.max(F.when(hit, F.col("value"))).alias(f"_{edge}{i}"))
    found = covered.groupBy("column").agg(F.max("_total").alias("_total"), *picks)

    def interpolated(i: int, p: float):
        rank = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return (lo + (hi - lo) * (rank - F.floor(rank))).alias(f"p{round(p * 100)}")

    return found.select("column", *[interpolated(i, p) for i, p in enumerate(probabilities)])


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum of the numeric columns."""
    columns = numeric_columns(df) if columns is None else list(columns)
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    # One pass over the table; its single row is then turned into one row per column.
    wide = numbers.agg(*[f(c).alias(f"{m}_{c}") for c in columns for m, f in measures.items()])
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{m}_{c}`").alias(m) for m in measures])
        for c in columns
    ]
    moments = wide.select(F.inline(F.array(*rows)))
    quartiles = exact_quantiles(df, columns, (0.25, 0.5, 0.75))
    return moments.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )
