"""Operators over row order that never put one whole file, order or table in one task.

The rows of an export are ordered by ``row_no`` inside their ``source_file``.  A window
per file would be one task per file, however large the file is.  Instead rows are cut
into buckets of consecutive row numbers:

* an aggregation (with map-side combine) reduces a bucket to the few values that later
  buckets may need: its last reset and, per column, its last value;
* a running maximum over that small table gives each bucket what it inherits;
* a window per (file, bucket) does the rest, and the inherited values join in on the
  partitioning that window needs anyway.

With 262,144 rows per bucket, 2e11 rows shrink to under a million bucket rows.  The
number of tasks of that window follows the number of rows, which are counted first: a
fixed number lets its sorts outgrow a task's memory and spill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.schema import ROW_NO, SOURCE_FILE
from ledgerloom.storage import broadcast_if_small, materialize, tasks_for

BUCKET_ROWS = 1 << 18

_BUCKET = "_bucket"
_RESET = "_reset"
_START = "_start"
_HELD = "_held_"
_SEEN = "_seen_"


def _with_bucket(df: DataFrame, order_by: str, bucket_rows: int) -> DataFrame:
    return df.withColumn(_BUCKET, F.floor(F.col(order_by) / F.lit(bucket_rows)).cast("bigint"))


def _dealt(bucketed: DataFrame, keys: Sequence[str], rows: int | None) -> DataFrame:
    """Bucketed rows in as many tasks as keep their sort in memory; the session's own number where that is enough.

    Only then are the rows dealt by name: a shuffle that a window asks for itself goes when nobody reads its result.
    """
    spark = bucketed.sparkSession
    n = tasks_for(spark, bucketed.count() if rows is None else rows)
    enough = n <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    return bucketed if enough else bucketed.repartition(n, *keys, _BUCKET)


def _at(order_by: str, column: str) -> Column:
    """(position, value) of a non-null cell; the maximum is the latest one."""
    return F.when(
        F.col(column).isNotNull(),
        F.struct(F.col(order_by).alias("pos"), F.col(column).alias("value")),
    )


def _inherited(
    bucketed: DataFrame, keys: Sequence[str], order_by: str, columns: Sequence[str]
) -> DataFrame:
    """Per bucket: the last reset and last values of all earlier buckets of the same key."""
    summary = bucketed.groupBy(*keys, _BUCKET).agg(F.max(_RESET).alias(_RESET))
    if columns:
        # Keeping values makes an aggregation sort its input, so it only gets the rows that
        # have one (few line rows do); the plain aggregation above lists every bucket.
        valued = F.lit(False)
        for c in columns:
            valued = valued | F.col(c).isNotNull()
        latest = bucketed.filter(valued).groupBy(*keys, _BUCKET).agg(
            *[F.max(_at(order_by, c)).alias(_HELD + c) for c in columns]
        )
        summary = summary.join(latest, [*keys, _BUCKET], "left")
    earlier = W.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    held = [_RESET, *[_HELD + c for c in columns]]
    carried = summary.select(*keys, _BUCKET, *[F.max(h).over(earlier).alias(h) for h in held])
    carried = carried.select(
        *keys,
        _BUCKET,
        F.col(_RESET).alias(_START),
        *[
            F.when(
                F.col(_RESET).isNull() | (F.col(_HELD + c)["pos"] >= F.col(_RESET)),
                F.col(_HELD + c)["value"],
            ).alias(_HELD + c)
            for c in columns
        ],
    )
    # Buckets that inherit nothing (all of them, for keys within one bucket) need no row.
    useful = F.col(_START).isNotNull()
    for c in columns:
        useful = useful | F.col(_HELD + c).isNotNull()
    return carried.filter(useful)


def forward_fill(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = (SOURCE_FILE,),
    order_by: str = ROW_NO,
    reset: Column | None = None,
    reset_position: str | None = None,
    bucket_rows: int = BUCKET_ROWS,
    only_above: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Replace nulls by the last value above them within the same key.

    ``reset`` marks rows that start a new group: nothing is filled across them.  With
    ``reset_position`` the position of the last reset at or above each row is added.
    ``only_above`` gives every row the last value of the rows before it, not its own.
    ``rows``, at least the number of rows, saves counting them.
    """
    keys = list(keys)
    order = df.columns
    marked = F.lit(None).cast("bigint") if reset is None else F.when(reset, F.col(order_by))
    bucketed = _with_bucket(df, order_by, bucket_rows).withColumn(_RESET, marked.cast("bigint"))
    inherited = _inherited(bucketed, keys, order_by, columns)

    last = -1 if only_above else 0
    so_far = W.partitionBy(*keys, _BUCKET).orderBy(order_by).rowsBetween(W.unboundedPreceding, last)
    scanned = _dealt(bucketed, keys, rows).select(
        *[c for c in bucketed.columns if c != _RESET],
        F.max(_RESET).over(so_far).alias(_RESET),
        *[F.max(_at(order_by, c)).over(so_far).alias(_SEEN + c) for c in columns],
    )
    joined = scanned.join(inherited, [*keys, _BUCKET], "left")

    def filled(c: str) -> Column:
        here, above = F.col(_SEEN + c), F.col(_HELD + c)
        untouched = F.coalesce(here["value"], above)
        after_reset = F.when(here["pos"] >= F.col(_RESET), here["value"])
        return F.when(F.col(_RESET).isNull(), untouched).otherwise(after_reset)

    chosen = set(columns)
    out = [filled(c).alias(c) if c in chosen else F.col(c) for c in order]
    if reset_position is not None:
        out.append(F.coalesce(_RESET, _START).alias(reset_position))
    return joined.select(*out)


def previous_value(
    df: DataFrame,
    column: str,
    name: str,
    keys: Sequence[str] = (SOURCE_FILE,),
    order_by: str = ROW_NO,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add the (never null) ``column`` of the row directly above, null on the first row."""
    keys = list(keys)
    bucketed = _with_bucket(df, order_by, bucket_rows).withColumn(_RESET, F.lit(None).cast("bigint"))
    inherited = _inherited(bucketed, keys, order_by, [column]).drop(_START)
    above = F.lag(column).over(W.partitionBy(*keys, _BUCKET).orderBy(order_by))
    return (
        _dealt(bucketed, keys, None).withColumn(name, above)
        .join(inherited, [*keys, _BUCKET], "left")
        .select(*df.columns, F.coalesce(name, _HELD + column).alias(name))
    )


def number_rows(
    df: DataFrame,
    order_by: Sequence[Column],
    keys: Sequence[str] = (),
    name: str = "rank",
    rows: int | None = None,
) -> DataFrame:
    """Number all rows 1..n in the given total order, per key if keys are given.

    Rows are range-partitioned on the order, so each task holds one stretch of it and
    can number its rows by position; a running count over the stretches adds the
    offset.  The range bounds are sampled, so the partitioned rows are written once and
    both steps read that copy.  ``order_by`` must be unique for a repeatable result.
    With ``rows``, at least the number of rows, the stretches are as many as keep the sort
    of each in memory; without it as many as the session's shuffle partitions.
    """
    keys = list(keys)
    order = [*[F.col(k).asc() for k in keys], *order_by]
    n = [] if rows is None else [tasks_for(df.sparkSession, rows)]
    stretches = materialize(
        df.repartitionByRange(*n, *order)
        .sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}),
        name,
    )
    counts = stretches.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first")
    )
    # One row per stretch, and per further key a stretch holds.
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        "_part",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_offset"),
    )
    # Without keys there is one row per stretch.
    small = broadcast_if_small(offsets) if keys else F.broadcast(offsets)
    return (
        stretches.join(small, [*keys, "_part"])
        .select(*df.columns, (F.col("_at") + F.col("_offset")).alias(name))
    )


def running_total(
    df: DataFrame,
    value: str,
    order_by: Sequence[Column],
    keys: Sequence[str] = (),
    name: str = "before",
) -> DataFrame:
    """Add the sum of the whole number ``value`` over all rows before in the given total order, per key if keys are given.

    As in :func:`number_rows` the rows are cut into written stretches of the order.  A window per stretch adds up inside
    it, the sums of the stretches before it give its offset, and no window covers a whole key.
    """
    keys = list(keys)
    stretches = materialize(
        df.repartitionByRange(*[F.col(k).asc() for k in keys], *order_by).withColumn("_part", F.spark_partition_id()), name
    )
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        stretches.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
        .select(*keys, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy(*keys, "_part").orderBy(*order_by).rowsBetween(W.unboundedPreceding, -1)
    small = broadcast_if_small(offsets) if keys else F.broadcast(offsets)
    return (
        stretches.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(small, [*keys, "_part"])
        .select(*df.columns, (F.col("_inside") + F.col("_offset")).alias(name))
    )
