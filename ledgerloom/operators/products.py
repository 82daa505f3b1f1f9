"""Product summaries, month columns and full rankings.

A product that holds a large share of the lines is reduced on the map side of one
aggregation; named period columns are conditional sums in it, so no product is looked at
twice and no pivot or self-join is needed.

Columns for all months are kept as one map per product until the table is shown: hundreds
of columns, most of them 0, are never shuffled, sorted or written by this library.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import sum_or_zero, unit_price_by_qty
from ledgerloom.operators.filters import filter_product
from ledgerloom.operators.ordered import number_rows
from ledgerloom.schema import PERIOD, ROW_NO, SOURCE_FILE, present
from ledgerloom.storage import TASK_ROWS, materialize, tasks_for

MONTHS = "_months"
# Lines looked at for products that would overfill a task.
_SAMPLED = 200_000
# Products with a map that a task gets where they are dealt to a join.
_MAPS = 100_000

_SUMS = ("quantity", "subtotal", "cost_value")
_TEXTS = ("product_name", "unit")


def _first(c: str) -> Column:
    """First non-null value in file and row order."""
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(SOURCE_FILE, ROW_NO))).alias(c)


def _summary_columns(lines: DataFrame) -> list[Column]:
    columns = [_first(c) for c in present(lines, _TEXTS)]
    columns += [sum_or_zero(F.col(c)).alias(c) for c in present(lines, _SUMS)]
    if "unit_price" in lines.columns:
        mean = F.try_divide(F.sum("unit_price").cast("double"), F.count("unit_price").cast("double"))
        columns.append(mean.alias("unit_price"))
    return columns


def _by_product(lines: DataFrame, pattern: str | None, extra: Sequence[Column] = ()) -> DataFrame:
    """The summary in one shuffle on the product code, combined on the map side first."""
    chosen = filter_product(lines, pattern).filter(F.col("product_code").isNotNull())
    return _ordered_summary(chosen.groupBy("product_code").agg(*_summary_columns(lines), *extra))


def _ordered_summary(summary: DataFrame) -> DataFrame:
    if {"quantity", "subtotal"} <= set(summary.columns):
        summary = summary.withColumn(
            "unit_price_by_qty", unit_price_by_qty(F.col("subtotal"), F.col("quantity"))
        )
    shown = (
        "product_code", "product_name", "quantity", "unit", "unit_price", "unit_price_by_qty",
        "subtotal", "cost_value",
    )
    extra = [c for c in summary.columns if c not in shown]
    return summary.select(*present(summary, shown), *[F.col(f"`{c}`") for c in extra])


def product_summary(lines: DataFrame, pattern: str | None = None, ordered: bool = True) -> DataFrame:
    """One row per product code, by amount descending.

    Name and unit are the first non-null ones in row order; the unit price is the plain
    mean of the lines.  Columns the lines do not have are left out.
    """
    summary = _by_product(lines, pattern)
    if not ordered or "subtotal" not in summary.columns:
        return summary
    return summary.orderBy(F.desc("subtotal"), "product_code")


def product_summary_by_period(
    lines: DataFrame,
    periods: Sequence[str],
    pattern: str | None = None,
    period: str = PERIOD,
    ordered: bool = True,
) -> DataFrame:
    """E10 plus quantity and amount of each listed period, 0 where there is none.

    The period columns are conditional sums in the same aggregation as E10.
    """
    summary = _by_product(lines, pattern, period_sums(periods, period))
    return summary.orderBy(F.desc("subtotal"), "product_code") if ordered else summary


def period_sums(periods: Sequence[str], column: str) -> list[Column]:
    """Conditional sums of quantity and amount, two columns per period."""
    out = []
    for p in periods:
        here = F.col(column) == F.lit(p)
        out.append(sum_or_zero(F.when(here, F.col("quantity"))).alias(f"{p}_quantity"))
        out.append(sum_or_zero(F.when(here, F.col("subtotal"))).alias(f"{p}_amount"))
    return out


def period_columns(periods: Sequence[str]) -> list[str]:
    return [f"{p}_{what}" for p in periods for what in ("quantity", "amount")]


def order_period_columns(df: DataFrame, periods: Sequence[str], style: str = "sales") -> DataFrame:
    """Where the period columns go.

    ``sales``: sorted as text and placed before the amount; ``integrated``: at the end,
    in the order the periods were chosen.
    """
    base = (
        "product_code", "product_name", "quantity", "stock", "unit", "unit_price",
        "unit_price_by_qty", "subtotal", "cost_value",
    )
    shown = present(df, base)
    chosen = present(df, period_columns(periods))
    if style == "sales":
        at = shown.index("subtotal") if "subtotal" in shown else len(shown)
        shown = [*shown[:at], *sorted(chosen), *shown[at:]]
    else:
        shown = [*shown, *chosen]
    return df.select(*[F.col(f"`{c}`") for c in shown])


def month_totals(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sparse form of month columns: quantity and amount per key and month that has any."""
    return _known(lines, keys).groupBy(*keys, "ym").agg(
        sum_or_zero(F.col("quantity")).alias("quantity"), sum_or_zero(F.col("subtotal")).alias("subtotal")
    )


def months_in(gathered: DataFrame) -> list[str]:
    """All months of a gathered table, in order; more columns than ``spark.sql.pivotMaxValues`` allows are an error."""
    most = int(gathered.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = gathered.select(F.explode(F.map_keys(MONTHS)).alias("ym")).distinct().limit(most + 1).collect()
    if 2 * len(found) > most:
        raise ValueError(f"more than {most // 2} months; name the months, or use month_totals")
    return sorted(r["ym"] for r in found)


def _large_keys(known: DataFrame, keys: Sequence[str], rows: int, most: int) -> DataFrame | None:
    """Keys that hold more than ``most`` rows by a sample, which only decides how their rows are moved; None without any."""
    if rows <= most:
        return None
    share = min(1.0, _SAMPLED / rows)
    counts = known.select(*keys).sample(share, seed=1).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = counts.filter(F.col("_n") > share * most).select(*keys).collect()
    return known.sparkSession.createDataFrame(found, known.select(*keys).schema) if found else None


def gather_months(
    lines: DataFrame, keys: Sequence[str] = ("product_code", "product_name"), sized_by: DataFrame | None = None
) -> DataFrame:
    """One row per key: total quantity and amount, and column ``_months`` that maps each of its months to both.

    Lines go to their keys in one shuffle, in as many tasks as their number asks for, and are reduced per month and key
    there.  Only lines of a key that would overfill a task are reduced on the map side first.  ``sized_by`` is a table of
    the same products with at least as many rows that is cheaper to count and sample, such as the lines before a fill.
    """
    return gathered_rows(lines, keys, sized_by)[0]


def _join_tasks(spark: SparkSession, rows: int, most: int | None = None) -> int:
    """As ``tasks_for``, but no fewer than the session's shuffle partitions: a join would deal fewer ones anew."""
    return max(tasks_for(spark, rows, most), int(spark.conf.get("spark.sql.shuffle.partitions")))


def gathered_rows(
    lines: DataFrame, keys: Sequence[str], sized_by: DataFrame | None, at: Sequence[str] = ()
) -> tuple[DataFrame, int]:
    """:func:`gather_months`, and a number of rows that it does not exceed.  With ``at``, some of the keys, the rows lie
    where a join on those finds them."""
    known = _known(lines, keys).select(*keys, "ym", "quantity", "subtotal")
    sizes = known if sized_by is None else _known(sized_by, keys)
    rows = sizes.count()
    large = _large_keys(sizes, keys, rows, TASK_ROWS)
    if large is not None:
        few = month_totals(known.join(F.broadcast(large), list(keys), "left_semi"), keys)
        known = known.join(F.broadcast(large), list(keys), "left_anti").unionByName(few)
    monthly = month_totals(known.repartition(_join_tasks(known.sparkSession, rows), *(at or keys)), keys)
    month = F.struct(F.col("ym").alias("key"), F.struct("quantity", "subtotal").alias("value"))
    gathered = monthly.groupBy(*keys).agg(
        sum_or_zero(F.col("quantity")).alias("quantity"), sum_or_zero(F.col("subtotal")).alias("subtotal"),
        F.map_from_entries(F.collect_list(F.when(F.col("ym").isNotNull(), month))).alias(MONTHS),
    )
    return gathered, rows


def show_months(gathered: DataFrame, months: Sequence[str], quantity: str = "quantity", amount: str = "subtotal") -> DataFrame:
    """Two columns per month in the place of the map, 0 where there is none; of the types of the totals."""
    types = dict(gathered.dtypes)

    def shown(month: str, c: str, total: str) -> Column:
        return F.coalesce(F.try_element_at(MONTHS, F.lit(month))[c].cast(types[total]), F.lit(0).cast(types[total]))

    wide = [
        shown(m, c, total).alias(f"{m}_{what}")
        for m in months for c, total, what in (("quantity", quantity, "quantity"), ("subtotal", amount, "amount"))
    ]
    at = gathered.columns.index(MONTHS)
    named = [F.col(f"`{c}`") for c in gathered.columns]
    return gathered.select(*named[:at], *wide, *named[at + 1:])


def pivot_months(
    lines: DataFrame, months: Sequence[str] | None = None, keys: Sequence[str] = ("product_code", "product_name")
) -> DataFrame:
    """Quantity and amount per key and month (by default every month of the lines), 0 where there is none.

    ``lines`` may be a written table of :func:`gather_months`.  Where the months are to be found, that table is written; its
    maps are then dealt to their keys, so that a join finds the wide rows in place.
    """
    gathered = lines if MONTHS in lines.columns else gather_months(lines, keys)
    if months is None:
        written = gathered if gathered is lines else materialize(gathered, "months")
        months = months_in(written)
        gathered = written.repartition(_join_tasks(written.sparkSession, written.count(), _MAPS), *keys)
    return show_months(gathered, months).drop("quantity", "subtotal")


def attach_months(ranked: DataFrame, pivot: DataFrame) -> DataFrame:
    """month columns joined to ranked products, 0 where a product has no month.

    The ranked side, a few narrow columns, is the one kept in memory, so that no wide row is sorted.
    """
    keys = ["product_code", "product_name"]
    added = [c for c in pivot.columns if c not in keys]
    ranked = ranked.select(*[F.col(f"`{c}`") for c in ranked.columns if c not in added])
    joined = ranked.hint("shuffle_hash").join(pivot, keys, "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in ranked.columns], *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in added]
    )


def _known(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a null key: groups of null keys are not reported."""
    for k in keys:
        lines = lines.filter(F.col(k).isNotNull())
    return lines


def product_totals(lines: DataFrame, keys: Sequence[str], quantity: str, amount: str) -> DataFrame:
    """Total quantity and amount per key."""
    return _known(lines, keys).groupBy(*keys).agg(
        sum_or_zero(F.col("quantity")).alias(quantity), sum_or_zero(F.col("subtotal")).alias(amount)
    )


def rank_sold_products(
    lines: DataFrame, months: Sequence[str] | None = None, sized_by: DataFrame | None = None,
    lookup: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Every sold (code, name) with totals, rank by amount and month columns (by default of all months).

    Months and totals come from one pass over the lines; the ranking is global but
    computed by range, see :func:`ledgerloom.operators.ordered.number_rows`.  The months of a product travel with it as
    a map and become columns of the numbered rows.  ``sized_by`` as in :func:`gather_months`.  ``lookup`` adds columns by
    product code; it is called on the products without their month columns, where they lie at their codes.
    """
    keys = ["product_code", "product_name"]
    order = [F.desc("total_amount"), F.asc("product_code"), F.asc("product_name")]
    rows = None
    if months is not None and not months:
        totals = product_totals(lines, keys, "total_quantity", "total_amount")
    else:
        gathered, rows = gathered_rows(lines, keys, sized_by, keys[:1])
        totals = gathered.withColumnsRenamed({"quantity": "total_quantity", "subtotal": "total_amount"})
    ranked = number_rows(totals if lookup is None else lookup(totals), order, rows=rows)
    ranked = ranked.select(*totals.columns, "rank", *[c for c in ranked.columns if c not in (*totals.columns, "rank")])
    if MONTHS not in ranked.columns:
        return ranked
    return show_months(ranked, months_in(ranked) if months is None else months, "total_quantity", "total_amount")


def top_n_products(lines: DataFrame, n: int = 50) -> DataFrame:
    """The n products with the highest amount; rows lacking code, name, quantity or
    amount are ignored."""
    complete = lines.dropna(subset=["product_code", "product_name", "quantity", "subtotal"])
    best = (
        product_totals(complete, ["product_code", "product_name"], "quantity", "subtotal")
        .orderBy(F.desc("subtotal"), "product_code", "product_name")
        .limit(n)
    )
    return _rank_few(best)


def _rank_few(best: DataFrame) -> DataFrame:
    """Rank of an already limited list (at most n rows, so one task is enough)."""
    order = W.orderBy(F.desc("subtotal"), F.asc("product_code"), F.asc("product_name"))
    return best.select(F.row_number().over(order).alias("rank"), *best.columns)


def flag_unsold(df: DataFrame, suffix: str = " ⚠️ 未銷售") -> DataFrame:
    """Mark products that have stock but no sales, also in their name."""
    unsold = (F.col("sales_quantity") == 0) & (F.col("stock") > 0)
    return df.withColumns({
        "product_name": F.when(unsold, F.concat("product_name", F.lit(suffix))).otherwise(F.col("product_name")),
        "is_unsold": F.coalesce(unsold, F.lit(False)),
    })
