"""Landed text tables to typed tables, and the calendar columns of a sale."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import dates, names, numbers
from ledgerloom.schema import FIELDS, PERIOD, SOURCE_FILE, SPARK_TYPES, standardize

_NUMBER_KINDS = ("money", "amount", "percent")
# Inventory numbers for which a missing or bad value means zero (fixed values).
_ZERO_WHEN_MISSING = (
    "on_hand", "unit_cost", "cost_value", "safety_stock", "list_price_1", "list_price_2", "suggested_price",
)


def _typed(df: DataFrame, kind: str, rule: Callable[[str, str], Column]) -> DataFrame:
    kinds = {f.name: f.kind for f in FIELDS[kind]}
    known = [c for c in df.columns if c in kinds]
    # Dates take two projections, so that the reordered text is computed once per cell.
    spelled = {c: dates.date_in_order(F.col(c)) for c in known if kinds[c] == "date"}
    ordered = df.withColumns(spelled) if spelled else df
    return ordered.withColumns({
        c: dates.date_from_ordered(F.col(c)) if c in spelled else rule(c, kinds[c]) for c in known
    })


def clean_sales(landed: DataFrame) -> DataFrame:
    """Typed sales rows: B1 on numbers, B5 on dates, B13 on keys; adds the file's period."""

    def rule(c: str, kind: str) -> Column:
        col = F.col(c)
        if kind in _NUMBER_KINDS:
            return numbers.clean_number_sales(col, SPARK_TYPES[kind])
        return names.canonical_key(col) if c.endswith(("_no", "_code")) else col

    clean = _typed(standardize(landed, "sales"), "sales", rule)
    if PERIOD in clean.columns or SOURCE_FILE not in clean.columns:
        return clean
    return clean.withColumn(PERIOD, names.period_from_filename(F.col(SOURCE_FILE)))


def clean_inventory(landed: DataFrame, truncate_all: bool = False) -> DataFrame:
    """Typed stock rows: B2 on numbers, B4 on the margin, B13 on keys.

    Only the stock quantity is cut to a whole number; ``truncate_all`` also cuts costs
    and prices.
    """

    def rule(c: str, kind: str) -> Column:
        col = F.col(c)
        if c in _ZERO_WHEN_MISSING:
            cut = truncate_all or kind == "count"
            return numbers.clean_number_inventory(col, SPARK_TYPES[kind], truncate=cut)
        if kind == "percent":
            return numbers.scrub_masked_percent(col)
        if kind in _NUMBER_KINDS:
            return numbers.clean_number_value(col, SPARK_TYPES[kind])
        return names.canonical_key(col) if c.endswith("_code") else col

    return _typed(standardize(landed, "inventory"), "inventory", rule)


def derive_calendar(df: DataFrame, date: str = "order_date", raw: str | None = None) -> DataFrame:
    """``year``, ``month`` and ``ym`` of a sale.

    Where the date is null, year and month are read off the ROC text in ``raw``.
    """
    year, month = F.year(date), F.month(date)
    if raw is not None:
        year = F.coalesce(year, dates.roc_year(F.col(raw)))
        month = F.coalesce(month, dates.roc_month(F.col(raw)))
        ym = dates.year_month_text(year, month)
    else:
        ym = dates.ym_text(F.col(date))
    return df.withColumns({"year": year, "month": month, "ym": ym})


def report_calendar(
    df: DataFrame, date: str = "order_date", raw: str | None = None, fallback: str = "none", run_month: str | None = None
) -> DataFrame:
    """B8 and A7 together: the month of a row from its date, else from the ROC text in ``raw``; and where these fail, by
    ``fallback``: ``none``; ``rows`` takes the month of the file name, else ``run_month`` (by default the current one), for
    each row without a month; ``table`` does so only when no row of the table has one.

    A table without the date column has no dates; without the raw one too the switch of ``table`` is known to be on.
    Otherwise it is a value inside the plan.
    """
    if fallback not in ("none", "rows", "table"):
        raise ValueError("fallback is 'none', 'rows' or 'table'")
    undated = date not in df.columns and raw not in df.columns
    if date not in df.columns:
        df = df.withColumn(date, F.lit(None).cast("date"))
    dated = derive_calendar(df, date, raw if raw in df.columns else None)
    if fallback == "none":
        return dated
    stamped = names.period_fallback(F.col(SOURCE_FILE)) if run_month is None else F.coalesce(
        names.period_in_name(F.col(SOURCE_FILE)), F.lit(run_month)
    )
    acts = F.lit(True)
    if fallback == "table" and not undated:
        acts = dated.agg(F.count("ym") == 0).scalar()
    ym = F.coalesce("ym", F.when(acts, stamped))
    year, month = F.substring(ym, 1, 4).try_cast("int"), F.substring(ym, 6, 2).try_cast("int")
    return dated.withColumns({"year": F.coalesce("year", year), "month": F.coalesce("month", month), "ym": ym})


def apply_period_fallback(df: DataFrame) -> DataFrame:
    """Month from the file name for rows whose date gives none."""
    return df.withColumn("ym", F.coalesce("ym", names.period_fallback(F.col(SOURCE_FILE))))


def fill_defaults(df: DataFrame, defaults: Mapping[str, object] | None = None, zero: bool = False) -> DataFrame:
    """Defaults after a lookup join; with ``zero`` all remaining null numbers become 0."""
    chosen = {"stock": 0, "vendor_short": "N/A"} if defaults is None else dict(defaults)
    chosen = {c: v for c, v in chosen.items() if c in df.columns}
    filled = df.fillna(chosen) if chosen else df
    if not zero:
        return filled
    numeric = [c for c, t in filled.dtypes if t.startswith(("decimal", "int", "bigint", "double"))]
    return filled.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in numeric}) if numeric else filled
