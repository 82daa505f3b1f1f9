"""Facts encoded in export file names, and canonical text keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.dates import year_month_text


def canonical_key(c: Column) -> Column:
    """Key as trimmed text, so that numeric and text keys of two exports meet."""
    return F.trim(c.cast("string"))


def period_from_filename(c: Column) -> Column:
    """A5: ``name_20250101_20250131.xlsx`` -> ``2025-01``; names with fewer parts stay.  Folders before the name do not count."""
    parts = F.split(F.element_at(F.split(c, "/"), -1), "_")
    start = F.get(parts, F.lit(1))
    period = F.concat(F.substring(start, 1, 4), F.lit("-"), F.substring(start, 5, 2))
    return F.when(F.size(parts) >= 3, period).otherwise(c)


def snapshot_date_from_filename(c: Column, modified: Column | None = None) -> Column:
    """``BC_x_20250331.csv`` -> ``2025/03/31``; without eight digits there, the file's own time."""
    last = F.regexp_replace(F.element_at(F.split(c, "_"), -1), r"\.[^.]*$", "")
    dated = F.concat_ws("/", F.substring(last, 1, 4), F.substring(last, 5, 2), F.substring(last, 7, 2))
    fallback = F.lit(None).cast("string") if modified is None else F.date_format(modified, "yyyy/MM/dd")
    return F.when(last.rlike(r"^\d{8}"), dated).otherwise(fallback)


def period_in_name(c: Column) -> Column:
    """Month from ``_yyyyMMdd_`` in a file name, null without it."""
    stamp = F.regexp_extract(c, r"_(\d{8})_", 1)
    year, month = F.substring(stamp, 1, 4).try_cast("int"), F.substring(stamp, 5, 2).try_cast("int")
    return F.when(F.length(stamp) == 8, year_month_text(year, month))


def period_fallback(c: Column) -> Column:
    """Month from ``_yyyyMMdd_`` in a file name, otherwise the current month."""
    return F.coalesce(period_in_name(c), F.date_format(F.current_date(), "yyyy-MM"))
