"""Dates written in the Republic-of-China or the Gregorian calendar, as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ROC_OFFSET = 1911  # fixed value: year 1 of the ROC calendar is 1912
_LAST_YEAR = 2261  # fixed value: last full year of a nanosecond timestamp

# Spellings that are brought to year-month-day order before anything else.
_COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
_DAY_FIRST = r"^(1[3-9]|[23]\d)[-/](\d{1,2})[-/](\d{4})$"
_MONTH_FIRST = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$"
_GREGORIAN = r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"
_ROC = r"^\d{1,3}-\d{1,2}-\d{1,2}$"


def _date(year: Column, month: Column, day: Column) -> Column:
    """Date from its parts, null when there is no such day."""
    return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month, day).try_cast("date")


def date_in_order(c: Column) -> Column:
    """First step of B5: the cell as ``year-month-day`` text, whatever its spelling."""
    text = F.regexp_replace(F.trim(c.cast("string")), _COMPACT, "$1-$2-$3")
    text = F.regexp_replace(text, _DAY_FIRST, "$3-$2-$1")
    return F.translate(F.regexp_replace(text, _MONTH_FIRST, "$3-$1-$2"), "./", "--")


def date_from_ordered(c: Column) -> Column:
    """Second step of B5: a 1-3 digit year is ROC, a 4 digit year Gregorian."""
    roc_year = F.substring_index(c, "-", 1).try_cast("int") + _ROC_OFFSET
    roc = F.concat(roc_year.cast("string"), F.substr(c, F.instr(c, "-")))
    return F.when(c.rlike(_GREGORIAN), c.try_cast("date")).when(c.rlike(_ROC), roc.try_cast("date"))


def parse_sales_date(c: Column) -> Column:
    """Date of one cell, judged by that cell alone.

    Three parts with a 1-3 digit year are ROC; a 4 digit year is Gregorian; then
    ``yyyyMMdd``; with the year last, month-first unless that number is no month.
    """
    return date_from_ordered(date_in_order(c))


def minguo_to_date(c: Column) -> Column:
    """ROC text with ``.``, ``/`` or ``-`` (first kind found) to a date, else null."""
    text = c.cast("string")
    parts = (
        F.when(text.contains("."), F.split(text, r"\."))
        .when(text.contains("/"), F.split(text, "/"))
        .otherwise(F.split(text, "-"))
    )
    year = F.get(parts, F.lit(0)).try_cast("int") + _ROC_OFFSET
    month = F.get(parts, F.lit(1)).try_cast("int").cast("string")
    day = F.get(parts, F.lit(2)).try_cast("int").cast("string")
    known = (F.size(parts) == 3) & year.between(1, _LAST_YEAR) & month.isNotNull() & day.isNotNull()
    return F.when(known, _date(year, month, day))


def parse_report_date(c: Column) -> Column:
    """Date for the month report.

    Same per-cell rules as B5; nothing is decided from a sample of the table, so the
    result of a row does not depend on the other rows.
    """
    return F.coalesce(parse_sales_date(c), minguo_to_date(c))


def ym_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def roc_year(c: Column) -> Column:
    """Gregorian year read off ROC text whose full date cannot be parsed."""
    return F.nullif(F.regexp_extract(c.cast("string"), r"^(\d{1,3})\.", 1), F.lit("")).cast("int") + _ROC_OFFSET


def roc_month(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c.cast("string"), r"\.(\d{1,2})\.", 1), F.lit("")).cast("int")


def year_month_text(year: Column, month: Column) -> Column:
    text = F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))
    return F.when(year.isNotNull() & month.isNotNull(), text)
