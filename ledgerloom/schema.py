"""Column contracts of the two ERP exports.

Every table of the library uses the short English names below.  Landed exports
carry the ERP system's own headings; :func:`standardize` renames them.  All
decisions here are taken on ``df.columns`` only, so nothing runs at plan time.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
AMOUNT = T.DecimalType(18, 4)

# Row position columns stamped on every landed table.
SOURCE_FILE = "source_file"
ROW_NO = "row_no"
PERIOD = "period"
# The text of a CSV row that does not fit its header.
DAMAGED = "damaged_text"
POSITION = (SOURCE_FILE, ROW_NO)


class Field(NamedTuple):
    heading: str
    name: str
    kind: str  # text | money | amount | count | percent | date
    note: str


# --- fixed values: export headings and their meaning --------------------------------
ORDER_FIELDS = (
    Field("銷貨單號", "order_no", "text", "order number, filled on header rows only"),
    Field("訂單單號", "customer_order_no", "text", "the customer's own order number"),
    Field("銷貨日期", "order_date", "date", "date of sale"),
    Field("客戶代號", "customer_code", "text", "customer code"),
    Field("客戶名稱", "customer_name", "text", "customer name"),
    Field("部門代號", "dept_code", "text", "department code"),
    Field("部門名稱", "dept_name", "text", "department name"),
    Field("發票號碼", "invoice_no", "text", "invoice number"),
    Field("未稅小計", "net_amount", "money", "order amount before tax"),
    Field("營業稅", "tax", "money", "sales tax"),
    Field("折讓金額", "allowance", "money", "allowance granted"),
    Field("稅前折價", "pretax_discount", "money", "discount before tax"),
    Field("總計金額", "total_amount", "money", "order amount including tax"),
    Field("實收總額", "received_total", "money", "amount received"),
    Field("成本總額", "cost_total", "money", "cost of the order"),
    Field("毛利", "gross_profit", "amount", "order amount less cost"),
    Field("毛利率", "margin_pct", "percent", "profit in percent of the amount"),
)

LINE_FIELDS = (
    Field("產品代號", "product_code", "text", "product code (SKU)"),
    Field("產品名稱", "product_name", "text", "product name"),
    Field("倉別代號", "warehouse_code", "text", "warehouse code"),
    Field("倉別名稱", "warehouse_name", "text", "warehouse name"),
    Field("數量", "quantity", "amount", "quantity sold"),
    Field("單位", "unit", "text", "unit of measure"),
    Field("單價", "unit_price", "amount", "price per unit"),
    Field("小計", "subtotal", "amount", "line amount"),
    Field("成本總值", "cost_value", "amount", "cost of the line"),
    Field("產品毛利", "product_profit", "amount", "line amount less cost"),
    Field("產品毛利率", "product_margin_pct", "percent", "line profit in percent"),
    Field("銷售單價1", "list_price_1", "amount", "list price"),
    Field("精準成本", "exact_cost", "amount", "exact cost"),
    Field("精準毛利", "exact_profit", "amount", "exact profit"),
    Field("單位管銷成本", "overhead_unit", "amount", "overhead per unit"),
    Field("管銷成本合計", "overhead_total", "amount", "overhead of the line"),
    Field("*銷貨日期", "line_date", "date", "date of sale on the line"),
    Field("*客戶代號", "line_customer_code", "text", "customer code on the line"),
    Field("*客戶條件", "line_customer_terms", "text", "customer terms"),
    Field("*部門代號", "line_dept_code", "text", "department code on the line"),
    Field("*業務代號", "line_sales_rep", "text", "sales representative"),
    Field("*業務條件", "line_sales_terms", "text", "sales terms"),
)

# Optional columns seen in some sales exports.
EXTRA_SALES_FIELDS = (Field("大類名稱", "category_major", "text", "main category"),)

INVENTORY_FIELDS = (
    Field("產品代號", "product_code", "text", "product code (SKU)"),
    Field("產品名稱", "product_name", "text", "product name"),
    Field("數量", "on_hand", "count", "stock on hand"),
    Field("倉庫", "warehouse", "text", "warehouse"),
    Field("單位", "unit", "text", "unit of measure"),
    Field("成本單價", "unit_cost", "amount", "cost per unit"),
    Field("成本總價", "cost_value", "amount", "stock value at cost"),
    Field("安全存量", "safety_stock", "amount", "minimum stock to keep"),
    Field("廠商代號", "vendor_code", "text", "vendor code"),
    Field("廠商簡稱", "vendor_short", "text", "vendor short name"),
    Field("最後出貨日", "last_out", "date", "last shipment"),
    Field("最後進貨日", "last_in", "date", "last receipt"),
    Field("銷售單價1", "list_price_1", "amount", "list price 1"),
    Field("銷售單價2", "list_price_2", "amount", "list price 2"),
    Field("銷售單價3", "list_price_3", "amount", "list price 3"),
    Field("銷售單價4", "list_price_4", "amount", "list price 4"),
    Field("最低售價", "min_price", "amount", "lowest selling price"),
    Field("數量為零自動下架", "auto_delist", "text", "delist when stock is zero"),
    Field("持續上架", "keep_listed", "text", "always listed"),
    Field("停止上架", "stop_listed", "text", "no longer listed"),
    Field("大類名稱", "category_major", "text", "main category"),
    Field("中類名稱", "category_mid", "text", "middle category"),
    Field("小類名稱", "category_minor", "text", "small category"),
    Field("備註", "note", "text", "remarks"),
    Field("EAN13碼", "ean13", "text", "EAN-13 code"),
    Field("CO128碼", "co128", "text", "Code 128 code"),
    Field("建議售價", "suggested_price", "amount", "suggested price"),
    Field("毛利率", "margin_pct", "percent", "profit in percent, may be masked"),
)

# Other headings a canonical sales column may appear under, in order of preference.
SALES_ALIASES: dict[str, tuple[str, ...]] = {
    "product_code": ("商品代號", "品項代號", "SKU", "商品編號"),
    "product_name": ("商品名稱", "品項名稱", "商品說明"),
    "quantity": ("購買數量", "銷售數量", "qty", "quantity"),
    "subtotal": ("金額", "總額", "產品金額", "銷售金額", "amount"),
}

# Columns an export must have to be accepted, and those a report cannot do without.
REQUIRED = {
    "sales": tuple(f.name for f in ORDER_FIELDS),
    "inventory": (
        "product_code", "product_name", "on_hand", "warehouse", "unit", "unit_cost", "cost_value",
    ),
}
CRITICAL_SALES = ("order_date", "total_amount", "gross_profit")
# --- end of fixed values -------------------------------------------------------------

SALES_FIELDS = ORDER_FIELDS + LINE_FIELDS + EXTRA_SALES_FIELDS
ORDER_COLUMNS = tuple(f.name for f in ORDER_FIELDS)
LINE_COLUMNS = tuple(f.name for f in LINE_FIELDS) + tuple(f.name for f in EXTRA_SALES_FIELDS)

FIELDS: dict[str, tuple[Field, ...]] = {"sales": SALES_FIELDS, "inventory": INVENTORY_FIELDS}

SPARK_TYPES: dict[str, T.DataType] = {
    "text": T.StringType(),
    "money": MONEY,
    "amount": AMOUNT,
    "count": T.LongType(),
    "percent": T.DoubleType(),
    "date": T.DateType(),
}


def headings(kind: str) -> list[str]:
    """The export's own column headings, in order."""
    return [f.heading for f in FIELDS[kind]]


def text_schema(columns: Iterable[str]) -> T.StructType:
    """All-text landing schema for the given header."""
    notes = {n: f.note for fields in FIELDS.values() for f in fields for n in (f.heading, f.name)}
    return T.StructType([
        T.StructField(c, T.StringType(), True, {"comment": notes.get(c, "")}) for c in columns
    ])


def typed_schema(kind: str) -> T.StructType:
    """Schema of an export after cleaning."""
    return T.StructType([
        T.StructField(f.name, SPARK_TYPES[f.kind], True, {"comment": f.note})
        for f in FIELDS[kind]
    ])


def standardize(df: DataFrame, kind: str) -> DataFrame:
    """Rename the export's own headings to the library's names; other columns stay."""
    names = {f.heading: f.name for f in FIELDS[kind]}
    return df.withColumnsRenamed({c: names[c] for c in df.columns if c in names})


def resolve_aliases(
    df: DataFrame, aliases: Mapping[str, Sequence[str]] = SALES_ALIASES
) -> DataFrame:
    """Take a missing canonical column from the first of its aliases that is present."""
    added = {}
    for name, options in aliases.items():
        if name in df.columns:
            continue
        found = next((o for o in options if o in df.columns), None)
        if found is not None:
            added[name] = F.col(f"`{found}`")
    return df.withColumns(added) if added else df


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """D5 helper: the listed columns that exist, in the listed order."""
    return [c for c in columns if c in df.columns]


def check_contract(df: DataFrame, kind: str) -> DataFrame:
    """One row telling whether a table can be reported on.

    Missing columns come from the schema; the two counts need one pass over the data.
    A sales table is usable when its critical columns exist and at least one row has
    both an order number and a month.
    """
    missing = missing_columns(df, REQUIRED[kind])
    critical = missing_columns(df, CRITICAL_SALES) if kind == "sales" else missing
    conditions = [
        F.col(c).isNotNull() for c in ("order_no", "ym") if c in df.columns
    ] if kind == "sales" else [F.col("product_code").isNotNull()] if "product_code" in df.columns else []
    usable = F.lit(True)
    for c in conditions:
        usable = usable & c
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(usable).alias("usable_rows"),
    ).select(
        F.lit(kind).alias("kind"),
        _text_array(missing).alias("missing"),
        _text_array(critical).alias("missing_critical"),
        "rows",
        "usable_rows",
        ((F.col("usable_rows") > 0) & F.lit(not critical)).alias("accepted"),
    )


def _text_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def empty_table(spark: SparkSession, kind: str) -> DataFrame:
    """Typed table without rows, for exports that cannot be read."""
    schema = typed_schema(kind).add(SOURCE_FILE, "string").add(ROW_NO, "long")
    return spark.createDataFrame([], schema)
