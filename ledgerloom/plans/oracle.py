"""Independent SQL for the queries of :mod:`ledgerloom.plans.checks`.

Plain windows, joins and aggregates over the base tables, for a single-node engine; no
statement shares code with the Spark side beyond the month and filter constants.
"""

from __future__ import annotations

from ledgerloom.plans.checks import CATEGORIES, MONTHS, PATTERN, UNSOLD_PERIODS


def _in(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_BASE = """
WITH l AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, l.l_linenumber, l.l_partkey, l.l_suppkey,
         CAST(l.l_quantity AS DECIMAL(12,0)) AS qty, CAST(l.l_extendedprice AS DECIMAL(18,2)) AS ext,
         CAST(l.l_discount AS DECIMAL(4,2)) AS disc, CAST(l.l_tax AS DECIMAL(4,2)) AS tax,
         CAST(ROUND(o.o_totalprice * 100) AS BIGINT) AS cents,
         ROW_NUMBER() OVER (PARTITION BY o.o_orderkey
           ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) AS nth
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
sales_raw AS (
  SELECT 'sales_' || STRFTIME(o_orderdate, '%Y%m') || '01_end.csv' AS source_file,
    STRFTIME(o_orderdate, '%Y-%m') AS period,
    ROW_NUMBER() OVER (PARTITION BY YEAR(o_orderdate), MONTH(o_orderdate) ORDER BY o_orderkey, nth) AS row_no,
    CASE WHEN nth = 1 THEN 'SO' || o_orderkey END AS order_no,
    CASE WHEN nth = 1 THEN CAST(o_orderdate AS DATE) END AS order_date,
    CASE WHEN nth = 1 THEN c_name END AS customer_name,
    CASE WHEN nth = 1 THEN CAST(CAST(cents AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2)) END AS total_amount,
    CASE WHEN nth = 1 THEN CAST(CAST(cents * (MOD(o_orderkey, 40) - 5) AS DECIMAL(24,0)) / 10000 AS DECIMAL(18,4)) END AS gross_profit,
    'P' || l_partkey AS product_code, p_name AS product_name, p_type AS category_major,
    CAST(qty AS DECIMAL(18,4)) AS quantity, 'EA' AS unit,
    CAST(CAST(p_retailprice AS DECIMAL(12,2)) * (1 + tax) AS DECIMAL(18,4)) AS unit_price,
    CAST(ext * (1 - disc) AS DECIMAL(18,4)) AS subtotal,
    CAST(CAST(p_retailprice AS DECIMAL(12,2)) * qty AS DECIMAL(18,4)) AS cost_value
  FROM l JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
sales AS (SELECT * FROM sales_raw),
gapped AS (
  SELECT * REPLACE (
    CASE WHEN order_no IS NOT NULL AND row_no > 3
         THEN 'R' || (CAST(SUBSTR(order_no, 3) AS BIGINT) % 97) END AS order_no,
    CASE WHEN order_no IS NOT NULL THEN CASE WHEN row_no % 3 <> 0 THEN customer_name END
         WHEN row_no % 11 = 0 THEN 'own ' || row_no END AS customer_name)
  FROM sales_raw),
copies AS (
  SELECT p.*, 0 AS copy_no FROM part p
  UNION ALL SELECT p.*, 1 AS copy_no FROM part p WHERE MOD(p_partkey, 50) = 0),
inv AS (
  SELECT ROW_NUMBER() OVER (ORDER BY copy_no, p_partkey) AS row_no, 'P' || p_partkey AS product_code,
    p_name AS product_name,
    CAST(CASE WHEN MOD(p_partkey, 7) = 0 THEN 0 WHEN MOD(p_partkey, 11) = 0 THEN -3
         ELSE p_size * 3 + copy_no END AS BIGINT) AS on_hand,
    CAST(60 AS DECIMAL(18,4)) AS safety_stock,
    CAST(CAST(p_retailprice AS DECIMAL(12,2)) * 0.60 AS DECIMAL(18,4)) AS unit_cost,
    p_type AS category_major, p_brand AS category_mid, s_name AS vendor_short,
    CASE WHEN MOD(p_partkey, 13) = 0 THEN '***.**' ELSE CAST(MOD(p_partkey, 60) AS VARCHAR) END AS margin_text
  FROM copies LEFT JOIN supplier ON s_suppkey = MOD(p_partkey, 10)),
stock AS (
  SELECT product_code, LAST(product_name ORDER BY row_no) AS product_name, LAST(on_hand ORDER BY row_no) AS stock,
    LAST(vendor_short ORDER BY row_no) AS vendor_short, LAST(unit_cost ORDER BY row_no) AS unit_cost
  FROM inv GROUP BY product_code),
orders_once AS (
  SELECT *, STRFTIME(order_date, '%Y-%m') AS ym FROM sales WHERE order_no IS NOT NULL
  QUALIFY ROW_NUMBER() OVER (PARTITION BY order_no ORDER BY source_file, row_no) = 1),
gapped_once AS (
  SELECT * FROM gapped WHERE order_no IS NOT NULL
  QUALIFY ROW_NUMBER() OVER (PARTITION BY order_no ORDER BY source_file, row_no) = 1),
runs AS (
  SELECT *, COUNT(order_no) OVER (PARTITION BY source_file ORDER BY row_no) AS run FROM sales),
filled AS (
  SELECT * REPLACE (
    FIRST_VALUE(order_no) OVER w AS order_no, FIRST_VALUE(order_date) OVER w AS order_date,
    FIRST_VALUE(customer_name) OVER w AS customer_name, FIRST_VALUE(total_amount) OVER w AS total_amount)
  FROM runs WINDOW w AS (PARTITION BY source_file, run ORDER BY row_no)),
lines AS (SELECT *, STRFTIME(order_date, '%Y-%m') AS ym FROM filled),
gapped_runs AS (
  SELECT *, COUNT(order_no) OVER (PARTITION BY source_file ORDER BY row_no) AS run,
    LAST_VALUE(order_no IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY row_no) AS carried
  FROM gapped),
month_lines AS (SELECT * FROM sales WHERE period IN ({unsold})),
summary AS (
  SELECT product_code, SUM(quantity) AS quantity, SUM(subtotal) AS subtotal,
    CASE WHEN SUM(quantity) > 0 THEN CAST(SUM(subtotal) AS DOUBLE) / CAST(SUM(quantity) AS DOUBLE) ELSE 0 END AS unit_price_by_qty
  FROM sales GROUP BY product_code),
monthly AS (
  SELECT ym, SUM(total_amount) AS total_amount, SUM(gross_profit) AS gross_profit,
    CAST(SUM(gross_profit) AS DOUBLE) / CAST(SUM(total_amount) AS DOUBLE) * 100.0 AS margin_pct
  FROM orders_once GROUP BY ym),
daily AS (
  SELECT order_date, SUM(total_amount) AS sales FROM sales WHERE order_date IS NOT NULL GROUP BY order_date),
date_texts AS (
  SELECT o_orderkey, o_orderkey % 10 AS k, CAST(o_orderdate AS DATE) AS d,
    CAST(YEAR(o_orderdate) - 1911 AS VARCHAR) AS roc FROM orders)
""".replace("{unsold}", _in(UNSOLD_PERIODS))


# Every month of the test data.
ALL_MONTHS = tuple(f"{n // 12}-{n % 12 + 1:02d}" for n in range(1995 * 12, 2001 * 12 + 8))


def _period_sums(column: str, alias: str = "m", months: tuple[str, ...] = MONTHS) -> str:
    return ", ".join(
        f"SUM(CASE WHEN {column} = '{p}' THEN quantity ELSE 0 END) AS {alias}{p.replace('-', '_')}_quantity, "
        f"SUM(CASE WHEN {column} = '{p}' THEN subtotal ELSE 0 END) AS {alias}{p.replace('-', '_')}_amount"
        for p in months
    )


def _period_names(wrap: str = "{}", months: tuple[str, ...] = MONTHS) -> str:
    names = [f"m{p.replace('-', '_')}_{w}" for p in months for w in ("quantity", "amount")]
    return ", ".join(wrap.format(n) + (f" AS {n}" if wrap != "{}" else "") for n in names)


_SUMMARY = """
SELECT product_code, FIRST(product_name ORDER BY source_file, row_no) AS product_name,
  SUM(quantity) AS quantity, FIRST(unit ORDER BY source_file, row_no) AS unit,
  CAST(SUM(unit_price) AS DOUBLE) / COUNT(unit_price) AS unit_price,
  CASE WHEN SUM(quantity) > 0 THEN CAST(SUM(subtotal) AS DOUBLE) / CAST(SUM(quantity) AS DOUBLE) ELSE 0 END AS unit_price_by_qty,
  SUM(subtotal) AS subtotal, SUM(cost_value) AS cost_value{more}
FROM sales GROUP BY product_code"""

_POSITION = "source_file, row_no"
_ISO = "STRFTIME({0}, '%Y-%m-%d')"
_MARGIN = "CASE WHEN {s} > 0 THEN CAST({p} AS DOUBLE) / CAST({s} AS DOUBLE) * 100.0 ELSE 0 END"

_UNSOLD = """
SELECT product_code, product_name, on_hand, unit_cost, CAST(on_hand * unit_cost AS DECIMAL(38,4)) AS stock_value,
  vendor_short, category_major, category_mid
FROM inv WHERE on_hand > 0 AND product_code NOT IN (SELECT product_code FROM month_lines)"""

_READ = {
    "a1_read_sales": f"""
SELECT source_file, order_no, product_code, quantity, subtotal, customer_name, total_amount FROM filled""",
    "a2_read_inventory": """
SELECT product_code, product_name, stock AS on_hand, unit_cost, vendor_short FROM stock""",
    "a1_row_order": """
WITH twins AS (
  SELECT 'a/' || source_file AS f, * FROM sales UNION ALL
  SELECT 'b/' || source_file AS f, * FROM sales WHERE row_no % 2 = 0)
SELECT f AS source_file, ROW_NUMBER() OVER (PARTITION BY f ORDER BY row_no) AS place, period, order_no, product_code, subtotal
FROM twins""",
    "a2_read_inventory_rows": """
SELECT row_no AS place, product_code, product_name, on_hand, unit_cost, vendor_short,
  CASE WHEN margin_text = '***.**' THEN NULL ELSE CAST(margin_text AS DOUBLE) END AS margin_pct FROM inv""",
    "a3_file_catalog": """
SELECT DISTINCT source_file AS name, TRUE AS has_bytes, TRUE AS has_time FROM sales""",
    "a4_overlay_catalog": f"""
SELECT DISTINCT source_file AS name, CASE WHEN period IN ({_in(MONTHS)}) THEN 'active' ELSE 'history' END AS side FROM sales""",
    "a7_month_report_undated": """
WITH once AS (
  SELECT * FROM sales WHERE order_no IS NOT NULL
  QUALIFY ROW_NUMBER() OVER (PARTITION BY order_no ORDER BY source_file, row_no) = 1),
per_month AS (SELECT period, COUNT(*) AS lines FROM sales WHERE product_code IS NOT NULL GROUP BY period)
SELECT period AS ym, SUM(total_amount) AS total_amount, SUM(gross_profit) AS gross_profit,
  CAST(SUM(gross_profit) AS DOUBLE) / CAST(SUM(total_amount) AS DOUBLE) * 100.0 AS margin_pct, ANY_VALUE(lines) AS lines
FROM once JOIN per_month USING (period) GROUP BY period""",
    "a9_select_periods_one": f"""
SELECT period, COUNT(*) AS n, SUM(subtotal) AS subtotal FROM sales WHERE period = '{MONTHS[0]}' GROUP BY period""",
    "a9_latest_export": """
SELECT source_file, order_no, product_code, quantity, subtotal FROM sales
WHERE source_file = (SELECT MAX(source_file) FROM sales)""",
    "a11_preview": """
SELECT source_file, row_no, order_no, product_code, quantity, subtotal FROM sales ORDER BY source_file, row_no LIMIT 10""",
    "a13_replaced_uploads": f"""
SELECT period, COUNT(*) AS n, SUM(subtotal) AS subtotal FROM sales
WHERE period NOT IN ({_in(MONTHS)}) OR row_no % 2 = 0 GROUP BY period""",
    "a5_period_from_filename": """
SELECT source_file, COUNT(*) AS n,
  SUBSTR(SPLIT_PART(source_file, '_', 2), 1, 4) || '-' || SUBSTR(SPLIT_PART(source_file, '_', 2), 5, 2) AS period
FROM sales_raw GROUP BY source_file""",
    "a6_snapshot_date_from_filename": """
SELECT 'BC_all_sku_20010801.csv' AS source_file, COUNT(*) AS n, '2001/08/01' AS snapshot_date FROM inv""",
    "a7_period_fallback": """
SELECT period AS ym, COUNT(*) AS n FROM sales_raw GROUP BY period""",
    "a8_union_periods": """
SELECT period, COUNT(*) AS n, COUNT(customer_name) AS customers, SUM(subtotal) AS subtotal
FROM sales GROUP BY period""",
    "a9_select_periods_latest": """
SELECT period, COUNT(*) AS n, SUM(subtotal) AS subtotal FROM sales
WHERE period = (SELECT MAX(period) FROM sales) GROUP BY period""",
    "a9_select_periods_many": f"""
SELECT period, COUNT(*) AS n, SUM(subtotal) AS subtotal FROM sales
WHERE period IN ({_in(MONTHS)}) GROUP BY period""",
    "a10_write_csv": _UNSOLD,
    "a12_profile": "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", COUNT({c}) AS count, ROUND(AVG(CAST({c} AS DOUBLE)), 4) AS mean,
  ROUND(STDDEV_SAMP(CAST({c} AS DOUBLE)), 4) AS std, ROUND(CAST(MIN({c}) AS DOUBLE), 4) AS min,
  ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25), 4) AS p25, ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.5), 4) AS p50,
  ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75), 4) AS p75, ROUND(CAST(MAX({c}) AS DOUBLE), 4) AS max FROM sales"""
        for c in ("quantity", "unit_price", "subtotal", "total_amount")
    ),
    "a13_land_incremental": """
SELECT period, COUNT(*) AS n, COUNT(order_no) AS orders, SUM(total_amount) AS total_amount,
  SUM(subtotal) AS subtotal FROM sales GROUP BY period""",
}

_CLEAN = {
    "b1_clean_number_sales": f"""
SELECT {_POSITION}, CASE WHEN row_no % 13 = 0 THEN 0 WHEN row_no % 17 = 0 THEN NULL ELSE total_amount END AS total_amount
FROM sales""",
    "b2_clean_number_inventory": """
SELECT row_no, CASE WHEN row_no % 13 = 0 THEN 0 ELSE on_hand END AS on_hand,
  CAST(FLOOR(unit_cost) AS DECIMAL(18,4)) AS unit_cost_cut FROM inv""",
    "b3_clean_number_value": f"""
SELECT {_POSITION}, CASE WHEN row_no % 13 = 0 THEN NULL ELSE CAST(total_amount AS DOUBLE) END AS total_amount
FROM sales""",
    "b4_scrub_masked_percent": """
SELECT row_no, CASE WHEN margin_text = '***.**' THEN NULL ELSE CAST(margin_text AS DOUBLE) END AS margin_pct
FROM inv""",
    "b5_parse_sales_date": f"""
SELECT o_orderkey, CASE WHEN k < 8 THEN {_ISO.format('d')} END AS order_date FROM date_texts""",
    "b6_minguo_to_date": f"""
SELECT o_orderkey, CASE WHEN k < 3 THEN {_ISO.format('d')} END AS order_date FROM date_texts""",
    "b7_parse_date_by_sample": f"""
SELECT o_orderkey, CASE WHEN k < 8 THEN {_ISO.format('d')} END AS order_date, CASE WHEN k < 8 THEN STRFTIME(d, '%Y-%m') END AS ym
FROM date_texts""",
    "b8_derive_calendar": """
WITH x AS (
  SELECT CASE WHEN k < 8 OR k = 8 THEN YEAR(d) END AS y, CASE WHEN k < 8 THEN MONTH(d) WHEN k = 8 THEN 2 END AS m
  FROM date_texts)
SELECT COALESCE(y, 0) AS year, COALESCE(m, 0) AS month,
  CAST(y AS VARCHAR) || '-' || LPAD(CAST(m AS VARCHAR), 2, '0') AS ym, COUNT(*) AS n
FROM x GROUP BY ALL""",
    "b9_check_contract": """
SELECT 'sales' AS kind, CAST(17 - 5 AS BIGINT) AS n_missing, COUNT(*) AS rows,
  COUNT(*) FILTER (WHERE order_no IS NOT NULL AND order_date IS NOT NULL) AS usable_rows, TRUE AS accepted
FROM sales""",
    "b10_resolve_aliases": "{top50}",
    "b11_unit_price_by_qty": f"""
SELECT {_POSITION}, CASE WHEN row_no % 13 = 0 OR quantity <= 0 THEN 0
  ELSE CAST(subtotal AS DOUBLE) / CAST(quantity AS DOUBLE) END AS unit_price_by_qty FROM sales""",
    "b12_margin_pct": f"""
SELECT order_no, {_MARGIN.format(s='total_amount', p='gross_profit')} AS margin_pct FROM orders_once""",
    "b13_canonical_key": """
SELECT CAST(l_partkey AS VARCHAR) AS key, COUNT(*) AS n FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part) GROUP BY 1""",
    "b14_fill_defaults": """
SELECT row_no, CASE WHEN row_no % 4 = 0 THEN 0 ELSE on_hand END AS stock,
  CASE WHEN row_no % 4 = 0 THEN 'N/A' ELSE COALESCE(vendor_short, 'N/A') END AS vendor_short,
  CASE WHEN row_no % 4 = 0 THEN 0 ELSE unit_cost END AS unit_cost FROM inv""",
    "b15_format_report": """
SELECT ym, FORMAT('${:,.2f}', CAST(total_amount AS DOUBLE)) AS total_amount,
  FORMAT('${:,.2f}', CAST(gross_profit AS DOUBLE)) AS gross_profit, PRINTF('%.2f%%', margin_pct) AS margin_pct
FROM monthly""",
    "b16_flag_unsold": """
WITH s AS (
  SELECT t.*, COALESCE(m.quantity, 0) AS q, COALESCE(m.subtotal, 0) AS a
  FROM stock t LEFT JOIN summary m USING (product_code))
SELECT product_code, CASE WHEN q = 0 AND stock > 0 THEN product_name || ' ⚠️ 未銷售' ELSE product_name END AS product_name,
  stock, COALESCE(vendor_short, 'N/A') AS vendor_short, q AS sales_quantity, a AS sales_amount,
  q = 0 AND stock > 0 AS is_unsold FROM s""",
    "b17_quality_stats": """
SELECT COUNT(*) AS rows, COUNT(*) - COUNT(order_no) AS order_no_nulls, COUNT(*) - COUNT(order_date) AS order_date_nulls,
  COUNT(*) - COUNT(total_amount) AS total_amount_nulls, COUNT(*) - COUNT(subtotal) AS subtotal_nulls FROM sales""",
    "b17_damaged_rows": """
SELECT 'lines' AS read_as, COUNT(*) + COUNT(*) FILTER (WHERE row_no % 7 = 0) AS rows, 2 * COUNT(*) FILTER (WHERE row_no % 7 = 0) AS damaged
FROM sales UNION ALL SELECT 'quoted cells', COUNT(*), 0 FROM sales""",
    "b17_overflow_stats": """
WITH x AS (SELECT row_no % 13 = 0 AS bad, row_no % 17 = 0 AS empty, row_no % 19 = 0 AS large, total_amount AS t FROM sales)
SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE empty AND NOT bad) AS subtotal_empty, COUNT(*) FILTER (WHERE bad) AS subtotal_bad,
  COUNT(*) FILTER (WHERE large AND NOT bad AND NOT empty) AS subtotal_overflow, COUNT(*) - COUNT(t) AS total_amount_empty,
  0 AS total_amount_bad, 0 AS total_amount_overflow FROM x""",
    "b17_date_parse_stats": """
SELECT COUNT(*) FILTER (WHERE k < 9) AS dates, COUNT(*) FILTER (WHERE k < 8) AS parsed,
  CAST(COUNT(*) FILTER (WHERE k < 8) AS DOUBLE) / COUNT(*) FILTER (WHERE k < 9) AS parsed_share, FALSE AS suspicious
FROM date_texts""",
    "b17_stock_stats": """
SELECT COUNT(*) AS skus, COUNT(*) FILTER (WHERE on_hand > 0) AS in_stock, MIN(on_hand) AS min_stock,
  MAX(on_hand) AS max_stock, CAST(SUM(on_hand) AS DOUBLE) / COUNT(*) AS mean_stock FROM inv""",
}

_HIERARCHY = {
    "c1_mark_headers": f"SELECT {_POSITION}, order_no IS NOT NULL AS is_header FROM gapped",
    "c2_fill_order_info": f"""
SELECT {_POSITION}, LAST_VALUE(order_no IGNORE NULLS) OVER w AS order_no,
  {_ISO.format('LAST_VALUE(order_date IGNORE NULLS) OVER w')} AS order_date,
  LAST_VALUE(customer_name IGNORE NULLS) OVER w AS customer_name,
  LAST_VALUE(total_amount IGNORE NULLS) OVER w AS total_amount
FROM gapped_runs WINDOW w AS (PARTITION BY source_file, run ORDER BY row_no)""",
    "c3_fill_by_order_id": f"""
WITH f AS (
  SELECT source_file, row_no, carried, LAST_VALUE(order_no IGNORE NULLS) OVER w AS o,
    {_ISO.format('LAST_VALUE(order_date IGNORE NULLS) OVER w')} AS d,
    LAST_VALUE(customer_name IGNORE NULLS) OVER w AS c, LAST_VALUE(total_amount IGNORE NULLS) OVER w AS t
  FROM gapped_runs WINDOW w AS (PARTITION BY source_file, carried ORDER BY row_no))
SELECT {_POSITION}, CASE WHEN carried IS NOT NULL THEN o END AS order_no, CASE WHEN carried IS NOT NULL THEN d END AS order_date,
  CASE WHEN carried IS NOT NULL THEN c END AS customer_name, CASE WHEN carried IS NOT NULL THEN t END AS total_amount FROM f""",
    "c4_split_levels_orders": f"""
SELECT {_POSITION}, order_no, {_ISO.format('order_date')} AS order_date, customer_name, total_amount FROM gapped_once""",
    "c4_split_levels_lines": f"""
SELECT {_POSITION}, product_code, quantity, subtotal FROM gapped WHERE order_no IS NULL""",
    "c4_split_rule": """
SELECT COUNT(*) AS rows, COUNT(order_no) AS order_rows, COUNT(DISTINCT order_no) AS orders, 'first_row' AS rule
FROM filled""",
    "c4_split_by_product_column": """
WITH x AS (
  SELECT source_file, row_no, 'Q' || CASE WHEN row_no % 20 = 0 THEN row_no - 1 ELSE row_no END || '-' || source_file AS order_no,
    row_no % 20 = 19 AS h FROM sales),
o AS (SELECT * FROM x WHERE h QUALIFY ROW_NUMBER() OVER (PARTITION BY order_no ORDER BY source_file, row_no) = 1)
SELECT source_file, row_no, order_no, 'order' AS level FROM o UNION ALL
SELECT source_file, row_no, order_no, 'line' FROM x WHERE NOT h""",
    "c4_split_by_first_row": """
SELECT source_file, row_no, order_no, CASE WHEN ROW_NUMBER() OVER (PARTITION BY order_no ORDER BY source_file, row_no) = 1
  THEN 'order' ELSE 'line' END AS level FROM filled""",
    "c4_split_header_products": """
SELECT 'order' AS level, COUNT(*) AS n, COUNT(order_no) AS numbered FROM gapped_once UNION ALL
SELECT 'line', COUNT(*), COUNT(order_no) FROM gapped WHERE product_code IS NOT NULL""",
    "c5_dedup_orders": f"SELECT {_POSITION}, order_no, total_amount FROM gapped_once",
    "c6_assign_parent": f"""
SELECT {_POSITION}, COALESCE(MAX(CASE WHEN order_no IS NOT NULL THEN row_no END)
  OVER (PARTITION BY source_file ORDER BY row_no), -1) AS parent_row_no FROM gapped""",
    "c6_parent_coverage": """
SELECT COUNT(*) FILTER (WHERE order_no IS NULL AND run > 0) AS assigned_lines,
  COUNT(*) FILTER (WHERE order_no IS NULL AND run = 0) AS orphan_lines FROM gapped_runs""",
    "c7_hierarchy_profile": """
WITH p AS (
  SELECT order_no IS NOT NULL AS h, LAG(order_no IS NOT NULL) OVER (PARTITION BY source_file ORDER BY row_no) AS b
  FROM gapped)
SELECT COUNT(*) FILTER (WHERE h) AS header_rows, COUNT(*) FILTER (WHERE NOT h) AS line_rows,
  COUNT(*) FILTER (WHERE h AND b) AS consecutive_headers, COUNT(*) FILTER (WHERE NOT h AND NOT b) AS consecutive_lines
FROM p""",
}

_FILTERS = {
    "d1_filter_product": f"""
SELECT {_POSITION}, product_code, subtotal FROM sales WHERE REGEXP_MATCHES(product_code, '{PATTERN}', 'i')""",
    "d2_filter_in": f"""
SELECT row_no, product_code, category_major FROM inv WHERE category_major IN ({_in(CATEGORIES)})""",
    "d3_filter_stock": """
SELECT row_no, product_code, on_hand, safety_stock FROM inv WHERE on_hand > 0 AND on_hand < safety_stock""",
    "d3_stock_status": """
SELECT CASE WHEN on_hand <= 0 THEN 'no_stock' WHEN on_hand < safety_stock THEN 'low_stock' ELSE 'in_stock' END AS stock_status,
  COUNT(*) AS n FROM inv GROUP BY 1""",
    "d4_option_values": "SELECT DISTINCT vendor_short FROM inv WHERE vendor_short IS NOT NULL",
    "d5_project_existing": "SELECT product_code, product_name, on_hand, vendor_short FROM inv",
    "d6_sort_by": "SELECT row_no, product_code, on_hand FROM inv ORDER BY on_hand DESC, product_code, row_no",
}

_TOP50 = """
SELECT ROW_NUMBER() OVER (ORDER BY SUM(subtotal) DESC, product_code, product_name) AS rank, product_code, product_name,
  SUM(quantity) AS quantity, SUM(subtotal) AS subtotal
FROM sales GROUP BY product_code, product_name ORDER BY rank LIMIT 50"""
_CLEAN["b10_resolve_aliases"] = _TOP50

_METRICS = {
    "e1_sales_kpis": f"""
SELECT SUM(total_amount) AS total_sales, SUM(gross_profit) AS total_profit, COUNT(DISTINCT order_no) AS total_orders,
  {_MARGIN.format(s='SUM(total_amount)', p='SUM(gross_profit)')} AS margin_pct FROM sales""",
    "e2_order_kpis": "SELECT SUM(total_amount) AS total_amount, SUM(gross_profit) AS gross_profit FROM gapped_once",
    "e3_avg_order_margin": f"""
SELECT ROUND(CAST(SUM(CAST({_MARGIN.format(s='total_amount', p='gross_profit')} AS DECIMAL(18,8))) AS DOUBLE) / COUNT(*), 6) AS avg_margin_pct
FROM orders_once""",
    "e3_ratio_of_sums": f"""
SELECT {_MARGIN.format(s='SUM(total_amount)', p='SUM(gross_profit)')} AS avg_margin_pct FROM orders_once""",
    "e4_daily_sales": f"SELECT {_ISO.format('order_date')} AS date, sales FROM daily",
    "e5_rolling_7": f"""
SELECT {_ISO.format('order_date')} AS date, sales,
  CASE WHEN COUNT(*) OVER w = 7 THEN CAST(SUM(sales) OVER w AS DOUBLE) / 7 END AS avg_7
FROM daily WINDOW w AS (ORDER BY order_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "e6_top_customers": """
SELECT customer_name, SUM(total_amount) AS total_amount FROM sales WHERE customer_name IS NOT NULL
GROUP BY customer_name ORDER BY total_amount DESC, customer_name LIMIT 10""",
    "e7_top_products": """
SELECT product_name, COALESCE(SUM(total_amount), 0) AS total_amount FROM sales GROUP BY product_name
ORDER BY total_amount DESC, product_name LIMIT 10""",
    "e7_top_products_by_line": """
SELECT product_name, SUM(subtotal) AS total_amount FROM sales GROUP BY product_name
ORDER BY total_amount DESC, product_name LIMIT 10""",
    "e8_top_margin_products": f"""
SELECT product_name, SUM(total_amount) AS total_amount, SUM(gross_profit) AS gross_profit,
  {_MARGIN.format(s='SUM(total_amount)', p='SUM(gross_profit)')} AS margin_pct
FROM sales GROUP BY product_name HAVING SUM(total_amount) > 0 ORDER BY margin_pct DESC, product_name LIMIT 10""",
    "e9_daily_by_category": f"""
SELECT {_ISO.format('order_date')} AS date, category_major AS category, SUM(total_amount) AS sales
FROM sales WHERE order_date IS NOT NULL AND category_major IS NOT NULL GROUP BY 1, 2""",
    "e10_product_summary": _SUMMARY.format(more=""),
    "e11_product_summary_by_period": _SUMMARY.format(more=", " + _period_sums("period")),
    "e12_order_period_columns": _SUMMARY.format(more=", " + _period_sums("period")),
    "e13_file_summary": """
WITH once AS (
  SELECT * FROM gapped WHERE order_no IS NOT NULL
  QUALIFY ROW_NUMBER() OVER (PARTITION BY source_file, order_no ORDER BY row_no) = 1)
SELECT f.source_file, COALESCE(SUM(total_amount), 0) AS total_amount, COALESCE(SUM(gross_profit), 0) AS gross_profit
FROM (SELECT DISTINCT source_file FROM gapped) f LEFT JOIN once USING (source_file) GROUP BY f.source_file""",
    "e14_monthly_report": "SELECT * FROM monthly",
    "e15_month_over_month": """
SELECT ym, total_amount, gross_profit, margin_pct,
  CAST(total_amount - LAG(total_amount) OVER w AS DOUBLE) / CAST(LAG(total_amount) OVER w AS DOUBLE) * 100.0 AS sales_growth_pct,
  CAST(gross_profit - LAG(gross_profit) OVER w AS DOUBLE) / CAST(LAG(gross_profit) OVER w AS DOUBLE) * 100.0 AS profit_growth_pct,
  margin_pct - LAG(margin_pct) OVER w AS margin_change
FROM monthly WINDOW w AS (ORDER BY ym)""",
    "e16_month_day_matrix": """
SELECT ym, DAY(order_date) AS day, SUM(total_amount) AS sales FROM orders_once GROUP BY 1, 2""",
    "e17_rank_sold_products": f"""
WITH t AS (
  SELECT product_code, product_name, SUM(quantity) AS total_quantity, SUM(subtotal) AS total_amount, {_period_sums('ym', months=ALL_MONTHS)}
  FROM lines GROUP BY product_code, product_name)
SELECT ROW_NUMBER() OVER (ORDER BY total_amount DESC, t.product_code, t.product_name) AS rank, t.*,
  COALESCE(stock, 0) AS stock, COALESCE(vendor_short, 'N/A') AS vendor_short
FROM t LEFT JOIN stock s ON s.product_code = t.product_code""",
    "e18_top_n_products": _TOP50,
    "e19_all_sku_sales": f"""
WITH t AS (
  SELECT product_code, SUM(quantity) AS q, SUM(subtotal) AS a, {_period_sums('ym', months=ALL_MONTHS)} FROM lines GROUP BY product_code)
SELECT ROW_NUMBER() OVER (ORDER BY COALESCE(a, 0) DESC, s.product_code) AS rank, s.product_code, s.product_name, stock,
  COALESCE(vendor_short, 'N/A') AS vendor_short, COALESCE(q, 0) AS sales_quantity, COALESCE(a, 0) AS sales_amount,
  {_period_names('COALESCE({}, 0)', ALL_MONTHS)}
FROM stock s LEFT JOIN t ON s.product_code = t.product_code""",
    "e20_inventory_kpis": """
SELECT COUNT(*) AS skus, CAST(SUM(on_hand) AS BIGINT) AS total_stock,
  CAST(SUM(on_hand * unit_cost) AS DECIMAL(38,4)) AS stock_value,
  COUNT(*) FILTER (WHERE on_hand > 0 AND on_hand < safety_stock) AS low_stock FROM inv""",
    "e21_category_counts": "SELECT category_major, COUNT(*) AS skus FROM inv GROUP BY category_major",
    "e22_top_vendors": """
SELECT vendor_short, COUNT(*) AS skus FROM inv WHERE vendor_short IS NOT NULL
GROUP BY vendor_short ORDER BY skus DESC, vendor_short LIMIT 20""",
    "e23_coverage_counts": """
SELECT (SELECT COUNT(*) FROM orders_once) AS orders, (SELECT COUNT(DISTINCT ym) FROM orders_once) AS months,
  (SELECT COUNT(*) FROM sales WHERE product_code IS NOT NULL) AS lines, COUNT(*) AS skus,
  COUNT(*) FILTER (WHERE quantity > 0) AS skus_with_sales,
  COUNT(*) FILTER (WHERE COALESCE(quantity, 0) = 0) AS skus_without_sales,
  COUNT(*) FILTER (WHERE COALESCE(quantity, 0) = 0 AND stock > 0) AS unsold_with_stock
FROM stock LEFT JOIN summary USING (product_code)""",
    "e24_largest_orders": """
SELECT order_no, total_amount FROM orders_once ORDER BY total_amount DESC, order_no LIMIT 5""",
    "e24_order_total": "SELECT SUM(total_amount) AS total_amount FROM orders_once",
    "e25_sample_values": """
SELECT total_amount, gross_profit FROM orders_once ORDER BY MD5('7|' || order_no), order_no LIMIT 5""",
    "e26_duplicate_keys": """
SELECT order_no, COUNT(*) AS n FROM gapped WHERE order_no IS NOT NULL GROUP BY order_no HAVING COUNT(*) > 1""",
    "e26_dedup_totals": """
SELECT COUNT(*) AS rows_before, SUM(total_amount) AS total_before, (SELECT COUNT(*) FROM gapped_once) AS rows_after,
  (SELECT SUM(total_amount) FROM gapped_once) AS total_after FROM gapped WHERE order_no IS NOT NULL""",
}

_JOINS = {
    "f1_add_stock": _SUMMARY.format(more="").replace(
        "SELECT product_code,", "SELECT product_code, (SELECT COALESCE(MAX(stock), 0) FROM stock s WHERE s.product_code = sales.product_code) AS stock,", 1
    ),
    "f2_compare_stock": """
SELECT product_code, quantity, COALESCE(stock, 0) AS stock, COALESCE(stock, 0) - quantity AS stock_diff
FROM summary LEFT JOIN stock USING (product_code)""",
    "f2_compare_stock_expand": """
SELECT m.product_code, quantity, COALESCE(on_hand, 0) AS stock, COALESCE(on_hand, 0) - quantity AS stock_diff
FROM summary m LEFT JOIN inv i ON m.product_code = i.product_code""",
    "f2_compare_totals": """
SELECT COUNT(*) AS products, COUNT(*) FILTER (WHERE s > 0) AS matched, COUNT(*) FILTER (WHERE s > 0 AND s >= quantity) AS enough,
  COUNT(*) FILTER (WHERE s > 0 AND s < quantity) AS short, COUNT(*) FILTER (WHERE s <= 0) AS unmatched
FROM (SELECT quantity, COALESCE(stock, 0) AS s FROM summary LEFT JOIN stock USING (product_code))""",
    "f3_add_vendor": """
SELECT s.product_code, s.subtotal, COALESCE(stock, 0) AS stock, COALESCE(vendor_short, 'N/A') AS vendor_short
FROM (SELECT product_code, SUM(subtotal) AS subtotal FROM sales GROUP BY product_code) s
LEFT JOIN stock t ON s.product_code = t.product_code""",
    "f4_unsold_stock": _UNSOLD,
    "f4_unsold_totals": """
WITH x AS (
  SELECT *, on_hand > 0 AND product_code NOT IN (SELECT product_code FROM month_lines) AS u FROM inv)
SELECT COUNT(*) AS skus, COUNT(*) FILTER (WHERE u) AS unsold_skus,
  CAST(SUM(CASE WHEN u THEN on_hand * unit_cost ELSE 0 END) AS DECIMAL(38,4)) AS unsold_value,
  CAST(COUNT(*) FILTER (WHERE u) AS DOUBLE) / COUNT(*) * 100.0 AS unsold_share_pct FROM x""",
    "f5_inventory_with_sales": """
SELECT row_no, i.product_code, on_hand, COALESCE(quantity, 0) AS sales_quantity,
  COALESCE(unit_price_by_qty, 0) AS sales_unit_price, COALESCE(subtotal, 0) AS sales_subtotal
FROM inv i LEFT JOIN summary m ON i.product_code = m.product_code""",
    "f6_inventory_with_period_sales": f"""
WITH t AS (SELECT product_code, {_period_sums('period')} FROM sales GROUP BY product_code)
SELECT row_no, i.product_code, {_period_names('COALESCE({}, 0)')}
FROM inv i LEFT JOIN t ON i.product_code = t.product_code""",
    "f7_attach_months": f"""
WITH t AS (
  SELECT product_code, product_name, SUM(quantity) AS total_quantity, SUM(subtotal) AS total_amount, {_period_sums('ym', months=ALL_MONTHS)}
  FROM lines GROUP BY product_code, product_name)
SELECT ROW_NUMBER() OVER (ORDER BY total_amount DESC, product_code, product_name) AS rank, t.* FROM t""",
}


def _with_base(text: str) -> str:
    body = text.strip()
    # A query with its own CTEs continues the shared list.
    return _BASE + (", " + body[len("WITH "):] if body.startswith("WITH ") else body)


ORACLE: dict[str, str] = {
    name: _with_base(text)
    for group in (_READ, _CLEAN, _HIERARCHY, _FILTERS, _METRICS, _JOINS)
    for name, text in group.items()
}
