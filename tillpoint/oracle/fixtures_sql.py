"""DuckDB SQL for the canonical tables (the oracle's own copy of the mapping).

Written independently of the Spark code in ``tillpoint.sources.fixtures`` /
``tillpoint.plans.ledger``; both follow FIXTURES.md §3. The driver registers
the raw test tables as views; every oracle query starts with these CTEs.
"""

from __future__ import annotations

FIXTURE_CTES: list[tuple[str, str]] = [
    ("part_pricing", """
SELECT p_partkey, p_name, p_brand, p_type, p_size,
       CAST(ROUND(p_retailprice * 100) AS BIGINT) AS mrp_c,
       (CAST(ROUND(p_retailprice * 100) AS BIGINT) * (28 + p_size % 20)) // 100 AS cost_c
FROM part"""),
    ("geo", """
SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    ("supplier_region", """
SELECT s_suppkey, s_name, r_name FROM supplier JOIN geo ON s_nationkey = n_nationkey"""),
    ("dim_products", """
SELECT p_partkey AS product_id,
       p_name AS product_name,
       CASE p_type WHEN 'PROMO' THEN 'Footwear' WHEN 'LARGE' THEN 'Dresses' WHEN 'ECONOMY' THEN 'Outerwear'
                   WHEN 'MEDIUM' THEN 'Tops' WHEN 'SMALL' THEN 'Bottoms' WHEN 'STANDARD' THEN 'Accessories' END AS category,
       p_type AS sub_category,
       p_brand AS brand,
       CASE p_partkey % 4 WHEN 0 THEN 'Men' WHEN 1 THEN 'Women' WHEN 2 THEN 'Unisex' ELSE 'Kids' END AS gender,
       CAST(cost_c * 0.01 AS DECIMAL(10,2)) AS cost_price,
       CAST(mrp_c * 0.01 AS DECIMAL(10,2)) AS mrp,
       CASE p_size % 4 WHEN 0 THEN 'Festive' WHEN 1 THEN 'Winter' WHEN 2 THEN 'Summer' ELSE 'Monsoon' END AS season,
       DATE '1995-01-01' + CAST(p_partkey % 180 AS INTEGER) AS launch_date,
       'SUP-' || lpad(CAST(p_partkey % 40 AS VARCHAR), 3, '0') AS supplier_code,
       CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE 'Vendor ' || CAST(p_partkey % 40 AS VARCHAR) END AS supplier_name,
       CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE split_part(p_name, ' ', 1) END AS color,
       CASE p_size % 5 WHEN 0 THEN 'hero' WHEN 1 THEN 'core' WHEN 2 THEN 'core' WHEN 3 THEN 'slow' ELSE 'dead' END AS heat_score
FROM part_pricing"""),
    ("dim_stores", """
SELECT s_suppkey AS store_id,
       s_name AS store_name,
       r_name AS region,
       CASE s_suppkey % 3 WHEN 0 THEN 'In-Store' WHEN 1 THEN 'Online' ELSE 'Omnichannel' END AS channel,
       CAST(1200 + (s_suppkey * 131) % 6800 AS INTEGER) AS store_size_sqft,
       DATE '1990-01-01' + CAST(s_suppkey % 1500 AS INTEGER) AS opening_date,
       CAST(NULL AS VARCHAR) AS store_manager,
       CAST((8000000 + (s_suppkey * 7919) % 52000000) * 0.01 AS DECIMAL(12,2)) AS monthly_rent_inr,
       CASE WHEN s_suppkey % 12 = 0 THEN NULL ELSE 'store' || CAST(s_suppkey AS VARCHAR) || '@retail.test' END AS contact_email
FROM supplier_region"""),
    ("dim_customers", """
SELECT c_custkey AS customer_id,
       c_name AS customer_name,
       CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 'c' || CAST(c_custkey AS VARCHAR) || '@mail.test' END AS email,
       CASE WHEN c_custkey % 25 = 0 THEN NULL ELSE '+91-' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS phone,
       n_name AS city,
       r_name AS region,
       CASE c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Other' END AS gender,
       CASE c_custkey % 5 WHEN 0 THEN '18-24' WHEN 1 THEN '25-34' WHEN 2 THEN '35-44' WHEN 3 THEN '45-54' ELSE '55+' END AS age_group,
       CASE WHEN c_acctbal < 1700 THEN 'Bronze' WHEN c_acctbal < 4300 THEN 'Silver'
            WHEN c_acctbal < 7350 THEN 'Gold' ELSE 'Platinum' END AS loyalty_tier,
       DATE '1992-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS registration_date,
       CASE c_custkey % 3 WHEN 0 THEN 'In-Store' WHEN 1 THEN 'Online' ELSE 'Omnichannel' END AS preferred_channel
FROM customer JOIN geo ON c_nationkey = n_nationkey"""),
    ("txn_lines0", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, l_linestatus, l_shipdate,
       o_custkey, o_orderdate, o_orderpriority, mrp_c, cost_c, sr.r_name AS store_region,
       CASE WHEN l_orderkey % 200 = 1 THEN 75 ELSE CAST(ROUND(l_discount * 100) AS BIGINT) * 5 END AS dp,
       CAST(l_quantity AS INTEGER) AS qty
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN part_pricing ON l_partkey = p_partkey
LEFT JOIN supplier_region sr ON l_suppkey = sr.s_suppkey"""),
    ("txn_lines1", """
SELECT *,
       CASE WHEN l_orderkey % 200 = 0 THEN (mrp_c * 110) // 100
            WHEN l_orderkey % 200 = 2 THEN (cost_c * 40) // 100
            ELSE (mrp_c * (100 - dp)) // 100 END AS up_c
FROM txn_lines0"""),
    ("txn_lines", """
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                 CAST(l_suppkey AS VARCHAR), strftime(CAST(l_shipdate AS DATE), '%Y%m%d')) AS transaction_id,
       CAST(o_orderdate AS DATE) AS transaction_date,
       CASE WHEN l_orderkey % 14 = 0 THEN NULL ELSE o_custkey END AS customer_id,
       CASE WHEN l_orderkey % 400 = 399 THEN -l_partkey ELSE l_partkey END AS product_id,
       CASE WHEN l_orderkey % 60 = 59 THEN -l_suppkey ELSE l_suppkey END AS store_id,
       qty AS quantity,
       CAST(up_c * 0.01 AS DECIMAL(10,2)) AS unit_price,
       CAST(dp * 0.01 AS DECIMAL(5,2)) AS discount_pct,
       CAST((up_c * qty - CASE l_orderkey % 50 WHEN 0 THEN 70000 WHEN 1 THEN 25000 WHEN 2 THEN 5000
                                              WHEN 3 THEN -5000 ELSE 0 END) * 0.01 AS DECIMAL(12,2)) AS revenue,
       CAST(cost_c * qty * 0.01 AS DECIMAL(12,2)) AS cost,
       CASE WHEN l_orderkey % 25 = 0 THEN NULL ELSE o_orderpriority END AS payment_method,
       CASE (l_orderkey + l_linenumber) % 3 WHEN 0 THEN 'In-Store' WHEN 1 THEN 'Online' ELSE 'Omnichannel' END AS channel,
       store_region AS region,
       up_c * qty - CASE l_orderkey % 50 WHEN 0 THEN 70000 WHEN 1 THEN 25000 WHEN 2 THEN 5000
                                         WHEN 3 THEN -5000 ELSE 0 END AS rev_c,
       l_orderkey, l_linenumber, l_returnflag, l_linestatus
FROM txn_lines1"""),
    ("fact_transactions", """
SELECT transaction_id, transaction_date, customer_id, product_id, store_id, quantity, unit_price, discount_pct,
       revenue, cost, payment_method, channel, region
FROM txn_lines
UNION ALL
SELECT transaction_id, transaction_date, customer_id, product_id, store_id, quantity, unit_price, discount_pct,
       revenue, cost, payment_method, channel, region
FROM txn_lines WHERE (l_orderkey * 7 + l_linenumber) % 67 = 0"""),
    ("fact_returns", """
SELECT 'R-' || transaction_id AS return_id,
       CASE WHEN l_orderkey % 101 = 0 THEN 'X' || transaction_id ELSE transaction_id END AS transaction_id,
       product_id, customer_id, store_id,
       transaction_date + CAST(CASE WHEN l_orderkey % 97 = 0 THEN -3 WHEN l_orderkey % 97 = 1 THEN 120
                                    ELSE l_linenumber * 5 END AS INTEGER) AS return_date,
       CASE (l_orderkey + l_linenumber) % 7 WHEN 0 THEN 'Size issue' WHEN 1 THEN 'Quality defect'
            WHEN 2 THEN 'Wrong item' WHEN 3 THEN 'Changed mind' WHEN 4 THEN 'Damaged in transit'
            WHEN 5 THEN 'Colour mismatch' ELSE 'Late delivery' END AS return_reason,
       quantity AS quantity_returned,
       CAST(((rev_c * (85 + l_orderkey % 15)) // 100) * 0.01 AS DECIMAL(12,2)) AS refund_amount,
       CAST(((rev_c * 8) // 100) * 0.01 AS DECIMAL(10,2)) AS restocking_cost,
       (l_orderkey % 7 >= 2) AS resaleable
FROM txn_lines
WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND customer_id IS NOT NULL"""),
    ("inv_ship", """
SELECT l_partkey AS product_id, 1 + l_suppkey % 5 AS store_id,
       CAST(1 + (date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) // 7) % 26 AS INTEGER) AS week_number,
       SUM(CAST(l_quantity AS INTEGER)) AS units
FROM lineitem
GROUP BY 1, 2, 3"""),
    ("inv_weekly", """
SELECT g.product_id, g.p_size, g.store_id, g.week_number, CAST(COALESCE(s.units, 0) AS INTEGER) AS units_sold
FROM (SELECT p_partkey AS product_id, p_size, st.store_id, wk.week_number
      FROM part, range(1, 6) st(store_id), range(1, 27) wk(week_number)) g
LEFT JOIN inv_ship s ON g.product_id = s.product_id AND g.store_id = s.store_id AND g.week_number = s.week_number"""),
    ("inv_initial", """
SELECT product_id, store_id,
       CAST(SUM(units_sold) + 5 + (ANY_VALUE(p_size) * 11 + store_id * 17) % 180 AS INTEGER) AS initial_stock
FROM inv_weekly GROUP BY product_id, store_id"""),
    ("inv_ledger0", """
SELECT w.product_id, w.store_id, w.week_number, w.units_sold, i.initial_stock, p.mrp, p.cost_price,
       COALESCE(SUM(w.units_sold) OVER (PARTITION BY w.product_id, w.store_id ORDER BY w.week_number
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sold_before
FROM inv_weekly w
JOIN inv_initial i ON w.product_id = i.product_id AND w.store_id = i.store_id
JOIN dim_products p ON w.product_id = p.product_id"""),
    ("inv_ledger1", """
SELECT *, initial_stock - sold_before AS opening_stock,
       initial_stock - sold_before - units_sold AS closing_stock,
       CAST(CASE WHEN MAX(CASE WHEN week_number >= 9 AND sold_before * 100 < 35 * initial_stock THEN 1 ELSE 0 END)
                 OVER (PARTITION BY product_id, store_id ORDER BY week_number
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1
                 THEN 0.25 ELSE 0 END AS DECIMAL(5,2)) AS markdown_pct
FROM inv_ledger0"""),
    ("inv_ledger2", """
SELECT *, CAST(ROUND(mrp * (1 - markdown_pct), 2) AS DECIMAL(10,2)) AS effective_price FROM inv_ledger1"""),
    ("fact_inventory", """
SELECT 'INV-' || CAST(product_id AS VARCHAR) || '-' || CAST(store_id AS VARCHAR) || '-' || CAST(week_number AS VARCHAR) AS inventory_id,
       product_id, store_id, CAST(week_number AS INTEGER) AS week_number,
       DATE '1995-01-02' + CAST((week_number - 1) * 7 AS INTEGER) AS week_date,
       CAST(opening_stock AS INTEGER) AS opening_stock,
       units_sold,
       CAST(closing_stock AS INTEGER) AS closing_stock,
       CAST(CASE WHEN (product_id + week_number) % 33 = 0 THEN -closing_stock ELSE closing_stock END AS INTEGER) AS closing_stock_reported,
       CAST((week_number - 1) * 7 AS INTEGER) AS days_on_shelf,
       markdown_pct,
       effective_price,
       CAST(ROUND(CAST((CAST(effective_price AS DOUBLE) - CAST(cost_price AS DOUBLE))
                       / CAST(NULLIF(effective_price, 0) AS DOUBLE) * 100.0 AS DECIMAL(38,6)), 2) AS DECIMAL(7,2)) AS gross_margin_pct,
       CAST(units_sold * effective_price AS DECIMAL(12,2)) AS revenue
FROM inv_ledger2"""),
    ("fact_markdown_events", """
SELECT 'MD-' || lpad(CAST(ROW_NUMBER() OVER (ORDER BY product_id) AS VARCHAR), 5, '0') AS markdown_id,
       product_id, store_id,
       week_date AS markdown_date, week_number AS markdown_week, markdown_pct,
       days_on_shelf AS days_on_shelf_at_md, opening_stock AS stock_at_markdown,
       CAST(ROUND(CAST(1.0 - CAST(opening_stock AS DOUBLE) / 150.0 AS DECIMAL(38,6)), 4) AS DECIMAL(7,4)) AS sell_through_at_md,
       'Auto-trigger' AS approved_by, 'Slow-mover' AS markdown_type
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY store_id, week_number) AS rn
      FROM fact_inventory WHERE markdown_pct > 0) x
WHERE rn = 1"""),
    ("vw_clean_transactions", """
SELECT transaction_id, transaction_date, customer_id, product_id, store_id, quantity, unit_price, discount_pct,
       revenue, cost, payment_method, channel, region
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY transaction_date, product_id, customer_id, revenue
                                   ORDER BY transaction_id) AS rn
      FROM fact_transactions) x
WHERE rn = 1 AND revenue > 0 AND quantity > 0"""),
    ("fact_sales_targets", """
SELECT 'TGT-' || CAST(s.store_id AS VARCHAR) || '-' || m.month AS target_id,
       s.store_id, m.month, CAST(NULL AS VARCHAR) AS category,
       CAST(90000 + (s.store_id * 37 + m.m * 13) % 80000 AS DECIMAL(14,2)) AS target_revenue,
       CAST(COALESCE(a.actual, 0) AS DECIMAL(14,2)) AS actual_revenue,
       CAST((90000 + (s.store_id * 37 + m.m * 13) % 80000) // 900 AS INTEGER) AS target_units,
       CAST(TRUNC(COALESCE(a.actual, 0) / 900) AS INTEGER) AS actual_units,
       CAST(ROUND(CAST(CAST(COALESCE(a.actual, 0) AS DOUBLE)
                       / CAST(90000 + (s.store_id * 37 + m.m * 13) % 80000 AS DOUBLE) * 100.0 AS DECIMAL(38,6)), 2)
            AS DECIMAL(8,2)) AS attainment_pct
FROM dim_stores s
CROSS JOIN (SELECT m, strftime(first_month + to_months(CAST(m AS INTEGER)), '%Y-%m') AS month
            FROM (SELECT CAST(date_trunc('month', MIN(transaction_date)) AS DATE) AS first_month,
                         UNNEST(range(0, 1 + date_diff('month', date_trunc('month', MIN(transaction_date)),
                                                       date_trunc('month', MAX(transaction_date))))) AS m
                  FROM vw_clean_transactions) span) m
LEFT JOIN (SELECT store_id, strftime(transaction_date, '%Y-%m') AS month, SUM(revenue) AS actual
           FROM vw_clean_transactions GROUP BY 1, 2) a
       ON a.store_id = s.store_id AND a.month = m.month"""),
]

FIXTURE_NAMES = [n for n, _ in FIXTURE_CTES]


def with_fixtures(ctes: list[tuple[str, str]], final: str) -> str:
    """Full oracle query: fixture CTEs, then the job's own CTEs, then the final SELECT."""
    parts = [f"{name} AS ({body.strip()})" for name, body in FIXTURE_CTES + list(ctes)]
    return "WITH " + ",\n".join(parts) + "\n" + final.strip()
