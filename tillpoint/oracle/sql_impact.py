"""Oracle SQL (DuckDB) for the impact scenarios (J49), the summary (J50), the row counts
of the published outputs (J51) and the CSV round trip. The summary and the counts are
selected from the other jobs' own statements."""

from __future__ import annotations

from tillpoint.functions import labels as L
from tillpoint.oracle.fixtures_sql import with_fixtures
from tillpoint.oracle import sql_audit_sales as SALES
from tillpoint.oracle.sql_audit_sales import D, I, MEAN, MONTHLY_TREND, RUP, q
from tillpoint.oracle.sql_customers import QCUT_CTES, RFM_SEGMENT_SUMMARY, RFM_SEGMENT_TABLE, segment_case
from tillpoint.oracle.sql_inventory_returns import DEAD_CTE, DEAD_FILTER, DEAD_STOCK, RETURN_LOSS
from tillpoint.oracle.sql_risk import RETURN_LABEL, ROC
from tillpoint.params import TESTDATA_PARAMS as P
from tillpoint.sources import schemas as SC

AT_RISK = q(L.PANDAS_SEGMENTS[3])
MD = 1.0 - P.markdown_discount

IMPACT = with_fixtures([DEAD_CTE] + QCUT_CTES + [
    ("s1", f"""
SELECT COUNT(*) AS dead_stock_skus, {MEAN('mrp')} AS avg_mrp, {MEAN('cost_price')} AS avg_cost,
       SUM(closing_stock) AS dead_units, SUM(closing_stock * cost_price) AS stranded_value_inr
FROM dead WHERE {DEAD_FILTER}"""),
    ("segs", f"SELECT *, {segment_case(L.PANDAS_SEGMENTS)} AS segment FROM rq2"),
    ("s2", f"""
SELECT COUNT(CASE WHEN segment = {AT_RISK} THEN 1 END) AS at_risk_customers,
       {MEAN(f'CASE WHEN segment = {AT_RISK} THEN monetary END')} AS ltv,
       SUM(CASE WHEN segment = {AT_RISK} THEN monetary END) AS at_risk_revenue
FROM segs"""),
    ("s3", """
SELECT COALESCE((SELECT SUM(refund_amount) FROM fact_returns), 0)
     + COALESCE((SELECT SUM(restocking_cost) FROM fact_returns), 0) AS return_revenue_loss"""),
    ("v", f"""
SELECT *, CAST(dead_units AS DOUBLE) * {P.markdown_lift}::DOUBLE AS units,
       COALESCE(ltv, {P.default_churn_ltv}::DOUBLE) AS ltv2
FROM s1, s2, s3""")], f"""
SELECT {I('dead_stock_skus')} AS dead_stock_skus, {D('stranded_value_inr')} AS stranded_value_inr,
       {D(RUP('units', 2))} AS recovered_units,
       {D(RUP(f'units * avg_mrp * {MD}::DOUBLE', 2))} AS recovered_revenue_inr,
       {D(RUP(f'units * (avg_mrp * {MD}::DOUBLE - avg_cost)', 2))} AS recovered_margin_inr,
       {D(RUP(f'CAST(stranded_value_inr AS DOUBLE) * {P.writeoff_avoided}::DOUBLE', 2))} AS avoided_writeoff_inr,
       {I('at_risk_customers')} AS at_risk_customers,
       {D(RUP('ltv2', 2))} AS avg_churn_ltv,
       {D(RUP(f'CAST(at_risk_customers AS DOUBLE) * ltv2 * {P.winback_rate}::DOUBLE', 2))} AS winback_revenue_inr,
       {D('return_revenue_loss')} AS return_revenue_loss,
       {D(RUP(f'CAST(return_revenue_loss AS DOUBLE) * {P.return_reducible}::DOUBLE', 2))} AS return_impact_inr,
       {D(RUP(f'units * (avg_mrp * {MD}::DOUBLE - avg_cost) + CAST(at_risk_customers AS DOUBLE) * ltv2 * {P.winback_rate}::DOUBLE + CAST(return_revenue_loss AS DOUBLE) * {P.return_reducible}::DOUBLE', 2))} AS total_opportunity_inr,
       {D('at_risk_revenue')} AS at_risk_revenue
FROM v""")



def _even(x: str, n: int) -> str:
    return f"ROUND_EVEN(CAST({x} AS DECIMAL(38,6)), {n})"


def _json(statement: str, key: str, value: str) -> str:
    return (f"""(SELECT '{{' || string_agg('"' || {key} || '":' || CAST({value} AS VARCHAR), ',' ORDER BY {key}) || '}}'"""
            f" FROM ({statement}) entries)")


SUMMARY = f"""
SELECT {I(_even('k.total_revenue', 0))} AS total_revenue, k.total_units,
       {D(_even('k.gross_profit / k.total_revenue * 100.0::DOUBLE', 1))} AS gross_margin_pct, k.unique_customers,
       {D(_even('CAST(l.returns AS DOUBLE) / l.clean_transactions * 100.0::DOUBLE', 1))} AS return_rate_pct,
       i.dead_stock_skus, {I(_even('i.stranded_value_inr', 0))} AS stranded_value_inr, i.at_risk_customers,
       {I(_even('COALESCE(i.at_risk_revenue, 0)', 0))} AS at_risk_revenue_inr,
       {I(_even('i.total_opportunity_inr', 0))} AS total_opportunity_inr,
       {I(_even('i.recovered_margin_inr', 0))} AS recovered_margin_inr,
       {I(_even('i.winback_revenue_inr', 0))} AS winback_revenue_inr,
       {D(_even('r.roc_auc', 3))} AS model_roc_auc,
       {D(_even('(f.festive_revenue / f.festive_days) / (f.regular_revenue / f.regular_days)', 1))} AS festive_uplift_x,
       {D(_even('c.top_revenue / c.total_revenue * 100.0::DOUBLE', 1))} AS top2_cat_share_pct,
       a.duplicate_rows AS duplicate_rows_removed, a.negative_stock AS negative_stock_records,
       {_json(SALES.CATEGORY_REVENUE, 'category', I(_even('revenue', 0)))} AS cat_revenue,
       {_json(RFM_SEGMENT_SUMMARY, 'segment', 'customers')} AS rfm_segments
FROM ({SALES.HEADLINE}) k, ({RETURN_LOSS}) l, ({IMPACT}) i, ({ROC}) r, ({SALES.FESTIVE}) f,
     ({SALES.CATEGORY_CONCENTRATION}) c, ({SALES.AUDIT_COUNTERS}) a"""

PUBLISHED = {"rfm_segments": RFM_SEGMENT_TABLE, "dead_stock_skus": DEAD_STOCK, "monthly_revenue": MONTHLY_TREND,
             "category_revenue": SALES.CATEGORY_REVENUE, "labelled_transactions": RETURN_LABEL}
PUBLISH = "\nUNION ALL\n".join(
    [f"SELECT '{name}' AS output, 'csv' AS format, COUNT(*) AS rows FROM ({sql}) t" for name, sql in PUBLISHED.items()]
    + ["SELECT 'impact_summary', 'json', 1"])

# The planted faults of the CSV export, then the declared rules in their order.
_BROKEN = ([(f"NOT NULL {c}", f"{c} IS NULL") for c in SC.not_null_columns("fact_transactions")]
           + [(f"RANGE {r[1]}", f"NOT ({SC.range_rule(*r[1:])})") for r in SC.RANGES if r[0] == "fact_transactions"]
           + [(f"FOREIGN KEY {c}", f"{c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {parent})")
              for child, c, parent, k in SC.FOREIGN_KEYS if child == "fact_transactions"])
REJECTED_ROWS = with_fixtures([("marked", "SELECT *, LEFT(md5(transaction_id), 2) AS mark FROM fact_transactions"),
    ("exported", """
SELECT mark IN ('a0', 'a1') AS malformed, CASE WHEN mark <> 'a6' THEN transaction_id END AS transaction_id, transaction_date,
       customer_id, CASE WHEN mark = 'a4' THEN 999999999 ELSE product_id END AS product_id,
       CASE WHEN mark <> 'a2' THEN store_id END AS store_id,
       CASE WHEN mark = 'a3' THEN -4 WHEN mark = 'a5' THEN 1 ELSE quantity END AS quantity,
       unit_price, discount_pct, revenue, cost, payment_method, channel, region
FROM marked"""), ("judged", f"""
SELECT CASE WHEN malformed THEN ['MALFORMED RECORD'] ELSE list_filter([
         {", ".join(f"CASE WHEN {bad} THEN {q(reason)} END" for reason, bad in _BROKEN)}], lambda r: r IS NOT NULL) END AS reasons
FROM exported""")], f"""
SELECT reason, {I('COUNT(*)')} AS rows FROM (SELECT UNNEST(reasons) AS reason FROM judged) x GROUP BY reason
UNION ALL SELECT 'KEPT ROWS', {I('COUNT(*)')} FROM judged WHERE len(reasons) = 0
UNION ALL SELECT 'REJECTED ROWS', {I('COUNT(*)')} FROM judged WHERE len(reasons) > 0""")

SQL = {
    "impact_scenarios": IMPACT,
    "impact_summary": SUMMARY,
    "rejected_rows": REJECTED_ROWS,
    "publish_outputs": PUBLISH,
    "csv_source_roundtrip": MONTHLY_TREND,
}
