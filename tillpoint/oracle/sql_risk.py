"""Oracle SQL (DuckDB) for the return-risk jobs (J37-J42, J44-J47 on the rule score)."""

from __future__ import annotations

from tillpoint.functions import labels as L
from tillpoint.oracle.fixtures_sql import with_fixtures
from tillpoint.oracle.sql_audit_sales import D, I, RUP, q
from tillpoint.params import TESTDATA_PARAMS as P


def _score_terms() -> str:
    h = lambda x: int(round(x * 100))
    t = [str(h(L.RISK_BASE))]
    t += [f"CASE WHEN category = {q(c)} THEN {h(w)} ELSE 0 END" for c, w in L.RISK_CATEGORY_WEIGHTS]
    t += [f"CASE WHEN discount_pct > {lim:.2f} THEN {h(w)} ELSE 0 END" for lim, w in L.RISK_DISCOUNT_WEIGHTS]
    t.append(f"CASE WHEN quantity >= {L.RISK_QUANTITY_AT_LEAST} THEN {h(L.RISK_QUANTITY_WEIGHT)} ELSE 0 END")
    t.append(f"CASE WHEN heat_score = {q(L.RISK_DEAD_HEAT)} THEN {h(L.RISK_DEAD_WEIGHT)} ELSE 0 END")
    t.append(f"CASE WHEN channel = {q(L.RISK_ONLINE_CHANNEL)} THEN {h(L.RISK_ONLINE_WEIGHT)} ELSE 0 END")
    return " + ".join(t)


SEED = P.label_seed
FEATURES_NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in L.MODEL_FEATURES)

RISK_CTES = [("feat", """
SELECT t.transaction_id, t.transaction_date, t.product_id, p.category, p.heat_score, t.channel, t.quantity,
       t.unit_price, t.discount_pct,
       CAST(t.unit_price AS DOUBLE) / CAST(NULLIF(p.mrp, 0) AS DOUBLE) AS price_ratio,
       t.unit_price - p.cost_price AS margin_per_unit,
       isodow(t.transaction_date) - 1 AS day_of_week,
       CASE WHEN isodow(t.transaction_date) - 1 IN (5, 6) THEN 1 ELSE 0 END AS is_weekend,
       CASE WHEN month(t.transaction_date) IN (10, 11) THEN 1 ELSE 0 END AS is_festive
FROM vw_clean_transactions t LEFT JOIN dim_products p ON t.product_id = p.product_id"""),
    ("prob", f"""
SELECT *, CAST(({_score_terms()}) * 0.01 AS DECIMAL(5,2)) AS return_prob FROM feat"""),
    ("lab", f"""
SELECT *, CASE WHEN CAST(('0x' || substr(md5(transaction_id || ':{SEED}'), 1, 8))::BIGINT AS DOUBLE)
                    / 4294967296.0::DOUBLE < CAST(return_prob AS DOUBLE) THEN 1 ELSE 0 END AS is_returned
FROM prob"""),
    ("enc", f"""
SELECT *, DENSE_RANK() OVER (ORDER BY COALESCE(category, {q(L.ENCODER_FILLS['category'])})) - 1 AS cat_encoded,
          DENSE_RANK() OVER (ORDER BY COALESCE(channel, {q(L.ENCODER_FILLS['channel'])})) - 1 AS ch_encoded,
          DENSE_RANK() OVER (ORDER BY COALESCE(heat_score, {q(L.ENCODER_FILLS['heat_score'])})) - 1 AS heat_encoded
FROM lab"""),
    ("frame", f"SELECT * FROM enc WHERE {FEATURES_NOT_NULL}"),
    ("sp", f"""
SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY is_returned ORDER BY md5(transaction_id || ':split:{SEED}'),
                                       transaction_id)
                    <= ROUND({P.train_fraction} * COUNT(*) OVER (PARTITION BY is_returned)) THEN 'train'
               ELSE 'test' END AS split
FROM frame"""),
    ("test", f"""
SELECT transaction_id, is_returned, CAST(return_prob AS DOUBLE) AS score,
       CASE WHEN CAST(return_prob AS DOUBLE) >= {P.predict_threshold}::DOUBLE THEN 1 ELSE 0 END AS prediction
FROM sp WHERE split = 'test'"""),
    ("sc", """
SELECT score, SUM(is_returned) AS pos, SUM(1 - is_returned) AS neg FROM test GROUP BY score""")]

FEATURE_COLS = f"""transaction_id, CAST(transaction_date AS VARCHAR) AS transaction_date, product_id, category,
       heat_score, channel, {I('quantity')} AS quantity, {D('unit_price')} AS unit_price,
       {D('discount_pct')} AS discount_pct, price_ratio, {D('margin_per_unit')} AS margin_per_unit,
       {I('day_of_week')} AS day_of_week, {I('is_weekend')} AS is_weekend, {I('is_festive')} AS is_festive"""

RETURN_FEATURES = with_fixtures(RISK_CTES, f"SELECT {FEATURE_COLS} FROM feat")
RETURN_PROBABILITY = with_fixtures(RISK_CTES, f"SELECT {FEATURE_COLS}, {D('return_prob')} AS return_prob FROM prob")
RETURN_LABEL = with_fixtures(RISK_CTES, f"""
SELECT {FEATURE_COLS}, {D('return_prob')} AS return_prob, {I('is_returned')} AS is_returned FROM lab""")
CATEGORICAL_INDEX = with_fixtures(RISK_CTES, f"""
SELECT {FEATURE_COLS}, {D('return_prob')} AS return_prob, {I('is_returned')} AS is_returned,
       {I('cat_encoded')} AS cat_encoded, {I('ch_encoded')} AS ch_encoded, {I('heat_encoded')} AS heat_encoded
FROM enc""")
MODEL_FRAME = with_fixtures(RISK_CTES, f"""
SELECT {I('COUNT(*)')} AS rows, {I('SUM(is_returned)')} AS returned,
       {D(RUP('CAST(SUM(is_returned) AS DOUBLE) / CAST(NULLIF(COUNT(*), 0) AS DOUBLE) * 100.0::DOUBLE', 2))} AS return_rate_pct
FROM frame""")
SPLIT = with_fixtures(RISK_CTES, f"""
SELECT transaction_id, {I('is_returned')} AS is_returned, split FROM sp""")

ROC = with_fixtures(RISK_CTES + [("g2", """
SELECT *, COALESCE(SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
FROM sc""")], f"""
SELECT {I('SUM(pos)')} AS positives, {I('SUM(neg)')} AS negatives,
       SUM(CAST(pos AS DOUBLE) * (CAST(neg_below AS DOUBLE) + 0.5::DOUBLE * CAST(neg AS DOUBLE)))
       / (CAST(NULLIF(SUM(pos), 0) AS DOUBLE) * CAST(NULLIF(SUM(neg), 0) AS DOUBLE)) AS roc_auc
FROM g2""")


def _div(a, b):
    return f"(CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / CAST(NULLIF({b}, 0) AS DOUBLE) ELSE 0.0::DOUBLE END)"


def _f1(p, r):
    return f"(CASE WHEN {p} + {r} > 0 THEN 2.0::DOUBLE * {p} * {r} / ({p} + {r}) ELSE 0.0::DOUBLE END)"


REPORT = with_fixtures(RISK_CTES + [("cm", """
SELECT SUM(CASE WHEN is_returned = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp,
       SUM(CASE WHEN is_returned = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS fp,
       SUM(CASE WHEN is_returned = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS fn,
       SUM(CASE WHEN is_returned = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS tn
FROM test"""), ("m", f"""
SELECT {_div('tn', 'tn + fn')} AS p0, {_div('tn', 'tn + fp')} AS r0, tn + fp AS s0,
       {_div('tp', 'tp + fp')} AS p1, {_div('tp', 'tp + fn')} AS r1, tp + fn AS s1,
       {_div('tp + tn', 'tp + fp + fn + tn')} AS acc, tp + fp + fn + tn AS n
FROM cm"""), ("m2", f"""
SELECT *, {_f1('p0', 'r0')} AS f0, {_f1('p1', 'r1')} AS f1,
       CAST(s0 AS DOUBLE) / CAST(NULLIF(n, 0) AS DOUBLE) AS w0, CAST(s1 AS DOUBLE) / CAST(NULLIF(n, 0) AS DOUBLE) AS w1
FROM m""")], f"""
SELECT {q(L.CLASS_NAMES[0])} AS class_label, {D(RUP('p0', 4))} AS precision, {D(RUP('r0', 4))} AS recall,
       {D(RUP('f0', 4))} AS f1_score, {I('s0')} AS support FROM m2
UNION ALL SELECT {q(L.CLASS_NAMES[1])}, {D(RUP('p1', 4))}, {D(RUP('r1', 4))}, {D(RUP('f1', 4))}, {I('s1')} FROM m2
UNION ALL SELECT 'accuracy', NULL, NULL, {D(RUP('acc', 4))}, {I('n')} FROM m2
UNION ALL SELECT 'macro avg', {D(RUP('(p0 + p1) / 2', 4))}, {D(RUP('(r0 + r1) / 2', 4))},
                 {D(RUP('(f0 + f1) / 2', 4))}, {I('n')} FROM m2
UNION ALL SELECT 'weighted avg', {D(RUP('p0 * w0 + p1 * w1', 4))}, {D(RUP('r0 * w0 + r1 * w1', 4))},
                 {D(RUP('f0 * w0 + f1 * w1', 4))}, {I('n')} FROM m2""")

PR_CURVE = with_fixtures(RISK_CTES + [("c", """
SELECT score, SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
       SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
       SUM(pos) OVER () AS p
FROM sc""")], f"""
SELECT score AS threshold, {I('tp')} AS tp, {I('fp')} AS fp,
       {D(RUP('CAST(tp AS DOUBLE) / CAST(NULLIF(tp + fp, 0) AS DOUBLE)', 6))} AS precision,
       {D(RUP('CAST(tp AS DOUBLE) / CAST(NULLIF(p, 0) AS DOUBLE)', 6))} AS recall
FROM c""")


def _threshold_sql() -> str:
    parts = []
    for t in P.thresholds:
        tp = f"SUM(CASE WHEN score >= {t}::DOUBLE AND is_returned = 1 THEN 1 ELSE 0 END)"
        fp = f"SUM(CASE WHEN score >= {t}::DOUBLE AND is_returned = 0 THEN 1 ELSE 0 END)"
        fn = f"SUM(CASE WHEN NOT (score >= {t}::DOUBLE) AND is_returned = 1 THEN 1 ELSE 0 END)"
        parts.append(f"""SELECT {t}::DOUBLE AS threshold, {D(RUP(_div(tp, f'{tp} + {fp}'), 4))} AS precision,
       {D(RUP(_div(tp, f'{tp} + {fn}'), 4))} AS recall, {I(f'{tp} + {fp}')} AS flagged FROM test""")
    return with_fixtures(RISK_CTES, "\nUNION ALL\n".join(parts))


SQL = {
    "return_features": RETURN_FEATURES,
    "return_probability": RETURN_PROBABILITY,
    "return_label": RETURN_LABEL,
    "categorical_index": CATEGORICAL_INDEX,
    "model_frame": MODEL_FRAME,
    "stratified_split": SPLIT,
    "roc_auc": ROC,
    "classification_report": REPORT,
    "pr_curve": PR_CURVE,
    "threshold_table": _threshold_sql(),
}
