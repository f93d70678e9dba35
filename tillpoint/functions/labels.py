"""Output labels and rule constants.

FIXED VALUES — these strings and numbers must equal the original analyses'
outputs for results to match, so they are stated here plainly, together and
in their natural order. Nothing else in the package restates them.
"""

# --- audit labels -----------------------------------------------------------
NEGATIVE_STOCK_LABEL = "NEGATIVE STOCK ERROR"
PRICE_ABOVE_MRP = "PRICE ABOVE MRP — data error"
PRICE_BELOW_COST = "PRICE BELOW 50% COST — loss-making transaction"
DISCOUNT_OVER_LIMIT = "DISCOUNT > 70% — requires approval check"
ORPHAN_RETURNS = "Returns with no matching transaction"
ORPHAN_TXN_PRODUCT = "Transactions with unknown product"
ORPHAN_TXN_STORE = "Transactions with unknown store"
ORPHAN_INV_PRODUCT = "Inventory rows with unknown product"
RETURN_BEFORE_PURCHASE = "RETURN BEFORE PURCHASE — impossible"
RETURN_OUTSIDE_WINDOW = "RETURN > 90 DAYS — outside policy window"
DQ_METRICS = (
    "Total transactions (raw)",
    "Duplicate transactions removed",
    "Null customer_id (guest checkouts)",
    "Negative stock records flagged",
    "Products with missing supplier",
)

# --- inventory health ---------------------------------------------------------
STATUS_CRITICAL = "CRITICAL — Immediate Markdown"
STATUS_AT_RISK = "AT-RISK — Markdown Within 2 Weeks"
STATUS_WATCH = "WATCH — Monitor Weekly"
STATUS_HEALTHY = "HEALTHY"
CRITICAL_BELOW = 0.20
AT_RISK_BELOW = 0.35
WATCH_UPTO = 0.50
MARKDOWN_CRITICAL = 0.28
MARKDOWN_AT_RISK = 0.20
RECOVERY_SHARE_OF_MRP = 0.72

# --- sell-through cohort ------------------------------------------------------
COHORT_TRIGGER_EARLY = "MARKDOWN TRIGGER — ST below 25% at week 6+"
COHORT_TRIGGER_LATE = "MARKDOWN TRIGGER — ST below 40% at week 10+"
COHORT_ON_TRACK = "ON TRACK"
COHORT_EARLY_PCT, COHORT_EARLY_WEEK = 25, 6
COHORT_LATE_PCT, COHORT_LATE_WEEK = 40, 10

# --- revenue leakage ------------------------------------------------------------
LEAK_HIGH = "HIGH — ₹500+ gap"
LEAK_MEDIUM = "MEDIUM — ₹100-500 gap"
LEAK_LOW = "LOW — ₹1-100 gap"
LEAK_OVERBILLING = "OVERBILLING — customer charged extra"
LEAK_HIGH_ABOVE, LEAK_MEDIUM_ABOVE = 500, 100

# --- seasons (daily sales) -------------------------------------------------------
SEASON_FESTIVE = ("Festive (Oct-Nov)", (10, 11))
SEASON_HOLIDAY = ("Holiday (Dec-Jan)", (12, 1))
SEASON_MONSOON = ("Monsoon (Jul-Aug)", (7, 8))
SEASON_REGULAR = "Regular"

# --- RFM segments: SQL wording, then the pandas wording ---------------------------
SQL_SEGMENTS = (
    "Champions",
    "Loyal Customers",
    "New Customers",
    "At-Risk — High Value",
    "Lost Customers",
    "Big Spenders — Low Frequency",
    "Potential Loyalists",
)
PANDAS_SEGMENTS = (
    "Champions",
    "Loyal Customers",
    "New Customers",
    "At-Risk High Value",
    "Lost Customers",
    "Big Spenders",
    "Potential Loyalists",
)

# Segment rules in order, first match wins: bounds of the r, f and m score (lowest, highest) and
# the number of the name above; None leaves a score open.
SEGMENT_RULES = (
    ((4, None), (4, None), (4, None), 0),
    ((3, None), (3, None), (3, None), 1),
    ((4, None), (None, 2), (None, None), 2),
    ((None, 2), (3, None), (3, None), 3),
    ((None, 2), (None, 2), (None, None), 4),
    ((None, None), (None, 2), (4, None), 5),
    ((None, None), (None, None), (None, None), 6),
)

# --- weekly demand of the stock recurrence ------------------------------------------
DEMAND_DECAY_PER_WEEK = 0.055
MARKDOWN_DEMAND_LIFT = 1.8
MARKDOWN_FROM_WEEKS_LIVE = 9
MARKDOWN_BELOW_SELL_THROUGH = 0.35

# --- churn ------------------------------------------------------------------------
CHURN_HIGH = "HIGH CHURN RISK — Winback Campaign"
CHURN_MEDIUM = "MEDIUM CHURN RISK — Re-engagement"
CHURN_VIP = "VIP — Retention Priority"
CHURN_STANDARD = "STANDARD"
CHURN_RECENT_VS_PREVIOUS = 0.5
WINBACK_SHARE = 0.35

# --- returns ------------------------------------------------------------------------
RETURN_HIGH = "HIGH RETURN — Review Quality"
RETURN_ELEVATED = "ELEVATED — Monitor"
RETURN_NORMAL = "NORMAL"
RETURN_HIGH_ABOVE_PCT, RETURN_ELEVATED_ABOVE_PCT = 15, 8
RETURN_REASONS = (
    "Size issue",
    "Quality defect",
    "Wrong item",
    "Changed mind",
    "Damaged in transit",
    "Colour mismatch",
    "Late delivery",
)

# --- return-risk score: base, then (condition, weight) in the original order ---------
RISK_BASE = 0.05
RISK_CATEGORY_WEIGHTS = (("Footwear", 0.12), ("Dresses", 0.07), ("Outerwear", 0.05))
RISK_DISCOUNT_WEIGHTS = ((0.40, 0.10), (0.25, 0.05))
RISK_QUANTITY_AT_LEAST, RISK_QUANTITY_WEIGHT = 3, 0.08
RISK_DEAD_HEAT, RISK_DEAD_WEIGHT = "dead", 0.06
RISK_ONLINE_CHANNEL, RISK_ONLINE_WEIGHT = "Online", 0.06
WEEKEND_DAYS = (5, 6)  # Monday = 0
ENCODER_FILLS = {"category": "Unknown", "channel": "Unknown", "heat_score": "core"}
MODEL_FEATURES = (
    "quantity",
    "unit_price",
    "discount_pct",
    "price_ratio",
    "margin_per_unit",
    "is_weekend",
    "is_festive",
    "cat_encoded",
    "ch_encoded",
    "heat_encoded",
)
CLASS_NAMES = ("No Return", "Returned")

# --- store / target rule of the original generator -----------------------------------
UNITS_PER_TARGET_INR = 900
