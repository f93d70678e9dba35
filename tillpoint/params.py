"""Job parameters.

``RetailParams`` defaults are the values the original analyses hard-code
(snapshot 2024-09-30, churn value bands 5,000 / 8,000 / 15,000 / 20,000 INR).
``TESTDATA_PARAMS`` re-aims the date and value parameters at the driver's
test tables, whose orders run 1995-01 .. 2001-08 and whose customers carry
about 40 lines each (median lifetime value about 656,000).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class RetailParams:
    # --- snapshot and churn windows -------------------------------------
    as_of: dt.date = dt.date(2024, 9, 30)
    recent_from: dt.date = dt.date(2024, 4, 1)  # orders_last_6m: date >= recent_from
    previous_from: dt.date = dt.date(2023, 4, 1)  # orders_prev_6m: previous_from <= d < recent_from
    # --- churn value bands (INR) ----------------------------------------
    churn_ltv_floor: float = 5000.0
    churn_medium_ltv: float = 8000.0
    churn_high_ltv: float = 15000.0
    churn_vip_ltv: float = 20000.0
    churn_high_idle_days: int = 90
    churn_medium_idle_days: int = 60
    churn_vip_min_recent_orders: int = 2
    # --- integer-average switch (T-SQL AVG(int) truncates) ---------------
    integer_avg: bool = False
    # --- RFM --------------------------------------------------------------
    rfm_buckets: int = 5
    # --- leakage / anomalies ---------------------------------------------
    leakage_tolerance: float = 1.0
    max_discount: float = 0.70
    min_cost_ratio: float = 0.50
    return_window_days: int = 90
    return_sample_rate: float = 0.11  # share of clean transactions drawn for returns
    # --- inventory --------------------------------------------------------
    cohort_max_week: int = 16
    dead_sell_through: float = 0.40
    dead_min_units: int = 5
    nominal_stock: int = 150
    # --- seasons / festive months -----------------------------------------
    festive_months: tuple[int, ...] = (10, 11)
    # --- model --------------------------------------------------------------
    label_seed: int = 42
    train_fraction: float = 0.75
    tree_depth: int = 5
    tree_min_leaf: int = 50
    tree_max_bins: int = 64
    thresholds: tuple[float, ...] = (0.30, 0.40, 0.50, 0.60)
    predict_threshold: float = 0.50
    top_features: int = 6
    # --- impact -------------------------------------------------------------
    markdown_discount: float = 0.25
    markdown_lift: float = 0.60
    writeoff_avoided: float = 0.40
    winback_rate: float = 0.20
    return_reducible: float = 0.15
    default_mrp: float = 800.0
    default_churn_ltv: float = 12000.0
    top_categories: int = 2
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    def with_(self, **kw) -> "RetailParams":
        return replace(self, **kw)


TESTDATA_PARAMS = RetailParams(
    as_of=dt.date(2001, 8, 1),
    recent_from=dt.date(2001, 2, 1),
    previous_from=dt.date(2000, 2, 1),
    churn_ltv_floor=300000.0,
    churn_medium_ltv=500000.0,
    churn_high_ltv=650000.0,
    churn_vip_ltv=800000.0,
)
