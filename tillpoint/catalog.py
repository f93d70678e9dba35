"""Registry of user-level jobs: name -> callable(spark, sf_dir) -> DataFrame.

Each entry reads the staged canonical tables of ``sf_dir`` (see
``tillpoint.sources.warehouse``), runs one job with the test-data parameters
and normalises the result types for comparison (``to_output``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.functions.exprs import to_output
from tillpoint.params import TESTDATA_PARAMS as P
from tillpoint.plans import audit as A
from tillpoint.plans import customers as C
from tillpoint.plans import impact as IM
from tillpoint.plans import incremental as INC
from tillpoint.plans import inventory as INV
from tillpoint.plans import ledger as LG
from tillpoint.plans import returns as R
from tillpoint.plans import risk as K
from tillpoint.plans import sales as S
from tillpoint.sources import fixtures as FX
from tillpoint.sources.layout import TEXT_CODEC
from tillpoint.sources.warehouse import warehouse

Job = Callable[[SparkSession, str], DataFrame]


def _job(fn, text_ids: tuple[str, ...] = ()) -> Job:
    """Wrap a job: staged tables in, normalised types out. ``text_ids`` are
    nullable key columns emitted as text (as the original's VARCHAR ids), so a
    NULL key reads the same from every engine and client library."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = to_output(fn(warehouse(spark, sf_dir)))
        for c in text_ids:
            out = out.withColumn(c, F.col(c).cast("string"))
        return out
    run.__name__ = getattr(fn, "__name__", "job")
    return run


GUEST_KEYS = ("customer_id",)  # NULL for guest checkouts


def _audit() -> dict[str, Job]:
    return {
        "null_rate_audit": _job(lambda w: A.null_rate_audit(w.tables(), A.AUDITED_NULL_COLUMNS)),
        "duplicate_detection": _job(lambda w: A.duplicate_detection(w["fact_transactions"])),
        "duplicate_rows": _job(lambda w: A.duplicate_rows(w["fact_transactions"]), GUEST_KEYS),
        "negative_stock": _job(lambda w: A.negative_stock(w["fact_inventory"], w["dim_products"])),
        "price_anomalies": _job(lambda w: A.price_anomalies(w["fact_transactions"], w["dim_products"],
                                                            P.max_discount, P.min_cost_ratio)),
        "referential_integrity": _job(lambda w: A.referential_integrity(A.default_integrity_checks(w))),
        "date_consistency": _job(lambda w: A.date_consistency(w["fact_returns"], w["fact_transactions"],
                                                              P.return_window_days)),
        "date_consistency_bucketed": _job(lambda w: A.date_consistency(
            w.stored("fact_returns"), w.stored("fact_transactions"), P.return_window_days)),
        # recomputed from the raw table here (not read from the staged copy) so the job itself runs
        "clean_transactions": _job(lambda w: A.clean_transactions(w["fact_transactions"]), GUEST_KEYS),
        "dq_summary": _job(lambda w: A.dq_summary(w["fact_transactions"], w["clean_transactions"],
                                                  w["fact_inventory"], w["dim_products"])),
        "constraint_audit": _job(lambda w: A.constraint_audit(w.tables(), w.settled)),
        "audit_counters": _job(lambda w: A.audit_counters(w["fact_transactions"], w["fact_inventory"],
                                                          w["dim_products"])),
        "clean_by_first": _job(lambda w: A.clean_by_first(w["fact_transactions"]), GUEST_KEYS),
        "incremental_clean": _job(incremental_clean, GUEST_KEYS),
    }


def incremental_clean(w):
    """The clean table built from two batches, the second with late online sales and a month
    that was loaded before, then the first batch once more."""
    import uuid

    from tillpoint.session import staging_root
    t, day = w["fact_transactions"], F.col("transaction_date")
    late = F.col("channel").eqNullSafe("Online")
    first = t.filter((day < F.lit(P.recent_from)) & ~late)
    second = t.filter(late | (day >= F.add_months(F.lit(P.recent_from), -1)))
    clean = INC.CleanTable(w.spark, f"{staging_root(w.spark)}/clean-{uuid.uuid4().hex[:12]}")
    for batch in (first, second, first):
        clean.apply(batch)
    return clean.read()


def _sales() -> dict[str, Job]:
    return {
        "monthly_revenue": _job(lambda w: S.monthly_revenue(w["clean_transactions"])),
        "monthly_revenue_rollup": _job(lambda w: S.monthly_revenue_rollup(
            w["clean_transactions"], S.daily_sales(w["clean_transactions"]),
            S.daily_ids(w["clean_transactions"], "customer_id"))),
        "reach": _job(lambda w: S.reach(w["clean_transactions"])),
        "revenue_leakage": _job(lambda w: S.revenue_leakage(w["clean_transactions"], w["dim_products"],
                                                            w["dim_stores"], P.leakage_tolerance)),
        "store_scorecard": _job(lambda w: S.store_scorecard(w["clean_transactions"], w["fact_sales_targets"],
                                                            w["dim_stores"])),
        "season_performance": _job(lambda w: S.season_performance(w["clean_transactions"])),
        "headline_kpis": _job(lambda w: S.headline_kpis(w["clean_transactions"])),
        "category_revenue": _job(lambda w: S.category_revenue(w["clean_transactions"], w["dim_products"])),
        "category_concentration": _job(lambda w: S.category_concentration(
            w["clean_transactions"], w["dim_products"], P.top_categories)),
        "festive_uplift": _job(lambda w: S.festive_uplift(w["clean_transactions"], P.festive_months)),
        "monthly_trend": _job(lambda w: S.monthly_trend(w["clean_transactions"])),
        "view_monthly_trend": _job(lambda w: S.monthly_trend(w.stored("vw_clean_transactions"))),
        "missed_target_channels": _job(lambda w: S.missed_target_channels(
            w.by_month("clean_transactions"), w.by_month("fact_sales_targets"), P.festive_months)),
    }


def qcut_scores(w):
    return C.rfm_scores_qcut(w["clean_transactions"], P.as_of, P.rfm_buckets)


def ntile_scores(w):
    return C.rfm_scores_ntile(C.customer_measures(w["clean_transactions"], P.as_of), P.rfm_buckets, w["dim_customers"])


def rfm_scored(w):
    """Quantile RFM scores, made once per session and staged for the jobs that read them."""
    return w.derived("rfm_scored", qcut_scores)


def rfm_ntile(w):
    """NTILE RFM scores, staged like ``rfm_scored``."""
    return w.derived("rfm_ntile", ntile_scores)


def _customers() -> dict[str, Job]:
    qcut = rfm_scored
    return {
        "customer_metrics": _job(lambda w: C.customer_metrics(w["clean_transactions"], w["dim_customers"], P.as_of)),
        "rfm_scores_ntile": _job(ntile_scores),
        "rfm_segments": _job(lambda w: C.rfm_segments(rfm_ntile(w), P.integer_avg)),
        "rfm_scores_qcut": _job(qcut_scores),
        "rfm_segment_table": _job(lambda w: C.rfm_segment_table(qcut(w), w["dim_customers"])),
        "rfm_segment_summary": _job(lambda w: C.rfm_segment_summary(qcut(w))),
        "churn_risk": _job(lambda w: C.churn_risk(w["clean_transactions"], w["dim_customers"], P)),
        "churn_windows": _job(lambda w: C.churn_windows(w.by_month("clean_transactions"), P)),
        "churn_customers": _job(lambda w: C.churn_scored(w["clean_transactions"], w["dim_customers"], P)),
    }


def _inventory() -> dict[str, Job]:
    def ledger(w):
        # from the raw test tables: weekly units and initial stock, then the ledger
        weekly = FX.inventory_series(FX.read_source(w.spark, w.sf_dir))
        return LG.stock_ledger(weekly, w["dim_products"], week1_date=FX.INVENTORY_WEEK1)

    return {
        "inventory_health": _job(lambda w: INV.inventory_health(w["fact_inventory"], w["dim_products"],
                                                                w["dim_stores"])),
        "dead_stock": _job(lambda w: INV.dead_stock(w["fact_inventory"], w["dim_products"],
                                                    P.dead_sell_through, P.dead_min_units)),
        "sell_through_cohort": _job(lambda w: INV.sell_through_cohort(w["fact_inventory"], w["dim_products"],
                                                                      P.cohort_max_week)),
        "first_markdown_event": _job(lambda w: LG.first_markdown_event(w["fact_inventory"], P.nominal_stock)),
        "stock_ledger": _job(ledger),
        "capped_ledger": _job(lambda w: LG.capped_ledger(FX.capped_demand(FX.read_source(w.spark, w.sf_dir)),
                                                         w["dim_products"])),
        "target_spine": _job(lambda w: LG.target_spine(w["dim_stores"], w["clean_transactions"],
                                                       rule=FX.target_rule)),
    }


def _returns() -> dict[str, Job]:
    return {
        "top_return_reason": _job(lambda w: R.top_return_reason(w["fact_returns"])),
        "return_profitability": _job(lambda w: R.return_profitability(w["clean_transactions"], w["fact_returns"],
                                                                      w["dim_products"])),
        "return_loss": _job(lambda w: R.return_loss(w["clean_transactions"], w["fact_returns"])),
        "return_candidates": _job(lambda w: R.return_candidates(w["fact_transactions"], w["clean_transactions"],
                                                                P.return_sample_rate, P.label_seed)),
    }


def labelled(w):
    """Features, rule score and label of the clean transactions, staged once per session: the codes, the
    split's cut values and the rows of the model frame are separate passes over them."""
    return w.derived("labelled", lambda x: K.return_label(K.return_probability(K.return_features(
        x["clean_transactions"], x["dim_products"])), P.label_seed))


def labelled_transactions(w):
    """Clean transactions with the labels of their id. An id that is on one row has that row's own label, so only rows
    of repeated ids are joined. Repeated ids are among those whose hash is on several rows: what is exchanged to
    find them is a hash a row, not the row."""
    tc = w["clean_transactions"]
    several = w.derived("several_ids", lambda _: tc.filter(F.col("transaction_id").isNotNull())
                        .groupBy(F.xxhash64("transaction_id").alias("_id_hash")).count().filter("count > 1").select("_id_hash"))
    hashed = F.xxhash64("transaction_id") == several["_id_hash"]
    rows = K.return_label(K.return_probability(K.return_features(tc, w["dim_products"], others=tc.columns)), P.label_seed)
    alone = (rows.filter(F.col("transaction_id").isNotNull()).join(several, hashed, "left_anti")
             .select("transaction_id", *[c for c in tc.columns if c != "transaction_id"], "is_returned"))
    labels = labelled(w).select("transaction_id", "is_returned").join(several, hashed, "left_semi")
    return alone.unionByName(tc.join(several, hashed, "left_semi").join(labels, "transaction_id"))


def model_input(w):
    return K.categorical_index(labelled(w))


def model_split(w):
    return K.stratified_split(K.model_frame(model_input(w)), "is_returned", P.train_fraction, P.label_seed)


def cut_split(w):
    """The model split as a projection of the labelled rows; its cut values (a row per class) are found once per
    session and staged."""
    frame = K.model_frame(model_input(w))
    cuts = w.derived("split_cuts", lambda _: K.split_cuts(frame, "is_returned", P.train_fraction, P.label_seed))
    return K.stratified_split(frame, "is_returned", P.train_fraction, P.label_seed, cuts=cuts)


def staged_split(w):
    """The model split, materialised once per session for the tree, which reads its training rows many times."""
    return w.derived("model_split", cut_split)


def tree_rows(w):
    """(training rows, test rows, whether the former are staged by themselves). Where they are more than a task's, only what
    a fit reads of them is written; the test rows are a projection of the labelled rows."""
    if labelled(w).count() <= K.TRAIN_ROWS_PER_TASK:
        split = staged_split(w)
        return split.filter(F.col("split") == "train"), split.filter(F.col("split") == "test"), False
    train = w.derived("training_rows", lambda x: K.training_rows(cut_split(x).filter(F.col("split") == "train")),
                      rows_per_file=K.TRAIN_ROWS_PER_TASK)
    return train, cut_split(w).filter(F.col("split") == "test"), True


def rule_scored_test(w):
    """Test split scored by the rule probability (exact, SQL-checkable)."""
    t = cut_split(w).filter(F.col("split") == "test")  # one pass, three columns: nothing of the split is written
    score = F.col("return_prob").cast("double")
    return t.select("transaction_id", "is_returned", score.alias("score"),
                    (score >= F.lit(P.predict_threshold)).cast("int").alias("prediction"))


def tree_model(w):
    """Fit once per session on the training rows; every tree job reuses the model."""
    train, test, staged = tree_rows(w)
    return w.memo("return_tree", lambda _: K.fit_return_tree(
        train, depth=P.tree_depth, min_leaf=P.tree_min_leaf, max_bins=P.tree_max_bins, seed=P.label_seed, staged=staged)), test


def tree_nodes(w):
    """Node table of the fitted tree (a bounded number of rows), read once per session."""
    return w.memo("return_tree_nodes", lambda x: K.tree_nodes(tree_model(x)[0]))


def _risk() -> dict[str, Job]:
    feature_cols = ["transaction_id", "transaction_date", "product_id", "category", "heat_score", "channel",
                    "quantity", "unit_price", "discount_pct", "price_ratio", "margin_per_unit", "day_of_week",
                    "is_weekend", "is_festive"]

    def feats(w):
        return K.return_features(w["clean_transactions"], w["dim_products"])

    def tree_predictions(w):
        _, test = tree_model(w)
        return K.predict_by_nodes(tree_nodes(w), test)

    def tree_importance(w):
        model, _ = tree_model(w)
        return K.feature_importance(model, w.spark, k=P.top_features)

    return {
        "return_features": _job(lambda w: feats(w).select(*feature_cols)),
        "return_probability": _job(lambda w: K.return_probability(feats(w)).select(*feature_cols, "return_prob")),
        "return_label": _job(lambda w: K.return_label(K.return_probability(feats(w)), P.label_seed)
                             .select(*feature_cols, "return_prob", "is_returned")),
        "categorical_index": _job(lambda w: model_input(w).select(
            *feature_cols, "return_prob", "is_returned", "cat_encoded", "ch_encoded", "heat_encoded")),
        "model_frame": _job(lambda w: K.model_frame_stats(K.model_frame(model_input(w)))),
        "stratified_split": _job(lambda w: model_split(w).select("transaction_id", "is_returned", "split")),
        "roc_auc": _job(lambda w: K.roc_auc(rule_scored_test(w))),
        "classification_report": _job(lambda w: K.classification_report(rule_scored_test(w))),
        "pr_curve": _job(lambda w: K.pr_curve(rule_scored_test(w))),
        "threshold_table": _job(lambda w: K.threshold_table(rule_scored_test(w), P.thresholds)),
        "return_risk_tree": _job(tree_predictions),
        "return_tree_nodes": _job(lambda w: K.nodes_table(w.spark, tree_nodes(w))),
        "tree_roc_auc": _job(lambda w: K.roc_auc(tree_predictions(w))),
        "tree_classification_report": _job(lambda w: K.classification_report(tree_predictions(w))),
        "tree_pr_curve": _job(lambda w: K.pr_curve(tree_predictions(w))),
        "tree_threshold_table": _job(lambda w: K.threshold_table(tree_predictions(w), P.thresholds)),
        "feature_importance": _job(tree_importance),
    }


def _impact_inputs(w):
    tc, p = w["clean_transactions"], w["dim_products"]
    dead = INV.dead_stock(w["fact_inventory"], p, P.dead_sell_through, P.dead_min_units)
    return dead, C.with_pandas_segment(rfm_scored(w)), R.return_loss(tc, w["fact_returns"])


def impact(w):
    dead, segments, loss = _impact_inputs(w)
    return IM.impact_scenarios(dead, segments, loss, P)


def summary(w, auc):
    tc, p = w["clean_transactions"], w["dim_products"]
    dead, segments, loss = _impact_inputs(w)
    categories = w.derived("category_revenue", lambda x: S.category_revenue(x["clean_transactions"], x["dim_products"]))
    return IM.impact_summary(
        S.headline_kpis(tc), loss, IM.impact_scenarios(dead, segments, loss, P), auc,
        S.festive_uplift(tc, P.festive_months), S.category_concentration(tc, p, P.top_categories),
        A.audit_counters(w["fact_transactions"], w["fact_inventory"], p),
        categories, C.rfm_segment_summary(segments))


def checked_summary(w):
    """The summary with the AUC of the rule score, which SQL can rebuild, and JSON maps."""
    return IM.maps_as_json(summary(w, K.roc_auc(rule_scored_test(w))))


def publish(w):
    from tillpoint.session import staging_root
    tc, p = w["clean_transactions"], w["dim_products"]
    _, test = tree_model(w)
    outputs = {
        "rfm_segments": C.rfm_segment_table(rfm_scored(w), w["dim_customers"]),
        "dead_stock_skus": INV.dead_stock(w["fact_inventory"], p, P.dead_sell_through, P.dead_min_units),
        "monthly_revenue": S.monthly_trend(tc),
        "category_revenue": S.category_revenue(tc, p),
        "labelled_transactions": labelled_transactions(w),
        "impact_summary": summary(w, K.roc_auc(K.predict_by_nodes(tree_nodes(w), test))),
    }
    return IM.publish_outputs(w.spark, outputs, IM.new_output_dir(staging_root(w.spark)), "csv")


def csv_roundtrip(w):
    """Clean transactions written as CSV, read back with the declared
    schema (dates parsed on read), then the monthly trend over the CSV copy."""
    import uuid

    from tillpoint.session import staging_root
    from tillpoint.sources import io as IO
    d = f"{staging_root(w.spark)}/csv-{uuid.uuid4().hex[:12]}"
    IO.write_tables({"clean_transactions": w["clean_transactions"]}, d, "csv")
    back = IO.load_tables(w.spark, d, ["clean_transactions"], "csv")["clean_transactions"]
    return S.monthly_trend(back)


def rejected_rows(w):
    """A CSV export with planted faults, loaded under the declared rules."""
    import uuid

    from tillpoint.session import staging_root
    from tillpoint.sources import quarantine as Q
    d = f"{staging_root(w.spark)}/load-{uuid.uuid4().hex[:12]}"
    FX.faulty_transactions(w["fact_transactions"]).write.option("header", True).option("compression", TEXT_CODEC).csv(f"{d}/csv")
    parents = {n: w[n] for n in ("dim_products", "dim_stores", "dim_customers")}
    return Q.rejection_summary(*Q.load_checked(w.spark, f"{d}/csv", "fact_transactions", parents, f"{d}/loaded"))


def _impact() -> dict[str, Job]:
    return {
        "impact_scenarios": _job(impact),
        "impact_summary": _job(checked_summary),
        "publish_outputs": _job(publish),
        "csv_source_roundtrip": _job(csv_roundtrip),
        "rejected_rows": _job(rejected_rows),
    }


def queries() -> dict[str, Job]:
    out: dict[str, Job] = {}
    for part in (_audit, _sales, _customers, _inventory, _returns, _risk, _impact):
        out.update(part())
    return out


def oracle_sql() -> dict[str, str]:
    from tillpoint.oracle import sql_audit_sales, sql_customers, sql_impact, sql_inventory_returns, sql_risk
    out: dict[str, str] = {}
    out.update(sql_audit_sales.SQL)
    out.update(sql_customers.SQL)
    out.update(sql_inventory_returns.SQL)
    out.update(sql_risk.SQL)
    out.update(sql_impact.SQL)
    return out
