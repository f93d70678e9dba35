"""Rejected rows on load; the fitted tree as nodes, as an expression and as SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL, rows
from tillpoint import catalog
from tillpoint.plans import risk as K
from tillpoint.sources import quarantine as Q
from tillpoint.sources import schemas as SC

COLUMNS = [f.name for f in SC.SCHEMAS["fact_transactions"].fields]
GOOD = dict(transaction_id="t1", transaction_date="2020-01-05", customer_id="1", product_id="10", store_id="100", quantity="2",
            unit_price="9.99", discount_pct="0.10", revenue="17.98", cost="8.00", payment_method="Card", channel="Online", region="R")


def test_each_rule_rejects_its_row(spark, tmp_path):
    lines = [GOOD, GOOD | {"transaction_id": "t2", "customer_id": ""}, GOOD | {"transaction_id": "t3", "quantity": ""},
             GOOD | {"transaction_date": "05.01.2020"}, GOOD | {"unit_price": "abc"}, GOOD | {"transaction_id": ""},
             GOOD | {"quantity": "0"}, GOOD | {"discount_pct": "1.5"}, GOOD | {"product_id": "11"},
             GOOD | {"store_id": "", "customer_id": "2", "quantity": "-1"}, GOOD | {"payment_method": 'quoted, "comma"'}]
    text = lambda r: ",".join('"' + r[c].replace('"', '\\"') + '"' if "," in r[c] else r[c] for c in COLUMNS)
    (tmp_path / "in").mkdir()
    body = [",".join(COLUMNS), *map(text, lines), "only,three,fields", text(GOOD) + ",one,too,many"]
    (tmp_path / "in" / "a.csv").write_text("\n".join(body) + "\n")
    parents = {"dim_products": spark.createDataFrame([(10,), (10,)], "product_id long"),
               "dim_stores": spark.createDataFrame([(100,)], "store_id long"),
               "dim_customers": spark.createDataFrame([(1,)], "customer_id long")}
    kept, rejected = Q.load_checked(spark, str(tmp_path / "in"), "fact_transactions", parents, str(tmp_path / "out"))
    assert kept.columns == COLUMNS
    assert rows(kept.select("transaction_id", "customer_id", "quantity", "payment_method")) == sorted(
        [("t1", 1, 2, "Card"), ("t2", None, 2, "Card"), ("t3", 1, 1, "Card"), ("t1", 1, 2, 'quoted, "comma"')],
        key=lambda t: tuple((x is None, str(x)) for x in t))
    reasons = sorted(tuple(r["reasons"]) for r in rejected.collect())
    assert reasons == sorted([("MALFORMED RECORD",)] * 4 + [("NOT NULL transaction_id",), ("RANGE quantity",),
                             ("RANGE discount_pct",), ("FOREIGN KEY product_id",),
                             ("NOT NULL store_id", "RANGE quantity", "FOREIGN KEY customer_id")])
    raw = {r["raw_record"] for r in rejected.collect()} - {None}
    assert len(raw) == 4 and "only,three,fields" in raw
    summary = {r["reason"]: r["rows"] for r in Q.rejection_summary(kept, rejected).collect()}
    assert summary["KEPT ROWS"] == 4 and summary["REJECTED ROWS"] == 9 and summary["RANGE quantity"] == 2


def test_an_empty_load(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(",".join(COLUMNS) + "\n")
    kept, rejected = Q.load_checked(spark, str(tmp_path / "in"), "fact_transactions", {}, str(tmp_path / "out"))
    assert kept.count() == 0 and rejected.count() == 0


def test_tree_expression_equals_the_fitted_model(spark, wh):
    model, test = catalog.tree_model(wh)
    nodes = catalog.tree_nodes(wh)
    ours = K.predict_by_nodes(nodes, test)
    assert rows(ours) == rows(K.predict_return(model, test), ours.columns)
    plan = ours._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "Exchange" not in plan
    inner = [n for n in nodes if n.feature is not None]
    assert len(inner) >= 3 and len(nodes) == 2 * len(inner) + 1


def test_sql_scores_from_the_node_table(spark, wh):
    """The published nodes are all that another engine needs."""
    _, test = catalog.tree_model(wh)
    nodes = catalog.queries()["return_tree_nodes"](spark, SF_SMALL).toPandas()  # noqa: F841 - read by SQL
    features = sorted({n.feature for n in catalog.tree_nodes(wh) if n.feature})
    cases = test.select("transaction_id", *[F.col(f).cast("double").alias(f) for f in features]).toPandas()  # noqa: F841
    value = " ".join(f"WHEN '{f}' THEN c.{f}" for f in features)
    got = duckdb.sql(f"""
        WITH RECURSIVE walk AS (
          SELECT transaction_id, CAST(1 AS BIGINT) AS node_id FROM cases
          UNION ALL
          SELECT w.transaction_id, 2 * w.node_id + CASE WHEN CASE n.feature {value} END <= n.threshold THEN 0 ELSE 1 END
          FROM walk w JOIN nodes n USING (node_id) JOIN cases c USING (transaction_id) WHERE n.feature IS NOT NULL)
        SELECT transaction_id, prediction, score FROM walk JOIN nodes USING (node_id) WHERE feature IS NULL""").fetchall()
    ours = K.predict_by_nodes(catalog.tree_nodes(wh), test).select("transaction_id", "prediction", "score")
    assert sorted(got) == sorted(tuple(r) for r in ours.collect()) and len(got) == pytest.approx(test.count())
