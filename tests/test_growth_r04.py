"""Steps that filled the disk: what they exchange, write and leave behind, and their rows."""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal as Dec

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL, rows
from tillpoint import catalog
from tillpoint.plans import audit as A
from tillpoint.plans import impact as IM
from tillpoint.plans import incremental as INC
from tillpoint.plans import risk as K
from tillpoint.sources import fixtures as FX
from tillpoint.sources import layout
from tillpoint.sources import warehouse as WH


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture()
def small_pieces(monkeypatch):
    monkeypatch.setattr(WH, "ROWS_PER_PIECE", 1000)
    monkeypatch.setattr(WH, "ROWS_PER_TASK", 1000)


def raw_rows(src):
    return FX.fact_transactions(FX.transaction_lines(src))


def test_lines_are_exchanged_by_order_and_by_part_only(spark, no_broadcast, small_pieces):
    src = FX.read_source(spark, SF_SMALL)
    plan = plan_of(WH.marked_transactions(src))
    # two tables by order, two by part, nation and region; regions of suppliers come without an exchange
    assert plan.count("Exchange hashpartitioning") == 6 and "Exchange hashpartitioning(l_suppkey" not in plan
    assert plan.count("Exchange hashpartitioning(l_partkey") == 1


@pytest.mark.parametrize("change", ["as they are", "one part", "below zero", "listed twice"])
def test_lines_laid_by_part_are_the_same_rows(spark, small_pieces, change):
    src = FX.read_source(spark, SF_SMALL)
    part, li = src["part"], src["lineitem"]
    if change == "one part":
        li = li.withColumn("l_partkey", F.when(F.col("l_linenumber") < 5, F.lit(7).cast("long")).otherwise(F.col("l_partkey")))
    elif change == "below zero":
        # part -k in an order without orphans and part k in one with orphans are the same product
        part = part.unionByName(part.withColumn("p_partkey", -F.col("p_partkey")))
        li = li.withColumn("l_partkey", F.when(F.col("l_orderkey") % 3 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey")))
    elif change == "listed twice":
        part = part.unionByName(part.filter("p_partkey % 5 = 0"))
        li = li.unionByName(li.filter("l_orderkey % 7 = 0")).unionByName(li.limit(3).withColumn("l_partkey", F.lit(None).cast("long")))
    src |= {"part": part, "lineitem": li}
    marked = WH.marked_transactions(src)
    assert rows(marked, FX.TRANSACTION_COLUMNS) == rows(raw_rows(src))
    clean = marked.filter(A.IS_CLEAN)
    assert rows(clean, A.CLEAN_COLUMNS) == rows(A.clean_transactions(raw_rows(src)))
    assert clean.filter(F.col(layout.MONTH) != F.trunc("transaction_date", "month")).count() == 0


def test_a_staged_table_leaves_no_files_of_its_exchanges(spark):
    def held():
        return {f for r, _, fs in os.walk(local) for f in fs if f.startswith("shuffle_")}
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()
    was = held()
    counts = WH.Warehouse(spark, SF_SMALL).derived(
        "counts", lambda _: spark.range(10_000).withColumn("k", F.col("id") % 97).groupBy("k").count())
    assert not held() - was and counts.count() == 97
    assert spark.conf.get(layout.CLEANED) == "false"


def test_a_large_split_is_not_written_nor_exchanged_for_the_tree(spark, monkeypatch):
    monkeypatch.setattr(K, "TRAIN_ROWS_PER_TASK", 500)
    w = WH.Warehouse(spark, SF_SMALL)
    model, test = catalog.tree_model(w)
    train, _, staged = catalog.tree_rows(w)
    assert staged and "model_split" not in w._memo and "Exchange" not in plan_of(train)
    assert max(r["n"] for r in train.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()) <= 500
    split = catalog.staged_split(w)
    features = [*K.L.MODEL_FEATURES, "is_returned"]
    expected = split.filter("split = 'train'").select(*[F.col(c).cast("double") for c in K.L.MODEL_FEATURES], "is_returned")
    assert rows(train, features) == rows(expected, features)
    assert rows(test, ["transaction_id", *features]) == rows(split.filter("split = 'test'"), ["transaction_id", *features])
    # every training row reaches the fit, in partitions of its own files
    assert model.stages[-1]._java_obj.rootNode().impurityStats().rawCount() == train.count()
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def names(path) -> list[str]:
    return [f for _, _, fs in os.walk(path) for f in fs if f.startswith("part-")]


def test_published_texts_are_compressed_and_whole(spark, tmp_path):
    df = spark.range(500).select(F.concat(F.lit("T"), "id").alias("transaction_id"), (F.col("id") % 7).alias("n"))
    told = IM.publish_outputs(spark, {"lines": df, "doc": df.agg(F.map_from_entries(F.collect_list(F.struct("transaction_id", "n"))).alias("m"))},
                              str(tmp_path))
    assert rows(told, ["output", "rows"]) == [("doc", 1), ("lines", 500)]
    assert all(n.endswith(".csv.gz") for n in names(tmp_path / "lines")) and all(n.endswith(".json.gz") for n in names(tmp_path / "doc"))
    assert rows(spark.read.option("header", True).schema(df.schema).csv(str(tmp_path / "lines"))) == rows(df)


def test_a_checked_load_reads_and_writes_compressed_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tillpoint.session.staging_root", lambda _: str(tmp_path))
    w = WH.Warehouse(spark, SF_SMALL)
    found = {r["reason"]: r["rows"] for r in catalog.rejected_rows(w).collect()}
    assert found["KEPT ROWS"] + found["REJECTED ROWS"] == w["fact_transactions"].count() and found["MALFORMED RECORD"] > 0
    (load,) = tmp_path.glob("load-*")
    assert all(n.endswith(".csv.gz") for n in names(load / "csv")) and all(n.endswith(".zstd.parquet") for n in names(load / "loaded"))


def test_a_batch_exchanges_hashes_and_rows_of_repeated_keys(spark, tmp_path):
    """Most rows go on as they are; what was kept before is not exchanged again; the first row of every key is kept."""
    schema = "transaction_id string, transaction_date date, customer_id long, product_id long, revenue decimal(10,1), quantity int"

    def batch(numbers):
        data = [(f"T{7919 * i % 1000:03d}", None if i % 50 == 0 else dt.date(2021, 1 + i % 3, 1 + i % 9), None if i % 4 == 0 else i % 40,
                 i % 31, Dec(i % 6), i % 5) for i in numbers]
        t = spark.createDataFrame(data, schema)
        for c in set(A.CLEAN_COLUMNS) - set(t.columns):
            t = t.withColumn(c, F.lit(None).cast(INC.SC.SCHEMAS["fact_transactions"][c].dataType))
        return t.select(*A.CLEAN_COLUMNS)

    clean = INC.CleanTable(spark, str(tmp_path / "clean"))
    first, second = batch(range(0, 600)), batch([*range(300, 950), *range(400, 420)])
    for b in (first, second, first):
        clean.apply(b)
    cols = ["transaction_id", "transaction_date", "customer_id", "product_id", "quantity"]
    assert rows(clean.read(), cols) == rows(A.clean_transactions(first.unionByName(second)), cols)
    assert clean.changed_outside().count() == 0
    # the batch again: its months differ from it by the second batch, yet none of its keys is open
    incoming = second.filter("revenue > 0").withColumn("sale_month", F.trunc("transaction_date", "month"))
    best = incoming.join(clean.read().select("transaction_id", "transaction_date"), ["transaction_id", "transaction_date"], "left_semi")
    months = [r[0] for r in best.select("sale_month").distinct().collect()]
    changes, open_months = clean._changes(best, clean._kept(), months)
    assert len(months) > 2 and open_months == [] and changes.count() == 0
    # new keys pass without an aggregate; so do few others
    late = batch(range(950, 990)).withColumn("sale_month", F.lit(dt.date(2030, 1, 1)))
    changes, open_months = clean._changes(late.filter("revenue > 0"), clean._kept(), [dt.date(2030, 1, 1)])
    assert open_months == [dt.date(2030, 1, 1)] and spark.read.parquet(str(tmp_path / "clean" / "shared")).count() == 0
    assert changes.count() == late.filter("revenue > 0").count()


def test_constraints_are_checked_one_after_the_other(spark, wh):
    got = catalog.queries()["constraint_audit"](spark, SF_SMALL)
    assert "Exchange hashpartitioning" not in plan_of(got)
    assert rows(got) == rows(A.constraint_audit(wh.tables()))
