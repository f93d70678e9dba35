"""Return-risk model jobs (J37-J48): features, rule score, deterministic
label, label encoding, model frame, stratified split, decision tree, and the
evaluation metrics (ROC-AUC, classification report, PR curve, thresholds,
feature importances).

Scale notes
* Features, score and label are row-local expressions in one projection
  (whole-stage codegen); the product attributes come through one join.
* The label draw hashes the transaction id, so it is the same on every run,
  partitioning and engine (``rand(seed)`` is not).
* The stratified split looks for one cut value per class in the hash order; the
  rows themselves only get a projection.
* Metrics work from counts per distinct score (a depth-d tree emits at most
  2^d distinct probabilities, the rule score at most 101); the cumulative sums
  over scores use the distributed prefix sum, so a continuous score with one
  value per row is fine too. Classification counts are one aggregate;
  threshold sweeps are one scan with one conditional sum per threshold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.functions import labels as L
from tillpoint.functions.exprs import dbl, hash_uniform, nz, ratio, round_up, weekday_mon0
from tillpoint.operators.rank import global_row_number, prefix_sum
from tillpoint.operators.sampling import cut_values, hash_order_key
from tillpoint.sources.layout import settings

UNB = Window.unboundedPreceding
PACKED = 10 ** 18  # two counts in one decimal: positives x PACKED + negatives


# J37 ----------------------------------------------------------------------------
def return_features(tc: DataFrame, p: DataFrame, others: Sequence[str] = ()) -> DataFrame:
    """Transaction-level features after a left join to products. ``others``: columns of ``tc`` to keep beside them."""
    x = tc.join(p.select("product_id", "category", "cost_price", "mrp", "heat_score"), "product_id", "left")
    dow = weekday_mon0("transaction_date")
    own = ["transaction_id", "transaction_date", "product_id", "category", "heat_score", "channel",
           "quantity", "unit_price", "discount_pct"]
    return x.select(
        *own, *[c for c in others if c not in own],
        ratio("unit_price", "mrp").alias("price_ratio"),
        (F.col("unit_price") - F.col("cost_price")).alias("margin_per_unit"),
        dow.alias("day_of_week"),
        dow.isin(*L.WEEKEND_DAYS).cast("int").alias("is_weekend"),
        F.month("transaction_date").isin(10, 11).cast("int").alias("is_festive"),
    )


# J38 ----------------------------------------------------------------------------
def return_probability(features: DataFrame) -> DataFrame:
    """Additive rule score in hundredths (exact): base + category + discount +
    quantity + dead stock + online channel. A NULL attribute adds nothing."""
    def hund(x: float) -> int:
        return int(round(x * 100))

    def term(cond, w):
        return F.when(F.coalesce(cond, F.lit(False)), F.lit(hund(w))).otherwise(F.lit(0))

    terms = [F.lit(hund(L.RISK_BASE))]
    terms += [term(F.col("category") == cat, w) for cat, w in L.RISK_CATEGORY_WEIGHTS]
    terms += [term(F.col("discount_pct") > F.lit(lim), w) for lim, w in L.RISK_DISCOUNT_WEIGHTS]
    terms.append(term(F.col("quantity") >= L.RISK_QUANTITY_AT_LEAST, L.RISK_QUANTITY_WEIGHT))
    terms.append(term(F.col("heat_score") == L.RISK_DEAD_HEAT, L.RISK_DEAD_WEIGHT))
    terms.append(term(F.col("channel") == L.RISK_ONLINE_CHANNEL, L.RISK_ONLINE_WEIGHT))
    score = reduce(lambda a, b: a + b, terms)
    return features.withColumn("return_prob", (score.cast("decimal(7,0)") / F.lit(100)).cast("decimal(5,2)"))


# J39 ----------------------------------------------------------------------------
def return_label(scored: DataFrame, seed: int = 42) -> DataFrame:
    """is_returned = 1 when a deterministic U[0,1) draw per transaction is below the score."""
    u = hash_uniform("transaction_id", seed)
    return scored.withColumn("is_returned", (u < dbl("return_prob")).cast("int"))


# J40 ----------------------------------------------------------------------------
def categorical_codes(df: DataFrame, fills: dict[str, str]) -> DataFrame:
    """(_c, _v, _code): each column's distinct values (NULL filled first) and their
    0-based position in sorted order. All columns share one pass and one map-side
    aggregate; the distinct values of all columns are numbered in range partitions, from
    which each column's first number (a row per column, broadcast) is subtracted."""
    values = F.array(*[F.struct(F.lit(i).alias("_c"), F.coalesce(F.col(c), F.lit(fill)).alias("_v"))
                       for i, (c, fill) in enumerate(fills.items())])
    distinct = df.select(F.inline(values)).distinct()
    numbered = global_row_number(distinct, [F.col("_c"), F.col("_v")], "_number")
    firsts = numbered.groupBy("_c").agg(F.min("_number").alias("_first_number"))
    return (numbered.join(F.broadcast(firsts), "_c")
            .select("_c", "_v", (F.col("_number") - F.col("_first_number")).alias("_code")))


CODES_BROADCAST_BYTES = 16 << 20


def categorical_index(df: DataFrame, fills: dict[str, str] | None = None,
                      suffix: dict[str, str] | None = None) -> DataFrame:
    """Label encoding: each value's 0-based position among the column's sorted
    distinct values (NULL filled first). The size of a column's codes is measured: up to
    ``CODES_BROADCAST_BYTES`` they are broadcast and the rows stay where they are; a larger code
    table is joined by sorting (AQE splits hot values)."""
    fills = fills or dict(L.ENCODER_FILLS)
    names = suffix or {"category": "cat_encoded", "channel": "ch_encoded", "heat_score": "heat_encoded"}
    codes = categorical_codes(df, fills)
    per_column = codes.groupBy("_c").agg(F.sum(F.octet_length("_v") + 24).alias("_bytes"))
    size = {r["_c"]: r["_bytes"] for r in per_column.collect()}  # a row per encoded column
    out = df
    for i, (c, fill) in enumerate(fills.items()):
        own = codes.filter(F.col("_c") == i).select(F.col("_v").alias(f"_v{i}"), F.col("_code").cast("int").alias(names[c]))
        own = F.broadcast(own) if size.get(i, 0) <= CODES_BROADCAST_BYTES else own
        out = out.join(own, F.coalesce(F.col(c), F.lit(fill)) == F.col(f"_v{i}"), "left").drop(f"_v{i}")
    return out


def model_input(tc: DataFrame, p: DataFrame, seed: int = 42) -> DataFrame:
    """J37 -> J38 -> J39 -> J40 in one plan."""
    return categorical_index(return_label(return_probability(return_features(tc, p)), seed))


# J41 ----------------------------------------------------------------------------
def model_frame(df: DataFrame, features=L.MODEL_FEATURES, label: str = "is_returned") -> DataFrame:
    """Rows with no NULL feature."""
    return df.dropna(subset=list(features))


def model_frame_stats(frame: DataFrame, label: str = "is_returned") -> DataFrame:
    return frame.agg(F.count(F.lit(1)).alias("rows"),
                     F.sum(label).cast("long").alias("returned"),
                     round_up(ratio(F.sum(label), F.count(F.lit(1))) * F.lit(100.0), 2).alias("return_rate_pct"))


# J42 ----------------------------------------------------------------------------
def stratified_split(df: DataFrame, label: str = "is_returned", train_fraction: float = 0.75,
                     seed: int = 42, id_col: str = "transaction_id", exact: bool = True,
                     cuts: DataFrame | None = None) -> DataFrame:
    """Exact stratified split: inside each class, rows ordered by md5(id:seed)
    (then id, unique); the first round(fraction x class size) rows train, the rest
    test. Only a cut value per class is looked for (``operators/sampling.py``): the
    wide frame gets a projection, no sort, shuffle or checkpoint. ``label`` has few
    values; rows with a NULL label are dropped. ``cuts``: what ``split_cuts`` gave for the same arguments.

    ``exact=False`` trains on rows whose hashed draw is below the fraction: a
    projection with no shuffle or sort, class sizes within sampling error."""
    if not exact:
        u = hash_uniform(F.concat(F.col(id_col).cast("string"), F.lit(":split")), seed)
        return df.withColumn("split", F.when(u < F.lit(train_fraction), F.lit("train")).otherwise(F.lit("test")))
    h = hash_order_key(id_col, seed, "split")
    # cuts has one row per value of the label, a class column: a broadcast with a proven bound
    cuts = split_cuts(df, label, train_fraction, seed, id_col) if cuts is None else cuts
    upto = F.struct(h.alias("h"), F.col(id_col).alias("k")) <= F.struct(F.col("_cut_h").alias("h"), F.col("_cut_k").alias("k"))
    train = (F.col("_want") >= F.col("_n")) | (F.col("_cut_h").isNotNull() & upto)
    joined = df.join(F.broadcast(cuts), df[label] == cuts["_class"])
    return joined.select(*df.columns, F.when(train, F.lit("train")).otherwise(F.lit("test")).alias("split"))


def split_cuts(df: DataFrame, label: str = "is_returned", train_fraction: float = 0.75, seed: int = 42,
               id_col: str = "transaction_id") -> DataFrame:
    """The cut values of ``stratified_split``, one row per class."""
    keys = df.select(F.col(label).alias("_class"), hash_order_key(id_col, seed, "split").alias("_h"), F.col(id_col).alias("_k"))
    return cut_values(keys, F.round(F.lit(train_fraction) * F.col("_n")))


# J43 ----------------------------------------------------------------------------
def class_weights(train: DataFrame, label: str = "is_returned") -> DataFrame:
    """Balanced weights n / (classes x n_class) as a per-class table."""
    c = train.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    w = Window.partitionBy()  # one row per class
    return c.select(label, (dbl(F.sum("_nc").over(w)) / (dbl(F.count(F.lit(1)).over(w)) * dbl("_nc"))).alias("weight"))


TRAIN_ROWS_PER_TASK = 1 << 20


def dealt(rows: DataFrame, features=L.MODEL_FEATURES) -> DataFrame:
    """Training rows in partitions of about ``TRAIN_ROWS_PER_TASK``: every level of a tree reads its task's
    rows again from memory, and a split of compressed files holds far more rows than fit there."""
    parts = -(-rows.count() // TRAIN_ROWS_PER_TASK)
    return rows.repartition(parts, *features) if parts > 1 else rows


def training_rows(train: DataFrame, features=L.MODEL_FEATURES, label: str = "is_returned") -> DataFrame:
    """What a fit reads of its training rows. Staged in files of at most ``TRAIN_ROWS_PER_TASK`` rows it needs no
    exchange (``fit_return_tree(staged=True)``)."""
    return train.select(*[dbl(c).alias(c) for c in features], label)


def fit_return_tree(train: DataFrame, features=L.MODEL_FEATURES, label: str = "is_returned", depth: int = 5,
                    min_leaf: int = 50, max_bins: int = 64, seed: int = 42, staged: bool = False):
    """Depth-limited decision tree with balanced class weights (pyspark.ml). ``staged``: ``train`` is a scan of files
    that are a task's rows each."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    weighted = train.join(F.broadcast(class_weights(train, label)), label)
    casted = weighted.select(*[dbl(c).alias(c) for c in features], F.col(label).cast("double").alias("label"),
                             "weight")
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features"),
        DecisionTreeClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxDepth=depth,
                               minInstancesPerNode=min_leaf, maxBins=max_bins, seed=seed),
    ])
    if not staged:
        return pipe.fit(dealt(casted, features))
    with settings(train.sparkSession, {"spark.sql.files.minPartitionNum": str(len(train.inputFiles()))}):
        return pipe.fit(casted)


def predict_return(model, test: DataFrame, features=L.MODEL_FEATURES, label: str = "is_returned",
                   id_col: str = "transaction_id") -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    casted = test.select(id_col, F.col(label).cast("int").alias(label), *[dbl(c).alias(c) for c in features])
    pred = model.transform(casted)
    return pred.select(id_col, label, F.col("prediction").cast("int").alias("prediction"),
                       vector_to_array("probability")[1].alias("score"))


@dataclass(frozen=True)
class TreeNode:
    """Node of a fitted tree: children of node i are 2i (feature <= threshold) and 2i + 1."""

    node_id: int
    feature: str | None
    threshold: float | None
    score: float  # weighted share of returned rows
    prediction: int


def tree_nodes(model, features=L.MODEL_FEATURES) -> list[TreeNode]:
    """The fitted tree as nodes (at most 2 ** (depth + 1) - 1), by number."""
    found: list[TreeNode] = []

    def walk(node, number: int) -> None:
        stats = list(node.impurityStats().stats())
        inner = node.subtreeDepth() > 0
        split = node.split() if inner else None
        found.append(TreeNode(number, features[split.featureIndex()] if inner else None, split.threshold() if inner else None,
                              stats[1] / sum(stats), int(node.prediction())))
        if inner:
            walk(node.leftChild(), 2 * number)
            walk(node.rightChild(), 2 * number + 1)

    walk(model.stages[-1]._java_obj.rootNode(), 1)
    return sorted(found, key=lambda n: n.node_id)


def nodes_table(spark, nodes: list[TreeNode]) -> DataFrame:
    """The nodes as a table, from which any engine can score."""
    return spark.createDataFrame([(n.node_id, n.feature, n.threshold, n.score, n.prediction) for n in nodes],
                                 "node_id long, feature string, threshold double, score double, prediction int")


def tree_expression(nodes: list[TreeNode], value: str) -> F.Column:
    """The tree as one CASE expression that gives a leaf's ``value``."""
    by_id = {n.node_id: n for n in nodes}

    def build(number: int) -> F.Column:
        node = by_id[number]
        if node.feature is None:
            return F.lit(getattr(node, value))
        return F.when(dbl(node.feature) <= F.lit(node.threshold), build(2 * number)).otherwise(build(2 * number + 1))

    return build(1)


def predict_by_nodes(nodes: list[TreeNode], test: DataFrame, label: str = "is_returned",
                     id_col: str = "transaction_id") -> DataFrame:
    """``predict_return`` as a projection: no vectors and no ML transform in the plan."""
    return test.select(id_col, F.col(label).cast("int").alias(label),
                       tree_expression(nodes, "prediction").cast("int").alias("prediction"),
                       tree_expression(nodes, "score").alias("score"))


# J44 ----------------------------------------------------------------------------
def score_counts(scored: DataFrame, label: str = "is_returned", score: str = "score") -> DataFrame:
    return scored.groupBy(score).agg(F.sum(F.col(label)).cast("long").alias("pos"),
                                     F.sum(F.lit(1) - F.col(label)).cast("long").alias("neg"))


def roc_auc(scored: DataFrame, label: str = "is_returned", score: str = "score") -> DataFrame:
    """Area under the ROC curve with tied scores counted half (Mann-Whitney),
    from counts per distinct score."""
    g = prefix_sum(score_counts(scored, label, score), [F.col(score).asc()], "neg", "_neg_upto")
    g = g.withColumn("neg_below", F.col("_neg_upto") - F.col("neg"))
    a = g.agg(F.sum(F.col("pos").cast("decimal(18,0)")
                    * (2 * F.col("neg_below") + F.col("neg")).cast("decimal(19,0)")).alias("_u2"),
              F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    return a.select("positives", "negatives",
                    (dbl("_u2") / 2 / (dbl(nz("positives")) * dbl(nz("negatives")))).alias("roc_auc"))


# J45 ----------------------------------------------------------------------------
def classification_report(pred: DataFrame, label: str = "is_returned", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and
    weighted averages (0 where a denominator is 0), 4 decimals."""
    y, p = F.col(label), F.col(prediction)
    c = pred.agg(F.sum(((y == 1) & (p == 1)).cast("long")).alias("tp"),
                 F.sum(((y == 0) & (p == 1)).cast("long")).alias("fp"),
                 F.sum(((y == 1) & (p == 0)).cast("long")).alias("fn"),
                 F.sum(((y == 0) & (p == 0)).cast("long")).alias("tn"))

    def div(a, b):
        return F.when(b > 0, dbl(a) / dbl(nz(b))).otherwise(F.lit(0.0))

    def f1(pr, rc):
        return F.when(pr + rc > 0, F.lit(2.0) * pr * rc / (pr + rc)).otherwise(F.lit(0.0))

    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    m = c.select(
        div(tn, tn + fn).alias("p0"), div(tn, tn + fp).alias("r0"), (tn + fp).alias("s0"),
        div(tp, tp + fp).alias("p1"), div(tp, tp + fn).alias("r1"), (tp + fn).alias("s1"),
        div(tp + tn, tp + fp + fn + tn).alias("acc"), (tp + fp + fn + tn).alias("n"))
    m = m.withColumn("f0", f1(F.col("p0"), F.col("r0"))).withColumn("f1", f1(F.col("p1"), F.col("r1")))
    w0, w1 = dbl("s0") / dbl(nz("n")), dbl("s1") / dbl(nz("n"))
    rows = [
        (L.CLASS_NAMES[0], F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        (L.CLASS_NAMES[1], F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        ("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("acc"), F.col("n")),
        ("macro avg", (F.col("p0") + F.col("p1")) / 2, (F.col("r0") + F.col("r1")) / 2,
         (F.col("f0") + F.col("f1")) / 2, F.col("n")),
        ("weighted avg", F.col("p0") * w0 + F.col("p1") * w1, F.col("r0") * w0 + F.col("r1") * w1,
         F.col("f0") * w0 + F.col("f1") * w1, F.col("n")),
    ]
    arr = F.array(*[F.struct(F.lit(n).alias("class_label"), round_up(pr, 4).alias("precision"),
                             round_up(rc, 4).alias("recall"), round_up(f, 4).alias("f1_score"),
                             s.cast("long").alias("support")) for n, pr, rc, f, s in rows])
    return m.select(F.inline(arr))


# J46 ----------------------------------------------------------------------------
def pr_curve(scored: DataFrame, label: str = "is_returned", score: str = "score") -> DataFrame:
    """Precision and recall when flagging every row with score >= threshold,
    for each distinct score."""
    g = score_counts(scored, label, score)
    # one running sum for both counts: positives in the high digits, negatives in the low
    both = (F.col("pos").cast("decimal(38,0)") * F.lit(PACKED) + F.col("neg")).cast("decimal(38,0)")
    g = prefix_sum(g.withColumn("_both", both), [F.col(score).desc()], "_both", "_sum", total_out="_total")
    high = lambda c: F.call_function("div", F.col(c), F.lit(PACKED).cast("decimal(20,0)"))
    g = (g.withColumn("tp", high("_sum")).withColumn("_p", high("_total"))
          .withColumn("fp", (F.col("_sum") % F.lit(PACKED)).cast("long")))
    return g.select(F.col(score).alias("threshold"), "tp", "fp",
                    round_up(ratio("tp", F.col("tp") + F.col("fp")), 6).alias("precision"),
                    round_up(ratio("tp", "_p"), 6).alias("recall"))


# J47 ----------------------------------------------------------------------------
def threshold_table(scored: DataFrame, thresholds=(0.30, 0.40, 0.50, 0.60), label: str = "is_returned",
                    score: str = "score") -> DataFrame:
    """Precision, recall and rows flagged at each threshold (score >= t), in one scan."""
    y, s = F.col(label), dbl(score)
    aggs = []
    for i, t in enumerate(thresholds):
        hit = s >= F.lit(float(t))
        aggs += [F.sum((hit & (y == 1)).cast("long")).alias(f"tp{i}"),
                 F.sum((hit & (y == 0)).cast("long")).alias(f"fp{i}"),
                 F.sum(((~hit) & (y == 1)).cast("long")).alias(f"fn{i}")]
    one = scored.agg(*aggs)

    def div(a, b):
        return F.when(b > 0, dbl(a) / dbl(nz(b))).otherwise(F.lit(0.0))

    arr = F.array(*[F.struct(
        F.lit(float(t)).alias("threshold"),
        round_up(div(F.col(f"tp{i}"), F.col(f"tp{i}") + F.col(f"fp{i}")), 4).alias("precision"),
        round_up(div(F.col(f"tp{i}"), F.col(f"tp{i}") + F.col(f"fn{i}")), 4).alias("recall"),
        (F.col(f"tp{i}") + F.col(f"fp{i}")).alias("flagged")) for i, t in enumerate(thresholds)])
    return one.select(F.inline(arr))


# J48 ----------------------------------------------------------------------------
def feature_importance(model, spark, features=L.MODEL_FEATURES, k: int = 6) -> DataFrame:
    """Top-k importances of the fitted tree (one small row per feature)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature").limit(k)
