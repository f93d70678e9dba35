"""Nearest neighbours over Hilbert orderings against all inner products."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillpoint.llm import hilbert_search

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every, k=20):
    """Ranked (id, score) of every query by all products, one list per query id."""
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ok = list({(i, v.tobytes()): (i, v) for i, v in ok}.values())
    width = max((len(v) for _, v in ok), default=0)
    ids = np.array([i for i, _ in ok])
    mat = np.array([np.pad(v, (0, width - len(v))) for _, v in ok])
    out = {}
    for i, v in zip(ids, mat):
        if i % every == 0:
            score = (mat * v).sum(axis=1)
            out[int(i)] = [(int(j), float(s)) for s, j in sorted((-s, j) for s, j in zip(score, ids) if j != i)[:k]]
            out[int(i)] = [(j, -s) for j, s in out[int(i)]]
    return out


def found(df):
    lists = {}
    for r in df.orderBy("query_id", "rank").collect():
        lists.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for got in lists.values():
        assert [x[0] for x in got] == list(range(1, len(got) + 1))
        assert got == sorted(got, key=lambda x: (-x[2], x[1]))
    return {q: [x[1:] for x in got] for q, got in lists.items()}


def recall(got, expected):
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in e}) for q, e in expected.items())
    return hits / sum(len(e) for e in expected.values())


def test_hilbert_keys_walk_through_neighbouring_cells():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = hilbert_search.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_whole_table(spark):
    from tillpoint.llm.queries import op11_hilbert_search
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    expected, got = plain(rows, 20), found(op11_hilbert_search(spark, SF))
    assert set(got) == set(expected) and all(len(v) == 20 for v in got.values())
    assert recall(got, expected) >= 0.9
    exact = {i: np.array(v, np.float64) for i, v in rows}
    assert all(abs(s - float(exact[q] @ exact[j])) < 1e-12 for q, v in got.items() for j, s in v)


@pytest.mark.parametrize("cell", [256, 300])
def test_structured_vectors_and_a_hot_one(spark, cell):
    """Clusters of different norms, and one vector that a third of all rows share; small cells,
    several lanes."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(30, 24)) * 3
    vectors = centre[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 24)) * 0.5
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5000 + i, centre[0].tolist()) for i in range(1500)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(6)
    got = found(hilbert_search.search(df, F.col("vec_id") % 20 == 0, cell=cell, calibrate=40))
    expected = plain(rows, 20)
    assert set(got) == set(expected) and recall(got, expected) >= 0.9
    assert all([j for j, _ in got[q]] == [j for j, _ in expected[q]] for q in range(5000, 6500, 20))


def test_awkward_vectors(spark):
    """Null, empty, zero, non-finite and short vectors, null and repeated ids, ties, fewer
    candidates than k: with so few rows the result is exact."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (6, [None, 1.0]), (7, [1.0]), (8, [1.0, 1.0]), (9, [1.0, 1.0]), (10, [1.0, 1.0]), (None, [5.0, 5.0]),
            (40, [1.0, 1.0]), (60, None), (80, [0.0]), (11, [-3.0, 1.0]), (11, [-3.0, 1.0]), (100, [2.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("code", F.lit("clash")).withColumn("pos", F.lit(1))
    got = found(hilbert_search.search(df, F.col("vec_id") % 20 == 0))
    assert got == plain(rows, 20)
    three = found(hilbert_search.search(df, F.col("vec_id") % 20 == 0, k=3))
    assert three == plain(rows, 20, k=3)


def test_nothing_to_search(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hilbert_search.search(empty, F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(20, [1.0, 2.0], 0)], SCHEMA)
    assert hilbert_search.search(one, F.col("vec_id") % 20 == 0).count() == 0
    unasked = spark.createDataFrame([(21, [1.0, 2.0], 0)], SCHEMA)
    assert hilbert_search.search(unasked, F.col("vec_id") % 20 == 0).count() == 0
