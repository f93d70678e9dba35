"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import staged

LINKS_DDL = "u long, v long"
FOLD = 500_000  # links that a task holds at a time


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) -> the links of a task, ``FOLD`` at a time, as stars: every node but the least of
    its group points to the least. The same nodes stay connected."""
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        while (above := parent.setdefault(node, node)) != node:
            parent[node] = node = parent[above]
        return node

    def stars() -> pa.RecordBatch:
        pairs = [(node, root(node)) for node in list(parent)]
        parent.clear()
        pairs = [(u, v) for u, v in pairs if u != v]
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in pairs], pa.int64()),
                                           pa.array([v for _, v in pairs], pa.int64())], names=["u", "v"])

    held = 0
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
        held += batch.num_rows
        if held >= FOLD:
            yield stars()
            held = 0
    yield stars()


def _star(edges: DataFrame) -> DataFrame:
    """Columns u, v, m: each neighbour v of u with the least node m around u (u included)."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.selectExpr("inline(array(struct(u, v), struct(v AS u, u AS v)))")
    return _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return _star(down).selectExpr("inline(array(struct(v AS u, m AS v), struct(u, m AS v)))").filter("u <> v")


def _settled(edges: DataFrame) -> bool:
    """Whether all links are stars already: who points to a node points to one only, and
    nobody points to them."""
    ends = edges.selectExpr("inline(array(struct(u AS node, 1 AS leaving, 0 AS entering), "
                            "struct(v AS node, 0 AS leaving, 1 AS entering)))")
    return ends.groupBy("node").agg(F.sum("leaving").alias("leaving"), F.max("entering").alias("entering")).filter(
        "leaving > 1 OR leaving = 1 AND entering = 1").isEmpty()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (u, v) -> node, component (the smallest node reachable), for every node
    that has a link. Every task first folds the links it reads into stars. The edge table is
    written to the shared folder after each round and never leaves the executors; a node
    with many links only meets map-side aggregates and joins that can split it. Rounds end
    when all edges are stars."""
    edges = staged(links.select("u", "v").filter("u <> v").mapInArrow(_folded, LINKS_DDL).distinct(), "links")
    for _ in range(max_rounds):
        if _settled(edges):
            break
        edges = staged(_small_star(_large_star(edges).distinct()).distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
