"""Nearest neighbours by largest inner product, over shifted Hilbert orderings.

Every distinct vector is put on several Hilbert curves. Each curve runs through the grid of
another random projection (``DIMS`` orthonormal directions, a random shift of the grid), so
neighbours that one curve tears apart are close on another. For inner products a further
coordinate lifts all vectors to one norm, where the largest product is the least distance;
queries lie on the curves without it. All orderings are numbered by one range-partitioned
sort. A query looks at the window of places around its own on every curve: it visits the
cells (runs of places) that the window touches, the candidates of all windows merge, and
exact products in double precision on the original vectors rank them.

The window is measured, not guessed: the true neighbours of at most ``CALIBRATE`` queries,
found by one pass over all vectors, have a least distance in places over the curves, and
the window is the ``RECALL`` quantile of it. On data without structure it becomes a large share of the table;
that is what such data need. Rows of the index are never sampled; the projection's scale is fitted
on ``FIT_ROWS`` vectors.

Copies: equal vectors are one entry of the index with its k + 1 smallest ids, which is all that any
query can return of them; a vector that a third of all rows share costs as much as any other.

Memory: a cell has at most ``CELL`` vectors, and its visiting queries are dealt over lanes of about
as many.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do rows without an id; a shorter vector counts as padded with zeros; repeated rows count
once; rows of one id are never neighbours of each other, and an id with several vectors has one list
for each; with fewer candidates than k all are returned; ties go to the smaller id; without
queries the result is empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import staged
from tillpoint.operators.rank import global_row_number

ORDERINGS, DIMS, BITS = 8, 16, 4  # a key has DIMS * BITS = 64 bits
RECALL = 0.95  # of the calibration's neighbours, so that whole results stay above 0.9
CALIBRATE, FIT_ROWS = 256, 2048
CELL, LEAST_CELL = 16_384, 256
CHUNK = 256  # queries multiplied at a time
HITS = "q string, code string, least long, score double"


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column as float64, padded with zeros to ``dim``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of grid cells (rows of integers below 2 ** bits), as signed
    64-bit keys in curve order. Per bit, from the highest: a row whose bit is set is mirrored in
    the bits below, else it changes places with the first axis; the axes' bits then
    form a Gray code, read axis by axis."""
    x = cells.astype(np.uint64).copy()
    n, dims = x.shape
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, below = one << np.uint64(level), (one << np.uint64(level)) - one
        for axis in range(dims):
            set_ = (x[:, axis] & bit) != 0
            swap = np.where(set_, np.uint64(0), (x[:, 0] ^ x[:, axis]) & below)
            x[:, 0] ^= np.where(set_, below, swap)
            x[:, axis] ^= swap
    for axis in range(1, dims):
        x[:, axis] ^= x[:, axis - 1]
    flip = np.zeros(n, np.uint64)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        flip ^= np.where((x[:, -1] & bit) != 0, bit - one, np.uint64(0))
    x ^= flip[:, None]
    key = np.zeros(n, np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = (key << one) | ((x[:, axis] >> np.uint64(level)) & one)
    return (key ^ (one << np.uint64(dims * bits - 1))).astype(np.int64) if dims * bits == 64 else key.astype(np.int64)


@dataclass
class Curves:
    """Fitted orderings: per ordering a projection of the lifted vectors and a shifted grid."""

    dim: int
    norm: float
    turns: np.ndarray  # orderings x (dim + 1) x dims
    low: np.ndarray  # orderings x dims
    width: np.ndarray  # orderings
    bits: int

    def keys(self, vectors: np.ndarray, as_query: bool) -> np.ndarray:
        """orderings x rows."""
        length = np.sqrt((vectors * vectors).sum(axis=1))
        if as_query:
            lifted = np.column_stack([vectors * (self.norm / length)[:, None], np.zeros(len(vectors))])
        else:
            lifted = np.column_stack([vectors, np.sqrt(np.maximum(self.norm ** 2 - length ** 2, 0))])
        top = (1 << self.bits) - 1
        return np.stack([hilbert_keys(np.clip((lifted @ turn - low) / width, 0, top).astype(np.uint64), self.bits)
                         for turn, low, width in zip(self.turns, self.low, self.width)])


def fit_curves(sample: np.ndarray, norm: float, orderings: int = ORDERINGS, dims: int = DIMS, bits: int = BITS,
               seed: int = 11) -> Curves:
    """Random orthonormal projections; each grid spans ten standard deviations of the sample
    around its mean, shifted at random by up to one in either direction."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    dims = min(dims, dim + 1)
    lifted = np.column_stack([sample, np.sqrt(np.maximum(norm ** 2 - (sample * sample).sum(axis=1), 0))])
    turns, low, width = [], [], []
    for _ in range(orderings):
        turn = np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0][:, :dims]
        placed = lifted @ turn
        spread = max(float(np.sqrt(placed.var(axis=0).mean())), 1e-12)
        turns.append(turn)
        low.append(placed.mean(axis=0) - spread * (4 + 2 * rng.random(dims)))
        width.append(10 * spread / (1 << bits))
    return Curves(dim, norm, np.stack(turns), np.stack(low), np.array(width), bits)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in one fixed order."""
    return (a * b).sum(axis=1)


def best_pairs(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, vector rows and products of each query's k best vectors, all ties included."""
    rows, cols = [], []
    for at in range(0, len(queries), CHUNK):
        score = queries[at:at + CHUNK] @ vectors.T
        if len(vectors) > k:
            edge = np.partition(score, -k, axis=1)[:, -k]
            # the matrix product rounds otherwise than ``products``: look a little below the edge
            keep = score >= (edge - 1e-12 * np.maximum(1.0, np.abs(score).max(axis=1)))[:, None]
        else:
            keep = np.ones(score.shape, bool)
        i, j = np.nonzero(keep)
        rows.append(i + at)
        cols.append(j)
    i, j = np.concatenate(rows), np.concatenate(cols)
    exact = np.concatenate([products(queries[i[s:s + 65536]], vectors[j[s:s + 65536]]) for s in range(0, len(i), 65536)])
    return i, j, exact


def _usable(df: DataFrame, is_query: Column, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v, asked, code (128 bits of hash, by which equal vectors meet)."""
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(finite & F.exists("v", lambda x: x != 0))
    part = lambda h: F.lpad(F.hex(h), 16, "0")
    return rows.withColumn("code", F.concat(part(F.xxhash64("v")), part(F.xxhash64(F.lit(1), "v"))))


def _curve_rows(vectors: DataFrame, curves: Curves) -> DataFrame:
    """ordering, key, kind (0 entry of the index, 1 query), code."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix, asked = _matrix(batch.column("v"), curves.dim), batch.column("asked").to_numpy(zero_copy_only=False)
            codes = np.array(batch.column("code").to_pylist(), object)
            for kind, mask in ((0, np.ones(len(codes), bool)), (1, asked.astype(bool))):
                if mask.any():
                    for number, keys in enumerate(curves.keys(matrix[mask], kind == 1)):
                        n = len(keys)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, number, np.int32)), pa.array(keys), pa.array(np.full(n, kind, np.int32)),
                             pa.array(codes[mask], pa.string())], ["ordering", "key", "kind", "code"])

    return vectors.select("code", "v", "asked").mapInArrow(run, "ordering int, key long, kind int, code string")


def _true_pairs(vectors: DataFrame, names: list[str], queries: np.ndarray, k: int) -> DataFrame:
    """The k best other vectors of a few queries, by a pass over all vectors (q, code)."""
    dim, own = queries.shape[1], np.array(names, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            codes = np.array(batch.column("code").to_pylist(), object)
            i, j, score = best_pairs(queries, _matrix(batch.column("v"), dim), k + 1)
            other = own[i] != codes[j]
            held.append((i[other], codes[j][other], score[other]))
            i, c, score = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((-score, i))
            rank = np.arange(len(i)) - np.searchsorted(i[order], i[order])
            best = order[rank < k]  # at most k a query go on
            held = [(i[best], c[best], score[best])]
        if held:
            i, c, score = held[0]
            yield pa.RecordBatch.from_arrays([pa.array(own[i], pa.string()), pa.array(c, pa.string()), pa.array(score)],
                                             ["q", "code", "score"])

    found = vectors.select("code", "v").mapInArrow(run, "q string, code string, score double")
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "code")
    return found.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= k).select("q", "code")


def measured_window(vectors: DataFrame, numbered: DataFrame, dim: int, k: int, calibrate: int, recall: float) -> int:
    """Places to either side within which ``recall`` of the true neighbours of at most
    ``calibrate`` queries (the first by hash) lie on at least one curve."""
    asked = vectors.filter("asked").orderBy("code").limit(calibrate).select("code", "v").toArrow()
    names = asked["code"].to_pylist()
    pairs = staged(_true_pairs(vectors, names, _matrix(asked["v"], dim), k), "true-pairs")  # <= calibrate * k rows
    here = numbered.filter("kind = 1").join(F.broadcast(pairs.select(F.col("q").alias("code")).distinct()), "code")
    here = here.select(F.col("code").alias("q"), "ordering", F.col("pos").alias("own"))
    there = numbered.filter("kind = 0").join(F.broadcast(pairs), "code").select("q", "code", "ordering", "pos")
    away = (there.join(here, ["q", "ordering"]).groupBy("q", "code").agg(F.min(F.abs(F.col("pos") - F.col("own"))).alias("away")))
    places = [r["away"] for r in away.collect()]  # bounded like ``pairs``
    return int(np.quantile(places, recall, method="higher")) if places else 1


def _visits(vectors: DataFrame, numbered: DataFrame, dim: int, window: int, total: int, asked: int, k: int, cell: int) -> DataFrame:
    """q, code, least, score: each query's best in every cell that its windows touch."""
    size = max(LEAST_CELL, min(window, cell))
    lanes = max(1, -(-min(asked, 2 * (window + size)) // cell))
    place = lambda p: F.expr(f"cast(({p}) div {size} AS int)")
    entries = (numbered.filter("kind = 0")
               .select("ordering", place("pos").alias("cell"), "code", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
               .join(vectors.select("code", "v", F.col("ids")[0].alias("least")), "code"))
    queries = (numbered.filter("kind = 1")
               .select("ordering", F.pmod(F.xxhash64("code", F.lit(5)), F.lit(lanes)).cast("int").alias("lane"), "code",
                       F.explode(F.sequence(place(f"greatest(pos - {window}, 0)"), place(f"least(pos + {window}, {total - 1})"))).alias("cell"))
               .join(vectors.select("code", "v"), "code"))

    def run(asking: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asking) or not len(held):
            return pa.table({"q": pa.array([], pa.string()), "code": pa.array([], pa.string()),
                             "least": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        i, j, score = best_pairs(_matrix(asking["v"], dim), _matrix(held["v"], dim), k + 1)
        return pa.table({"q": asking["code"].take(pa.array(i)), "code": held["code"].take(pa.array(j)),
                         "least": held["least"].take(pa.array(j)), "score": pa.array(score)})

    keys = ["ordering", "cell", "lane"]
    renewed = queries.select(*[F.col(c).alias(c) for c in (*keys, "code", "v")])  # own columns on either side
    return renewed.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInArrow(run, HITS)


def _own_products(vectors: DataFrame, dim: int) -> DataFrame:
    """Each query vector as a candidate of its own: its copies are its neighbours."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch.column("v"), dim)
            yield pa.RecordBatch.from_arrays([batch.column("code"), batch.column("code"), batch.column("least"),
                                              pa.array(products(matrix, matrix))], ["q", "code", "least", "score"])

    return vectors.filter("asked").select("code", "v", F.col("ids")[0].alias("least")).mapInArrow(run, HITS)


def search(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           recall: float = RECALL, calibrate: int = CALIBRATE, orderings: int = ORDERINGS, cell: int = CELL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows of every row where ``is_query``."""
    rows = _usable(df, is_query, id_col, vec_col)
    single = rows.groupBy("code", "vec_id").agg(F.first("v").alias("v"))
    smallest = Window.partitionBy("code").orderBy("vec_id")
    entries = (single.withColumn("_rn", F.row_number().over(smallest)).filter(F.col("_rn") <= k + 1)
               .groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v")))
    asking = staged(rows.filter("asked").select(F.col("vec_id").alias("query_id"), "code").distinct(), "queries")
    marks = asking.select("code").distinct().withColumn("asked", F.lit(True))
    vectors = staged(entries.join(marks, "code", "left").withColumn("asked", F.coalesce("asked", F.lit(False))), "vectors")

    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asked").cast("long")).alias("asked"),
                        F.max(F.size("v")).alias("dim"), F.max(norm).alias("norm")).first()
    total = facts["n"] + (facts["asked"] or 0)
    if not facts["asked"]:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = facts["dim"]
    sample = _matrix(vectors.orderBy("code").limit(FIT_ROWS).select("v").toArrow()["v"], dim)
    curves = fit_curves(sample, facts["norm"], orderings)
    order = [F.col(c).asc() for c in ("ordering", "key", "kind", "code")]
    numbered = global_row_number(_curve_rows(vectors, curves), order, "_rn")
    numbered = numbered.withColumn("pos", F.pmod(F.col("_rn") - 1, F.lit(total))).drop("_rn", "key")

    window = measured_window(vectors, numbered, dim, k, calibrate, recall)
    hits = _visits(vectors, numbered, dim, window, total, facts["asked"], k, cell).unionByName(_own_products(vectors, dim))
    hits = hits.groupBy("q", "code").agg(F.max("score").alias("score"), F.min("least").alias("least"))
    nearest = Window.partitionBy("q").orderBy(F.col("score").desc(), "least")
    top = hits.withColumn("_rn", F.row_number().over(nearest)).filter(F.col("_rn") <= k + 1).select("q", "code", "score")
    ids = top.join(vectors.select("code", "ids"), "code").select("q", "score", F.explode("ids").alias("vec_id"))
    first = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    ids = ids.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= k + 1)
    lists = ids.groupBy(F.col("q").alias("code")).agg(F.sort_array(F.collect_list(F.struct("_rn", "vec_id", "score"))).alias("list"))
    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (asking.join(lists, "code").select("query_id", F.posexplode(others).alias("_at", "_hit"))
            .select("query_id", (F.col("_at") + 1).alias("rank"), "_hit.vec_id", "_hit.score"))
