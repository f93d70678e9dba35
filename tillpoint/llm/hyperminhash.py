"""Near-duplicate documents by HyperMinHash.

1. *Registers.* A document's set is its distinct word shingles. Each of ``bands x
   rows`` buckets has its own hash function and keeps the minimum over the set, stored
   as a count of leading zeros plus the next 10 bits (16 bits instead of the hash).
   (One hash per bucket instead of dealing a single hash's values over the buckets:
   short documents would leave most buckets empty.) Documents with equal sets are one
   class, named by its smallest doc_id; only classes go on.
2. *Candidates.* ``rows`` registers make a band; classes that agree in a band share a
   bucket. A bucket never emits its pairs: its smallest class is paired with the
   others. After these links are known, buckets of three or more whose members are not
   yet all connected are compared inside, in blocks of bounded size that are dealt
   over the tasks: two classes of different components meet in the first band they
   share, are estimated and verified there, and only links that join components leave
   the block. So any two classes that share a bucket were compared or are connected,
   and what is emitted grows with the classes, not with their pairs.
3. *Estimate.* The share of equal registers, corrected for chance collisions of the
   compressed values, must reach the threshold less a margin of five standard errors.
4. *Verification.* The full shingle sets of the surviving pairs decide.
5. *Components* of the verified links (``components.py``).

With 48 bands of 6 registers a pair at similarity 0.8 is missed by all bands with
probability 5e-7.

Edge cases: null, empty and blank texts have an empty set and link with nothing; a
text with fewer words than a shingle is one shingle; a null doc_id links with nothing
(component_id null, kept); repeated rows are all returned, a doc_id repeated with
other texts names each of their classes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import drop_rows, id_text, staged, text_bytes
from tillpoint.llm.components import connected_components

BANDS, ROWS = 48, 6
MANTISSA = 10  # bits
MARGIN = 0.125  # the estimate may be this far below the threshold
BLOCK = 2000  # classes of a chunk of a bucket; two chunks are compared at a time
BLOCK_SHINGLES = 1 << 20  # and shingles of a chunk
PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(body: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text. Words are runs of
    anything but ASCII white space, A-Z lower-cased."""
    tokens = body.lower().split()
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, n)
    size = min(words, n)
    s = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        s = (s ^ (s >> np.uint64(32))) * PRIME + w[i:n - size + 1 + i]
    s = (s ^ (s >> np.uint64(29))) * PRIME
    return np.unique(s ^ (s >> np.uint64(32)))


def bucket_hashes(count: int) -> np.ndarray:
    """Odd multipliers, one hash function for each bucket."""
    return np.random.default_rng(20240607).integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def registers(shingles: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers: minimum per bucket, as leading zeros and 10 more bits."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(hashes), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(values), 512):
        np.minimum(least, (hashes[:, None] * values[None, at:at + 512]).min(axis=1), out=least)
    bits = np.frexp(least.astype(np.float64))[1].astype(np.uint64)  # bit length
    zeros = np.uint64(32) - bits
    mantissa = ((least.astype(np.uint64) << (zeros + np.uint64(1))) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimate of register rows. Two different minima agree
    in their compressed form with probability about 0.72 * 2^-10 * n_a n_b / (n_a + n_b)^2."""
    return estimate_of((a == b).mean(axis=-1), n_a, n_b)


def estimate_of(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    chance = 0.72 * 2.0 ** -MANTISSA * n_a * n_b / (n_a + n_b) ** 2
    return (equal - chance) / (1 - chance)


def _sketch(words: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = bucket_hashes(buckets)
        for batch in batches:
            sizes, set_ids, regs = [], [], []
            for scalar in batch.column(1):
                s = shingle_set(scalar.as_py(), words)
                sizes.append(len(s))
                set_ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                regs.append(registers(s, hashes).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(set_ids, pa.binary()),
                 pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "set_id", "registers"])
    return run


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _passing(threshold: float):
    """(u, v, registers and sizes of both) -> (u, v) whose estimate passes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                j = estimate(_matrix(batch.column("reg_u"), "<u2"), _matrix(batch.column("reg_v"), "<u2"),
                             batch.column("n_u").to_numpy(), batch.column("n_v").to_numpy())
                yield batch.select(["u", "v"]).filter(pa.array(j >= threshold - MARGIN))
    return run


def _block_links(threshold: float, percent: int, rows: int):
    """One block of a bucket: verified links, given as the names of the components that they
    join. A block pairs its chunk ``lo`` with its chunk ``hi``. A pair is looked at only in the first band
    that it shares, and not once its components are joined in this block."""
    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        regs = _matrix(block.column("registers").chunk(0), "<u2")
        sets = [np.frombuffer(s, np.uint64) for s in block.column("set").to_pylist()]
        n, rep = block.column("n_shingles").to_numpy(), block.column("rep").to_numpy()
        named, comp = np.unique(block.column("comp").to_numpy(), return_inverse=True)
        own = comp.copy()  # the components before this block's links
        chunk = block.column("chunk").to_numpy()
        lo, hi, band = (int(block.column(c)[0].as_py()) for c in ("lo", "hi", "b"))
        left, right = np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi)
        links = []
        for i in left:
            others = right[(comp[right] != comp[i]) & ((rep[right] > rep[i]) | (lo != hi))]
            if not len(others):
                continue
            equal = regs[others] == regs[i]
            shared = equal.reshape(len(others), -1, rows).all(axis=2)
            likely = estimate_of(equal.mean(axis=1), n[i], n[others]) >= threshold - MARGIN
            for j in others[likely & (shared.argmax(axis=1) == band)]:
                if comp[i] != comp[j]:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        links.append((int(named[own[i]]), int(named[own[j]])))
                        comp[comp == comp[j]] = comp[i]
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})
    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(s.as_py(), words).tobytes() for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["rep", "set"])
    return run


def _confirmed(percent: int):
    """Exact test on full sets: 100 x intersection >= percent x union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("set_u"), batch.column("set_v")):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))
    return run


def near_groups(df: DataFrame, words: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable
    over links), kept (doc_id is the component_id)."""
    docs = id_text(df, id_col, text_col)
    percent = round(100 * threshold)
    sketches = staged(docs.select("doc_id", text_bytes().alias("body")).mapInArrow(
        _sketch(words, bands * rows), "doc_id long, n_shingles long, set_id binary, registers binary"), "sketches")
    usable = sketches.filter(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    classes = staged(usable.groupBy("set_id", "n_shingles", "registers").agg(F.min("doc_id").alias("rep")), "classes")
    keys = (f"inline(transform(sequence(0, {bands - 1}), "
            f"b -> struct(b, xxhash64(substring(registers, b * {2 * rows} + 1, {2 * rows}), b) AS band)))")
    banded = classes.selectExpr("rep", "n_shingles", keys)
    shared = (banded.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("first"),
                                         F.sum("n_shingles").alias("shingles"))
              .filter("members > 1"))
    in_bucket = staged(banded.drop("n_shingles").join(shared, "band"), "members")
    sketch = classes.select("rep", "n_shingles", "registers")

    # Full sets, from the whole texts, of the classes that share a bucket with another.
    wanted = in_bucket.select(F.col("rep").alias("doc_id")).distinct()
    sets = staged(docs.join(wanted, "doc_id", "left_semi").select("doc_id", text_bytes().alias("body"))
                  .mapInArrow(_sets(words), "rep long, set binary"), "sets")

    def side(name: str) -> DataFrame:
        return sketch.select(F.col("rep").alias(name), F.col("registers").alias(f"reg_{name}"),
                             F.col("n_shingles").alias(f"n_{name}"))

    star = in_bucket.filter("rep <> first").select(F.col("first").alias("u"), F.col("rep").alias("v")).distinct()
    passing = staged(star.join(side("v"), "v").join(side("u"), "u")
                     .mapInArrow(_passing(threshold), "u long, v long"), "passing")
    full = (passing.join(sets.select(F.col("rep").alias("v"), F.col("set").alias("set_v")), "v")
            .join(sets.select(F.col("rep").alias("u"), F.col("set").alias("set_u")), "u"))
    links = staged(full.mapInArrow(_confirmed(percent), "u long, v long"), "verified")
    nodes = connected_components(links)

    # Buckets of three or more that are not yet one component: compare what is left.
    labelled = (in_bucket.filter("members > 2")
                .join(nodes.withColumnRenamed("node", "rep"), "rep", "left")
                .select("band", "b", "members", "shingles", "rep", F.coalesce("component", "rep").alias("comp")))
    # Any difference of least and greatest shows more than one component; a map-side aggregate.
    open_bands = (labelled.groupBy("band").agg(F.min("comp").alias("least"), F.max("comp").alias("greatest"))
                  .filter("least <> greatest").select("band"))
    chunks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    blocks = (labelled.join(open_bands, "band")
              .withColumn("chunk", F.pmod(F.xxhash64("rep"), chunks).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
              .withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other"))
              .join(sketch, "rep").join(sets, "rep"))
    late = staged(blocks.groupBy("band", "lo", "hi")
                  .applyInArrow(_block_links(threshold, percent, rows), "u long, v long").distinct(), "late")
    if not late.isEmpty():  # these links are between components: only those are joined further
        joined = connected_components(late).select(F.col("node").alias("_of"), F.col("component").alias("_in"))
        renamed = nodes.join(joined, F.col("component") == F.col("_of"), "left").select(
            "node", F.coalesce("_in", "component").alias("component"))
        alone = joined.select(F.col("_of").alias("node"), F.col("_in").alias("component"))
        nodes = renamed.unionByName(alone.join(nodes, "node", "left_anti"))

    named = (sketches.select("doc_id", "n_shingles", "set_id")
             .join(classes.select("set_id", "rep"), "set_id", "left")
             .join(nodes.withColumnRenamed("node", "rep"), "rep", "left")
             .select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id")))
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(df: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Rows of ``df`` that stay, with all their columns: one document of each group."""
    kept = near_groups(df, words, threshold, id_col=id_col, text_col=text_col).filter("kept").select("doc_id")
    renamed = df if id_col == "doc_id" else df.withColumnRenamed(id_col, "doc_id")
    stay = drop_rows(renamed, kept)
    return stay if id_col == "doc_id" else stay.withColumnRenamed("doc_id", id_col)
