"""Merkle manifest of a table, by butterfly exchange between aligned blocks.

Each row is a leaf: a hash of its fields. The leaves of one group (a source), in order,
form a tree in which every ``FANOUT`` consecutive nodes become their parent; the roots of
the groups, in order, form a further tree of the same kind, whose root stands for the
table. A row's proof is the siblings on its way up: with them anyone can fold a leaf to
the root.

The leaves of a group are dealt into aligned blocks of ``FANOUT ** LOCAL`` places. A block is
one unit of work: it hashes its own subtree. From there on blocks exchange roots in a
butterfly: in round r the blocks whose numbers differ in digit r only (base FANOUT) swap the
roots of their subtrees, and each of them hashes the parent, all the same one. So after the
last round every block knows the root and all upper siblings, and there is no way back down.
Where the last subtree of a level is incomplete, its blocks also send for the places that
have none. A round moves one root per block (at most twice as many with the stand-ins), in
groups of at most FANOUT rows.

Numbering is by range partitions, so a group that holds any share of the rows is spread
over many tasks; blocks bound what a task holds.

Edge cases: a null field is hashed as ``-``; null groups come first and form a group; within
a group null ids come first, rows that repeat an id are ordered by their leaf (equal rows are
interchangeable); a group of one leaf has that leaf as its root; an empty table gives an
empty manifest; columns that are neither named nor carried are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.llm.common import staged
from tillpoint.operators.rank import global_row_number

FANOUT = 16
LOCAL = 3  # levels hashed inside a block: 4096 leaves
STEP = T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])


def joined_hash(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(*fields: Column) -> Column:
    """A row's leaf: per field its UTF-8 length, a colon and its text; ``-`` for null."""
    texts = [f.cast("string") for f in fields]
    return joined_hash(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                         for t in texts])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf gives with the siblings of a proof."""
    return F.aggregate(proof, leaf, lambda node, step: joined_hash(step["left"], node, step["right"]))


def proof_hash(proof: Column) -> Column:
    """Hash of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _parent(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def block_levels(leaves: list[str], levels: int) -> tuple[str, list[list[str]]]:
    """Root of a block and its nodes level by level, from the leaves up."""
    rows = [leaves]
    for _ in range(levels):
        below = rows[-1]
        rows.append([_parent(below[i:i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return rows[-1][0], rows[:-1]


def _siblings(nodes: list[str]) -> list[dict]:
    """Per node, the concatenated nodes of its run before and after it."""
    steps = []
    for at in range(0, len(nodes), FANOUT):
        run = nodes[at:at + FANOUT]
        ends = [0, *accumulate(map(len, run))]
        whole = "".join(run)
        steps += [{"left": whole[:ends[i]], "right": whole[ends[i + 1]:]} for i in range(len(run))]
    return steps


def _levels(count: Column) -> Column:
    """Height of a tree of ``count`` leaves: the least h with FANOUT ** h >= count."""
    return sum((count > F.lit(FANOUT ** h).cast("long")).cast("int") for h in range(15))


def _block_roots(laid: DataFrame, local: int) -> DataFrame:
    """tree, block, blocks, height, node: one row a block with the root of its leaves."""
    out = T.StructType([T.StructField("tree", T.LongType()), T.StructField("block", T.LongType()),
                        T.StructField("blocks", T.LongType()), T.StructField("height", T.IntegerType()),
                        T.StructField("node", T.StringType())])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        height = rows["height"][0].as_py()
        root, _ = block_levels(rows["leaf"].to_pylist(), min(local, height))
        first = rows.slice(0, 1).select(["tree", "block", "blocks", "height"])
        return first.append_column("node", pa.array([root]))

    return laid.groupBy("tree", "block").applyInArrow(run, out)


def _exchange(blocks: DataFrame, level: int, step: int) -> DataFrame:
    """One round: blocks that differ in digit ``step`` swap the roots of their subtrees, hash
    the parent and note the siblings. Trees that are whole below ``level`` wait."""
    width = FANOUT ** step
    working = blocks.filter(F.col("height") > level)
    sub, lane = F.expr(f"block div {width}"), F.pmod("block", F.lit(width))
    last = F.expr(f"(blocks - 1) div {width}")
    members = F.col("blocks") - last * width
    # The last subtree of the level may have fewer blocks than lanes: they send for the others.
    sends = (F.when((sub == last) & (sub % FANOUT > 0), F.sequence(lane, F.lit(width - 1).cast("long"), members))
             .otherwise(F.array(lane)))
    sent = (working.withColumn("_group", F.expr(f"block div {width * FANOUT}"))
            .withColumn("_digit", F.pmod(sub, F.lit(FANOUT)).cast("int"))
            .withColumn("_own", lane).withColumn("_lane", F.explode(sends)))
    meet = Window.partitionBy("tree", "_group", "_lane")
    sent = (sent.withColumn("_run", F.array_sort(F.collect_list(F.struct("_digit", "node")).over(meet)))
            .filter("_lane = _own"))
    side = lambda keep: F.array_join(F.transform(F.filter("_run", keep), lambda s: s["node"]), "")
    met = sent.select("tree", "block", "blocks", "height",
                      F.sha2(F.array_join(F.transform("_run", lambda s: s["node"]), ""), 256).alias("node"),
                      F.concat("path", F.array(F.struct(
                          side(lambda s: s["_digit"] < F.col("_digit")).alias("left"),
                          side(lambda s: s["_digit"] > F.col("_digit")).alias("right")))).alias("path"))
    return met.unionByName(blocks.filter(F.col("height") <= level))


def prove(nodes: DataFrame, carry: list[str], local: int = LOCAL) -> DataFrame:
    """``nodes``: tree, place (gapless from 0 in its tree), leaf, count (leaves of the tree), carried
    columns; a written table. Returns tree, place, leaf, the carried columns, ``top`` (root of
    the tree) and ``path``, the siblings from the leaf to that root."""
    size = FANOUT ** local
    laid = nodes.select("tree", F.expr(f"place div {size}").alias("block"), "place", "leaf", *carry,
                        F.expr(f"(count - 1) div {size} + 1").alias("blocks"), _levels(F.col("count")).alias("height"))
    roots = staged(_block_roots(laid.select("tree", "block", "place", "leaf", "blocks", "height"), local), "block-roots")
    highest = roots.agg(F.max("height")).first()[0] or 0
    blocks = roots.withColumn("path", F.array().cast(T.ArrayType(STEP)))
    for step, level in enumerate(range(local, highest)):
        blocks = _exchange(blocks, level, step)
    upper = blocks.select("tree", "block", F.col("node").alias("top"), F.col("path").alias("_upper"))

    kept = ["tree", "place", "leaf", *carry]
    found = T.StructType([f for f in laid.schema if f.name in kept]
                         + [T.StructField("top", T.StringType()), T.StructField("path", T.ArrayType(STEP))])
    names, into = [f.name for f in found][:-2], pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        if not len(rows):
            return rows.select(names)
        rows = rows.sort_by("place")
        _, levels = block_levels(rows["leaf"].to_pylist(), min(local, rows["height"][0].as_py()))
        steps = [_siblings(nodes) for nodes in levels]
        upper_path = above["_upper"][0].as_py()
        paths = [[level[i // FANOUT ** k] for k, level in enumerate(steps)] + upper_path for i in range(len(rows))]
        return (rows.select(names).append_column("top", pa.array([above["top"][0].as_py()] * len(rows)))
                .append_column("path", pa.array(paths, into)))

    return laid.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(run, found)


def manifest(rows: DataFrame, carry: list[str] | None = None, local: int = LOCAL) -> DataFrame:
    """``rows``: id, group, leaf and the columns in ``carry``. Returns id, group, place, leaf,
    subroot, root, proof (siblings from the leaf by the subroot to the root) and the carried
    columns, one row a row."""
    carry = carry or []
    named = rows.select("id", "group", "leaf", *carry).withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf").asc(), F.col("_row").asc()]
    numbered = global_row_number(named, order, "_rn")
    sizes = numbered.groupBy("group").agg(F.min("_rn").alias("start"), F.count(F.lit(1)).alias("count"))
    groups = staged(global_row_number(sizes, [F.col("group").asc_nulls_first()], "_tree", total_out="_trees"), "groups")
    # A written table has a known size: Catalyst broadcasts it if small, else joins by sorting, splitting hot groups.
    known = groups.withColumnRenamed("group", "_group")
    leaves = staged(numbered.join(known, numbered["group"].eqNullSafe(known["_group"]))
                    .select((F.col("_tree") - 1).alias("tree"), (F.col("_rn") - F.col("start")).alias("place"),
                            "count", "leaf", "id", *carry), "leaves")
    proved = prove(leaves, ["id", *carry], local)

    # The roots of the groups are the leaves of the tree above, proved in the same way.
    tops = proved.filter("place = 0").select((F.col("tree") + 1).alias("_tree"), F.col("top").alias("leaf"))
    above = staged(groups.join(tops, "_tree").select(
        F.lit(0).cast("long").alias("tree"), (F.col("_tree") - 1).alias("place"), F.col("_trees").alias("count"),
        "leaf", "group"), "group-roots")
    upper = staged(prove(above, ["group"], local).select(
        F.col("place").alias("tree"), "group", F.col("top").alias("root"), F.col("path").alias("_above")), "group-proofs")
    return proved.join(upper, "tree").select(
        "id", "group", "place", "leaf", F.col("top").alias("subroot"), "root",
        F.concat("path", "_above").alias("proof"), *carry)


def documents_manifest(docs: DataFrame, local: int = LOCAL) -> DataFrame:
    """Manifest of a ``documents`` table (grouped by source, ordered by doc_id), with the column
    ``changed``: the leaf of the tampered row. Tampering lower-cases the ASCII capitals of the
    text where the unsigned crc32 of the decimal doc_id is divisible by 5."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaf = leaf_hash(*others, F.col("text"))
    changed = F.when(hit, leaf_hash(*others, F.translate(F.col("text").cast("string"), upper, lower))).otherwise(leaf)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("group"),
                       leaf.alias("leaf"), changed.alias("changed"))
    return manifest(rows, ["changed"], local)
