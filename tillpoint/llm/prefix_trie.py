"""Prefix trie of conversations in balanced parentheses, built shard by shard.

Each conversation is a path of 20-byte entries, one a turn: 16 bytes of a digest of (role,
text) and 4 bytes with the words of the text. Equal paths are counted first, so a path that
any share of the conversations has is one row. The distinct paths are sorted over range
partitions; a shard is a run of neighbouring paths with a bounded number of nodes.

A shard writes its trie as balanced parentheses (a node opens before and closes after its
subtree). ``Parentheses`` keeps the least excess of every block in a range min tree, by
which findclose finds where each subtree ends; the rank of the pairs ``()`` counts leaves;
cumulative arrays in opening order give the conversations and the savings of any subtree.

Only the nodes on a shard's first and last path, its spines, can lie in other shards too.
They are merged by the digest of their path: first their conversations, then, once these
are known, each node's own saving is added along the spines of the one shard that owns it
(the first that has it) and the shards' shares are summed. Everything else of a shard is
final at once. Spines have at most two paths a shard; no step gathers more than that.

The ids of the conversations that end at a node are hashed in order from chunks of about
8 KB that range partitions prepare, so that the one task that a path's hash needs reads few,
ready-made pieces.

Memory: texts are never gathered. A conversation's entries make one row (20 bytes a turn).

Edge cases: a null role or text counts as empty; turns are ordered by turn, null first, ties
by the entry; repeated rows are repeated turns; a row without conv_id belongs to no
conversation and is left out; for negative ids c%20 is the remainder from 0 to 19; a
conversation may be turnless and ends at the root; an empty table gives no nodes; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import staged

ENTRY = 20
CHUNK = 8192  # bytes of ids hashed as one piece
SHARD_NODES = 1 << 19
BLOCK = 64  # parentheses in a block of the range min tree
NO_ENDS = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"

NODE_TYPES = {"shard": pa.int64(), "slot": pa.int64(), "parent_slot": pa.int64(), "depth": pa.int64(),
              "spine": pa.bool_(), "branch": pa.int32(), "fork": pa.int64(), "node": pa.binary(),
              "conv_id": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(),
              "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "words": pa.int64(), "has_child": pa.bool_(),
              "ends_sha256": pa.string()}
NODE_SCHEMA = ("shard long, slot long, parent_slot long, depth long, spine boolean, branch int, fork long, node binary, "
               "conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
               "words long, has_child boolean, ends_sha256 string")


class Parentheses:
    """Balanced parentheses (1 opens, 0 closes) with a range min tree over blocks of excess."""

    def __init__(self, bits: np.ndarray, block: int = BLOCK):
        self.bits, self.block = bits, block
        self.excess = np.cumsum(bits.astype(np.int64) * 2 - 1)
        padded = np.full(-(-len(bits) // block) * block, np.iinfo(np.int64).max)
        padded[:len(bits)] = self.excess
        self.mins = [padded.reshape(-1, block).min(axis=1)]
        while len(self.mins[-1]) > 1:
            low = self.mins[-1]
            low = np.append(low, np.iinfo(np.int64).max) if len(low) % 2 else low
            self.mins[-1] = low
            self.mins.append(low.reshape(-1, 2).min(axis=1))
        pairs = np.zeros(len(bits) + 1, np.int64)
        pairs[1:-1] = np.cumsum((bits[:-1] == 1) & (bits[1:] == 0))
        pairs[-1] = pairs[-2]
        self.pairs = pairs  # pairs[i]: leaf pairs that start before position i

    def _scan(self, start: np.ndarray, until: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First position in [start, until) whose excess is ``target``, else -1."""
        found, left = np.full(len(start), -1), np.arange(len(start))
        for step in range(self.block):
            left = left[start[left] + step < until[left]]
            if not len(left):
                break
            hit = self.excess[start[left] + step] == target[left]
            found[left[hit]] = start[left[hit]] + step
            left = left[~hit]
        return found

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """Position of the parenthesis that closes each of ``opens``."""
        target = self.excess[opens] - 1
        own_end = np.minimum((opens // self.block + 1) * self.block, len(self.bits))
        close = self._scan(opens + 1, own_end, target)
        far = np.flatnonzero(close < 0)
        if not len(far):
            return close
        # Up from the own block until a right neighbour reaches the target, then down in it.
        at, reached = opens[far] // self.block, np.full(len(far), -1)
        for level, low in enumerate(self.mins[:-1]):
            open_ = np.flatnonzero(reached < 0)
            left_child = open_[at[open_] % 2 == 0]
            hit = left_child[low[at[left_child] + 1] <= target[far[left_child]]]
            at[hit] += 1
            reached[hit] = level
            still = np.flatnonzero(reached < 0)
            at[still] //= 2
        for level in range(len(self.mins) - 2, 0, -1):
            down = np.flatnonzero(reached == level)
            at[down] *= 2
            at[down] += self.mins[level - 1][at[down]] > target[far[down]]
            reached[down] = level - 1
        start = at * self.block
        close[far] = self._scan(start, np.minimum(start + self.block, len(self.bits)), target[far])
        return close


def _shared(a: bytes, b: bytes) -> int:
    """Number of leading entries that two paths share."""
    n = min(len(a), len(b)) // ENTRY
    if a[:n * ENTRY] == b[:n * ENTRY]:
        return n
    lo, hi = 0, n  # the first lo entries are equal, the first hi are not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo * ENTRY:mid * ENTRY] == b[lo * ENTRY:mid * ENTRY] else (lo, mid)
    return lo


def _path_digests(path: bytes) -> list[bytes]:
    running, out = hashlib.sha256(), [hashlib.sha256().digest()]
    for at in range(0, len(path), ENTRY):
        running.update(path[at:at + ENTRY])
        out.append(running.copy().digest())
    return out


def _least_below(least: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> None:
    """Turn each node's least id into that of its subtree, deepest nodes first."""
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for nodes in np.split(order, cuts):
        if depth[nodes[0]] > 0:
            np.minimum.at(least, parent[nodes], least[nodes])


def shard_nodes(shard: int, paths: list[bytes], counts: list[int], firsts: list[int], ends: list[str]) -> pa.Table:
    """Rows of one shard's trie; ``paths`` are distinct and ascending."""
    bits, depth, parent, words = bytearray(b"\1"), [0], [0], [0]
    stack, end_of, before = [0], [], b""
    for path in paths:
        common, length = _shared(before, path), len(path) // ENTRY
        bits.extend(b"\0" * (len(stack) - 1 - common))
        del stack[common + 1:]
        for d in range(common, length):
            parent.append(stack[-1])
            stack.append(len(depth))
            depth.append(d + 1)
            words.append(int.from_bytes(path[d * ENTRY + 16:(d + 1) * ENTRY], "big"))
        bits.extend(b"\1" * (length - common))
        end_of.append(stack[-1])
        before = path
    bits.extend(b"\0" * len(stack))
    depth, parent, words, end_of = (np.array(x, np.int64) for x in (depth, parent, words, end_of))
    n = len(depth)

    tree = Parentheses(np.frombuffer(bytes(bits), np.uint8))
    opens = np.flatnonzero(tree.bits)
    close = tree.findclose(opens)
    until = np.arange(n) + (close - opens + 1) // 2  # a subtree is the opening numbers [i, until)

    def below(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values)))
        return total[until] - total[:n]

    spine = np.zeros(n, bool)
    spine[:depth[end_of[0]] + 1] = True  # the first path opens first
    branch = np.where(spine, 0, 1)
    fork = _shared(paths[0], paths[-1])
    spine[stack] = True

    here, least = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    here[end_of], least[end_of] = counts, firsts
    n_convs = below(here)
    _least_below(least, parent, depth)
    has_child = np.zeros(n, bool)
    has_child[parent[1:]] = True
    final_children = np.bincount(parent[1:][~spine[1:]], minlength=n)
    leaves = tree.pairs[close] - tree.pairs[opens] - below(spine & ~has_child)
    saved = below(np.where(spine, 0, (n_convs - 1) * words))

    node = np.full(n, None, object)
    for path, nodes in ((paths[0], range(depth[end_of[0]] + 1)), (paths[-1], stack)):
        node[list(nodes)] = _path_digests(path)
    ended = np.full(n, None, object)
    ended[end_of] = ends
    parent_conv = pa.array(least[parent], mask=spine[parent])
    values = {"shard": np.full(n, shard), "slot": np.arange(n), "parent_slot": parent, "depth": depth, "spine": spine,
              "branch": branch, "fork": np.full(n, fork), "node": node, "conv_id": least, "parent_conv_id": parent_conv,
              "n_convs": n_convs, "n_children": final_children, "n_leaves": leaves, "saved_tokens": saved,
              "words": words, "has_child": has_child, "ends_sha256": ended}
    return pa.table({k: v if isinstance(v, pa.Array) else pa.array(v, kind) for (k, kind), v in
                     zip(NODE_TYPES.items(), values.values())})


def conversation_paths(df: DataFrame) -> DataFrame:
    """conv_id, path: the entries of each rebuilt conversation. The first h turns are those of
    conversation c - c%20, h = crc32(c) % 4; the others are its own."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    entry = F.concat(digest, F.lpad(F.hex(F.regexp_count(text, F.lit(WORD))), 8, "0"))
    turns = (df.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("t"), entry.alias("e")).alias("turn"))
             .filter("conv_id IS NOT NULL"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    own = staged(own.select("conv_id", F.transform("turns", lambda t: t["e"]).alias("entries")), "conversations")
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(20))
    heads = own.filter(F.pmod("conv_id", F.lit(20)) == 0).select(F.col("conv_id").alias("base"), F.slice("entries", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    rebuilt = own.withColumn("base", base).join(heads, "base", "left").select("conv_id", F.concat(
        F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), h),
        F.slice("entries", h + 1, F.greatest(F.size("entries"), F.lit(1)))).alias("entries"))
    return rebuilt.select("conv_id", F.unhex(F.array_join("entries", "")).alias("path"))


def ends_digests(paths: DataFrame) -> DataFrame:
    """key (digest of a path), ends_sha256: hash of the comma-joined ids that have the path."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, None, [], 0
        out: list[tuple] = []
        for batch in batches:
            for k, i in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if k != key or size >= CHUNK:
                    if ids:
                        out.append((key, first, ",".join(ids)))
                    key, first, ids, size = k, i, [], 0
                ids.append(str(i))
                size += len(ids[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["key", "first", "ids"])
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()),
                                              pa.array([",".join(ids)])], ["key", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k != key:
                    if running:
                        out.append((key, running.hexdigest()))
                    key, running = k, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["key", "ends_sha256"])
        if running:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()])],
                                             ["key", "ends_sha256"])

    ordered = (paths.select(F.unhex(F.sha2("path", 256)).alias("key"), "conv_id")
               .repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id"))
    ready = ordered.mapInArrow(pieces, "key binary, first long, ids string")
    return (ready.repartition("key").sortWithinPartitions("key", "first")
            .mapInArrow(digests, "key binary, ends_sha256 string"))


def _sharded(distinct: DataFrame, most: int) -> DataFrame:
    """Rows of all shards. ``distinct``: path, n, first, ends_sha256."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes, shard, before = [], 0, None, b""
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("path", "n", "first", "ends_sha256", "part"))):
                new = len(row[0]) // ENTRY - _shared(before, row[0])
                if held and nodes + new > most:
                    yield from shard_nodes(shard, *map(list, zip(*held))).to_batches(max_chunksize=10_000)
                    held, nodes, shard = [], 0, shard + 1
                shard = row[4] << 32 if shard is None else shard
                held.append(row[:4])
                nodes, before = nodes + new, row[0]
        if held:
            yield from shard_nodes(shard, *map(list, zip(*held))).to_batches(max_chunksize=10_000)

    ordered = distinct.repartitionByRange("path").sortWithinPartitions("path")
    return ordered.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(run, NODE_SCHEMA)


def _merged_spines(spines: DataFrame) -> DataFrame:
    """One row per node on any spine, with its final values and the shard that owns it."""
    known = spines.groupBy("node").agg(
        F.min("shard").alias("owner"), F.min("conv_id").alias("least"), F.sum("n_convs").alias("members"),
        F.max("has_child").alias("inner"), F.max("ends_sha256").alias("ends"))
    held = spines.join(known, "node")
    mine = F.col("shard") == F.col("owner")
    held = (held.withColumn("_saving", F.when(mine, (F.col("members") - 1) * F.col("words")).otherwise(0))
            .withColumn("_leaf", F.when(mine & ~F.col("inner"), 1).otherwise(0))
            .withColumn("_one", F.when(mine, 1).otherwise(0)))
    path = Window.partitionBy("shard", "branch").orderBy(F.col("depth").desc())
    rising, whole = path.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("shard")
    on_fork = (F.col("branch") == 0) & (F.col("depth") <= F.col("fork"))

    def along(value: str):
        side = F.sum(F.when(F.col("branch") == 1, F.col(value)).otherwise(0)).over(whole)
        return F.sum(value).over(rising) + F.when(on_fork, side).otherwise(0)

    next_branch = F.sum(F.when((F.col("branch") == 1) & (F.col("depth") == F.col("fork") + 1), F.col("_one")).otherwise(0)).over(whole)
    spine_children = (F.coalesce(F.lag("_one").over(path), F.lit(0))
                      + F.when((F.col("branch") == 0) & (F.col("depth") == F.col("fork")), next_branch).otherwise(0))
    shares = held.select("node", "shard", "slot", "parent_slot", "depth", "owner", "least", "members", "ends",
                         (F.col("saved_tokens") + along("_saving")).alias("saved_tokens"),
                         (F.col("n_leaves") + along("_leaf")).alias("n_leaves"),
                         (F.col("n_children") + spine_children).alias("n_children"))
    mine = F.col("shard") == F.col("owner")
    return shares.groupBy("node").agg(
        F.max("owner").alias("shard"), F.max(F.when(mine, F.col("parent_slot"))).alias("parent_slot"),
        F.max("depth").alias("depth"), F.max("least").alias("conv_id"), F.max("members").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"), F.max("ends").alias("ends_sha256"))


def trie(df: DataFrame, shard_nodes_: int = SHARD_NODES) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row a
    node of the trie of the rebuilt conversations of ``df`` (conv_id, turn, role, text)."""
    paths = staged(conversation_paths(df), "conversation-paths")
    ends = staged(ends_digests(paths), "ends")
    distinct = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"))
    distinct = distinct.withColumn("key", F.unhex(F.sha2("path", 256))).join(ends, "key").drop("key")
    nodes = staged(_sharded(staged(distinct, "distinct-paths"), shard_nodes_), "trie")

    spines, others = nodes.filter("spine"), nodes.filter("NOT spine")
    merged = staged(_merged_spines(spines), "spines")
    least = (spines.select("shard", "slot", "node").join(merged.select("node", F.col("conv_id").alias("above")), "node")
             .select("shard", F.col("slot").alias("parent_slot"), "above"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inside = others.filter("parent_conv_id IS NOT NULL").select(*out)
    # A shard's nodes under a spine node: at most a shard's rows share this join key.
    under = others.filter("parent_conv_id IS NULL").drop("parent_conv_id").join(least, ["shard", "parent_slot"])
    above = merged.join(least, ["shard", "parent_slot"])
    parent = F.when(F.col("depth") > 0, F.col("above")).alias("parent_conv_id")
    shown = [parent if c == "parent_conv_id" else F.col(c) for c in out]
    whole = inside.unionByName(under.select(*shown)).unionByName(above.select(*shown))
    return whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
