"""Exact deduplication through an extendible-hash index on shared files.

1. *Pages.* One pass over the texts writes them to the shared folder. Inside a
   task, equal texts collapse to one entry (bytes compared); the table holds one
   narrow row per document (part, entry, pos, doc_id) and one row per entry with
   its bytes (zstd). A text that a third of all rows share is one entry per task.
2. *Directory.* A histogram of the leading hash bits of the entries drives the
   directory: starting at one bucket, a bucket that holds more than ``capacity``
   entries is split by one more bit and the directory doubles when a bucket's
   depth passes the global depth. Its size is bounded by ``2 ** max_depth``.
3. *Owners.* Neighbouring buckets form key ranges of even size, one task each. An
   owner reads its entries in hash order, chains entries of equal hash and
   compares their bytes, so a hash collision never merges texts. A bucket that
   the deepest directory cannot split (one hash) is just a longer chain.
4. *Result.* Each entry's group goes back to its documents over (part, entry);
   no entry has more documents than its part, so no join key is hot.

Edge cases: null text counts as the empty text; null doc_ids are smaller than any
id (a group of null ids only keeps its first row, keep_id null); repeated rows
are copies, one of them stays; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import id_text, shuffle_partitions, staged, text_bytes

HELD_BYTES = 64 << 20  # bytes of distinct text a task holds before it writes them as entries
PAGE_SCHEMA = pa.schema([("part", pa.int32()), ("entry", pa.int64()), ("pos", pa.int64()), ("doc_id", pa.int64()),
                         ("hash", pa.int64()), ("sha256", pa.string()), ("n", pa.int64()),
                         ("max_id", pa.int64()), ("max_pos", pa.int64()), ("body", pa.binary())])
PAGE_DDL = ("part int, entry long, pos long, doc_id long, hash long, sha256 string, n long, max_id long, "
            "max_pos long, body binary")
LINK_SCHEMA = pa.schema([("part", pa.int32()), ("entry", pa.int64()), ("keep_id", pa.int64()),
                         ("keep_part", pa.int32()), ("keep_pos", pa.int64()), ("group_size", pa.int64()),
                         ("sha256", pa.string())])
LINK_DDL = "part int, entry long, keep_id long, keep_part int, keep_pos long, group_size long, sha256 string"


def write_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collapse equal texts of one task; yield document rows and entry rows."""
    part = TaskContext.get().partitionId()
    held: dict[bytes, list[list]] = {}  # digest -> entries [number, n, max_id, max_pos, body]
    pack = zstandard.ZstdCompressor(level=1).compress
    held_bytes, entries, pos = 0, 0, 0

    def entry_rows() -> pa.RecordBatch:
        rows = [{"part": part, "entry": e[0], "hash": int.from_bytes(d[:8], "big", signed=True),
                 "sha256": d.hex(), "n": e[1], "max_id": e[2], "max_pos": e[3], "body": pack(e[4])}
                for d, chain in held.items() for e in chain]
        return pa.RecordBatch.from_pylist(rows, schema=PAGE_SCHEMA)

    for batch in batches:
        ids, bodies = batch.column(0).to_pylist(), batch.column(1)
        of, first = [], pos
        for doc_id, scalar in zip(ids, bodies):
            body = scalar.as_py()
            digest = hashlib.sha256(body).digest()
            chain = held.setdefault(digest, [])
            e = next((x for x in chain if x[4] == body), None)
            if e is None:
                chain.append(e := [entries, 0, doc_id, pos, body])
                entries += 1
                held_bytes += len(body)
            elif doc_id is not None and (e[2] is None or doc_id > e[2]):
                e[2], e[3] = doc_id, pos
            e[1] += 1
            of.append(e[0])
            pos += 1
        n = len(ids)
        narrow = {"part": pa.array(np.full(n, part, np.int32)), "entry": pa.array(of, pa.int64()),
                  "pos": pa.array(np.arange(first, pos)), "doc_id": pa.array(ids, pa.int64())}
        yield pa.RecordBatch.from_arrays(
            [narrow.get(f.name, pa.nulls(n, f.type)) for f in PAGE_SCHEMA], schema=PAGE_SCHEMA)
        if held_bytes > HELD_BYTES:
            yield entry_rows()
            held, held_bytes = {}, 0
    if held:
        yield entry_rows()


class Directory:
    """Extendible-hash directory over the leading bits of a 64-bit hash.

    ``counts[p]`` is the number of entries whose first ``depth`` bits are ``p``.
    ``slots`` maps the first ``global_depth`` bits to a bucket; buckets are numbered
    in key order, ``sizes`` and ``depths`` describe them."""

    def __init__(self, counts: np.ndarray, capacity: int):
        depth = int(math.log2(len(counts)))
        total = np.concatenate([[0], np.cumsum(counts)])
        buckets: list[tuple[int, int, int]] = []  # (first prefix, local depth, entries)
        self.global_depth = 0
        stack = [(0, 0)]
        while stack:
            prefix, local = stack.pop()
            width = 1 << (depth - local)
            size = int(total[prefix + width] - total[prefix])
            if size > capacity and local < depth:  # split; the directory doubles when depth grows
                self.global_depth = max(self.global_depth, local + 1)
                stack += [(prefix + width // 2, local + 1), (prefix, local + 1)]
            else:
                buckets.append((prefix, local, size))
        self.depths = np.array([b[1] for b in buckets], np.int32)
        self.sizes = np.array([b[2] for b in buckets], np.int64)
        self.slots = np.repeat(np.arange(len(buckets), dtype=np.int32),
                               [1 << (self.global_depth - b[1]) for b in buckets])

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        if self.global_depth == 0:
            return np.zeros(len(hashes), np.int32)
        return self.slots[(hashes.view(np.uint64) >> np.uint64(64 - self.global_depth)).astype(np.int64)]

    def owners(self, tasks: int) -> np.ndarray:
        """Owner task of each bucket: key ranges with about equal numbers of entries."""
        middle = np.cumsum(self.sizes) - self.sizes / 2
        return np.minimum((middle * tasks / max(1, self.sizes.sum())).astype(np.int32), tasks - 1)


def link_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner task: entries arrive in hash order; those of equal hash are chained and
    their bytes compared. Yields each entry's group: row to keep and group size."""
    unpack = zstandard.ZstdDecompressor().decompress
    chain_hash, chain = None, []  # chain: [body, sha256, total, keep, [(part, entry)]]
    done: list[dict] = []

    def close() -> None:
        for _, sha, total, keep, members in chain:
            done.extend({"part": p, "entry": e, "keep_id": keep[0], "keep_part": -keep[1], "keep_pos": -keep[2],
                         "group_size": total, "sha256": sha} for p, e in members)

    for batch in batches:
        cols = {name: batch.column(name).to_pylist() for name in
                ("part", "entry", "hash", "sha256", "n", "max_id", "max_pos")}
        bodies = batch.column("body")
        for i, h in enumerate(cols["hash"]):
            if h != chain_hash:
                close()
                chain_hash, chain = h, []
            body = unpack(bodies[i].as_py())
            key = (cols["max_id"][i], -cols["part"][i], -cols["max_pos"][i])
            member = (cols["part"][i], cols["entry"][i])
            for group in chain:
                if group[0] == body:
                    group[2] += cols["n"][i]
                    group[3] = max(group[3], key, key=lambda k: (k[0] is not None, k[0] or 0, k[1], k[2]))
                    group[4].append(member)
                    break
            else:
                chain.append([body, cols["sha256"][i], cols["n"][i], key, [member]])
        if len(done) >= 10_000:
            yield pa.RecordBatch.from_pylist(done, schema=LINK_SCHEMA)
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=LINK_SCHEMA)


def build_directory(entries: DataFrame, capacity: int = 4096, max_depth: int = 18) -> Directory:
    """Directory over ``entries`` (column ``hash``). The histogram sent to the driver has
    at most ``2 ** max_depth`` rows; where more entries than ``capacity * 2 ** max_depth``
    exist, buckets grow beyond ``capacity`` and stay correct."""
    total = entries.count()
    depth = min(max_depth, max(1, math.ceil(math.log2(max(1, total / capacity))) + 4))
    prefix = F.shiftrightunsigned("hash", 64 - depth)
    counts = np.zeros(1 << depth, np.int64)
    for row in entries.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["p"]] = row["n"]
    return Directory(counts, capacity)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = 4096, max_depth: int = 18) -> DataFrame:
    """One row per input row: doc_id, keep_id (largest doc_id with the same bytes),
    group_size, kept (exactly one row per group), text_sha256."""
    docs = id_text(df, id_col, text_col).select("doc_id", text_bytes().alias("body"))
    pages = staged(docs.mapInArrow(write_pages, PAGE_DDL), "dedup-pages")
    entries = pages.filter(F.col("hash").isNotNull())
    directory = build_directory(entries, capacity, max_depth)
    tasks = shuffle_partitions(df.sparkSession)
    owners = directory.owners(tasks)

    @F.pandas_udf("int")
    def owner(hashes):
        import pandas as pd
        return pd.Series(owners[directory.bucket(hashes.to_numpy(np.int64))])

    links = (entries.select("part", "entry", "hash", "sha256", "n", "max_id", "max_pos", "body")
             .withColumn("owner", owner("hash"))
             .repartitionById(tasks, F.col("owner")).drop("owner")
             .sortWithinPartitions("hash", "part", "entry")
             .mapInArrow(link_entries, LINK_DDL))
    members = pages.filter(F.col("pos").isNotNull()).select("part", "entry", "pos", "doc_id")
    kept = (F.col("part") == F.col("keep_part")) & (F.col("pos") == F.col("keep_pos"))
    return (members.join(staged(links, "dedup-links"), ["part", "entry"])
            .select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha256").alias("text_sha256")))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """Rows of ``df`` that stay, with all their columns. Where the kept row's id and
    text are repeated in other rows, whole-row duplicates are removed as well (rows
    that then still differ do so in other columns, and stay)."""
    groups = staged(exact_groups(df, id_col, text_col, **index), "dedup-groups")
    kept = groups.filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    sha = F.sha2(text_bytes(F.coalesce(df[text_col].cast("string"), F.lit(""))), 256)
    stay = df.join(kept, df[id_col].cast("long").eqNullSafe(kept["_kept_id"]) & (sha == kept["_kept_sha"]),
                   "left_semi")
    repeated = groups.filter(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return stay if repeated.isEmpty() else stay.dropDuplicates()
