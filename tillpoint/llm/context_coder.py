"""Token-id files with an adaptive context-mixing range coder.

Ids are cut into blocks of ``BLOCK``; each block is coded on its own, from a reset
model, and carries the crc32 of its ids. Many blocks are coded side by side as lanes
of numpy arrays, one id of every lane at a time.

Model of a lane. Three contexts are kept: order 0 (none), order 1 (the id before) and
order 2 (the two ids before), the latter two in hashed slots. Each context predicts an
id (the majority of those it has seen) and holds an adaptive distribution over 16
events: "the order-2 prediction", "the order-1 prediction", "the order-0 prediction",
or one of 13 magnitude classes of a new id. The three distributions are mixed with
weights that follow how well each order predicted so far and how often its context
was seen. A range coder codes the event with the mixture and, for a new id, its
remaining bits. All arithmetic is integer or single IEEE operations in a fixed order,
so a file reads the same on every machine.

File. One row of a Parquet table per *segment*, a run of whole documents of about
``SEGMENT_IDS`` ids in ascending doc_id order: ``part``, ``segment``, ``n_ids`` and
``data``, a self-contained binary (header with its own crc32, document table, block
table with the ids' crc32, coded blocks). Spark's writer commits it, so a lost
executor leaves no half file. Parts are ranges of doc_id: nothing passes through one
task, and a document's start is its place in the segment plus the sizes of the
segments and parts before.

Edge cases: null and empty texts are the end id alone; null doc_ids come first; rows
that repeat a doc_id follow each other (by text hash); an empty table gives no
segments; a damaged block or header fails the read; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import id_text, text_bytes
from tillpoint.llm.tokens import chunks, few_rows, tokenizer_text, worker_encoder

BLOCK = 4096
LANES = 1024
SEGMENT_IDS = 1 << 20
MOST_SEGMENTS = 6  # that a task decodes side by side
SLOTS = 512  # hashed slots of order 1 and of order 2 in a lane
EVENTS = 16
CLASSES = 13  # magnitude classes of new ids
TOTAL = 4 * 4096 + EVENTS  # of the coded frequencies
LOW_BITS, WORD = np.uint64(48), np.uint64(16)
LOW_MASK = np.uint64((1 << 48) - 1)
SMALL = np.uint64(1 << 32)  # the range is kept at or above this

_TRUST = np.minimum(np.arange(256), 30).astype(np.float32) * np.float32(0.5) + np.float32(0.05)
_RATE = np.repeat(np.minimum(1 + np.arange(256) // 2, 5).astype(np.int16)[:, None], EVENTS, axis=1)
_TARGET = np.where(np.arange(EVENTS)[None, :] > np.arange(EVENTS)[:, None], 4096, 0).astype(np.int16)
ROW = np.dtype(f"V{2 * EVENTS}")  # a distribution, moved as one item

# A slot's counts in one number: times seen, and 256 times the votes for its prediction.
_SEEN, _VOTES = np.arange(1 << 16) & 255, np.arange(1 << 16) >> 8
_SEEN_NEXT = np.minimum(_SEEN, 254) + 1
_COUNTS_MISSED = (_SEEN_NEXT + 256 * np.where(_VOTES == 0, 1, _VOTES - 1)).astype(np.uint16)
_COUNTS_MET = (_SEEN_NEXT + 256 * (np.minimum(_VOTES, 254) + 1)).astype(np.uint16)


class LaneModel:
    """Adaptive models of ``lanes`` blocks, all reset. A slot is a row of 16 numbers: its counts
    (the cumulative frequency before event 0 is 0 and not kept), then the cumulative
    frequencies before events 1 to 15. Arrays are indexed by order, then lane."""

    def __init__(self, lanes: int, bits: int):
        size = lanes * (1 + 2 * SLOTS)
        self.rows = np.tile((np.arange(EVENTS) * 256).astype(np.int16), (size, 1))
        self.guess = np.full(size, -1, np.int32)
        self.weight = np.full((3, lanes), 1 / 3, np.float32)
        lane = np.arange(lanes)
        self.base = np.stack([lane, lanes + lane * SLOTS, lanes * (1 + SLOTS) + lane * SLOTS])
        self.small_bits = max(0, bits - CLASSES + 1)
        self.bits_after = np.array([0] * 3 + [self.small_bits + max(e - 4, 0) for e in range(3, EVENTS)], np.uint64)
        self.lead = np.where(np.arange(EVENTS) > 3, np.int64(1) << self.bits_after.astype(np.int64), 0)
        self.k = -1

    def _hold(self, k: int) -> None:
        """Room for the slots of the first ``k`` lanes."""
        self.k = k
        self.slots, self.change, self.rate = (np.zeros((3, k, EVENTS), np.int16) for _ in range(3))
        self.target = np.zeros((k, EVENTS), np.int16)
        self.at = self.base[:, :k].copy()
        self.first = (np.arange(3 * k) * EVENTS).reshape(3, k)  # places of event 0 in the slots held

    def look(self, before: np.ndarray, before2: np.ndarray) -> np.ndarray:
        """Fetch the slots of the contexts; returns their predicted ids."""
        k = len(before)
        if k != self.k:
            self._hold(k)
        one = before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        two = (one ^ before2.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        for order, mixed in ((1, one), (2, two)):
            slot = ((mixed >> np.uint64(40)) & np.uint64(SLOTS - 1)).astype(np.int64)
            np.add(self.base[order, :k], slot, out=self.at[order])
        self.rows.view(ROW).ravel().take(self.at, out=self.slots.view(ROW)[:, :, 0], mode="clip")
        self.counts = self.slots[:, :, 0].view(np.uint16).astype(np.int64)
        self.slots[:, :, 0] = 0
        self.seen = self.counts & 255
        self.guessed = self.guess.take(self.at)
        self.trust = self.weight[:, :k] * _TRUST.take(self.seen)
        self.scale = np.float32(4) / (self.trust[0] + self.trust[1] + self.trust[2])
        return self.guessed

    def pick(self, event: np.ndarray) -> np.ndarray:
        """Cumulative frequencies before an event of each lane, by order."""
        return self.slots.ravel().take(self.first + event)

    def mix(self, picked: np.ndarray, event: np.ndarray) -> np.ndarray:
        """The mixture of the cumulative frequencies before an event."""
        parts = self.trust * picked
        mixed = parts[0]
        mixed += parts[1]
        mixed += parts[2]
        mixed *= self.scale
        return mixed.astype(np.int32) + event

    def span(self, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (excluded) mixed frequency of an event."""
        last = event == EVENTS - 1
        self.low, self.high = self.pick(event), self.pick(np.where(last, event, event + 1))
        start, stop = self.mix(self.low, event), self.mix(self.high, event + 1)
        self.high[:, last] = 4096
        stop[last] = TOTAL
        return start.astype(np.uint64), stop.astype(np.uint64)

    def find(self, point: np.ndarray) -> np.ndarray:
        """The last event that begins at or before a mixed frequency."""
        event = np.zeros(len(point), np.int64)
        for step in (8, 4, 2, 1):
            ahead = event + step
            np.copyto(event, ahead, where=self.mix(self.pick(ahead), ahead) <= point)
        return event

    def classes(self, ids: np.ndarray) -> np.ndarray:
        """The events of ids that no context predicts."""
        return 3 + np.maximum(np.frexp(ids.astype(np.float64))[1] - self.small_bits, 0)

    @staticmethod
    def events(ids: np.ndarray, classes: np.ndarray, guess: np.ndarray) -> np.ndarray:
        event = classes.astype(np.int64)
        for e, order in ((2, 0), (1, 1), (0, 2)):
            np.copyto(event, e, where=ids == guess[order])
        return event

    def rest_bits(self, event: np.ndarray) -> np.ndarray:
        """Number of bits that follow an event."""
        return self.bits_after.take(event)

    def value(self, event: np.ndarray, guess: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """The id of an event and its remaining bits."""
        ids = self.lead.take(event) + rest
        for e, order in ((0, 2), (1, 1), (2, 0)):
            np.copyto(ids, guess[order], where=event == e)
        return ids

    def update(self, event: np.ndarray, ids: np.ndarray) -> None:
        k = self.k
        p = (self.high - self.low + 16).astype(np.float32)
        total = p[0] + p[1] + p[2]
        weight = self.weight[:, :k]
        weight += (p / total - weight) * np.float32(0.04)
        _TARGET.view(ROW).ravel().take(event, out=self.target.view(ROW)[:, 0], mode="clip")
        _RATE.view(ROW).ravel().take(self.seen, out=self.rate.view(ROW)[:, :, 0], mode="clip")
        np.subtract(self.target, self.slots, out=self.change)
        np.right_shift(self.change, self.rate, out=self.change)
        self.slots += self.change
        same = self.guessed == ids
        replaced = ~same & (self.counts < 256)
        self.slots[:, :, 0] = np.where(same, _COUNTS_MET.take(self.counts), _COUNTS_MISSED.take(self.counts)).view(np.int16)
        self.rows.view(ROW).ravel().put(self.at, self.slots.view(ROW)[:, :, 0], mode="clip")
        self.guess[self.at] = np.where(replaced, ids, self.guessed)


def _lanes(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the blocks by falling size, and how many are alive at each step."""
    order = np.argsort(-sizes, kind="stable")
    alive = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")
    return order, alive


def lane_groups(n: int) -> list[tuple[int, int]]:
    """(first, last) of ``n`` blocks in even groups of about ``LANES``, at most 1.5 times as many:
    a step costs nearly as much for a few lanes as for many."""
    bounds = np.linspace(0, n, max(1, round(n / LANES)) + 1).astype(int).tolist()
    return list(zip(bounds[:-1], bounds[1:])) if n else []


def encode_blocks(blocks: list[np.ndarray], bits: int) -> list[bytes]:
    """Code blocks of ids below ``2 ** bits``, side by side."""
    sizes = np.array([len(b) for b in blocks], np.int64)
    order, alive = _lanes(sizes)
    n, steps = len(blocks), len(alive)
    ids = np.zeros((steps + 2, n), np.int32)  # a step's ids lie together; two zeros come before
    for row, i in enumerate(order):
        ids[2:2 + sizes[i], row] = blocks[i]
    model = LaneModel(n, bits)
    low, span = np.zeros(n, np.uint64), np.full(n, 1 << 48, np.uint64)
    width = 2 * steps + 6
    words = np.zeros((n, width), np.uint32)  # word 0 takes a carry
    flat = words.ravel()
    first = np.arange(n) * width
    used = first + 1  # next place of a lane in ``flat``

    def shift(k: int) -> None:
        """Put out the top word of lanes whose range is small (once is enough)."""
        small = np.flatnonzero(span[:k] < SMALL)
        top = low[small]
        at = used[small]
        flat[at] = top >> np.uint64(32)
        used[small] = at + 1
        low[small] = (top << WORD) & LOW_MASK
        span[small] <<= WORD

    def add(k: int, amount: np.ndarray) -> None:
        low[:k] += amount
        carried = np.flatnonzero(low[:k] > LOW_MASK)
        flat[used[carried] - 1] += np.uint32(1)
        low[carried] &= LOW_MASK

    for t, k in enumerate(alive):
        now = ids[t + 2, :k]
        guess = model.look(ids[t + 1, :k], ids[t, :k])
        event = model.events(now, model.classes(now), guess)
        start, stop = model.span(event)
        unit = span[:k] // np.uint64(TOTAL)
        add(k, unit * start)
        span[:k] = unit * (stop - start)
        shift(k)
        rest = model.rest_bits(event)
        span[:k] >>= rest
        add(k, span[:k] * (now.astype(np.uint64) & ((np.uint64(1) << rest) - np.uint64(1))))
        shift(k)
        model.update(event, now)
    for cut in (32, 16, 0):
        flat[used] = ((low >> np.uint64(cut)) & np.uint64(0xFFFF)).astype(np.uint32)
        used += 1
    for few in (words[at:at + 64] for at in range(0, n, 64)):
        while (carry := few >> 16).any():
            few &= 0xFFFF
            few[:, :-1] += carry[:, 1:]
    coded: list[bytes] = [b""] * n
    for row, i in enumerate(order):
        coded[i] = words[row, 1:used[row] - first[row]].astype("<u2").tobytes()
    return coded


def decode_blocks(coded: list[bytes], sizes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The ids of coded blocks of the given sizes."""
    order, alive = _lanes(sizes)
    n, steps = len(coded), len(alive)
    longest = max((len(c) // 2 for c in coded), default=0) + 6
    words = np.zeros((n, longest), np.uint16)
    for row, i in enumerate(order):
        found = np.frombuffer(coded[i], "<u2")
        words[row, :len(found)] = found
    model = LaneModel(n, bits)
    head = words[:, :3].astype(np.uint64)
    code = (head[:, 0] << np.uint64(32)) | (head[:, 1] << WORD) | head[:, 2]
    flat = words.ravel()
    span, used = np.full(n, 1 << 48, np.uint64), np.arange(n) * longest + 3
    ids = np.zeros((steps + 2, n), np.int32)  # a step's ids lie together; two zeros come before

    def shift(k: int) -> None:
        small = np.flatnonzero(span[:k] < SMALL)
        at = used[small]
        code[small] = (code[small] << WORD) | flat[at]
        used[small] = at + 1
        span[small] <<= WORD

    for t, k in enumerate(alive):
        guess = model.look(ids[t + 1, :k], ids[t, :k])
        unit = span[:k] // np.uint64(TOTAL)
        event = model.find(np.minimum(code[:k] // unit, np.uint64(TOTAL - 1)).astype(np.int32))
        start, stop = model.span(event)
        code[:k] -= unit * start
        span[:k] = unit * (stop - start)
        shift(k)
        rest = model.rest_bits(event)
        span[:k] >>= rest
        tail = np.minimum(code[:k] // span[:k], (np.uint64(1) << rest) - np.uint64(1))
        code[:k] -= tail * span[:k]
        shift(k)
        now = model.value(event, guess, tail.astype(np.int64))
        ids[t + 2, :k] = now
        model.update(event, now)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
    for row, i in enumerate(order):
        out[i] = ids[2:2 + sizes[i], row].astype(np.uint32)
    return out


_HEAD = "<4sHHIII"  # magic, version, bits, block length, documents, blocks
MAGIC = b"CMID"


class Segment:
    """A run of whole documents: ``doc_ids`` (None allowed), ``counts`` and ``ids``."""

    def __init__(self, doc_ids: list, counts: np.ndarray, ids: np.ndarray):
        self.doc_ids, self.counts, self.ids = doc_ids, counts, ids

    def blocks(self) -> list[np.ndarray]:
        return [self.ids[i:i + BLOCK] for i in range(0, len(self.ids), BLOCK)]

    def pack(self, coded: list[bytes], bits: int) -> bytes:
        blocks = self.blocks()
        head = b"".join([
            struct.pack(_HEAD, MAGIC, 1, bits, BLOCK, len(self.doc_ids), len(blocks)),
            np.array([i is None for i in self.doc_ids], np.uint8).tobytes(),
            np.array([i or 0 for i in self.doc_ids], "<i8").tobytes(), self.counts.astype("<u8").tobytes(),
            np.array([len(c) for c in coded], "<u4").tobytes(),
            np.array([crc32(b.astype("<u4").tobytes()) for b in blocks], "<u4").tobytes()])
        return b"".join([head, struct.pack("<I", crc32(head)), *coded])


def unpack(data: bytes) -> tuple[list, np.ndarray, list[bytes], np.ndarray, np.ndarray, int]:
    """(doc ids, counts, coded blocks, block sizes, block crc32, bits) of a segment."""
    magic, version, bits, block, docs, blocks = struct.unpack_from(_HEAD, data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a segment")
    at = struct.calcsize(_HEAD)
    fields = []
    for dtype, n in (("u1", docs), ("<i8", docs), ("<u8", docs), ("<u4", blocks), ("<u4", blocks)):
        fields.append(np.frombuffer(data, dtype, n, at))
        at += fields[-1].nbytes
    if struct.unpack_from("<I", data, at)[0] != crc32(data[:at]):
        raise ValueError("damaged segment header")
    missing, doc_ids, counts, lengths, sums = fields
    ends = at + 4 + np.cumsum(lengths.astype(np.int64))
    coded = [data[e - n:e] for e, n in zip(ends.tolist(), lengths.tolist())]
    total = int(counts.sum())
    sizes = np.minimum(block, total - block * np.arange(blocks, dtype=np.int64))
    return [None if m else int(i) for m, i in zip(missing, doc_ids)], counts.astype(np.int64), coded, sizes, sums, bits


def _write_segments(tokenizer: str, spaces_matter: bool, end_id: int, bits: int):
    """mapInArrow function: sorted (doc_id, body) -> segments of this part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, spaces_matter, end_id)
        part, written = TaskContext.get().partitionId(), 0
        ready: list[Segment] = []
        doc_ids, counts, ids, held = [], [], [], 0

        def close() -> None:
            nonlocal doc_ids, counts, ids, held
            if doc_ids:
                ready.append(Segment(doc_ids, np.concatenate(counts), np.concatenate(ids)))
            doc_ids, counts, ids, held = [], [], [], 0

        def code() -> pa.RecordBatch:
            nonlocal written
            all_blocks = [b for s in ready for b in s.blocks()]
            coded = [c for first, last in lane_groups(len(all_blocks)) for c in encode_blocks(all_blocks[first:last], bits)]
            data, at = [], 0
            for s in ready:
                n = -(-len(s.ids) // BLOCK)
                data.append(s.pack(coded[at:at + n], bits))
                at += n
            batch = pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ready), pa.int32()), pa.array(range(written, written + len(ready)), pa.int64()),
                 pa.array([len(s.ids) for s in ready], pa.int64()), pa.array(data, pa.binary())],
                names=["part", "segment", "n_ids", "data"])
            written += len(ready)
            ready.clear()
            return batch

        for batch in few_rows(batches):
            names, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, last in chunks(bodies):
                flat, n = encoder.encode(bodies[first:last])
                doc_ids += names[first:last]
                counts.append(n)
                ids.append(flat)
                held += len(flat)
                if held >= SEGMENT_IDS:
                    close()
                if sum(len(s.ids) for s in ready) >= 2 * LANES * BLOCK:
                    yield code()
        close()
        if ready:
            yield code()
    return run


def write_ids(df: DataFrame, path: str, tokenizer_path: str, spaces_matter: bool = False, end_id: int = 2,
              bits: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, in ascending doc_id order, to the folder ``path``.
    ``bits``: ids are below ``2 ** bits``."""
    docs = id_text(df, id_col, text_col)
    ordered = (docs.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h")
               .sortWithinPartitions("doc_id", "h").select("doc_id", text_bytes().alias("body")))
    write = _write_segments(tokenizer_text(tokenizer_path), spaces_matter, end_id, bits)
    (ordered.mapInArrow(write, "part int, segment long, n_ids long, data binary")
     .write.mode("overwrite").option("compression", "none").parquet(path))


def _read_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment_start, data) -> one row per document with its ids."""
    for batch in batches:
        groups = -(-batch.num_rows // MOST_SEGMENTS)
        bounds = np.linspace(0, batch.num_rows, groups + 1).astype(int).tolist()
        for first, last in zip(bounds[:-1], bounds[1:]):  # a few segments side by side
            rows = batch.slice(first, last - first)
            found = [unpack(d.as_py()) for d in rows.column("data")]
            blocks = [c for f in found for c in f[2]]
            sizes = np.concatenate([f[3] for f in found])
            ids = [i for a, b in lane_groups(len(blocks)) for i in decode_blocks(blocks[a:b], sizes[a:b], found[0][5])]
            at = 0
            for (doc_ids, counts, coded, _, sums, _), start in zip(found, rows.column("segment_start").to_pylist()):
                own = ids[at:at + len(coded)]
                at += len(coded)
                for block, expected in zip(own, sums):
                    if crc32(block.astype("<u4").tobytes()) != expected:
                        raise ValueError("damaged block")
                ends = np.cumsum(counts)
                offsets = np.concatenate([[0], ends]).astype(np.int64) * 4
                flat = np.concatenate(own).astype("<u4").tobytes() if own else b""
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(start + ends - counts), pa.array(counts),
                     pa.array([flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian
    uint32) of every document of the files. Block checksums are verified."""
    segments = spark.read.parquet(path)
    sizes = segments.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row per part (a write task): the only window without a partition.
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part_starts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sizes.withColumn("before", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
              .join(part_starts, "part")
              .select("part", "segment", (F.col("part_start") + F.col("before")).alias("segment_start")))
    # Starts meet the coded segments: decoded ids are neither exchanged nor broadcast.
    return segments.join(starts, ["part", "segment"]).select("segment_start", "data").mapInArrow(
        _read_segments, "doc_id long, start long, n_tokens long, ids binary")
