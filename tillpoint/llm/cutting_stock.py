"""Sequence packing by cutting-stock column generation.

Documents become token ids, cut into full sequences and one remainder. How many
pieces have each length is a histogram of at most ``capacity`` rows; a linear
program over packing patterns covers it with the fewest sequences. Columns
(patterns, and exchanges of one piece for shorter ones) are priced by an
unbounded-knapsack dynamic program on the dual prices and enter a revised simplex until
the cover is proven near its optimum, or a warning tells its proven gap. The patterns, rounded down, give each length ranges of ranks; pieces are ranked inside their length
by a distributed numbering and look their range up. Patterns that leave padding are
used, those that leave least first, while all their padding stays within a stated share
of the ids, whatever the number of pieces. The pieces of the others and what rounding
leaves over are laid end to end and cut at sequence borders; the last, short rest
becomes sequences whose lengths are powers of two, which need no padding.

Only the histogram and the table of slots (bounded by the square of ``capacity``,
whatever the number of pieces) pass through the driver. Ids stay in the staged pieces table.

Edge cases: null or empty text is the end id alone; very long texts give many full
sequences; repeated rows are separate documents; a null doc_id is kept as null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.llm.common import id_text, rank_in_class, staged, text_bytes
from tillpoint.llm.tokens import chunks, few_rows, tokenizer_text, worker_encoder

BROADCAST_CUTS = 200_000
PIECE_DDL = "piece_id long, doc_id long, doc_tokens long, start long, length int, ids binary"


def cut_documents(tokenizer: str, spaces_matter: bool, end_id: int, capacity: int):
    """mapInArrow function: (doc_id, body) -> pieces of at most ``capacity`` ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, spaces_matter, end_id)
        next_id = TaskContext.get().partitionId() << 40
        for batch in few_rows(batches):
            doc_ids, bodies = batch.column(0), batch.column(1).to_pylist()
            for first, last in chunks(bodies):
                flat, counts = encoder.encode(bodies[first:last])
                pieces = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), pieces)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = nth * capacity
                length = np.minimum(counts[doc] - start, capacity)
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4
                ids = pa.Array.from_buffers(pa.binary(), len(doc), [
                    None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(next_id + np.arange(len(doc))), doc_ids.slice(first, last - first).take(pa.array(doc)),
                     pa.array(counts[doc]), pa.array(start), pa.array(length.astype(np.int32)), ids],
                    names=["piece_id", "doc_id", "doc_tokens", "start", "length", "ids"])
                next_id += len(doc)
    return run


class Knapsack:
    """Unbounded knapsack over ``lengths`` (ascending) with ``prices``, for every room up to
    ``capacity``: ``best[room]`` is the highest total price that fits."""

    def __init__(self, lengths: np.ndarray, prices: np.ndarray, capacity: int):
        self.lengths = lengths
        self.best, self.item = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int32)
        best = self.best
        for room in range(int(lengths[0]), capacity + 1):
            fit = np.searchsorted(lengths, room, "right")
            value = best[room - lengths[:fit]] + prices[:fit]
            k = int(value.argmax())
            if value[k] > best[room - 1]:
                best[room], self.item[room] = value[k], k
            else:
                best[room] = best[room - 1]

    def filling(self, room: int) -> Counter:
        """Items (by number) of a best filling of ``room``."""
        pattern = Counter()
        while room > 0:
            if self.item[room] < 0:
                room -= 1
                continue
            pattern[int(self.item[room])] += 1
            room -= int(self.lengths[self.item[room]])
        return pattern


def first_basis(lengths: np.ndarray, need: np.ndarray,
                capacity: int) -> tuple[list[Counter], np.ndarray, np.ndarray]:
    """Sequential patterns: the longest open length with the fullest filling of the
    others, used until one length is exhausted. Pattern k exhausts one length and has
    no length exhausted before, so the patterns are a feasible basis, triangular in
    that order. Returns patterns, amounts and the inverse of the basis."""
    patterns: list[Counter] = [Counter()] * len(lengths)
    order: list[int] = []
    amount, left = np.zeros(len(lengths)), need.copy()
    is_open = np.ones(len(lengths), bool)
    while is_open.any():
        alive = np.flatnonzero(is_open)
        longest = alive[-1]
        pattern = Counter({int(longest): 1})
        room = capacity - int(lengths[longest])
        if room >= lengths[alive[0]]:
            plenty = 1 + 0.02 * left[alive] / max(1e-9, left[alive].max())
            rest = Knapsack(lengths[alive], lengths[alive] * plenty, room).filling(room)
            pattern.update({int(alive[i]): n for i, n in rest.items()})
        used = np.array(list(pattern))
        times = left[used] / np.array([pattern[i] for i in used])
        out = int(used[times.argmin()])
        for i, n in pattern.items():
            left[i] = max(0.0, left[i] - n * times.min())
        patterns[out], amount[out], is_open[out] = pattern, times.min(), False
        order.append(out)
    inverse = np.eye(len(lengths))
    for out in order:  # eliminate column by column
        pattern = patterns[out]
        inverse[out] /= pattern[out]
        for i, n in pattern.items():
            if i != out:
                inverse[i] -= n * inverse[out]
    return patterns, amount, inverse


class Cover:
    """Revised simplex over columns that cover the demand of each length: a pattern (cost
    1) adds its pieces, an exchange (cost 0) takes one slot of a length and adds the
    shorter pieces that fill it instead."""

    def __init__(self, lengths: np.ndarray, need: np.ndarray, capacity: int):
        self.columns, self.amount, self.inverse = first_basis(lengths, need, capacity)
        shares = np.modf(np.arange(1, len(need) + 1) * (5 ** 0.5 - 1) / 2)[0]
        self.amount = self.amount + 1e-4 * self.amount.mean() * shares
        self.source = np.full(len(lengths), -1)  # length whose slot an exchange takes; -1: a pattern
        self.prices = self.inverse.sum(axis=0)

    @property
    def sequences(self) -> float:
        return float(self.amount[self.source < 0].sum())

    def enter(self, column: Counter, source: int, min_gain: float = 1e-7) -> bool:
        """Let a column into the basis if it still saves sequences at the present prices."""
        pieces = dict(column)
        if source >= 0:
            pieces[source] = pieces.get(source, 0) - 1
        at, n = np.array(list(pieces), np.int64), np.array(list(pieces.values()), float)
        gain = float(self.prices[at] @ n) - (source < 0)
        if gain <= min_gain:
            return False
        step = self.inverse[:, at] @ n
        rows = np.flatnonzero(step > 1e-9)
        out = rows[np.argmin(self.amount[rows] / step[rows])]
        entering = max(0.0, self.amount[out] / step[out])
        self.amount = np.maximum(self.amount - entering * step, 0.0)
        self.amount[out] = entering
        pivot = self.inverse[out] / step[out]
        changed, used = np.flatnonzero(step), np.flatnonzero(pivot)
        self.inverse[np.ix_(changed, used)] -= np.outer(step[changed], pivot[used])
        self.inverse[out] = pivot
        self.prices = self.prices - gain * pivot
        self.columns[out], self.source[out] = column, source
        return True

    def patterns(self) -> list[tuple[Counter, float]]:
        """Patterns and amounts after the exchanges. From the longest length down, slots are
        refilled pattern by pattern; an exchange splits at most one pattern."""
        done = [(p, x) for p, x, s in zip(self.columns, self.amount, self.source) if s < 0 and x > 1e-9]
        swaps = sorted(((int(s), p, x) for p, x, s in zip(self.columns, self.amount, self.source)
                        if s >= 0 and x > 1e-9), key=lambda swap: -swap[0])
        for slot, filling, slots in swaps:
            after = []
            for pattern, amount in done:
                n = pattern[slot]
                share = min(amount, slots / n) if n else 0.0
                if share > 1e-9:
                    refilled = Counter({i: k for i, k in pattern.items() if i != slot})
                    for i, k in filling.items():
                        refilled[i] += n * k
                    after.append((refilled, share))
                    slots -= share * n
                if amount - share > 1e-9:
                    after.append((pattern, amount - share))
            done = after
        return done


def volume_bound(lengths: np.ndarray, need: np.ndarray, capacity: int) -> float:
    """Fewest sequences by volume: for every limit k, pieces longer than ``capacity - k`` fill
    a sequence, those above a half take one each, and the others of at least k fill what
    those leave; the best limit counts."""
    half = capacity // 2
    best = float((lengths * need).sum()) / capacity
    for k in range(1, half + 1):
        large, middle = lengths > capacity - k, (lengths > half) & (lengths <= capacity - k)
        small = (lengths >= k) & (lengths <= half)
        over = (lengths * need)[small].sum() - ((capacity - lengths) * need)[middle].sum()
        best = max(best, need[large].sum() + need[middle].sum() + max(0.0, float(over)) / capacity)
    return float(best)


def solve_patterns(demand: dict[int, int], capacity: int, gap: float = 5e-3,
                   smoothing: float = 0.9, max_tables: int = 200) -> list[tuple[Counter, float]]:
    """Column generation: [(pattern {length: pieces}, sequences)], covering ``demand``.
    One knapsack table prices the best pattern and, for every length, the best exchange of
    its slot for shorter pieces: exchanges keep the prices monotone and superadditive, as
    those of an optimal cover are. Tables are built on prices between the simplex's and the
    ones that gave the best bound so far; when nothing enters, the weight of the latter is
    halved, down to none. Columns enter until the sequences used are proven within ``gap`` of the
    optimum, by volume or by Farley's bound (the demand's price over the best pattern's).
    Against ties in the pivots the first amounts are raised, each by another share, by less
    than 0.01 % in total; bounds are those of the true demand. After ``max_tables`` tables (the
    driver's time is bounded) the cover is used as it is, and a warning gives its proven gap."""
    lengths = np.array(sorted(demand), np.int64)
    need = np.array([demand[int(n)] for n in lengths], float)
    if not len(lengths):
        return []
    cover = Cover(lengths, need, capacity)
    bound = volume_bound(lengths, need, capacity)
    center, weight = lengths / capacity, smoothing
    tables = 0
    while cover.sequences > bound * (1 + gap):
        if tables == max_tables:
            warnings.warn(f"packing patterns: {cover.sequences / bound - 1:.4f} above the proven bound "
                          f"after {max_tables} tables", stacklevel=2)
            break
        tables += 1
        prices = weight * center + (1 - weight) * cover.prices
        table = Knapsack(lengths, prices, capacity)
        proven = float(prices @ need) / float(table.best[capacity])
        if proven > bound:
            bound, center = proven, prices / table.best[capacity]
        entered = 0
        for k in np.flatnonzero(table.best[lengths - 1] > prices - 1e-2 / capacity):
            entered += cover.enter(table.filling(int(lengths[k]) - 1), int(k))
        entered += cover.enter(table.filling(capacity), -1)
        if entered:
            weight = smoothing
        elif weight:
            weight = weight / 2 if weight > 0.05 else 0.0
        else:
            break
    cover.amount = np.maximum(cover.inverse @ need, 0.0)  # of the true demand
    return [(Counter({int(lengths[i]): n for i, n in p.items()}), float(x)) for p, x in cover.patterns()]


@dataclass
class Slots:
    """Ranks ``first <= rank < last`` of pieces of ``length`` go, ``each`` to a sequence,
    to sequences from ``sequence`` on, the first at ``offset``. A cut piece has one row
    for each part: ids from ``cut_start``, ``cut_length`` of them. ``cuts``: how many cuts."""
    rows: list[tuple]
    sequences: int

    @property
    def cuts(self) -> int:
        return sum(row[2] - row[1] for row in self.rows if row[6])


SLOT_DDL = ("length int, first long, last long, each int, sequence long, offset int, cut_start int, "
            "cut_length int")


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def plan_slots(demand: dict[int, int], capacity: int, gap: float = 5e-3, max_padding: float = 1e-3) -> Slots:
    """Whole patterns first (rounded down), then the rest laid end to end and cut. Patterns
    that leave padding are used while it is at most ``max_padding`` of all ids in total;
    the pieces of the others join the rest. Of the rest, equal pieces that fill sequences
    exactly are laid as one round of at most ``capacity`` pieces, repeated; so fewer than
    ``capacity`` of each length are listed one by one."""
    left, taken, rows, sequence = dict(demand), Counter(), [], 0
    full = left.pop(capacity, 0)
    solved = [(Counter({capacity: 1}), float(full))] if full else []
    left_or_full = dict(demand)
    solved += solve_patterns(left, capacity, gap)
    def padding(pattern: Counter) -> int:
        filled = sum(n * k for n, k in pattern.items())
        return capacity - filled if filled & (filled - 1) else 0

    allowed = int(max_padding * sum(n * k for n, k in demand.items()))
    for pattern, amount in sorted(solved, key=lambda s: (padding(s[0]), -s[1])):
        times = min([int(amount + 1e-6), *(left_or_full[n] // k for n, k in pattern.items())])
        if times <= 0 or times * padding(pattern) > allowed:
            continue
        allowed -= times * padding(pattern)
        offset = 0
        for n, k in sorted(pattern.items(), reverse=True):
            rows.append((n, taken[n], taken[n] + times * k, k, sequence, offset, 0, n))
            taken[n] += times * k
            left_or_full[n] -= times * k
            offset += n * k
        sequence += times
    for n in sorted(left_or_full, reverse=True):
        pieces = capacity // gcd(n, capacity)  # fill n // gcd sequences
        times = left_or_full[n] // pieces
        for k in range(pieces if times else 0):
            nth, offset = divmod(k * n, capacity)
            part, first = min(n, capacity - offset), taken[n] + k * times
            rows.append((n, first, first + times, 1, sequence + nth * times, offset, 0, part))
            if part < n:
                rows.append((n, first, first + times, 1, sequence + (nth + 1) * times, 0, part, n - part))
        taken[n] += pieces * times
        left_or_full[n] -= pieces * times
        sequence += pieces * n // capacity * times
    rest = [n for n in sorted(left_or_full, reverse=True) for _ in range(left_or_full[n])]
    total = sum(rest)
    borders = [capacity] * (total // capacity) + powers_of_two(total % capacity)
    at, room = 0, borders[0] if borders else 0
    for n in rest:
        rank, cut = taken[n], 0
        taken[n] += 1
        while cut < n:
            if not room:
                at += 1
                room = borders[at]
            part = min(room, n - cut)
            rows.append((n, rank, rank + 1, 1, sequence + at, borders[at] - room, cut, part))
            cut, room = cut + part, room - part
    return Slots(rows, sequence + len(borders))


@dataclass
class Packing:
    """``pieces``: the staged ids (piece_id, doc_id, doc_tokens, start, length, ids);
    ``places``: piece_id, cut_start, cut_length, sequence_id, offset; ``n_cuts``: cuts in them."""
    pieces: DataFrame
    places: DataFrame
    n_cuts: int

    def parts(self) -> DataFrame:
        """One row per part of a document that lies in a sequence, with its ids."""
        joined = self.pieces.join(self.places, "piece_id")
        return joined.select("doc_id", (F.col("start") + F.col("cut_start")).alias("start"),
                             F.col("cut_length").cast("long").alias("length"),
                             F.expr("substring(ids, cut_start * 4 + 1, cut_length * 4)").alias("ids"),
                             "doc_tokens", "sequence_id", "offset")

    def sequences(self) -> DataFrame:
        """sequence_id and its ids (little-endian uint32), parts in offset order. A
        sequence has at most ``capacity`` parts."""
        listed = F.array_sort(F.collect_list(F.struct("offset", "ids")))
        return self.parts().groupBy("sequence_id").agg(
            F.aggregate(listed, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))

    def digests(self) -> DataFrame:
        """``parts`` with the crc32 of the ids instead of the ids. Up to ``BROADCAST_CUTS`` cuts
        are broadcast to the scan of the ids, which are then not shuffled."""
        uncut = (F.col("cut_start") == 0) & (F.col("cut_length") == F.col("length"))
        cuts = (self.places.filter(~uncut).groupBy("piece_id")
                .agg(F.collect_list(F.struct("cut_start", "cut_length")).alias("cuts")))
        cuts = F.broadcast(cuts) if self.n_cuts <= BROADCAST_CUTS else cuts.hint("merge")
        whole = F.array(F.struct(F.lit(0).alias("cut_start"), F.col("length").alias("cut_length")))
        parts = (self.pieces.join(cuts, "piece_id", "left")
                 .withColumn("cut", F.explode(F.coalesce("cuts", whole)))
                 .select("piece_id", "doc_id", "doc_tokens", "start", F.col("cut.cut_start").alias("cut_start"),
                         F.expr("crc32(substring(ids, cut.cut_start * 4 + 1, cut.cut_length * 4))").alias("ids_crc32")))
        return (parts.join(self.places, ["piece_id", "cut_start"])
                .select("doc_id", (F.col("start") + F.col("cut_start")).alias("start"),
                        F.col("cut_length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
                        "sequence_id", F.col("offset").cast("long").alias("offset")))


def pack(df: DataFrame, tokenizer_path: str, spaces_matter: bool = True, end_id: int = 0,
         capacity: int = 1024, gap: float = 5e-3, lanes: int = 256,
         id_col: str = "doc_id", text_col: str = "text") -> Packing:
    """Pack all documents of ``df`` into sequences of at most ``capacity`` ids."""
    spark: SparkSession = df.sparkSession
    docs = id_text(df, id_col, text_col).select("doc_id", text_bytes().alias("body"))
    cut = cut_documents(tokenizer_text(tokenizer_path), spaces_matter, end_id, capacity)
    pieces = staged(docs.mapInArrow(cut, PIECE_DDL), "pieces")
    demand = {r["length"]: r["n"] for r in
              pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_slots(demand, capacity, gap)
    slots = spark.createDataFrame(plan.rows, SLOT_DDL)
    ranked = rank_in_class(pieces.select("piece_id", "length"), ["length"], ["piece_id"], "rank", lanes)
    # Rows per (pattern, length), per piece of a round and per listed part: bounded by the capacity.
    at = F.col("rank") - F.col("first")
    places = (ranked.alias("r").join(F.broadcast(slots).alias("s"),
                                     (F.col("r.length") == F.col("s.length"))
                                     & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
              .select("piece_id", F.col("r.length").alias("length"), "cut_start", "cut_length",
                      (F.col("sequence") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
                      (F.col("offset") + (at % F.col("each")) * F.col("r.length")).cast("int").alias("offset")))
    return Packing(pieces, staged(places, "places"), plan.cuts)
