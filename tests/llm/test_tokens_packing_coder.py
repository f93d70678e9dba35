import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tillpoint.llm import context_coder, cutting_stock
from tillpoint.llm.common import shared_folder
from tillpoint.llm.tokens import WordEncoder, tokenizer_text

from .conftest import TOKENIZERS, awkward_rows

FILES = {"word_bpe_49k.json": (False, 2), "byte_bpe_50k.json": (True, 0)}


def library_ids(name: str, texts: list[str]) -> list[list[int]]:
    t = Tokenizer.from_file(f"{TOKENIZERS}/{name}")
    t.encode_special_tokens = True
    return [e.ids + [FILES[name][1]] for e in t.encode_batch(texts, add_special_tokens=False)]


def own_ids(encoder: WordEncoder, texts: list[str]) -> list[list[int]]:
    flat, counts = encoder.encode([t.encode() for t in texts])
    return [a.tolist() for a in np.split(flat, np.cumsum(counts)[:-1])] if texts else []


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_library(name):
    spaces, end = FILES[name]
    encoder = WordEncoder(tokenizer_text(f"{TOKENIZERS}/{name}"), spaces, end, cache=200)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(st.sampled_from(list("abcEÉß'’s.t,!?09 \n\t\r\x0b\x00\x1c\x85  　ΣИ日́ª_<|>")),
                            max_size=30), min_size=1, max_size=4))
    def equal(texts):
        assert own_ids(encoder, texts) == library_ids(name, texts)

    equal()
    texts = [t or "" for _, t, *_ in awkward_rows()]
    assert own_ids(encoder, texts) == library_ids(name, texts)


@pytest.mark.parametrize("name", FILES)
def test_word_memory_is_bounded(name):
    """Words met once are dropped, words and parts met often stay, and ids do not change."""
    spaces, end = FILES[name]
    encoder = WordEncoder(tokenizer_text(f"{TOKENIZERS}/{name}"), spaces, end, cache=400)
    for k in range(12):
        texts = [f"often met words one{k}a{i} two{i}b{k}" for i in range(60)]
        assert own_ids(encoder, texts) == library_ids(name, texts)
        assert len(encoder.known) <= 400 and len(encoder.known) == len(encoder.lengths) == len(encoder.uses)
        assert len(encoder.parts) <= 400 and len(encoder.parts) == len(encoder.part_lengths) == len(encoder.part_uses)
    assert b"met" in encoder.known and len(encoder.part_ids) == encoder.part_lengths.sum()


def test_pieces_are_cut_from_few_rows_at_a_time(monkeypatch):
    import pyarrow as pa
    seen = []
    encode = WordEncoder.encode
    monkeypatch.setattr(WordEncoder, "encode", lambda self, bodies: seen.append(len(bodies)) or encode(self, bodies))
    monkeypatch.setattr(cutting_stock, "TaskContext", type("T", (), {"get": staticmethod(
        lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500)), pa.array([b"a text"] * 2500)], names=["doc_id", "body"])
    cut = cutting_stock.cut_documents(tokenizer_text(f"{TOKENIZERS}/byte_bpe_50k.json"), True, 0, 64)
    found = list(cut(iter([batch])))
    assert max(seen) <= 1000 and sum(seen) == 2500
    assert [i for b in found for i in b.column("doc_id").to_pylist()] == list(range(2500))
    assert [i for b in found for i in b.column("piece_id").to_pylist()] == list(range(2500))


def test_packing_of_awkward_rows(awkward, empty, spark):
    packed = cutting_stock.pack(awkward, f"{TOKENIZERS}/byte_bpe_50k.json", capacity=64)
    parts = packed.parts().collect()
    digests = packed.digests().collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["sequence_id"], r["offset"])
    assert Counter((*key(r), zlib.crc32(bytes(r["ids"]))) for r in parts) == Counter(
        (*key(r), r["ids_crc32"]) for r in digests)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in parts:
        assert len(r["ids"]) == 4 * r["length"]
        by_doc[(r["doc_id"], r["doc_tokens"])].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in by_seq.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(by_seq) == list(range(len(by_seq)))
    ids = defaultdict(list)
    rows = awkward_rows()
    for (i, *_), one in zip(rows, library_ids("byte_bpe_50k.json", [r[1] or "" for r in rows])):
        ids[(i, len(one))].append(one)
    assert {k: sum(len(x) for x in v) for k, v in ids.items()} == {
        k: sum(r["length"] for r in v) for k, v in by_doc.items()}
    for k, v in by_doc.items():
        for r in v:
            piece = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
            assert any(one[r["start"]:r["start"] + r["length"]] == piece for one in ids[k])
    sequences = {r["sequence_id"]: len(r["ids"]) // 4 for r in packed.sequences().collect()}
    assert sequences == {s: sum(n for _, n in f) for s, f in by_seq.items()}
    assert cutting_stock.pack(empty, f"{TOKENIZERS}/byte_bpe_50k.json").digests().count() == 0


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 200), max_size=20))
def test_slots_cover_every_rank_once(demand):
    plan = cutting_stock.plan_slots(demand, 32)
    covered = defaultdict(set)
    fill = Counter()
    for n, first, last, each, sequence, offset, cut, length in plan.rows:
        for rank in range(first, last):
            at = rank - first
            assert (rank, cut) not in covered[n]
            covered[n].add((rank, cut))
            place = offset + (at % each) * n
            assert place + length <= 32
            fill[sequence + at // each] += length
    total = {n: Counter() for n in demand}
    for n, _, _, _, _, _, cut, length in plan.rows:
        total[n][(cut, length)] += 1
    assert {n: len({r for r, _ in c}) for n, c in covered.items()} == demand
    assert sum(fill.values()) == sum(n * k for n, k in demand.items())
    assert set(fill) == set(range(plan.sequences)) and max(fill.values(), default=0) <= 32


@pytest.mark.parametrize("scale", [1, 7, 8, 500])
def test_little_padding_at_any_count_with_one_hot_length(scale):
    """A hot length above half the capacity has too few short pieces to fill up with: at every
    count the padding is at most a thousandth of the ids and the plan stays small."""
    demand = {n: scale for n in range(3, 300, 41)} | {700: 1001 * scale, 901: 13 * scale}
    plan = cutting_stock.plan_slots(demand, 1024)
    fill, covered = Counter(), Counter()
    for n, first, last, each, sequence, offset, cut, length in plan.rows:
        for at in range(last - first):
            assert offset + at % each * n + length <= 1024
            fill[sequence + at // each] += length
            covered[n, first + at] += length
    assert covered == {(n, r): n for n, k in demand.items() for r in range(k)}
    assert set(fill) == set(range(plan.sequences))
    assert sum(1024 - n for n in fill.values() if n & (n - 1)) <= 1e-3 * sum(fill.values())
    assert plan.cuts <= plan.sequences + 1024 and len(plan.rows) < 4 * 1024 * len(demand)


def test_packing_is_the_same_when_cuts_are_not_broadcast(spark, monkeypatch):
    rows = [(i, " ".join(["word"] * 700)) for i in range(20)] + [(99, "short text")]
    packed = cutting_stock.pack(spark.createDataFrame(rows, "doc_id long, text string"),
                                f"{TOKENIZERS}/byte_bpe_50k.json")
    assert packed.n_cuts > 0
    expected = sorted(packed.digests().collect())
    monkeypatch.setattr(cutting_stock, "BROADCAST_CUTS", 0)
    assert sorted(packed.digests().collect()) == expected


def test_patterns_reach_the_volume_bound():
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(rng.integers(1, 200, 50_000), return_counts=True)
    demand = dict(zip(lengths.tolist(), counts.tolist()))
    solved = cutting_stock.solve_patterns(demand, 256)
    assert all(sum(n * k for n, k in p.items()) <= 256 for p, _ in solved)
    made = Counter()
    for p, x in solved:
        for n, k in p.items():
            made[n] += k * x
    assert all(abs(made[n] - demand[n]) < 1e-6 * 50_000 for n in demand)
    bound = sum(n * k for n, k in demand.items()) / 256
    assert sum(x for _, x in solved) <= bound * 1.002


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 40), min_size=1, max_size=8))
def test_cover_is_proven_and_covers_every_length(demand):
    solved = cutting_stock.solve_patterns(demand, 24, gap=0.0)
    made = Counter()
    for p, x in solved:
        assert x >= 0 and sum(n * k for n, k in p.items()) <= 24
        for n, k in p.items():
            made[n] += k * x
    sequences = sum(x for _, x in solved)
    assert all(-1e-6 < made[n] - demand[n] < 2e-3 * sequences for n in demand)
    lengths, need = np.array(list(demand)), np.array(list(demand.values()))
    assert sequences >= cutting_stock.volume_bound(lengths, need, 24) - 1e-6
    # no pattern is worth more than one sequence at the optimum's prices: brute force over all patterns
    patterns = [()]
    for n in sorted(demand):
        patterns = [p + (k,) for p in patterns for k in range((24 - sum(a * b for a, b in zip(sorted(demand), p))) // n + 1)]
    rows = np.array(patterns, float)
    prices = _packing_prices(rows, np.array([demand[n] for n in sorted(demand)], float))
    assert sequences <= prices * (1 + 2e-3) + 1e-6


def _packing_prices(patterns: np.ndarray, need: np.ndarray) -> float:
    """Optimum of the linear program over all patterns, by a dense tableau of its dual
    (maximise price @ need while no pattern is worth more than 1)."""
    used = patterns[patterns.any(axis=1)]
    m, n = used.shape
    tableau = np.zeros((m + 1, n + m + 1))
    tableau[:m, :n], tableau[:m, n:n + m], tableau[:m, -1] = used, np.eye(m), 1
    tableau[m, :n] = -need
    while (tableau[m, :-1] < -1e-9).any():
        enter = int(np.argmax(tableau[m, :-1] < -1e-9))  # Bland's rule
        rows = np.flatnonzero(tableau[:m, enter] > 1e-9)
        out = rows[np.argmin(tableau[rows, -1] / tableau[rows, enter])]
        tableau[out] /= tableau[out, enter]
        others = np.arange(m + 1) != out
        tableau[others] -= np.outer(tableau[others, enter], tableau[out])
    return float(tableau[m, -1])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**12 - 1), max_size=80), max_size=6))
def test_blocks_round_trip(blocks):
    arrays = [np.array(b, np.int64) for b in blocks]
    coded = context_coder.encode_blocks(arrays, 12) if arrays else []
    back = context_coder.decode_blocks(coded, np.array([len(b) for b in arrays], np.int64), 12) if arrays else []
    assert [b.tolist() for b in back] == blocks


def test_coder_adapts():
    rng = np.random.default_rng(0)
    repeated = np.tile(rng.integers(0, 40_000, 16), 250)
    fresh = rng.integers(0, 65_536, 4000)
    small, large = context_coder.encode_blocks([repeated, fresh], 16)
    assert len(small) < 0.05 * len(fresh) * 2 and len(large) < 1.1 * len(fresh) * 2


def test_blocks_do_not_depend_on_their_neighbours():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 500, n) for n in (700, 3, 0, 1500)]
    together = context_coder.encode_blocks(blocks, 16)
    assert together == [context_coder.encode_blocks([b], 16)[0] for b in blocks]


def test_lanes_are_grouped_evenly():
    """No group of a few lanes is left over: its steps would cost nearly as much as those of a full one."""
    lanes = context_coder.LANES
    for n in (0, 1, lanes // 3, lanes, lanes + 4, lanes * 5 // 4, 2 * lanes + 1, 7 * lanes - 3):
        groups = context_coder.lane_groups(n)
        sizes = [last - first for first, last in groups]
        assert [i for first, last in groups for i in range(first, last)] == list(range(n))
        assert all(min(n, lanes * 2 // 3) <= k <= lanes * 3 // 2 for k in sizes)


def test_segments_are_coded_side_by_side(spark, monkeypatch):
    """A few blocks more than the lanes are coded and decoded in one group."""
    monkeypatch.setattr(context_coder, "LANES", 8)
    monkeypatch.setattr(context_coder, "BLOCK", 16)
    monkeypatch.setattr(context_coder, "SEGMENT_IDS", 40)
    monkeypatch.setattr(context_coder, "TaskContext", type("T", (), {"get": staticmethod(
        lambda: type("C", (), {"partitionId": staticmethod(lambda: 3)}))}))
    groups = {"encode_blocks": [], "decode_blocks": []}
    for name, sizes in groups.items():
        plain = getattr(context_coder, name)
        monkeypatch.setattr(context_coder, name, lambda blocks, *a, plain=plain, sizes=sizes: sizes.append(len(blocks)) or plain(blocks, *a))
    texts = [" ".join(f"w{i}x{k}" for k in range(6)) for i in range(9)]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t.encode()])], names=["doc_id", "body"]) for i, t in enumerate(texts)]
    write = context_coder._write_segments(tokenizer_text(f"{TOKENIZERS}/word_bpe_49k.json"), False, 2, 16)
    rows = pa.Table.from_batches(list(write(iter(batches)))).to_pylist()
    starts = np.cumsum([0] + [r["n_ids"] for r in rows])[:-1].tolist()
    coded = pa.RecordBatch.from_pydict({"segment_start": starts, "data": [r["data"] for r in rows]})
    back = pa.Table.from_batches(list(context_coder._read_segments(iter([coded])))).to_pylist()
    expected = library_ids("word_bpe_49k.json", texts)
    assert [r["doc_id"] for r in back] == list(range(9))
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in back] == expected
    assert [r["start"] for r in back] == np.cumsum([0] + [len(x) for x in expected])[:-1].tolist()
    assert len(rows) > 2 and min(groups["encode_blocks"]) >= 5 and min(groups["decode_blocks"]) >= 5


def plain_code(ids: list[int], bits: int) -> bytes:
    """One block coded id by id, with a range as two integers: the model as its module describes it."""
    f32, total, small = np.float32, 4 * 4096 + 16, max(0, bits - 12)
    slots: dict = {}
    weight = [f32(1 / 3)] * 3
    low, span, out = 0, 1 << 48, 0
    n_words, before, before2 = 0, 0, 0
    mask = (1 << 64) - 1

    def narrow(start: int, size: int) -> None:
        nonlocal low, span, out, n_words
        low, span = low + start, size
        if span < 1 << 32:
            out, n_words = (out << 16) + (low >> 32), n_words + 1
            low, span = (low & 0xFFFFFFFF) << 16, span << 16
        elif low >> 48:
            out, low = out + (low >> 48), low & ((1 << 48) - 1)

    for now in ids:
        one = before * 0x9E3779B97F4A7C15 & mask
        two = (one ^ before2) * 0xC2B2AE3D27D4EB4F & mask
        own = [slots.setdefault(key, {"cdf": [256 * e for e in range(16)], "seen": 0, "guess": -1, "votes": 0})
               for key in (0, (1, one >> 40 & 511), (2, two >> 40 & 511))]
        event = next((e for e, order in ((0, 2), (1, 1), (2, 0)) if own[order]["guess"] == now), None)
        if event is None:
            event = 3 + max(now.bit_length() - small, 0)
        rest = 0 if event < 3 else small + max(event - 4, 0)
        trust = [w * (f32(min(s["seen"], 30)) * f32(0.5) + f32(0.05)) for w, s in zip(weight, own)]
        scale = f32(4) / (trust[0] + trust[1] + trust[2])
        mixed = lambda e: total if e == 16 else int(sum(
            (t * f32(s["cdf"][e]) for t, s in zip(trust[1:], own[1:])), trust[0] * f32(own[0]["cdf"][e])) * scale) + e
        unit = span // total
        narrow(unit * mixed(event), unit * (mixed(event + 1) - mixed(event)))
        narrow((span >> rest) * (now & (1 << rest) - 1), span >> rest)
        p = [f32((s["cdf"] + [4096])[event + 1] - s["cdf"][event] + 16) for s in own]
        weight = [w + (q / (p[0] + p[1] + p[2]) - w) * f32(0.04) for w, q in zip(weight, p)]
        for s in own:
            rate = min(1 + s["seen"] // 2, 5)
            s["cdf"] = [c + (((4096 if e > event else 0) - c) >> rate) for e, c in enumerate(s["cdf"])]
            s["seen"] = min(s["seen"], 254) + 1
            if s["guess"] == now:
                s["votes"] = min(s["votes"], 254) + 1
            elif s["votes"] == 0:
                s["guess"], s["votes"] = now, 1
            else:
                s["votes"] -= 1
        before, before2 = now, before
    whole = (out << 48) + low
    return np.array([whole >> 16 * (n_words + 2 - i) & 0xFFFF for i in range(n_words + 3)], "<u2").tobytes()


def test_blocks_equal_a_plain_coder():
    rng = np.random.default_rng(5)
    phrase = rng.integers(0, 40_000, 12)
    blocks = [rng.integers(0, 9, 900), rng.integers(0, 65_536, 400), np.tile(phrase, 60), np.minimum(rng.zipf(1.4, 700), 60_000), np.zeros(600, int)]
    assert context_coder.encode_blocks(blocks, 16) == [plain_code(b.tolist(), 16) for b in blocks]


def test_files_of_awkward_rows(awkward, empty, spark):
    path = shared_folder(spark, "ids")
    context_coder.write_ids(awkward, path, f"{TOKENIZERS}/word_bpe_49k.json")
    rows = context_coder.read_ids(spark, path).collect()
    got = sorted(rows, key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    source = awkward_rows()
    expected = Counter((r[0], tuple(x)) for r, x in zip(source, library_ids("word_bpe_49k.json", [r[1] or "" for r in source])))
    assert Counter((r["doc_id"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in rows) == expected
    context_coder.write_ids(empty, shared := shared_folder(spark, "ids"), f"{TOKENIZERS}/word_bpe_49k.json")
    assert context_coder.read_ids(spark, shared).count() == 0


def test_damage_is_detected():
    rng = np.random.default_rng(2)
    s = context_coder.Segment([1, None], np.array([5000, 300]), rng.integers(0, 100, 5300).astype(np.uint32))
    data = bytearray(s.pack(context_coder.encode_blocks(s.blocks(), 16), 16))
    doc_ids, counts, coded, sizes, sums, bits = context_coder.unpack(bytes(data))
    assert doc_ids == [1, None] and counts.tolist() == [5000, 300] and sizes.tolist() == [4096, 1204]
    back = context_coder.decode_blocks(coded, sizes, bits)
    assert np.concatenate(back).tolist() == s.ids.tolist()
    assert [zlib.crc32(b.astype("<u4").tobytes()) for b in back] == sums.tolist()
    data[20] ^= 1
    with pytest.raises(ValueError, match="header"):
        context_coder.unpack(bytes(data))
