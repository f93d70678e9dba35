"""SentencePiece encoding and decoding with a unigram model.

Pieces and log scores come from a model file (read with the ``sentencepiece``
library on the driver; a vocabulary has a fixed size). They form a double-array trie
over UTF-8 bytes. A text is encoded by Viterbi: the segmentation of highest total
score, where a character that no piece covers costs the unknown score and becomes
byte pieces. White space is escaped to U+2581 and one is put in front, as the
model's identity normaliser does. Since no piece has U+2581 after another character,
or a line break, segmentation splits exactly at words: a worker runs Viterbi once for
each distinct word, many words at a time in numpy, and remembers them.

Decoding joins pieces and raw bytes, turns U+2581 into blanks and drops the first.

Edge cases: null and empty texts have no ids and decode to the empty text; a U+2581
in a text decodes to a blank (that is the format's escape); ids outside the
vocabulary are an error; invalid byte sequences decode to U+FFFD; a null doc_id and
repeated rows pass through; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillpoint.llm.common import id_text
from tillpoint.llm.tokens import WordTable, chunks, few_rows, ragged, worker_held

SPACE = "▁".encode()
WINDOW = 1024  # places looked at together when the trie is laid out
UNKNOWN_PENALTY = 10.0  # below the lowest score of a piece
CHUNK = 1 << 20  # bytes of text or ids worked on at a time
WORDS, CELLS = 5_000, 500_000  # words, and their bytes, in one Viterbi table: some 40 bytes of memory a cell
KEPT_WORDS = 200_000  # distinct words a Python worker remembers


@dataclass
class Trie:
    """Double-array trie: from state s, byte c leads to ``t = base[s] + c + 1`` if
    ``check[t] == s``; ``piece[t]`` is the piece that ends there, or -1."""
    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray


def build_trie(keys: dict[bytes, int]) -> Trie:
    """First-fit construction over the sorted keys."""
    words = sorted(keys)
    size = 1 << 12
    base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0] = 0
    low = {1: 1, 2: 1}  # where the search for one code, or for several, starts
    todo = [(0, 0, len(words), 0)]  # state, range of words, depth
    while todo:
        state, lo, hi, depth = todo.pop()
        if lo < hi and len(words[lo]) == depth:
            piece[state] = keys[words[lo]]
            lo += 1
        groups: list[tuple[int, int, int]] = []  # byte, range of words
        at = lo
        while at < hi:
            c, end = words[at][depth], at
            while end < hi and words[end][depth] == c:
                end += 1
            groups.append((c, at, end))
            at = end
        if not groups:
            continue
        codes = np.array([g[0] + 1 for g in groups])
        kind = min(2, len(codes))
        while True:
            window = low[kind] + WINDOW
            while window + 512 >= len(check):
                grow = len(check)
                base = np.concatenate([base, np.zeros(grow, np.int32)])
                check = np.concatenate([check, np.full(grow, -1, np.int32)])
                piece = np.concatenate([piece, np.full(grow, -1, np.int32)])
            starts = np.flatnonzero(check[low[kind]:window] < 0) + low[kind] - codes[0]
            starts = starts[starts >= 0]
            fits = (check[starts[:, None] + codes[None, :]] < 0).all(axis=1)
            if fits.any():
                start = int(starts[fits.argmax()])
                break
            low[kind] = window
        if kind == 1:
            low[1] = start + int(codes[0])
        base[state] = start
        check[start + codes] = state
        todo.extend((start + g[0] + 1, g[1], g[2], depth + 1) for g in groups)
    pad = np.zeros(257, np.int32)
    return Trie(np.concatenate([base, pad]), np.concatenate([check, pad - 1]), np.concatenate([piece, pad - 1]))


@dataclass
class UnigramModel:
    trie: Trie
    scores: np.ndarray  # log score of every id
    unknown: float
    byte_ids: np.ndarray  # id of the piece of each byte
    piece_bytes: np.ndarray  # text bytes of all ids, one after the other
    piece_lengths: np.ndarray
    name: str


def load_model(path: str, zipf: bool = False) -> UnigramModel:
    """Pieces, scores and kinds of a SentencePiece model file. A BPE file's scores are
    merge ranks, not log probabilities: ``zipf`` takes ``-log(1 + id)`` instead."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    scores = -np.log1p(np.arange(size)) if zipf else np.array([sp.get_score(i) for i in range(size)])
    byte_ids, keys, text = np.zeros(256, np.int32), {}, []
    for i in range(size):
        if sp.is_byte(i):
            value = int(sp.id_to_piece(i)[1:-1], 16)
            byte_ids[value] = i
            text.append(bytes([value]))
        elif sp.is_control(i):
            text.append(b"")
        elif sp.is_unknown(i):
            text.append(" ⁇ ".encode())
        else:
            piece = sp.id_to_piece(i).encode()
            text.append(piece.replace(SPACE, b" "))
            if not sp.is_unused(i):
                keys[piece] = i
    if any(SPACE in k.lstrip(SPACE) or b"\n" in k for k in keys):
        raise ValueError("a piece spans words")
    normal = scores[list(keys.values())]
    return UnigramModel(build_trie(keys), scores, float(normal.min() - UNKNOWN_PENALTY), byte_ids,
                        np.frombuffer(b"".join(text), np.uint8), np.array([len(t) for t in text], np.int64), f"{path} {zipf}")


def viterbi(words: list[bytes], model: UnigramModel) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentation of each word: (all ids one after the other, ids per word).
    All words advance together, one start position at a time."""
    n, longest = len(words), max(map(len, words))
    lengths = np.array([len(w) for w in words])
    text = np.zeros((n, longest + 1), np.uint8)
    text[np.arange(longest + 1)[None, :] < lengths[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    starts_char = (text & 0xC0) != 0x80
    best = np.full((n, longest + 1), -np.inf)
    best[:, 0] = 0.0
    # Inside a character only byte pieces lead on: they are the default.
    came = np.tile(np.arange(-1, longest), (n, 1))
    token = np.concatenate([np.zeros((n, 1), np.int32), model.byte_ids[text[:, :-1]]], axis=1)
    base, check, piece = model.trie.base, model.trie.check, model.trie.piece
    for i in range(longest):
        rows = np.flatnonzero((lengths > i) & starts_char[:, i])
        if not len(rows):
            continue
        covered = np.zeros(n, bool)
        state, at, live = np.zeros(len(rows), np.int64), i, rows
        while len(live) and at < longest:
            nxt = base[state] + text[live, at].astype(np.int64) + 1
            ok = (check[nxt] == state) & (lengths[live] > at)
            live, state = live[ok], nxt[ok]
            at += 1
            ends = piece[state]
            hit = ends >= 0
            if hit.any():
                r, ids = live[hit], ends[hit]
                one = starts_char[r, at] | (lengths[r] == at)
                covered[r[one & (starts_char[r, i + 1:at].sum(axis=1) == 0)]] = True
                value = best[r, i] + model.scores[ids]
                better = value > best[r, at]
                r = r[better]
                best[r, at], came[r, at], token[r, at] = value[better], i, ids[better]
        rest = rows[~covered[rows]]
        if len(rest):  # no piece for this character: bytes, at the unknown score
            width = np.ones(len(rest), np.int64)
            for k in range(1, 4):
                if i + k <= longest:
                    width += (width == k) & (lengths[rest] > i + k) & ~starts_char[rest, np.minimum(i + k, longest)]
            end = i + width
            value = best[rest, i] + model.unknown
            better = value > best[rest, end]
            r, end = rest[better], end[better]
            best[r, end], came[r, end] = value[better], end - 1
            token[r, end] = model.byte_ids[text[r, end - 1]]
    out = np.zeros((n, longest), np.int32)
    counts, at, live = np.zeros(n, np.int64), lengths.copy(), np.flatnonzero(lengths > 0)
    while len(live):
        out[live, counts[live]] = token[live, at[live]]
        counts[live] += 1
        at[live] = came[live, at[live]]
        live = live[at[live] > 0]
    order = counts[:, None] - 1 - np.arange(longest)[None, :]
    picked = np.take_along_axis(out, np.maximum(order, 0), axis=1)
    return picked[order >= 0].astype(np.uint32), counts


_CHUNKS = re.compile(rb" +[^ \n]*|[^ \n]+|\n")
_PAIRS = (b"  ", b"\n\n", b" \n", b"\n ")
_AS_IS = b"\xff"


class UnigramEncoder(WordTable):
    """Ids of texts; distinct words are segmented once."""

    def __init__(self, model: UnigramModel, **table):
        super().__init__(None, **{"cache": KEPT_WORDS} | table)
        self.unigram = model

    def _words(self, body: bytes) -> list[bytes]:
        if not body:
            return []
        if any(p in body for p in _PAIRS) or body[:1] in (b" ", b"\n") or body[-1:] in (b" ", b"\n"):
            return [_AS_IS + w for w in _CHUNKS.findall(b" " + body)]
        return body.replace(b"\n", b" \n").split(b" ")  # a bare word stands for " word"

    def _plain(self, key: bytes) -> bytes:
        word = key[1:] if key[:1] == _AS_IS else key if key[:1] == b"\n" else b" " + key
        return word.replace(b" ", SPACE)

    def _learn(self, words: list[bytes]) -> None:
        plain = [(self._plain(w), w) for w in words]
        plain.sort(key=lambda p: len(p[0]))
        at = 0
        while at < len(plain):  # words of like length together, a bounded table at a time
            limit = max(12, len(plain[at][0]) * 3 // 2)
            end = at
            while end < len(plain) and end - at < WORDS and len(plain[end][0]) <= limit \
                    and (end - at + 1) * len(plain[end][0]) <= CELLS:
                end += 1
            end = max(end, at + 1)
            ids, counts = viterbi([p for p, _ in plain[at:end]], self.unigram)
            self._add([w for _, w in plain[at:end]], counts, ids)
            at = end


def encode(df: DataFrame, model: UnigramModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and ``ids`` (little-endian uint32) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_held(f"unigram {model.name}", lambda: UnigramEncoder(model))
        for batch in few_rows(batches):
            bodies = [t.encode() for t in batch.column("text").to_pylist()]
            for first, last in chunks(bodies, CHUNK):
                flat, counts = encoder.encode(bodies[first:last])
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * 4
                ids = pa.Array.from_buffers(pa.binary(), last - first, [
                    None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat.astype("<u4"))])
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), ids],
                                                 names=["doc_id", "text", "ids"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, text string, ids binary")


def decode_ids(ids: np.ndarray, counts: np.ndarray, model: UnigramModel) -> list[str]:
    """Texts of id runs of ``counts`` ids each."""
    flat = ragged(model.piece_bytes, model.piece_lengths, ids).tobytes()
    before = np.append(0, np.cumsum(model.piece_lengths[ids]))
    ends = before[np.append(0, np.cumsum(counts))]
    texts = []
    for a, b in zip(ends[:-1], ends[1:]):
        raw = flat[a:b]
        texts.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace"))
    return texts


def decode(df: DataFrame, model: UnigramModel, ids_col: str = "ids") -> DataFrame:
    """``df`` with the column ``decoded``: the text of each row's ids."""
    at = df.columns.index(ids_col)
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            rows = batch.column(at).to_pylist()
            for first, last in chunks([r or b"" for r in rows], CHUNK):
                part = [r or b"" for r in rows[first:last]]
                ids = np.frombuffer(b"".join(part), "<u4").astype(np.int64)
                texts = decode_ids(ids, np.array([len(r) // 4 for r in part], np.int64), model)
                piece = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.string())],
                                                 names=[*piece.schema.names, "decoded"])

    return df.mapInArrow(run, schema)

