"""Token ids of whole texts with a public tokenizer, distinct words encoded once.

Both public tokenizers split a text at white space before their merges run, so the
ids of a text are the ids of its words in order. A task cuts its texts into words,
numbers their distinct words in Arrow, has the ``tokenizers`` library encode each new one
once, and looks the others up. Words of ASCII and Latin-1 letters are cut further, where the tokenizer's own
pattern cuts, and each distinct part goes straight to the library's merge model;
other words go through its whole chain, and texts with white space outside ASCII go
to it whole. The result equals ``Tokenizer.encode(text, add_special_tokens=False)``;
strings of special tokens in a text are ordinary text (``encode_special_tokens``).
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_CACHE = 500_000  # distinct words a Python worker remembers
TEXT_CHUNK = 4 << 20  # bytes of text encoded at a time
ROWS = 1_000  # rows turned into Python objects at a time
MOST_USES = 16  # that count when words are dropped

_CONTROL_SPACES = b"\x00" + bytes(range(0x1C, 0x20))
_ODD_SPACES = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_GENERAL_SPACE = re.compile(rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]")
_OTHER_SPACES = b"\t\r\x0b\x0c"
_SPACE_PAIRS = (b"  ", b"\n\n", b" \n", b"\n ")
_SPACED = re.compile(rb" ?[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+")

_CUT = "\x00"  # between words that are cut together

# Words of this alphabet need no normalisation beyond str.lower(), and the patterns
# below cut them where the tokenizers' patterns do (letters, digits, the rest).
_PLAIN_WORD = re.compile(r"[\n ]?[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_OTHER_CHARACTER = "[^\n\x21-\x7eÀ-ÖØ-öø-ÿ]"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_PARTS_SPACED = re.compile(rf"{_CUT}|{_SHORT}| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_CUT}0-9{_LETTER}]+|\n")
_PARTS_WORDS = re.compile(rf"{_CUT}|{_SHORT}|[{_LETTER}]+|[0-9]|[^\s{_CUT}0-9{_LETTER}]+")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the other
    bytes, in order, for the characters from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


# Keys of the word table: a bare word stands for " word" (byte-level) or "word";
# these first bytes, which no UTF-8 text starts with, mark the exceptions.
_AS_IS, _END = b"\xff", b"\xfe"


def _has(body: bytes, chars: bytes) -> bool:
    return len(body.translate(None, chars)) < len(body)


def _odd_space(body: bytes) -> bool:
    found = [p for p in _ODD_SPACES if p in body]
    return bool(found) and (found != [b"\xe2\x80"] or bool(_GENERAL_SPACE.search(body)))


class WordTable:
    """Ids of texts, looked up word by word in a table of the words met so far. A subclass
    cuts texts (``_words``) and adds new words to the table (``_learn``). ``end_id`` is
    appended to each text."""

    def __init__(self, end_id: int | None, cache: int = WORD_CACHE):
        self.end_id, self.cache = end_id, cache
        self._reset()

    def _forget(self) -> None:
        """Keep the words that were met again, half the cache at most; drop the rest. Uses
        count half from then on, so a word often met outlasts a time without it."""
        kept = often_used(self.uses, self.cache // 2)
        words, lengths, ids, uses = list(self.known), self.lengths[kept], ragged(self.ids, self.lengths, kept), self.uses
        self._reset()
        self.known = {words[i]: n for n, i in enumerate(kept.tolist())}
        self.lengths, self.ids, self.uses = lengths, ids, np.minimum(uses[kept], MOST_USES) // 2

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {_END: 0}
        self.lengths = np.array([1], np.int64)
        self.ids = np.array([self.end_id or 0], np.uint32)
        self.uses = np.array([2], np.int64)

    def _add(self, words: list[bytes], lengths: np.ndarray, ids: np.ndarray) -> None:
        first = len(self.lengths)
        self.known.update(zip(words, range(first, first + len(words))))
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])

    def encode(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other as uint32, number of ids of each text)."""
        words: list[bytes] = []
        bounds = np.zeros(len(bodies) + 1, np.int64)
        for i, body in enumerate(bodies):
            words += self._words(body)
            if self.end_id is not None:
                words.append(_END)
            bounds[i + 1] = len(words)
        numbered = pa.array(words, pa.large_binary()).dictionary_encode()
        del words
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = numbered.indices.to_numpy()
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > self.cache:
            self._forget()
            new = [w for w in distinct if w not in self.known]
        if new:
            self._learn(new)
        place = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        self.uses[place] += np.bincount(number, minlength=len(distinct))
        at = place[number]
        ends = np.concatenate([[0], np.cumsum(self.lengths[at])])
        return ragged(self.ids, self.lengths, at), np.diff(ends[bounds])


class WordEncoder(WordTable):
    """Ids of texts for a tokenizer given as its JSON text. ``spaces_matter``: white
    space is part of the tokens (byte-level BPE)."""

    def __init__(self, tokenizer_json: str, spaces_matter: bool, end_id: int | None = None,
                 cache: int = WORD_CACHE):
        from tokenizers import Tokenizer

        self.parts: dict[str, int] = {}
        super().__init__(end_id, cache)
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.spaces_matter = spaces_matter

    def _reset(self) -> None:
        super()._reset()
        if not self.parts:
            self.parts = {_CUT: 0}
            self.part_lengths = self.part_uses = np.array([0], np.int64)
            self.part_ids = np.zeros(0, np.uint32)

    def _forget_parts(self) -> None:
        """Like words: those met again are kept, half the cache at most."""
        kept = often_used(self.part_uses, self.cache // 2)
        parts = list(self.parts)
        self.part_ids = ragged(self.part_ids, self.part_lengths, kept)
        self.parts = {parts[i]: n for n, i in enumerate(kept.tolist())}
        self.part_lengths, self.part_uses = self.part_lengths[kept], np.minimum(self.part_uses[kept], MOST_USES) // 2

    def _words(self, body: bytes) -> list[bytes]:
        if _has(body, _CONTROL_SPACES) or not body.isascii() and _odd_space(body):
            return [_AS_IS + body]
        if not self.spaces_matter:
            return body.split()
        if (_has(body, _OTHER_SPACES) or any(p in body for p in _SPACE_PAIRS)
                or body[:1] in (b" ", b"\n") or body[-1:] in (b" ", b"\n")):
            return [_AS_IS + w for w in _SPACED.findall(body)]
        words = body.replace(b"\n", b" \n").split(b" ")
        words[0] = _AS_IS + words[0]
        return words if body else []

    def _simple(self, words: list[bytes]) -> tuple[list[bytes], str, list[tuple[bytes, str]]]:
        """(words that need no normalisation but str.lower(), their texts joined by cut marks, all
        other words with their texts)."""
        marked = [(w, w[1:].decode()) for w in words if w[:1] == _AS_IS]
        bare = [w for w in words if w[:1] != _AS_IS] if marked else words
        simple = [(w, t) for w, t in marked if _PLAIN_WORD.fullmatch(t)]
        odd = [(w, t) for w, t in marked if not _PLAIN_WORD.fullmatch(t)]
        texts = pa.array(bare, pa.large_binary()).cast(pa.large_string())
        other = pc.and_(pc.invert(pc.string_is_ascii(texts)), pc.match_substring_regex(texts, _OTHER_CHARACTER))
        strange = np.flatnonzero(other.to_numpy(zero_copy_only=False)).tolist()
        if strange:
            space = b" " if self.spaces_matter else b""
            odd += [(w, (w if w[:1] == b"\n" else space + w).decode()) for w in map(bare.__getitem__, strange)]
            left_out = set(strange)
            bare = [w for i, w in enumerate(bare) if i not in left_out]
        mark = _CUT.encode()
        if self.spaces_matter:  # a space before each word, but for those that start a line
            joined = (mark + b" ").join([b"", *bare]).replace(mark + b" \n", mark + b"\n")[1:]
        else:
            joined = mark.join(bare)
        pieces = ([joined.decode()] if bare else []) + [t for _, t in simple]
        return bare + [w for w, _ in simple], _CUT.join(pieces), odd

    def _part_places(self, flat: list[str]) -> np.ndarray:
        """Place of each part in the part table; new parts go through the merge model."""
        new = list(set(flat).difference(self.parts))
        if len(self.parts) + len(new) > self.cache:
            self._forget_parts()
            new = list(set(flat).difference(self.parts))
        if new:
            mapped = _CUT.join(new).encode().decode("latin-1").translate(self.letters).split(self.letters[0])
            tokenize = self.model.tokenize
            found = [[t.id for t in tokenize(m)] for m in mapped]
            first = len(self.part_lengths)
            self.parts.update(zip(new, range(first, first + len(new))))
            self.part_lengths = np.concatenate([self.part_lengths, np.fromiter(map(len, found), np.int64, len(found))])
            self.part_ids = np.concatenate([self.part_ids, np.fromiter(chain.from_iterable(found), np.uint32)])
            self.part_uses = np.concatenate([self.part_uses, np.zeros(len(found), np.int64)])
        at = np.fromiter(map(self.parts.__getitem__, flat), np.int64, len(flat))
        self.part_uses += np.bincount(at, minlength=len(self.part_uses))
        return at

    def _learn(self, words: list[bytes]) -> None:
        simple, joined, odd = self._simple(words)
        if simple:
            cut = (_PARTS_SPACED if self.spaces_matter else _PARTS_WORDS).findall
            at = self._part_places(cut(joined if self.spaces_matter else joined.lower()))
            lengths = self.part_lengths[at]
            border = np.flatnonzero(at == 0)  # the cut mark is part 0, without ids
            ends = np.append(np.cumsum(lengths)[border], lengths.sum())
            self._add(simple, np.diff(ends, prepend=0), ragged(self.part_ids, self.part_lengths, at))
        for first in range(0, len(odd), 10_000):
            part = odd[first:first + 10_000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False)]
            self._add([w for w, _ in part], np.fromiter(map(len, found), np.int64, len(found)),
                      np.fromiter(chain.from_iterable(found), np.uint32))


def often_used(uses: np.ndarray, limit: int) -> np.ndarray:
    """Ascending places of the ``limit`` most used entries of those used twice or more, and 0."""
    order = np.argsort(-uses, kind="stable")[:limit]
    return np.union1d(order[uses[order] >= 2], [0])


def ragged(values: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs numbered ``at`` one after the other; run k is ``lengths[k]`` values long."""
    starts, taken = np.cumsum(lengths) - lengths, lengths[at]
    before = np.cumsum(taken) - taken
    return values[np.repeat(starts[at] - before, taken) + np.arange(taken.sum())]


def worker_held(key: str, make: Callable[[], WordTable]) -> WordTable:
    """The encoder ``key`` of this Python worker, made once: tasks that run in the worker
    one after the other share the words it has learnt."""
    held = sys.modules.setdefault("_tillpoint_encoders", types.ModuleType("_tillpoint_encoders")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def worker_encoder(tokenizer_json: str, spaces_matter: bool, end_id: int | None) -> WordTable:
    return worker_held(f"{hash(tokenizer_json)} {spaces_matter} {end_id}",
                       lambda: WordEncoder(tokenizer_json, spaces_matter, end_id))


def few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``ROWS``, so that few texts at a time are Python objects."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            yield batch.slice(first, ROWS)


def chunks(bodies: list[bytes], limit: int = TEXT_CHUNK):
    """(first, last) row ranges of about ``limit`` bytes."""
    first, held = 0, 0
    for i, body in enumerate(bodies):
        held += len(body)
        if held >= limit:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(bodies):
        yield first, len(bodies)


def tokenizer_text(path: str) -> str:
    """The tokenizer file as text: it is read on the driver and travels with the task
    (a vocabulary file has a fixed size), so executors need no copy of it."""
    with open(path, encoding="utf-8") as f:
        return f.read()
