"""I-Match fingerprints and likeness against a plain computation with the xxhash library."""

import hashlib
import struct
from collections import Counter, defaultdict

import pytest
import regex
import xxhash

from tillpoint.llm import imatch

SF = "/root/testdata/sf0.001"


def signed64(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def chained(*values):
    """Spark's xxhash64 of integers (``i`` 4 bytes, ``q`` 8 bytes) or text, in turn."""
    seed = 42
    for kind, v in values:
        data = v.encode() if kind == "s" else struct.pack("<" + kind, v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed64(seed)


def terms_of(text):
    return list(dict.fromkeys(chained(("s", w)) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w))


def short(h):
    return (h & (1 << 64) - 1) >> 32


def plain_signatures(terms, lexicon):
    subsets = [share for share, count in imatch.SUBSETS for _ in range(count)]
    kept = sorted(t for t in terms if t in lexicon)
    if not kept:
        mixed = 0
        for t in terms:
            mixed ^= chained(("q", t))
        return [short(chained(("q", mixed), ("i", -1)))] * len(subsets)
    holds = {t: [chained(("q", t), ("i", n)) % (1 << 20) < int(s * (1 << 20)) for n, s in enumerate(subsets)] for t in kept}
    out = []
    for n in range(len(subsets)):
        own = [t for t in kept if holds[t][n]]
        fields = [f for t in own for f in (("q", t), ("q", sum(1 << k for k, h in enumerate(holds[t]) if h)))]
        out.append(short(chained(*fields, ("i", n))) if own else 0)
    return out


def plain_likeness(a, b):
    used = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


@pytest.mark.parametrize("share", [(0.003, 0.2), (0.05, 0.6)])
def test_fingerprints_and_likeness(spark, share):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    freq = Counter(t for text in set(rows.values()) for t in terms_of(text))
    total = len(set(rows.values()))
    lexicon = {t for t, n in freq.items() if share[0] * total <= n <= max(1.0, share[1] * total)}
    order = sorted(rows, reverse=True)
    following = {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}
    show = lambda s: "-".join(f"{x:08x}" for x in s)
    signed = {i: plain_signatures(terms_of(t), lexicon) for i, t in rows.items()}
    expected = defaultdict(dict)
    for i, text in rows.items():
        cut = len(text) // 3
        edited = text[:len(text) - cut] + rows[following[i]][:cut]
        new = plain_signatures(terms_of(edited), lexicon)
        expected[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), show(signed[i]), show(new),
                       plain_likeness(signed[i], new), plain_likeness(signed[i], signed[following[i]]))
    got = {r["doc_id"]: tuple(r)[1:] for r in imatch.fingerprints(docs, *share).collect()}
    assert got.keys() == expected.keys()
    wrong = [i for i in got if got[i][:4] != expected[i][:4] or any(abs(a - b) > 1e-9 for a, b in zip(got[i][4:], expected[i][4:]))]
    assert wrong == []
