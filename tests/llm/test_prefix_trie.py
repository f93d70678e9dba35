"""The conversation trie against a plain trie of all conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillpoint.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SF = "/root/testdata/sf0.01"


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), (role or "", text or "")))
    turns = {c: [x[1] for x in sorted(v, key=lambda x: x[0])] for c, v in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    members, ended = defaultdict(list), defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ended[tuple(seq)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids[node])
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ended[n]))).encode()).hexdigest())
                  for n, m in members.items())


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


def got(df, most):
    return ordered(tuple(r) for r in prefix_trie.trie(df, most).select(*OUT).collect())


def random_rows(seed, n_convs, deep=False):
    rng = random.Random(seed)
    rows = []
    for c in range(n_convs):
        c = c * 7 - 30 if seed % 2 else c
        for t in range(rng.choice([1, 2, 3, 5, 40 if deep and c % 9 == 0 else 4])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "a b", " ", None, "ä  \tb\nc"])))
    return rows


@pytest.mark.parametrize("seed,most", [(1, 1), (2, 5), (3, 40), (4, 1 << 19)])
def test_random_conversations_in_shards_of_any_size(spark, seed, most):
    rows = random_rows(seed, 60, deep=True)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("clash")).repartition(3)
    assert got(df, most) == ordered(plain_trie(rows))


def test_awkward_rows(spark):
    """Null ids, turns, roles and texts, repeated turns, ties, a turnless conversation, one
    conversation that a third of all have, a long one."""
    rows = [(None, 0, "user", "of no conversation"), (0, None, "user", "null turn first"), (0, 0, None, None),
            (0, 3, "user", "x " * 5000), (1, 0, "user", "repeat"), (1, 0, "user", "repeat"), (-5, 0, "user", "negative")]
    rows += [(c, t, "user", f"same {t}") for c in range(40, 400) for t in range(4)]
    rows += [(77_000, t, "user", f"same {t}") for t in range(900)]
    rows += [(c, 0, "user", "only one") for c in range(10_001, 10_019)]  # some lose it: no base conversation
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    expected = ordered(plain_trie(rows))
    assert any(r[1] == 0 and r[-1] != prefix_trie.NO_ENDS for r in expected)
    for most in (3, 1 << 19):
        assert got(df, most) == expected


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA), 10) == []


def test_findclose(spark):
    rng = random.Random(7)
    for n in (1, 2, 50, 3000):
        bits, depth, opened = [], 0, 0
        while opened < n or depth:
            if opened < n and (depth == 0 or rng.random() < 0.55):
                bits.append(1)
                opened, depth = opened + 1, depth + 1
            else:
                bits.append(0)
                depth -= 1
        tree = prefix_trie.Parentheses(np.array([1, *bits, 0], np.uint8), block=4)
        stack, close = [], {}
        for i, b in enumerate(tree.bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        opens = np.flatnonzero(tree.bits)
        assert tree.findclose(opens).tolist() == [close[i] for i in opens]


def test_whole_table(spark):
    from tillpoint.llm.queries import op12_prefix_trie
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert ordered(tuple(r) for r in op12_prefix_trie(spark, SF).select(*OUT).collect()) == ordered(plain_trie(rows))
