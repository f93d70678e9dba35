"""The Merkle manifest against a plain tree of the whole table."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tillpoint.llm import merkle

from .conftest import awkward_rows

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root and, per leaf, (left, right) siblings of every level."""
    paths, rows = [[] for _ in leaves], leaves
    spans = [[i] for i in range(len(leaves))]
    while len(rows) > 1:
        above, merged = [], []
        for at in range(0, len(rows), 16):
            run = rows[at:at + 16]
            for i, leaves_below in enumerate(spans[at:at + 16]):
                for leaf in leaves_below:
                    paths[leaf].append(("".join(run[:i]), "".join(run[i + 1:])))
            above.append(sha("".join(run)))
            merged.append([x for s in spans[at:at + 16] for x in s])
        rows, spans = above, merged
    return rows[0], paths


def plain_leaf(row: dict) -> str:
    parts = []
    for c in ("doc_id", "source", "lang", "n_chars", "text"):
        t = None if row[c] is None else str(row[c])
        parts.append("-" if t is None else f"{len(t.encode())}:{t}")
    return sha("".join(parts))


def plain_fold(leaf: str, path) -> str:
    for left, right in path:
        leaf = sha(left + leaf + right)
    return leaf


def plain_manifest(rows: list[dict]) -> list[tuple]:
    groups = defaultdict(list)
    for r in rows:
        text, hit = r["text"], r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        if hit and text is not None:
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        groups[r["source"]].append((r["doc_id"], plain_leaf(r), plain_leaf(r | {"text": text})))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = plain_tree([x[1] for x in groups[g]])
    root, tops = plain_tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for (i, leaf, changed), path in zip(groups[g], trees[g][1]):
            whole = path + top
            folded = plain_fold(changed, whole)
            out.append((i, leaf, trees[g][0], root, sha("".join(a + b for a, b in whole)), folded, folded == root))
    return out


def derived(df, local):
    from tillpoint.llm.queries import manifest_digests
    return [tuple(r) for r in manifest_digests(merkle.documents_manifest(df, local)).collect()]


def same(got, expected):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("local", [1, 3])
def test_awkward_rows(awkward, local):
    rows = [dict(zip(COLUMNS, (i, t, lang, s, n))) for i, t, lang, s, n in awkward_rows()]
    same(derived(awkward, local), plain_manifest(rows))


def test_empty(empty):
    assert derived(empty, 1) == []


@pytest.mark.parametrize("local", [1, 2])
def test_ragged_trees_of_many_rounds(spark, local):
    """Groups of 1 to 4,700 leaves: whole and incomplete runs, several rounds of exchange,
    stand-ins for missing blocks, and more groups than one run holds."""
    sizes = {"a": 1, "b": 16, "c": 17, "d": 256, "e": 257, "f": 272, "g": 273, "h": 529, "i": 4700, None: 33}
    sizes |= {f"z{k}": 1 + k % 3 for k in range(20)}
    rows, n = [], 0
    for g, size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append((n * 7919 % 1_000_003, f"Text {n} ÄB" if n % 11 else None, "en", g, n))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    expected = plain_manifest([dict(zip(COLUMNS, r)) for r in rows])
    same(derived(df.repartition(5), local), expected)
    assert any(not r[-1] for r in expected) and any(r[-1] for r in expected)


def test_equal_rows_are_a_third(spark):
    """One row repeated over a third of the table."""
    rows = [(5, "Copy", "en", "s", 4)] * 400 + [(i, f"T{i}", "en", "s", 2) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    same(derived(df, 1), plain_manifest([dict(zip(COLUMNS, r)) for r in rows]))


def test_proof_of_a_changed_sibling_fails(spark):
    rows = spark.range(40).select(F.col("id"), F.lit("g").alias("group"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    m = merkle.manifest(rows, local=1)
    folded = m.select((merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"),
                      (merkle.fold(F.sha2("leaf", 256), F.col("proof")) == F.col("root")).alias("bad"))
    assert {tuple(r) for r in folded.collect()} == {(True, False)}
