"""The registered queries against SQL or brute force, and the pipeline's stages."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tillpoint.llm import ordinal_quality, queries, toxicity
from tillpoint.llm.common import staged

from .test_near_fingerprint_unigram import brute_components
from .test_tokens_packing_coder import library_ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = df.columns
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted((tuple(r) for r in df.collect()), key=key)
    rows = duck.execute(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall()
    assert got == sorted(rows, key=key)


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    """Every stage works on what the one before kept; the effects are those of the operators."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, seen, texts = docs.columns, {r["doc_id"] for r in docs.collect()}, []
    from tillpoint.llm.common import staged

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), name)
        assert docs.columns == columns
        rows = docs.collect()
        ids = {r["doc_id"] for r in rows}
        assert ids <= seen and len(ids) == len(rows)
        if name == "quality":
            lost = [i for i in seen - ids if i in labels]
            assert sum(labels[i]["quality"] for i in lost) <= 0.02 * len(labels)
        seen, texts = ids, [r["text"] for r in rows]
    assert len(set(texts)) == len(texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == seen
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_equals_scores_and_brute_force(spark):
    """Each stage keeps what its operator's scores or brute force keep and removes something;
    ``run`` gives the ids of what the stages keep one after the other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def quality(d):
        model = ordinal_quality.fit(d, queries.ratings(labels), grades=3)
        return {r["doc_id"] for r in ordinal_quality.score(d, model).collect() if r["tail_probability"] >= 0.5}

    def clean(d):
        return {r["doc_id"] for r in toxicity.score(d, toxicity.fit(d, labels)).collect() if r["score"] < 0.3}

    def last_of_copies(d):
        return set({r["text"]: r["doc_id"] for r in sorted(d.collect(), key=lambda r: r["doc_id"])}.values())

    def one_of_near(d):
        groups = brute_components([(r["doc_id"], r["text"]) for r in d.collect()], 5, 80)
        return {i for i, (_, smallest) in groups.items() if i == smallest}

    for name, expected in (("quality", quality), ("toxicity", clean), ("exact_dedup", last_of_copies),
                           ("near_dedup", one_of_near)):
        kept = staged(stages[name](spark, docs, SF), name)
        ids = [r["doc_id"] for r in kept.collect()]
        before = docs.count()
        print(name, before, len(ids))
        assert sorted(ids) == sorted(expected(docs)), name
        assert len(ids) < before, name
        docs = kept

    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    tokens = dict(zip(texts, library_ids("byte_bpe_50k.json", list(texts.values()))))
    sequences, parts = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        assert r["doc_tokens"] == len(tokens[r["doc_id"]])
        piece = np.array(tokens[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(piece.tobytes())
        parts[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))

    def end_to_end(spans):
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        return at

    assert {i: end_to_end(p) for i, p in parts.items()} == {i: len(t) for i, t in tokens.items()}
    assert sorted(sequences) == list(range(len(sequences)))
    assert max(end_to_end(p) for p in sequences.values()) <= 1024
