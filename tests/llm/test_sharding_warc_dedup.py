import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillpoint.llm import exact_dedup, sharding, warc_store
from tillpoint.llm.common import shared_folder

from .conftest import awkward_rows


def test_shards_of_awkward_rows(awkward):
    rows = sharding.assign_shards(awkward, [1.0] * 16).collect()
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in awkward_rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_weights_and_movement(spark):
    ids = spark.range(40_000).withColumn("text", F.lit("x")).withColumnRenamed("id", "doc_id")
    counts = {r["shard"]: r["count"] for r in
              sharding.assign_shards(ids, [1.0, 2.0, 5.0]).groupBy("shard").count().collect()}
    for shard, weight in enumerate((1, 2, 5)):
        assert abs(counts[shard] / 40_000 - weight / 8) < 0.01
    owner = lambda n: {r["doc_id"]: r["s"] for r in ids.select(
        "doc_id", sharding.rendezvous(F.col("doc_id"), [1.0] * n)["shard"].alias("s")).collect()}
    four, five = owner(4), owner(5)
    moved = [i for i in four if four[i] != five[i]]
    assert all(five[i] == 4 for i in moved) and abs(len(moved) / 40_000 - 0.2) < 0.01


def test_shards_of_nothing(empty):
    assert sharding.assign_shards(empty, [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), [0.0])


def test_exact_groups_of_awkward_rows(awkward):
    got = exact_dedup.exact_groups(awkward, capacity=2).collect()
    groups = defaultdict(list)
    for i, t, *_ in awkward_rows():
        groups[t or ""].append(i)
    expected = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            expected[(i, max(known) if known else None, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == expected
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_keeps_whole_rows(awkward, empty):
    stay = exact_dedup.exact_dedup(awkward)
    assert stay.columns == awkward.columns
    texts = [r["text"] or "" for r in stay.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, *_ in awkward_rows()})
    assert exact_dedup.exact_groups(empty).count() == 0


def test_directory_doubles_and_covers_all_hashes():
    rng = np.random.default_rng(0)
    hashes = np.concatenate([rng.integers(-2**63, 2**63, 5000), np.full(3000, 77)]).astype(np.int64)
    prefix = (hashes.view(np.uint64) >> np.uint64(52)).astype(np.int64)
    d = exact_dedup.Directory(np.bincount(prefix, minlength=1 << 12), capacity=100)
    assert len(d.slots) == 1 << d.global_depth and d.sizes.sum() == len(hashes)
    buckets = d.bucket(hashes)
    assert (np.bincount(buckets, minlength=len(d.sizes)) == d.sizes).all()
    over = d.sizes > 100
    assert (d.depths[over] == 12).all()  # only what more bits cannot split
    owners = d.owners(8)
    assert (np.diff(owners) >= 0).all() and owners.max() <= 7


def test_equal_hashes_are_told_apart_by_bytes():
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    rows = [{"part": 0, "entry": k, "hash": 5, "sha256": t, "n": 1, "max_id": k, "max_pos": k, "body": pack(t.encode())}
            for k, t in enumerate(["a", "b", "a"])]
    batch = pa.RecordBatch.from_pylist(rows, schema=exact_dedup.PAGE_SCHEMA)
    out = [r for b in exact_dedup.link_entries(iter([batch])) for r in b.to_pylist()]
    assert {(r["entry"], r["keep_id"], r["group_size"]) for r in out} == {(0, 2, 2), (2, 2, 2), (1, 1, 1)}


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, head string")


def test_warc_records_round_trip(spark):
    big, small = "<p>ü</p>" * 40, "<b>short</b>"
    rows = [(3, "http://a/\r\nX: 1", big), (1, None, big), (2, "u", small), (4, "u", small), (5, "u", None),
            (6, "u", ""), (None, "u", big), (7, "u", "<i>" + big), (1, None, big)]
    path = shared_folder(spark, "t")
    warc_store.write_archive(pages(spark, [(*r, "x", "y") for r in rows]), path)
    index = warc_store.read_index(spark, path).collect()
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in index)
    expected = Counter()
    for page, _, html in rows:
        body = (html or "").encode()
        firsts = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        repeat = len(body) >= 100 and page != min(firsts)
        expected[(page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if repeat else "response",
                  min(firsts) if repeat else None)] += 1
    assert got == expected
    records = warc_store.read_records(spark, path).collect()
    assert Counter(bytes(r["payload"]) for r in records) == Counter((h or "").encode() for _, _, h in rows)
    for r in records:
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
        assert (body == b"\r\n\r\n") == (r["record_type"] == "revisit" or not r["payload"])
    assert spark.read.parquet(f"{path}/payloads").count() == 4  # each payload once


def test_warc_detects_a_damaged_payload(spark):
    path = shared_folder(spark, "t")
    warc_store.write_archive(pages(spark, [(1, "u", "<p>x</p>", "", "")]), path)
    stored = [tuple(r) for r in spark.read.parquet(f"{path}/payloads").collect()]
    bad = [(d, n, b"other") for d, n, _ in stored]
    spark.createDataFrame(bad, "digest string, n_bytes long, payload binary").write.mode("overwrite").parquet(
        f"{path}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc_store.read_index(spark, path).collect()


def test_warc_detects_a_wrong_content_length(spark):
    path = shared_folder(spark, "t")
    warc_store.write_archive(pages(spark, [(1, "u", "<p>x</p>", "", "")]), path)
    heads = [(r["page_id"], r["digest"], bytes(r["head"]).replace(b"Content-Length: 8", b"Content-Length: 9"))
             for r in spark.read.parquet(f"{path}/headers").collect()]
    spark.createDataFrame(heads, "page_id long, digest string, head binary").write.mode("overwrite").parquet(
        f"{path}/headers")
    for read in (warc_store.read_index, warc_store.read_records):
        with pytest.raises(Exception, match="Content-Length does not match"):
            read(spark, path).collect()


def test_the_query_reconstructs_records(spark, monkeypatch):
    """The registered query reads whole records: it fails where they cannot be reconstructed."""
    from tillpoint.llm import queries

    monkeypatch.setattr(warc_store, "read_records", lambda *_: (_ for _ in ()).throw(RuntimeError("records")))
    with pytest.raises(RuntimeError, match="records"):
        queries.op9_warc_store(spark, "/root/testdata/sf0.001")


def test_empty_archive(spark):
    path = shared_folder(spark, "t")
    warc_store.write_archive(pages(spark, []), path)
    assert warc_store.read_index(spark, path).count() == 0


def test_records_of_a_payload_that_a_third_share(spark, monkeypatch):
    """They are rebuilt in many lanes, each record once and with its own bytes."""
    monkeypatch.setattr(warc_store, "LANE_RECORDS", 7)
    hot = "<p>" + "shared " * 30 + "</p>"
    rows = [(i, f"http://h/{i}", hot if i % 3 == 0 else f"<p>{i}</p>" * 20, "x", "y") for i in range(300)]
    path = shared_folder(spark, "warc-test")
    warc_store.write_archive(pages(spark, rows), path)
    got = {r["page_id"]: r for r in warc_store.read_records(spark, path).collect()}
    assert len(got) == 300 and warc_store.read_records(spark, path).count() == 300
    for i, url, html, *_ in rows:
        body = html.encode()
        kind = "revisit" if i % 3 == 0 and i else "response"
        assert bytes(got[i]["payload"]) == body and got[i]["record_type"] == kind
        assert got[i]["payload_digest"] == hashlib.sha256(body).hexdigest()
        record = bytes(got[i]["record"])
        assert f"WARC-Target-URI: {url}\r\n".encode() in record
        assert record.endswith((b"" if kind == "revisit" else body) + b"\r\n\r\n")
