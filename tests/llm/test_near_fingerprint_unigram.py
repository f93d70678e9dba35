import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillpoint.llm import components, hyperminhash, imatch, unigram

from .conftest import TOKENIZERS, awkward_rows, sentence


def brute_components(rows, words, percent):
    """doc_id -> (set size, smallest doc_id reachable), by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_groups_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for family in range(12):
        base = sentence(family * 31, int(rng.integers(4, 120))).split()
        for copy in range(int(rng.integers(1, 9))):
            words = list(base)
            for _ in range(copy):
                words[int(rng.integers(len(words)))] = f"edit{rng.integers(1000)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(900 + i, t) for i, (_, t, *_) in enumerate(awkward_rows())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (4, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"])
               for r in hyperminhash.near_groups(docs, words=words).collect()}
        expected = brute_components(rows, words, 80)
        assert got == {i: (n, c, c == i) for i, (n, c) in expected.items()}


def test_buckets_that_hold_several_groups_are_compared(spark, monkeypatch):
    """One register a band: unlike texts share buckets, and blocks are split."""
    monkeypatch.setattr(hyperminhash, "BLOCK", 5)
    shared = sentence(3, 30)
    rows = [(i, f"{shared} " + sentence(i // 3 * 17, 40) + (" tail" if i % 3 else "")) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_groups(docs, words=4, bands=4, rows=1).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 4, 80).items()}


def test_near_groups_of_awkward_rows(awkward, empty):
    rows = hyperminhash.near_groups(awkward).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in awkward_rows())
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["component_id"] == by_id[7]["component_id"] == 1
    for i in (3, 4, 5):
        assert by_id[i]["n_shingles"] == 0 and by_id[i]["kept"] and by_id[i]["component_id"] == i
    stay = hyperminhash.near_dedup(awkward)
    assert stay.columns == awkward.columns and {1, 3, 4, 5} <= {r["doc_id"] for r in stay.collect()}
    assert hyperminhash.near_groups(empty).count() == 0


def test_estimate_is_corrected_for_collisions():
    rng = np.random.default_rng(0)
    hashes = hyperminhash.bucket_hashes(4096)
    for share in (0.0, 0.5, 0.8, 1.0):
        common = rng.integers(0, 2**63, int(2000 * share)).astype(np.uint64)
        own = lambda: rng.integers(0, 2**63, 2000 - len(common)).astype(np.uint64) * np.uint64(2)
        a, b = np.concatenate([common, own()]), np.concatenate([common, own()])
        real = len(common) / (4000 - len(common))
        found = hyperminhash.estimate(hyperminhash.registers(a, hashes), hyperminhash.registers(b, hashes), 2000, 2000)
        assert abs(found - real) < 0.04


def test_components_of_a_path_a_star_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 8), (8, 9), (9, 7), (3, 3)]
    links = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    expected = {i: 100 for i in range(100, 141)} | {i: 500 for i in range(500, 560)} | {7: 7, 8: 7, 9: 7}
    assert got == expected
    assert components.connected_components(links.filter("false")).count() == 0


def test_stars_need_no_round(spark, monkeypatch):
    """Links that are stars after each task's folding are written once, not exchanged in rounds."""
    written = []
    staged = components.staged
    monkeypatch.setattr(components, "staged", lambda df, name: written.append(name) or staged(df, name))
    links = spark.createDataFrame([(i, i + 1) for i in range(200, 100, -1)] + [(9, 7), (7, 8)], "u long, v long").coalesce(1)
    got = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    assert got == {i: 101 for i in range(101, 202)} | {7: 7, 8: 7, 9: 7}
    assert len(written) == 1


@pytest.mark.parametrize("links", [[(3, 2), (2, 1)], [(3, 1), (3, 2)], [(1, 2), (2, 3), (4, 5)]])
def test_chains_are_not_settled(spark, links):
    assert not components._settled(spark.createDataFrame(links, "u long, v long"))


def test_late_links_join_whole_components(spark, monkeypatch):
    """Links found inside buckets are between components; all members of both get the least id."""
    calls = []
    joined = hyperminhash.connected_components
    monkeypatch.setattr(hyperminhash, "connected_components", lambda links: calls.append(links.count()) or joined(links))
    words = [f"w{i}" for i in range(2000)]
    rows = [(i * 37 % 101, " ".join(words[i * 5:i * 5 + 60])) for i in range(101)]  # each like its neighbours only
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in
           hyperminhash.near_groups(docs, words=4, bands=24, rows=2, threshold=0.8).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 4, 80).items()}
    assert len(calls) == 2 and calls[1] < calls[0]


def next_text(rows):
    """Text after each place in descending doc_id order, wrapping around."""
    order = sorted({i for i, _ in rows if i is not None}, reverse=True) + [None] * any(i is None for i, _ in rows)
    return {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}


def test_fingerprints_of_awkward_rows(awkward, empty, spark):
    rows = [(i, t or "") for i, t, *_ in awkward_rows()]
    after = next_text(rows)
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(t)
    got = imatch.fingerprints(awkward).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t)) for i, t in rows)
    allowed = defaultdict(set)
    for i, t in rows:
        third = len(t) // 3
        for n in texts[after[i]]:
            allowed[(i, len(t))].add(hashlib.sha256((t[:len(t) - third] + n[:third]).encode()).hexdigest())
    assert all(r["edited_sha256"] in allowed[(r["doc_id"], r["n_chars"])] for r in got)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[1] == prints[2] and prints[3] == prints[4] and prints[1] != prints[8]
    assert imatch.fingerprints(empty).count() == 0
    alone = imatch.fingerprints(spark.createDataFrame([(5, "a single text")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["near_next"]) for r in alone] == [(5, 1.0)]


def test_edited_texts_are_nearer_than_neighbours(spark):
    got = imatch.fingerprints(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).toPandas()
    assert got.near_edited.mean() > 0.1 > got.near_next.mean()
    assert (got.near_edited > got.near_next).mean() > 0.85


def test_neighbours_over_sparse_ids(spark):
    ids = [-(1 << 63), -70_000_000, -5, 0, 4095, 4096, 4097, 20_000_000, 1 << 40]
    got = {r["place"]: r["next_place"] for r in
           imatch.neighbours(spark.createDataFrame([(i,) for i in ids], "place long")).collect()}
    assert got == {i: ids[k - 1] for k, i in enumerate(ids)}


def test_no_task_sorts_all_sparse_places(spark):
    """Ids spread by more than 2**24 are numbered in several tasks; a window over the whole
    table would read them all in one. Only the partitions' counts pass through one task."""
    places = spark.range(20_000).select((F.col("id") * ((1 << 24) + 3) - (1 << 37)).alias("place"))
    linked = imatch.neighbours(places)
    got = {r["place"]: r["next_place"] for r in linked.collect()}
    ids = sorted(got)
    assert len(ids) == 20_000 and got == {i: ids[k - 1] for k, i in enumerate(ids)}
    assert max(single_task_rows(linked), default=0) <= 64


def single_task_rows(df):
    """Rows that went through each exchange to a single partition, from the executed plan."""
    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from walk(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            yield from walk(node.plan())
        else:
            if name == "ShuffleExchangeExec" and "SinglePartition" in node.outputPartitioning().toString():
                yield node.metrics().apply("shuffleRecordsWritten").value()
            children = node.children()
            for i in range(children.size()):
                yield from walk(children.apply(i))
    return list(walk(df._jdf.queryExecution().executedPlan()))


def test_lexicon_band(spark):
    docs = spark.createDataFrame([(i, "common " + ("mid " if i < 4 else "") + f"rare{i}") for i in range(20)],
                                 "doc_id long, text string")
    kept = {r["term"] for r in imatch.lexicon(docs, 0.1, 0.5).collect()}
    mid = docs.select(F.xxhash64(F.lit("mid"))).first()[0]
    assert kept == {mid}


def test_copies_count_once_in_the_lexicon(spark):
    """A third of the rows are copies of one text: the lexicon is that of the distinct texts,
    and the copies keep signatures of their own terms."""
    single = [(i, " ".join([sentence(i * 17, 30)] + [f"mid{i % 25 * 40 + k}" for k in range(40)])) for i in range(200)]
    docs = spark.createDataFrame(single + [(1000 + i, single[7][1]) for i in range(100)], "doc_id long, text string")
    kept = {r["term"] for r in imatch.lexicon(docs, 0.003, 0.2).collect()}
    plain = spark.createDataFrame(single, "doc_id long, text string")
    assert kept == {r["term"] for r in imatch.lexicon(plain, 0.003, 0.2).collect()} and len(kept) >= 1000
    hot = [r for r in imatch.fingerprints(docs).collect() if r["doc_id"] == 7 or r["doc_id"] >= 1000]
    assert len(hot) == 101 and len({r["fingerprint"] for r in hot}) == 1
    changed = [r for r in hot if r["edited_fingerprint"] != r["fingerprint"]]
    assert changed and all(r["near_edited"] > 0 for r in changed)


@pytest.fixture(scope="module")
def model_pair(tmp_path_factory):
    """The same pieces with scores of two binary digits, for us and for the library."""
    import sentencepiece
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")

    proto = pb.ModelProto()
    with open(f"{TOKENIZERS}/piece_bpe_32k.model", "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):
        if p.type == 1:
            p.score = -i / 64
    path = str(tmp_path_factory.mktemp("m") / "unigram.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    return unigram.load_model(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_unigram_equals_the_library(model_pair):
    model, library = model_pair
    texts = [(t or "")[:2000] for _, t, *_ in awkward_rows()] + [
        " ", "  ", "a  b", "\n", "x\n\ny ", "日本語 テスト\U0001d4b3 á", "   lead", "trail   ", "€" * 40, " \n \n"]
    flat, counts = unigram.UnigramEncoder(model).encode([t.encode() for t in texts])
    own = [a.tolist() for a in np.split(flat, np.cumsum(counts)[:-1])]
    assert own == [library.encode(t) for t in texts]
    assert unigram.decode_ids(flat.astype(np.int64), counts, model) == texts == [library.decode(i) for i in own]


def test_trie_finds_every_piece():
    keys = {w.encode(): i for i, w in enumerate(["a", "ab", "abc", "b", "été", "▁", "▁the", "z" * 30])}
    trie = unigram.build_trie(keys)

    def find(key):
        s = 0
        for c in key:
            t = trie.base[s] + c + 1
            if trie.check[t] != s:
                return None
            s = t
        return trie.piece[s]

    assert all(find(k) == i for k, i in keys.items())
    assert find(b"abd") is None and find("ét".encode()) == -1


def test_unigram_rows(awkward, empty):
    model = unigram.load_model(f"{TOKENIZERS}/piece_bpe_32k.model", zipf=True)
    rows = unigram.decode(unigram.encode(awkward, model), model).collect()
    assert Counter((r["doc_id"], r["decoded"]) for r in rows) == Counter((i, t or "") for i, t, *_ in awkward_rows())
    assert all((len(r["ids"]) == 0) == (r["text"] == "") for r in rows)
    assert unigram.decode(unigram.encode(empty, model), model).count() == 0


def test_viterbi_tables_are_small(monkeypatch):
    from tillpoint.llm import unigram
    sizes = []

    def spy(words, model):
        sizes.append((len(words), sum(map(len, words))))
        return np.zeros(len(words), np.uint32), np.ones(len(words), np.int64)
    monkeypatch.setattr(unigram, "viterbi", spy)
    encoder = unigram.UnigramEncoder(None)
    encoder.encode([" ".join(f"word{i:06}" for i in range(30_000)).encode()])
    assert sum(n for n, _ in sizes) == 30_000
    assert max(n for n, _ in sizes) <= 5_000 and max(b for _, b in sizes) <= 500_000 and encoder.cache <= 200_000


def test_few_rows_at_a_time():
    import pyarrow as pa

    from tillpoint.llm import unigram
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], names=["n"]) for n in (0, 2_500, 3)]
    got = list(unigram.few_rows(iter(batches)))
    assert [b.num_rows for b in got] == [1_000, 1_000, 500, 3]
    assert [v for b in got for v in b.column(0).to_pylist()] == [*range(2_500), *range(3)]
