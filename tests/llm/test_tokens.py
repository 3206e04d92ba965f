"""Token counts, token files, packing and the caches under them, against the library on whole texts."""

import random
import zlib

import numpy as np
import pytest

from concordia.llm import packing, pretokens, token_counts, token_files
from concordia.llm.common import scratch, tokenizer_path
from concordia.llm.elias_fano import EliasFano
from tests.llm.corpus import SMALL, edge_documents, small

PATH = tokenizer_path("byte_bpe_50k.json")
TOK = pretokens.library(PATH)


def ids(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def mixed(n=1500):
    rng = random.Random(1)
    parts = ["a", "b1", " ", "  ", "\n", "\t", ".", "'s", "'", "é", "<|endoftext|>", "9", "漢", "-", "\x1d", "\x0b", "　", "the"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_cached_ids_equal_the_library():
    texts = mixed()
    for _ in range(2):  # the second time from the cache
        assert [np.frombuffer(b, "<u4").tolist() for b in pretokens.ids_of(PATH, texts)] == [ids(t) for t in texts]


def test_small_cache_changes_nothing():
    c = pretokens.ChunkCache(lambda s: [len(e) for e in TOK.encode_batch_fast(s, add_special_tokens=False)], {"the": 1}, limit=3, longest=2)
    texts = mixed(300)
    assert [sum(v) for t in texts for v in c.batch([t])] == [len(ids(t)) for t in texts]


def test_counts(spark):
    for df in (edge_documents(spark), small(spark)):
        rows = {(r.doc_id, r.text) for r in df.collect()}
        want = sorted(((d, len((t or "").encode()), len(ids(t))) for d, t in rows), key=str)
        got = token_counts.count_tokens(df, PATH).collect()
        assert sorted({(r.doc_id, r.n_bytes, r.n_tokens) for r in got}, key=str) == sorted(set(want), key=str) and len(got) == df.count()
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.count_tokens(edge_documents(spark).limit(0), PATH).count() == 0


def test_frequent_table_holds_true_lengths():
    blob, lens = token_counts.frequent_lengths(PATH)
    words = blob.decode().split("\n")
    assert len(words) == len(lens) > 20_000
    for w, n in random.Random(2).sample(list(zip(words, lens)), 300):
        assert len(ids(" " + w)) == n


@pytest.mark.parametrize("values", [[0], [5, 5, 5], [0, 1, 2, 1000, 1001], list(range(0, 10**6, 997)), [-(2**62), 0, 2**62], [7] * 1000 + [10**12]])
def test_elias_fano(values):
    e, end = EliasFano.from_buffer(b"xx" + EliasFano.encode(np.array(values)).to_bytes(), 2)
    assert e.values().tolist() == values and [e[i] for i in range(len(values))] == values
    for a, b in ((0, len(values)), (len(values) // 2, len(values)), (0, 0), (len(values) // 3, 2 * len(values) // 3)):
        assert e.run(a, b).tolist() == values[a:b]
    with pytest.raises(IndexError):
        e[len(values)]
    with pytest.raises(IndexError):
        e.run(0, len(values) + 1)


def test_elias_fano_is_small():
    x = np.sort(np.random.default_rng(0).integers(0, 2**40, 20_000))
    assert 8 * len(EliasFano.encode(x).to_bytes()) < len(x) * (2 + np.log2(2**40 / len(x)) + 0.6) + 1000


def test_files(spark):
    for df in (edge_documents(spark), small(spark)):
        manifest = token_files.write_token_files(df, scratch(spark, "test-ids"), PATH, shards=3)
        got = sorted(token_files.read_token_files(spark, manifest).collect(), key=lambda r: r.start)
        assert len(got) == df.count() and [r.doc_id for r in got] == sorted((r.doc_id for r in df.collect()), key=lambda d: (d is not None, d or 0))
        at = 0
        for r in got:
            assert r.start == at
            at += r.n_tokens
        assert sorted((crc([*ids(r.text), 0]) for r in df.collect())) == sorted(r.ids_crc32 for r in got)
    none = token_files.write_token_files(edge_documents(spark).limit(0), scratch(spark, "test-ids"), PATH)
    assert none == [] and token_files.read_token_files(spark, none).count() == 0


def test_many_equal_rows_go_to_several_files(spark):
    df = spark.range(0, 4000, 1, 8).selectExpr("CASE WHEN id % 3 = 0 THEN 7L ELSE id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same text' ELSE concat('t ', id) END AS text", "1 AS tie", "2 AS place")
    manifest = token_files.write_token_files(df, scratch(spark, "test-ids"), PATH, shards=8)
    assert max(m["n_docs"] for m in manifest) < 1000
    got = token_files.read_token_files(spark, manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in df.collect())
    big = df.withColumn("text", token_files.F.expr("repeat('x', 100)"))
    assert token_files.shard_count(big, shard_bytes=1 << 10) > 4 >= token_files.shard_count(spark.createDataFrame([(1, "a")], "doc_id long, text string"))


def test_select_gives_any_document(spark):
    df = small(spark)
    (m,) = token_files.write_token_files(df.limit(20), scratch(spark, "test-ids"), PATH, shards=1)
    fs, place = token_files.filesystem(m["file"])
    with fs.open_input_file(place) as f:
        (s,) = token_files.TokenFile(f).segments()
    text = {r.doc_id: r.text for r in df.collect()}
    for i in (19, 3, 0, 11):
        key, x = s.document(i)
        assert x.tolist() == [*ids(text[key]), 0]


def check_packing(df, got, capacity):
    docs = {}
    for r in df.collect():
        docs.setdefault((r.doc_id, crc([*ids(r.text), 0])), []).append([*ids(r.text), 0])
    total = sum(len(x) for v in docs.values() for x in v)
    assert sum(r.length for r in got) == total
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= capacity
    want = sorted(((d, a, min(capacity, len(x) - a), crc(x[a : a + capacity]), len(x)) for (d, _), v in docs.items() for x in v for a in range(0, len(x), capacity)), key=str)
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=str) == want
    return len(by), total


def test_packing(spark):
    df = edge_documents(spark)
    check_packing(df, packing.pack(df, PATH, 64, group_docs=5).collect(), 64)
    n, total = check_packing(small(spark), packing.op2_packing(spark, SMALL).collect(), 1024)
    assert n <= -(-total // 1024) * 1.02 + 1
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_packing_of_many_equal_rows(spark):
    df = spark.range(0, 3000, 1, 4).selectExpr("CASE WHEN id % 3 = 0 THEN 7L ELSE id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same text' ELSE concat('t ', id) END AS text", "1 AS g", "2 AS dealt")
    got = packing.pack(df, PATH, 64, group_docs=100).collect()
    check_packing(df, got, 64)
    groups = {}
    for r in got:
        groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + 1
    assert len(groups) == 30 and max(groups.values()) < 170


def test_first_fit_by_the_tree():
    rng = random.Random(5)
    lengths = np.array([rng.randrange(1, 101) for _ in range(400)])
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room, want = [], {}
    for i in sorted(range(400), key=lambda i: (-lengths[i], i)):
        b = next((b for b, r in enumerate(room) if r >= lengths[i]), None)
        if b is None:
            b = len(room)
            room.append(100)
        want[i] = (b, 100 - room[b])
        room[b] -= lengths[i]
    assert all((bins[i], offsets[i]) == want[i] for i in range(400))
