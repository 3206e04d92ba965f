"""Best-fit packing against optimal packings of small groups, and its pieces against the library."""

import random

import numpy as np
import pytest

from concordia.llm import best_fit, pretokens
from concordia.llm.common import tokenizer_path
from tests.llm.corpus import SMALL, edge_documents, small
from tests.llm.test_tokens import crc, mixed

PATH = tokenizer_path("word_bpe_49k.json")
TOK = pretokens.library(PATH)


def ids(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def test_word_ids_equal_the_library():
    texts = mixed() + ["ÀÉ Ñandú naïve ÅNGSTRÖM.", "don't they'll 's ’s", "á éx", "İstanbul ΑΣ ſ ß ﬁ", "<|startoftext|> x<|endoftext|>y", "dans,' .'s", "\x1c\x1d a\x1eb", "\x85\xa0 q z", "x²³ 12 ª", ""]
    for _ in range(2):  # the second time from the cache
        assert [np.frombuffer(b, "<u4").tolist() for b in pretokens.ids_of(PATH, texts)] == [ids(t) for t in texts]


def optimum(sizes, capacity):
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_small_groups_are_optimal():
    rng, beaten = random.Random(3), 0
    for _ in range(300):
        capacity = rng.choice([10, 20, 50, 100])
        low, high = rng.choice([(1, capacity), (capacity // 5, capacity // 2 + 2)])
        sizes = [rng.randrange(low, high) for _ in range(rng.randrange(1, 13))]
        bins, least = best_fit.bin_completion(sizes, capacity), optimum(sizes, capacity)
        assert sorted(s for b in bins for s in b) == sorted(sizes) and max(map(sum, bins)) <= capacity
        assert best_fit.least_bins(sizes, capacity) <= least == len(bins)
        beaten += len(best_fit.best_fit_decreasing(sizes, capacity)) > least
    assert beaten > 5


@pytest.mark.parametrize("low, high, share", [(1300, 1420, 0.94), (800, 2400, 0.995), (1, 4096, 1.0), (1365, 1366, 1.0)])
def test_large_groups_beat_best_fit(low, high, share):
    rng = random.Random(low)
    sizes = [rng.randrange(low, high) for _ in range(1500)]
    plain, bins = best_fit.best_fit_decreasing(sizes, 4096), best_fit.bin_completion(sizes, 4096)
    assert sorted(s for b in bins for s in b) == sorted(sizes) and max(map(sum, bins)) <= 4096
    assert best_fit.least_bins(sizes, 4096) <= len(bins) <= share * len(plain)


def test_dominance():
    left = best_fit.Left([5, 4, 3, 2], 10)
    assert best_fit.dominated((3, 2), 0, left) and best_fit.dominated((4,), 1, left) and not best_fit.dominated((5,), 0, left)
    assert best_fit.fillings(left, 5, 0, 1000, 10) == [(5,)]  # 3 + 2 is dominated by 5


def check(df, got, capacity):
    docs = sorted((str(r.doc_id), crc([*ids(r.text), 1]), tuple([*ids(r.text), 1])) for r in df.collect())
    want = sorted((d, a // capacity, a, min(capacity, len(x) - a), crc(x[a : a + capacity])) for d, _, x in docs for a in range(0, len(x), capacity))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= capacity
    return len(by), sum(len(x) for _, _, x in docs)


def test_packing(spark):
    df = edge_documents(spark)
    check(df, best_fit.pack(df.selectExpr("*", "1 AS g", "2 AS dealt", "3 AS piece"), PATH, 64, group_docs=5).collect(), 64)
    n, total = check(small(spark), best_fit.op13_best_fit(spark, SMALL).collect(), 4096)
    assert n <= -(-total // 4096) * 1.02 + 1
    assert best_fit.pack(df.limit(0), PATH).count() == 0


def test_many_equal_rows_are_spread(spark):
    df = spark.range(0, 3000, 1, 4).selectExpr("CASE WHEN id % 3 = 0 THEN 7L ELSE id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same text' ELSE concat('t ', id) END AS text")
    got = best_fit.pack(df, PATH, 64, group_docs=100).collect()
    check(df, got, 64)
    groups = {}
    for r in got:
        groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + 1
    assert len(groups) == 30 and max(groups.values()) < 170
