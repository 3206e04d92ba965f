import math
import zlib
from collections import Counter

import numpy as np

from concordia.llm import language_model as lm
from tests.llm.corpus import edge_documents, small


def check(spark, df, better=False):
    held = df.withColumn("held_out", lm.crc_mod(df["doc_id"], 7) == 2)
    model, counts = lm.fit(held.where("NOT held_out"), words=30, steps=4)
    got = lm.score(held, model, counts, table_words=50).collect()
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert len(got) == len(rows)
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    seen = Counter(w for d, t in rows if not out(d) for w in lm.words_of(t))
    n, v = sum(seen.values()), len(seen)
    want = sorted((str(d), out(d), len(w := lm.words_of(t)), sum(x in seen for x in w), round(sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w), 6)) for d, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 and math.isfinite(r.score) for r in got)
    if better:
        assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    return model


def test_small_table(spark):
    model = check(spark, small(spark), better=True)
    # The classes, and the members of a class, share one unit of probability.
    context = np.arange(0, model.history**2, 997)
    assert np.allclose(np.exp(model.class_logp(context)).sum(1), 1)
    context = np.arange(0, (model.n_classes + 1) * model.history * model.n_classes, 991)
    assert np.allclose(np.exp(model.word_logp(context)).sum(1), 1)


def test_edges(spark):
    check(spark, edge_documents(spark))
    check(spark, edge_documents(spark).where("doc_id = 2"))
    check(spark, edge_documents(spark).limit(0))


def test_contexts_stay_in_their_text():
    m = lm.outline([(b"a", 2), (b"b", 1)], np.ones((2, 1)), 2, 16)
    before2, before = m.contexts(np.array([0, 1, 0, 1, 0]), np.array([3, 1, 1]))
    s = m.start
    assert before.tolist() == [s, 0, 1, s, s] and before2.tolist() == [s, s, 0, s, s]


def plain_score(text, model, seen):
    """log10 probability of a text, a token at a time."""
    total, names = 0.0, {w: i for i, w in enumerate(model.names)}
    sums = {}
    for w, c in seen.items():
        if w not in names:
            n, v = sums.get(g := lm.bucket(w, model.groups, model.buckets), (0, 0))
            sums[g] = (n + c, v + 1)
    before2 = before = model.start
    kinds = [*model.classes.tolist(), model.n_classes]
    for w in lm.words_of(text):
        x = names.get(w, len(names) + lm.bucket(w, model.groups, model.buckets) if w not in names else None)
        z = model.class_weights[0].astype(float) + sum(model.class_weights[r[0]].astype(float) for r in model.class_rows(np.array([before2 * model.history + before])))
        total += (z[kinds[x]] - math.log(sum(math.exp(y) for y in z))) / math.log(10)
        context = np.array([(kinds[before2] * model.history + before) * model.n_classes + kinds[x]])
        z = model.word_weights[model.own_rows()[kinds[x]]].astype(float) + sum(model.word_weights[r[0]].astype(float) for r in model.word_rows(context))
        own = [i for i, c in enumerate(model.classes.tolist()) if c == kinds[x]]
        total += (z[model.members[x]] - math.log(sum(math.exp(z[model.members[i]]) for i in own))) / math.log(10)
        if w not in names:
            n, v = sums.get(x - len(names), (0, 0))
            total += math.log10((seen.get(w, 0) + 1) / (n + v + 1))
        before2, before = before, x
    return total


def test_scores_by_hand(spark):
    held = small(spark).withColumn("held_out", lm.crc_mod(lm.F.col("doc_id"), 7) == 2)
    model, counts = lm.fit(held.where("NOT held_out"), steps=3)
    seen = Counter(w for r in held.where("NOT held_out").collect() for w in lm.words_of(r.text))
    some = held.where("length(text) < 1500").limit(12)
    text = {r.doc_id: r.text for r in some.collect()}
    for r in lm.score(some, model, counts, table_words=100).collect():
        assert abs(r.score - plain_score(text[r.doc_id], model, seen)) < 1e-3 * max(1, abs(r.score) / 100)


def test_the_order_of_rare_words_matters(spark):
    texts = ["common alphaq betaq gammaq deltaq", "common gammaq alphaq deltaq betaq"] * 10
    rows = [(i, t + " common" * 5, False) for i, t in enumerate(texts[::2])] + [(100 + i, t, True) for i, t in enumerate(texts[:2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    model, counts = lm.fit(docs.where("NOT held_out"), words=2, buckets=64, rows=1024)
    a, b = (r.score for r in lm.score(docs.where("held_out"), model, counts).orderBy("doc_id").collect())
    assert a > b + 1  # the order that was learned; all these words end alike and none has a number of its own


def test_sizes_follow_the_corpus():
    sizes = [lm.extent(n) for n in (10**4, 10**6, 10**8, 10**10)]
    assert sizes == sorted(sizes) and len(set(sizes)) == 4
    words, buckets, rows = sizes[-1]
    assert words >= 3000 and 4 * rows * (2 * words**0.5 + lm.GROUPS + 2 * words**0.5) < 150e6
