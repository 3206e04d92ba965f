import zlib

import numpy as np

from concordia.llm import toxicity
from tests.llm.corpus import edge_documents, small, documents, SMALL


def test_ngrams_are_those_of_each_text():
    owner, h = toxicity.ngrams(["AbC", "", "abc"])
    assert (owner == 0).sum() == (owner == 2).sum() == 3 + 2 + 1 and (owner == 1).sum() == 0
    assert sorted(h[owner == 0]) == sorted(h[owner == 2])


def test_held_out_accuracy(spark):
    root = SMALL.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{root}/labels.parquet")
    out = toxicity.op6_toxicity(spark, root).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert ((out.doc_id.astype(str).map(lambda x: zlib.crc32(x.encode()) % 5 == 0)) == out.held_out).all()
    rank = held.score.rank().to_numpy()
    p = (held.toxic == 1).to_numpy()
    auc = (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())
    assert auc > 0.85 and (held.predicted == held.toxic).mean() > 0.9
    assert ((out.score >= 0.5).astype(int) == out.predicted).all()


def test_edges(spark):
    labels = spark.createDataFrame([(3, 0), (5, 1), (5, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    docs = edge_documents(spark).withColumn("score", toxicity.F.lit("x")).withColumn("__whole", toxicity.F.lit("y"))
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    assert scored.columns == [*(c for c in docs.columns if c != "score"), "score", "predicted"] and scored.where("__whole = 'y'").count() == docs.count()
    assert toxicity.score(scored, model).columns == scored.columns
    rows = scored.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    none = toxicity.fit(docs, labels.limit(0))
    assert all(r.predicted == 0 for r in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_same_text_same_score(spark):
    model = toxicity.Classifier(np.where(np.arange(1 << toxicity.BITS) % 7 == 0, 0.01, 0.0), -1.0)
    docs = documents(spark, ["the cat sat", "x" * 3_000_000, "the cat sat", "the cat " * 400_000])
    a = [r.score for r in toxicity.score(docs, model).orderBy("doc_id").collect()]
    assert a[0] == a[2]


def test_scores_by_hand(spark):
    """Each score from the n-grams themselves, one at a time."""
    model = toxicity.fit(small(spark), spark.read.parquet(f"{SMALL}/labels.parquet"))
    weights = model.weights.astype(np.float32)
    for r in toxicity.score(small(spark), model).limit(20).collect():
        padded, seen = f" {r.text.lower()} ", {}
        for n in toxicity.ORDERS:
            for i in range(len(padded) - n + 1):
                h = 0
                for j, c in enumerate(padded[i : i + n]):
                    h = (h + ord(c) * toxicity.ODD[j]) % 2**32
                h ^= h >> 15
                h = h * 0x2C1B3C6D % 2**32
                h = (h ^ (h >> 12)) * 0x297A2D39 % 2**32 >> (32 - toxicity.BITS)
                seen[h] = seen.get(h, 0) + 1
        z = model.bias + sum(float(weights[h]) * (1 + np.log(k)) for h, k in seen.items())
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(z, -35, 35)))) < 1e-6


def test_repeated_ids_do_not_multiply_the_sample(spark):
    docs = documents(spark, ["bad word here", "good one", "another good", "foul thing"], [1, 2, 3, 4])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    many = docs
    for _ in range(6):
        many = many.unionByName(docs.where("doc_id = 1"))
    a, b = toxicity.fit(docs, labels), toxicity.fit(many, labels)
    assert np.allclose(a.weights, b.weights) and np.isclose(a.bias, b.bias)
