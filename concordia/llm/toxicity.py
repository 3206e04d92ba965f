"""Operator 6: toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed 3-, 4- and 5-grams of characters of the lower-cased text, 1 + log of how often each occurs.
Their log-count ratios between toxic and other labelled texts scale them; a logistic regression on the scaled
features that tell the labels apart best, trained by gradient steps, gives the weights.  The classifier is fitted on a
bounded sample, at most max_rows labelled texts chosen by a hash of their id; the scores cover every whole text,
map-side, without a shuffle.

Null and empty texts get the score of no feature at all.  Rows are kept as they are; columns named score or predicted
are replaced by the results.  If labels hold an id twice it is toxic when any of its labels says so, and if documents
hold a labelled id twice the least of its texts is learned from; labels without an id or a value are left out.  With no
label to learn from, or labels of one kind only, every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.common import crc_mod, free_name, release, table, trim, whole_text, written
from concordia.llm.pretokens import slices

BITS = 18
ORDERS = (3, 4, 5)
ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts and hashed n-grams that begin in them; a text is led and followed by a blank."""
    padded = [f" {t.lower()} " for t in texts]
    sizes = np.array([len(t) for t in padded])
    c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    owners, hashes = [], []
    h = np.zeros(len(c), np.uint32)
    for i in range(max(ORDERS)):
        if len(c) <= i:
            break
        h = h[: len(c) - i] + c[i:] * np.uint32(ODD[i])
        if i + 1 in ORDERS:
            same = owner[: len(h)] == owner[i:]
            x = h ^ (h >> np.uint32(15))
            x *= np.uint32(0x2C1B3C6D)
            x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39) >> np.uint32(32 - BITS)
            owners.append(owner[: len(h)][same])
            hashes.append(x[same])
    if not hashes:
        return np.zeros(0, np.int32), np.zeros(0, np.uint32)
    return np.concatenate(owners), np.concatenate(hashes)


def present(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs in order, and 1 + log of how often each occurs; wanted: which features to keep."""
    owner, h = ngrams(texts)
    if wanted is not None:
        keep = wanted[h]
        owner, h = owner[keep], h[keep]
    pairs, n = np.unique(owner.astype(np.int64) << BITS | h, return_counts=True)
    return pairs >> BITS, pairs & ((1 << BITS) - 1), 1 + np.log(n)


@dataclass
class Classifier:
    weights: np.ndarray  # of each hashed feature, its log-count ratio included
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        wanted = self.weights != 0
        out = np.full(len(texts), self.bias)
        for a, b in slices(texts, 500_000):
            owner, f, value = present(texts[a:b], wanted)
            out[a:b] += np.bincount(owner, self.weights[f] * value, b - a)
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, features: int = 3_000, steps: int = 80, penalty: float = 2e-3) -> Classifier:
    """labels: doc_id and toxic.  At most max_rows labelled texts are learned from."""
    import pyarrow as pa

    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    chosen = known.orderBy(F.xxhash64(F.lit(6), "doc_id"), "doc_id").limit(max_rows)
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", whole_text(docs).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "__toxic").agg(F.min("text").alias("text"))  # at most max_rows
    sample = written(sample, "toxicity-sample", max_rows, 2_500)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        df, n = np.zeros((2, 1 << BITS), np.int32), [0, 0]
        for b in batches:
            texts, y = b.column("text").to_pylist(), b.column("__toxic").to_numpy().astype(np.int64)
            for a, z in slices(texts, 500_000):
                owner, f, _ = present(texts[a:z])
                for k in (0, 1):
                    df[k] += np.bincount(f[y[a:z][owner] == k], minlength=1 << BITS).astype(np.int32)
            for k in (0, 1):
                n[k] += int((y == k).sum())
        yield pa.RecordBatch.from_pydict({"n0": [n[0]], "n1": [n[1]], "df": [df.tobytes()]})

    some = sample.coalesce(8)
    parts = some.mapInArrow(counts, "n0 long, n1 long, df binary").collect()  # one row of fixed size for each of eight tasks
    n0, n1 = sum(p.n0 for p in parts), sum(p.n1 for p in parts)
    df = sum((np.frombuffer(p.df, np.int32).reshape(2, -1).astype(np.int64) for p in parts), np.zeros((2, 1 << BITS), np.int64))
    weights = np.zeros(1 << BITS)
    if not n0 or not n1:
        share = min(max(n1 / max(1, n0 + n1), 1e-6), 1 - 1e-6)
        return Classifier(weights, float(np.log(share / (1 - share))))
    ratio = np.log((df[1] + 1) / (n1 + 2)) - np.log((df[0] + 1) / (n0 + 2))
    worth = likelihood_ratio(df, n0, n1)
    top = np.argsort(-worth, kind="stable")[:features]
    top = np.sort(top[worth[top] > 0])
    wanted = np.zeros(1 << BITS, bool)
    wanted[top] = True

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            out = []
            for a, z in slices(texts, 500_000):
                owner, f, value = present(texts[a:z], wanted)
                ends = np.searchsorted(owner, np.arange(1, z - a))
                out += [(x.astype("<u4").tobytes(), v.astype("<f4").tobytes()) for x, v in zip(np.split(f, ends), np.split(value, ends))]
            f, v = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__toxic"), pa.array(f, pa.binary()), pa.array(v, pa.binary())], ["doc_id", "y", "f", "v"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(vectors, f"doc_id {kind}, y int, f binary, v binary").toPandas().sort_values(["doc_id", "f"])  # at most max_rows short rows
    number = np.zeros(1 << BITS, np.int32)
    number[top] = np.arange(len(top))
    rows = [number[np.frombuffer(x, "<u4")] for x in got.f]
    lens = np.array([len(x) for x in rows])
    cols, owner = np.concatenate(rows) if rows else np.zeros(0, int), np.repeat(np.arange(len(rows)), lens)
    value = np.frombuffer(b"".join(got.v), "<f4").astype(np.float64)
    w, bias = logistic(cols, owner, value, ratio[top], got.y.to_numpy(np.float64), steps, penalty)
    weights[top] = w * ratio[top]
    return Classifier(weights, bias)


def likelihood_ratio(df: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """How far the counts of texts that hold a feature, by label, are from independence (the G statistic)."""
    n = n0 + n1
    seen = np.stack([df[0], df[1], n0 - df[0], n1 - df[1]]).astype(np.float64)
    total = df.sum(0)
    expected = np.stack([total * n0 / n, total * n1 / n, (n - total) * n0 / n, (n - total) * n1 / n])
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(seen > 0, seen * np.log(seen / expected), 0).sum(0).clip(0) * (total > 0)


def logistic(cols, owner, value, scale, y, steps: int, penalty: float) -> tuple[np.ndarray, float]:
    """Weights on the scaled features and the bias, by gradient steps of adaptive size over the whole sample."""
    n, k = len(y), len(scale)
    rate = y.mean()
    w = np.zeros(k + 1)
    w[k] = np.log(rate / (1 - rate))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        z = np.bincount(owner, (w[:k] * scale)[cols] * value, n) + w[k]
        err = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / n
        g = np.append(np.bincount(cols, err[owner] * value, k) * scale + penalty * w[:k], err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w[:k], float(w[k])


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with score and predicted after their columns; columns of these names are replaced."""
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, IntegerType, StructType

    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # 1 MB
    own = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    whole = free_name(own, "whole")
    rows = docs.select(*(F.col(f"`{c}`") for c in own), whole_text(docs).alias(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        weights, bias = shared.value
        model = Classifier(weights, bias)
        for b in batches:
            s = model.scores(b.column(whole).to_pylist())
            yield pa.RecordBatch.from_arrays([*map(b.column, own), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*own, "score", "predicted"])

    schema = StructType([docs.schema[c] for c in own]).add("score", DoubleType()).add("predicted", IntegerType())
    return rows.mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fitted on the labels of the rows that aren't held out."""
    model = fit(docs, labels.where(crc_mod(labels["doc_id"], 5) != 0).select("doc_id", "toxic"))
    trim()  # the driver goes on beside its heap
    return model


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    held = docs.select("doc_id", "text", (crc_mod(docs["doc_id"], 5) == 0).alias("held_out"))
    return score(held, model).select("doc_id", "held_out", "score", "predicted")
