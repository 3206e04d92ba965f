"""Operator 10: scores of texts by a hashed maximum-entropy language model.

Tokens are words of the text, A-Z lower-cased, cut at ASCII white space, and one end for each text.

Counts.  Each task counts its words and sends what it has when its table is full; a shuffle adds the parts.  The base
score is the add-one unigram score over these counts.

Model.  The most frequent words have a number of their own; every other word falls in a hashed bucket, whose number
says its last character's group and a hash of the whole word.  The log probability of a token is that of its class
given the history, plus that of its number in the class, plus, in a bucket, that of the word by the bucket's add-one
unigram, with one share for all unseen words.  Classes are frequent words of like frequency, and the buckets of one
group.  Both softmax layers are maximum-entropy models over hashed features of the history: for the class, the number
before, the one before that (a skip feature) and both together; for the number in its class, the one before, and the
class of the one before that together with the class at hand.

Size.  Words, buckets, classes and hashed rows follow the number V of distinct training words: V^0.35 frequent words,
as many buckets, classes by the square root of that, and 16 rows for each number.  For ten billion distinct words these
are 3,200 words and tables of at most 140 MB in single precision; smaller corpora have smaller models.

Training.  The features see no more than the two tokens before, so the counts of (history, class) and of (history,
number) over all training tokens hold all that the gradient needs.  They are gathered by a shuffle once and written to
the shared folder, in order of the history.  A gradient is a sum over them, so each step reads the files as they lie,
batch by batch; blocks of the tables are added up by a shuffle, and the driver gets their sums alone.  Every training
token takes part in every step.

Scoring.  Tokens become numbers, contexts of a batch are made unique, their few hashed rows are added and normalised in
numpy, and the tokens' entries are read off.  Words outside a broadcast table of at most `table_words` short words are
joined with the counts by shuffle.

Null and empty texts are one end token.  Rows are kept, repeated ones and null ids included (a null id counts as empty
text for the held-out rule).  Without training texts the counts are empty and the model is uniform over its classes.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.common import crc_mod, files_for, table, whole_text, written

END = b"\n"  # no word holds white space
LONGEST = 48  # longer words have no number of their own, so that the broadcast table is bounded; buckets take words of any length
GROUPS = 16


def words_of(text: str | None) -> list[bytes]:
    """The text's tokens, the end included."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def rare_group(word: bytes, groups: int) -> int:
    """The group of a word, by a hash of its last character."""
    return int.from_bytes(word[-2:] if word[-1] > 127 else word[-1:], "big") * 0x9E3779B1 % 2**32 * groups >> 32


def bucket(word: bytes, groups: int, buckets: int) -> int:
    """The bucket of a word without a number of its own: the group of its last character, and a hash of the word."""
    return rare_group(word, groups) * buckets + zlib.crc32(word) % buckets


class _Numbers(dict):
    """Word to number; rare words' buckets are kept, and when there are too many the keeping starts afresh."""

    def __init__(self, names: list[bytes], groups: int, buckets: int, limit: int = 500_000):
        super().__init__((w, i) for i, w in enumerate(names))
        self.names, self.groups, self.buckets, self.limit = names, groups, buckets, max(limit, 2 * len(names))
        self.of_last = [rare_group(bytes([c]), groups) * buckets for c in range(128)]

    def __missing__(self, word: bytes) -> int:
        last = word[-1]
        n = len(self.names) + (self.of_last[last] + zlib.crc32(word) % self.buckets if last < 128 else bucket(word, self.groups, self.buckets))
        if len(word) <= LONGEST:
            if len(self) >= self.limit:
                self.clear()
                self.update((w, i) for i, w in enumerate(self.names))
            self[word] = n
        return n


@dataclass
class Model:
    """names: the frequent words, most frequent first; numbers are those and after them the buckets; weights are rows of
    hashed features."""

    names: list[bytes]
    classes: np.ndarray  # class of each number
    members: np.ndarray  # place of each number in its class
    times: np.ndarray  # count of each number
    groups: int
    buckets: int  # of each group
    rows: int
    class_weights: np.ndarray | None = None  # rows, classes
    word_weights: np.ndarray | None = None  # rows, places in a class
    number: dict | None = None
    base: np.ndarray | None = None
    bucket_log: np.ndarray | None = None  # log10 of each bucket's tokens, words and one
    total: int = 0  # training tokens
    distinct: int = 0  # and words

    @property
    def n_classes(self) -> int:
        return int(self.classes.max(initial=0)) + 1

    @property
    def start(self) -> int:
        """Number of what stands before the first token."""
        return len(self.classes)

    @property
    def history(self) -> int:
        return self.start + 1

    @property
    def width(self) -> int:
        return int(self.members.max(initial=0)) + 1

    def class_of(self) -> np.ndarray:
        """Class of every number, the start in one of its own."""
        return np.append(self.classes, self.n_classes).astype(np.int64)

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        if self.number is None:
            self.number = _Numbers(self.names, self.groups, self.buckets)
        return np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))

    def sizes(self) -> np.ndarray:
        return np.bincount(self.classes, minlength=self.n_classes)

    # Hashed rows of the features.

    def _row(self, kind: int, *parts: np.ndarray) -> np.ndarray:
        h = np.full(parts[0].shape, kind * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
        for p in parts:
            h = (h ^ p.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
        return (h % np.uint64(self.rows)).astype(np.int64)

    def class_rows(self, context: np.ndarray) -> list[np.ndarray]:
        """Rows of the features of a history (number before that, number before), beside the first row, which all have."""
        before2, before = context // self.history, context % self.history
        return [self._row(1, before), self._row(2, before2), self._row(3, before2, before)]

    def word_rows(self, context: np.ndarray) -> list[np.ndarray]:
        """Rows of the features of a context (class before that, number before, class), beside the class's own row."""
        c = context % self.n_classes
        before = context // self.n_classes % self.history
        before2 = context // self.n_classes // self.history
        return [self._row(5, before, c), self._row(6, before2, c)]

    def own_rows(self) -> np.ndarray:
        """The row of each class in the table of its members."""
        return self._row(4, np.arange(self.n_classes))

    def _word_base(self) -> np.ndarray:
        """What every context of a class starts with: its own row, and no share for places that it doesn't have."""
        if self.base is None:
            free = np.arange(self.width)[None, :] >= self.sizes()[:, None]
            self.base = np.where(free, np.float32(-1e30), self.word_weights[self.own_rows()]).astype(np.float32)
        return self.base

    def logits(self, kind: int, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights added up for each context and output, and the logarithms of the sums of their exponentials."""
        w, rows = (self.class_weights, self.class_rows(context)) if kind == 0 else (self.word_weights, self.word_rows(context))
        z = w[rows[0]]
        for r in rows[1:]:
            z += w[r]
        z += w[0] if kind == 0 else self._word_base()[context % self.n_classes]
        most = z.max(1)
        return z, np.log(np.exp(z - most[:, None]).sum(1)) + most

    def class_logp(self, context: np.ndarray) -> np.ndarray:
        z, whole = self.logits(0, context)
        return z - whole[:, None]

    def word_logp(self, context: np.ndarray) -> np.ndarray:
        z, whole = self.logits(1, context)
        return z - whole[:, None]

    def contexts(self, numbers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two numbers before each token; texts are end to end."""
        before = np.concatenate([[self.start], numbers[:-1]]) if len(numbers) else numbers
        before2 = np.concatenate([[self.start, self.start], numbers[:-2]])[: len(numbers)]
        first = np.cumsum(lengths) - lengths
        before[first] = self.start
        before2[first] = self.start
        second = first[lengths > 1] + 1
        before2[second] = self.start
        return before2, before

    def token_logp(self, numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log probability of each token's number."""
        before2, before = self.contexts(numbers, lengths)
        kinds = self.class_of()
        c = kinds[numbers]
        out = np.zeros(len(numbers))
        for kind, context, target in (
            (0, before2 * self.history + before, c),
            (1, (kinds[before2] * self.history + before) * self.n_classes + c, self.members[numbers]),
        ):
            order = np.argsort(context)
            fresh = np.flatnonzero(np.concatenate([[True], np.diff(context[order]) != 0])) if len(order) else np.zeros(0, int)
            for a in range(0, len(fresh), 1 << 14):  # so many contexts at once
                part = fresh[a : a + (1 << 14)]
                end = fresh[a + (1 << 14)] if a + (1 << 14) < len(fresh) else len(order)
                own = order[part[0] : end]
                at = np.repeat(np.arange(len(part)), np.diff(np.append(part, end)))
                z, whole = self.logits(kind, context[order[part]])
                out[own] += z[at, target[own]] - whole[at]
        return out


def outline(frequent: list[tuple[bytes, int]], bucket_times: np.ndarray, groups: int, rows: int) -> Model:
    """Classes of frequent words, in the order of their counts, of about equal counts and at most twice the square root
    of all; then a class for the buckets of each group.  bucket_times: groups, buckets."""
    n = len(frequent)
    share, most = max(1, round(n**0.5)), max(2, round(2 * n**0.5))
    total, acc, classes, members = sum(c for _, c in frequent) or 1, 0, [], []
    c = place = 0
    for _, k in frequent:
        if place and (acc * share // total > c or place >= most):
            c, place = c + 1, 0
        classes.append(c)
        members.append(place)
        place += 1
        acc += k
    own, buckets = (c + 1 if n else 0), bucket_times.shape[1]
    return Model(
        [w for w, _ in frequent], np.concatenate([np.array(classes, np.int64), own + np.repeat(np.arange(groups), buckets)]),
        np.concatenate([np.array(members, np.int64), np.tile(np.arange(buckets), groups)]),
        np.concatenate([np.array([k for _, k in frequent], np.float64), bucket_times.ravel().astype(np.float64)]), groups, buckets, rows,
    )


def count_words(texts: DataFrame, full: int = 400_000) -> DataFrame:
    """word and count c over all texts (a column of text)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def send():
            for a in range(0, len(held), 100_000):
                part = list(held.items())[a : a + 100_000] if len(held) > 100_000 else list(held.items())
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], ["word", "c"])
            held.clear()

        for b in batches:
            for at in range(0, len(b), 500):
                for t in b.column("text").slice(at, 500).to_pylist():
                    held.update(words_of(t))
                if len(held) > full:
                    yield from send()
        yield from send()

    return texts.select("text").mapInArrow(run, "word binary, c long").repartition("word").groupBy("word").agg(F.sum("c").alias("c"))


KIND = 1 << 62  # added to the key of a count of numbers in their classes, not to that of classes


def gather(texts: DataFrame, model: Model, full: int = 1_200_000) -> DataFrame:
    """key and count n over all tokens of the texts; a key says kind (class or number), context and output."""
    import pyarrow as pa

    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        kinds = m.class_of()
        raw: list[np.ndarray] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []  # sorted keys and their counts, in parts
        waiting = size = 0

        def count() -> None:
            nonlocal waiting, size
            if raw:
                held.append(np.unique(np.concatenate(raw), return_counts=True))
                size += len(held[-1][0])
                raw.clear()
                waiting = 0

        def merge() -> None:
            nonlocal size
            keys, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            held[:] = [(keys[first], np.add.reduceat(n, first))]
            size = len(first)

        def send():
            nonlocal size
            count()
            if held:
                merge()
                keys, n = held[0]
                for a in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000]), pa.array(n[a : a + 100_000].astype(np.int64))], ["key", "n"])
                held.clear()
                size = 0

        for b in batches:
            for at in range(0, len(b), 500):
                cut = [words_of(t) for t in b.column("text").slice(at, 500).to_pylist()]
                numbers = m.numbers([w for c in cut for w in c])
                before2, before = m.contexts(numbers, np.array([len(c) for c in cut]))
                c = kinds[numbers]
                raw.append((before2 * m.history + before) * m.n_classes + c)
                raw.append(((kinds[before2] * m.history + before) * m.n_classes + c) * m.width + m.members[numbers] + KIND)
                waiting += 2 * len(numbers)
                if waiting > 2 * full:
                    count()
                if size > 3 * full:
                    merge()
                    if size > 2 * full:  # what merging didn't shrink
                        yield from send()
        yield from send()

    # Tasks send sums already, so that nothing is added up again before the shuffle.
    return texts.select("text").mapInArrow(run, "key long, n long").repartition("key").groupBy("key").agg(F.sum("n").alias("n"))


def packed(counts: DataFrame, widths: tuple[int, int], entries: int = 100_000) -> DataFrame:
    """The gathered counts, sorted by key, as few rows of arrays: kind, contexts, how many outputs each has,
    outputs, and their counts.  They are read in every step, so they are kept as numpy takes them."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[pa.RecordBatch]):
            key, n = (pa.Table.from_batches(held).column(c).to_numpy() for c in ("key", "n"))
            cut = int(np.searchsorted(key, KIND))
            for k, own in ((0, slice(0, cut)), (1, slice(cut, len(key)))):
                x, output = np.divmod(key[own] - k * KIND, widths[k])
                if len(x):
                    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                    parts = (x[first], np.diff(np.append(first, len(x))).astype(np.int32), output.astype(np.int32), n[own])
                    yield pa.RecordBatch.from_pydict({"kind": [k]} | {c: [p.tobytes()] for c, p in zip(("context", "size", "output", "n"), parts)})

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size >= entries:
                yield from rows(held)
                held, size = [], 0
        if held:
            yield from rows(held)

    return counts.mapInArrow(run, "kind long, context binary, size binary, output binary, n binary")


BLOCK = 512  # rows of a table whose gradient goes as one


def train(texts: DataFrame, model: Model, tokens: int, steps: int = 12, rate: float = 0.5, penalty: float = 1e-7) -> Model:
    """Weights by gradient steps of adaptive size, each summed over all gathered counts."""
    import pyarrow as pa

    spark = texts.sparkSession
    shapes = ((model.rows, model.n_classes), (model.rows, model.width))
    w = [np.zeros(s) for s in shapes]
    square = [np.zeros(s) for s in shapes]
    model.class_weights, model.word_weights = w
    if not tokens:
        return model
    lying = gather(texts, model).coalesce(files_for(tokens // 4, 500_000)).sortWithinPartitions("key")
    counts = written(packed(lying, (model.n_classes, model.width)), "lm-counts")
    parts = max(6, counts.count() // 40)
    # Both layers start at the log frequencies, so that the steps are about the history.
    w[0][0] = np.log(np.bincount(model.classes, model.times, model.n_classes) + 0.5)
    for c in range(model.n_classes):
        row = model.own_rows()[c]
        own = np.flatnonzero(model.classes == c)
        w[1][row, model.members[own]] += np.log(model.times[own] + 0.5) - np.log(model.times[own].mean() + 0.5)

    for step in range(steps):
        model.class_weights, model.word_weights, model.base = *(x.astype(np.float32) for x in w), None
        shared = spark.sparkContext.broadcast(model)

        def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m: Model = shared.value
            out = [np.zeros(s, np.float32) for s in shapes]

            def one(k: int, x: np.ndarray, at: np.ndarray, y: np.ndarray, c: np.ndarray) -> None:
                seen = np.bincount(at * shapes[k][1] + y, c, len(x) * shapes[k][1]).reshape(len(x), -1).astype(np.float32)
                z, whole = m.logits(k, x)
                z -= whole[:, None]
                diff = seen - np.exp(z) * seen.sum(1, keepdims=True)
                if k == 0:
                    out[0][0] += diff.sum(0)
                else:
                    own = x % m.n_classes
                    order = np.argsort(own)
                    c, first = np.unique(own[order], return_index=True)
                    np.add.at(out[1], m.own_rows()[c], np.add.reduceat(diff[order], first, axis=0))
                for rows in m.class_rows(x) if k == 0 else m.word_rows(x):
                    jumps = np.flatnonzero(rows[1:] != rows[:-1]) + 1
                    if 4 * len(jumps) < len(rows):  # runs, as the contexts are in order
                        first, part = np.concatenate([[0], jumps]), diff
                        rows, part = rows[first], np.add.reduceat(diff, first, axis=0)
                    else:
                        part = diff
                    order = np.argsort(rows)
                    r, first = np.unique(rows[order], return_index=True)
                    out[k][r] += part[order] if len(r) == len(rows) else np.add.reduceat(part[order], first, axis=0)

            for b in batches:
                for r in b.to_pylist():
                    x, size = np.frombuffer(r["context"], np.int64), np.frombuffer(r["size"], np.int32)
                    y, c = np.frombuffer(r["output"], np.int32), np.frombuffer(r["n"], np.int64)
                    ends = np.append(0, np.cumsum(size))
                    for a in range(0, len(x), 1 << 14):
                        z = min(len(x), a + (1 << 14))
                        own = slice(ends[a], ends[z])
                        one(r["kind"], x[a:z], np.repeat(np.arange(z - a), size[a:z]), y[own], c[own])
            for k in (0, 1):
                for a in range(0, m.rows, BLOCK):
                    if (part := out[k][a : a + BLOCK]).any():
                        yield pa.RecordBatch.from_pydict({"kind": [k], "row": [a], "g": [zlib.compress(part.astype(np.float32).tobytes(), 1)]})

        def added(t: pa.Table) -> pa.Table:
            g = sum(np.frombuffer(zlib.decompress(x), np.float32).astype(np.float64) for x in t.column("g").to_pylist())
            return pa.table({"kind": t.column("kind")[:1], "row": t.column("row")[:1], "g": pa.array([g.astype(np.float32).tobytes()], pa.binary())})

        form = "kind long, row long, g binary"
        sums = counts.coalesce(parts).mapInArrow(gradient, form).groupBy("kind", "row").applyInArrow(added, form).collect()  # one table, in blocks
        total = [np.zeros(s) for s in shapes]
        for r in sums:
            part = total[r.kind][r.row : r.row + BLOCK]
            part[:] = np.frombuffer(r.g, np.float32).reshape(part.shape)
        for k, g in enumerate(total):
            g = g / tokens - penalty * w[k]
            square[k] += g * g
            w[k] += rate * g / (np.sqrt(square[k]) + 1e-8)
        shared.unpersist()
    model.class_weights, model.word_weights, model.base = *(x.astype(np.float32) for x in w), None
    return model


def extent(distinct: int) -> tuple[int, int, int]:
    """Frequent words, buckets of each group and rows for so many distinct words."""
    words = max(32, round(distinct**0.35))
    buckets = max(1, -(-words // GROUPS))
    return words, buckets, 1 << max(8, math.ceil(math.log2(16 * (words + GROUPS * buckets))))


def fit(texts: DataFrame, words: int | None = None, buckets: int | None = None, rows: int | None = None, **more) -> tuple[Model, DataFrame]:
    """The model, and the counts of all words of the training texts; sizes that aren't given follow the texts."""
    counts = written(count_words(texts), "lm-words")
    of = extent(counts.count())
    words, buckets, rows = words or of[0], buckets or of[1], rows or of[2]
    frequent = most_frequent(counts, words)
    held = {w for w, _ in frequent}
    n, v = bucket_sums(counts, held, GROUPS, buckets)
    model = outline(frequent, n, GROUPS, rows)
    model = train(texts, model, int(n.sum()) + sum(k for _, k in frequent), **more)
    model.bucket_log = np.log10((n + v + 1).ravel())
    model.total, model.distinct = int(n.sum()) + sum(k for _, k in frequent), int(v.sum()) + len(frequent)
    return model, counts


def most_frequent(counts: DataFrame, n: int, exactly: bool = True) -> list[tuple[bytes, int]]:
    """The n most frequent of the words that aren't long, ties by the word; or as many as whole steps of frequency hold.

    The steps are few, so their sizes tell the least count before any word is sent to the driver.
    """
    short = counts.where(F.length("word") <= LONGEST).withColumn("step", F.floor(F.log2("c") * 8))
    sizes = {r.step: r.n for r in short.groupBy("step").agg(F.count("*").alias("n")).collect()}
    least, held = None, 0
    for step in sorted(sizes, reverse=True):
        if not exactly and held + sizes[step] > n:
            break
        least, held = step, held + sizes[step]
        if exactly and held >= n:
            break
    if least is None:
        return []
    found = short.where(F.col("step") >= least).select("word", "c")
    got = (found.orderBy(F.desc("c"), "word").limit(n) if exactly else found).toArrow()
    return list(zip(got.column("word").to_pylist(), got.column("c").to_pylist()))


def bucket_sums(counts: DataFrame, held: set[bytes], groups: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each bucket: groups, buckets."""
    import pyarrow as pa

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros((2, groups * buckets), np.int64)
        for b in batches:
            words, c = b.column("word").to_pylist(), b.column("c").to_numpy()
            g = np.array([-1 if w in held else bucket(w, groups, buckets) for w in words], np.int64)
            n += np.bincount(g[g >= 0], c[g >= 0], len(n)).astype(np.int64)
            v += np.bincount(g[g >= 0], minlength=len(n))
        some = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(v[some])], ["g", "n", "v"])

    n, v = np.zeros((2, groups * buckets), np.int64)
    for r in counts.mapInArrow(grouped, "g long, n long, v long").groupBy("g").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # a row for each bucket
        n[r.g], v[r.g] = r.n, r.v
    return n.reshape(groups, buckets), v.reshape(groups, buckets)


@dataclass
class Known:
    """The broadcast table of words and their counts; a worker finds a word's number and logarithm by one look-up."""

    words: list[bytes]
    counts: list[int]
    place: dict | None = None

    def of(self, tokens: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the tokens in the model, and log10 of their counts and one; NaN for words outside the table."""
        if self.place is None:
            rare = model.groups * model.buckets
            self.place = _Numbers(self.words, model.groups, model.buckets)
            self.number = np.concatenate([model.numbers(self.words), len(model.names) + np.arange(rare)])
            self.log = np.concatenate([np.log10(np.array(self.counts, np.float64) + 1), np.full(rare, np.nan)])
            model.number = None  # its cache isn't needed beside this one
        at = np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))
        return self.number[at], self.log[at]


def score(docs: DataFrame, model: Model, counts: DataFrame, table_words: int = 200_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row (doc_id, held_out, text)."""
    import pyarrow as pa

    n = model.total
    base_log = float(np.log10(n + model.distinct + 1))
    known = dict(most_frequent(counts, table_words, exactly=False)) | dict(zip(model.names, model.times.astype(int).tolist()))
    shared = docs.sparkSession.sparkContext.broadcast((model, Known(list(known), list(known.values()))))
    rows = docs.select(docs["doc_id"], docs["held_out"], whole_text(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, known = shared.value
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.slice(at, 500)
                cut = [words_of(t) for t in b.column("text").to_pylist()]
                lengths = np.array([len(c) for c in cut], np.int64)
                first = np.cumsum(lengths) - lengths
                tokens = [w for c in cut for w in c]
                numbers, log_c = known.of(tokens, m)
                logp = m.token_logp(numbers, lengths) / np.log(10)
                missed = np.isnan(log_c)
                log_c[missed] = 0
                grouped = numbers >= len(m.names)
                logp[grouped] += log_c[grouped] - m.bucket_log[numbers[grouped] - len(m.names)]
                misses = [Counter(c[i] for i in np.flatnonzero(missed[a : a + k]).tolist()) for c, a, k in zip(cut, first.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"), b.column("held_out"), pa.array(row + np.arange(len(b))), pa.array(lengths),
                        pa.array(lengths - np.add.reduceat(missed.astype(np.int64), first)),
                        pa.array(np.add.reduceat(log_c, first) - lengths * base_log), pa.array(np.add.reduceat(logp, first)),
                        pa.array([list(x) for x in misses], pa.list_(pa.binary())), pa.array([list(x.values()) for x in misses], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "model", "word", "times"],
                )
                row += len(b)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_known long, base double, model double, word array<binary>, times array<bigint>"
    part = written(rows.mapInArrow(run, schema), "lm-part")  # row numbers hold from here on
    sent = part.select("row", F.explode(F.arrays_zip("word", "times")).alias("x")).select("row", "x.word", "x.times")
    found = sent.join(counts, "word").groupBy("row")
    found = found.agg(F.sum("times").alias("more"), F.sum(F.log10(F.col("c") + 1) * F.col("times")).alias("logs"))
    logs = F.coalesce("logs", F.lit(0.0))
    return part.drop("word", "times").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", crc_mod(docs["doc_id"], 7) == 2)
    model, counts = fit(docs.where("NOT held_out"))
    return score(docs, model, counts)
