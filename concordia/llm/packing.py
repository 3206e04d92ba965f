"""Operator 2: documents packed into sequences by first-fit decreasing over a tournament tree.

A document's ids and its end id are cut into pieces of the sequence length and a rest.  The descriptions
of pieces are written first; from then on a document is dealt at random, by a hash of its row's place in the input, so
that repeated rows don't meet in one group, into groups of about group_docs documents.  Each group is packed alone:
full pieces fill sequences of their own, and the rests go by first-fit decreasing, where a tournament tree over the
free room of the open sequences finds the first that fits in logarithmic time.  Only piece descriptions are shuffled,
never texts or ids, and the number of groups grows with the input.

Null text is empty: its document is the end id alone.  Repeated rows, equal ids and null ids are packed as they are.
A very long text is many full pieces.  Columns other than doc_id and text aren't read, whatever their names; an empty
table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.common import table, tokenizer_path, whole_text, written
from concordia.llm.pretokens import ids_of

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class TournamentTree:
    """Free room of bins; each inner node holds the most room below it."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.room = [room] * (2 * self.size)

    def place(self, need: int) -> int:
        """The first bin with that much room; takes it."""
        room, at = self.room, 1
        while at < self.size:
            at *= 2
            if room[at] < need:
                at += 1
        room[at] -= need
        out = at - self.size
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return out


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items in the given order among equals.  No item is longer than the capacity."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = int((lengths == capacity).sum())
    bins[order[:full]] = np.arange(full)
    rest = order[full:]
    tree, used = TournamentTree(len(rest), capacity), {}
    for i in rest.tolist():
        n = int(lengths[i])
        b = tree.place(n)
        bins[i], offsets[i] = full + b, used.get(b, 0)
        used[b] = used.get(b, 0) + n
    return bins, offsets


def pieces_of(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """The pieces of each document, with a hash of its row's place."""
    import pyarrow as pa

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    rows = rows.withColumn("dealt", F.xxhash64(F.lit(11), F.monotonically_increasing_id()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = []
            for key, h, ids in zip(b.column("doc_id").to_pylist(), b.column("dealt").to_pylist(), ids_of(path, b.column("text").to_pylist())):
                data = memoryview(ids + end)
                total = len(data) // 4
                for a in range(0, total, capacity):
                    n = min(capacity, total - a)
                    out.append((key, a, n, zlib.crc32(data[4 * a : 4 * (a + n)]), total, h))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "dealt"])

    return rows.mapInArrow(cut, PIECES + ", dealt long")


def pack(docs: DataFrame, path: str, capacity: int = 1024, group_docs: int = 4096, end_id: int = 0) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    pieces = written(pieces_of(docs, path, capacity, end_id), "packing-pieces", docs.count(), spread=True)
    groups = max(1, -(-pieces.where("start = 0").count() // group_docs))
    pieces = pieces.withColumn("g", F.pmod("dealt", F.lit(groups).cast("long"))).drop("dealt")

    def fit(key, g):
        import pyarrow as pa

        g = g.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(g.column("length").to_numpy(), capacity)
        ids = (key[0].as_py() << 32) + bins
        return g.drop_columns(["g"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    return pieces.groupBy("g").applyInArrow(fit, PIECES + ", sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
