"""Operator 7: token ids in binary files with Elias-Fano document boundaries.

Documents are dealt out by ranges of doc_id; each range is one file, a run of segments.  A segment holds whole
documents: their keys and boundaries as Elias-Fano sequences, then their ids end to end, two bytes wide where the
vocabulary allows.  The last bytes of a file index its segments.  The files of a corpus, in order, are the
concatenated id array; a manifest of one row for each file gives the count of ids before it.

Writers keep one segment in memory.  A file is written under a name of its attempt and then renamed, so that a task
that is run again leaves the same file.  The number of files follows the bytes of the input.  Reading goes by the
select structure: it takes the keys and boundaries of a run of documents, and neither sequence is ever decoded whole.

Columns other than doc_id and text aren't read, whatever their names.  Rows with a null id come first; rows with equal ids follow in the order of a hash of their text.  Null text is empty
and still gets its end id.  An empty table has no files and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.common import known_bytes, scratch, shuffle_partitions, table, tokenizer_path, whole_text
from concordia.llm.elias_fano import EliasFano
from concordia.llm.pretokens import ids_of

MAGIC = b"CTOKEF01"
SEGMENT = struct.Struct("<8sQQQB")
ENTRY = struct.Struct("<QQQ")
TAIL = struct.Struct("<QQ8s")


def filesystem(uri: str):
    """pyarrow's filesystem and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as the cluster's default filesystem has it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().replace("file:/", "file:///", 1).replace("file://///", "file:///")


class TokenFileWriter:
    """Appends documents; a segment is written when it holds segment_ids ids."""

    def __init__(self, out, wide: bool, segment_ids: int = 1 << 20):
        self.out, self.wide, self.segment_ids = out, wide, segment_ids
        self.index: list[tuple[int, int, int]] = []
        self.at = self.n_docs = self.n_ids = 0
        self._reset()

    def _reset(self) -> None:
        self.keys: list = []
        self.ids: list[bytes] = []
        self.held = 0

    def add(self, key: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        self.keys.append(key)
        self.ids.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.segment_ids:
            self.flush()

    def flush(self) -> None:
        if not self.keys:
            return
        nulls = sum(k is None for k in self.keys)
        keys = EliasFano.encode(np.array(self.keys[nulls:], np.int64)).to_bytes()
        ends = np.cumsum([0, *(len(x) // 4 for x in self.ids)])
        ids = np.frombuffer(b"".join(self.ids), "<u4").astype("<u4" if self.wide else "<u2")
        data = SEGMENT.pack(MAGIC, len(self.keys), nulls, len(ids), ids.itemsize) + keys + EliasFano.encode(ends).to_bytes() + ids.tobytes()
        self.out.write(data)
        self.index.append((self.at, len(self.keys), len(ids)))
        self.at += len(data)
        self.n_docs += len(self.keys)
        self.n_ids += len(ids)
        self._reset()

    def close(self) -> None:
        self.flush()
        self.out.write(b"".join(ENTRY.pack(*x) for x in self.index) + TAIL.pack(self.at, len(self.index), MAGIC))


class Segment:
    """One segment as read: n documents, the key of each, and its ids, by the select structures of keys and boundaries."""

    def __init__(self, data: bytes):
        magic, self.n, self.nulls, self.n_ids, width = SEGMENT.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        self.keys, at = EliasFano.from_buffer(data, SEGMENT.size)
        self.ends, at = EliasFano.from_buffer(data, at)
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, at)

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        return (None if i < self.nulls else self.keys[i - self.nulls]), self.ids[self.ends[i] : self.ends[i + 1]]

    def documents(self, at_once: int = 4096) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Key, start in the segment and ids of every document; keys and boundaries come by select, a run at a time."""
        for i in range(0, self.n, at_once):
            j = min(self.n, i + at_once)
            ends = self.ends.run(i, j + 1).tolist()
            keys = [None] * max(0, min(j, self.nulls) - i) + self.keys.run(max(0, i - self.nulls), max(0, j - self.nulls)).tolist()
            for k, a, b in zip(keys, ends, ends[1:]):
                yield k, a, self.ids[a:b]


class TokenFile:
    """A file opened for reading: its index, and its segments one at a time."""

    def __init__(self, f):
        self.f = f
        size = f.size()
        f.seek(size - TAIL.size)
        at, n, magic = TAIL.unpack(f.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        f.seek(at)
        raw = f.read(n * ENTRY.size)
        self.index = [ENTRY.unpack_from(raw, i * ENTRY.size) for i in range(n)] + [(at, 0, 0)]

    def segments(self) -> Iterator[Segment]:
        for (a, _, _), (b, _, _) in zip(self.index, self.index[1:]):
            self.f.seek(a)
            yield Segment(self.f.read(b - a))


def shard_count(docs: DataFrame, shard_bytes: int = 256 << 20) -> int:
    """So many files that none holds much more than shard_bytes of what is read, and all tasks of a shuffle have one."""
    size = known_bytes(docs)
    if size is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(shuffle_partitions(docs.sparkSession), -(-size // shard_bytes))


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 0, shards: int | None = None) -> list[dict]:
    """Writes the files; returns the manifest: a row for each file, in order, with the count of ids before it.

    shards: how many ranges; by default as many as the size of the input asks for.  Rows equal in id and text are dealt
    to several ranges where they are many, by where they stand in the input; so the input must be read from files, or
    otherwise come in the same order when a lost task is run again.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    folder = qualified(spark, folder)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(shards or shard_count(rows), "doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie")
    dealt = dealt.select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        shard = TaskContext.get().partitionId()
        fs, place = filesystem(folder)
        name, writer, out = f"{place}/ids-{shard:06d}.efids", None, None
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            if writer is None:
                fs.create_dir(place, recursive=True)
                tmp = f"{place}/.{uuid.uuid4().hex}.tmp"
                out = fs.open_output_stream(tmp)
                writer = TokenFileWriter(out, Tokenizer.from_file(path).get_vocab_size() > 1 << 16)
            for key, ids in zip(b.column("doc_id").to_pylist(), ids_of(path, b.column("text").to_pylist())):
                writer.add(key, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            fs.move(tmp, name)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name.rsplit("/", 1)[1]], "n_docs": [writer.n_docs], "n_ids": [writer.n_ids]})

    found = dealt.mapInArrow(write, "shard long, file string, n_docs long, n_ids long").collect()  # a row for each file
    manifest, start = [], 0
    for r in sorted(found, key=lambda r: r["shard"]):
        manifest.append({"file": f"{folder}/{r['file']}", "start": start, "n_docs": r["n_docs"], "n_ids": r["n_ids"]})
        start += r["n_ids"]
    return manifest


def read_token_files(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    import pyarrow as pa

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(m["file"], m["start"]) for m in manifest], "file string, start long").repartition(len(manifest))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
                fs, place = filesystem(file)
                with fs.open_input_file(place) as f:
                    for segment in TokenFile(f).segments():
                        rows = [(k, base + a, len(x), zlib.crc32(x.astype("<u4").tobytes())) for k, a, x in segment.documents()]
                        base += segment.n_ids
                        cols = list(zip(*rows))
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, schema)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "op7-token-files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"))
    return read_token_files(spark, manifest)
