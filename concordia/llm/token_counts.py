"""Operator 8: token counts by a map-side two-tier lookup.

Tier one is a compact table of frequent pre-tokens and their lengths in tokens, broadcast once.  It is taken from the
tokenizer's own vocabulary, whose entries are the frequent pre-tokens by construction: its size is bounded by the
vocabulary, whatever the corpus, and no pass over the corpus is needed to make it.  Tier two is a bounded cache in each
worker, filled by the library for chunks that tier one lacks.  No pre-token is shuffled; every text is counted whole
and exactly.

Null text counts as empty (0 bytes, 0 tokens).  Rows are kept as they are, repeated ones and null ids included;
columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.common import table, tokenizer_path, whole_text
from concordia.llm.pretokens import ChunkCache, library, slices


def frequent_lengths(path: str) -> tuple[bytes, bytes]:
    """The chunks that are vocabulary entries led by a blank, joined by line feeds, and one byte of length for each."""
    tok = library(path)
    chunks = []
    for token in tok.get_vocab(with_added_tokens=False):
        if token[:1] == "Ġ" and "�" not in (s := tok.decoder.decode([token])) and s[:1] == " " and not any(c.isspace() for c in s[1:]):
            chunks.append(s[1:])
    chunks.sort()
    lens = [len(e) for e in tok.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]
    keep = [(c, n) for c, n in zip(chunks, lens) if n < 256]
    return "\n".join(c for c, _ in keep).encode(), bytes(n for _, n in keep)


_COUNTERS: dict[str, ChunkCache] = {}


def _counter(path: str, table_of) -> ChunkCache:
    if path not in _COUNTERS:
        tok = library(path)
        blob, lens = table_of.value
        _COUNTERS[path] = ChunkCache(
            lambda s: [len(e) for e in tok.encode_batch_fast(s, add_special_tokens=False)], dict(zip(blob.decode().split("\n"), lens)), limit=700_000
        )
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row."""
    import pyarrow as pa

    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_lengths(path))
    rows = docs.select(docs[id_col].alias("doc_id"), whole_text(docs, text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _counter(path, frequent)
        for b in batches:
            texts = b.column("text").to_pylist()
            n = [sum(v) for a, z in slices(texts) for v in cache.batch(texts[a:z])]
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
