"""Operator 11: how far the sources of a language diverge in their use of terms, by DuckDB over shards of languages and terms.

Terms are runs of letters and of characters beyond ASCII, only A-Z lower-cased.  Each language keeps the terms that are in
enough of its documents.  A group is a language and a source that occur together; in it a kept term has the smoothed share
p = 1 + floor(1e9 * (count + 5) / (N + 5 V)), N being the group's occurrences of the V kept terms, and a language has such
shares q of all its sources.  Two sources are as far apart as the sum of |p - p'| over all kept terms; a group's own terms
are those of p > q.  All of it is exact: integers, and 128-bit ones where a product needs them.

Tasks count the terms of their texts by SQL, a slice of bounded characters at a time, and deal counts, one row for each
slice, shard and group, by a hash of language and term.  Each shard sums them by SQL and keeps what occurs in enough
documents; Spark adds up N and V.  Then each shard, together with the groups' totals, makes its partial sums for pairs of
sources, which Spark adds up and ranks, and its best terms of each group.  In a shard a term only costs the sources that
have it, each against all sources of the language: pairs both without it are one product a pair, added by Spark.  A source
or term with a large share of all rows is spread over slices and shards, and summed before it is dealt.

Null texts, languages and sources count as empty; empty texts have no terms, though their group is there.  Repeated rows
and null ids count each.  A text of any length is taken whole by one task.  Columns but text, lang and source are not
read, whatever their names; an empty table gives no row.  Ranks are without ties: equal values go by their item's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia.llm.common import known_bytes, shuffle_partitions, table, written

SCALE = 1_000_000_000
SLICE_CHARS, SHARD_BYTES = 12_000_000, 16 << 20

SLICED = r"""WITH w AS (SELECT doc, lang, source, unnest(string_split_regex(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM part),
d AS (SELECT doc, lang, source, term, count(*) AS c FROM w WHERE term <> '' GROUP BY ALL),
t AS (SELECT lang, source, term, CAST(sum(c) AS BIGINT) AS c, count(*) AS n FROM d GROUP BY ALL)
SELECT CAST(hash(lang, term) % $shards AS INT) AS shard, lang, source, list(term) AS terms, list(c) AS counts, list(n) AS docs FROM t GROUP BY ALL"""
#: The kept terms of each shard and group; rows of no source have how many terms a language keeps there.
KEPT = """CREATE OR REPLACE TEMP TABLE kept AS WITH u AS (SELECT shard, lang, source, unnest(terms) AS term, unnest(counts) AS c, unnest(docs) AS n FROM dealt),
g AS (SELECT shard, lang, source, term, CAST(sum(c) AS BIGINT) AS c, sum(n) AS n FROM u GROUP BY ALL),
k AS (SELECT shard, lang, term FROM g GROUP BY ALL HAVING sum(n) >= $least) SELECT shard, lang, source, term, c FROM g SEMI JOIN k USING (shard, lang, term)"""
KEPT_ROWS = """SELECT shard, lang, source, list(term) AS terms, list(c) AS counts, CAST(sum(c) AS BIGINT) AS total FROM kept GROUP BY shard, lang, source
UNION ALL SELECT shard, lang, NULL, NULL, NULL, count(DISTINCT term) FROM kept GROUP BY shard, lang"""
KEPT_SCHEMA = "shard int, lang string, source string, terms array<string>, counts array<long>, total long"

SHARES = f"""CREATE OR REPLACE TEMP TABLE shares AS WITH u AS (SELECT lang, source, unnest(terms) AS term, unnest(counts) AS c FROM kept)
SELECT u.lang, u.term, g.id, g.n, g.v, g.whole, g.none, c, CAST(1 + (CAST({SCALE} AS HUGEINT) * (c + 5)) // (g.n + 5 * g.v) AS BIGINT) AS p, dense_rank() OVER (ORDER BY u.lang, u.term) AS t
FROM u JOIN totals g ON g.lang = u.lang AND g.source = u.source"""
#: What a term that some group has adds to the pair of that group and any other, beyond what two groups without it differ by.
PAIRS = """SELECT lang, least(x, y) AS a, greatest(x, y) AS b, CAST(sum(f) AS BIGINT) AS f FROM (
SELECT s.lang, m.source AS x, o.source AS y, abs(s.p - coalesce(r.p, o.none)) - abs(s.none - o.none) AS f
FROM shares s JOIN totals m ON m.id = s.id JOIN totals o ON o.lang = s.lang AND o.id <> s.id LEFT JOIN shares r ON r.t = s.t AND r.id = o.id WHERE r.id IS NULL OR s.id < o.id) GROUP BY ALL"""
TERMS = f"""WITH q AS (SELECT t, CAST(1 + (CAST({SCALE} AS HUGEINT) * (sum(c) + 5)) // (any_value(whole) + 5 * any_value(v)) AS BIGINT) AS q FROM shares GROUP BY t)
SELECT s.lang, g.source AS a, s.term AS b, p - q AS f FROM shares s JOIN q USING (t) JOIN totals g ON g.id = s.id WHERE p > q
QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY p - q DESC, s.term) <= $top"""


def _connect():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": "", "preserve_insertion_order": False})


def counted(docs: DataFrame, shards: int) -> DataFrame:
    """shard, lang, source, terms, counts, docs: occurrences and documents of each term, as a slice of the texts has them."""
    import pyarrow as pa
    import pyarrow.compute as pc

    some = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    rows = docs.select(some("text"), some("lang"), some("source"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect()
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            part = pa.table({"doc": pa.array(range(t.num_rows), pa.int64()), "lang": t["lang"], "source": t["source"], "text": pc.ascii_lower(t["text"])})
            con.register("part", part)
            yield from con.sql(SLICED, params={"shards": shards}).to_arrow_table().to_batches(max_chunksize=2_000)
            con.unregister("part")

        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                held.append(part)
                size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if size >= SLICE_CHARS:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return rows.mapInArrow(count, "shard int, lang string, source string, terms array<string>, counts array<long>, docs array<long>")


def kept_terms(dealt: DataFrame, least: int) -> DataFrame:
    """KEPT_SCHEMA: of dealt counts, a shard's rows in one partition, the terms in at least so many documents of their language."""
    import pyarrow as pa

    kinds = {"terms": pa.list_(pa.string()), "counts": pa.list_(pa.int64()), "total": pa.int64()}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(iter(batches), None)
        if first is None:
            return
        con = _connect()

        def all_() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        con.register("dealt", pa.RecordBatchReader.from_batches(first.schema, all_()))
        con.execute(KEPT, {"least": least})
        con.unregister("dealt")
        made = con.sql(KEPT_ROWS).to_arrow_table()
        for name, kind in kinds.items():
            made = made.set_column(made.schema.get_field_index(name), name, made[name].cast(kind))
        yield from made.to_batches(max_chunksize=200)

    return dealt.mapInArrow(keep, KEPT_SCHEMA)


def shard_count(docs: DataFrame) -> int:
    """Enough shards that one's counts fit a task; they follow the input's bytes, as each shard has partial sums of its own.
    Where the plan doesn't know those, there are as many as shuffle partitions."""
    size = known_bytes(docs)
    least = 2 * docs.sparkSession.sparkContext.defaultParallelism
    return shuffle_partitions(docs.sparkSession) if size is None else max(least, -(-size // SHARD_BYTES))


def divergence(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: of each group all other sources of its language by distance (pair), and its
    own terms by how far their share is above the language's (term, the first `top`)."""
    shards = shard_count(docs)
    kept = written(kept_terms(counted(docs, shards).repartition(shards, "shard"), least), "divergence-kept")

    some = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    groups = docs.select(some("lang"), some("source")).distinct()
    n = kept.where("source IS NOT NULL").groupBy("lang", "source").agg(F.sum("total").alias("n"))
    v = kept.where("source IS NULL").groupBy("lang").agg(F.sum("total").alias("v"))
    groups = groups.join(n, ["lang", "source"], "left").join(v, "lang", "left").na.fill(0, ["n", "v"])
    whole = F.sum("n").over(Window.partitionBy("lang"))
    none = F.when(F.col("v") > 0, F.lit(1) + F.expr(f"5 * {SCALE}L div (n + 5 * v)"))
    totals = written(groups.select("lang", "source", "n", "v", whole.alias("whole"), none.alias("none")), "divergence-totals")

    def compare(key, own, totals):
        import pyarrow as pa

        con = _connect()
        con.register("kept", own)
        con.register("totals", totals.append_column("id", pa.array(range(totals.num_rows), pa.int64())))
        con.execute(SHARES)
        pairs = con.sql(f"SELECT 'pair' AS part, lang, a, b, f FROM ({PAIRS})").to_arrow_table()
        terms = con.sql(f"SELECT 'term' AS part, lang, a, b, f FROM ({TERMS})", params={"top": top}).to_arrow_table()
        return pa.concat_tables([pairs, terms])

    # A shard holds terms of any language, so it takes the totals of all groups: they are dealt to shards as rows are.
    own = kept.where("source IS NOT NULL").select("shard", "lang", "source", "terms", "counts")
    dealt = totals.where("v > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    parts = own.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(compare, "part string, lang string, a string, b string, f long")
    parts = written(parts, "divergence-parts")

    sums = parts.where("part = 'pair'").groupBy("lang", "a", "b").agg(F.sum("f").alias("f"))
    one = totals.select("lang", F.col("source").alias("a"), F.col("none").alias("na"), "v")
    other = totals.select("lang", F.col("source").alias("b"), F.col("none").alias("nb"))
    both = one.join(other, "lang").where("a < b").join(sums, ["lang", "a", "b"], "left")
    value = F.coalesce(F.col("v") * F.abs(F.col("na") - F.col("nb")), F.lit(0)) + F.coalesce("f", F.lit(0))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = both.select("lang", ends.alias("e"), value.cast("long").alias("value")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    terms = parts.where("part = 'term'").select("lang", F.col("a").alias("source"), "part", F.col("b").alias("item"), F.col("f").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
