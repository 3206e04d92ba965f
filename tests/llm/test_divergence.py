"""Source divergence against a plain count over all terms, and the SQL of the query."""

import random
import re
from collections import Counter

import duckdb

from concordia.llm import divergence as D
from concordia.llm.queries import DIVERGENCE_SQL
from tests.llm.corpus import SMALL, edge_documents


def plain(rows, least, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(r.lang or "", r.source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r.text or "").translate(low))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        within = Counter(t for _, _, ws in own for t in set(ws))
        kept = [t for t, n in within.items() if n >= least]
        share = {}
        for source in {d[1] for d in own} | {None}:
            c = Counter(t for _, s, ws in own if source is None or s == source for t in ws)
            n = sum(c[t] for t in kept)
            share[source] = {t: (1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)), c[t]) for t in kept}
        for a in set(share) - {None}:
            pairs = [(b, sum(abs(share[a][t][0] - share[b][t][0]) for t in kept)) for b in set(share) - {None, a}]
            terms = [(t, share[a][t][0] - share[None][t][0]) for t in kept if share[a][t][1] and share[a][t][0] > share[None][t][0]]
            for part, items, n in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, a, part, i, v, k) for k, (i, v) in enumerate(items[:n], 1)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


def test_against_a_plain_count(spark, monkeypatch):
    rng = random.Random(4)
    words = ["a", "b", "Été", "ÉTÉ", "x9y", "漢字", "the", "THE", "rare", "q-r", "ß"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(9))), rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", "é2", None, "S1"])) for i in range(300)]
    rows += [(None, None, "en", "s1"), (1, "", "xx", "alone"), (1, "the the", "xx", "alone"), (7, "a" * 100_000 + " the " * 50_000, "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = plain(df.collect(), 20, 3)
    assert got(D.divergence(df, least=20, top=3)) == want and len(want) > 50
    monkeypatch.setattr(D, "SLICE_CHARS", 500)  # many slices, many shards
    monkeypatch.setattr(D, "SHARD_BYTES", 64)
    assert got(D.divergence(df.repartition(3), least=20, top=3)) == want


def test_odd_rows(spark):
    df = edge_documents(spark)
    df = df.union(df.selectExpr("doc_id", "text", "lang", "'t'", "n_chars").limit(9))
    clash = df.selectExpr("*", "1 AS term", "2 AS shard", "'x' AS part", "3 AS item")
    for least in (1, 2, 1000):
        want = plain(df.collect(), least, 50)
        assert got(D.divergence(clash, least=least)) == want
    assert {(r[2], r[4]) for r in want} == {("pair", 0)}  # no term is kept
    assert got(D.divergence(df.limit(0))) == []


def test_query_gives_the_rows_of_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(DIVERGENCE_SQL).fetchall()
    assert got(D.op11_source_divergence(spark, SMALL)) == sorted(want)
