import random

from concordia.llm import near_dup
from tests.llm.corpus import documents, edge_documents, small


def brute(rows, words, percent):
    """doc_id to (size, component) by all pairs of rows."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        n = min(words, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common * 100 >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def check(df, words=2, percent=80, **more):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = near_dup.near_duplicates(df, words, percent, **more).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, words, percent)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_edges(spark):
    check(edge_documents(spark))
    check(edge_documents(spark).limit(0))
    check(documents(spark, ["A b\tc", "a B c", "a\x85b c", "É b c", "é b c"]))


def test_small_table(spark):
    check(small(spark))
    check(small(spark), words=5)


def test_large_groups_of_alike_documents(spark):
    """Nodes beyond the limit go by leaders, cells and deeper levels."""
    rng = random.Random(4)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(3)]
    texts = []
    for i in range(240):
        t = list(base[i % 3])
        for _ in range(rng.randrange(6)):
            t[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    check(documents(spark, texts), limit=20, deeper=1, depth=1)


def test_trees_suffice_at_the_deepest_level(spark):
    """A pair at the threshold is missed by no more than the stated chance where its nodes are large at every level."""
    n = near_dup.NearDuplicates(documents(spark), 2, 80)
    for count in (2, 50_000, 10**9):
        depth, trees = n.shape(count)
        assert (1 - near_dup.survival(0.8, depth + n.deeper)) ** trees <= n.missed


def test_survivors_keep_one_of_each_group(spark):
    df = documents(spark, ["a b c d e f", "a b c d e f", "A b c d e f", "", "", "other words entirely here now ok"], [7, 3, None, 5, 5, None])
    out = near_dup.drop_near_duplicates(df).collect()
    assert sorted((r.doc_id, r.text) for r in out if r.doc_id) == [(3, "a b c d e f"), (5, ""), (5, "")]
    assert [r.text for r in out if r.doc_id is None] == ["other words entirely here now ok"]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    assert {r.u: r.root for r in near_dup.components(links).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_query_equals_its_sql(spark):
    import duckdb

    from concordia.llm.queries import oracle_sql
    from tests.llm.corpus import SMALL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = sorted(con.execute(oracle_sql()["op1_near_dup"]).fetchall())
    got = near_dup.op1_near_dup(spark, SMALL).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == want
