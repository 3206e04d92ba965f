import numpy as np

from concordia.llm import nearest
from tests.llm.corpus import SMALL


def exact(rows, k=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    ids, x = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            s = x @ v
            s[ids == i] = -np.inf
            order = [p for p in np.lexsort((ids, -s)) if ids[p] != i][:k]
            out[i] = [(int(ids[p]), s[p]) for p in order]
    return out


def compare(df, least):
    want = exact([(r.vec_id, r.embedding) for r in df.collect()])
    got = {}
    for r in sorted(nearest.nearest(df).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {q for q, w in want.items() if w}
    hits = total = 0
    for q, g in got.items():
        assert len(g) == len(want[q]) and len({i for i, _ in g}) == len(g)
        assert sorted(g, key=lambda r: (-r[1], r[0])) == g
        hits += len({i for i, _ in g} & {i for i, _ in want[q]})
        total += len(g)
    assert hits >= least * total
    return got


def test_recall_on_a_whole_table(spark):
    compare(spark.read.parquet(f"{SMALL}/embeddings.parquet"), 0.9)


def test_ties_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(100)] + [(100, [9.0, 0.0, 0.0]), (101, None), (102, [0.0, 0.0, 0.0]), (120, [nan, 1.0, 1.0]), (140, [inf, 1.0, 1.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (103, [1.0, None, 1.0]), (104, [])]
    got = compare(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 1.0)
    assert [i for i, _ in got[20]][:3] == [0, 1, 2] and 120 not in got
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    one = nearest.nearest(spark.createDataFrame([(20, [1.0]), (21, [2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in one] == [(20, 1, 21, 2.0)]


def test_parallel_residuals_shrink():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 16))
    plain, aware = nearest.fit(x, 4, threshold=0.0), nearest.fit(x, 4, threshold=0.4)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def along(q):
        codes = q.encode(x)
        made = np.concatenate([q.books[j][codes[:, j]] for j in range(4)], 1)
        return (((x - made) * unit).sum(1) ** 2).mean()

    assert along(aware) < 0.7 * along(plain)


def test_full_block_with_near_copies():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_000, 64)).astype(np.float32)
    x[1::3] = x[1] + rng.normal(scale=0.01, size=x[1::3].shape)
    ids = np.arange(len(x))
    asked = np.arange(0, len(x), 100)  # a third of them among the near copies
    got = {}
    for i, j, _ in nearest.search_block(nearest.fit(x[:4000], rounds=2), asked, x[asked], ids, x, 20, 400):
        got.setdefault(i, []).append(j)
    for i in asked:
        s = x.astype(float) @ x[i].astype(float)
        s[i] = -np.inf
        assert got[i] == np.lexsort((ids, -s))[:20].tolist()


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3 + i % 2 * 2).tolist(), "x") for i in range(15, 215)]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")).collect()
    for q in {r[0] for r in rows if r[0] % 20 == 0}:
        v = dict((i, x) for i, x, _ in rows)[q]
        want = sorted(((-float(np.dot(v, x)), i) for i, x, _ in rows if len(x) == len(v) and i != q))[:20]
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [i for _, i in want]
