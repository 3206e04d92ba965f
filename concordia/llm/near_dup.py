"""Operator 1: near-duplicate documents by a chosen-path set similarity join.

A document's set holds its distinct word shingles.  Documents of equal sets form a class, told by a 128-bit hash of
the set; from there on only classes are handled, so copies never meet in pairs.  Each class has 128 minwise tokens.

In each of several independent trees, a node of the tree chooses one or two of the 128 places, on average 1 / threshold,
and each class goes down to one child for each chosen place and the minwise token it has there.  Trees begin at a
depth that follows the number of classes; nodes of more than `limit` classes branch on.  Small nodes are compared
exhaustively, by the share of equal minwise tokens (four bits each).  The number of trees follows from the recall
asked for at the threshold itself; more similar pairs are found with more certainty.

A node stays large where many documents are alike.  There, each class is compared with up to eight leaders of the
node; those close to the first leader, or to a leader that leads to it, hang together already, and only the others
(the rest) must still be compared with all.  If the rest is small, or the node doesn't shrink, that is done in cells of
bounded size, dealt over all tasks; else the node branches on.  No group is ever gathered in one task.

Of the candidates of a node only links that keep together what all of them connect are passed on, with each class's
two most similar ones and two of the smallest hashes.  They are confirmed on the full sets.  What the candidates
connect but the confirmed links don't is then compared exactly, on full sets: every class outside the largest
confirmed part of such a group against all of the group, again in cells of bounded size, so that no link between two
components is missed for a candidate left out.  Components come from large-star and small-star rounds, each written to
the shared folder.

Null text and text without words have an empty set and are linked with nothing.  Rows are kept, repeated ones and null
ids included; a null id never names a component unless no other id is in it, and is never kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.common import files_for, forget, free_name, holds, release, table, whole_text, written

PLACES = 128
#: Candidates have at least this share of equal minwise tokens less than the threshold, in standard deviations.
SLACK = 4.5
NIBBLES = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], np.uint8)
_ODD = (np.random.default_rng(20).integers(0, 2**63, PLACES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            if not self:
                holds("words", self.clear)
            if len(self) >= 200_000:
                self.clear()
            self[word] = h
        return h


_WORDS = _WordHashes()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of a shorter text, of its whole sequence."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, tokens), np.uint64, n)
    k = min(n, words)
    s = h[: n - k + 1] + np.uint64(k)
    for j in range(1, k):
        s = (s ^ (s >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j]
    s = (s ^ (s >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(s ^ (s >> np.uint64(32)))


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each of the minwise tokens of non-empty sets."""
    x = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), PLACES), np.uint16)
    for p in range(PLACES):
        low = np.minimum.reduceat(x * _ODD[p], starts)
        out[:, p] = ((low ^ (low >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return out


def small_signature(sig: np.ndarray) -> np.ndarray:
    """Four bits of each minwise token, two to a byte."""
    low = (sig & 15).astype(np.uint8)
    return low[:, 0::2] << 4 | low[:, 1::2]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity from small signatures; equal bits by chance are taken off."""
    same = NIBBLES[a ^ b].sum(-1, dtype=np.int32) / PLACES
    return (same - 1 / 16) / (15 / 16)


def _mix(x: np.ndarray, y) -> np.ndarray:
    x = (x ^ y) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def branch(node: np.ndarray, row: np.ndarray, sig: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of each (node, row): one, and with probability share a second; both chosen by the node alone."""
    outs, rows = [], []
    h = _mix(node, np.uint64(1))
    first = (h % np.uint64(PLACES)).astype(np.int64)
    second = ((h >> np.uint64(16)) % np.uint64(PLACES)).astype(np.int64)
    twice = ((h >> np.uint64(32)) < np.uint64(int(share * 2**32))) & (second != first)
    for place, on in ((first, None), (second, twice)):
        p, r, n = (place, row, node) if on is None else (place[on], row[on], node[on])
        outs.append(_mix(n, _mix(p.astype(np.uint64) << np.uint64(16) | sig[r, p].astype(np.uint64), np.uint64(2))))
        rows.append(r)
    return np.concatenate(outs), np.concatenate(rows)


def survival(threshold: float, depth: int) -> float:
    """Chance that a pair at the threshold shares a node of that depth in one tree."""
    q, share = 1.0, 1 / threshold - 1
    for _ in range(depth):
        x = 1 - threshold * q
        q = 1 - ((1 - share) * x + share * x * x)
    return q


def _roots(a: np.ndarray, b: np.ndarray, n: int, root: np.ndarray | None = None) -> np.ndarray:
    """The smallest member of each of n members' part, links given by their ends."""
    root = np.arange(n) if root is None else root
    while len(a):
        x, y = root[a], root[b]
        on = x != y
        if not on.any():
            break
        a, b, x, y = a[on], b[on], x[on], y[on]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def thin(a: np.ndarray, b: np.ndarray, like: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of a node's candidate links to pass on: each member's two most alike and its two of the smallest ranks,
    and of the others what it takes to connect all that the candidates connect."""
    members, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, link = ends, np.concatenate([ends[len(a) :], ends[: len(a)]]), np.tile(np.arange(len(a)), 2)
    keep = np.zeros(len(a), bool)
    for by in (-np.tile(like, 2), rank[members][y]):
        order = np.lexsort((by, x))
        nth = np.arange(len(x)) - np.searchsorted(x[order], x[order])
        keep[link[order][nth < 2]] = True
    x, y = ends[: len(a)], ends[len(a) :]
    root = _roots(x[keep], y[keep], len(members))
    for i in np.flatnonzero(root[x] != root[y]).tolist():
        if root[x[i]] != root[y[i]]:
            keep[i] = True
            root = _roots(x[i : i + 1], y[i : i + 1], len(members), root)
    return keep


def thin_dense(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """As thin, from a node's table of equal minwise tokens (a byte a pair); its rows are in the order of their ranks."""
    n = len(same)
    np.fill_diagonal(same, 0)
    ok = same >= least
    row, ends = np.flatnonzero(ok.any(1)), []
    for table in (same, ok):  # the first largest entry of a row: its most alike, or its first in rank
        first = table[row].argmax(1)
        rest = table[row]
        rest[np.arange(len(row)), first] = 0
        second = rest.argmax(1)
        held = ok[row, second] & (rest[np.arange(len(row)), second] > 0)
        ends += [(row, first), (row[held], second[held])]
        del rest
    x, y = np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends])
    root = _roots(x, y, n)
    while True:  # a link out of each part that has one, until no candidate joins two parts
        out = ok & (root[:, None] != root[None, :])
        row = np.flatnonzero(out.any(1))
        if not len(row):
            break
        row = row[np.unique(root[row], return_index=True)[1]]
        far = out[row].argmax(1)
        x, y = np.concatenate([x, row]), np.concatenate([y, far])
        root = _roots(row, far, n, root)
    pairs = np.unique(np.minimum(x, y) * n + np.maximum(x, y))
    return pairs // n, pairs % n


def equal_tokens(sig: np.ndarray) -> np.ndarray:
    """For each pair of rows how many minwise tokens look equal, a byte each; in strips, so that little more is held."""
    n = len(sig)
    same = np.empty((n, n), np.uint8)
    strip = max(1, (1 << 22) // max(1, sig.size))
    for a in range(0, n, strip):
        part = NIBBLES[sig[a : a + strip, None] ^ sig[None, a:]].sum(-1, dtype=np.uint8)
        same[a : a + strip, a:] = part
        same[a:, a : a + strip] = part.T
    return same


def compare(node: np.ndarray, sig: np.ndarray, rank: np.ndarray, cut: float, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Places of the candidate links within the runs of equal nodes; all rows of a node are given, sorted by node.

    Nodes of up to `small` rows are compared together; a larger one alone, by tables of a byte for each pair of its rows,
    and its links are thinned before the next one's are made.
    """
    n = len(node)
    if not n:
        return np.zeros(0, int), np.zeros(0, int)
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    ends = np.append(starts[1:], n)
    sizes = ends - starts
    firsts, seconds, likes = [], [], []
    large_a, large_b = [], []
    least = math.ceil(PLACES * (1 / 16 + cut * 15 / 16) - 1e-9)  # the cut as a count of equal tokens
    for x, y in zip(starts[sizes > small].tolist(), ends[sizes > small].tolist()):
        order = x + np.argsort(rank[x:y], kind="stable")
        a, b = thin_dense(equal_tokens(sig[order]), least)
        large_a.append(order[a])
        large_b.append(order[b])
    left = np.repeat(np.where(sizes > small, starts, ends), sizes) - np.arange(n)
    at, s = np.flatnonzero(left > 1), 1
    while len(at):
        for c in range(0, len(at), 1 << 14):
            i = at[c : c + (1 << 14)]
            like = likeness(sig[i], sig[i + s])
            ok = like >= cut
            firsts.append(i[ok])
            seconds.append(i[ok] + s)
            likes.append(like[ok])
        s += 1
        at = at[left[at] > s]
    a, b, like = (np.concatenate(z) if z else np.zeros(0, int) for z in (firsts, seconds, likes))
    run = np.searchsorted(starts, a, "right") - 1
    order = np.argsort(run, kind="stable")
    a, b, like, run = a[order], b[order], like[order], run[order]
    keep = np.ones(len(a), bool)
    edges = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1], [True]])) if len(a) else np.zeros(1, int)
    for x, y in zip(edges[:-1], edges[1:]):
        if y - x > 6:
            keep[x:y] = thin(a[x:y], b[x:y], like[x:y], rank)
    return np.concatenate([a[keep], *large_a]), np.concatenate([b[keep], *large_b])


def _fixed(column, kind, width: int) -> np.ndarray:
    """A binary column of one width as a matrix."""
    if not len(column):
        return np.zeros((0, width), kind)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


class NearDuplicates:
    """The join over one table of documents; words is the length of a shingle, percent the least similarity."""

    def __init__(self, docs: DataFrame, words: int = 5, percent: int = 80, missed: float = 1e-5, limit: int = 512, deeper: int = 3, trees: int | None = None, depth: int | None = None):
        self.docs, self.words, self.percent, self.limit, self.deeper = docs, words, percent, limit, deeper
        self.spark: SparkSession = docs.sparkSession
        self.missed, self.trees, self.depth = missed, trees, depth
        self.threshold = percent / 100
        self.cut = self.threshold - SLACK * math.sqrt(self.threshold * (1 - self.threshold) / PLACES)

    def _keyed(self) -> DataFrame:
        text = whole_text(self.docs)
        return self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), row_key(F.col("doc_id").cast("long"), text).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"))

    def documents(self) -> DataFrame:
        """doc_id, key, size of the text, size of the set, its hash (cid) and its minwise tokens, of every row."""
        import pyarrow as pa

        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            release("words")
            for whole in batches:
                for at in range(0, len(whole), 500):
                    b = whole.slice(at, 500)
                    sets = [shingles(t, words) for t in b.column("text").to_pylist()]
                    full = [s for s in sets if len(s)]
                    sigs = iter(minwise(full) if full else ())
                    cid = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                    sig = [next(sigs).tobytes() if len(s) else None for s in sets]
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id"), b.column("key"), b.column("n_bytes"), pa.array([len(s) for s in sets], pa.int64()), pa.array(cid, pa.binary()), pa.array(sig, pa.binary())],
                        ["doc_id", "key", "n_bytes", "n_shingles", "cid", "sig"],
                    )

        return self._keyed().mapInArrow(run, "doc_id long, key binary, n_bytes long, n_shingles long, cid binary, sig binary")

    def nodes(self, classes: DataFrame, depth: int, trees: int, full: bool) -> DataFrame:
        """A row for each node of that depth and class in it; full: with all minwise tokens, else with the small ones."""
        import pyarrow as pa

        share = 1 / self.threshold - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for whole in batches:
                for at in range(0, len(whole), 2000):
                    b = whole.slice(at, 2000)
                    sig = _fixed(b.column("sig"), np.uint16, PLACES)
                    nodes, rows = [], []
                    for t in range(trees):
                        row = np.arange(len(sig))
                        node = np.full(len(sig), 0x5851F42D4C957F2D * (t + 1) % 2**64, np.uint64)
                        for _ in range(depth):
                            node, row = branch(node, row, sig, share)
                        nodes.append(node)
                        rows.append(row)
                    row = np.concatenate(rows)
                    held = b.column("sig") if full else pa.array([x.tobytes() for x in small_signature(sig)], pa.binary())
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes).view(np.int64)), b.column("cid").take(take), held.take(take)], ["node", "cid", "sig"])

        return classes.select("cid", "sig").mapInArrow(run, "node long, cid binary, sig binary")

    def node_sizes(self, classes: DataFrame, n: int, depth: int, trees: int) -> DataFrame:
        """node and count of the nodes of more than limit classes; a task adds up before it sends."""
        import pyarrow as pa

        share = 1 / self.threshold - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for whole in batches:
                for at in range(0, len(whole), 2000):
                    sig = _fixed(whole.slice(at, 2000).column("sig"), np.uint16, PLACES)
                    for t in range(trees):
                        row, node = np.arange(len(sig)), np.full(len(sig), 0x5851F42D4C957F2D * (t + 1) % 2**64, np.uint64)
                        for _ in range(depth):
                            node, row = branch(node, row, sig, share)
                        found, n = np.unique(node, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["node", "n"])

        sizes = classes.select("sig").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("count"))
        return written(sizes.where(F.col("count") > self.limit), "dedup-large", n * trees * 2 // self.limit, spread=True)

    def children(self, rows: DataFrame) -> DataFrame:
        """The rows of nodes, with all minwise tokens, one level down."""
        import pyarrow as pa

        share = 1 / self.threshold - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sig = _fixed(b.column("sig"), np.uint16, PLACES)
                node, row = branch(b.column("node").to_numpy().view(np.uint64), np.arange(len(sig)), sig, share)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), b.column("cid").take(take), b.column("sig").take(take)], ["node", "cid", "sig"])

        return rows.select("node", "cid", "sig").mapInArrow(run, "node long, cid binary, sig binary")

    def exhaustive(self, rows: DataFrame) -> DataFrame:
        """Candidate links (a, b) of nodes of bounded size; rows have small signatures."""
        import pyarrow as pa

        cut = self.cut

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def links(node, cid, sig):
                rank = np.array([int.from_bytes(c[:6], "big") for c in cid], np.int64)
                a, b = compare(node, sig, rank, cut)
                pairs = {(cid[i], cid[j]) if cid[i] < cid[j] else (cid[j], cid[i]) for i, j in zip(a.tolist(), b.tolist()) if cid[i] != cid[j]}
                x, y = zip(*pairs) if pairs else ((), ())
                return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["a", "b"])

            release()
            node, cid, sig = np.zeros(0, np.int64), [], np.zeros((0, PLACES // 2), np.uint8)
            for b in batches:
                node = np.concatenate([node, b.column("node").to_numpy()])
                cid += b.column("cid").to_pylist()
                sig = np.concatenate([sig, _fixed(b.column("sig"), np.uint8, PLACES // 2)])
                whole = int(np.searchsorted(node, node[-1])) if len(node) else 0  # the last node may go on
                if whole:
                    yield links(node[:whole], cid[:whole], sig[:whole])
                    node, cid, sig = node[whole:].copy(), cid[whole:], sig[whole:].copy()
            if len(node):
                yield links(node, cid, sig)

        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(n, "node").sortWithinPartitions("node").mapInArrow(run, "a binary, b binary")

    def leaders(self, rows: DataFrame, n: int) -> DataFrame:
        """Each row of large nodes with its links to the node's leaders, and whether it hangs together with the first."""
        import pyarrow as pa

        cut = self.cut
        lot = F.pmod(F.xxhash64(F.lit(3), "cid"), F.lit(8))
        one = rows.groupBy("node", lot.alias("lot")).agg(F.min(F.struct(F.xxhash64(F.lit(4), "cid").alias("h"), "cid", "sig")).alias("x"))
        some = one.groupBy("node").agg(F.sort_array(F.collect_list("x")).alias("leaders"), F.count("*").alias("n"))
        some = written(some.select("node", F.transform("leaders", lambda x: x["cid"]).alias("lead"), F.transform("leaders", lambda x: x["sig"]).alias("lead_sig")), "dedup-leaders", n // self.limit + 1, spread=True)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for b in batches:
                sig = small_signature(_fixed(b.column("sig"), np.uint16, PLACES))
                cid, lead = b.column("cid").to_pylist(), b.column("lead").to_pylist()
                known: dict[tuple, tuple] = {}
                links, alike = [], []
                for i, (c, ids, sigs) in enumerate(zip(cid, lead, b.column("lead_sig").to_pylist())):
                    key = tuple(ids)
                    if key not in known:
                        x = small_signature(np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, PLACES))
                        m, n = np.nonzero(likeness(x[:, None], x[None, :]) >= cut)
                        known[key] = (x, _roots(m, n, len(x)) == 0)
                    x, main = known[key]
                    like = likeness(x, sig[i])
                    near = np.flatnonzero(like >= cut)
                    if c not in key:  # a leader keeps all its links, so that the leaders hang together as they do here
                        firsts, most = near[main[near]][:1], near[np.argsort(-like[near], kind="stable")[:1]]
                        near = np.union1d(firsts, most)
                    links.append([ids[j] for j in near if ids[j] != c])
                    alike.append(bool(main[like >= cut].any()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("node"), b.column("cid"), b.column("sig"), pa.array(links, pa.list_(pa.binary())), pa.array(alike)], ["node", "cid", "sig", "links", "alike"]
                )

        return rows.join(some, "node").mapInArrow(run, "node long, cid binary, sig binary, links array<binary>, alike boolean")

    def cells(self, rows: DataFrame, sizes: DataFrame) -> DataFrame:
        """Rows of large nodes dealt to cells in which each of the rest meets every row; sizes: node, n, rest."""
        n = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / self.limit)).cast("long")
        zero = F.lit(0).cast("long")
        own = lambda seed, c: F.pmod(F.xxhash64(F.lit(seed), "cid"), n(c))
        both = rows.join(sizes, "node")
        every = both.withColumn("i", own(5, "n")).withColumn("j", F.explode(F.sequence(zero, n("rest") - 1)))
        rest = both.where(~F.col("alike")).withColumn("j", own(6, "rest")).withColumn("i", F.explode(F.sequence(zero, n("n") - 1)))
        return every.unionByName(rest).select(F.xxhash64("node", "i", "j").alias("node"), "cid", "sig").dropDuplicates(["node", "cid"])

    def _small(self, rows: DataFrame) -> DataFrame:
        """Rows with all minwise tokens as rows with small signatures."""
        import pyarrow as pa

        def run(batches):
            for b in batches:
                s = small_signature(_fixed(b.column("sig"), np.uint16, PLACES))
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("cid"), pa.array([x.tobytes() for x in s], pa.binary())], ["node", "cid", "sig"])

        return rows.select("node", "cid", "sig").mapInArrow(run, "node long, cid binary, sig binary")

    def shape(self, count: int) -> tuple[int, int]:
        """Depth and number of trees for so many classes; a pair must survive to the deepest level if its nodes are large."""
        depth = self.depth or max(2, round(math.log2(max(count, 2)) / 6))
        return depth, self.trees or math.ceil(math.log(self.missed) / math.log(1 - survival(self.threshold, depth + self.deeper)))

    def candidates(self, classes: DataFrame) -> DataFrame:
        """Distinct candidate links between classes."""
        n = classes.count()
        depth, trees = self.shape(n)
        total = lambda large: large.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        large = self.node_sizes(classes, n, depth, trees)
        held = total(large)
        rows = self.nodes(classes, depth, trees, False)
        compared = [rows.join(large, "node", "left_anti") if held else rows]
        found: list[DataFrame] = []
        hot = self.nodes(classes, depth, trees, True).join(large, "node", "left_semi") if held else None
        for level in range(self.deeper + 1):
            if not held:
                break
            hot = written(hot, "dedup-hot", held, 20_000, spread=True)
            hot = written(self.leaders(hot, held), "dedup-led", held, 20_000, spread=True)
            found.append(hot.select(F.col("cid").alias("a"), F.explode("links").alias("b")))
            rest = hot.groupBy("node").agg(F.count("*").alias("n"), F.count_if(~F.col("alike")).alias("rest")).where("rest > 0")
            rest = written(rest, "dedup-rest", held // self.limit + 1, spread=True)
            last = level == self.deeper
            compared.append(self._small(self.cells(hot, rest if last else rest.where(F.col("rest") <= self.limit))))
            if last:
                break
            down = self.children(hot.join(rest.where(F.col("rest") > self.limit), "node", "left_semi"))
            down = written(down, "dedup-down", held, 20_000, spread=True)
            large = down.groupBy("node").count().where(F.col("count") > self.limit)
            large = written(large, "dedup-large", held // self.limit + 1, spread=True)
            compared.append(self._small(down.join(large, "node", "left_anti")))
            hot, held = down.join(large, "node", "left_semi"), total(large)
        everything = compared[0]
        for more in compared[1:]:
            everything = everything.unionByName(more)
        links = self.exhaustive(everything)
        for more in found:
            links = links.unionByName(more)
        return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()

    def sets(self, links: DataFrame, classes: DataFrame) -> DataFrame:
        """cid and items, the full set, of each class that has a candidate link."""
        import pyarrow as pa

        words = self.words
        members = written(links.select(F.col("a").alias("cid")).union(links.select("b")).distinct(), "dedup-members", links.count(), 50_000)
        wanted = classes.join(members, "cid", "left_semi").select("key", "cid")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release("words")
            for whole in batches:
                for at in range(0, len(whole), 200):
                    b = whole.slice(at, 200)
                    sets = [shingles(t, words).view(np.int64) for t in b.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(sets, pa.list_(pa.int64()))], ["cid", "items"])

        texts = self._keyed().select("key", "text").join(wanted, "key").dropDuplicates(["cid"])
        items = texts.select("cid", "text").mapInArrow(run, "cid binary, items array<bigint>")
        return written(items, "dedup-sets", members.count(), 4_000)

    def confirmed(self, links: DataFrame, sets: DataFrame) -> DataFrame:
        """The links whose full sets are similar enough."""
        one = links.join(sets.select(F.col("cid").alias("a"), F.col("items").alias("x")), "a")
        both = one.join(sets.select(F.col("cid").alias("b"), F.col("items").alias("y")), "b")
        common = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("i"), (F.size("x") + F.size("y")).cast("long").alias("n"))
        return common.where(F.col("i") * 100 >= (F.col("n") - F.col("i")) * self.percent).select("a", "b")

    def remaining(self, links: DataFrame, sure: DataFrame, sets: DataFrame, cell: int = 256) -> DataFrame:
        """Confirmed links between the parts that confirmed links (sure) leave of what the candidates connect."""
        import pyarrow as pa

        percent = self.percent
        named = lambda d, n: components(d.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("u").alias("cid"), F.col("root").alias(n))
        group = named(links, "k").join(named(sure, "g"), "cid", "left").withColumn("g", F.coalesce("g", "cid"))
        group = written(group, "dedup-parts", links.count(), 50_000)
        parts = group.groupBy("k", "g").agg(F.count("*").alias("n"))
        whole = parts.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.max(F.struct("n", "g")).alias("main"))
        tried = links.join(group.select(F.col("cid").alias("a"), "k"), "a").groupBy("k").agg(F.count("*").alias("tried"))
        left = whole.where("parts > 1").join(tried, "k").where("tried < n * (n - 1) / 2")
        left = written(left.select("k", "n", F.col("main.g").alias("main"), (F.col("n") - F.col("main.n")).alias("rest")), "dedup-left", group.count(), spread=True)
        if not left.take(1):
            return sure.limit(0)
        zero = F.lit(0).cast("long")
        number = lambda c: F.ceil(F.col(c) / cell).cast("long")
        own = lambda seed, c: F.pmod(F.xxhash64(F.lit(seed), "cid"), number(c))
        both = group.join(left, "k")
        every = both.withColumn("i", own(8, "n")).withColumn("j", F.explode(F.sequence(zero, number("rest") - 1))).withColumn("side", F.lit(0))
        rest = both.where("g <> main").withColumn("j", own(9, "rest")).withColumn("i", F.explode(F.sequence(zero, number("n") - 1))).withColumn("side", F.lit(1))
        rows = every.unionByName(rest).select("k", "i", "j", "side", "cid", "g").join(sets, "cid")

        def run(t: pa.Table) -> pa.Table:
            cid, g = t.column("cid").to_pylist(), t.column("g").to_pylist()
            items = [np.asarray(x, np.int64) for x in t.column("items").combine_chunks().to_numpy(zero_copy_only=False)]
            side = t.column("side").to_numpy()
            all_of, some = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            out: list[tuple] = []
            root: dict[bytes, bytes] = {}

            def find(x: bytes) -> bytes:
                while (y := root.get(x, x)) != x:
                    x = y
                return x

            ends = np.cumsum([len(items[i]) for i in all_of]) // (1 << 18) if len(all_of) and len(some) else np.zeros(0, int)
            for part in np.split(all_of, np.flatnonzero(np.diff(ends)) + 1) if len(ends) else ():  # so many items at once
                flat = np.concatenate([items[i] for i in part])
                sizes = np.array([len(items[i]) for i in part])
                starts = np.cumsum(sizes) - sizes
                for r in some.tolist():
                    x = np.sort(items[r])
                    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
                    common = np.add.reduceat((x[at] == flat).astype(np.int64), starts)
                    for e in np.flatnonzero(common * 100 >= percent * (sizes + len(x) - common)).tolist():
                        p, q = find(g[r]), find(g[part[e]])
                        if p != q:
                            root[p] = q
                            out.append((cid[r], cid[part[e]]))
            a, b = zip(*out) if out else ((), ())
            return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

        return rows.groupBy("k", "i", "j").applyInArrow(run, "a binary, b binary")

    def groups(self) -> tuple[DataFrame, DataFrame]:
        """The rows' sets, and for each class its component, links, first row (key) and whether that names the component."""
        docs = written(self.documents(), "dedup-docs", self.docs.count(), 25_000, spread=True)
        full = docs.where(F.col("cid").isNotNull())
        largest = F.lit(2**63 - 1)
        first = F.min(F.struct(F.coalesce("doc_id", largest).alias("id"), "key"))
        classes = full.groupBy("cid").agg(F.min("doc_id").alias("first_id"), first.alias("first"), F.max("sig").alias("sig"))
        classes = written(classes.select("cid", "first_id", F.col("first.key").alias("key"), "sig"), "dedup-classes", docs.count(), 8_000, spread=True)
        count = classes.count()
        links = written(self.candidates(classes), "dedup-candidates", 2 * count, 25_000, spread=True)
        sets = self.sets(links, classes)
        sure = written(self.confirmed(links, sets), "dedup-links", links.count(), 10_000)
        more = written(self.remaining(links, sure, sets), "dedup-more-links", count, spread=True)
        links = sure.unionByName(more)
        vertex = classes.select("cid", F.struct(F.coalesce("first_id", largest).alias("id"), "cid").alias("v"))
        ends = links.join(vertex.select(F.col("cid").alias("a"), F.col("v").alias("u")), "a").join(vertex.select(F.col("cid").alias("b"), "v"), "b").select("u", "v")
        roots = components(ends).select(F.col("u.cid").alias("cid"), "root")
        named = classes.select("cid", "first_id", "key").join(roots, "cid", "left")
        named = named.select(
            "cid", "key",
            F.coalesce(F.when(F.col("root.id") < largest, F.col("root.id")), "first_id").alias("component_id"),
            (F.col("root").isNull() | (F.col("root.cid") == F.col("cid"))).alias("names"),
        )
        return docs, written(named, "dedup-named", count)

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id and kept of every row."""
        docs, named = self.groups()
        linked = docs.where(F.col("cid").isNotNull()).select("doc_id", "n_shingles", "cid").join(named, "cid")
        bare = docs.where(F.col("cid").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        out = linked.select("doc_id", "n_shingles", "component_id").unionByName(bare)
        out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
        return out.coalesce(files_for(docs.count(), 25_000))

    def survivors(self, file_bytes: int = 16 << 20) -> DataFrame:
        """The rows of the table, one of each group: the first of the class that names it; of rows equal in id and text
        the one whose other columns have the smallest hash.  Rows without words all stay."""
        docs, named = self.groups()
        row, key, tie = (free_name(self.docs.columns, c) for c in ("row", "key", "tie"))
        keys = named.where("names").select(F.col("key").alias(key))
        text = whole_text(self.docs)
        has_words = text.rlike(r"[^\x20\x09-\x0D]")
        names = [F.col(f"`{c}`") for c in self.docs.columns]
        keyed = self.docs.where(has_words).select(F.struct(*names).alias(row), row_key(F.col("doc_id").cast("long"), text).alias(key), F.xxhash64(*names).alias(tie))
        one = keyed.join(keys, key, "left_semi").groupBy(key).agg(F.min_by(row, tie).alias(row)).select(f"{row}.*")
        size = docs.join(named.where("names").select("key"), "key", "left_semi").agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
        one = one.coalesce(max(1, -(-size // file_bytes)))  # files of about so much text, whatever the number of partitions
        return one.unionByName(self.docs.where(~has_words).coalesce(files_for(docs.where("cid IS NULL").count(), 100_000)))


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that tell a row's id and text."""
    return F.unhex(F.md5(F.concat_ws("\n", F.coalesce(doc_id.cast("string"), F.lit("")), text).cast("binary")))


def components(links: DataFrame) -> DataFrame:
    """For each end u of a link (u, v) the smallest vertex it reaches; large-star and small-star rounds until they
    change nothing."""
    both = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    n = both.count()
    edges = written(both.distinct(), "components", n, 50_000)
    mark = None

    def lows(both: DataFrame) -> DataFrame:
        return both.groupBy("u").agg(F.min("v").alias("m"))

    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40)), F.bit_xor(F.xxhash64("u", "v"))).first()
        n = now[0]
        if now == mark:
            return edges.select("u", F.col("v").alias("root")).union(edges.select(F.col("v").alias("u"), F.col("v").alias("root"))).distinct()
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = lows(both)
        own = low.select("u", F.least("u", "m").alias("m"))
        large = written(both.join(own, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "components", n, 50_000)
        forget(edges)
        low = lows(large)
        pulled = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(pulled.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "components", n, 50_000)
        forget(large)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, **more) -> DataFrame:
    return NearDuplicates(docs, words, percent, **more).result()


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group; see NearDuplicates.survivors."""
    return NearDuplicates(docs, words, percent).survivors()


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2, percent=80)
