"""Operator 12: conversations repaired to a grammar of roles at least cost, by a recursive DuckDB query in each batch.

A conversation's rows are taken by turn (nulls first); rows of one turn in the order of role and text.  The first fault of
a row counts: blank (nothing but white space), duplicate (its role and text were seen earlier in the conversation),
truncated (its last character that is no white space is none of . ! ?).  Rows are kept (0), given the role of the user or
the assistant (2) or deleted (3, and blank and duplicate ones always), empty rows of either are inserted anywhere (2), and
a truncated row that stays costs 1 more.  The repaired roles' initials match (s?(ua)+)?; among repairs of least cost the
one whose edits' initials (D, I, K, R) come first is taken.  From any state of the grammar there is one role that may be
inserted or given, so the initials say which it is.

Rows are hash-partitioned by conversation and sorted within partitions by Spark, which also finds duplicates, by windows
over the same partitioning: one shuffle.  A task streams its conversations in batches of bounded rows and bytes.  In a
batch every conversation is cut into segments of at most SEGMENT rows, and one recursive query advances one turn of all
segments at a time, keeping the least cost and audit for each grammar state at the segment's start and each it may be in
now.  Segments are then joined in order; a conversation longer than a batch carries four states, their audits and their
hashes to the next one.  So a conversation with a large share of all rows takes memory for its audit alone, though its
hash and audit, being one sequence, are made by one task.

Null roles and texts count as one space, null ids are one conversation, null turns come first.  A conversation without
rows (all dropped by the damage) has zeros, an empty audit and the hash of the empty text.  Repeated rows are duplicates.
Texts of any length are taken whole.  Columns but the four are not read, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia.llm.common import table

SEGMENT = 64
BATCH_ROWS, BATCH_CHARS = 20_000, 8_000_000

# States of the grammar: nothing yet, after the system, after the user, after the assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row of the user or the assistant that is inserted or given its role, by the state before it.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: What makes a repair whole from each state: inserted rows.
ENDS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows as a hash of conv_id and turn damages them; dropped ones are marked gone."""
    c = conversations.select(*(conversations[x].alias(x) for x in ("conv_id", "turn", "role", "text")))
    some = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    c = c.withColumn("__kind", F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20)
    kind = F.col("__kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return c.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(some("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), copies.alias("__copy")).drop("__copy")


def numbered(turns: DataFrame) -> DataFrame:
    """The rows by conversation in order, gone ones last, with what the rows before them tell: first, dup, the role's
    initial before, and whether the turn is a new one."""
    gone = turns["gone"] if "gone" in turns.columns else F.lit(False)
    some = lambda x: F.coalesce(turns[x].cast("string"), F.lit(" ")).alias(x)
    t = turns.select(turns["conv_id"].alias("conv_id"), turns["turn"].cast("long").alias("turn"), some("role"), some("text"), gone.alias("gone"))
    t = t.repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "text").orderBy("gone", F.asc_nulls_first("turn"))
    order = Window.partitionBy("conv_id").orderBy("gone", F.asc_nulls_first("turn"), "role", "text", "dup")
    t = t.withColumn("dup", F.row_number().over(same) > 1)
    before: Column = F.lag("turn").over(order)
    return t.select(
        "conv_id", "role", "text", "gone", "dup", "turn", (F.row_number().over(order) == 1).alias("first"),
        F.lag(F.substring("role", 1, 1)).over(order).alias("before"), (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(before)).alias("fresh"),
    )


def steps() -> list[tuple[str, int, int, int, str]]:
    """(class of row, state before, state after, cost, audit): the best way over one row between each two states.

    A class is the role's initial, or x, and what the row's fault asks: - (nothing), t (truncated), d (must be deleted).
    """
    best = {}
    for initial in "suax":
        for fault in "-td":
            for start in NEXT:
                state, lead = start, ""
                for _ in range(4):  # rows inserted before it: more would only come back to a state
                    extra = fault == "t"
                    ways = [(state, 3, "D")]
                    if fault != "d":
                        ways.append((NEXT[state], 2 + extra, "R"))
                        if (state, initial) in KEEP:
                            ways.append((KEEP[state, initial], extra, "K"))
                    for to, cost, edit in ways:
                        key, way = (initial + fault, start, to), (cost + 2 * len(lead), lead + edit)
                        best[key] = min(best.get(key, way), way)
                    state, lead = NEXT[state], lead + "I"
    return [(*k, *w) for k, w in best.items()]


#: One class for each row; white space is what the faults take for it.
ROWS = r"""CREATE OR REPLACE TEMP TABLE marked AS SELECT *, left(role, 1) AS initial, CASE WHEN body = '' THEN 'b' WHEN dup THEN 'd'
WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM batch WHERE NOT gone)"""
COUNTS = """SELECT run, min(turn) AS least, max(turn) AS most, count(*) FILTER (fresh) AS turns, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY run"""
#: Each recursion takes one more turn of every segment; a state keeps its least cost and, among equals, least audit.
PATHS = """WITH RECURSIVE r AS (SELECT seg, i, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'x' END || CASE WHEN fault IN ('b', 'd') THEN 'd' ELSE fault END AS kind FROM marked),
n AS (SELECT seg, max(i) AS n FROM r GROUP BY seg),
dp(seg, i, origin, state, cost, audit) AS (SELECT seg, 0, s, s, CAST(0 AS BIGINT), '' FROM n JOIN opened USING (seg), range(4) t(s) WHERE s = 0 OR NOT opening
UNION ALL SELECT seg, i, origin, state, min(cost), arg_min(audit, struct_pack(c := cost, a := audit)) FROM (
SELECT dp.seg, r.i, dp.origin, s.after AS state, dp.cost + s.cost AS cost, dp.audit || s.audit AS audit
FROM dp JOIN r ON r.seg = dp.seg AND r.i = dp.i + 1 JOIN steps s ON s.kind = r.kind AND s.state = dp.state) GROUP BY seg, i, origin, state)
SELECT dp.seg, origin, state, cost, audit FROM dp JOIN n ON n.seg = dp.seg AND n.n = dp.i ORDER BY dp.seg"""


def lines(audit: str, state: int, rows: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired rows that an audit makes of rows (role, text), from a state on."""
    at = iter(rows)
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            yield ROLE[state], ""
            continue
        role, text = next(at)
        if edit == "R":
            state = NEXT[state]
            yield ROLE[state], text
        elif edit == "K":
            state = KEEP[state, role[:1]]
            yield role, text


class _Open:
    """A conversation that is being read: counts, and of each state the cost, audit and hash of the best way to it."""

    def __init__(self, conv_id):
        self.conv_id, self.blank, self.duplicate, self.truncated, self.illegal, self.turns = conv_id, 0, 0, 0, 0, 0
        self.least = self.most = None
        self.ways = {START: (0, "", hashlib.sha256(), False)}

    def count(self, c: dict) -> None:
        for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, k, getattr(self, k) + c[k])
        if c["least"] is not None:
            self.least = c["least"] if self.least is None else min(self.least, c["least"])
            self.most = c["most"] if self.most is None else max(self.most, c["most"])

    @staticmethod
    def _written(sha, some: bool, made: Iterator[tuple[str, str]]) -> bool:
        for role, text in made:
            sha.update(f"{chr(10) if some else ''}{role}:{text}".encode())
            some = True
        return some

    def advance(self, paths: list[tuple], rows: list[tuple[str, str]]) -> None:
        best = {}
        for origin, state, cost, audit in paths:
            if origin in self.ways:
                c, a, _, _ = self.ways[origin]
                way = (c + cost, a + audit, origin, audit)
                best[state] = min(best.get(state, way), way)
        made = {}
        for state, (cost, whole, origin, audit) in best.items():
            sha = self.ways[origin][2].copy()
            made[state] = (cost, whole, sha, self._written(sha, self.ways[origin][3], lines(audit, origin, rows)))
        self.ways = made

    def close(self) -> tuple:
        cost, audit, state = min((c + 2 * len(ENDS[s]), a + ENDS[s], s) for s, (c, a, _, _) in self.ways.items())
        sha, some = self.ways[state][2].copy(), self.ways[state][3]
        self._written(sha, some, lines(ENDS[state], state, []))
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, sha.hexdigest()


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair(turns: DataFrame, batch_rows: int = BATCH_ROWS, segment: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of turns
    (conv_id, turn, role, text, and gone, if rows are marked so)."""
    import pyarrow as pa

    rows = numbered(turns)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def connect():
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})  # batches are bounded: nothing spills
        con.execute("CREATE TABLE steps (kind VARCHAR, state INT, after INT, cost BIGINT, audit VARCHAR)")
        con.executemany("INSERT INTO steps VALUES (?, ?, ?, ?, ?)", steps())
        return con

    def results(con, batch: pa.Table, open_: _Open | None) -> Iterator[_Open]:
        """The conversations of the batch in order, the one that was open first; the last may go on."""
        first = batch.column("first").to_pylist()
        gone = batch.column("gone").to_pylist()
        ids = batch.column("conv_id").to_pylist()
        roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
        runs, segs, at, opening, members = [], [], [], [], []
        run, seg, i = -1 if open_ is None else 0, -1, segment
        held: dict[int, list[int]] = {} if open_ is None else {0: []}
        begins = {}
        for k, f in enumerate(first):
            if f:
                run += 1
                held[run], begins[run] = [], ids[k]
            if not gone[k] and (f or i >= segment or (k == 0)):
                seg, i = seg + 1, 0
                held[run].append(seg)
                opening.append(f)
                members.append([])
            if not gone[k]:
                i += 1
                members[seg].append((roles[k], texts[k]))
            runs.append(run)
            segs.append(seg)
            at.append(i)
        t = batch.append_column("run", pa.array(runs, pa.int32())).append_column("seg", pa.array(segs, pa.int32())).append_column("i", pa.array(at, pa.int32()))
        con.register("batch", t)
        con.register("opened", pa.table({"seg": pa.array(range(len(opening)), pa.int32()), "opening": pa.array(opening, pa.bool_())}))
        con.execute(ROWS)
        counts = {c["run"]: c for c in con.sql(COUNTS).to_arrow_table().to_pylist()}
        paths: dict[int, list] = {}
        for s, *way in con.execute(PATHS).fetchall():
            paths.setdefault(s, []).append(tuple(way))
        con.unregister("batch")
        con.unregister("opened")
        for r, own in held.items():
            if r in begins:
                open_ = _Open(begins[r])
            if r in counts:
                open_.count(counts[r])
            for s in own:
                open_.advance(paths[s], members[s])
            yield open_

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n, size = [], 0, 0
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                held.append(part)
                n, size = n + part.num_rows, size + part.get_total_buffer_size() * part.num_rows // max(1, b.num_rows)
                if n >= batch_rows or size >= BATCH_CHARS:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, n, size = [], 0, 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, open_, done, kinds = None, None, [], None

        def out():
            cols = list(zip(*done)) if done else [()] * len(NAMES)
            types = [kinds, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], list(NAMES))

        for batch in batched(batches):
            con = con or connect()
            kinds = batch.schema.field("conv_id").type
            for c in results(con, batch, open_):
                if open_ is not None and c is not open_:
                    done.append(open_.close())
                open_ = c
            if done:
                yield out()
                done = []
        if open_ is not None:
            done.append(open_.close())
            yield out()

    return rows.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
