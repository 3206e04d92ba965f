"""Conversation repair against all edits of short conversations, and the SQL of the query."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb

from concordia.llm import conversations as C
from concordia.llm.queries import REPAIR_SQL
from tests.llm.corpus import SMALL

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def ordered(rows):
    return sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(WHITE)
        out.append("b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(rows, most_inserts=2):
    """By trying every edit of every row, and up to two inserted rows in every gap."""
    found = faults(rows)
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(f in ("b", "d") and e != "D" for f, e in zip(found, edits)):
            continue
        base = sum({"D": 3, "K": 0, "R": 2}[e] + (f == "t" and e != "D") for f, e in zip(found, edits))
        for gaps in itertools.product(range(most_inserts + 1), repeat=len(rows) + 1):
            cost = base + 2 * sum(gaps)
            audit = "".join("I" * n + e for n, e in zip(gaps, (*edits, "")))
            if best is not None and (cost, audit) >= best[:2]:
                continue
            slots = [None if e in "IR" else rows[k] for e, k in kept_slots(audit)]
            for fill in itertools.product(("user", "assistant"), repeat=sum(s is None for s in slots)):
                names = iter(fill)
                made = [next(names) if s is None else s[1] for s in slots]
                if re.fullmatch("(s?(ua)+)?", "".join(m[:1] or "-" for m in made)):
                    texts = ["" if e == "I" else rows[k][2] for e, k in kept_slots(audit)]
                    best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in zip(made, texts)))
                    break
    return best


def kept_slots(audit):
    k = 0
    for e in audit:
        if e != "D":
            yield e, k
        k += e != "I"


def expected(rows):
    rows = ordered(rows)
    f, turns = faults(rows), [t for t, _, _ in rows if t is not None]
    cost, audit, text = cheapest(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, f.count("b"), f.count("d"), f.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def sample(n, seed=3):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "umpire"], ["Hi.", "Hi.", "Yes!", "no end", " \t", "", None, "So?\n", "é."]
    return {c: [(rng.choice([0, 1, 2, 3, 9, None]), rng.choices(roles, [5, 5, 2, 1, 1, 1, 1])[0], rng.choice(texts)) for _ in range(rng.randrange(1, 5))] for c in range(n)}


def test_against_every_edit(spark):
    convs = sample(120)
    df = spark.createDataFrame([(c, *r) for c, rows in convs.items() for r in rows], SCHEMA)
    want = {c: expected(rows) for c, rows in convs.items()}
    assert got(C.repair(df)) == want
    assert got(C.repair(df.repartition(3), batch_rows=5, segment=2)) == want  # cut into segments and batches


def test_long_conversations_are_cut(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "b", " ", f"{t}?", f"{t}!"])) for c in (1, 2) for t in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = got(C.repair(df, segment=10_000))
    assert whole == got(C.repair(df)) == got(C.repair(df, batch_rows=1000, segment=7))


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, None, "user", "x" * 300_000 + "."), (1, 0, "user", "A."), (1, 0, "user", "A."), (2, 5, "assistant", "\x1c"), (3, -2, "system", "S."), (3, 9, "user", "U.")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {c: expected([r[1:] for r in rows if r[0] == c]) for c in (None, 1, 2, 3)}
    assert got(C.repair(df.selectExpr("*", "1 AS seg", "2 AS first", "'x' AS dup", "3 AS __kind"))) == want
    assert got(C.repair(df.limit(0))) == {} == got(C.repair(C.damaged(df.limit(0))))


def test_damage(spark):
    convs = sample(60, 5) | {None: [(None, "user", None)], 1000: [(t, "system", "a.b!c?") for t in range(60)]}
    df = spark.createDataFrame([(c, *r) for c, rows in convs.items() for r in rows], SCHEMA)
    want = {}
    for c, rows in convs.items():
        for t, role, text in rows:
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            role, text = "user" if kind == 4 else " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            want.setdefault(c, []).extend([(t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    d = C.damaged(df.withColumn("gone", C.F.lit(7)))
    have = {}
    for r in d.collect():
        have.setdefault(r.conv_id, []).extend([] if r.gone else [(r.turn, r.role, r.text)])
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert {c: sorted(v, key=key) for c, v in have.items()} == {c: sorted(v, key=key) for c, v in want.items()}
    out = got(C.repair(d))
    assert set(out) == set(convs)
    for c, rows in want.items():
        if not rows:
            assert out[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        elif len(rows) < 5:
            assert out[c] == expected(rows)


def test_query_gives_the_rows_of_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    want = {r[0]: r[1:] for r in con.execute(REPAIR_SQL).fetchall()}
    assert got(C.op12_conversation_repair(spark, SMALL)) == want and len(want) > 10
