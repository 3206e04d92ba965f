"""Operator 4: secret scans through a trigram index, in DataFrame functions only.

Each rule is a regular expression.  From its syntax tree a Boolean query over trigrams is derived that every match
satisfies.  The index has a posting for each trigram that some query names and each text that contains it
(lower-cased).  Postings are kept as bitmaps, a bit for each trigram, beside the text that they belong to: a query's
intersections and unions are then bit operations in the row, and neither texts nor postings move.  A rule's candidates
are the texts that its query admits; only they are verified with the expression itself.  A rule without mandatory
trigrams has no query and scans every text.

Spans are code points, end exclusive; of each kind the leftmost matches that don't overlap.  Null text is empty and
has no span.  Rows are kept as they are, repeated ones and null ids included, with all their columns; a column that has
the name of the result is replaced by it, and no other name is taken.  An empty table gives an empty result.

Expressions run in linear time on texts of any length: none repeats a group without end, which would recurse once a
repetition in Java's matcher, and those that begin with a run of characters read each run once, from its first
character on (by a look-behind and an atomic group).

The syntax tree comes from the parser of Python's re, whose modules have underscored names; tests hold the queries
derived from it, so that a change there can't pass unseen.
"""

from __future__ import annotations

import functools
import re._constants as rc
import re._parser as rp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.common import free_name, table, whole_text


@dataclass(frozen=True)
class Rule:
    """A match counts where its group has at least so many characters.

    suffix: the span is this group, which ends where the match ends, instead of the whole match.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    suffix: int = 0


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment_key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("maps_key", r"AIza[A-Za-z0-9_-]{35}"),
    # From the first eyJ of a run: a later one of the same run has the same rest and less before it.
    Rule("web_token", r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", suffix=1),
    # Words of A-Z with one blank after each.
    Rule("private_key", r"-----BEGIN (?![A-Z ]*  )(?:[A-Z][A-Z ]* )?PRIVATE KEY-----"),
    # From the first letter of a run of a scheme's characters.
    Rule("url_login", r"(?<![a-z0-9+.-])(?>[0-9+.-]*)([a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s:/@]+@)", suffix=1),
)
RULES = BASE + MORE

SPANS = "CAST(array() AS array<struct<start:int,end:int,order:int,kind:string>>)"
#: Sets of strings beyond so many are no longer spelt out.
SPELT = 64


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _query_of(strings: set[str]) -> frozenset[frozenset[str]] | None:
    """Any of the strings: a disjunction of conjunctions of trigrams; None if a string is too short to say."""
    if not strings or any(len(s) < 3 for s in strings):
        return None
    all_of = {_trigrams(s) for s in strings}
    return frozenset(a for a in all_of if not any(b < a for b in all_of))


def _walk(items, before: frozenset[str] = frozenset({""})) -> tuple[set[str] | None, list]:
    """The strings that a sequence spells exactly after those before it, if few, and the queries that its parts demand."""
    spelt: set[str] | None = set(before)
    run: set[str] = set(before)
    demands: list = []

    def flush(after: set[str] = frozenset({""})) -> None:
        nonlocal run
        if q := _query_of(run):
            demands.append(q)
        run = set(after)

    for op, arg in items:
        if op is rc.BRANCH:  # what stands before the branch belongs to each of its alternatives
            exact, inner = _branch(arg[1], frozenset(run))
            longer = exact
        else:
            exact, inner = _item(op, arg)
            longer = exact if exact is None else {a + b for a in run for b in exact}
        demands += inner
        if exact is None:
            spelt = None
            flush()
            continue
        if len(longer) <= SPELT:
            run = longer
        else:
            spelt = None
            flush(exact)
        if spelt is not None:
            spelt = set(run)
    if spelt is None:
        flush()
    return spelt, demands


def _branch(alternatives, before: frozenset[str]) -> tuple[set[str] | None, list]:
    """The strings of alternatives after those before them, if all are spelt exactly; else one query, which holds for
    any of them: of each alternative the demand of most trigrams."""
    found = [_walk(b, before) for b in alternatives]
    if all(s is not None for s, _ in found) and len(all_of := set().union(*(s for s, _ in found))) <= SPELT:
        return all_of, []
    options = []
    for s, demands in found:
        q = _query_of(s) if s is not None else max(reversed(demands), key=lambda d: min(map(len, d)), default=None)
        if q is None:
            return None, []
        options.append(q)
    return None, [frozenset().union(*options)]


def _item(op, arg) -> tuple[set[str] | None, list]:
    if op is rc.LITERAL:
        return {chr(arg).lower()}, []
    if op is rc.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is rc.LITERAL:
                chars.add(chr(x).lower())
            elif kind is rc.RANGE and x[1] - x[0] < 8:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, []
        return (chars, []) if len(chars) <= 8 else (None, [])
    if op is rc.SUBPATTERN:
        return _walk(arg[-1])
    if op is rc.ATOMIC_GROUP:
        return _walk(arg)
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
        low, high, inner = arg
        s, demands = _walk(inner)
        if (low, high) == (0, 1) and s is not None and len(s) < SPELT:
            return s | {""}, []
        if low == high and s is not None:
            out = {""}
            for _ in range(low):
                out = {a + b for a in out for b in s}
                if len(out) > SPELT:
                    return None, demands
            return out, []
        return None, demands if low else []
    if op is rc.AT or op in (rc.ASSERT, rc.ASSERT_NOT):
        return {""}, []
    return None, []


@functools.cache
def trigram_query(pattern: str) -> tuple[frozenset[frozenset[str]], ...]:
    """A conjunction of disjunctions of conjunctions of lower-case trigrams; empty if nothing is mandatory."""
    spelt, demands = _walk(rp.parse(pattern))
    if spelt is not None and (q := _query_of(spelt)):
        demands.append(q)
    return tuple(demands)


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The trigrams that the rules' queries name."""
    return sorted({t for r in rules for any_of in trigram_query(r.pattern) for all_of in any_of for t in all_of})


BITS = 62  # of a long


def postings(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text's postings, as bitmaps of the vocabulary's trigrams: an array of longs."""
    known = vocabulary(rules)
    bits = lambda low, part: functools.reduce(
        Column.__add__, (F.when(F.contains(low, F.lit(t)), F.lit(1 << i)).otherwise(F.lit(0).cast("long")) for i, t in enumerate(part)), F.lit(0).cast("long")
    )
    maps = F.transform(F.array(F.lower(text)), lambda low: F.array(*(bits(low, known[a : a + BITS]) for a in range(0, max(1, len(known)), BITS))))
    return F.get(maps, F.lit(0))  # the lower-cased text is made once


def admitted(maps: Column, rule: Rule, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether the rule's query holds on a text's postings; true for a rule without a query."""
    at = {t: i for i, t in enumerate(vocabulary(rules))}

    def has_all(trigrams: frozenset[str]) -> Column:
        need: dict[int, int] = {}
        for t in trigrams:
            need[at[t] // BITS] = need.get(at[t] // BITS, 0) | 1 << at[t] % BITS
        return functools.reduce(Column.__and__, (F.get(maps, F.lit(w)).bitwiseAND(F.lit(m)) == F.lit(m) for w, m in sorted(need.items())))

    return functools.reduce(Column.__and__, (functools.reduce(Column.__or__, map(has_all, sorted(any_of, key=sorted))) for any_of in trigram_query(rule.pattern)), F.lit(True))


def scanned(items: Column, step, none: str, part: int = 512) -> Column:
    """What step appends, from the first item to the last; step takes (at, out) and an item and gives the next (at, out).

    The items go in parts, and a part's output is appended at once, as an array that grows by one item at a time is
    copied each time: a text may hold hundreds of thousands of spans.
    """
    fresh = lambda at: F.struct(at.alias("at"), F.expr(none).alias("out"))

    def parts(own: Column) -> Column:
        last = F.greatest(F.ceil(F.size(own) / F.lit(part)) - 1, F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda p: F.slice(own, p * part + 1, part))

    def whole(acc: Column, own: Column) -> Column:
        done = F.transform(F.array(F.aggregate(own, fresh(acc["at"]), step)), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], r["out"]).alias("out")))
        return F.get(done, F.lit(0))

    named = F.transform(F.array(items), lambda own: F.aggregate(parts(own), fresh(F.lit(0)), whole))  # the items are made once
    return F.get(named, F.lit(0))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans in the text, from what matches and what lies between the matches."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    own = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.suffix)) if rule.suffix else found
    sizes = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p)).alias("gap"),
        F.transform(found, lambda m: F.length(m)).alias("size"),
        F.transform(held, lambda m: F.length(m)).alias("held"),
        F.transform(own, lambda m: F.length(m)).alias("own"),
    )

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))
        span = F.struct((end - x["own"]).alias("start"), end.alias("end"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(F.coalesce(x["held"], F.lit(-1)) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return scanned(sizes, step, SPANS)["out"]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """docs with an array of (start, end, order, kind), by start and then by the rules' order."""
    text, maps = free_name(docs.columns, "secret_text"), free_name(docs.columns, "secret_postings")
    indexed = docs.withColumn(text, whole_text(docs, text_col)).withColumn(maps, postings(F.col(text), rules))
    none = F.expr(SPANS)
    parts = []
    for i, r in enumerate(rules):
        wanted = admitted(F.col(maps), r, rules) & F.col(text).rlike(r.pattern)
        parts.append(F.when(wanted, _spans(F.col(text), r, i)).otherwise(none))
    order = lambda a, b: F.when(F.struct(a["start"], a["order"]) < F.struct(b["start"], b["order"]), -1).otherwise(1)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()]
    return indexed.select(*kept, F.array_sort(F.concat(*parts), order).alias(out))


def described(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by the mark, overlapping ones by one mark; a null text stays null."""
    text = F.col("text")
    spans = free_name(docs.columns, "spans")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.array(F.struct(acc["at"].alias("start"), s["start"].alias("end")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    found = find_secrets(docs, rules, out=spans)
    kept = scanned(F.col(spans), step, "CAST(array() AS array<struct<start:int,end:int>>)")

    def cut(k: Column) -> Column:
        # A place in a text is found by counting from the text's start, so pieces are cut from parts of it.
        last = F.greatest(F.ceil(F.size(k["out"]) / F.lit(256)) - 1, F.lit(0)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda p: F.slice(k["out"], p * 256 + 1, 256))
        named = F.transform(parts, lambda p: F.struct(p.alias("p"), p[0]["start"].alias("at"), F.substring(text, p[0]["start"] + 1, F.element_at(p, -1)["end"] - p[0]["start"]).alias("own")))
        marked = F.transform(named, lambda x: F.array_join(F.transform(x["p"], lambda p: F.concat(F.substring(x["own"], p["start"] - x["at"] + 1, p["end"] - p["start"]), F.lit(mark))), ""))
        return F.concat(F.array_join(marked, ""), F.substring(text, k["at"] + 1, F.length(text)))

    clean = F.get(F.transform(F.array(kept), cut), F.lit(0))
    out = found.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(text)).drop(spans)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["order"] < len(BASE))
    count = lambda i: F.size(F.filter("secrets", lambda s: s["order"] == i)).cast("long")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)),
        F.sha2(described(base).cast("binary"), 256).alias("base_sha256"),
        described(F.col("secrets")).alias("spans"),
    )
