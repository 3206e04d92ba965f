"""Text functions on columns: folding, stripping, cleaning.  All are built-in expressions."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.functions.loops import cut_loops

#: White space as the strip of a reader's value takes it.
SPACE = r"(?U)[\s\x1c-\x1f]"


HANGUL = (0xAC00, 0xD7A3)


@functools.cache
def _fold_tables() -> tuple[str, str, str, dict[str, str]]:
    """From the character database: single replacements (from, to), marks to delete, and replacements by several, or of
    characters beyond the basic plane.  Hangul syllables go by rule."""
    one_from, one_to, gone, many = [], [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or HANGUL[0] <= code <= HANGUL[1]:
            continue
        c = chr(code)
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if d == c:
            continue
        if len(d) <= 1 and code < 0x10000:
            (one_from if d else gone).append(c)
            one_to += d
        else:
            many[c] = d
    return "".join(one_from), "".join(one_to), "".join(gone), many


def _ranges(codes: list[int]) -> str:
    """A character class of these code points, runs as ranges."""
    out, at = [], 0
    while at < len(codes):
        end = at
        while end + 1 < len(codes) and codes[end + 1] == codes[end] + 1:
            end += 1
        out.append(f"\\x{{{codes[at]:x}}}" + (f"-\\x{{{codes[end]:x}}}" if end > at else ""))
        at = end + 1
    return "[" + "".join(out) + "]"


def _jamo(c: Column) -> Column:
    """A Hangul syllable as the letters that make it up."""
    n = F.ascii(c) - HANGUL[0]
    letter = lambda base, i: F.decode(F.unhex(F.lpad(F.hex((F.lit(base) + i).cast("long")), 4, "0")), "UTF-16BE")
    tail = F.pmod(n, F.lit(28))
    lead, vowel = F.floor(n / 588), F.floor(F.pmod(n, F.lit(588)) / 28)
    return F.concat(letter(0x1100, lead), letter(0x1161, vowel), F.when(tail > 0, letter(0x11A7, tail)).otherwise(F.lit("")))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of the column, which is named once however often f uses it: chains of such steps grow by sums, not products."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+\z|\A{SPACE[4:]}+", "")


def fold(c: Column) -> Column:
    """Compatibility decomposition without combining marks, lower case, stripped.

    Texts of ASCII alone are only lower-cased; single replacements are one pass; only the characters that become several
    and that a text does hold are then replaced one by one.
    """
    one_from, one_to, gone, many = _fold_tables()
    plain = F.translate(c, one_from + gone, one_to)
    odd = F.lit(_ranges(sorted([*map(ord, many), *range(HANGUL[0], HANGUL[1] + 1)])))
    table = F.str_to_map(F.lit("\x01".join(f"{a}\x02{b}" for a, b in many.items())), F.lit("\x01"), F.lit("\x02"))
    made = lambda x: F.when(x.between(chr(HANGUL[0]), chr(HANGUL[1])), _jamo(x)).otherwise(F.element_at(table, x))
    several = lambda p, rest: F.aggregate(F.array_distinct(F.regexp_extract_all(rest, odd, F.lit(0))), p, lambda acc, x: F.replace(acc, x, made(x)))
    # The long class is only tried on what the single replacements leave beyond ASCII.
    rest = lambda p: F.regexp_replace(p, r"[\x00-\x7f]+", "")
    wide = let(plain, lambda p: let(rest(p), lambda r: F.when((r != "") & F.regexp(r, odd), several(p, r)).otherwise(p)))
    return strip(F.lower(F.when(F.regexp(c, F.lit(r"[^\x00-\x7F]")), wide).otherwise(c)))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def tokens(c: Column) -> Column:
    """Distinct letter runs of two or more of the folded text."""
    return F.array_distinct(F.regexp_extract_all(fold(c), F.lit("[a-z]{2,}"), F.lit(0)))


def digit_runs(c: Column) -> Column:
    """Distinct digit runs of the raw text."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)\d+"), F.lit(0)))


#: What readers write for a value that they couldn't read.
UNREADABLE = ("n/a", "none", "null", "inconnu", "unknown", "illisible", "[illegible]")


def clean_value(c: Column) -> Column:
    """A reader's value without marks of illegibility; null and what only marks make up become empty."""
    s = strip(F.coalesce(c.cast("string"), F.lit("")))
    inner = F.regexp_replace(s, r"\[\?\]|…", "")
    cut = F.regexp_replace(inner, r"\A[ \-–—,;]+|[ \-–—,;]+\z", "")
    empty = s.rlike(r"\A(?U)[\[\]?.…\s\x1c-\x1f\-–—]*\z") | F.lower(s).isin(*UNREADABLE)
    return F.when(empty, F.lit("")).otherwise(strip(cut))


def line_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), f"{SPACE}+", " ")


#: Fixed value: a line that says nothing but what couldn't be read.
FILLER = r"\A(?:\[\?\]|le|la|au|à|du|de|et|,|\.|…|-|\s)*+\z"


def collapse_lines(c: Column) -> Column:
    """The text's lines, without those that repeat the line before, and without filler lines after a line that has a gap.

    Both rules look one raw line back: a line dropped as a repeat has the key of the line before it, and a line dropped
    as filler holds a gap like the one kept before it.
    """
    lines = F.split(c, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
    # A last line end opens no line.
    ended = let(lines, lambda x: F.when((F.size(x) > 0) & (F.element_at(x, -1) == ""), F.slice(x, 1, F.size(x) - 1)).otherwise(x))
    keyed = F.transform(ended, lambda x: F.struct(x.alias("line"), line_key(x).alias("key")))

    def kept(x: Column, before: Column) -> Column:
        gap = lambda y: F.coalesce(F.contains(y["key"], F.lit("[?]")), F.lit(False))
        return ~F.coalesce((x["key"] != "") & (x["key"] == before["key"]), F.lit(False)) & ~(gap(x) & gap(before) & x["key"].rlike(FILLER))

    return F.transform(let(keyed, lambda both: F.filter(both, lambda x, i: kept(x, F.get(both, i - 1)))), lambda x: x["line"])


#: A phrase that loops, and what becomes of it.
LOOP = (r"(?U)(\b[^\n]{2,40}?\b)(?:[\s,;·]*\1){3,}+", "$1 $1 …")


def cut_phrase_loops(c: Column) -> Column:
    """A short phrase that stands four times or more in a row is kept twice."""
    return F.regexp_replace(c, *LOOP)


def phrase_loops_cut(rows: DataFrame, name: str) -> DataFrame:
    """rows with cut_phrase_loops() of a column; only what lies around a loop is given to the pattern."""
    return cut_loops(rows, name, *LOOP)


def _before_loops(c: Column) -> Column:
    t = F.regexp_replace(c, "</?start_of_image>|</?end_of_image>", "")
    t = F.regexp_replace(t, "(?md)^```.*?$", "")
    t = F.array_join(collapse_lines(t), "\n")
    t = F.regexp_replace(t, r"(?iU)(?:\[\?\]\s*(?:le|la|au|à|du|de|et)?\s*){3,}+", "[?] … ")
    return F.regexp_replace(t, r"(?U)(?:\[\?\]\s*){3,}+", "[?] … ")


def _after_loops(c: Column) -> Column:
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def clean_transcript(c: Column) -> Column:
    """A reader's transcript without sentinels, code fences and runaway repetition; the patterns are fixed values."""
    return _after_loops(cut_phrase_loops(_before_loops(c)))


def transcripts_cleaned(rows: DataFrame, name: str) -> DataFrame:
    """rows with clean_transcript() of a column, for whole tables."""
    cut = phrase_loops_cut(rows.withColumn(name, _before_loops(F.col(name))), name)
    return cut.withColumn(name, _after_loops(F.col(name)))
