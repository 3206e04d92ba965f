"""Indel similarity of any strings, scored by Arrow batches; and in the JVM for short strings inside arrays.

The score of two strings is 200 * common / (len a + len b), common being the length of their longest common subsequence.
A batch's pairs are scored at once, a lane of bits a pair; no string is too long.
"""

from __future__ import annotations

import functools

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from concordia.functions import lanes

#: Longest string whose characters fit the bits of a long with room for the carry.
BITS = 62

register_pickle_by_value(lanes)  # scorers travel with their functions, so that workers need no import of this package


@functools.cache
def _scorer(kind: str):
    """A pandas UDF of two string columns."""
    import pandas as pd

    rule = {"plain": lanes.ratios, "composite": lanes.composites}[kind]

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        some = (a.notna() & b.notna()).to_numpy()
        if some.all():
            return pd.Series(rule(a.tolist(), b.tolist()))
        out = pd.Series([None] * len(a), dtype="object")
        out[some] = rule(a[some].tolist(), b[some].tolist())
        return out

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}  # as types, which the UDF's kind is told from
    return F.pandas_udf(run, DoubleType())


def ratio(a: Column, b: Column) -> Column:
    """200 * common / (len a + len b), 100 for two empty strings; null if either is.

    a and b are columns of a table below a join or aggregate: Spark gives a Python function no expression that holds
    functions over arrays, as folding does.
    """
    return _scorer("plain")(a, b)


def composite_ratio(a: Column, b: Column) -> Column:
    """The usual composite scorer, by its published description: the best of the plain ratio, 0.95 of that of sorted or
    common words, and, where one string is at least half longer, of the best part of it (0.9, or 0.6 from eight times the
    length on)."""
    return _scorer("composite")(a, b)


def upper_bound(a: Column, b: Column) -> Column:
    """What the ratio can be at most, from the lengths alone."""
    return F.when(F.length(a) + F.length(b) == 0, F.lit(100.0)).otherwise(F.lit(200.0) * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b)))


def short_ratio(a: Column, b: Column) -> Column:
    """The ratio by built-in expressions, for use within functions over arrays; null where both have over BITS characters."""
    short = F.when(F.length(a) < F.length(b), F.struct(b.alias("x"), a.alias("y"))).otherwise(F.struct(a.alias("x"), b.alias("y")))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * common_subsequence(short["x"], short["y"]) / total)


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence; b has at most BITS characters, else null."""
    one = F.lit(1).cast("long")
    full = F.call_function("shiftleft", one, F.length(b)) - one
    places = F.transform(_chars(b), lambda x, i: F.struct(x.alias("c"), F.call_function("shiftleft", one, i).alias("bit")))

    def step(acc: Column, c: Column) -> Column:
        m = F.aggregate(acc["places"], F.lit(0).cast("long"), lambda bits, p: F.when(p["c"] == c, bits.bitwiseOR(p["bit"])).otherwise(bits))
        hit = acc["s"].bitwiseAND(m)
        s = (acc["s"] + hit).bitwiseOR(acc["s"].bitwiseAND(F.bitwise_not(m))).bitwiseAND(acc["full"])
        return F.struct(acc["places"].alias("places"), acc["full"].alias("full"), s.alias("s"))

    start = F.struct(places.alias("places"), full.alias("full"), full.alias("s"))
    count = F.aggregate(_chars(a), start, step, lambda acc: F.bit_count(F.bitwise_not(acc["s"]).bitwiseAND(acc["full"])))
    return F.when(F.length(b) <= BITS, count)
