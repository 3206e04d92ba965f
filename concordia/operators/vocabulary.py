"""Values against controlled vocabularies and dictionaries: exact, contained, and by similarity within blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions.normalise import length_window
from concordia.functions.similarity import composite_ratio, ratio, upper_bound
from concordia.functions.text import fold, strip
from concordia.operators import nearby

#: Dictionaries so large that a lookup stays within the first letter.
BLOCKED = ("surname", "givenname", "occupation")


def exact_snap(cells: DataFrame, vocab: DataFrame) -> DataFrame:
    """cells (with vocab and value) with canonical where the folded value is a variant; the last canonical wins a shared one."""
    known = vocab.groupBy("vocab", "norm").agg(F.max_by("canonical", "ord").alias("canonical"))
    return cells.withColumn("norm", fold(F.col("value"))).join(F.broadcast(known), ["vocab", "norm"], "left").drop("norm")


def snapped(values: DataFrame, vocab: DataFrame) -> DataFrame:
    """vocab, value, canonical, score, exact: of distinct values (vocab, value) those that a vocabulary takes.

    An exact folded variant comes first (of a shared one the last canonical), else the most similar variant from the
    vocabulary's least score on, the first among equals.  Vocabularies are of fixed size; a value meets its own alone.
    """
    asked = values.where(strip(F.col("value")) != "").select("vocab", "value").distinct().withColumn("n", fold(F.col("value")))
    pairs = asked.join(F.broadcast(vocab.select("vocab", "canonical", "norm", "ord", "least")), "vocab")
    scored = pairs.withColumn("score", composite_ratio(F.col("n"), F.col("norm"))).withColumn("exact", F.col("n") == F.col("norm"))
    scored = scored.where(F.col("exact") | (F.col("score") >= F.col("least")))
    order = F.struct("exact", F.when(F.col("exact"), F.lit(0.0)).otherwise(F.col("score")).alias("s"), F.when(F.col("exact"), F.col("ord")).otherwise(-F.col("ord")).alias("o"))
    best = scored.groupBy("vocab", "value").agg(F.max_by(F.struct("canonical", "score", "exact"), order).alias("m"))
    return best.select("vocab", "value", "m.canonical", F.when(F.col("m.exact"), 100.0).otherwise(F.col("m.score")).alias("score"), "m.exact")


def fuzzy_snap(cells: DataFrame, vocab: DataFrame) -> DataFrame:
    """cells with the canonical form that snapped() finds, and its score."""
    return cells.join(snapped(cells, vocab).drop("exact"), ["vocab", "value"], "left")


def snap_notes(values: DataFrame, vocab: DataFrame) -> DataFrame:
    """vocab, value, to, note of the distinct values that change.

    An exact variant that changes the value is noted as case: in a plain list and as snap: in a vocabulary with variants.
    """
    found = snapped(values, vocab).where(F.col("canonical") != F.col("value"))
    listed = F.broadcast(vocab.select("vocab", "listed").distinct())
    exact = F.concat(F.when(F.col("listed"), "case:").otherwise("snap:"), F.col("vocab"))
    near = F.concat(F.lit("snap:"), F.col("vocab"), F.lit("("), F.bround("score").cast("int").cast("string"), F.lit(")"))
    return found.join(listed, "vocab").select("vocab", "value", F.col("canonical").alias("to"), F.when(F.col("exact"), exact).otherwise(near).alias("note"))


def snap(cells: DataFrame, vocab: DataFrame) -> DataFrame:
    """cells with snapped value and note: exact variants first, the rest by similarity."""
    out = cells.join(snap_notes(cells, vocab), ["vocab", "value"], "left")
    return out.withColumn("note", F.coalesce("note", F.lit(""))).withColumn("value", F.coalesce("to", "value")).drop("to")


def build_dictionary(sources: DataFrame, gloss_keys: tuple[str, ...] = ("hair", "eye")) -> DataFrame:
    """dictkey, value, norm, block, norm_len, ord from (dictkey, value, src, ord): blanks and glosses go, of equal folded
    values the first spelling stays."""
    v = strip(F.translate("value", "\u00a0", " "))
    rows = sources.withColumn("value", v).where(F.col("value").isNotNull() & ~F.col("value").isin("", "."))
    rows = rows.where(~(F.col("dictkey").isin(*gloss_keys) & F.col("value").rlike(r"(?i),|\bor\b"))).withColumn("norm", fold(F.col("value"))).where("norm <> ''")
    first = rows.groupBy("dictkey", "norm").agg(F.min(F.struct("src", "ord", "value")).alias("f"))
    return first.select("dictkey", F.col("f.value").alias("value"), "norm", F.substring("norm", 1, 1).alias("block"), F.length("norm").alias("norm_len"), F.struct("f.src", "f.ord").alias("ord"))


def dictionary_candidates(values: DataFrame, dictionary: DataFrame, least: float) -> DataFrame:
    """dictkey, v, value, score, ord of dictionary values in the block and length window of each distinct value v.

    From nearby.LEAST on values meet through the segments that their score makes them share; below it, where segments
    would be single letters, by first letter and length, so that no letter's values meet in one task.  Values whose block
    is empty, and keys that aren't blocked, meet the whole dictionary of their key.
    """
    asked = values.select("dictkey", "v").distinct().withColumn("n", fold(F.col("v"))).where("n <> ''").withColumn("block", F.substring("n", 1, 1))
    blocked = F.col("dictkey").isin(*BLOCKED)
    blocks = dictionary.where(blocked).select("dictkey", "block", F.lit(True).alias("there")).distinct()
    asked = asked.join(blocks, ["dictkey", "block"], "left").withColumn("block", F.when(F.col("there"), F.col("block")).otherwise("")).drop("there")
    whole = F.array(F.lit(""))
    d = dictionary.select("dictkey", F.explode(F.when(blocked, F.array("block", F.lit(""))).otherwise(whole)).alias("block"), "norm_len", "norm", "value", "ord")
    low, high = length_window(F.length("n"))
    if least >= nearby.LEAST:
        words = asked.select("dictkey", "block", F.col("n").alias("w")).distinct()
        pairs = nearby.like_pairs(words, d.select("dictkey", "block", F.col("norm").alias("seen")), ("dictkey", "block"), least)
        scored = pairs.join(d.withColumnRenamed("norm", "seen"), ["dictkey", "block", "seen"]).join(asked.withColumnRenamed("n", "w"), ["dictkey", "block", "w"])
        low, high = length_window(F.length("w"))
        return scored.where(F.col("norm_len").between(low, high)).select("dictkey", "v", "value", "score", "ord")
    asked = asked.withColumn("norm_len", F.explode(F.sequence(low, high)))
    pairs = asked.join(d, ["dictkey", "block", "norm_len"]).where(upper_bound(F.col("n"), F.col("norm")) >= least)
    return pairs.withColumn("score", ratio(F.col("n"), F.col("norm"))).where(F.col("score") >= least).select("dictkey", "v", "value", "score", "ord")


def best_match(values: DataFrame, dictionary: DataFrame, least: float = 84.0) -> DataFrame:
    """dictkey, v, match, score: exact folded matches at 100, else the most similar, the first among equals; blanks around
    v don't count."""
    exact = values.select("dictkey", "v").distinct().withColumn("norm", fold(F.col("v"))).join(dictionary.select("dictkey", "norm", "value"), ["dictkey", "norm"], "left")
    done = exact.where("value IS NOT NULL").select("dictkey", "v", F.col("value").alias("match"), F.lit(100.0).alias("score"))
    near = dictionary_candidates(exact.where("value IS NULL"), dictionary, least)
    rank = F.row_number().over(Window.partitionBy("dictkey", "v").orderBy(F.desc("score"), "ord"))
    top = near.withColumn("r", rank).where("r = 1").select("dictkey", "v", F.col("value").alias("match"), "score")
    return done.unionByName(top)


def top_candidates(values: DataFrame, dictionary: DataFrame, k: int = 4, least: float = 55.0) -> DataFrame:
    """dictkey, v, rank, value, score of the k most similar dictionary values."""
    rank = F.row_number().over(Window.partitionBy("dictkey", "v").orderBy(F.desc("score"), "ord"))
    return dictionary_candidates(values, dictionary, least).withColumn("rank", rank).where(F.col("rank") <= k).select("dictkey", "v", "rank", "value", "score")


def vocabulary_candidates(values: DataFrame, vocab: DataFrame, k: int = 4, least: float = 60.0) -> DataFrame:
    """vocab, v, rank, value, score of the k canonical forms of a small vocabulary most similar to each value, the first
    among equals; of those, what scores at least so much."""
    canon = vocab.groupBy("vocab", "canonical").agg(F.min("ord").alias("ord")).withColumn("norm", fold(F.col("canonical")))
    asked = values.select("vocab", "v").distinct().where(strip(F.col("v")) != "").withColumn("n", fold(F.col("v")))
    pairs = asked.join(F.broadcast(canon), "vocab")  # the folded values are a column below the join: scorers take no functions over arrays
    scored = pairs.withColumn("score", composite_ratio(F.col("n"), F.col("norm")))
    rank = F.row_number().over(Window.partitionBy("vocab", "v").orderBy(F.desc("score"), "ord"))
    return scored.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("score") >= least)).select("vocab", "v", "rank", F.col("canonical").alias("value"), "score")


def candidates(values: DataFrame, spec: DataFrame, vocab: DataFrame, dictionary: DataFrame | None = None, k: int = 4) -> DataFrame:
    """label, v, candidates (best first) that ground a speller: of the field's dictionary, or else of its vocabulary."""
    asked = values.select("label", "v").distinct().join(F.broadcast(spec.select("label", "dictkey", "vocab")), "label")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"])  # at most k
    if dictionary is not None:
        big = top_candidates(asked.where("dictkey IS NOT NULL"), dictionary, k).groupBy("dictkey", "v").agg(ordered.alias("big"))
        asked = asked.join(big, ["dictkey", "v"], "left")
    else:
        asked = asked.withColumn("big", F.lit(None).cast("array<string>"))
    open_ = asked.where("big IS NULL AND vocab IS NOT NULL")
    small = vocabulary_candidates(open_, vocab, k).groupBy("vocab", "v").agg(ordered.alias("small"))
    none = F.array().cast("array<string>")
    return asked.join(small, ["vocab", "v"], "left").select("label", "v", F.coalesce("big", F.when(F.col("vocab").isNotNull(), F.col("small")), none).alias("candidates"))


#: Dictionaries to which the project's own vocabulary of that name is added.
MERGED = ("city", "state", "prefix", "suffix")


def with_project_vocabulary(sources: DataFrame, vocab: DataFrame, keys: tuple[str, ...] = MERGED) -> DataFrame:
    """sources (dictkey, value, src, ord) and, after them, the canonical forms of the project's vocabularies."""
    own = vocab.where(F.col("vocab").isin(*keys)).groupBy("vocab", "canonical").agg(F.min("ord").alias("ord"))
    last = F.lit(2**31 - 1)
    return sources.select("dictkey", "value", F.col("src").cast("int").alias("src"), F.col("ord").cast("long").alias("ord")).unionByName(
        own.select(F.col("vocab").alias("dictkey"), F.col("canonical").alias("value"), last.alias("src"), F.col("ord").cast("long").alias("ord"))
    )


def contained(cells: DataFrame, closed: DataFrame) -> DataFrame:
    """cells (dictkey, v) with match: the first canonical of a small closed set that the value is or holds as a word."""
    words = F.split(fold(F.col("v")), r"\s+")
    pairs = cells.select("dictkey", "v").distinct().join(F.broadcast(closed.select("dictkey", F.col("value").alias("c"), F.col("norm").alias("cn"), F.col("ord").alias("co"))), "dictkey")
    hit = pairs.where((fold(F.col("v")) == F.col("cn")) | F.array_contains(words, F.col("cn")))
    return cells.join(hit.groupBy("dictkey", "v").agg(F.min_by("c", "co").alias("match")), ["dictkey", "v"], "left")
