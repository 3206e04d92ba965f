"""The correction of a record's values in a fixed order of layers, with the log of what each changed.

Layers are expressions over one cell: the format rules, what a vocabulary or dictionary makes of its value, the spelling,
and the regiment's format.  Vocabularies and dictionaries are asked once for each distinct value, and cells take the
answers by one join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.functions.normalise import day, department, height, ordinal, regiment
from concordia.functions.text import clean_value, let, strip
from concordia.operators.fields import AFFIXES, CLOSED, DAYS, DICTIONARY_OF, FIELDS, SPELT
from concordia.operators.vocabulary import best_match, candidates, contained, snap_notes
from concordia.sources.stage import staged

DIFFS = "array<struct<original:string,corrected:string,note:string>>"
#: The notes of the log.
NOTES = {"height": "format:height", "day": "format:day", "ordinal": "format:ordinal-marker", "department": "rule:default-dept", "spelling": "llm", "regiment": "format:regiment"}
#: The fields that first_rules() may change.
RULED = ("Height", *DAYS, *AFFIXES, "Enlistment Departement")
FAILED = "llm-correction-failed: "  # fixed value
#: Answers that each executor can hold.
FEW = 100_000
#: The answers to distinct values: what kind of list was asked, which, for what value, and what it becomes.
ANSWERS = ("kind", "key", "v", "to", "note")


def diff(original: Column, corrected: Column, note: Column | str) -> Column:
    """The change as an array of one, none if there is no change."""
    made = F.struct(original.alias("original"), corrected.alias("corrected"), (F.lit(note) if isinstance(note, str) else note).alias("note"))
    return F.filter(F.array(made), lambda d: d["original"] != d["corrected"]).cast(DIFFS)


def first_rules(label: Column, value: Column) -> Column:
    """struct(value, diffs) after the format rules that come before any list; a field has one rule at most."""
    own = {"height": (label == "Height", height), "day": (label.isin(*DAYS), day), "ordinal": (label.isin(*AFFIXES), ordinal), "department": (label == "Enlistment Departement", department)}
    new, note = F.when(value == "", value), F.lit("")
    for name, (which, rule) in own.items():
        new = new.when(which, rule(value))
        note = F.when(which, NOTES[name]).otherwise(note)
    made = let(new.otherwise(value), lambda x: F.struct(x.alias("value"), diff(value, x, note).alias("diffs")))
    return F.when(label.isin(*RULED) & (value != ""), made).otherwise(F.struct(value.alias("value"), F.array().cast(DIFFS).alias("diffs")))


def last_rules(label: Column, value: Column) -> Column:
    """struct(value, diffs) after the regiment's format, which comes last as lists and spelling may undo it."""
    made = let(F.struct(value.alias("was"), regiment(value).alias("value")), lambda x: F.struct(x["value"], diff(x["was"], x["value"], NOTES["regiment"]).alias("diffs")))
    return F.when((label == "Regiment") & (value != ""), made).otherwise(F.struct(value.alias("value"), F.array().cast(DIFFS).alias("diffs")))


def question(label: Column, value: Column, confidence: Column, dictionaries: bool, gated: bool = True) -> Column:
    """struct(kind, key, v) that a cell asks: its dictionary, where there are any, else its vocabulary; null if neither.

    HIGH values are left to open dictionaries' readers, if gated; blank ones ask nothing.
    """
    big = {n: k for n, k in DICTIONARY_OF.items() if dictionaries}
    small = {n: v for n, _, v in FIELDS if v and v not in ("day", "year") and n not in big}

    def of(names: dict[str, str]) -> Column:
        out = F.lit(None).cast("string")
        for key in sorted(set(names.values())):
            out = F.when(label.isin(*(n for n, k in names.items() if k == key)), key).otherwise(out)
        return out

    kind = F.when(label.isin(*big), F.when(label.isin(*(n for n, k in big.items() if k in CLOSED)), "closed").otherwise("open")).when(label.isin(*small), "vocab")
    ask = F.struct(kind.alias("kind"), F.coalesce(of(big), of(small)).alias("key"), F.when(kind == "vocab", value).otherwise(strip(value)).alias("v"))
    shut = (kind == "open") & (confidence == "HIGH") if gated else F.lit(False)
    return F.when((value != "") & label.isin(*big, *small) & ~F.coalesce(shut, F.lit(False)) & (strip(value) != ""), ask)


def answers(asked: DataFrame, vocab: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    """ANSWERS to the distinct questions (kind, key, v) whose value a list changes."""
    small = snap_notes(asked.where("kind = 'vocab'").select(F.col("key").alias("vocab"), F.col("v").alias("value")), vocab)
    out = small.select(F.lit("vocab").alias("kind"), F.col("vocab").alias("key"), F.col("value").alias("v"), "to", "note")
    if dictionary is not None:
        near = best_match(asked.where("kind = 'open'").select(F.col("key").alias("dictkey"), "v"), dictionary).select(F.lit("open").alias("kind"), "dictkey", "v", "match", "score")
        one = contained(asked.where("kind = 'closed'").select(F.col("key").alias("dictkey"), "v"), dictionary.where(F.col("dictkey").isin(*CLOSED)))
        both = near.unionByName(one.where("match IS NOT NULL").select(F.lit("closed").alias("kind"), "dictkey", "v", "match", F.lit(100.0).alias("score")))
        note = F.concat(F.lit("dict:"), F.col("dictkey"), F.lit("("), F.bround("score").cast("int").cast("string"), F.lit(")"))
        out = out.unionByName(both.where("match <> v").select("kind", F.col("dictkey").alias("key"), "v", F.col("match").alias("to"), note.alias("note")))
    return out


def answered(value: Column, raw: Column, kind: Column, v: Column, to: Column, note: Column) -> Column:
    """struct(value, diffs) after an answer; the log of a vocabulary has the raw value, that of a dictionary the stripped one."""
    d = F.when(to.isNotNull(), F.array(F.struct(F.when(kind == "vocab", raw).otherwise(v).alias("original"), to.alias("corrected"), note.alias("note"))).cast(DIFFS))
    return F.struct(F.coalesce(to, value).alias("value"), F.coalesce(d, F.array().cast(DIFFS)).alias("diffs"))


def payload(cells: DataFrame, spec: DataFrame, vocab: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """record_id, label, value, candidates of the cells that a speller is given: free text, not HIGH, not blank."""
    asked = cells.where(F.col("label").isin(*SPELT) & (F.col("confidence") != "HIGH")).withColumn("v", strip(F.col("value"))).where("v <> ''")
    near = candidates(staged(asked.select("label", "v").distinct(), "spelling"), spec, vocab, dictionary)
    return asked.select("record_id", "label", "v").join(near, ["label", "v"], "left").select("record_id", "label", F.col("v").alias("value"), "candidates")


def spell(cells: DataFrame, spelt: DataFrame) -> DataFrame:
    """cells (with value and diffs) with what a speller returned (record_id, label, spelt, error): any field that it names
    takes a text that isn't blank once it is cleaned; an error is logged with the record's first field, and changes nothing."""
    failed = F.max("error").alias("__error")
    said = spelt.groupBy("record_id", "label").agg(F.max("spelt").alias("__spelt"))
    lost = spelt.where("error IS NOT NULL").groupBy("record_id").agg(failed)
    c = cells.join(said, ["record_id", "label"], "left").join(lost, "record_id", "left")
    new = F.when(F.coalesce(clean_value(F.col("__spelt")), F.lit("")) != "", clean_value(F.col("__spelt"))).otherwise(F.col("value"))
    made = c.withColumn("__new", new).withColumn("__d", diff(F.col("value"), F.col("__new"), NOTES["spelling"]))
    broken = F.struct(F.lit("").alias("original"), F.lit("").alias("corrected"), F.concat(F.lit(FAILED), F.col("__error")).alias("note"))
    wrong = F.when(F.col("__error").isNotNull() & (F.col("label") == FIELDS[0][0]), F.array(broken).cast(DIFFS)).otherwise(F.array().cast(DIFFS))
    return made.withColumn("diffs", F.concat("diffs", "__d", wrong)).withColumn("value", F.col("__new")).drop("__new", "__d", "__spelt", "__error")


def correct(
    cells: DataFrame, spec: DataFrame, vocab: DataFrame, dictionary: DataFrame | None = None, speller: Callable[[DataFrame], DataFrame] | None = None,
    gated: bool = True,
) -> DataFrame:
    """cells with corrected values, raw (as given) and diffs (original, corrected, note) in the order of the layers.

    speller is a hook for a model: it gets the payload (record_id, label, value, candidates) and returns (record_id, label,
    spelt, error); what it returns for any field is taken, as spell() says.
    gated: HIGH values are left to open dictionaries' readers; without it, as for a record that a user edits, none are.
    """
    c = cells.withColumn("raw", F.col("value")).withColumn("__first", first_rules(F.col("label"), F.col("value")))
    c = c.withColumn("value", F.col("__first.value")).withColumn("diffs", F.col("__first.diffs")).drop("__first")
    if "confidence" not in c.columns:
        c = c.withColumn("confidence", F.lit(""))
    c = c.withColumn("__q", question(F.col("label"), F.col("value"), F.col("confidence"), dictionary is not None, gated))
    questions = staged(c.where("__q IS NOT NULL").select("__q.kind", "__q.key", "__q.v").distinct(), "questions")
    found = staged(answers(questions, vocab, dictionary).select(*(F.col(x).alias(f"__{x}") for x in ANSWERS)), "answers")
    # Cells ask few distinct values, most of them very often; where the answers are few, they go to the cells, which stay.
    if found.count() <= FEW:
        found = F.broadcast(found)
    # Cells without a question meet no answer; their record spreads them over the join's tasks.
    c = c.withColumn("__kind", F.coalesce("__q.kind", F.lit(""))).withColumn("__key", F.coalesce("__q.key", F.lit(""))).withColumn("__v", F.coalesce("__q.v", F.col("record_id").cast("string")))
    c = c.join(found, ["__kind", "__key", "__v"], "left")
    c = c.withColumn("__a", answered(*(F.col(x) for x in ("value", "raw", "__kind", "__v", "__to", "__note"))))
    c = c.withColumn("value", F.col("__a.value")).withColumn("diffs", F.concat("diffs", "__a.diffs")).drop("__a", "__q", *(f"__{x}" for x in ANSWERS))
    if speller is not None:
        c = staged(c, "corrected")
        c = spell(c, staged(speller(payload(c, spec, vocab, dictionary)), "spelt"))
    c = c.withColumn("__last", last_rules(F.col("label"), F.col("value")))
    c = c.withColumn("value", F.col("__last.value")).withColumn("diffs", F.concat("diffs", "__last.diffs"))
    return c.select(*cells.columns, "raw", "diffs")


def diff_log(corrected: DataFrame) -> DataFrame:
    """record_id, label, seq, original, corrected, note: one row for each change; of a failed speller under _error."""
    rows = corrected.select("record_id", "label", F.posexplode("diffs").alias("seq", "d"))
    label = F.when(F.startswith(F.col("d.note"), F.lit(FAILED)), "_error").otherwise(F.col("label"))
    return rows.select("record_id", label.alias("label"), "seq", "d.original", "d.corrected", "d.note")
