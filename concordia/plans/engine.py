"""The phases of a run, from readers' tables to verified records.

Both phases in one, without a speller, keep cells as rows, which meet again in their record at the end.  Else a record is
one row with an array of its cells, and layers change the array.  Only distinct values and tokens are looked up by joins.
What the readers agreed on is written between the phases, as are the lists' answers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions.text import fold, let
from concordia.operators import correct, fields, reconcile, verify
from concordia.operators.reconcile import changed
from concordia.sources.stage import staged, tasks


@dataclass(frozen=True)
class Settings:
    mode: str = "accurate"
    strict: bool = False
    third_reader: bool = True


INDEX = ("words", "runs", "all_digits", "doctype", "doctype_confidence")


def index_of(transcripts: DataFrame, parts: int | None = None) -> DataFrame:
    """record_id and what the phases need of its transcript (record_id, text): INDEX; parts: to how many tasks.

    Transcripts are dealt by record first, as records are, so that large files are read by many tasks and the join moves
    nothing again.
    """
    dealt = transcripts.select("record_id", "text")
    dealt = dealt.repartition(parts, "record_id") if parts else dealt.repartition("record_id")
    texts = dealt.withColumn("__fold", fold(F.coalesce("text", F.lit(""))))
    return verify.transcript_index(verify.classify(texts, folded="__fold"), more=("doctype", "doctype_confidence"), folded="__fold")


def told(rows: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """rows with __told, the Event Type that a row's name or the transcript's headings tell, if any, and __split; and what
    an Event Type's cell then has."""
    split = verify.row_split(F.col("record_id"))
    kind = F.when(F.col("__split"), F.lit("Military")).when(F.coalesce("doctype", F.lit("")) != "", F.col("doctype"))
    split_ = F.col("__split")
    cell = {
        "value": F.col("__told"), "confidence": F.when(split_, "HIGH").otherwise(F.col("doctype_confidence")),
        "source": F.when(split_, "row-split").otherwise("structure"), "alt": F.lit(""),
        "evidence": F.when(split_, "one row of a multi-person ledger page").otherwise("page section headers"),
    }
    return rows.withColumn("__split", split).withColumn("__told", kind), cell


def typed(rows: DataFrame, log: bool) -> DataFrame:
    """records with the Event Type that told() finds; log: the change goes to the cell's diffs, else, while records are
    read, it is the reading."""
    rows, own = told(rows)
    value = own["value"]

    def cell(c: Column) -> Column:
        note = F.when(F.col("__split"), "row-split:forced").otherwise("doctype:markers")
        diffs = F.concat(c["diffs"], correct.diff(c["value"], value, note)) if log else c["diffs"]
        return F.struct(*(x.alias(n) for n, x in own.items()), diffs.alias("diffs"), (c["raw"] if log else value).alias("raw"))

    fresh = (*own, "diffs", "raw")
    return changed(rows, fresh, lambda c: (c["label"] == "Event Type") & value.isNotNull(), cell).drop("__told", "__split")


def read_records(text: DataFrame, vision: DataFrame | None, settings: Settings, index: DataFrame | None) -> DataFrame:
    """Silver records with the fields that a reader has, and, where the transcripts' index is given, typed and with its
    columns.  Fields that nobody read stay out until the end: no layer changes them."""
    fast = settings.mode == "fast" or vision is None
    silver = reconcile.records(text, None if fast else vision, fields.LABELS)
    return silver if index is None else typed(silver.join(index, "record_id", "left"), False)


def _looked_up(rows: DataFrame, vocab: DataFrame, dictionary: DataFrame | None, gated: bool) -> DataFrame:
    """records after the lists' answers.  Questions go to the lists once for each distinct value; only what they change
    comes back, as one array a record."""
    asks = lambda c: F.struct(c["label"].alias("label"), correct.question(c["label"], c["value"], c["confidence"], dictionary is not None, gated).alias("q"))
    some = F.filter("cells", lambda c: c["value"] != "")
    asked = rows.select("record_id", F.explode(F.filter(F.transform(some, asks), lambda x: x["q"].isNotNull())).alias("x")).select("record_id", "x.label", "x.q.*")
    found = staged(correct.answers(staged(asked.select("kind", "key", "v").distinct(), "questions"), vocab, dictionary), "answers")
    back = asked.join(found, ["kind", "key", "v"]).groupBy("record_id").agg(F.collect_list(F.struct("label", "kind", "v", "to", "note")).alias("__answers"))
    own = lambda c: F.get(F.filter("__answers", lambda x: x["label"] == c["label"]), F.lit(0))

    def cell(c: Column) -> Column:
        made = let(own(c), lambda a: correct.answered(c["value"], c["raw"], a["kind"], a["v"], a["to"], a["note"]))
        return let(made, lambda m: F.struct(m["value"], F.concat(c["diffs"], m["diffs"]).alias("diffs")))

    hit = lambda c: (c["value"] != "") & F.exists(F.coalesce("__answers", F.array().cast(back.schema["__answers"].dataType)), lambda x: x["label"] == c["label"])
    return changed(rows.join(back, "record_id", "left"), ("value", "diffs"), hit, cell).drop("__answers")


def post_records(
    silver: DataFrame, settings: Settings = Settings(), dictionary: DataFrame | None = None, third: DataFrame | None = None,
    speller: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Gold records from silver ones that carry their transcript's INDEX: corrected, typed, verified, and confirmed by a
    third reader."""
    spark = silver.sparkSession
    vocab = fields.vocabulary(spark)

    first = lambda c: correct.first_rules(c["label"], c["value"])
    rows = changed(silver, ("value", "diffs"), lambda c: (c["value"] != "") & c["label"].isin(*correct.RULED), first)
    rows = _looked_up(rows, vocab, dictionary, True)
    if speller is not None:
        cells = staged(reconcile.spread(reconcile.filled(rows, fields.LABELS)), "corrected")
        spelt = correct.spell(cells, staged(speller(correct.payload(cells, fields.field_spec(spark), vocab, dictionary)), "spelt"))
        rows = reconcile.gathered(spelt).join(rows.drop("cells"), "record_id")

    last = lambda c: let(correct.last_rules(c["label"], c["value"]), lambda m: F.struct(m["value"], F.concat(c["diffs"], m["diffs"]).alias("diffs")))
    rows = changed(rows, ("value", "diffs"), lambda c: (c["value"] != "") & (c["label"] == "Regiment"), last)
    rows = verify.verify_records(typed(rows, True), settings.strict)
    birth = F.get(F.filter("cells", lambda c: c["label"] == "Birth Year"), F.lit(0))["value"]
    rows = rows.withColumn("__birth", verify.four_digits(birth))

    early = lambda c: F.struct(F.concat(c["flags"], F.array(F.lit("before-birth"))).alias("flags"), F.lit("LOW").alias("confidence"))
    rows = changed(rows, ("flags", "confidence"), lambda c: verify.before_birth_flags(c["label"], c["value"], F.col("__birth")), early).drop("__birth")
    return reconcile.third_reader_records(rows, third) if settings.third_reader and third is not None else rows


def read_phase(text: DataFrame, vision: DataFrame | None, settings: Settings = Settings(), transcripts: DataFrame | None = None) -> DataFrame:
    """Silver cells from the readers' cells: every record with all fields, typed where its transcript is given."""
    rows = read_records(text, vision, settings, None if transcripts is None else index_of(transcripts)).select("record_id", "cells")
    return reconcile.spread(reconcile.filled(rows, fields.LABELS, _source(vision, settings))).select("record_id", *reconcile.CELL)


def _source(vision: DataFrame | None, settings: Settings) -> str:
    """Whom fields that nobody has are put down to: in fast mode the text reader."""
    return "text" if settings.mode == "fast" or vision is None else ""


def post_phase(
    silver: DataFrame, transcripts: DataFrame, settings: Settings = Settings(), dictionary: DataFrame | None = None, third: DataFrame | None = None,
    speller: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Gold cells, always from silver ones: corrected, typed, verified, and confirmed by a third reader."""
    index = index_of(transcripts)
    rows = staged(reconcile.gathered(silver).join(index, "record_id", "left"), "silver")
    return reconcile.spread(post_records(rows, settings, dictionary, third, speller))


def run(
    text: DataFrame, vision: DataFrame | None, transcripts: DataFrame, settings: Settings = Settings(), dictionary: DataFrame | None = None,
    third: DataFrame | None = None, speller: Callable[[DataFrame], DataFrame] | None = None, blanks: bool = True,
) -> DataFrame:
    """Gold cells of both phases in one: what post_phase() makes of read_phase(); silver cells are written once.

    Without a speller, who may name any field, cells stay rows until the end, and only then get their record's blank
    fields; blanks: False leaves these out, but for the Event Type.
    """
    source = _source(vision, settings)
    if speller is not None:
        silver = staged(read_records(text, vision, settings, index_of(transcripts)), "silver")
        gold = reconcile.spread(reconcile.filled(post_records(silver, settings, dictionary, third, speller), fields.LABELS, source))
        return gold if blanks else gold.where((F.col("value") != "") | (F.col("label") == "Event Type"))
    fast = settings.mode == "fast" or vision is None
    silver = staged(reconcile.read_cells(text, None if fast else vision, fields.LABELS, third if settings.third_reader else None), "silver")
    spark = silver.sparkSession
    rows = correct.correct(silver, fields.field_spec(spark), fields.vocabulary(spark), dictionary)
    return _verified(rows, transcripts, settings.strict, source, blanks)


def _verified(rows: DataFrame, transcripts: DataFrame, strict: bool, source: str, blanks: bool) -> DataFrame:
    """Gold cells of corrected rows (with said): verified, confirmed, typed, and with their record's other fields.

    A record's rows are dealt and sorted once: there each learns which fields the others are (a bit each) and the birth year,
    and meets the transcript.  The record's first row brings the fields that it lacks.
    """
    parts = tasks(rows, reconcile.DEALT)
    of = Window.partitionBy("record_id")
    every = F.expr("array(" + ", ".join(f"'{n}'" for n in fields.LABELS) + ")")  # a literal
    rows = rows.repartition(parts, "record_id").withColumn("__at", F.array_position(every, F.col("label")).cast("int"))
    rows = rows.withColumns({
        "__held": F.bit_or(F.expr("shiftleft(1L, __at)")).over(of), "__least": F.min("__at").over(of),
        "__birth": F.max(F.when(F.col("label") == "Birth Year", verify.four_digits(F.col("value")))).over(of),
    })
    rows, event = told(rows.join(index_of(transcripts, parts), "record_id", "left"))
    rows = verify.verify_cells(rows, strict)
    if strict:  # a birth year that was blanked isn't one
        rows = verify.before_birth(rows)
    else:
        early = verify.before_birth_flags(F.col("label"), F.col("value"), F.col("__birth"))
        rows = rows.withColumn("__early", early).withColumns({
            "flags": F.when(F.col("__early"), F.concat("flags", F.array(F.lit("before-birth")))).otherwise(F.col("flags")),
            "confidence": F.when(F.col("__early"), "LOW").otherwise(F.col("confidence")),
        })
    fresh = ("confidence", "source", "flags")
    rows = rows.withColumn("__c", reconcile.confirmed({c: F.col(c) for c in reconcile.CELL}, F.col("said"), "+third"))
    rows = rows.withColumns({n: F.col(f"__c.{n}") for n in fresh})

    first = F.col("__at") == F.col("__least")
    out = rows.select("*", F.posexplode(F.when(first, every).otherwise(F.array("label"))).alias("__pos", "__label"))
    own, is_event = F.col("__label") == F.col("label"), F.col("__label") == "Event Type"
    lacking = F.expr("shiftright(__held, __pos + 1) & 1L") == 0
    out = out.where(own | (lacking if blanks else lacking & is_event))
    none, diffs = F.array().cast("array<string>"), F.array().cast(correct.DIFFS)
    event |= {"flags": none, "raw": event["value"], "diffs": diffs, "dropped": F.lit(None).cast("string")}
    blank = {n: F.lit("") for n in reconcile.CELL[1:-1]} | {"source": F.lit(source), "flags": none, "raw": F.lit(""), "diffs": diffs, "dropped": F.lit(None).cast("string")}
    made = lambda n: F.when(is_event & F.col("__told").isNotNull(), event[n]).when(own, F.col(n)).otherwise(blank[n])
    return out.select("record_id", F.col("__label").alias("label"), *(made(n).alias(n) for n in (*reconcile.CELL[1:], *reconcile.LOGS)))


def edited(cells: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """A user's own values corrected: no confidence holds any back, and nothing is verified again."""
    spark = cells.sparkSession
    return correct.correct(cells, fields.field_spec(spark), fields.vocabulary(spark), dictionary, gated=False)
