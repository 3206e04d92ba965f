"""Two readers' cells into one value with a confidence, and the statistics of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.functions.text import fold, let, strip
from concordia.sources.stage import dealt

#: Rows of readers that a task is dealt.
DEALT = 2_000_000


def spine(records: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """record_id and label: each record with every field."""
    return records.select("record_id").distinct().withColumn("label", F.explode(F.array(*map(F.lit, labels))))


def reconcile(vision: DataFrame, text: DataFrame, labels: tuple[str, ...] | None = None) -> DataFrame:
    """vision: record_id, label, value, confidence, evidence; text: record_id, label, value.

    Agreement of the folded values is HIGH; a conflict keeps the vision value, LOW, and notes the other one.  The text
    reader's value is stripped first.  labels: every record gets these fields and no others, blank where no reader has
    them; else the fields are those that a reader has.
    """
    v = vision.select("record_id", "label", F.col("value").alias("v"), F.col("confidence").alias("vc"), "evidence")
    t = text.select("record_id", "label", strip(F.col("value")).alias("t"))
    on = ["record_id", "label"]
    met = v.join(t, on, "full_outer") if labels is None else _of_records(v, t, labels)
    both = met.select(*on, *(F.coalesce(c, F.lit("")).alias(c) for c in ("v", "vc", "evidence", "t")))
    made = merged(F.col("v"), F.col("vc"), F.col("t"))
    return both.select(*on, *(made[c].alias(c) if c in CONSENSUS else F.col(c) for c in ("value", "confidence", "evidence", "source", "alt")), F.array().cast("array<string>").alias("flags"))


def _of_records(v: DataFrame, t: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """record_id, label, v, vc, evidence and t of every record's fields, each repeated cell of one reader with each of the
    other.  Only readers' cells are dealt, by record; a record's fields are made of them where they meet."""
    text = F.lit(None).cast("string")
    both = v.select("record_id", F.struct("label", "v", "vc", "evidence").alias("c"), text.alias("label"), text.alias("t"))
    both = both.unionByName(t.select("record_id", F.lit(None).cast(both.schema["c"].dataType).alias("c"), "label", "t"))
    some = F.struct("label", "t")
    held = both.groupBy("record_id").agg(F.collect_list("c").alias("vs"), F.collect_list(F.when(F.col("c").isNull(), some)).alias("ts"))
    none = lambda a, kind: F.when(F.size(a) > 0, a).otherwise(F.array(F.lit(None).cast(kind)))
    own = lambda cells, label: F.filter(cells, lambda c: c["label"] == label)
    v_kind, t_kind = (held.schema[c].dataType.elementType for c in ("vs", "ts"))

    def field(label: Column) -> Column:
        pair = lambda x, y: F.struct(label.alias("label"), x["v"].alias("v"), x["vc"].alias("vc"), x["evidence"].alias("evidence"), y["t"].alias("t"))
        met = lambda vs, ts: F.flatten(F.transform(vs, lambda x: F.transform(ts, lambda y: pair(x, y))))
        return let(none(own("vs", label), v_kind), lambda vs: let(none(own("ts", label), t_kind), lambda ts: met(vs, ts)))

    every = F.expr("array(" + ", ".join(f"'{n}'" for n in labels) + ")")  # a literal
    blank = lambda label: F.struct(label.alias("label"), *(text.alias(c) for c in ("v", "vc", "evidence", "t")))
    had = F.concat(*(F.transform(c, lambda x: x["label"]) for c in ("vs", "ts")))
    made = lambda h: F.concat(F.flatten(F.transform(F.array_intersect(every, h), field)), F.transform(F.array_except(every, h), blank))
    cells = let(had, made)
    return held.select("record_id", F.explode(cells).alias("x")).select("record_id", "x.*")


CONSENSUS = ("value", "confidence", "source", "alt")


def merged(v: Column, vc: Column, t: Column, same: Column | None = None) -> Column:
    """struct(value, confidence, source, alt) of what a vision reader has, with its confidence, and a text reader; same:
    whether both are equal once folded, where that is a column already."""
    has_v, has_t, same = v != "", t != "", fold(v) == fold(t) if same is None else same

    def pick(agree: Column | str, conflict: Column | str, only_v: Column | str, only_t: Column | str) -> Column:
        a, c, x, y = (F.lit(k) if isinstance(k, str) else k for k in (agree, conflict, only_v, only_t))
        return F.when(has_v & has_t & same, a).when(has_v & has_t, c).when(has_v, x).when(has_t, y).otherwise(F.lit(""))

    return F.struct(
        pick(v, v, v, t).alias("value"), pick("HIGH", "LOW", F.when(vc == "", F.lit("MEDIUM")).otherwise(vc), "MEDIUM").alias("confidence"),
        pick("vision+text", "conflict", "vision", "text").alias("source"), pick("", t, "", "").alias("alt"),
    )


CELL = ("label", "value", "confidence", "evidence", "source", "alt", "flags")
#: What the later phase adds to a cell: the value as the readers had it, the log of its changes, and what was blanked.
LOGS = {"raw": "value", "diffs": "CAST(array() AS array<struct<original:string,corrected:string,note:string>>)", "dropped": "CAST(NULL AS string)"}


def records(text: DataFrame, vision: DataFrame | None, labels: tuple[str, ...], always: tuple[str, ...] = ("Event Type",)) -> DataFrame:
    """record_id and cells, an array of CELL and LOGS: what reconcile() or, without vision, fast_mode() has of every record,
    but for the fields that no reader has, which filled() adds; those of always are there in any case.

    Both readers' rows are dealt by record once and meet there; of repeated cells of a reader the largest value counts.
    """
    t = text.select("record_id", "label", F.lit("text").alias("reader"), F.coalesce("value", F.lit("")).alias("value"), F.lit("").alias("confidence"), F.lit("").alias("evidence"))
    both = t if vision is None else t.unionByName(vision.select("record_id", "label", F.lit("vision").alias("reader"), "value", "confidence", "evidence"))
    of = lambda reader: F.max(F.when(F.col("reader") == reader, F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in ("value", "confidence", "evidence")))))
    one = both.repartition("record_id").groupBy("record_id", "label").agg(of("vision").alias("v"), of("text").alias("t"))
    some = lambda c: F.coalesce(c, F.lit(""))
    if vision is None:
        made = one.select("record_id", "label", some(F.col("t.value")).alias("value"), F.lit("").alias("evidence"), F.lit("text").alias("source"), F.lit("").alias("alt"))
        made = made.withColumn("confidence", F.when(strip(F.col("value")) != "", "MEDIUM").otherwise(""))
    else:
        one = one.withColumn("m", merged(some(F.col("v.value")), some(F.col("v.confidence")), strip(some(F.col("t.value")))))
        made = one.select("record_id", "label", "m.*", some(F.col("v.evidence")).alias("evidence"))
    cell = F.struct(*CELL[:-1], F.array().cast("array<string>").alias("flags"), *(F.expr(e).alias(n) for n, e in LOGS.items()))
    held = made.groupBy("record_id").agg(F.collect_list(F.when(F.col("label").isin(*labels), cell)).alias("cells"))
    more = blanks(always, made.select(cell.alias("c")).schema["c"].dataType.simpleString(), "text" if vision is None else "")
    lacking = F.filter(more, lambda b: ~F.exists("cells", lambda c: c["label"] == b["label"]))
    return held.withColumn("cells", F.concat("cells", lacking))


def read_cells(text: DataFrame, vision: DataFrame | None, labels: tuple[str, ...], third: DataFrame | None = None) -> DataFrame:
    """The cells of records() as rows (record_id, CELL), with said, what a third reader has of the field: a row for each
    field that a reader has.  Of fields outside labels a record keeps one blank row, whose label is empty.

    All readers' rows are dealt by record, each about two million rows a task, and grouped by record and field where they lie.
    """
    known = F.coalesce(F.col("label").isin(*labels), F.lit(False))
    none = F.lit("")
    some = lambda c: F.when(known, F.coalesce(c, none)).otherwise(none)

    def of(rows: DataFrame, reader: str, *more: str) -> DataFrame:
        own = (some(c) if c in more else none for c in ("confidence", "evidence"))
        return rows.select("record_id", F.when(known, F.col("label")).otherwise(none).alias("label"), F.lit(reader).alias("reader"), some("value").alias("value"), *(x.alias(c) for x, c in zip(own, ("confidence", "evidence"))))

    both = of(text, "text")
    if vision is not None:
        both = both.unionByName(of(vision, "vision", "confidence", "evidence"))
    if third is not None:
        both = both.unionByName(of(third.where(known), "third"))
    met = dealt(both, "record_id", DEALT).groupBy("record_id", "label").agg(
        F.max(F.when(F.col("reader") == "vision", F.struct("value", "confidence", "evidence"))).alias("v"),
        *(F.max(F.when(F.col("reader") == r, F.col("value"))).alias(c) for r, c in (("text", "t"), ("third", "said"))),
    )
    met = met.where("v IS NOT NULL OR t IS NOT NULL")  # what a third reader alone has makes no cell
    flags = F.array().cast("array<string>").alias("flags")
    if vision is None:
        value = F.coalesce("t", none)
        sure = F.when(strip(value) != "", "MEDIUM").otherwise("")
        return met.select("record_id", "label", value.alias("value"), sure.alias("confidence"), none.alias("evidence"), F.lit("text").alias("source"), none.alias("alt"), flags, "said")
    met = met.select("record_id", "label", *(F.coalesce(F.col("v")[c], none).alias(n) for c, n in (("value", "__v"), ("confidence", "__vc"), ("evidence", "evidence"))), strip(F.coalesce("t", none)).alias("__t"), "said")
    v, t = F.col("__v"), F.col("__t")
    met = met.withColumn("__same", F.when((v != "") & (t != ""), fold(v) == fold(t)))
    made = merged(v, F.col("__vc"), t, F.col("__same"))
    return met.select("record_id", "label", *(made[c].alias(c) if c in CONSENSUS else F.col(c) for c in CELL[1:-1]), flags, "said")


def blanks(labels: tuple[str, ...], kind: str, source: str = "") -> Column:
    """A literal: the cells, of that type, of fields that no reader has."""
    one = "named_struct('label', '{}', 'value', '', 'confidence', '', 'evidence', '', 'source', '{}', 'alt', '', 'flags', array(), 'raw', '', 'diffs', array(), 'dropped', NULL)"
    return F.expr("array(" + ", ".join(one.format(n, source) for n in labels) + ")").cast(f"array<{kind}>")


def filled(rows: DataFrame, labels: tuple[str, ...], source: str = "") -> DataFrame:
    """records with a cell for every label, in their order."""
    whole = blanks(labels, rows.schema["cells"].dataType.elementType.simpleString(), source)
    own = lambda cells: F.transform(whole, lambda b: F.coalesce(F.get(F.filter(cells, lambda c: c["label"] == b["label"]), F.lit(0)), b))
    return rows.withColumn("cells", let(F.col("cells"), own))  # named once, as the optimiser puts the cells' own making in its place


def spread(rows: DataFrame) -> DataFrame:
    """record_id and its cells as rows."""
    return rows.select("record_id", F.explode("cells").alias("c")).select("record_id", "c.*")


def gathered(cells: DataFrame) -> DataFrame:
    """record_id and cells with LOGS: a record's rows as one array; a record has each field once."""
    c = cells.withColumns({n: F.expr(e) for n, e in LOGS.items() if n not in cells.columns})
    return c.groupBy("record_id").agg(F.collect_list(F.struct(*(n for n in c.columns if n != "record_id"))).alias("cells"))


def fast_mode(text: DataFrame, labels: tuple[str, ...] | None = None) -> DataFrame:
    """One reader alone: what it has is MEDIUM.  labels: as for reconcile."""
    if labels is not None:
        text = spine(text, labels).join(text.select("record_id", "label", "value"), ["record_id", "label"], "left")
    value = F.coalesce("value", F.lit(""))
    return text.select(
        "record_id", "label", value.alias("value"), F.when(strip(value) != "", "MEDIUM").otherwise("").alias("confidence"),
        F.lit("").alias("evidence"), F.lit("text").alias("source"), F.lit("").alias("alt"), F.array().cast("array<string>").alias("flags"),
    )


def confidence_stats(cells: DataFrame, by: str = "record_id", more: tuple[Column, ...] = ()) -> DataFrame:
    """Of each record's filled cells: how many, by confidence, in conflict and flagged; and more aggregates."""
    filled = strip(F.col("value")) != ""
    level = lambda k: F.count_if(filled & (F.col("confidence") == k)).alias(k.lower())
    return cells.groupBy(by).agg(
        F.count_if(filled).alias("filled"), level("HIGH"), level("MEDIUM"), level("LOW"),
        F.count_if(filled & (F.col("source") == "conflict")).alias("conflicts"),
        F.count_if(filled & (F.size("flags") > 0)).alias("flagged"), *more,
    )


def batch_totals(stats: DataFrame) -> DataFrame:
    """Sums over records; those of failed ones (null) add nothing."""
    return stats.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("filled", "high", "medium", "low", "conflicts", "flagged")))


def confirmed(cell: Column, said: Column, mark: str) -> Column:
    """struct(confidence, source, flags) of a LOW cell whose value or alternative a third reader said; else as they are."""
    open_ = (cell["confidence"] == "LOW") & (F.coalesce(said, F.lit("")) != "")
    same = let(fold(said), lambda q: (q == fold(cell["value"])) | ((cell["alt"] != "") & (q == fold(cell["alt"]))))
    more = F.struct(F.lit("MEDIUM").alias("confidence"), F.concat(cell["source"], F.lit(mark)).alias("source"), F.array_remove(cell["flags"], "uncorroborated").alias("flags"))
    return F.when(open_ & F.when(open_, same), more).otherwise(F.struct(*(cell[n].alias(n) for n in ("confidence", "source", "flags"))))


def third_reader(cells: DataFrame, third: DataFrame, mark: str = "+third") -> DataFrame:
    """LOW cells whose value or alternative a third reader confirms become MEDIUM; the value stays."""
    q = third.select("record_id", "label", F.col("value").alias("q"))
    j = cells.join(q, ["record_id", "label"], "left").withColumn("__c", confirmed({c: F.col(c) for c in cells.columns}, F.col("q"), mark))
    made = ("confidence", "source", "flags")
    return j.select(*(F.col(f"__c.{c}" if c in made else c).alias(c) for c in cells.columns))


def third_reader_records(rows: DataFrame, third: DataFrame, mark: str = "+third") -> DataFrame:
    """The same over records' arrays of cells."""
    said = third.groupBy("record_id").agg(F.collect_list(F.struct("label", F.col("value").alias("q"))).alias("__third"))
    quote = lambda c: F.get(F.filter("__third", lambda t: t["label"] == c["label"]), F.lit(0))["q"]
    low = lambda c: (c["confidence"] == "LOW") & F.col("__third").isNotNull()
    made = lambda c: let(quote(c), lambda q: confirmed(c, q, mark))
    return changed(rows.join(said, "record_id", "left"), ("confidence", "source", "flags"), low, made).drop("__third")


def changed(rows: DataFrame, fresh: tuple[str, ...], which: Callable[[Column], Column], cell: Callable[[Column], Column]) -> DataFrame:
    """rows with the fresh fields of those cells as cell makes them, in one struct; other cells stay as they are."""
    names = rows.schema["cells"].dataType.elementType.names
    made = lambda c: let(cell(c), lambda m: F.struct(*((m if n in fresh else c)[n].alias(n) for n in names)))
    return rows.withColumn("cells", F.transform("cells", lambda c: F.when(which(c), made(c)).otherwise(c)))


def independent(third: DataFrame, readers: DataFrame, model: str) -> DataFrame:
    """What a third reader says of the records that it didn't read itself at first: readers has record_id and reader.  The
    same model can't confirm its own reading."""
    return third.join(readers.where(F.col("reader") == model).select("record_id"), "record_id", "left_anti")


def batch_items(names: DataFrame, gold: DataFrame) -> DataFrame:
    """name, ok, event_type, the record's statistics and error of each name asked for; a name without a record is an
    error of its own and fails nothing else."""
    event = F.max(F.when(F.col("label") == "Event Type", F.col("value"))).alias("event_type")
    done = confidence_stats(gold, more=(event,)).withColumnRenamed("record_id", "name").withColumn("ok", F.lit(True))
    out = names.select("name").distinct().join(done, "name", "left")
    ok = F.coalesce("ok", F.lit(False))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("filled", "high", "medium", "low", "conflicts", "flagged")]
    return out.select("name", ok.alias("ok"), F.coalesce("event_type", F.lit("")).alias("event_type"), *counts, F.when(ok, "").otherwise(F.concat("name", F.lit(" has not been read yet"))).alias("error"))
