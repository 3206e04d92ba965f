"""Values against an independent transcript, plausibility and each other; and the type of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions.normalise import plausibility
from concordia.functions.text import digit_runs, digits, fold, let, strip
from concordia.operators import nearby
from concordia.operators.fields import DAYS, DERIVED, FIELDS, NUMBERS, YEARS
from concordia.operators.reconcile import changed, gathered, spread

# Structural headings of the two kinds of pages.
MILITARY_MARKERS = (
    "signalement", "detail des services", "mutations diverses", "conseil de revision", "numero matricule", "etat civil", "corps d affectation",
    "decision du conseil", "degre d instruction", "inscrit sous le", "classe dans", "antecedents judiciaires", "blessures", "campagnes",
    "renseignements physionomiques", "localites successives",
)
COVER_MARKERS = (
    "subdivision de", "repertoire", "table alphabetique", "bureau de recrutement", "registre matricule des", "classe de mobilisation de",
    "liste generale", "volume", "tome",
)


def held(folded: Column, markers: tuple[str, ...]) -> Column:
    """How many of the markers the folded text holds."""
    return sum((F.contains(folded, F.lit(m)).cast("long") for m in markers), F.lit(0).cast("long"))


def classify(docs: DataFrame, text_col: str = "text", folded: str | None = None) -> DataFrame:
    """docs with mil, cov, doctype and doctype_confidence; folded: the column that has the folded text, if there is one."""
    t = docs if folded else docs.withColumn("__folded", fold(F.coalesce(F.col(text_col), F.lit(""))))
    own = F.col(folded or "__folded")
    t = t.withColumn("mil", held(own, MILITARY_MARKERS)).withColumn("cov", held(own, COVER_MARKERS)).drop("__folded")
    high = (F.col("mil") >= 2) & (F.col("mil") >= F.col("cov"))
    one = (F.col("mil") == 1) & (F.col("cov") == 0)
    cover = (F.col("cov") >= 1) & (F.col("mil") == 0)
    return t.withColumn("doctype", F.when(high | one, "Military").when(cover, "Coverpage").otherwise("")).withColumn(
        "doctype_confidence", F.when(high, "HIGH").when(one | cover, "MEDIUM").otherwise("")
    )


def row_split(name: Column) -> Column:
    """Whether an image is a row cut from a page."""
    return name.rlike(r"\A.+_row\d+\.png\z")


def transcript_index(docs: DataFrame, id_col: str = "record_id", text_col: str = "text", more: tuple[str, ...] = (), folded: str | None = None) -> DataFrame:
    """record_id, words, runs (of digits), all digits in one string, and more of the columns; folded: as for classify."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("record_id"), t.alias("__text"), (F.col(folded) if folded else fold(t)).alias("__folded"), *more)
    words = F.array_distinct(F.regexp_extract_all("__folded", F.lit("[a-z]{2,}"), F.lit(0)))
    return d.select("record_id", words.alias("words"), digit_runs(F.col("__text")).alias("runs"), digits(F.col("__folded")).alias("all_digits"), *more)


def longest_word(value: Column) -> Column:
    """The longest letter run of four or more of the folded value, the first among equals; null if there is none."""
    found = F.filter(F.regexp_extract_all(fold(value), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) >= 4)
    return F.aggregate(found, F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull() | (F.length(x) > F.length(acc)), x).otherwise(acc))


# The scores from which a transcript's word or digit run backs one that it doesn't hold as it is.
LEAST = {"word": 82.0, "number": 85.0}


def word_support(asked: DataFrame, index: DataFrame) -> DataFrame:
    """record_id, word of the asked words that the record's transcript holds, up to their similarity."""
    words = asked.where("word <> ''").groupBy("record_id").agg(F.collect_set("word").alias("__asked"))
    met = words.join(index.select("record_id", "words"), "record_id")
    found = met.select("record_id", nearby.own_likes(F.col("__asked"), F.col("words"), LEAST["word"]).alias("__found"))
    return found.select("record_id", F.explode("__found").alias("word")).distinct()


def evidence_for(label: Column, value: Column, words: Column, runs: Column, all_digits: Column) -> Column:
    """struct(ok, kind, token): whether a transcript backs a value as it is, or else the token whose likes may.

    Numbers are backed by the transcript's digits in a row, derived values by nothing that could be looked up, and others by
    their longest word, if they have one of four letters; without words of its own a transcript backs none.
    """
    number = lambda n: F.when((n == "") | F.contains(all_digits, n), _backed(True)).otherwise(_backed(False, F.when(F.length(n) >= 3, "number"), n))
    word = lambda w: F.when(w.isNull() | F.array_contains(words, F.coalesce(w, F.lit(""))), _backed(True)).otherwise(_backed(False, F.when(F.size(words) > 0, "word"), w))
    derived = label.isin(*(n for n, _, v in FIELDS if v in DERIVED))
    return F.when(label.isin(*NUMBERS), let(digits(value), number)).when(derived, _backed(True)).otherwise(let(longest_word(value), word))


def _backed(ok: bool, kind: Column | None = None, token: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(ok).alias("ok"), (none if kind is None else kind).alias("kind"), (none if token is None else token).alias("token"))


def judged(cell: Column, supported: Column, strict: bool) -> Column:
    """struct(value, confidence, flags, dropped) of a cell (label, value, confidence, flags): flagged HIGH and MEDIUM become
    LOW; strict blanks what the transcript doesn't back."""
    return let(flagged(cell, supported), lambda f: weighed(cell, supported, strict, f))


def flagged(cell: Column, supported: Column) -> Column:
    """A cell's flags with those that verification adds."""
    label, value = cell["label"], cell["value"]
    backed = F.when(supported, F.array().cast("array<string>")).otherwise(F.array(F.lit("uncorroborated")))
    found = plausibility(value, label.isin(*DAYS), label.isin(*YEARS), label == "Height")
    return F.when(strip(value) != "", F.concat(cell["flags"], backed, found)).otherwise(cell["flags"])


def weighed(cell: Column, supported: Column, strict: bool, f: Column) -> Column:
    """struct(value, confidence, flags, dropped) of a cell whose flags are f."""
    value = cell["value"]
    filled = strip(value) != ""
    low = filled & (F.size(f) > 0) & cell["confidence"].isin("HIGH", "MEDIUM")
    drop = filled & ~supported & F.lit(strict)
    return F.struct(
        F.when(drop, "").otherwise(value).alias("value"), F.when(low, "LOW").otherwise(cell["confidence"]).alias("confidence"), f.alias("flags"),
        F.when(drop, strip(value)).alias("dropped"),
    )


def four_digits(value: Column) -> Column:
    """The year that a value's digits are, if they are four."""
    return F.when(digits(value).rlike(r"\A[0-9]{4}\z"), digits(value).try_cast("int"))


def verify(cells: DataFrame, index: DataFrame, spec: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """cells with flags; flagged HIGH and MEDIUM become LOW; strict blanks what the transcript doesn't back (dropped).

    A record's cells meet its transcript as one row.  spec: where given, cells of other fields are left out.
    """
    if spec is not None:
        cells = cells.join(F.broadcast(spec.select("label")), "label", "left_semi")
    out = verify_records(gathered(cells).join(index, "record_id", "left"), strict)
    return before_birth(spread(out).select(*cells.columns, "dropped"))


def verify_records(records: DataFrame, strict: bool = False) -> DataFrame:
    """records (record_id, cells, words, runs, all_digits) with judged cells; what the transcript doesn't hold as it is
    is compared with its own words or digit runs, distinct tokens once."""
    none = F.array().cast("array<string>")
    r = records.withColumns({"words": F.coalesce("words", none), "runs": F.coalesce("runs", none), "all_digits": F.coalesce("all_digits", F.lit(""))})
    seen = lambda c: evidence_for(c["label"], c["value"], F.col("words"), F.col("runs"), F.col("all_digits"))
    found_of = lambda c: F.struct(c["label"].alias("label"), seen(c).alias("e"))
    r = r.withColumn("__e", F.transform(F.filter("cells", lambda c: c["value"] != ""), found_of))
    asked = lambda kind: F.array_distinct(F.transform(F.filter("__e", lambda x: x["e"]["kind"] == kind), lambda x: x["e"]["token"]))
    r = r.withColumns({f"__{kind}": asked(kind) for kind in LEAST})
    r = r.withColumns({f"__like_{kind}": nearby.own_likes(F.col(f"__{kind}"), F.col(own), LEAST[kind]) for kind, own in (("word", "words"), ("number", "runs"))})
    among = lambda e, kind: F.coalesce((e["kind"] == kind) & F.array_contains(F.col(f"__like_{kind}"), e["token"]), F.lit(False))
    held = lambda e: e["ok"] | among(e, "word") | among(e, "number")
    own = lambda c: F.get(F.filter("__e", lambda x: x["label"] == c["label"]), F.lit(0))["e"]
    judge = lambda c: let(let(own(c), held), lambda ok: judged(c, ok, strict))
    made = changed(r, ("value", "confidence", "flags", "dropped"), lambda c: c["value"] != "", judge)
    return made.drop("__e", *(f"__{p}{kind}" for kind in LEAST for p in ("", "like_")))


def verify_cells(cells: DataFrame, strict: bool = False) -> DataFrame:
    """The same over rows of cells that carry their transcript's words, runs and all_digits, which go."""
    none = F.array().cast("array<string>")
    e = evidence_for(F.col("label"), F.col("value"), F.coalesce("words", none), F.coalesce("runs", none), F.coalesce("all_digits", F.lit("")))
    r = cells.withColumn("__e", F.when(F.col("value") != "", e))
    ask = lambda kind: F.when(F.col("__e.kind") == kind, F.array("__e.token"))
    r = r.withColumns({f"__like_{kind}": nearby.own_likes(ask(kind), F.col(own), LEAST[kind]) for kind, own in (("word", "words"), ("number", "runs"))})
    held = F.coalesce(F.col("__e.ok"), F.lit(True)) | (F.size("__like_word") > 0) | (F.size("__like_number") > 0)
    r = r.drop("words", "runs", "all_digits").withColumn("__ok", held)
    cell = {c: F.col(c) for c in ("label", "value", "confidence", "flags")}
    r = r.withColumn("__f", flagged(cell, F.col("__ok")))
    made = weighed(cell, F.col("__ok"), strict, F.col("__f"))
    fresh = ("value", "confidence", "flags", "dropped")
    return r.select(*(F.col(c) for c in cells.columns if c not in (*fresh, "words", "runs", "all_digits")), *(made[c].alias(c) for c in fresh))


LATER = ("Discharge Year", "Death Year", "Classe Year")


def before_birth_flags(label: Column, value: Column, birth: Column) -> Column:
    """Whether a later year of a record lies before its birth year."""
    year = four_digits(value)
    return F.coalesce(label.isin(*LATER) & (year < birth) & (year > 0) & (birth > 0), F.lit(False))


def before_birth(cells: DataFrame) -> DataFrame:
    """Later years of a record that lie before its birth year are flagged and LOW."""
    birth = F.max(F.when(F.col("label") == "Birth Year", four_digits(F.col("value")))).over(Window.partitionBy("record_id"))
    c = cells.withColumn("__birth", birth)
    late = before_birth_flags(F.col("label"), F.col("value"), F.col("__birth"))
    return c.withColumn("flags", F.when(late, F.concat("flags", F.array(F.lit("before-birth")))).otherwise(F.col("flags"))).withColumn(
        "confidence", F.when(late, "LOW").otherwise(F.col("confidence"))
    ).drop("__birth")
