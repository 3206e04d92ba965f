"""The delivery table: one row a record, a fixed order of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.functions.text import strip
from concordia.operators.fields import LABELS
from concordia.operators.select import row_of

# The delivery template's columns in order.
TEMPLATE = (
    "ImageName", "DocType", "Enlistment City", "Enlistment Département", "Classe Year", "Prefix", "Given Name", "Surname", "Suffix", "Birth Day",
    "Birth Month", "Birth Year", "Birth Commune", "Birth Canton", "Birth Département", "Hair Color", "Eye Color", "Height", "Father Prefix",
    "Father Given Name", "Father Surname", "Father Suffix", "Deceased Father", "Mother Prefix", "Mother Given Name", "Mother Maiden Name",
    "Mother Surname", "Mother Suffix", "Deceased Mother", "Domicile", "Residence Commune", "Residence Canton", "Regiment", "Unit", "Branch",
    "Compagnie", "Battalion", "Rank", "Discharge Day", "Discharge Month", "Discharge Year", "Death Day", "Death Month", "Death Year",
    "Death Commune", "Occupation", "Entry Number", "Event Type",
)
RENAMED = {"Enlistment Département": "Enlistment Departement", "Birth Département": "Birth Departement"}


def template(cells: DataFrame, images: DataFrame, columns: tuple[str, ...] = TEMPLATE, value: str = "value") -> DataFrame:
    """One row for each record (an image's name) of cells that is among images, sorted by page and row.

    value: the column that is delivered; corrected cells have the readers' own values as raw.
    """
    own = cells.join(images.select(F.col("name").alias("record_id")).distinct(), "record_id", "left_semi")
    wide = own.groupBy("record_id").pivot("label", list(LABELS)).agg(F.max(value))
    parent, idx = row_of("record_id")
    out = wide.withColumn("__parent", parent).withColumn("__row", idx).orderBy("__parent", "__row", "record_id")

    def column(c: str):
        source = {"ImageName": "__parent", "DocType": "Event Type"}.get(c, RENAMED.get(c, c))
        return F.coalesce(F.col(f"`{source}`"), F.lit("")).alias(c)

    return out.select(*map(column, columns))


def field_map(spec: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """label, key, vocab of the fields in order, and, of cells, how many of each are filled."""
    out = spec.select("ord", "label", "key", F.coalesce("vocab", F.lit("")).alias("vocab"))
    if cells is not None:
        filled = cells.groupBy("label").agg(F.count_if(strip(F.col("value")) != "").alias("filled"))
        out = out.join(F.broadcast(filled), "label", "left").withColumn("filled", F.coalesce("filled", F.lit(0)))  # a row for each field
    return out.orderBy("ord").drop("ord")


def field_lines(spec: DataFrame) -> DataFrame:
    """The fields in order as one text for a model: a line for each, with its vocabulary, if it has one."""
    line = F.concat(F.lit('- "'), F.col("label"), F.lit('"'), F.coalesce(F.concat(F.lit("  ("), F.col("vocab"), F.lit(")")), F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))  # a row for each field
    return spec.agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("prompt"))


#: Fixed value: so many characters of a transcript go to extraction.
EXTRACTED = 6000


def field_prompt(spec: DataFrame, transcripts: DataFrame, text_col: str = "text") -> DataFrame:
    """transcripts with prompt: the fields, and the part of the transcript that a model extracts them from."""
    lines = field_lines(spec).head()[0]  # one short text
    return transcripts.withColumn("prompt", F.concat(F.lit(lines + "\n\n"), F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, EXTRACTED)))
