"""Which images a run takes, and the listing of images with what is known of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.operators.verify import row_split


class EmptySelection(ValueError):
    """Nothing is left to process."""


def select_images(
    images: DataFrame, results: DataFrame, names: DataFrame | None = None, doctype: str | None = None, task: str = "full", unprocessed: bool = False
) -> DataFrame:
    """images (name, ...) to process; results have name, event_type and postprocessed.

    An explicit list of names comes before a doctype.  Postprocessing takes only images with a result.  Unprocessed ones
    are those without a result, for postprocessing those whose result isn't postprocessed.
    """
    out = images
    if names is not None:
        out = out.join(names.select("name").distinct(), "name", "left_semi")
    elif doctype:
        out = out.join(results.where(F.col("event_type") == doctype).select("name"), "name", "left_semi")
    if task == "postprocess":
        out = out.join(results.select("name"), "name", "left_semi")
        if unprocessed:
            out = out.join(results.where(F.coalesce("postprocessed", F.lit(False))).select("name"), "name", "left_anti")
    elif unprocessed:
        out = out.join(results.select("name"), "name", "left_anti")
    return out


def require_some(selected: DataFrame) -> DataFrame:
    if selected.isEmpty():
        raise EmptySelection("no image is selected")
    return selected


def row_of(name: Column | str) -> tuple[Column, Column]:
    """Parent and row number of a row cut from a page; else the stem and 0."""
    c = F.col(name) if isinstance(name, str) else name
    p = r"\A(.+)_row(\d+)\.png\z"
    is_row = c.rlike(p)
    stem = F.regexp_replace(c, r"(?s)(?<=.)\.[^.]*\z", "")
    return F.when(is_row, F.regexp_extract(c, p, 1)).otherwise(stem), F.when(is_row, F.regexp_extract(c, p, 2).try_cast("int")).otherwise(F.lit(0))


STATS = ("filled", "high", "medium", "low", "conflicts", "flagged")


def listing(images: DataFrame, results: DataFrame, converted: DataFrame | None = None) -> DataFrame:
    """name, parent, row_idx, rows of its page, which row of how many it is, has_rows, processed, event_type, n_diffs of
    every image, and those of STATS that results have; converted: the names of converted images, which are noted."""
    parent, idx = row_of("name")
    cut = row_split(F.col("name"))
    i = images.select("name").withColumn("parent", parent).withColumn("row_idx", idx).withColumn("is_row", cut)
    rows = i.where("is_row").groupBy("parent").agg(F.count("*").alias("rows"))
    stats = [c for c in STATS if c in results.columns]
    r = results.select("name", "event_type", "n_diffs", *stats, F.lit(True).alias("processed"))
    out = i.join(rows, "parent", "left").join(r, "name", "left")
    if converted is not None:
        there = converted.select(F.col("name").alias("png")).distinct().withColumn("converted", F.lit(True))
        out = out.withColumn("png", files_of(F.col("name"))[0]).join(there, "png", "left")
    return out.select(
        "name", "parent", "row_idx", F.when(F.col("is_row"), F.coalesce("rows", F.lit(1))).otherwise(F.lit(1)).cast("long").alias("rows"),
        F.when(F.col("is_row"), F.concat_ws(" of ", F.col("row_idx").cast("string"), F.col("rows").cast("string"))).otherwise("").alias("row_info"),
        (F.col("rows").isNotNull() & ~F.col("is_row")).alias("has_rows"), F.coalesce("processed", F.lit(False)).alias("processed"),
        F.coalesce("event_type", F.lit("")).alias("event_type"), F.coalesce("n_diffs", F.lit(0)).cast("long").alias("n_diffs"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in stats), *([F.coalesce("converted", F.lit(False)).alias("converted")] if converted is not None else []),
    )


class NotProcessed(LookupError):
    """There is no result of that name."""


def result_of(results: DataFrame, name: str) -> DataFrame:
    """The result of that name; one that isn't there is an error."""
    own = results.where(F.col("name") == name)
    if own.isEmpty():
        raise NotProcessed(name)
    return own


def folders(images: DataFrame, path: str = "path") -> DataFrame:
    return images.select(F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1).alias("folder")).distinct().orderBy("folder")


def progress(done: Column, total: Column, share: Column, elapsed: Column) -> tuple[Column, Column]:
    """Fraction done, and seconds left once 2 % are done."""
    frac = (done + share / 100) / F.greatest(F.lit(1), total)
    return frac, F.when(frac > 0.02, elapsed / frac - elapsed)


def files_of(name: Column) -> tuple[Column, Column, Column]:
    """Names of the converted, the straightened and the enhanced image of a file; files of one stem share them."""
    stem = F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*\z", "")
    return tuple(F.concat(stem, F.lit(x)) for x in (".png", "_deskewed.png", "_preprocessed.png"))
