"""Images, dictionaries and the store of results as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The image formats that are read.
IMAGE_TYPES = ("j2k", "jp2", "jpg", "jpeg", "png", "tif", "tiff", "bmp")


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """name, path, stem of the images below a folder, by name; of equal names the path that sorts last stays.

    Only paths and sizes are read, not contents.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    found = found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1)).isin(*IMAGE_TYPES))
    named = found.withColumn("name", F.regexp_extract("path", r"([^/]+)\z", 1))
    last = named.groupBy("name").agg(F.max(F.struct("path", "length", "modificationTime")).alias("f"))
    return last.select("name", "f.path", "f.length", F.regexp_replace("name", r"\.[^.]+\z", "").alias("stem")).orderBy("name")


def default_images(found: DataFrame) -> DataFrame:
    """The images of a project whose folder nobody set: its .j2k files below a folder named Images, or all if none is there."""
    j2k = found.where(F.lower("name").endswith(".j2k"))
    within = j2k.where(F.array_contains(F.split(F.regexp_replace("path", r"/[^/]*\z", ""), "/"), "Images"))
    return within if not within.isEmpty() else j2k


def source_folder(path: str) -> str:
    """The folder a user names, without blanks and quotes around it; one that isn't there is an error."""
    import os

    folder = path.strip().strip('"').strip("'")
    if "://" not in folder and not os.path.isdir(folder):
        raise NotADirectoryError(folder)
    return folder


def newest(found: DataFrame) -> DataFrame:
    """The latest modification of any of the files, which dates what is made from them."""
    return found.agg(F.max("modificationTime").alias("newest"))


def merge_derived(images: DataFrame, derived: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """images and the derived ones (name, path, stem, parent) whose parent is there; a derived image replaces one of its
    name.  files: the paths that there are; derived images whose file has gone are left out."""
    own = derived.join(images.select(F.col("stem").alias("parent")).distinct(), "parent", "left_semi").select("name", "path", "stem")
    if files is not None:
        own = own.join(files.select("path").distinct(), "path", "left_semi").select("name", "path", "stem")
    return images.select("name", "path", "stem").join(own, "name", "left_anti").unionByName(own)


def read_dictionary(spark: SparkSession, path: str, dictkey: str, src: int = 0) -> DataFrame:
    """dictkey, value, src, ord from the first column of a text or CSV export, its heading left out."""
    rows = spark.read.option("header", True).csv(path)
    first = F.col(f"`{rows.columns[0]}`")
    # A file's rows are numbered in their order; files go by name, whatever the order in which they are listed and split.
    placed = rows.select(first.alias("value"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    order = F.row_number().over(Window.partitionBy("f").orderBy("b", "i"))
    files = [r.f for r in placed.select("f").distinct().orderBy("f").collect()]  # a row for each file of one dictionary
    number = F.array_position(F.array(*map(F.lit, files)), F.col("f")) if files else F.lit(0)
    return placed.select(F.lit(dictkey).alias("dictkey"), "value", F.lit(src).alias("src"), (number.cast("long") * (1 << 40) + order).alias("ord"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A store written as Parquet, or as JSON lines; what can't be read is an error."""
    return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str = "name", order: str | None = None) -> DataFrame:
    """old with the rows of new in place of those with their keys; of several new rows of a key the last by order."""
    if order:
        w = Window.partitionBy(key).orderBy(F.desc(order))
        new = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def swap(spark: SparkSession, path: str, new: DataFrame, key: str = "name", order: str | None = None) -> DataFrame:
    """The store at path with new rows in place of those of the same key; readers see the old table or the new one.

    The result is written beside the store and takes its name when it is whole; the old one goes last.  A run that stops
    between the renames leaves the old table under path.old.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = place(path).getFileSystem(conf)
    there = fs.exists(place(path))
    out = upsert(read_results(spark, path), new, key, order) if there else new
    fs.delete(place(path + ".new"), True)
    out.write.parquet(path + ".new")
    if there:
        fs.delete(place(path + ".old"), True)
        fs.rename(place(path), place(path + ".old"))
    fs.rename(place(path + ".new"), place(path))
    fs.delete(place(path + ".old"), True)
    return read_results(spark, path)
