"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of the input folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts are of any length, so a batch is bounded by its bytes; a batch stands several times in a worker and beside the JVM's heap.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, also where the driver alone has it on its path; bound Arrow batches."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound) in ("67108864b", "64m", str(64 << 20)):  # as Spark has it, so nobody chose it
        spark.conf.set(bound, str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    have = [os.path.abspath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if root in have or os.path.abspath(os.getcwd()) == root or getattr(spark.sparkContext, "_concordia_shipped", False):
        return
    import zipfile

    out = os.path.join(tempfile.mkdtemp(), "concordia_src.zip")  # the driver serves this file to its executors
    with zipfile.ZipFile(out, "w") as z:
        for d, _, names in os.walk(os.path.join(root, "concordia")):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(d, n)
                    z.write(p, os.path.relpath(p, root))
    spark.sparkContext.addPyFile(out)
    spark.sparkContext._concordia_shipped = True


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir; the setting is made only where it is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="concordia-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def known_bytes(df: DataFrame) -> int | None:
    """The size of what is read, as the plan has it from its files; None where it doesn't know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return None if size >= 1 << 60 else size


def merged(df: DataFrame, task_bytes: int = 4 << 20) -> DataFrame:
    """The rows with small splits put together, so that a table of many tiny files doesn't become one of many tiny files
    again; splits of task_bytes or more stay as they are."""
    size = known_bytes(df)
    if size is None:
        return df
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // task_bytes)))


def files_for(rows: int, each: int) -> int:
    """How many files so many rows take: each rows in one, up to a hundred thousand files; beyond that ten million."""
    return max(1, min(-(-rows // each), max(100_000, -(-rows // 10_000_000))))


def written(df: DataFrame, what: str, rows: int | None = None, each: int = 100_000, spread: bool = False) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again; this cuts the lineage.

    rows: about how many there are, where that is known: the number of files follows from it, not from the number of
    shuffle partitions, since a table of few rows in many files costs more to open than to read.  The last stage then
    has as many tasks; spread: it has as many as before, and the rows are dealt to the files after it.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.repartition(files_for(rows, each)) if spread else df.coalesce(files_for(rows, each))
    path = scratch(spark, what)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)  # nobody waits for a mark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(*superseded: DataFrame) -> None:
    """Deletes the files of tables that written() made, once what was derived from them is written itself."""
    for df in superseded:
        if path := getattr(df, "_written_at", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def free_name(taken, name: str) -> str:
    """A column name like this one that none of the taken ones equals, upper case or lower."""
    held = {c.lower() for c in taken}
    name = f"__{name}"
    while name.lower() in held:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(key: Column, m: int) -> Column:
    """crc32 of the key as text, modulo m; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def whole_text(df: DataFrame, text_col: str = "text") -> Column:
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def arrow_batches(rows: Iterator[dict], schema) -> Iterator:
    """Record batches from dicts of columns."""
    import pyarrow as pa

    for cols in rows:
        yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)


_HELD: dict[str, Callable[[], None]] = {}


def holds(what: str, drop: Callable[[], None]) -> None:
    """Tells that this worker keeps a cache of that name for its next tasks, and how to drop it."""
    _HELD[what] = drop


def release(*kept: str) -> None:
    """Drops the caches that tasks of other operators left in this worker, but for those kept, and gives their memory back.

    A worker outlives its tasks and stands beside its executor's heap, so a task that begins calls this first.
    """
    others = [what for what in _HELD if what not in kept]
    for what in others:
        _HELD.pop(what)()
    if others:
        trim()


def trim() -> None:
    """Gives memory that was freed back to the system; it stays with the process otherwise."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    given = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if given is not None:
        given(0)


def tokenizer_path(name: str) -> str:
    """A vocabulary file's place; files are read where the package of public tokenizers has them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def single_threaded() -> None:
    """Libraries in a worker use one thread, as a task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    sys.setswitchinterval(0.05)
