"""What the operators of this package share: words, table access and tables written for reuse."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: the space and U+0009 to U+000D.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than BLANKS, in order; an empty array if there are none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def workspace(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of our own only where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return str(held.get())
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tracelode-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def then(batches: Iterator, last: Callable[[], None] = lambda: None) -> Iterator:
    """The batches; after the last one ``last`` is called and the worker, which stays for later tasks, gives its idle memory back."""
    yield from batches
    last()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def rows_of(batches: Iterator) -> Iterator[dict]:
    """The rows of Arrow batches, one at a time: rows that hold much are not turned into Python objects together."""
    for b in batches:
        for i in range(b.num_rows):
            yield {n: b.column(n)[i].as_py() for n in b.schema.names}


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/tracelode/{name}-{uuid.uuid4().hex}"


def written_at(df: DataFrame, name: str, compression: str | None = None) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: computed once, and safe from lost executors. Also the folder."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return written_at(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing will read again."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
