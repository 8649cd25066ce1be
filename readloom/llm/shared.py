"""What the operators share: intermediate tables, row identities, native helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import ship


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = os.path.join(tempfile.gettempdir(), "readloom-shared")
    return named


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/readloom-{spark.sparkContext.applicationId}"


_SCOPE: ContextVar[str] = ContextVar("scope", default="")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{_SCOPE.get() or own_folder(spark)}/{what}-{uuid.uuid4().hex}"


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What operators write between their steps in here goes at the end; the function given writes a table that stays."""
    own = f"{own_folder(spark)}/scope-{uuid.uuid4().hex}"

    def keep(df: DataFrame, what: str) -> DataFrame:
        return _written(df, f"{own_folder(spark)}/{what}-{uuid.uuid4().hex}")

    token = _SCOPE.set(own)
    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        remove(spark, own)


def clean(spark: SparkSession) -> None:
    """Remove what the operators of this application have written between their steps; results that still read it must be saved before."""
    remove(spark, own_folder(spark))


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again: lineage ends there, so a lost
    executor costs a re-read and not a recomputation."""
    return _written(df, new_folder(df.sparkSession, what))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*written: DataFrame) -> None:
    """Remove tables of materialize() that no frame reads any more."""
    for df in written:
        if path := getattr(df, "_written", None):
            remove(df.sparkSession, path)


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that `df` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def numbered(docs: DataFrame, what: str) -> tuple[DataFrame, str]:
    """`docs` with a number a row, written once so that every later read sees the same numbers, and the column's name."""
    key = free_name(docs, "row_key")
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), what), key


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Before Python runs on executors: the code is sent, and Arrow batches hold so many rows at most, as texts may be long."""
    ship.ensure(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= rows:  # only ever less, as frames made before run with it too
        spark.conf.set(name, str(rows))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once a row, also where `body` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
