"""Publishing results: in record order, whole or not at all, and never over something by accident."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def reserve(spark: SparkSession, inputs: list[str], outputs: list[str], force: bool = False) -> None:
    """Conflicts are errors before any job starts: outputs twice, over an input, or over something without force."""
    whole = lambda p: _fs(spark, p)[0].makeQualified(_fs(spark, p)[1]).toString()
    names = [whole(p) for p in outputs]
    if len(set(names)) < len(names):
        raise ValueError("two outputs have one path")
    if set(names) & {whole(p) for p in inputs}:
        raise ValueError("an output is an input")
    for p in outputs:
        if not force and exists(spark, p):
            raise ValueError(f"{p} exists; use force to replace it")


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


@contextmanager
def staged(df: DataFrame, near: str) -> Iterator[DataFrame]:
    """`df` written once beside `near`, for several outputs and reports that read from there; gone afterwards.

    A run's kernels are evaluated once this way, however many tables are taken from their facts, and with pruned
    columns; the folder is the output's, which the driver and all executors share.
    """
    spark = df.sparkSession
    path = f"{near.rstrip('/')}.{uuid.uuid4().hex}.facts"
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)


def _replace(spark: SparkSession, temp: str, path: str) -> None:
    """Rename `temp` to `path`; what was there steps aside and goes last, or comes back."""
    fs, where = _fs(spark, path)
    aside = None
    if fs.exists(where):
        aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.old"
        if not fs.rename(where, _fs(spark, aside)[1]):
            raise OSError(f"cannot move {path} aside")
    try:
        done = fs.exists(_fs(spark, temp)[1]) and fs.rename(_fs(spark, temp)[1], where)
    except Py4JJavaError:
        done = False
    if not done:
        if aside:
            fs.rename(_fs(spark, aside)[1], where)
        raise OSError(f"cannot rename {temp} to {path}")
    if aside:
        remove(spark, aside)


def publish(df: DataFrame, path: str, force: bool = False, order: tuple[str, ...] = ("record_index",), codec: str = "zstd", block_bytes: int | None = None, level: int | None = None) -> None:
    """Write beside `path`, sorted by `order` (as it comes if that is empty), then rename; what was there goes only at the end, and only with force."""
    spark = df.sparkSession
    if block_bytes is not None and block_bytes <= 0:
        raise ValueError("the block size must be positive")
    reserve(spark, [], [path], force)
    own = [c for c in order if c in df.columns]
    temp = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    writer = (df.orderBy(*own) if own else df).write.option("compression", codec)
    if block_bytes:
        writer = writer.option("parquet.block.size", block_bytes)
    if level is not None:
        writer = writer.option(f"parquet.compression.codec.{codec}.level", level)
    try:
        writer.parquet(temp)
        if not force and exists(spark, path):
            raise ValueError(f"{path} exists; use force to replace it")
        _replace(spark, temp, path)
    finally:
        fs, where = _fs(spark, temp)
        if fs.exists(where):
            fs.delete(where, True)


def as_json(report: dict[str, Any]) -> str:
    return json.dumps(report, indent=2, sort_keys=True, default=str)


def as_tsv(report: dict[str, Any]) -> str:
    """Dotted keys, [i] for places in lists, nothing for null."""

    def walk(value: Any, key: str):
        if isinstance(value, dict):
            for k in sorted(value):
                yield from walk(value[k], f"{key}.{k}" if key else str(k))
        elif isinstance(value, (list, tuple)):
            for i, x in enumerate(value):
                yield from walk(x, f"{key}[{i}]")
        else:
            yield f"{key}\t{'' if value is None else str(value).lower() if isinstance(value, bool) else value}"

    return "\n".join(walk(report, "")) + "\n"


def write_text(spark: SparkSession, path: str, text: str, force: bool = False) -> None:
    reserve(spark, [], [path], force)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, where = _fs(spark, temp)
    out = fs.create(where, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    _replace(spark, temp, path)


def rows(df: DataFrame) -> list[dict[str, Any]]:
    """A report's table, as small as its groups."""
    return [r.asDict(recursive=True) for r in df.collect()]
