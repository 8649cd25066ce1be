"""Read data sets in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators.sample import span
from readloom.schema import Presence, checked, reads_of


def read(spark: SparkSession, path: str, start: int = 0, end: int | None = None, check: bool = False) -> DataFrame:
    """Reads at `path`, of the span [start, end). A filter on record_index reaches the scan, so row groups outside are skipped."""
    df = spark.read.parquet(path)
    if "record_index" not in df.columns:
        df = with_index(df)
    df = reads_of(df)
    # a start beyond the end is an error; the count reads footers alone
    out = span(df, start, end, df.count() if start else None)
    return checked(out) if check else out


def with_index(df: DataFrame) -> DataFrame:
    """record_index from each file's row numbers, files in order of their names; one count a file reaches the driver."""
    spark = df.sparkSession
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sizes = placed.groupBy("__file").agg(F.count("*").alias("n")).collect()
    starts, before = [], 0
    for r in sorted(sizes, key=lambda r: r["__file"]):
        starts.append((r["__file"], before))
        before += r["n"]
    offsets = spark.createDataFrame(starts, "__file string, __start long")
    return placed.join(F.broadcast(offsets), "__file").withColumn("record_index", F.col("__start") + F.col("__row")).drop("__file", "__row", "__start")


def describe(df: DataFrame) -> Presence:
    return Presence.of(df)
