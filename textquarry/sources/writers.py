"""Sinks of SURVEY §2.2. Each writes in parallel; none gathers rows on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators.report import upsert
from textquarry.storage import Scratch


#: Null in a CSV export.
NULL_FIELD = "\\N"


def parquet_by(df: DataFrame, path: str, *by: str) -> None:
    """Parquet, one folder per value of the given columns (K1, K2, K9)."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def csv_export(df: DataFrame, path: str) -> None:
    """CSV with header; quotes are doubled, line breaks quoted, null is ``NULL_FIELD`` and the empty text is quoted (K3)."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", NULL_FIELD).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def jsonl(df: DataFrame, path: str, keep_nulls: bool = False) -> None:
    """JSON lines; null fields are left out unless kept (K4, K6)."""
    df.write.mode("overwrite").option("ignoreNullFields", not keep_nulls).json(path)


def finite_only(scores: DataFrame, path: str, score: str = "score") -> DataFrame | None:
    """Publish a score cache only if all scores are finite (K15): what was published, else None.

    The scorer runs once: its rows are written beside the path, checked there and moved.
    """
    spark = scores.sparkSession
    staged = f"{path.rstrip('/')}.staged"
    scores.write.mode("overwrite").parquet(staged)
    bad = F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    files = path_of(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    fine = spark.read.parquet(staged).filter(bad).isEmpty()
    if fine:
        files.delete(path_of(path), True)
        files.rename(path_of(staged), path_of(path))
        return spark.read.parquet(path)
    files.delete(path_of(staged), True)
    return None


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> None:
    """Replace rows of a stored table by key and add new ones (K8).

    The whole new table is written beside the old one before two renames swap them; where a failure fell between
    the renames, the next call puts the old table back first. ``storage.Versions`` keeps tables without any gap.
    """
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    live, staged, before = path_of(path), path_of(f"{path.rstrip('/')}.staged"), path_of(f"{path.rstrip('/')}.before")
    files = live.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(before):
        if files.exists(live):
            files.delete(before, True)
        else:
            files.rename(before, live)
    merged = upsert(spark.read.parquet(path), new, keys) if files.exists(live) else new
    merged.write.mode("overwrite").parquet(staged.toString())
    if files.exists(live):
        files.rename(live, before)
    files.rename(staged, live)
    files.delete(before, True)


def predictions(scores: DataFrame, path: str, key: str = "id", score: str = "score") -> None:
    """Predictions as one JSON array of ``id`` and ``score`` (K6): a single document, so one task streams its lines."""
    rows = scores.select(F.to_json(F.struct(F.col(key).cast("string").alias("id"), F.col(score).cast("double").alias("score"))).alias("value"))
    opened = scores.sparkSession.range(1).select(F.lit("[").alias("value"))
    closed = scores.sparkSession.range(1).select(F.lit("]").alias("value"))
    comma = F.when(F.monotonically_increasing_id() > 0, ",").otherwise("")  # counts from 0 within the one partition
    lines = opened.union(rows.coalesce(1).select(F.concat(comma, "value").alias("value"))).union(closed)
    lines.coalesce(1).write.mode("overwrite").text(path)


def results_by_run(results: DataFrame, path: str, by: tuple[str, ...] = ("detector", "variant")) -> None:
    """One folder of JSON lines for each run (K9)."""
    results.write.mode("overwrite").partitionBy(*by).json(path)


def round_trip(spark: SparkSession, bundle: DataFrame, kind: str) -> DataFrame:
    """Write an export of a split bundle in a format and read it back."""
    from textquarry.sources.readers import csv

    rows = bundle.select("row_id", "texts", "labels", "sources", "split")
    at = Scratch(spark, "export").path(kind)
    if kind == "parquet":
        parquet_by(rows, at, "split")
        back = spark.read.parquet(at)
    elif kind == "json":
        jsonl(rows, at)
        back = spark.read.schema(rows.schema).json(at)
    else:
        csv_export(rows, at)
        back = csv(spark, at, rows.schema, NULL_FIELD)
    return back.select("row_id", "texts", "labels", "sources", "split")
