"""Scans. One function per input format of SURVEY §2.1; all return lazy DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.operators.curate import looked_up

PAIRS = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "prompt", "machine_text", "human_text", "model", "source", "generator_id")] + [T.StructField("temperature", T.DoubleType()), T.StructField("word_count", T.IntegerType()), T.StructField("generated_at", T.StringType())])
#: What a missing column of a bundle holds.
DEFAULTS = {"domains": "-", "generators": "-", "attacks": "none", "sources": "-"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder (S1, S6, S8); ``timestamp[us]`` columns come as TIMESTAMP_NTZ."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where the path does not exist."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def csv(spark: SparkSession, path: str, schema: T.StructType | None = None, null: str = "") -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes (S2); ``null`` is null, quoted or not."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", null).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    return (reader.schema(schema) if schema else reader).csv(path)


def csv_quota(spark: SparkSession, path: str, want: int, text: str = "text") -> DataFrame:
    """The first ``want`` rows of a CSV, in file order, with its text column, or its first one where it has none (S3)."""
    rows = csv(spark, path)
    name = next((c for c in rows.columns if c.lower() == text), rows.columns[0])
    return rows.select(F.col(name).alias(text), F.monotonically_increasing_id().alias("_at")).orderBy("_at").limit(want).drop("_at")


def jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank and malformed lines are dropped (S4). Undecodable bytes are replaced by the decoder."""
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    rows = lines.select(F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return rows.filter("_bad IS NULL").drop("_bad")


def jsonl_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of text files as ``text``."""
    return spark.read.text(path).select(F.col("value").alias("text")).filter(F.length(F.trim("text")) > 0)


def with_file_part(spark: SparkSession, glob: str, schema: T.StructType, name: str = "generator") -> DataFrame:
    """JSON lines of many files with the part of the file name after the last underscore, or the whole stem."""
    rows = spark.read.schema(schema).json(glob)
    return rows.withColumn(name, F.regexp_extract(F.col("_metadata.file_name"), r"([^_]+?)(\.[^._]+)?$", 1))


def metadata_links(spark: SparkSession, glob: str, corrections: dict[str, str] | None = None) -> DataFrame:
    """``name``, ``model_id``, ``submission``, ``link``, ``id_corrected_from`` of metadata JSON files with a model link.

    Links to spaces are no models. ``corrections`` maps misspelled ids; the name falls back to the folder's.
    """
    rows = spark.read.option("multiLine", True).schema("detector_name string, huggingface_link string").json(glob)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    link = F.trim(F.coalesce("huggingface_link", F.lit("")))
    rows = rows.select(F.coalesce("detector_name", folder).alias("name"), folder.alias("submission"), link.alias("link"))
    return corrected_ids(rows.withColumn("raw", model_id(F.col("link"))).filter("raw <> ''"), "raw", corrections or {}).select("name", "model_id", "submission", "link", "id_corrected_from")


def model_id(link: Column) -> Column:
    """Owner and name of a model link; '' where it is none."""
    return F.regexp_extract(link, r"huggingface\.co/(?!spaces/)([\p{L}\p{N}_.-]+/[\p{L}\p{N}_.-]+)", 1)


def corrected_ids(rows: DataFrame, raw: str, corrections: dict[str, str]) -> DataFrame:
    """``rows`` with ``model_id`` (the corrected id) and ``id_corrected_from`` (the raw one where it differs)."""
    fixed = looked_up(F.col(raw), corrections, None)
    return rows.withColumn("model_id", F.coalesce(fixed, raw)).withColumn("id_corrected_from", F.when(F.col("model_id") != F.col(raw), F.col(raw)))


def resolve(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Columns by name whatever their case, renamed as wanted."""
    return df.select(*[F.col(f"`{w}`").alias(w) for w in wanted])


def selected(df: DataFrame, include: dict[str, Sequence] | None = None, exclude: dict[str, Sequence] | None = None) -> DataFrame:
    """Rows in all include lists and in no exclude list, compared as strings (P3, P4); none left is an error."""
    for lists, keep in ((include or {}, True), (exclude or {}, False)):
        for column, values in lists.items():
            inside = F.coalesce(F.col(column).cast("string").isin([str(v) for v in values]), F.lit(False))
            df = df.filter(inside if keep else ~inside)
    if df.isEmpty():
        raise ValueError("no row passes the selection")
    return df


def label_is(column: Column, value) -> Column:
    """1 where the label equals the machine value, else 0."""
    return (column == F.lit(value)).cast("int")


def unfold_pairs(pairs: DataFrame, key: str, generator: str) -> DataFrame:
    """A human row and a machine row of each paired record with that text."""
    both = F.array(
        F.struct(F.lit(0).alias("label"), F.col("human_text").alias("text"), F.lit("human").alias("generator")),
        F.struct(F.lit(1).alias("label"), F.col("machine_text").alias("text"), F.col(generator).alias("generator")),
    )
    return pairs.select(key, F.inline(both)).filter("text IS NOT NULL")


def assemble(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of bundles by name; missing or null metadata get their defaults."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items() if c in out.columns})
