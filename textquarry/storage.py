"""Intermediate tables in the shared folder of the cluster.

Iterative operators cut their lineage by writing Parquet below
``spark.checkpoint.dir`` (shared by all executors), so that a lost executor costs
a re-read and never a recomputation of the whole history. Where a local session
names no such folder (tests, a laptop), a private temporary one is made and set; on a
cluster that is an error. What an operator returns stays until the application ends.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a fresh temporary one only where a local session has it unset."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="textquarry-")
        atexit.register(shutil.rmtree, known[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that end within it remove their shuffle files."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Scratch:
    """Named tables of one operator run, each written once and read back.

    ``lean``: tables are compressed harder and the shuffle files of a table go once it is
    written, not when the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, label: str, lean: bool = False) -> None:
        self.spark = spark
        self.lean = lean
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[str] = []

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as a scan: exact statistics, no lineage."""
        at = self.path(name)
        if self.lean:
            with _shuffles_removed(self.spark):
                df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        else:
            df.write.mode("overwrite").parquet(at)
        if not self.tables:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(where)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._tq_path = at  # type: ignore[attr-defined]
        self.tables.append(at)
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table of this run that nothing will read again."""
        at = getattr(df, "_tq_path", None)
        if at in self.tables:
            self.tables.remove(at)
            self._delete(at)

    def finish(self, *kept: DataFrame) -> None:
        """Remove all tables of this run but those given: what an operator returns must be read from these alone."""
        stay = {getattr(df, "_tq_path", None) for df in kept}
        for at in [t for t in self.tables if t not in stay]:
            self.tables.remove(at)
            self._delete(at)

    def _delete(self, at: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


class Versions:
    """A table kept below a folder, one subfolder per version.

    A version exists once its write has been committed, so a failed write leaves the last one and
    readers never see a hole. Older versions are removed but for ``keep``.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2) -> None:
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Committed versions in order."""
        if not self._files.exists(self._folder):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(self._folder)]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._files.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def at(self, number: int) -> str:
        return f"{self.path}/v{number:06d}"

    def read(self, number: int | None = None) -> DataFrame | None:
        """A version, the last one unless given; None where there is none."""
        known = self.numbers()
        if not known or number is not None and number not in known:
            return None
        return self.spark.read.parquet(self.at(known[-1] if number is None else number))

    def write(self, df: DataFrame, number: int | None = None) -> DataFrame:
        """Commit ``df``, which may read the last version, as the next one, or as the given one."""
        known = self.numbers()
        number = number or (known[-1] + 1 if known else 1)
        df.write.mode("overwrite").parquet(self.at(number))
        for old in known[: max(0, len(known) + 1 - self.keep)]:
            self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.at(old)), True)
        return self.spark.read.parquet(self.at(number))


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Repartition a scan that has fewer splits than the cluster has cores.

    Only for narrow, CPU-bound Python stages over scans: a corpus of many files
    already has enough splits and is left alone, so no shuffle is added at scale.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(want) if df.rdd.getNumPartitions() < want // per_core else df


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than one row beyond them."""
    return df.limit(max_rows + 1).count() <= max_rows
