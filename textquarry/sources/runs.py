"""Run specifications, score caches and model tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators.split import capped, per_cell
from textquarry.operators.stats import content_fingerprint
from textquarry.sources import readers
from textquarry.sources.writers import finite_only


@dataclass(frozen=True)
class EvaluationSet:
    """Where a set of labelled texts lies and how it is read."""

    path: str
    text: str = "text"
    label: str = "label"
    ai_value: object = 1
    groups: Sequence[str] = ()
    include: dict = field(default_factory=dict)
    exclude: dict = field(default_factory=dict)
    limit: int | None = None
    calib_sample: int | None = None

    @classmethod
    def parse(cls, raw: dict) -> EvaluationSet:
        """From a JSON object; unknown keys are an error."""
        unknown = set(raw) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown keys: {sorted(unknown)}")
        return cls(**raw)

    def load(self, spark: SparkSession, key: str = "doc_id") -> DataFrame:
        """``key``, ``text``, ``y`` and the groups; null texts become empty."""
        kinds = {"csv": readers.csv, "jsonl": lambda s, p: s.read.json(p)}
        rows = kinds.get(self.path.rsplit(".", 1)[-1], lambda s, p: s.read.parquet(p))(spark, self.path)
        rows = readers.selected(rows, self.include, self.exclude)
        out = rows.select(key, F.coalesce(F.col(self.text), F.lit("")).alias("text"), readers.label_is(F.col(self.label), self.ai_value).alias("y"), *self.groups)
        if self.limit:
            out = capped(out, key, self.limit)
        return per_cell(out, key, ["y"], self.calib_sample) if self.calib_sample else out


@dataclass(frozen=True)
class RunSpec:
    """A validation set and the test sets by name."""

    val: EvaluationSet
    sets: dict[str, EvaluationSet]

    @classmethod
    def parse(cls, text: str) -> RunSpec:
        raw = json.loads(text)
        return cls(EvaluationSet.parse(raw["val"]), {k: EvaluationSet.parse(v) for k, v in raw.get("sets", {}).items()})


def cached_scores(docs: DataFrame, root: str, tag: str, score: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of exactly these texts: read where they are stored, else computed and stored if all are finite.

    The place is named by the tag and the collection's fingerprint.
    """
    print_ = content_fingerprint(docs, key, text).first()
    at = f"{root}/{tag}-{print_['n']}-{print_['digest']:012x}"
    known = readers.table_or_none(docs.sparkSession, at)
    if known is not None:
        return known
    out = score(docs)
    kept = finite_only(out, at)
    return out if kept is None else kept


def save_model(spark: SparkSession, path: str, intercept: float, weights: dict[str, float]) -> None:
    """A linear model as a table: name and weight."""
    spark.createDataFrame([("(intercept)", float(intercept)), *((k, float(v)) for k, v in weights.items())], "name string, weight double").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, names: Sequence[str]) -> tuple[float, dict[str, float]]:
    """Intercept and weights; the stored names must be exactly those expected (one row per feature, so it fits the driver)."""
    rows = {r["name"]: r["weight"] for r in spark.read.parquet(path).collect()}
    intercept = rows.pop("(intercept)")
    if set(rows) != set(names):
        raise ValueError(f"missing {sorted(set(names) - set(rows))}, unexpected {sorted(set(rows) - set(names))}")
    return intercept, {n: rows[n] for n in names}
