"""Scorers: a registry of document scorers and a linear one.

A scorer maps a text column to a margin column. Heavy models enter as Arrow
UDFs made by ``arrow_scorer``, whose model is loaded once per worker; texts are
ordered by length within a task so that batches hold texts of like length.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@dataclass(frozen=True)
class Scorer:
    """A margin of text, with its polarity and native threshold."""

    margin: Callable[[Column], Column]
    higher_is_machine: bool = True
    threshold: float = 0.0
    max_chars: int | None = None

    def __call__(self, text: Column) -> Column:
        shown = F.substring(text, 1, self.max_chars) if self.max_chars else text
        m = self.margin(shown)
        return m if self.higher_is_machine else -m


REGISTRY: dict[str, Scorer] = {}


def register(name: str, scorer: Scorer) -> Scorer:
    """Make a scorer known by name."""
    REGISTRY[name] = scorer
    return scorer


def matching(names: list[str], wanted: list[str]) -> list[str]:
    """Names that contain any of the wanted parts, any case."""
    return [n for n in names if any(w.lower() in n.lower() for w in wanted)]


def linear(weights: dict[str, tuple[Callable[[Column], Column], float]], bias: float = 0.0) -> Scorer:
    """A weighted sum of column expressions of the text, inside codegen."""

    def margin(text: Column) -> Column:
        out = F.lit(bias)
        for value, weight in weights.values():
            out = out + F.lit(weight) * F.coalesce(value(text).cast("double"), F.lit(0.0))
        return out

    return Scorer(margin)


#: Models of this worker process by scorer, so that a worker loads each once whatever its tasks.
LOADED: dict[str, Any] = {}


def loaded(name: str, load: Callable[[], Any]) -> Any:
    """The model of a name, loaded where this process has not done so. Workers import this function, so its memory outlives a task."""
    if name not in LOADED:
        LOADED[name] = load()
    return LOADED[name]


def arrow_scorer(load: Callable[[], Any], score: Callable[[Any, list[str]], list[float]], **kw: Any) -> Scorer:
    """A scorer from Python: ``load`` makes the model once per worker, ``score`` maps a batch of texts to margins.

    Null texts are scored as empty; a non-finite margin is retried alone and is
    null if it stays so.
    """

    name = uuid.uuid4().hex

    @F.pandas_udf(DoubleType())
    def margin(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(name, load)
        for texts in batches:
            known = texts.fillna("").tolist()
            out = pd.Series(score(model, known), dtype="float64")
            for i in out.index[~out.abs().lt(float("inf"))]:
                again = score(model, [known[i]])[0]
                out[i] = again if abs(again) < float("inf") else None
            yield out

    return Scorer(margin, **kw)


def log_odds(human: Column, machine: Column) -> Column:
    """Margin of two logits or of a probability pair's logarithms (M7)."""
    return machine - human


def softmax(human: Column, machine: Column) -> Column:
    """Probability of the machine class."""
    return 1 / (1 + F.exp(human - machine))


def by_length(docs: DataFrame, text: str) -> DataFrame:
    """Rows of a task in order of length, so that batches are even."""
    return docs.sortWithinPartitions(F.length(text).desc())


def scored_in_order(docs: DataFrame, key: str, text: str, score: Callable[[Column], Column]) -> DataFrame:
    """``key`` and ``score``, computed in batches of like length and returned in the order of the key."""
    return by_length(docs.select(key, text), text).select(key, score(F.col(text)).alias("score")).orderBy(key)


def top_share_mean(values: Column, share: float) -> Column:
    """Mean of the greatest share of an array."""
    k = F.greatest(F.lit(1), F.ceil(F.size(values) * F.lit(share))).cast("int")
    top = F.slice(F.sort_array(values, asc=False), F.lit(1), k)
    return F.try_divide(F.aggregate(top, F.lit(0.0), lambda a, x: a + x.cast("double")), F.size(top))


def fit_linear(features: DataFrame, columns: list[str], label: str = "label", weights: dict[int, float] | None = None):
    """Weighted logistic regression on feature columns (D11): (intercept, coefficients by column)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    weight = F.lit(1.0)
    for k, w in (weights or {1: 1.0, 0: 1.5}).items():
        weight = F.when(F.col(label) == k, F.lit(w)).otherwise(weight)
    rows = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="skip").transform(features.withColumn("_w", weight))
    model = LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", maxIter=50, regParam=0.01).fit(rows)
    return model.intercept, dict(zip(columns, model.coefficients.toArray().tolist(), strict=True))
