"""Composite scorers in one plan: fold, features, scale, choose, linear head, margin or probability."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.normalize import fold
from textquarry.operators import features, stats
from textquarry.operators.evaluate import distribution, score_agreement
from textquarry.operators.score import softmax

Block = Callable[[DataFrame], DataFrame]


def chosen_blocks(docs: DataFrame, text: str, blocks: Sequence[Block] | None = None, normalise: Callable[[Column], Column] = fold) -> DataFrame:
    """``doc_id`` and the features of the normalised texts: all 62, or those of the given blocks."""
    folded = docs.select(features.KEY, normalise(F.col(text)).alias("text"))
    if blocks is None:
        return features.all_features(folded)
    base = features.base(folded)
    return reduce(lambda a, b: a.join(b, features.KEY), [block(base) for block in blocks])


def fitted_scale(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """``name``, ``center``, ``scale`` of feature columns: a row per feature."""
    return stats.robust_scale(long_table(table, names).select("name", "value"), ["name"])


def long_table(table: DataFrame, names: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), stats.clean_number(F.col(n)).alias("value")) for n in names])
    return table.select(features.KEY, F.inline(pairs))


def margins(table: DataFrame, scale: DataFrame, weights: dict[str, float], intercept: float = 0.0) -> DataFrame:
    """``doc_id`` and ``margin`` of scaled features with fixed weights: the features not named are not chosen.

    ``scale`` has a row per feature, so it fits the driver and the scaling is part of the projection.
    """
    fitted = {r["name"]: (r["center"], r["scale"]) for r in scale.filter(F.col("name").isin(*weights)).collect()}
    missing = set(weights) - set(fitted)
    if missing:
        raise ValueError(f"no scale for {sorted(missing)}")
    total = F.lit(float(intercept))
    for name, weight in weights.items():
        center, width = fitted[name]
        total = total + F.lit(float(weight)) * (stats.clean_number(F.col(name)) - F.lit(center)) / F.lit(width)
    return table.select(features.KEY, total.alias("margin"))


def probabilities(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``margin`` with the probability of the machine class and the decision 0 or 1."""
    p = softmax(F.lit(0.0), F.col("margin"))
    return scored.withColumn("probability", p).withColumn("machine", (F.col("probability") > threshold).cast("int"))


def submission(scored: DataFrame, previous: DataFrame, key: str = features.KEY) -> tuple[DataFrame, DataFrame]:
    """(distribution, agreement) of margins before they are handed in (D17): their spread, and how they agree with a previous run (``key``, ``score``)."""
    now = scored.select(key, F.col("margin").alias("score"))
    spread = distribution(now.select(F.lit(1).alias("y"), F.col("score").alias("s")))
    return spread, score_agreement(now, previous, key)


def shown_margin(text: Column, score: Callable[[Column], Column]) -> Column:
    """The margin of a text folded without collapsing its white space, as a reader sees it."""
    return score(fold(text, collapse=False))
