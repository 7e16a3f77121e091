"""Classifier heads over given embeddings: margins without a deep-learning runtime.

An encoder is outside this engine; what it leaves behind, a vector per document or per token, is a column.
A head is a few matrices of fixed size that travel with the task; rows stay in their partition.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_erf = np.vectorize(math.erf, otypes=[float])


def gelu(x: np.ndarray) -> np.ndarray:
    """The exact Gaussian error linear unit."""
    return x * 0.5 * (1 + _erf(x / math.sqrt(2)))


@dataclass(frozen=True)
class Dense:
    """``x @ weight + bias``."""

    weight: np.ndarray
    bias: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight + self.bias


def _rows(column: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, known): rows of the wanted width; others are zero and not known."""
    known = np.array([x is not None and len(x) == width for x in column], bool)
    out = np.zeros((len(column), width))
    for i in np.flatnonzero(known):
        out[i] = column.iloc[i]
    return out, known & np.isfinite(out).all(axis=1)


def plain_head(hidden: Dense, out: Dense) -> Callable[[Column], Column]:
    """Margin of an embedding through one hidden layer to two logits (D2, D4); null for a vector of another width or not finite."""

    @F.pandas_udf(DoubleType())
    def margin(vectors: pd.Series) -> pd.Series:
        x, known = _rows(vectors, len(hidden.weight))
        logits = out(gelu(hidden(np.where(known[:, None], x, 0.0))))
        return pd.Series(np.where(known, logits[:, 1] - logits[:, 0], np.nan)).where(known, None)

    return margin


def gated_head(project: Dense, gate_hidden: Dense, gate_out: Dense, hidden: Dense, out: Dense) -> Callable[[Column, Column], Column]:
    """Margin of an embedding fused with linguistic features behind a learned gate (D3).

    The features are projected to the width of the embedding; a gate between 0 and 1 from both scales them.
    """

    @F.pandas_udf(DoubleType())
    def margin(vectors: pd.Series, features: pd.Series) -> pd.Series:
        x, known = _rows(vectors, project.weight.shape[1])
        f, also = _rows(features, len(project.weight))
        known = known & also
        x, f = np.where(known[:, None], x, 0.0), np.where(known[:, None], f, 0.0)
        shown = gelu(project(f))
        gate = 1 / (1 + np.exp(-gate_out(np.tanh(gate_hidden(np.hstack([x, shown]))))))
        logits = out(gelu(hidden(np.hstack([x, gate * shown]))))
        return pd.Series(np.where(known, logits[:, 1] - logits[:, 0], np.nan)).where(known, None)

    return margin


def mean_pooled(tokens: Column, mask: Column | None = None) -> Column:
    """The mean of token vectors (array of arrays), of the masked-in ones where a mask is given (D6); null where there is none."""
    kept = tokens if mask is None else F.filter(tokens, lambda _, i: F.get(mask, i) == 1)
    width = F.size(F.get(kept, F.lit(0)))
    sums = F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.aggregate(kept, F.lit(0.0), lambda a, x: a + F.get(x, k)))
    return F.when(F.size(kept) > 0, F.transform(sums, lambda x: x / F.size(kept)))


def dot(vector: Column, weights: Sequence[float], bias: float = 0.0) -> Column:
    """A single logit: the dot product with fixed weights inside codegen (D6); null for a vector of another width."""
    listed = F.array(*[F.lit(float(w)) for w in weights])
    total = F.aggregate(F.zip_with(vector, listed, lambda a, b: a.cast("double") * b), F.lit(float(bias)), lambda a, x: a + x)
    return F.when(F.size(vector) == len(weights), total)
