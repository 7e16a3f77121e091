"""Mixing sources to target weights (problem 6).

Documents are counted in tokens of a public tokenizer and summed per cell of
source, language and topic. Iterative proportional fitting rakes the token
weights of each mix to its source targets and to the language and topic shares
the sources have in the corpus; the rate of a cell (fitted tokens per token it
holds) never exceeds the mix's cap on repeats. Documents are then taken
systematically with their cell's rate, ordered by size within a source: a
document is copied as often as the running sum of rates passes an integer, so
that a source's total is met up to about one document a slice, and languages
and topics in expectation.

Raking sees cells, whose number is bounded by the categories and not by the
documents; drawing runs in slices of a source, so that a source holding a third of
all rows is many tasks.

Defined cases: sources are compared trimmed and in lower case; a null source
belongs to none; language and topic are compared likewise and null is a value
of its own; null and empty texts have 0 tokens and are never drawn; a target
without documents has 0 tokens; a weight of 0 draws nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.tokenize import TOKENIZER_DIR, VOCABULARY, token_counts
from textquarry.storage import Scratch

#: Rounds of raking; it stops earlier when the sources and marginals are met to this share.
ROUNDS = 200
TOLERANCE = 1e-9
#: About so many documents of a source are drawn in one slice.
SLICE_ROWS = 200_000
MARGINS = ("lang", "topic")


def clean(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+$", ""))


def sized_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str = "domain", directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key``, cleaned ``source``, ``lang``, ``topic`` and ``n_tokens`` of each document with a source."""
    slim = docs.filter(F.col(source).isNotNull()).select(F.col(key), clean(F.col(source)).alias("source"), F.coalesce(clean(F.col(lang)), F.lit("?")).alias("lang"), F.coalesce(clean(F.col(topic)), F.lit("?")).alias("topic"), F.col(text).alias("text"))
    return token_counts(slim, "text", (key, "source", *MARGINS), directory, vocabulary)


def rake(cells: pd.DataFrame, weights: dict[str, float], cap: float, budget: float) -> np.ndarray:
    """Fitted tokens of each cell (``source``, ``lang``, ``topic``, ``tokens``).

    The fit starts from the cells' own tokens, meets each source's weight of
    ``budget`` as far as its tokens times ``cap`` allow, and keeps the shares of
    languages and topics as near to the corpus as the sources permit. The source
    step is the last of a round, so sources are met exactly.
    """
    have = cells["tokens"].to_numpy(float)
    most = have * cap
    source, sources = pd.factorize(cells["source"])
    room = np.bincount(source, most, len(sources))
    want = np.minimum([weights.get(s, 0.0) * budget for s in sources], room)
    total = want.sum()
    if total <= 0:
        return np.zeros(len(cells))
    margins = []
    for name in MARGINS:
        code, values = pd.factorize(cells[name])
        share = np.bincount(code, have, len(values))
        margins.append((code, share / share.sum() * total))
    fit = have * (total / have.sum())
    for _ in range(ROUNDS):
        before = fit.copy()
        for code, goal in margins:
            now = np.bincount(code, fit, len(goal))
            fit = fit * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[code]
        fit = _to_sources(fit, most, source, want)
        if np.abs(fit - before).max() <= TOLERANCE * total:
            break
    return fit


def _to_sources(fit: np.ndarray, most: np.ndarray, source: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Scale each source to its total without passing ``most`` in any cell; what a full cell cannot take goes to the others."""
    fixed = np.zeros(len(fit), bool)
    out = np.minimum(fit, most)
    for _ in range(len(fit) + 1):
        left = want - np.bincount(source, np.where(fixed, most, 0.0), len(want))
        free = np.bincount(source, np.where(fixed, 0.0, fit), len(want))
        scale = np.divide(np.maximum(left, 0), free, out=np.zeros_like(left), where=free > 0)
        out = np.where(fixed, most, fit * scale[source])
        over = ~fixed & (out > most * (1 + 1e-12))
        if not over.any():
            break
        fixed |= over
    missing = want - np.bincount(source, out, len(want))  # cells that a margin had emptied
    spare = most - out
    room = np.bincount(source, spare, len(want))
    return out + spare * np.divide(np.maximum(missing, 0), room, out=np.zeros_like(room), where=room > 0)[source]


def mix_sources(docs: DataFrame, targets: DataFrame, key: str = "doc_id", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(drawn, report) for all mixes of ``targets``.

    ``docs`` as of ``sized_documents``. ``drawn``: ``mix_id``, ``key``, ``source``,
    ``copies``, ``n_tokens``. ``report``: a row per target with ``available_tokens``,
    ``max_tokens`` (times the cap), ``target_tokens``, ``reachable``,
    ``drawn_tokens``, ``actual_weight`` (of what the mix drew) and ``budget_share``.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    docs = scratch.save(docs, "sized")
    targets = scratch.save(targets.select("mix_id", "source", "target_weight", "max_repeats", "budget_tokens", clean(F.col("source")).alias("name")), "targets")
    cells = docs.filter("n_tokens > 0").groupBy("source", *MARGINS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    cells = scratch.save(cells.withColumnRenamed("source", "name"), "cells")
    joined = targets.filter("target_weight > 0 AND max_repeats > 0").drop("source").join(cells, "name")
    schema = "mix_id int, name string, lang string, topic string, rate double, n long, max_repeats int"

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        caps = group["max_repeats"].to_numpy(float)
        frame = group.rename(columns={"name": "source"})
        weights = dict(zip(frame["source"], frame["target_weight"], strict=True))
        # one cap per target: cells count in units of their own cap
        got = rake(frame.assign(tokens=frame["tokens"] * caps), weights, 1.0, float(group["budget_tokens"].iloc[0]))
        return group.assign(rate=np.minimum(got / group["tokens"].to_numpy(float), caps))[["mix_id", "name", "lang", "topic", "rate", "n", "max_repeats"]]

    rates = joined.groupBy("mix_id").applyInPandas(fit, schema)
    rates = scratch.save(rates.withColumn("docs", F.sum("n").over(Window.partitionBy("mix_id", "name"))), "rates")
    pairs = docs.filter("n_tokens > 0").withColumnRenamed("source", "name").join(rates.filter("rate > 0"), ["name", *MARGINS])
    pairs = pairs.withColumn("slice", F.pmod(F.hash(F.col(key), "mix_id"), (F.floor(F.col("docs") / SLICE_ROWS) + 1).cast("int")))
    line = Window.partitionBy("mix_id", "name", "slice").orderBy("n_tokens", F.md5(F.concat_ws("|", "mix_id", F.col(key))), F.col(key)).rowsBetween(Window.unboundedPreceding, 0)
    start = F.conv(F.substring(F.md5(F.concat_ws("|", "mix_id", "name", F.col("slice"))), 1, 8), 16, 10).cast("double") / (1 << 32)
    run = F.sum("rate").over(line) + start
    copies = F.least(F.floor(run + 1e-9) - F.floor(run - F.col("rate") + 1e-9), F.col("max_repeats")).cast("int")
    drawn = pairs.withColumn("copies", copies).filter("copies > 0").select("mix_id", key, F.col("name").alias("source"), "copies", "n_tokens")
    drawn = scratch.save(drawn, "drawn")
    got = drawn.groupBy("mix_id", F.col("source").alias("name")).agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("drawn_tokens"))
    have = cells.groupBy("name").agg(F.sum("tokens").alias("available_tokens"))
    whole = Window.partitionBy("mix_id")
    report = (
        targets.join(have, "name", "left").join(got, ["mix_id", "name"], "left").na.fill(0, ["available_tokens", "drawn_tokens"])
        .withColumn("max_tokens", F.col("available_tokens") * F.col("max_repeats"))
        .withColumn("target_tokens", F.col("target_weight") * F.col("budget_tokens"))
        .withColumn("reachable", F.col("max_tokens") >= F.col("target_tokens"))
        .withColumn("actual_weight", F.try_divide("drawn_tokens", F.sum("drawn_tokens").over(whole)))
        .withColumn("budget_share", F.try_divide("drawn_tokens", "budget_tokens"))
        .select("mix_id", "source", "target_weight", "max_repeats", "budget_tokens", "available_tokens", "max_tokens", "target_tokens", "reachable", "drawn_tokens", "actual_weight", "budget_share")
    )
    report = scratch.save(report, "report")
    scratch.finish(drawn, report)
    return drawn, report
