"""Evaluation of scored documents.

A scored table is long: group columns, ``y`` (0 human, 1 machine) and ``s``. All
curve work starts from counts per distinct score, so that the ordered windows
run over distinct scores and, within a group, cover ranges whose totals are
added afterwards; rows are only ever aggregated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.operators.stats import edges, place, quantiles
from textquarry.storage import Scratch


def finite(scored: DataFrame) -> DataFrame:
    """Rows with a label and a finite score."""
    return scored.filter(F.col("y").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s") & (F.abs("s") != float("inf")))


def score_health(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows, non-finite scores and whether the set must be skipped."""
    bad = F.col("s").isNull() | F.isnan("s") | (F.abs("s") == float("inf"))
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad")).withColumn("skip", F.col("n_bad") > 0)


def _counts(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Machines ``p`` and humans ``n`` of each distinct score; a table that has been counted comes back as it is."""
    if {"s", "p", "n"} <= set(scored.columns):
        return scored
    return finite(scored).groupBy(*by, "s").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))


def _cumulative(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``p_above``, ``n_above`` (rows with a score greater or equal) and totals ``p_all``, ``n_all`` per group.

    The running sum is taken within ranges of the score and shifted by the sums
    of the ranges above, so that one group is many tasks. The ranges hold about equal numbers
    of distinct scores, whatever outliers a group has.
    """
    bounds = counts.groupBy(*by).agg(edges("s").alias("_cuts"), F.sum("p").alias("p_all"), F.sum("n").alias("n_all"))
    wide = _join(counts, bounds, by).withColumn("_r", place(F.col("_cuts"), F.col("s"))).drop("_cuts")
    totals = wide.groupBy(*by, "_r").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    above = Window.partitionBy(*by).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0) if by else Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.select(*by, "_r", (F.sum("_p").over(above) - F.col("_p")).alias("_pa"), (F.sum("_n").over(above) - F.col("_n")).alias("_na"))
    inside = Window.partitionBy(*by, "_r").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    run = wide.withColumn("_pi", F.sum("p").over(inside)).withColumn("_ni", F.sum("n").over(inside))
    run = _join(run, totals, [*by, "_r"])
    return run.withColumn("p_above", F.col("_pi") + F.col("_pa")).withColumn("n_above", F.col("_ni") + F.col("_na")).select(*by, "s", "p", "n", "p_above", "n_above", "p_all", "n_all")


def _join(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns that may be null; with the one row of ``right`` where there are none."""
    if not by:
        return left.join(F.broadcast(right), how=how)
    renamed = right.select(*[F.col(c).alias(f"_k_{c}") for c in by], *[c for c in right.columns if c not in by])
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return left.join(renamed, condition, how).drop(*[f"_k_{c}" for c in by])


def auroc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per group, ties counting half (A9); null where a class is missing."""
    run = _cumulative(_counts(scored, by), by)
    won = F.sum(F.col("p") * (F.col("n_all") - F.col("n_above") + F.col("n") / 2))
    return run.groupBy(*by).agg(F.try_divide(won, F.max("p_all").cast("double") * F.max("n_all")).alias("auroc"))


def roc_points(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``fpr``, ``tpr``, ``threshold`` by falling threshold, starting at +inf (A10)."""
    run = _cumulative(_counts(scored, by), by)
    points = run.select(*by, F.try_divide(F.col("n_above").cast("double"), "n_all").alias("fpr"), F.try_divide(F.col("p_above").cast("double"), "p_all").alias("tpr"), F.col("s").alias("threshold"))
    first = points.select(*by).distinct() if by else points.limit(1).select()
    return points.unionByName(first.select("*", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold")))


def tpr_interpolated(scored: DataFrame, fpr: float, by: Sequence[str] = ()) -> DataFrame:
    """TPR at a false-positive rate, linear between ROC points."""
    return tprs_interpolated(scored, {"tpr": fpr}, by)


def tprs_interpolated(scored: DataFrame, fprs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """A column for each named false-positive rate, from one pass over the ROC points."""
    points = roc_points(scored, by)
    low = lambda x: F.max(F.when(F.col("fpr") <= x, F.struct("fpr", "tpr")))
    high = lambda x: F.min(F.when(F.col("fpr") >= x, F.struct("fpr", "tpr")))
    ends = points.groupBy(*by).agg(*[f(x).alias(f"{side}_{name}") for name, x in fprs.items() for side, f in (("a", low), ("b", high))])

    def between(name: str, x: float) -> Column:
        a, b = F.col(f"a_{name}"), F.col(f"b_{name}")
        return a["tpr"] + F.coalesce(F.try_divide(b["tpr"] - a["tpr"], b["fpr"] - a["fpr"]), F.lit(0.0)) * (x - a["fpr"])

    return ends.select(*by, *[between(name, x).alias(name) for name, x in fprs.items()])


def tpr_empirical(scored: DataFrame, fpr: float, by: Sequence[str] = (), strict: bool = True, least_humans: int = 21) -> DataFrame:
    """TPR beyond the linear quantile of the human scores (A11); null under ``least_humans``."""
    counts = _counts(scored, by)
    humans = counts.groupBy(*by).agg(F.sum("n").alias("n_human"))
    cut = quantiles(counts.filter("n > 0"), "s", [1 - fpr], by, "n").select(*by, F.col("q").alias("cut"))
    cut = _join(humans, cut, by, "left")
    wide = _join(counts, cut, by)
    hit = F.col("s") > F.col("cut") if strict else F.col("s") >= F.col("cut")
    rate = F.try_divide(F.sum(F.when(hit, F.col("p")).otherwise(F.lit(0))).cast("double"), F.sum("p"))
    return wide.groupBy(*by).agg(F.max("cut").alias("threshold"), F.when(F.max("n_human") >= least_humans, rate).alias("tpr"))


def balanced_accuracy(threshold: Column, strict: bool = True) -> list[Column]:
    """Aggregates at a threshold (A7, A8): recalls, their mean (or the one defined side), false positives and negatives."""
    hit = F.col("s") > threshold if strict else F.col("s") >= threshold
    machine = F.avg(F.when(F.col("y") == 1, hit.cast("double")))
    human = F.avg(F.when(F.col("y") == 0, (~hit).cast("double")))
    return [
        machine.alias("recall_machine"), human.alias("recall_human"), F.coalesce((machine + human) / 2, machine, human).alias("ba"),
        (machine.isNull() | human.isNull()).alias("single_class"), F.count_if((F.col("y") == 0) & hit).alias("fp"), F.count_if((F.col("y") == 1) & ~hit).alias("fn"),
    ]


def _binned(counts: DataFrame, by: Sequence[str], grid: DataFrame, strict: bool) -> DataFrame:
    """BA of each threshold of a grid: ``by``, ``t``, ``ba``.

    A distinct score falls into the bin given by how many thresholds lie below
    it; after that a group has no more rows than thresholds, over which counts run.
    """
    lists = grid.groupBy(*by).agg(F.array_sort(F.collect_set("t")).alias("ts"))
    placed = _join(counts, lists, by).select(*by, "p", "n", place(F.col("ts"), F.col("s"), not strict).alias("bin"))
    bins = placed.groupBy(*by, "bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    steps = lists.select(*by, F.posexplode("ts").alias("i", "t")).select(*by, (F.col("i") + 1).alias("bin"), "t")
    # thresholds without a score of their own still need a row; bin 0 is below all of them
    rows = bins.withColumn("t", F.lit(None).cast("double")).unionByName(steps.withColumn("p", F.lit(0).cast("bigint")).withColumn("n", F.lit(0).cast("bigint")))
    rows = rows.groupBy(*by, "bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.max("t").alias("t"))
    down = Window.partitionBy(*by).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0) if by else Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    seen = rows.withColumn("tp", F.sum("p").over(down)).withColumn("fp", F.sum("n").over(down)).withColumn("p_all", F.sum("p").over(whole)).withColumn("n_all", F.sum("n").over(whole))
    ba = (F.try_divide(F.col("tp").cast("double"), "p_all") + 1 - F.try_divide(F.col("fp").cast("double"), "n_all")) / 2
    return seen.filter("t IS NOT NULL").select(*by, "t", ba.alias("ba"))


def best_threshold(scored: DataFrame, grid: DataFrame, by: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """``tau`` and ``ba``: the first threshold of a grid with the greatest balanced accuracy."""
    tried = _binned(_counts(scored, by), by, grid, strict)
    best = tried.groupBy(*by).agg(F.max(F.struct(F.col("ba"), (-F.col("t")).alias("m"))).alias("b"))
    return best.select(*by, (-F.col("b.m")).alias("tau"), F.col("b.ba").alias("ba"))


def fixed_grid(scored: DataFrame, start: float, stop: float, step: float, by: Sequence[str] = ()) -> DataFrame:
    """Thresholds start, start + step, ... below stop, for each group."""
    n = round((stop - start) / step)
    points = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(start) + i * F.lit(step))).alias("t")
    groups = scored.select(*by).distinct() if by else scored.limit(1).select()
    return groups.select("*", points)


def quantile_grid(scored: DataFrame, count: int = 1500, low: float = 0.001, high: float = 0.999, by: Sequence[str] = ()) -> DataFrame:
    """Distinct linear quantiles of the scores."""
    probs = [low + (high - low) * i / (count - 1) for i in range(count)]
    return quantiles(_counts(scored, by).withColumn("_both", F.col("p") + F.col("n")), "s", probs, by, "_both").select(*by, F.col("q").alias("t")).distinct()


def youden(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``tau``: threshold with the greatest tpr - fpr, the highest on ties; +inf falls back to the greatest score."""
    points = roc_points(scored, by)
    best = points.groupBy(*by).agg(F.max(F.struct((F.col("tpr") - F.col("fpr")).alias("j"), F.col("threshold"))).alias("b"), F.max(F.when(F.col("threshold") != float("inf"), F.col("threshold"))).alias("top"))
    return best.select(*by, F.when(F.col("b.threshold") == float("inf"), F.col("top")).otherwise(F.col("b.threshold")).alias("tau"), F.col("b.j").alias("j"))


def threshold_at_fpr(scored: DataFrame, fpr: float, by: Sequence[str] = ()) -> DataFrame:
    """``tau``: lowest threshold whose false-positive rate is within ``fpr``."""
    points = roc_points(scored, by)
    best = points.filter(F.col("fpr") <= fpr).groupBy(*by).agg(F.min("threshold").alias("t"))
    top = points.groupBy(*by).agg(F.max(F.when(F.col("threshold") != float("inf"), F.col("threshold"))).alias("top"))
    return _join(best, top, by).select(*by, F.when(F.col("t") == float("inf"), F.col("top")).otherwise(F.col("t")).alias("tau"))


def metric_block(scored: DataFrame, threshold: float, by: Sequence[str] = (), least: int = 1, fpr: float = 0.01, native: float | None = None, interval: bool = False) -> DataFrame:
    """The metrics of each group at a fixed threshold (A16-A19); they are null under ``least`` rows.

    Sizes, recalls, BA, AUROC, empirical TPR at ``fpr``, interpolated TPR at 1 % and 5 %, oracle BA over the
    quantile grid and its gap. ``native`` adds the BA at the detector's own threshold, ``interval`` the bootstrap
    interval of the BA. Where a class is missing, all but sizes, recalls and BA are null.
    """
    counts = Scratch(scored.sparkSession, "metrics").save(_counts(scored, by), "counts")  # read by every curve below
    base = counts.groupBy(*by).agg((F.sum("p") + F.sum("n")).alias("n"), F.sum("p").alias("n_machine"), F.sum("n").alias("n_human"), *_counted_accuracy(threshold))
    out = _join(_join(base, auroc(counts, by), by), tpr_empirical(counts, fpr, by).drop("threshold"), by)
    out = _join(out, oracle_accuracy(counts, by).drop("tau"), by, "left")
    out = _join(out, tprs_interpolated(counts, {"tpr_1": 0.01, "tpr_5": 0.05}, by), by, "left")
    out = out.withColumn("oracle_gap", F.col("oracle_ba") - F.col("ba"))
    names = ["tpr_1", "tpr_5", "oracle_ba", "oracle_gap"]
    if native is not None:
        own = counts.groupBy(*by).agg(*_counted_accuracy(native)).select(*by, F.col("ba").alias("ba_native"))
        out, names = _join(out, own, by), [*names, "ba_native"]
    if interval:
        out, names = _join(out, bootstrap_interval(scored, threshold, by), by), [*names, "low", "high"]
    guarded = [F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("recall_machine", "recall_human", "ba", "auroc", "tpr")]
    paired = [F.when((F.col("n") >= least) & ~F.col("single_class"), F.col(c)).alias(c) for c in names]
    return out.select(*by, "n", "n_machine", "n_human", "single_class", *guarded, *paired)


def _counted_accuracy(threshold: float) -> list[Column]:
    """As ``balanced_accuracy`` with strict edges, from counts per score."""
    rate = lambda c, hit: F.try_divide(F.sum(F.when(hit, F.col(c)).otherwise(F.lit(0))).cast("double"), F.sum(c))
    machine, human = rate("p", F.col("s") > threshold), rate("n", F.col("s") <= threshold)
    return [machine.alias("recall_machine"), human.alias("recall_human"), F.coalesce((machine + human) / 2, machine, human).alias("ba"), (machine.isNull() | human.isNull()).alias("single_class")]


def oracle_accuracy(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``tau`` and ``oracle_ba``: the best BA over the group's own quantile grid."""
    return best_threshold(scored, quantile_grid(scored, by=by), by).withColumnRenamed("ba", "oracle_ba")


def paired_scores(first: DataFrame, second: DataFrame, key: str, score: str = "score") -> DataFrame:
    """``key``, ``a``, ``b``: the scores of two runs joined by id (J4); ids of one run only are left out."""
    return first.select(key, F.col(score).alias("a")).join(second.select(key, F.col(score).alias("b")), key)


def score_agreement(first: DataFrame, second: DataFrame, key: str, score: str = "score") -> DataFrame:
    """How two runs agree (J4, A22): joined rows, rank correlation, mean and greatest difference, rows on the other side of 0."""
    both = paired_scores(first, second, key, score)
    gap = F.abs(F.col("a") - F.col("b"))
    sums = both.agg(F.count("*").alias("n"), F.avg(gap).alias("mean_gap"), F.max(gap).alias("most_gap"), F.count_if((F.col("a") > 0) != (F.col("b") > 0)).alias("n_turned"))
    return sums.join(F.broadcast(spearman(both, "a", "b")))  # two rows of one


def every_cell(scored: DataFrame, detectors: Sequence[str], sets: Sequence[str], metric: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """A row of metrics for each detector and set, null where it has no rows (J10): a frame of the two short lists."""
    spark = scored.sparkSession
    frame = spark.createDataFrame([(d, s) for d in detectors for s in sets], "detector string, set string")
    return F.broadcast(frame).join(metric(scored, ["detector", "set"]), ["detector", "set"], "left")


def best_epoch(history: Sequence[float], patience: int = 3) -> tuple[int, int]:
    """(best, last): the epoch of greatest value, the first on ties, when training stops after ``patience`` epochs without a better one."""
    best = 0
    for epoch, value in enumerate(history):
        if value > history[best]:
            best = epoch
        elif epoch - best >= patience:
            return best, epoch
    return best, max(0, len(history) - 1)


def spearman(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman correlation with average ranks of ties (A22, W13): one row ``rho``.

    Ranks come from counts per distinct value and running sums over value ranges.
    """
    rows = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())

    def ranks(c: str) -> DataFrame:
        counted = rows.select(F.col(c).cast("double").alias("s"), F.lit(1).alias("y"))
        run = _cumulative(_counts(counted, ()), ())
        return run.select(F.col("s").alias(f"_{c}"), (F.col("p_all") - F.col("p_above") + (F.col("p") + 1) / 2).alias(f"_r_{c}"))

    wide = rows.withColumn(f"_{a}", F.col(a).cast("double")).withColumn(f"_{b}", F.col(b).cast("double")).join(ranks(a), f"_{a}").join(ranks(b), f"_{b}")
    x, y = F.col(f"_r_{a}").cast("double"), F.col(f"_r_{b}").cast("double")
    return wide.agg(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("rho"))


def distribution(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Least, middle and greatest score, distinct scores, share above 0."""
    rows = finite(scored)
    ends = rows.groupBy(*by).agg(F.min("s").alias("low"), F.max("s").alias("high"), F.count_distinct("s").alias("n_unique"), F.avg((F.col("s") > 0).cast("double")).alias("positive"))
    mid = quantiles(rows, "s", [0.5], by).select(*by, F.col("q").alias("mid"))
    return _join(ends, mid, by, "left").select(*by, "low", "mid", "high", "n_unique", "positive")


def polarity(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``scored`` with scores turned where the AUROC is below one half, and a flag."""
    turned = auroc(scored, by).withColumn("flipped", F.coalesce(F.col("auroc") < 0.5, F.lit(False))).drop("auroc")
    return _join(scored, turned, by).withColumn("s", F.when(F.col("flipped"), -F.col("s")).otherwise(F.col("s")))


def macro_average(metrics: DataFrame, names: Sequence[str], name: str = "set", value: str = "ba") -> DataFrame:
    """Mean over named sets, null unless all are present (A20): one row."""
    part = metrics.filter(F.col(name).isin(*names))
    return part.agg(F.when(F.count_distinct(name) == len(set(names)), F.avg(value)).alias("macro"))


def bootstrap_interval(scored: DataFrame, threshold: float, by: Sequence[str] = (), resamples: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Bootstrap interval of the balanced accuracy (A18): ``low``, ``high``.

    A stratified resample's recall is a binomial share, so only the four counts
    of a group leave the cluster's rows; the draws run per group in one batch.
    A score at the threshold counts as machine here, unlike in ``balanced_accuracy``.
    """
    hit = F.col("s") >= threshold
    counts = finite(scored).groupBy(*by).agg(
        F.count_if((F.col("y") == 1) & hit).alias("tp"), F.count_if(F.col("y") == 1).alias("p"), F.count_if((F.col("y") == 0) & ~hit).alias("tn"), F.count_if(F.col("y") == 0).alias("n"),
    )
    fields = [counts.schema[c] for c in by]

    def run(batches):
        for frame in batches:
            low, high = [], []
            for tp, p, tn, n in zip(frame["tp"], frame["p"], frame["tn"], frame["n"], strict=True):
                rng = np.random.default_rng([seed, int(tp), int(p), int(tn), int(n)])
                sides = [rng.binomial(m, k / m, resamples) / m for k, m in ((tp, p), (tn, n)) if m]
                ba = np.mean(sides, axis=0) if sides else np.full(resamples, np.nan)
                a, b = np.quantile(ba, [(1 - level) / 2, (1 + level) / 2])
                low.append(a)
                high.append(b)
            yield frame[list(by)].assign(low=low, high=high)

    return counts.mapInPandas(run, T.StructType([*fields, T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))


def leaderboard(results: DataFrame, value: str) -> DataFrame:
    """Results by falling value, NaN and null last."""
    return results.orderBy(F.nanvl(F.coalesce(F.col(value), F.lit(-1.0)), F.lit(-1.0)).desc())
