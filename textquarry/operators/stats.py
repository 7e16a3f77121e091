"""Statistics of feature columns and collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_number(c: Column) -> Column:
    """NaN, infinite and null values become 0."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c.cast("double"))


def long_features(rows: DataFrame, key: str, features: str = "features") -> DataFrame:
    """``key``, ``idx``, ``value`` of each element of a feature array, cleaned."""
    return rows.select(key, F.posexplode(features).alias("idx", "v")).select(key, "idx", clean_number(F.col("v").cast("double")).alias("value"))


#: Value ranges in which the ranks of a group are counted, and the accuracy of their edges.
RANGES, ACCURACY = 256, 2_000


def edges(value: str) -> Column:
    """Aggregate: edges that cut the values of a group into ranges of about equal numbers of rows, whatever their spread."""
    return F.expr(f"percentile_approx(`{value}`, array({', '.join(f'{i / RANGES!r}D' for i in range(1, RANGES))}), {ACCURACY})")


def place(cuts: Column, value: Column, inclusive: bool = False) -> Column:
    """How many entries of a sorted array lie below a value (``inclusive``: at it, too), by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in range(15, -1, -1)])

    def step(at: Column, size: Column) -> Column:
        cut = F.get(cuts, at + size - 1)
        return at + F.when((at + size <= F.size(cuts)) & (cut <= value if inclusive else cut < value), size).otherwise(F.lit(0))

    return F.aggregate(steps, F.lit(0), step)


def quantiles(rows: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Exact linear quantiles: ``by``, ``p``, ``q``; nulls in ``value`` are left out, nulls in ``by`` are a group.

    ``weight`` says for how many equal rows a row stands (a whole number).

    Values are counted, ranks run within ranges of about equal numbers of distinct values and are shifted by
    the ranges below, and each wanted rank is looked up in its range. No task
    holds a group's values, as the built-in exact percentile would, and outliers do not stretch a range.
    """
    keys = [f"_b{i}" for i in range(len(by))]
    named = rows.filter(F.col(value).isNotNull()).select(*[F.struct(F.col(c)).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("s"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_w"))
    counts = named.groupBy(*keys, "s").agg(F.sum("_w").alias("c")).filter("c > 0")
    bounds = counts.groupBy(*keys).agg(edges("s").alias("cuts"), F.sum("c").alias("n")).filter("n IS NOT NULL")
    meet = lambda left, right, on: left.join(right, on) if on else left.join(F.broadcast(right))  # noqa: E731  without groups one row
    ranged = meet(counts, bounds, keys).withColumn("r", place(F.col("cuts"), F.col("s"))).drop("cuts")
    below = Window.partitionBy(*keys).orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy(*keys, "r").agg(F.sum("c").alias("t")).withColumn("base", F.sum("t").over(below) - F.col("t"))
    at = F.explode(F.split(F.lit(" ".join(repr(float(p)) for p in probs)), " ").cast("array<double>")).alias("p")  # one literal, however many
    wanted = bounds.select(*keys, "n", at).withColumn("h", F.col("p") * (F.col("n") - 1)).withColumn("k0", F.floor("h"))
    wanted = wanted.select(*keys, "p", "h", "k0", F.explode(F.array(F.col("k0"), F.least(F.col("k0") + 1, F.col("n") - 1))).alias("k")).distinct()
    # both sides hold a fixed number of rows per group
    placed = meet(wanted, totals, keys).filter((F.col("k") >= F.col("base")) & (F.col("k") < F.col("base") + F.col("t")))
    run = F.sum("c").over(Window.partitionBy(*keys, "r").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    ranks = ranged.withColumn("upto", run).select(*keys, "r", "s", "c", "upto")
    found = placed.join(ranks, [*keys, "r"]).filter((F.col("k") < F.col("base") + F.col("upto")) & (F.col("k") >= F.col("base") + F.col("upto") - F.col("c")))
    ends = found.groupBy(*keys, "p").agg(F.min(F.struct("k", "s")).alias("a"), F.max(F.struct("k", "s")).alias("b"), F.max(F.col("h") - F.col("k0")).alias("f"))
    q = F.col("a.s") + (F.col("b.s") - F.col("a.s")) * F.col("f")
    return ends.select(*[F.col(k)[c].alias(c) for c, k in zip(by, keys, strict=True)], "p", q.alias("q"))


def _at(p: float) -> Column:
    return F.max(F.when(F.col("p") == p, F.col("q")))


def robust_scale(values: DataFrame, by: Sequence[str] = ("idx",)) -> DataFrame:
    """``center`` (median) and ``scale`` (interquartile range, 0 becomes 1) of each feature."""
    q = quantiles(values, "value", (0.25, 0.5, 0.75), by).groupBy(*by).agg(_at(0.25).alias("a"), _at(0.5).alias("center"), _at(0.75).alias("b"))
    return q.select(*by, "center", F.when(F.col("b") == F.col("a"), 1.0).otherwise(F.col("b") - F.col("a")).alias("scale"))


def apply_scale(values: DataFrame, fitted: DataFrame, by: Sequence[str] = ("idx",)) -> DataFrame:
    """``values`` with ``scaled``."""
    return values.join(fitted, list(by)).withColumn("scaled", (F.col("value") - F.col("center")) / F.col("scale"))


def mutual_information(values: DataFrame, label: str, by: Sequence[str] = ("idx",), bins: int = 10) -> DataFrame:
    """Mutual information in nats of equal-frequency bins of a feature with a label (A28), greatest first.

    A binned estimate in place of a nearest-neighbour one: it needs counts only.
    """
    cuts = quantiles(values, "value", [i / bins for i in range(1, bins)], by).groupBy(*by).agg(F.array_sort(F.collect_list("q")).alias("cuts"))
    binned = values.join(cuts, list(by)).withColumn("bin", place(F.col("cuts"), F.col("value")))
    joint = binned.groupBy(*by, "bin", label).agg(F.count("*").alias("n"))
    n_bin, n_label, n_all = (F.sum("n").over(Window.partitionBy(*by, *more)) for more in (("bin",), (label,), ()))
    part = joint.select(*by, (F.col("n") / n_all * F.log(F.col("n") * n_all / (n_bin * n_label))).alias("term"))
    return part.groupBy(*by).agg(F.sum("term").alias("mi")).orderBy(F.desc("mi"), *by)


def content_fingerprint(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``digest`` and ``n`` of a collection whatever its order.

    The sum of row hashes: it needs no ordering and no row leaves its task, unlike
    the hash of the concatenated texts.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.coalesce(text, F.lit("")))), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.pmod(F.coalesce(F.sum(h), F.lit(0)), F.lit(281474976710656)).cast("bigint").alias("digest"))


def ordered_fingerprint(rows: DataFrame, key: str, text: str, block: int = 1000, levels: int = 2) -> DataFrame:
    """SHA-1 in key order: texts become digests, then blocks of ``block`` keys, then blocks of blocks.

    No task holds more than ``block`` digests but the last, which holds one for
    ``block`` to the power of ``levels`` keys.
    """

    def folded(df: DataFrame) -> DataFrame:
        return df.groupBy("b").agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "|")).alias("h"))

    level = folded(rows.select(F.floor(F.col(key) / block).alias("b"), F.col(key).alias("k"), F.sha1(F.coalesce(text, F.lit(""))).alias("h")))
    for _ in range(levels - 1):
        level = folded(level.select(F.floor(F.col("b") / block).alias("b"), F.col("b").alias("k"), "h"))
    last = F.array_sort(F.collect_list(F.struct(F.col("b").alias("k"), "h")))
    return level.agg(F.substring(F.sha1(F.array_join(F.transform(last, lambda x: x["h"]), "|")), 1, 12).alias("digest"))


def composition(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Rows, classes and shares per group with a TOTAL row (A1-A3)."""
    return tally(rows, [group], label).select(group, "n", "human", "machine", "share")


def tally(rows: DataFrame, groups: Sequence[str], label: str) -> DataFrame:
    """Rows and classes of each combination of groups with a TOTAL row (A1-A3): counts, share of all rows, of each class.

    A null group is ``-``. ``by_size`` orders the report.
    """
    named = rows.select(*[F.coalesce(g, F.lit("-")).alias(g) for g in groups], F.col(label).alias("_label"))
    counted = named.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(F.col("_label") == 0).alias("human"), F.count_if(F.col("_label") == 1).alias("machine"))
    total = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "human", "machine")])
    total = total.select(*[F.lit("TOTAL").alias(g) for g in groups], "n", "human", "machine")
    whole = Window.partitionBy(F.lit(1))  # a row per combination
    share = lambda c: F.round(F.try_divide(c, F.max(F.when(F.col("_total"), F.col(c))).over(whole)), 6)
    both = counted.withColumn("_total", F.lit(False)).unionByName(total.withColumn("_total", F.lit(True)))
    return both.select(*groups, "n", "human", "machine", share("n").alias("share"), share("human").alias("human_share"), share("machine").alias("machine_share"))


def by_size(report: DataFrame, count: str = "n") -> DataFrame:
    """A report in falling order of a count, then by name."""
    return report.orderBy(F.desc(count), *[c for c in report.columns if c != count])


def moments(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, population skewness and range of a value (M5, M6); skewness is 0 where all values are equal."""
    same = F.stddev_pop(value) == 0
    return rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"),
        F.when(same, 0.0).otherwise(F.skewness(value)).alias("skewness"), F.min(value).alias("low"), F.max(value).alias("high"),
    )


def loss_features(losses: DataFrame, key: str = "doc_id", pos: str = "pos", loss: str = "loss") -> DataFrame:
    """Features 0-7 of each document from the token losses of any language model (``key``, ``pos`` from 0, ``loss``).

    Perplexity, mean, greatest loss, deviation, skewness, shares of losses below the lower and above the upper quartile,
    and the mean of the second half less that of the first. A document of one loss has no skewness and no drift.
    """
    rows = losses.filter(F.col(key).isNotNull() & F.col(loss).isNotNull()).select(key, F.col(pos).alias("pos"), F.col(loss).cast("double").alias("loss"))
    quarters = quantiles(rows, "loss", (0.25, 0.75), [key]).groupBy(key).agg(_at(0.25).alias("low_q"), _at(0.75).alias("high_q"))
    sizes = rows.groupBy(key).agg(F.floor(F.count("*") / 2).alias("middle"))
    wide = rows.join(quarters, key).join(sizes, key)
    late = F.col("pos") >= F.col("middle")
    # --- Fixed values: greatest perplexity and loss shown
    return wide.groupBy(key).agg(
        F.least(F.exp(F.avg("loss")), F.lit(10000.0)).alias("f00"), F.avg("loss").alias("f01"), F.least(F.max("loss"), F.lit(50.0)).alias("f02"), F.stddev_pop("loss").alias("f03"),
        F.when((F.count("*") > 2) & (F.stddev_pop("loss") > 0), F.skewness("loss")).otherwise(0.0).alias("f04"),
        F.avg((F.col("loss") < F.col("low_q")).cast("double")).alias("f05"), F.avg((F.col("loss") > F.col("high_q")).cast("double")).alias("f06"),
        F.coalesce(F.avg(F.when(late, F.col("loss"))) - F.avg(F.when(~late, F.col("loss"))), F.lit(0.0)).alias("f07"),
    )


def word_statistics(rows: DataFrame, words: str, stored: str, by: Sequence[str]) -> DataFrame:
    """Words of texts per group (A26): mean, median, range, and rows whose stored count is missing or stale."""
    base = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(words).alias("mean_words"), F.min(words).alias("least"), F.max(words).alias("most"), F.count_if(F.coalesce(F.col(words) != F.col(stored), F.lit(True))).alias("stale"))
    middle = quantiles(rows, words, [0.5], by).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("q").alias("median_words"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return base.join(middle, on, "left").drop(*[f"_{c}" for c in by])


def stamp(at: Column, pattern: str = "yyyyMMdd_HHmmss") -> Column:
    """A time as a stamp for file names."""
    return F.date_format(at, pattern)


def parsed_stamp(text: Column) -> Column:
    """The time of an ISO stamp with ``T`` or a blank, with or without a fraction or zone; null for others."""
    return F.try_to_timestamp(F.regexp_replace(text, r"(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?$", ""), F.lit("yyyy-MM-dd['T'][' ']HH:mm:ss"))


def top_features(ranked: DataFrame, k: int = 30) -> DataFrame:
    """The k features of greatest mutual information (T5); ties by index."""
    return ranked.orderBy(F.desc("mi"), *[c for c in ranked.columns if c != "mi"]).limit(k)


def chosen_features(features: Column, indices: Sequence[int]) -> Column:
    """The listed elements of a feature array in order (P23); null where it is too short."""
    return F.transform(F.array(*[F.lit(int(i)) for i in indices]), lambda i: F.get(features, i))
