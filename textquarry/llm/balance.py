"""Samples that match target category proportions (problem 2).

The cube method on category indicators. Every record that a spec can use has an
inclusion probability; the flight phase moves the probabilities along directions
that leave all balancing totals unchanged until they are 0 or 1. It runs per
partition, what stays unresolved merges upward, and the landing phase resolves
the rest, dropping balancing variables one by one; what imbalance that leaves
is reported.

Records of one cell (same target and same categories) have the same balancing
vector, so within a partition the flight of a cell's records is exact and needs
no linear algebra: in hash order the first are taken, one keeps the fraction, the
others are left out. Only these fractions, at most one per cell and partition,
move on; numbers of rows never reach a single task.

Defined cases: of rows with one id the latest counts, a null stamp being the
earliest; rows without an id are each their own record; null or blank text is
unusable; categories are compared trimmed and in lower case and a null one fits
no named value; targets that name the same records in one spec share them, each
record serving the first such target.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.storage import Scratch

CATEGORIES = ("domain", "model", "attack")
#: First-level flights run within hash slices of each spec's cells: at least this many,
SLICES = 64
#: and so many that a slice of all records has about this many rows.
SLICE_ROWS = 500_000
#: Later flights merge so many slices at a time, in groups of about so many cells, at least so many groups a spec:
#: a task sees at most their product of records, whatever the number of rows.
FAN, GROUP_CELLS, CELL_GROUPS = 64, 1_000, 8
EPS = 1e-9


def _white(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+$", "")


def usable_records(rows: DataFrame, key: str = "id", text: str = "generation", stamp: str = "loaded_at", categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """One row per usable record: ``key`` and its cleaned categories.

    The text is reduced to a flag before anything is shuffled.
    """
    ok = F.coalesce(F.length(_white(F.col(text))) > 0, F.lit(False))
    slim = rows.select(key, F.struct(F.col(stamp).alias("at"), ok.alias("ok"), *[F.lower(_white(F.col(c))).alias(c) for c in categories]).alias("r"))
    latest = slim.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("r").alias("r"))
    return latest.unionByName(slim.filter(F.col(key).isNull())).filter("r.ok").select(key, *[f"r.{c}" for c in categories])


def _needed(targets: DataFrame) -> DataFrame:
    want = F.round(F.coalesce("target_share", F.lit(0.0)) * F.coalesce("sample_size", F.lit(0))).cast("bigint")
    return targets.withColumn("needed", F.greatest(F.coalesce("min_rows", F.lit(0)), want))


def cell_targets(cells: DataFrame, targets: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Which cell serves which target: ``spec_id``, ``target_id``, the categories, ``n``.

    A cell offers a key for each set of fields that a target may name, a target
    has the key of the fields it names: an equi-join. Null fits no named value.
    """

    def key(values: Sequence[Column]) -> Column:
        return F.array_join(F.array(*values), "\u0001")

    t = targets.select("spec_id", "target_id", key([F.coalesce(F.lower(_white(F.col(c))), F.lit("\u0002")) for c in categories]).alias("_key"))
    offers = []
    for names in (set(x) for n in range(len(categories) + 1) for x in combinations(categories, n)):
        known = reduce(lambda a, c: a & F.col(c).isNotNull(), names, F.lit(True))
        offers.append(F.when(known, key([F.col(c) if c in names else F.lit("\u0002") for c in categories])))
    offered = cells.select(*categories, "n", F.explode(F.array_compact(F.array(*offers))).alias("_key"))
    return offered.join(t, "_key").select("spec_id", "target_id", *categories, "n")


def sample_targets(records: DataFrame, targets: DataFrame, key: str = "id", categories: Sequence[str] = CATEGORIES, seed: str = "cube", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(sample, report) for all specs of ``targets``.

    ``sample``: ``spec_id``, ``target_id``, ``key``. ``report``: a row per target
    with ``needed``, ``available`` (all usable records that fit), ``drawn``,
    ``shortfall``, ``actual_share`` of the spec's sample, ``residual`` (drawn less
    the balanced total) and ``met``.
    """
    spark = records.sparkSession
    scratch = scratch or Scratch(spark, "balance")
    targets = scratch.save(_needed(targets), "targets")
    records = scratch.save(records, "records")
    cells = scratch.save(records.groupBy(*categories).agg(F.count("*").alias("n")), "cells")
    fits = scratch.save(cell_targets(cells, targets, categories), "fits")
    available = fits.groupBy("target_id").agg(F.sum("n").alias("available"))
    first = Window.partitionBy("spec_id", *categories).orderBy("target_id")
    serves = fits.withColumn("rank", F.row_number().over(first)).filter("rank = 1").drop("rank")
    of_target = serves.groupBy("target_id").agg(F.sum("n").alias("served"))
    plan = serves.join(of_target, "target_id").join(targets.select("target_id", "needed"), "target_id")
    plan = plan.withColumn("prob", F.least(F.lit(1.0), F.col("needed") / F.col("served"))).filter("prob > 0").drop("n", "served", "needed")
    plan = scratch.save(plan.withColumn("cell", F.concat_ws("|", F.col("target_id"), *[F.coalesce(F.col(c), F.lit("")) for c in categories])), "plan")
    match = [records[c].eqNullSafe(plan[c]) for c in categories]
    on = match[0]
    for m in match[1:]:
        on = on & m
    rows = records.join(plan, on).select("spec_id", "target_id", "cell", "prob", *[records[c] for c in categories], records[key])
    point = F.md5(F.concat_ws("|", F.lit(seed), F.col("spec_id"), F.coalesce(F.col(key).cast("string"), F.monotonically_increasing_id().cast("string"))))
    rows = scratch.save(rows.withColumn("point", point), "rows")
    slices = max(SLICES, (cells.agg(F.sum("n").alias("n")).first()["n"] or 0) // SLICE_ROWS)
    sure = rows.filter(F.col("prob") >= 1 - EPS).select("spec_id", "target_id", key)
    open_rows = rows.filter(F.col("prob") < 1 - EPS).withColumn("slice", F.pmod(F.hash("point"), F.lit(slices)))
    # first flight: within a slice of a cell, in hash order
    order = Window.partitionBy("cell", "slice").orderBy("point")
    whole = Window.partitionBy("cell", "slice")
    flown = open_rows.withColumn("k", F.row_number().over(order)).withColumn("total", F.count("*").over(whole) * F.col("prob"))
    floor = F.floor(F.col("total") + EPS)
    moved = F.when(F.col("k") <= floor, 1.0).when(F.col("k") == floor + 1, F.col("total") - floor).otherwise(0.0)
    flown = scratch.save(flown.withColumn("prob", moved).filter(F.col("prob") > EPS).drop("k", "total"), "flight1")
    taken = flown.filter(F.col("prob") >= 1 - EPS).select("spec_id", "target_id", key)
    rest = flown.filter(F.col("prob") < 1 - EPS)
    # what is left, at most one record per cell and slice, merges upward, slices first
    names = ["target_id", *categories]
    schema = "spec_id int, target_id long, cell string, slice int, prob double, " + "".join(f"{c} string, " for c in categories) + f"{key} string, point string"
    columns = ["spec_id", "target_id", "cell", "slice", "prob", *categories, key, "point"]

    def fly(final: bool):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["cell", "point"], ignore_index=True)[columns]
            group["prob"] = pivot(group["prob"].to_numpy(), group["cell"].to_numpy())
            group["prob"] = cube(group["prob"].to_numpy(), indicators(group[names]), landing=final)
            return group[group["prob"] > EPS]

        return run

    parts = max(CELL_GROUPS, cells.count() // GROUP_CELLS)
    level, resolved = slices, []
    while True:
        level = -(-level // FAN)
        merged = rest.withColumn("slice", F.floor(F.col("slice") / FAN).cast("int")).withColumn("part", F.pmod(F.hash("cell"), F.lit(parts)))
        rest = scratch.save(merged.groupBy("spec_id", "part", "slice").applyInPandas(fly(False), schema), f"flight-{level}")
        resolved.append(rest.filter(F.col("prob") >= 1 - EPS).select("spec_id", "target_id", key))
        rest = rest.filter(F.col("prob") < 1 - EPS)
        if level <= 1:
            break
    taken2 = reduce(lambda a, b: a.unionByName(b), resolved)
    landed = rest.groupBy("spec_id").applyInPandas(fly(True), schema).select("spec_id", "target_id", key)
    sample = scratch.save(sure.unionByName(taken).unionByName(taken2).unionByName(landed), "sample")
    drawn = sample.groupBy("target_id").agg(F.count("*").alias("drawn"))
    sizes = Window.partitionBy("spec_id")
    report = (
        targets.join(available, "target_id", "left").join(of_target, "target_id", "left").join(drawn, "target_id", "left")
        .na.fill(0, ["available", "served", "drawn"])
        .withColumn("shortfall", F.greatest(F.lit(0), F.col("needed") - F.col("drawn")))
        .withColumn("actual_share", F.try_divide("drawn", F.sum("drawn").over(sizes)))
        .withColumn("residual", F.col("drawn") - F.least("needed", "served"))
        .withColumn("met", (F.col("available") >= F.col("needed")) & (F.col("residual") >= 0) & (F.col("shortfall") == 0))
        .select("spec_id", "target_id", *categories, "target_share", "min_rows", "sample_size", "needed", "available", "drawn", "shortfall", "actual_share", "residual", "met")
    )
    report = scratch.save(report, "report")
    scratch.finish(sample, report)
    return sample, report


def indicators(frame: pd.DataFrame) -> np.ndarray:
    """Rows of 0 and 1: one column per value of each column of ``frame``; null is a value."""
    blocks = []
    for name in frame.columns:
        codes, values = pd.factorize(frame[name], use_na_sentinel=False)
        block = np.zeros((len(frame), len(values)))
        block[np.arange(len(frame)), codes] = 1.0
        blocks.append(block)
    return np.hstack(blocks) if blocks else np.zeros((len(frame), 0))


def pivot(prob: np.ndarray, cell: np.ndarray, seed: int = 11) -> np.ndarray:
    """The flight among records of the same cell (rows sorted by cell): pairs meet until one per cell is open."""
    p = prob.astype(float).copy()
    draws = np.random.default_rng(seed).random(len(p))
    held = -1
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            continue
        if held < 0 or cell[held] != cell[i]:
            held = i
            continue
        both = p[held] + p[i]
        if both < 1:
            win, lose = (held, i) if draws[i] < p[held] / both else (i, held)
            p[win], p[lose] = both, 0.0
        else:
            win, lose = (held, i) if draws[i] < (1 - p[i]) / (2 - both) else (i, held)
            p[win], p[lose] = 1.0, both - 1
        p[i], p[held] = (round(v) if v < EPS or v > 1 - EPS else v for v in (p[i], p[held]))
        held = next((k for k in (held, i) if EPS < p[k] < 1 - EPS), -1)
    return p


def _null_vector(rows: np.ndarray) -> np.ndarray | None:
    """A vector u with u @ rows = 0 for more rows than the rank, else None."""
    u, s, _ = np.linalg.svd(rows, full_matrices=True)
    rank = int((s > 1e-9).sum())
    return u[:, rank] if rank < len(rows) else None


def cube(prob: np.ndarray, x: np.ndarray, landing: bool = True, seed: int = 7) -> np.ndarray:
    """The cube method on probabilities and balancing rows.

    Flight: a window of one more record than there are variables moves along a
    null direction until one of them is 0 or 1, which leaves it for the next.
    Balancing totals stay exact. Landing: the last variables are dropped one
    after another (categories before targets), so that only the dropped ones can
    be off, by less than the number of records left.
    """
    p = prob.astype(float).copy()
    rng = np.random.default_rng(seed)
    keep = x.shape[1]
    if len(p) == 0:
        return p
    while True:
        queue = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
        window: list[int] = []
        at = 0
        while True:
            while len(window) <= keep and at < len(queue):
                window.append(queue[at])
                at += 1
            if not window:
                break
            u = _null_vector(x[window, :keep]) if keep else np.eye(len(window))[0]
            if u is None:
                break
            pw = p[window]
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(u > 1e-12, (1 - pw) / u, np.where(u < -1e-12, -pw / u, np.inf)).min()
                down = np.where(u > 1e-12, pw / u, np.where(u < -1e-12, (pw - 1) / u, np.inf)).min()
            step = up if rng.random() < down / (up + down) else -down
            pw = np.clip(pw + step * u, 0, 1)
            pw[pw < EPS], pw[pw > 1 - EPS] = 0.0, 1.0
            p[window] = pw
            window = [i for i in window if 0 < p[i] < 1]
        if not landing or not ((p > EPS) & (p < 1 - EPS)).any():
            return p
        keep = max(0, keep - 1)
