"""Splits and samples by hash order.

Selection is by the md5 of seed and key, which both engines compute alike, so
that a result is the same in every run whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = "42"


def draw(*key: Column, seed: str = SEED) -> Column:
    """The hash that orders rows: md5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in key]))


#: Hexadecimal digits of the hash that name a range: a cell's ranks are counted in 256 ranges.
DIGITS = 2


def cell_rank(rows: DataFrame, key: str, cells: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``_rank`` (from 1, in hash order) within its cell and ``_n``, the cell's rows; null is a cell.

    Ranks are counted within hash ranges and shifted by the ranges before, so a
    cell that holds a third of all rows is many tasks and no task sorts a cell.
    """
    ranged = rows.withColumn("_h", draw(F.col(key))).withColumn("_range", F.substring("_h", 1, DIGITS))
    shifts, _ = _shifts(ranged, cells)
    inside = ranged.withColumn("_inside", F.row_number().over(Window.partitionBy(*cells, "_range").orderBy("_h", key)))
    return _in_range(inside, shifts, cells).withColumn("_rank", F.col("_inside") + F.col("_before")).drop("_h", "_range", "_inside", "_before")


def _shifts(ranged: DataFrame, cells: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The cell and range of each count, ``_before`` (rows of the cell in earlier ranges) and ``_n`` (rows of the cell)."""
    counts = ranged.groupBy(*cells, "_range").agg(F.count("*").alias("_c"))
    cell = Window.partitionBy(*cells) if cells else Window.partitionBy(F.lit(1))
    before = F.sum("_c").over(cell.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    names = [f"_k_{c}" for c in cells]
    return counts.select(*[F.col(c).alias(k) for c, k in zip(cells, names, strict=True)], F.col("_range").alias("_k"), before.alias("_before"), F.sum("_c").over(cell).alias("_n")), names


def _in_range(ranged: DataFrame, shifts: DataFrame, cells: Sequence[str]) -> DataFrame:
    on = F.col("_range") == F.col("_k")
    for c in cells:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return ranged.join(shifts, on).drop("_k", *[f"_k_{c}" for c in cells])


def grouped_split(rows: DataFrame, group: str, share: float = 0.10) -> DataFrame:
    """``rows`` with ``split``: the first floor(groups x share) groups in hash order are val, all members follow."""
    groups = cell_rank(rows.select(group).distinct(), group)
    val = groups.filter(F.col("_rank") <= F.floor(F.col("_n") * F.lit(share))).select(F.col(group).alias("_group"), F.lit("val").alias("_split"))
    joined = rows.join(val, F.col(group).eqNullSafe(F.col("_group")), "left")
    return joined.withColumn("split", F.coalesce("_split", F.lit("train"))).drop("_group", "_split")


def stratified_split(rows: DataFrame, key: str, cells: Sequence[str], share: float = 0.10) -> DataFrame:
    """``rows`` with ``split``: floor(n x share) of each cell are val."""
    chosen = F.col("_rank") <= F.floor(F.col("_n") * F.lit(share))
    return cell_rank(rows, key, cells).withColumn("split", F.when(chosen, "val").otherwise("train")).drop("_rank", "_n")


def per_cell(rows: DataFrame, key: str, cells: Sequence[str], cap: int) -> DataFrame:
    """At most ``cap`` rows of each cell in hash order (X4); null is a cell.

    Counts of hash ranges tell which ranges a cell's first rows lie in; only rows of these are ranked, range by range.
    """
    ranged = rows.withColumn("_h", draw(F.col(key))).withColumn("_range", F.substring("_h", 1, DIGITS))
    before, _ = _shifts(ranged, cells)
    kept = _in_range(ranged, before.filter(F.col("_before") < cap), cells)
    rank = F.row_number().over(Window.partitionBy(*cells, "_range").orderBy("_h", key))
    return kept.withColumn("_rank", rank).filter(F.col("_rank") <= cap).filter(F.col("_rank") + F.col("_before") <= cap).drop("_rank", "_before", "_h", "_range", "_n")


def equal_allocation(rows: DataFrame, key: str, cells: Sequence[str], total: int) -> DataFrame:
    """max(1, total // cells) rows of each cell."""
    n = rows.select(*cells).distinct().agg(F.count("*").alias("_cells"))  # one row
    ranked = cell_rank(rows, key, cells).join(F.broadcast(n))
    return ranked.filter(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.lit(total) / F.col("_cells")))).drop("_rank", "_n", "_cells")


def fraction_per_cell(rows: DataFrame, key: str, cells: Sequence[str], share: float) -> DataFrame:
    """round(n x share) rows of each cell."""
    return cell_rank(rows, key, cells).filter(F.col("_rank") <= F.round(F.col("_n") * share)).drop("_rank", "_n")


def capped(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The first ``limit`` rows in hash order, as a top-k."""
    return rows.withColumn("_h", draw(F.col(key))).orderBy("_h", key).limit(limit).drop("_h")


def quota_plan(rows: DataFrame, label: Column, target: int) -> DataFrame:
    """What each class still needs to reach ``target`` rows (A5): one row."""
    return rows.agg(F.count_if(label == 0).alias("fixed_human"), F.count_if(label == 1).alias("fixed_machine")).select(
        "fixed_human", "fixed_machine", F.greatest(F.lit(0), F.lit(target) - F.col("fixed_human")).alias("need_human"),
        F.greatest(F.lit(0), F.lit(target) - F.col("fixed_machine")).alias("need_machine"),
        F.greatest(F.lit(0), F.col("fixed_human") - F.col("fixed_machine")).alias("balance"),
    )


def split_quotas(counts: DataFrame, targets: dict[int, int], filler: str, machine: str, source: str = "source", split: str = "split") -> DataFrame:
    """How many rows of the two pools a split takes (A5): ``split``, ``source``, ``label``, ``quota``.

    ``counts`` has ``source``, ``split``, ``label``, ``n``. In train the filler (humans) and the machine pool take
    what the other sources leave of the targets, at most what they have; in val the machine pool takes what the
    machines of the others leave of the humans. The two pools are the only ones that are cut.
    """

    def total(label: int, but: str | None = None) -> Column:
        mine = (F.col("label") == label) & (F.col(source) != F.lit(but) if but else F.lit(True))
        return F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0))

    def pool(name: str, label: int) -> Column:
        return F.coalesce(F.sum(F.when((F.col(source) == name) & (F.col("label") == label), F.col("n"))), F.lit(0))

    sums = counts.groupBy(split).agg(total(0, filler).alias("h"), total(0).alias("h_all"), total(1, machine).alias("m"), pool(filler, 0).alias("ph"), pool(machine, 1).alias("pm"))
    clamp = lambda have, left: F.greatest(F.lit(0), F.least(have, left)).cast("bigint")
    val = F.col(split) == "val"
    human = F.when(val, F.col("ph")).otherwise(clamp(F.col("ph"), F.lit(targets[0]) - F.col("h")))
    machines = F.when(val, clamp(F.col("pm"), F.col("h_all") - F.col("m"))).otherwise(clamp(F.col("pm"), F.lit(targets[1]) - F.col("m")))
    rows = F.array(F.struct(F.lit(filler).alias(source), F.lit(0).alias("label"), human.alias("quota")), F.struct(F.lit(machine).alias(source), F.lit(1).alias("label"), machines.alias("quota")))
    return sums.select(split, F.inline(rows))


def cut_to_quota(rows: DataFrame, quotas: DataFrame, key: str, source: str = "source", split: str = "split", label: str = "label") -> DataFrame:
    """Rows of the pools up to their quota in hash order, all rows of other sources (X9). Null fields belong to no pool."""
    cells = [source, split, label]
    named = quotas.select(*[F.col(c).alias(f"_q_{c}") for c in cells], "quota")
    on = F.lit(True)
    for c in cells:
        on = on & (F.col(c) == F.col(f"_q_{c}"))
    ranked = cell_rank(rows, key, cells).join(F.broadcast(named), on, "left")  # two rows a split
    return ranked.filter(F.col("quota").isNull() | (F.col("_rank") <= F.col("quota"))).drop("_rank", "_n", "quota", *[f"_q_{c}" for c in cells])
