"""Reports: upserts, merges of settings, placed results, wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it lacks; null keys match (K8, U6). Keys of ``new`` must be unique."""
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    kept = a.join(b, condition, "left_anti")
    return new.unionByName(kept, allowMissingColumns=True)


def overridden(template: Column, changes: Column) -> Column:
    """A map with the entries of ``changes`` over those of ``template`` (K7)."""
    return F.map_concat(F.map_filter(template, lambda k, _: ~F.map_contains_key(changes, k)), changes)


def placed(results: DataFrame, value: str) -> DataFrame:
    """Results with ``place`` by falling value, null and NaN last (T6). One row per result: a report."""
    order = F.nanvl(F.coalesce(F.col(value), F.lit(-1.0)), F.lit(-1.0))
    return results.withColumn("place", F.rank().over(Window.orderBy(order.desc())).cast("bigint"))


def wide(metrics: DataFrame, rows: str, columns: str, value: str, names: Sequence[str]) -> DataFrame:
    """One row per ``rows``, a column per named set."""
    return metrics.groupBy(rows).pivot(columns, list(names)).agg(F.first(value))


def nested(metrics: DataFrame, detector: str, name: str, values: Sequence[str]) -> DataFrame:
    """One row per detector with a map of set to struct of metrics, for a JSON sink (K9)."""
    entries = F.collect_list(F.struct(F.col(name), F.struct(*values)))  # one entry per set
    return metrics.groupBy(detector).agg(F.map_from_entries(entries).alias("sets"))


def latest(paths: DataFrame, path: str = "path") -> DataFrame:
    """The greatest path of a listing."""
    return paths.agg(F.max(path).alias(path))
