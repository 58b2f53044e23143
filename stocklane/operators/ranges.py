"""Ranks and running sums of groups of any size: rows are range-partitioned, and each range adds what the ranges before it hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklane.operators.storage import materialize


def placed(df: DataFrame, order: list[str | Column], name: str = "ranges") -> DataFrame:
    """``df`` sorted by ``order`` over range partitions and written once, with ``_part`` (the range) and ``_at`` (the place in it)."""
    rows = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    return materialize(rows.withColumns({"_part": F.shiftright("_id", 33), "_at": F.expr("_id & 8589934591")}).drop("_id"), name)


def with_runs(parts: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """``parts`` joined with one row for each range and key, which a range holds without a gap."""
    runs = runs.withColumnsRenamed({k: f"_run_{k}" for k in [*keys, "_part"]})
    on = F.lit(True)
    for k in [*keys, "_part"]:
        on = on & F.col(k).eqNullSafe(F.col(f"_run_{k}"))
    return parts.join(runs, on).drop(*[f"_run_{k}" for k in [*keys, "_part"]])


def earlier(keys: list[str]):
    """The ranges before this one that hold the key: as many rows a key as there are ranges, whatever the size of the group."""
    return Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def ranks(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """Row numbers from 1 within ``keys`` by ``order`` (rows that tie are numbered in any order, the same on every read)."""
    parts = placed(df, [*[F.col(k).asc_nulls_first() for k in keys], *order])
    runs = parts.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier(keys)), F.lit(0))).drop("_n")
    return with_runs(parts, runs, keys).withColumn(name, F.expr("_at - _first + _before + 1")).drop("_part", "_at", "_first", "_before")


def dense_ranks(df: DataFrame, order: list[Column], value: list[str], name: str, among: DataFrame | None = None) -> DataFrame:
    """Dense ranks from 1 of the values ``value``, which ``order`` sorts, among those of ``among`` (``df`` itself). Only distinct values are ranked."""
    found = ranks((df if among is None else among).select(*value).distinct(), [], order, "_dense")
    found = found.select(*[F.col(v).alias(f"_of_{v}") for v in value], F.col("_dense"))
    on = F.lit(True)
    for v in value:
        on = on & F.col(v).eqNullSafe(F.col(f"_of_{v}"))
    return df.join(found, on).withColumn(name, F.col("_dense")).drop("_dense", *[f"_of_{v}" for v in value])


def quantiles(df: DataFrame, keys: list[str], column: str, points: dict[str, float]) -> DataFrame:
    """Exact quantiles of ``column`` for each of ``keys``, interpolated between neighbours. ``points``: new column to share.

    Equal values are counted first, and running counts over ranges of values find the ranks, so no key's values meet in one task.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_x")).agg(F.count(F.lit(1)).alias("_k"))
    upto = running(counted, keys, ["_x"], {"_upto": "_k"})
    sizes = upto.groupBy(*keys).agg(F.max("_upto").alias("_size")).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    at = {name: F.lit(p) * (F.col("_size") - 1) for name, p in points.items()}
    met = upto.join(sizes, on).groupBy(*keys, "_size")
    ends = met.agg(*[F.min(F.when(F.col("_upto") > rank(at[name]), F.col("_x"))).alias(f"_{side}_{name}") for name in points for side, rank in (("lo", F.floor), ("hi", F.ceil))])
    part = lambda name: at[name] - F.floor(at[name])
    return ends.select(*keys, *[((1 - part(name)) * F.col(f"_lo_{name}") + part(name) * F.col(f"_hi_{name}")).alias(name) for name in points])


def accumulate(parts: DataFrame, keys: list[str], sums: dict[str, str] | None = None, before: dict[str, str] | None = None) -> DataFrame:
    """Of a ``placed`` frame, sorted by ``keys`` first: running sums, the row itself included, and largest values of the rows before (null for none).
    Both map new columns to columns; the places stay, so one call can build on another."""
    sums, before = sums or {}, before or {}
    parts_of = parts.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_all_{name}") for name, c in sums.items()], *[F.max(c).alias(f"_all_{name}") for name, c in before.items()])
    runs = parts_of.withColumns(
        {f"_before_{name}": F.coalesce(F.sum(f"_all_{name}").over(earlier(keys)), F.lit(0)) for name in sums} | {f"_before_{name}": F.max(f"_all_{name}").over(earlier(keys)) for name in before}
    ).drop(*[f"_all_{name}" for name in (*sums, *before)])
    own = Window.partitionBy(*keys, "_part").orderBy("_at")
    local = parts.withColumns({name: F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, 0)) for name, c in sums.items()} | {name: F.max(c).over(own.rowsBetween(Window.unboundedPreceding, -1)) for name, c in before.items()})
    met = with_runs(local, runs, keys)
    met = met.withColumns({name: F.col(name) + F.col(f"_before_{name}") for name in sums} | {name: F.greatest(name, f"_before_{name}") for name in before})
    return met.drop(*[f"_before_{name}" for name in (*sums, *before)])


def running(df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """Running sums within ``keys`` by ``order``, the row itself included. ``sums``: new column to summed column."""
    parts = placed(df, [*[F.col(k).asc_nulls_first() for k in keys], *order])
    return accumulate(parts, keys, sums).drop("_part", "_at")
