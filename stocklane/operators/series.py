"""Dense series, lags and rolling windows that never look ahead, event pivots and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def date_spine(df: DataFrame, ts: str, name: str = "demand_date") -> DataFrame:
    """Every day from the first to the last date of ``ts``; no rows for an empty input."""
    ends = df.agg(F.min(F.to_date(ts)).alias("lo"), F.max(F.to_date(ts)).alias("hi")).where("lo IS NOT NULL")
    return ends.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias(name))


def dense(spine: DataFrame, positions: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """A row per spine day and position, facts joined where there are any.

    The spine is a calendar, so its broadcast is bounded by the number of days.
    """
    return positions.crossJoin(F.broadcast(spine)).join(facts, on, "left")


def lags(keys: list[str], order: str, column: str, steps: tuple[int, ...], pattern: str = "lag_{}_units") -> dict[str, Column]:
    w = Window.partitionBy(*keys).orderBy(order)
    return {pattern.format(k): F.lag(column, k).over(w) for k in steps}


def before(keys: list[str], order: str, rows: int):
    """The ``rows`` rows before the current one."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-rows, -1)


def ahead(keys: list[str], order: str, rows: int):
    """The current row and those after it, ``rows`` in all."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(0, rows - 1)


def so_far(keys: list[str], order: str | list):
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(Window.unboundedPreceding, 0)


def first_times(events: DataFrame, keys: list[str], kinds: dict[str, str], kind: str = "event_type", ts: str = "event_ts") -> list[Column]:
    """First time of each kind, as aggregates to group by ``keys``. ``kinds``: kind to column name."""
    return [F.min(F.when(F.col(kind) == k, F.col(ts))).alias(name) for k, name in kinds.items()]


def share(count: str = "n", within: list[str] | None = None) -> Column:
    """A count's percentage of the total, over already aggregated rows."""
    from stocklane.functions.columns import percent

    return percent(count, F.sum(count).over(Window.partitionBy(*(within or [F.lit(1)]))))


def chronological_ids(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Numbers from 1 in the order of ``order`` (unique together) without a single-partition window.

    Rows are range-partitioned and sorted, each partition counts its rows, and the counts before it are its offset.
    The range split is written once, so both passes see the same partitions.
    """
    from stocklane.operators.storage import materialize

    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: as many as there are partitions, whatever the number of rows.
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    own = Window.partitionBy("_part").orderBy(*order)
    numbered = parts.join(F.broadcast(offsets), "_part").withColumn(name, F.row_number().over(own) + F.col("_before"))
    return numbered.drop("_part", "_before")
