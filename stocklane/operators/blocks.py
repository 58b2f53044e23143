"""Series of any length in many tasks: blocks of days with a halo of the days around them.

A series is cut into blocks of ``DAYS`` days. Rows near an end of a block are copied to its neighbour, so lags and windows that reach up to
``BEFORE`` days back and ``AFTER`` days ahead lie inside a block; the copies are dropped at the end. Running sums start from what
the days before a block's halo add up to, a small table by key and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a block, of the halo before it and of the halo after it.
DAYS, BEFORE, AFTER = 128, 28, 6
BLOCK, OWN = "_block", "_own"


def number(date: str, shift: int = 0) -> Column:
    return F.expr(f"CAST(floor((datediff({date}, DATE'1970-01-01') + {shift}) / {DAYS}) AS BIGINT)")


def with_halo(df: DataFrame, date: str) -> DataFrame:
    """Every row in its block (``_own``) and, where it is near enough, as a copy in the block before or after."""
    places = F.array_distinct(F.array(number(date), number(date, BEFORE), number(date, -AFTER)))
    return df.withColumn(BLOCK, F.explode(places)).withColumn(OWN, F.col(BLOCK) == number(date))


def own(df: DataFrame) -> DataFrame:
    """The rows without the copies."""
    return df.where(OWN).drop(BLOCK, OWN)


def with_starts(df: DataFrame, changes: DataFrame, keys: list[str], date: str, sums: dict[str, str], spine: DataFrame) -> DataFrame:
    """``df`` (``with_halo``) with what ``changes`` add up to before each block's halo.

    ``sums``: new column to column of ``changes``; ``spine``: the days that the series have. The table that is joined has a row for each key and block
    of days, so the window over one key's rows is short however many changes it has.
    """
    per = changes.groupBy(*keys, number(date, BEFORE).alias("_at")).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    upto = Window.partitionBy(*keys).orderBy("_at")
    last = spine.agg((F.max(number(date)) + 1).alias("_end"))
    found = per.select(*keys, (F.col("_at") + 1).alias("_from"), F.lead("_at").over(upto).alias("_till"), *[F.sum(name).over(upto).alias(name) for name in sums]).crossJoin(F.broadcast(last))
    blocks = F.expr("sequence(_from, coalesce(_till, greatest(_end, _from)))")
    starts = found.select(*keys, F.explode(blocks).alias(BLOCK), *sums)
    return df.join(starts, [*keys, BLOCK], "left").withColumns({name: F.coalesce(name, F.lit(0)) for name in sums})
