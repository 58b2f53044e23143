"""Data-quality checks: each gives rows (check, table, violations, passed); nothing is raised, so a report shows all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdicts(counts: DataFrame, table: str) -> DataFrame:
    """A one-row frame of violation counts, turned into a row each."""
    pairs = ", ".join(f"'{c}', CAST(coalesce(`{c}`, 0) AS BIGINT)" for c in counts.columns)
    long = counts.selectExpr(f"stack({len(counts.columns)}, {pairs}) AS (check, violations)")
    return long.select("check", F.lit(table).alias("table"), "violations", (F.col("violations") == 0).alias("passed"))


def violations(df: DataFrame, table: str, rules: dict[str, str | Column]) -> DataFrame:
    """Rows that break each rule (a condition that is true for a violation), in one pass."""
    return verdicts(df.agg(*[F.count_if(F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in rules.items()]), table)


def not_null(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    return violations(df, table, {f"not_null:{c}": F.col(c).isNull() for c in columns})


def unique(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Rows beyond the first of their key; counted per key, so a hot key is combined before the shuffle."""
    extra = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.sum("n").alias("unique:" + ",".join(keys)))
    return verdicts(extra, table)


def foreign_key(child: DataFrame, table: str, column: str, parent: DataFrame, key: str | None = None) -> DataFrame:
    """Children whose non-null reference has no parent."""
    orphans = child.where(F.col(column).isNotNull()).select(column).join(parent.select(F.col(key or column).alias(column)), column, "left_anti")
    return verdicts(orphans.agg(F.count(F.lit(1)).alias(f"foreign_key:{column}")), table)


#: Types of whole numbers.
WHOLE = {"tinyint", "smallint", "int", "bigint"}


def keys(frames: dict[str, DataFrame], unique: list[tuple[str, list[str]]], references: list[tuple[str, str, str]]) -> DataFrame:
    """``unique`` (table, columns) and ``foreign_key`` (table, column, parent) checks of all tables at once.

    Each table gives a row for each key it holds, and one with their number for the keys that its rows refer to together. Rows are counted by key
    before and after one shuffle, so a hot key is one row a task. Count 0 of a key is its owner's, the others are those of the tables that refer to
    it. Up to two whole numbers stay numbers, other keys are texts.
    """
    spaces = [(k, tuple(c)) for k, c in unique] + [(parent, (c,)) for _, c, parent in references]
    spaces = list(dict.fromkeys(spaces))
    kinds = {k: dict(df.dtypes) for k, df in frames.items()}
    texts = {at for at, (k, columns) in enumerate(spaces) if len(columns) > 2 or not {kinds[k][c] for c in columns} <= WHOLE}
    texts |= {spaces.index((parent, (c,))) for k, c, parent in references if kinds[k][c] not in WHOLE}
    owned, referred = {k: [] for k in frames}, {k: [] for k in frames}
    for at, (k, columns) in enumerate(spaces):
        owned[k].append((at, 0, columns))
    checks, used = [], [0] * len(spaces)
    for k, columns in unique:
        checks.append((f"unique:{','.join(columns)}", k, spaces.index((k, tuple(columns))), 0))
    for k, c, parent in references:
        at = spaces.index((parent, (c,)))
        used[at] += 1
        referred[k].append((at, used[at], (c,)))
        checks.append((f"foreign_key:{c}", k, at, used[at]))

    def emitted(at: int, slot: int, columns: tuple[str, ...]) -> Column:
        whole = [F.col(c).cast("bigint") for c in columns] if at not in texts else []
        one = F.col(columns[0]).cast("string") if len(columns) == 1 else F.to_json(F.struct(*columns))
        none = F.lit(None)
        pair = [*whole, none.cast("bigint"), none.cast("bigint")][:2]
        return F.struct(F.lit(at).alias("space"), F.lit(slot).alias("slot"), pair[0].alias("a"), pair[1].alias("b"), (none.cast("string") if whole else one).alias("key"))

    parts = []
    for k, df in frames.items():
        if owned[k]:
            parts.append(df.select(F.inline(F.array(*[emitted(*x) for x in owned[k]])), F.lit(1).cast("bigint").alias("rows")))
        if referred[k]:
            per = df.groupBy(*dict.fromkeys(c for _, _, (c,) in referred[k])).agg(F.count(F.lit(1)).alias("rows"))
            parts.append(per.select(F.inline(F.array(*[emitted(*x) for x in referred[k]])), "rows").where("a IS NOT NULL OR key IS NOT NULL"))
    slots = range(max(used) + 1)
    counted = combined(parts).groupBy("space", "a", "b", "key").agg(*[F.sum(F.when(F.col("slot") == s, F.col("rows")).otherwise(0)).alias(f"n{s}") for s in slots])
    broken = [F.when(F.col("n0") > 0, F.col("n0") - 1).otherwise(0), *[F.when(F.col("n0") == 0, F.col(f"n{s}")).otherwise(0) for s in slots[1:]]]
    sums = counted.groupBy("space").agg(*[F.sum(x).alias(f"x{s}") for s, x in enumerate(broken)])
    one = sums.agg(*[F.coalesce(F.max(F.when(F.col("space") == at, F.col(f"x{slot}"))), F.lit(0)).alias(f"c{i}") for i, (_, _, at, slot) in enumerate(checks)])
    pairs = ", ".join(f"'{name}', '{k}', c{i}" for i, (name, k, _, _) in enumerate(checks))
    long = one.selectExpr(f"stack({len(checks)}, {pairs}) AS (check, table, violations)")
    return long.withColumn("passed", F.col("violations") == 0)


def domain(df: DataFrame, table: str, column: str, allowed: tuple[str, ...]) -> DataFrame:
    return violations(df, table, {f"domain:{column}": ~F.col(column).isin(*allowed)})


def expected_count(df: DataFrame, table: str, expected: int) -> DataFrame:
    return verdicts(df.agg(F.abs(F.count(F.lit(1)) - F.lit(expected)).alias("expected_count")), table)


def missing(parent: DataFrame, child: DataFrame, on: list[str], table: str, name: str) -> DataFrame:
    """Rows of ``parent`` without a match."""
    return verdicts(parent.select(*on).join(child.select(*on).distinct(), on, "left_anti").agg(F.count(F.lit(1)).alias(name)), table)


def drift(df: DataFrame, table: str, column: str, expected: dict[str, float], tolerance: float) -> DataFrame:
    """Values whose share differs from the expected share by more than ``tolerance``; absent values have share 0."""
    shares = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(column) == v).alias(f"v{k}") for k, v in enumerate(expected)])
    rules = {f"drift:{column}={v}": (F.abs(F.col(f"v{k}") / F.nullif(F.col("n").cast("double"), F.lit(0.0)) - F.lit(e)) > tolerance).cast("int") for k, (v, e) in enumerate(expected.items())}
    return verdicts(shares.select(*[F.coalesce(c, F.lit(0)).alias(name) for name, c in rules.items()]), table)


def combined(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
