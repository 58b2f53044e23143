"""Publication of several tables at once: staged, verified, then switched for readers by one row of a log.

A folder holds ``versions/<version>/<table>``, whole tables of each publication, and ``log``, a row for each publication that was
verified. Readers take the newest row of the log, so they see all tables of one publication or all of another. A writer that dies leaves files
that no row names; the row itself appears when its one file does. Publications that run side by side get different versions, and
the one with the higher number, of equal ones the greater version, counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = "number bigint, version string, tables array<string>"


def fingerprint(df: DataFrame) -> list[Column]:
    """Rows, and a sum over their hashes in which a row counts as often as it occurs; sums of parts add up to that of the whole."""
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")), F.lit(0)).alias("digest")]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def newest(spark: SparkSession, folder: str) -> tuple[int, str | None, list[str]]:
    """Number, version and tables of the publication that counts; 0 and none before the first."""
    if not exists(spark, f"{folder}/log"):
        return 0, None, []
    row = spark.read.schema(LOG).json(f"{folder}/log").orderBy(F.desc("number"), F.desc("version")).first()
    return (row["number"], row["version"], row["tables"]) if row else (0, None, [])


def place(folder: str, version: str, name: str) -> str:
    return f"{folder}/versions/{version}/{name}"


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the newest publication."""
    _, version, tables = newest(spark, folder)
    if version is None or name not in tables:
        raise ValueError(f"{folder} holds no {name}")
    return spark.read.parquet(place(folder, version, name))


def stage(df: DataFrame, path: str, split: str | None) -> dict:
    """Write ``df``; what it held as it was written."""
    seen = Observation()
    writer = df.observe(seen, *fingerprint(df)).write
    (writer.partitionBy(split) if split else writer).parquet(path)
    return seen.get


def read_back(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    back = spark.read.parquet(path)
    if sorted(back.columns) != sorted(columns):
        raise ValueError(f"columns changed on disk: {', '.join(back.columns)}")
    return back.select([F.col(f"`{c}`") for c in columns])


def measured(back: DataFrame) -> dict:
    return back.agg(*fingerprint(back)).first().asDict()


def publish(tables: dict[str, DataFrame], folder: str, replace: bool = False, split: str | None = None) -> DataFrame:
    """Publish ``tables`` together; a row a table: rows written, rows read back, whether rows, digest and types agree.

    Nothing that readers see changes before every table is on disk and verified. Unless ``replace``, a folder that already holds one of
    the tables is refused before the first write. ``split``: a column whose values become folders.
    """
    spark = next(iter(tables.values())).sparkSession
    number, _, known = newest(spark, folder)
    if not replace and (taken := [name for name in tables if name in known or exists(spark, f"{folder}/{name}")]):
        raise ValueError(f"{folder} already holds {', '.join(taken)}")
    version = uuid.uuid4().hex
    rows = []
    for name, df in tables.items():
        wrote = stage(df, place(folder, version, name), split)
        back = read_back(spark, place(folder, version, name), df.columns)
        got = measured(back)
        rows.append((name, wrote["rows"], got["rows"], (wrote["rows"], int(wrote["digest"]), df.dtypes) == (got["rows"], int(got["digest"]), back.dtypes)))
    if wrong := [name for name, _, _, passed in rows if not passed]:
        raise ValueError(f"{', '.join(wrong)}: rows differ after the write")
    spark.createDataFrame([(number + 1, version, list(tables))], LOG).coalesce(1).write.mode("append").json(f"{folder}/log")
    return spark.createDataFrame(rows, "table string, expected bigint, actual bigint, passed boolean")
