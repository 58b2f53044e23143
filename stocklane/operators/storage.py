"""Tables in the shared folder that cut the lineage of a plan."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names; a temporary one only in a local session without the setting (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='stocklane-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables written in this process: path and schema by application, source, name and state of the source's files.
_WRITTEN: dict[tuple[str, str, str, str], tuple[str, StructType]] = {}


def listing(spark: SparkSession, folder: str) -> str:
    """A digest of names, sizes and times of the Parquet files below ``folder``; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    row = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return f"{row[0]}:{row[1]}"


def once(spark: SparkSession, source: str, name: str, build, state: str = "") -> DataFrame:
    """The table ``name`` over ``source``, written on its first use in a session and read by every later one.

    ``state`` tells states of the source apart (see ``listing``); a table of another state is written anew.
    """
    key = (spark.sparkContext.applicationId, source, name, state)
    if key in _WRITTEN:
        path, schema = _WRITTEN[key]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:  # the shared folder was cleared
            del _WRITTEN[key]
    df, path = build(), new_path(spark, name)
    df.write.parquet(path)
    _WRITTEN[key] = (path, df.schema)
    return spark.read.schema(df.schema).parquet(path)


def forget(source: str | None = None) -> None:
    """Tables of ``source`` (or all) are built anew on their next use."""
    for key in [k for k in _WRITTEN if source in (None, k[1])]:
        del _WRITTEN[key]
