"""Helpers that the training-data operators share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a step sees at once: so many rows, or so many bytes of text, whichever comes first; a longer text comes alone.
ROWS = 1024
BYTES = 512_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in a local session without the setting (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='stocklane-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than this share of all rows is hot: there are no more than 10,000 such keys, whatever the input.
HOT_SHARE = 10_000
HOT_LEAST = 1000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], copies: str) -> DataFrame:
    """``rows`` left joined with ``table`` (a row a key; both are tables on disk). ``copies``: a column of ``table``, how many
    rows have its key. The rows of hot keys meet a broadcast and stay where they are, so no task gets a hot key."""
    hot = F.col(copies) > max(HOT_LEAST, rows.count() // HOT_SHARE)
    if not table.where(hot).limit(1).count():
        return rows.join(table, keys, "left")
    met = rows.join(F.broadcast(table.where(hot)), keys, "left")
    rest = met.where(F.col(copies).isNull()).select(rows.columns).join(table.where(~hot), keys, "left")
    return met.where(F.col(copies).isNotNull()).unionByName(rest)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(part: pa.RecordBatch):
    """``part`` in slices of at most ``ROWS`` rows and ``BYTES`` bytes of text (or one row)."""
    sizes = np.zeros(part.num_rows, np.int64)
    for column in part.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            sizes += np.asarray(pc.fill_null(pc.binary_length(column), 0))
    total, at = np.cumsum(sizes), 0
    while at < part.num_rows:
        most = int(np.searchsorted(total, (total[at - 1] if at else 0) + BYTES, "right"))
        end = max(at + 1, min(at + ROWS, most))
        yield part.slice(at, end - at)
        at = end


def batches(frame: DataFrame, step, schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one slice of a record batch that returns a dict of columns.

    A step's memory follows ``BYTES`` of text (or the longest text), whatever the size of Arrow's batches.
    """
    from pyspark.sql.types import StructType

    fields = frame.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    assert isinstance(fields, StructType)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(parts):
        for part in parts:
            for own in slices(part):
                out = step(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else _flat(out[f.name], f.type) for f in arrow],
                    schema=arrow,
                )
        pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds nothing of the last

    return frame.mapInArrow(run, fields)


def _flat(column, kind):
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column if column.type == kind else column.cast(kind)
