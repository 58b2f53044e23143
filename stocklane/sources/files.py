"""CSV and Parquet in and out: contracts on headers and types, publication of the canonical tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocklane.operators.storage import new_path
from stocklane.sources.schemas import SCHEMAS
from stocklane.sources.versions import publish

STAMP = "yyyy-MM-dd'T'HH:mm:ss"
#: The tables that ``publish_tables`` publishes, parents first; ``publish_all_tables`` adds the two largest facts.
PUBLISHED = ("product_categories", "products", "warehouses", "customers", "inventory", "orders", "order_items", "shipments")
FACTS = ("inventory_movements", "order_events")


def sink_csv(df: DataFrame, path: str) -> None:
    """Headered CSV with ISO timestamps in UTC; quotes are doubled, so quoted newlines survive."""
    df.write.option("header", True).option("timestampNTZFormat", STAMP).option("escape", '"').csv(path)


def scan_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Typed rows; a header that differs from the schema in names or order, or a broken row, is an error."""
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    return reader.option("timestampNTZFormat", STAMP).option("multiLine", True).option("escape", '"').csv(path)


def scan_contract(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A canonical table's CSV under its column contract; an empty file is an error."""
    df = scan_csv(spark, path, SCHEMAS[table])
    if not df.limit(1).count():
        raise ValueError(f"{table}: no rows in {path}")
    return df


PARITIES = "file string, start bigint, odd bigint, even_ends bigint, odd_ends bigint"


def line_ends(parts):
    """For each byte range, in Arrow batches of its lines in order (value, file, start): whether it holds an odd number of quotes, and how many lines
    end a record if the range begins outside quotes (``even_ends``) or inside (``odd_ends``). Blank lines outside quotes are no records."""
    own, odd, even_ends, odd_ends = None, 0, 0, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([own[0]]), *(pa.array([int(x)]) for x in (own[1], odd, even_ends, odd_ends))], names=[f.split()[0] for f in PARITIES.split(", ")])

    for part in parts:
        quotes, lengths = np.asarray(pc.count_substring(part.column(0), '"')), np.asarray(pc.binary_length(part.column(0)))
        starts = np.asarray(part.column(2))
        places = list(zip(part.column(1).to_pylist(), starts.tolist(), strict=True))
        edges = [0, *(k for k in range(1, len(places)) if places[k] != places[k - 1]), len(places)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if own != places[a]:
                if own is not None:
                    yield row()
                own, odd, even_ends, odd_ends = places[a], 0, 0, 0
            upto = (odd + np.cumsum(quotes[a:b])) % 2
            before = np.concatenate([[odd], upto[:-1]])
            blank = (lengths[a:b] == 0) | (pc.utf8_trim(part.column(0).slice(a, b - a), "\r").to_numpy(zero_copy_only=False) == "")
            even_ends += int(((upto == 0) & ~(blank & (before == 0))).sum())
            odd_ends += int(((upto == 1) & ~(blank & (before == 1))).sum())
            odd = int(upto[-1])
    if own is not None:
        yield row()


def count_records(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Logical records: a quoted newline does not end one. A file of any size is counted in many tasks: each byte range gives its quotes' parity
    and its line ends for both states, and the parity of the ranges before it says which of them count. One header a file is left out.

    Quotes stand around whole values and are doubled inside them, as ``sink_csv`` writes them.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    ranges = lines.mapInArrow(line_ends, PARITIES)
    # A row for each byte range, whatever the number of records.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1
    files = ranges.withColumn("ends", F.when(inside, F.col("odd_ends")).otherwise(F.col("even_ends"))).groupBy("file").agg(F.greatest(F.sum("ends") - 1, F.lit(0)).alias("records"))
    return files.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records")).select(F.lit(name).alias("table"), "records")


def through_csv(df: DataFrame, table: str) -> str:
    path = new_path(df.sparkSession, f"csv-{table}")
    sink_csv(df.select([f.split()[0] for f in SCHEMAS[table].split(", ")]), path)
    return path


def scan_csv_contract(t) -> DataFrame:
    return scan_contract(t.spark, through_csv(t.order_items, "order_items"), "order_items").withColumn("unit_price", F.col("unit_price").cast("double"))


def scan_csv_typed(t) -> DataFrame:
    return scan_csv(t.spark, through_csv(t.order_events, "order_events"), SCHEMAS["order_events"]).select("event_id", "event_ts", "ingested_at", "payload")


def sink_csv_back(t) -> DataFrame:
    return scan_contract(t.spark, through_csv(t.shipments, "shipments"), "shipments").withColumn("shipping_cost", F.col("shipping_cost").cast("double"))


def csv_records(t) -> DataFrame:
    return count_records(t.spark, through_csv(t.order_events, "order_events"), "order_events")


def publish_tables(t) -> DataFrame:
    """The eight tables of its fixed oracle text; ``publish_all_tables`` is the whole load."""
    return publish({name: t.named(name) for name in PUBLISHED}, new_path(t.spark, "published"))


def publish_all_tables(t) -> DataFrame:
    """All ten canonical tables written, and their counts compared."""
    return publish({name: t.named(name) for name in (*PUBLISHED, *FACTS)}, new_path(t.spark, "published"))


NAMES = {"product_categories": "c_categories", "products": "c_products", "warehouses": "c_warehouses", "customers": "c_customers", "inventory": "c_inventory", "orders": "c_orders", "order_items": "c_items", "shipments": "c_shipments"}
ALL_NAMES = NAMES | {"inventory_movements": "c_movements", "order_events": "c_events"}
TEXTS = {
    "scan_csv_contract": (scan_csv_contract, "SELECT order_item_id, order_id, product_id, quantity, CAST(unit_price AS DOUBLE) AS unit_price FROM c_items"),
    "scan_csv_typed": (scan_csv_typed, "SELECT event_id, event_ts, ingested_at, payload FROM c_events"),
    "count_records": (csv_records, "SELECT 'order_events' AS \"table\", count(*) AS records FROM c_events"),
    "sink_csv": (sink_csv_back, "SELECT * REPLACE (CAST(shipping_cost AS DOUBLE) AS shipping_cost) FROM c_shipments"),
    "publish_tables": (publish_tables, " UNION ALL ".join(f"SELECT '{k}' AS \"table\", count(*) AS expected, count(*) AS actual, true AS passed FROM {v}" for k, v in NAMES.items())),
    "publish_all_tables": (publish_all_tables, " UNION ALL ".join(f"SELECT '{k}' AS \"table\", count(*) AS expected, count(*) AS actual, true AS passed FROM {v}" for k, v in ALL_NAMES.items())),
}


def registered():
    for name, (build, text) in TEXTS.items():
        yield name, build, text
