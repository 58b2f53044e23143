"""The canonical fulfillment tables, derived from the star-schema Parquet tables by integer arithmetic.

Facts keep the raw keys, so nothing needs a global numbering. Those that models use again and again (``stored``) are
written once a session to the shared folder, so the raw tables are read once; the others are lazy DataFrames.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklane.operators import lifecycle
from stocklane.operators.storage import listing, once
from stocklane.sources.schemas import CARRIERS, EVENT_SOURCE

START = "TIMESTAMP_NTZ'2025-08-01 00:00:00'"
PAYMENTS = ("card", "wallet", "bank_transfer", "invoice")
#: Rows that a task of a shuffle of lines or orders gets: partitions by size in bytes hold many times as many of these narrow rows.
ROWS = 250_000


def after(start: str, amount: str, unit: str = "SECOND") -> Column:
    return F.expr(f"timestampadd({unit}, CAST({amount} AS INT), {start})")


def cents(amount: str) -> Column:
    return F.expr(f"CAST(CAST({amount} AS DECIMAL(12,0)) * 0.01BD AS DECIMAL(12,2))")


def pick(words: tuple[str, ...], index: str) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), F.expr(f"CAST({index} AS INT) + 1"))


def stored(build):
    """A table of ``Tables`` that is written once for a session and folder."""
    name = build.__name__.strip("_")
    return property(lambda self: once(self.spark, f"{self.variant if name in self.changed else 'plain'}:{self.sf_dir}", name, lambda: build(self), self.state))


class Tables:
    """Canonical tables by name, each built once for a session and folder."""

    #: The name of another derivation, and which of the stored tables it changes.
    variant, changed = "plain", ()
    #: Twelfths of a month's sales that come in each month, tenfold.
    restock = "5 + product_id % 10"

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def state(self) -> str:
        """Of the folder's files: tables that were written from other files are not used."""
        return listing(self.spark, self.sf_dir)

    @cached_property
    def pieces(self) -> int:
        """Partitions of a shuffle of lines or orders, so that a task gets about ``ROWS`` lines however many there are. The files' footers have the count."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.raw("lineitem").count() // ROWS))

    def dealt(self, df: DataFrame, key: str = "order_id") -> DataFrame:
        """``df`` by ``key`` in ``pieces``; frames dealt by one key join without another shuffle."""
        return df.repartition(self.pieces, key)

    def kept(self, name: str, sources: tuple[str, ...], build) -> DataFrame:
        """A small table derived from ``sources``, written once a session; variants share it where they do not change these."""
        variant = self.variant if set(sources) & set(self.changed) else "plain"
        return once(self.spark, f"{variant}:{self.sf_dir}", name, build, self.state)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @stored
    def _parts(self) -> DataFrame:
        """Part rows with their category and product number. Categories are few and numbered by name."""
        kinds = self.product_categories.select(F.col("category_name").alias("p_type"), "category_id")
        part = self.raw("part").join(F.broadcast(kinds), "p_type")
        return part.withColumn("product_id", F.expr("(CAST(substring(p_brand, 7) AS BIGINT) - 1) * 6 + category_id"))

    @cached_property
    def product_categories(self) -> DataFrame:
        kinds = self.raw("part").agg(F.array_sort(F.collect_set("p_type")).alias("names"))
        return kinds.select(F.posexplode("names").alias("at", "category_name")).select((F.col("at") + 1).cast("int").alias("category_id"), "category_name")

    @stored
    def products(self) -> DataFrame:
        one = self._parts.groupBy("product_id", "category_id").agg(F.max("p_retailprice").alias("price"), F.max("p_size").alias("size"), F.min("p_name").alias("product_name"))
        one = one.withColumn("price", F.expr("CAST(round(price * 100) AS BIGINT)"))
        return one.select(
            "product_id", F.format_string("SKU-%06d", "product_id").alias("sku"), "product_name", "category_id",
            cents("price").alias("unit_price"), cents("price * 6 DIV 10").alias("unit_cost"),
            F.expr("CAST(CAST(size AS DECIMAL(10,0)) * 0.1BD AS DECIMAL(10,3))").alias("weight_kg"), F.lit(True).alias("active"), F.expr(START).alias("created_at"),
        )

    @cached_property
    def warehouses(self) -> DataFrame:
        number = F.expr("CAST(r_regionkey + 1 AS INT)")
        return self.raw("region").select(
            number.alias("warehouse_id"), F.format_string("WH-%02d", number).alias("warehouse_code"), F.concat(F.lit("Warehouse "), "r_name").alias("warehouse_name"),
            F.initcap("r_name").alias("city"), F.upper(F.substring("r_name", 1, 2)).alias("country_code"), (number * 100_000).cast("int").alias("capacity_units"), F.expr(START).alias("created_at"),
        )

    @cached_property
    def _located(self) -> DataFrame:
        nation = self.raw("nation").join(F.broadcast(self.raw("region")), F.expr("n_regionkey = r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey", "r_name")
        return self.raw("customer").join(F.broadcast(nation), "c_nationkey")

    @cached_property
    def customers(self) -> DataFrame:
        return self._located.select(F.col("c_custkey").alias("customer_id"), F.format_string("CUS-%08d", "c_custkey").alias("customer_external_id"), F.col("n_name").alias("country_code"), F.col("r_name").alias("region"), F.expr(START).alias("created_at"))

    @stored
    def order_items(self) -> DataFrame:
        prices = self.products.select("product_id", "unit_price")
        parts = self._parts.select(F.col("p_partkey").alias("l_partkey"), "product_id")
        lines = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
        few = self.raw("part").count() <= ROWS
        lines = lines.join(F.broadcast(parts), "l_partkey") if few else self.dealt(lines, "l_partkey").join(self.dealt(parts, "l_partkey"), "l_partkey")
        lines = self.dealt(lines.select(F.col("l_orderkey").alias("order_id"), "product_id", F.expr("1 + l_linenumber % 4").alias("units")))
        one = lines.groupBy("order_id", "product_id").agg(F.sum("units").cast("int").alias("quantity"))
        return one.join(prices, "product_id").select(F.expr("order_id * 1000 + product_id").alias("order_item_id"), "order_id", "product_id", "quantity", "unit_price")

    @stored
    def _order_base(self) -> DataFrame:
        """Orders that have items, without their totals."""
        k = "o_orderkey"
        kept = self.dealt(self.raw("orders"), k).join(self.dealt(self.raw("lineitem").select(F.col("l_orderkey").alias(k)), k), k, "left_semi")
        placed = self.dealt(kept, "o_custkey").join(self._located.select(F.col("c_custkey").alias("o_custkey"), "n_name", "r_name", "n_regionkey"), "o_custkey")
        method = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'same_day' WHEN '2-HIGH' THEN 'express' ELSE 'standard' END")
        placed = placed.withColumn("shipping_method", method).withColumn("day", F.expr("datediff(CAST(o_orderdate AS DATE), DATE'1995-01-01') % 365"))
        placed = placed.withColumn("order_ts", after(START, f"day * 86400 + ({k} * 7919) % 86400"))
        return placed.select(
            F.col(k).alias("order_id"), F.format_string("ORD-%08d", k).alias("order_external_id"), F.col("o_custkey").alias("customer_id"), (F.col("n_regionkey") + 1).cast("int").alias("warehouse_id"),
            F.expr(f"CASE WHEN o_orderstatus = 'P' THEN 'cancelled' WHEN o_orderstatus = 'O' AND {k} % 5 = 0 THEN 'shipped' ELSE 'delivered' END").alias("order_status"),
            "shipping_method", pick(PAYMENTS, f"{k} % 4").alias("payment_method"), F.col("n_name").alias("destination_country"), F.col("r_name").alias("destination_region"), "order_ts",
            after("order_ts", "CASE shipping_method WHEN 'same_day' THEN 12 WHEN 'express' THEN 72 ELSE 144 END", "HOUR").alias("promised_delivery_ts"), F.col("order_ts").alias("created_at"),
        )

    @stored
    def orders(self) -> DataFrame:
        totals = lifecycle.order_totals(self.dealt(self._order_base), self.dealt(self.order_items.select("order_id", "quantity", "unit_price")))
        return totals.select(*[c for c in self._order_base.columns if c != "created_at"], "total_amount", "created_at")

    @cached_property
    def shipments(self) -> DataFrame:
        o = self._order_base.where("order_status <> 'cancelled'").withColumn("created", after("order_ts", "2 + order_id % 34", "HOUR")).withColumn("shipped_at", after("created", "1 + order_id % 3", "HOUR"))
        return o.select(
            F.col("order_id").alias("shipment_id"), F.format_string("SHP-%08d", "order_id").alias("shipment_external_id"), "order_id", "warehouse_id", pick(CARRIERS, "order_id % 5").alias("carrier"),
            F.expr("CASE WHEN order_status = 'shipped' THEN 'exception' ELSE 'delivered' END").alias("shipment_status"), "shipped_at",
            after("shipped_at", "CASE shipping_method WHEN 'same_day' THEN 10 WHEN 'express' THEN 60 ELSE 96 END", "HOUR").alias("expected_delivery_at"),
            F.when(F.col("order_status") == "delivered", after("shipped_at", "(order_id * 7) % 120", "HOUR")).alias("delivered_at"),
            cents("CASE shipping_method WHEN 'same_day' THEN 1800 WHEN 'express' THEN 1000 ELSE 500 END + order_id % 400").alias("shipping_cost"), F.col("created").alias("created_at"),
        )

    @cached_property
    def _timed(self) -> DataFrame:
        """Orders with their lifecycle milestones."""
        shipped = self.shipments.select("order_id", F.col("created_at").alias("shipment_created_ts"), F.col("shipped_at").alias("order_shipped_ts"), "delivered_at", "expected_delivery_at", "shipment_status")
        return lifecycle.milestones(self.dealt(self._order_base).join(self.dealt(shipped), "order_id", "left"))

    @stored
    def order_events(self) -> DataFrame:
        return lifecycle.order_events(self._timed, EVENT_SOURCE)

    @stored
    def _positions(self) -> DataFrame:
        """Stocked positions with the units that non-cancelled orders asked for."""
        sold = self.dealt(self.order_items.select("order_id", "product_id", "quantity")).join(self.dealt(self._order_base.select("order_id", "warehouse_id", "order_status")), "order_id")
        return sold.groupBy("warehouse_id", "product_id").agg(F.coalesce(F.sum(F.expr("CASE WHEN order_status <> 'cancelled' THEN quantity END")), F.lit(0)).alias("sold"))

    @cached_property
    def inventory(self) -> DataFrame:
        return self._positions.select(
            "warehouse_id", "product_id", F.expr("CAST(200 + (13 * product_id + 7 * warehouse_id) % 300 AS INT)").alias("on_hand_qty"), F.expr("CAST((product_id + warehouse_id) % 20 AS INT)").alias("reserved_qty"),
            F.expr("CAST(20 + product_id % 80 AS INT)").alias("reorder_point"), F.expr(START).alias("updated_at"),
        )

    @stored
    def inventory_movements(self) -> DataFrame:
        """Opening receipts, monthly receipts that follow demand, and the movements of order lines."""
        opening = lifecycle.opening_receipts(self.inventory, F.expr(START))
        monthly = self._positions.withColumn("quantity_change", F.expr(f"CAST(sold * ({self.restock}) DIV 120 AS INT)")).where("quantity_change > 0")
        monthly = monthly.select("*", F.explode(F.sequence(F.lit(1), F.lit(11))).alias("month")).select(
            F.expr("month * 10000 + warehouse_id * 1000 + product_id").alias("movement_id"), "warehouse_id", "product_id", F.lit(None).cast("bigint").alias("order_id"), F.lit("receipt").alias("movement_type"),
            "quantity_change", after("add_months(DATE'2025-08-01', month)", "0").alias("event_ts"),
        )
        lines = lifecycle.line_movements(self.dealt(self.order_items), lifecycle.stages(self._timed, lifecycle.MOVING))
        cols = ["movement_id", "warehouse_id", "product_id", "order_id", "movement_type", "quantity_change", "event_ts"]
        both = opening.select(cols).unionByName(monthly.withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz")).select(cols)).unionByName(lines.select(cols))
        return both.withColumn("created_at", F.col("event_ts"))

    def named(self, name: str) -> DataFrame:
        return getattr(self, name)
