"""Two more bindings of the canonical tables, on which every branch and every check shows.

``Scarce`` holds so little stock that each stock status, risk band and target value occurs. ``Damaged`` breaks the sound
tables by rules on their keys, so that each check counts violations.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklane.sources.binding import Tables

#: The scarce stock of a position that sold ``sold`` units, in SQL that Spark and DuckDB read alike.
SCARCE = {
    "on_hand_qty": "CAST(floor(sold * (product_id % 7) / 12) + warehouse_id AS INT)", "reserved_qty": "CAST((product_id + warehouse_id) % 20 AS INT)",
    "reorder_point": "CAST(CASE WHEN product_id % 3 = 0 THEN 0 ELSE floor(sold / 24) + 1 END AS INT)",
}
SCARCE_RESTOCK = "2 + product_id % 12"

#: By table the columns that are damaged, and conditions of the rows that are kept and of those that are repeated.
DAMAGE: dict[str, tuple[dict[str, str], str, str]] = {
    "product_categories": ({"category_name": "CASE WHEN category_id IN (2, 3) THEN 'X' ELSE category_name END"}, "true", "false"),
    "products": ({
        "unit_cost": "CASE WHEN product_id % 5 = 0 THEN CAST(unit_price + 1 AS DECIMAL(12,2)) ELSE unit_cost END", "sku": "CASE WHEN product_id % 7 = 0 THEN 'SKU-0' ELSE sku END",
        "unit_price": "CASE WHEN product_id % 11 = 0 THEN CAST(-1 AS DECIMAL(12,2)) ELSE unit_price END", "weight_kg": "CASE WHEN product_id % 13 = 0 THEN CAST(0 AS DECIMAL(10,3)) ELSE weight_kg END",
        "category_id": "CASE WHEN product_id % 17 = 0 THEN 99 ELSE category_id END", "product_name": "CASE WHEN product_id % 19 = 0 THEN NULL ELSE product_name END",
    }, "true", "false"),
    "warehouses": ({"capacity_units": "CASE WHEN warehouse_id = 2 THEN 0 ELSE capacity_units END", "warehouse_code": "CASE WHEN warehouse_id = 3 THEN 'WH-01' ELSE warehouse_code END"}, "true", "warehouse_id = 4"),
    "customers": ({"customer_external_id": "CASE WHEN customer_id % 50 = 0 THEN 'CUS-0' ELSE customer_external_id END", "country_code": "CASE WHEN customer_id % 60 = 0 THEN NULL ELSE country_code END"}, "true", "customer_id % 70 = 0"),
    "inventory": ({
        "on_hand_qty": "CASE WHEN product_id % 17 = 0 THEN -5 WHEN product_id % 19 = 0 THEN on_hand_qty + 1 ELSE on_hand_qty END",
        "reserved_qty": "CASE WHEN product_id % 23 = 0 THEN 10000 WHEN product_id % 29 = 0 THEN -1 ELSE reserved_qty END", "reorder_point": "CASE WHEN product_id % 31 = 0 THEN NULL ELSE reorder_point END",
    }, "true", "product_id % 37 = 0"),
    "orders": ({
        "total_amount": "CASE WHEN order_id % 97 = 0 THEN CAST(total_amount + 1 AS DECIMAL(14,2)) WHEN order_id % 197 = 0 THEN CAST(-1 AS DECIMAL(14,2)) ELSE total_amount END",
        "promised_delivery_ts": "CASE WHEN order_id % 101 = 0 THEN order_ts - INTERVAL 1 HOUR ELSE promised_delivery_ts END",
        "shipping_method": "CASE WHEN order_id % 103 = 0 THEN 'drone' WHEN order_id % 199 = 0 THEN NULL ELSE shipping_method END",
        "order_status": "CASE WHEN order_id % 107 = 0 THEN 'lost' WHEN order_id % 109 = 0 THEN 'cancelled' ELSE order_status END",
        "customer_id": "CASE WHEN order_id % 113 = 0 THEN -1 WHEN order_id % 127 = 0 THEN NULL ELSE customer_id END",
        "order_external_id": "CASE WHEN order_id % 131 = 0 THEN 'ORD-0' ELSE order_external_id END", "warehouse_id": "CASE WHEN order_id % 137 = 0 THEN 99 ELSE warehouse_id END",
    }, "true", "false"),
    "order_items": ({
        "quantity": "CASE WHEN order_item_id % 149 = 0 THEN 0 WHEN order_item_id % 151 = 0 THEN quantity + 1 ELSE quantity END",
        "unit_price": "CASE WHEN order_item_id % 157 = 0 THEN CAST(-1 AS DECIMAL(12,2)) ELSE unit_price END", "product_id": "CASE WHEN order_item_id % 163 = 0 THEN -product_id ELSE product_id END",
    }, "order_id % 211 <> 0", "order_item_id % 167 = 0"),
    "shipments": ({
        "delivered_at": "CASE WHEN shipment_id % 53 = 0 THEN NULL WHEN shipment_id % 59 = 0 THEN shipped_at - INTERVAL 5 HOUR WHEN shipment_id % 61 = 0 THEN shipped_at + INTERVAL 5 HOUR ELSE delivered_at END",
        "shipped_at": "CASE WHEN shipment_id % 67 = 0 THEN shipped_at - INTERVAL 90 DAY WHEN shipment_id % 71 = 0 THEN NULL ELSE shipped_at END",
        "expected_delivery_at": "CASE WHEN shipment_id % 73 = 0 THEN expected_delivery_at - INTERVAL 90 DAY WHEN shipment_id % 79 = 0 THEN NULL ELSE expected_delivery_at END",
        "carrier": "CASE WHEN shipment_id % 83 = 0 THEN NULL WHEN shipment_id % 89 = 0 THEN 'PIGEON' ELSE carrier END", "warehouse_id": "CASE WHEN shipment_id % 97 = 0 THEN 99 ELSE warehouse_id END",
        "shipment_status": "CASE WHEN shipment_id % 101 = 0 THEN 'vanished' ELSE shipment_status END", "shipping_cost": "CASE WHEN shipment_id % 103 = 0 THEN CAST(-1 AS DECIMAL(12,2)) ELSE shipping_cost END",
        "shipment_external_id": "CASE WHEN shipment_id % 107 = 0 THEN 'SHP-0' ELSE shipment_external_id END",
    }, "shipment_id % 113 <> 0", "shipment_id % 109 = 0"),
    "inventory_movements": ({
        "quantity_change": "CASE WHEN movement_id % 41 = 0 THEN -quantity_change WHEN movement_id % 43 = 0 THEN 0 ELSE quantity_change END", "movement_type": "CASE WHEN movement_id % 47 = 0 THEN 'theft' ELSE movement_type END",
        "order_id": "CASE WHEN movement_id % 53 = 0 THEN NULL WHEN movement_type = 'receipt' AND movement_id % 5 = 0 THEN 1 ELSE order_id END", "product_id": "CASE WHEN movement_id % 59 = 0 THEN -1 ELSE product_id END",
        "warehouse_id": "CASE WHEN movement_id % 61 = 0 THEN 99 ELSE warehouse_id END",
    }, "true", "false"),
    "order_events": ({
        "event_type": "CASE WHEN event_id % 41 = 0 THEN 'sneezed' ELSE event_type END", "source": "CASE WHEN event_id % 43 = 0 THEN 'x' ELSE source END",
        "payload": "CASE WHEN event_id % 47 = 0 THEN '[]' WHEN event_id % 59 = 0 THEN NULL ELSE payload END", "event_ts": "CASE WHEN event_id % 61 = 0 THEN event_ts - INTERVAL 2 DAY ELSE event_ts END",
        "event_key": "CASE WHEN event_id % 67 = 0 THEN 'EVT-0' ELSE event_key END", "order_id": "CASE WHEN event_id % 79 = 0 THEN -1 ELSE order_id END", "warehouse_id": "CASE WHEN event_id % 83 = 0 THEN 99 ELSE warehouse_id END",
    }, "event_id % 73 <> 0", "event_id % 71 = 0"),
}


class Scarce(Tables):
    """The sound tables with little stock: opening stock, reorder points and receipts follow what a position sells."""

    variant, changed, restock = "scarce", ("inventory_movements",), SCARCE_RESTOCK

    @cached_property
    def inventory(self) -> DataFrame:
        own = [F.expr(x).alias(c) for c, x in SCARCE.items()]
        return self._positions.select("warehouse_id", "product_id", *own, F.lit("2025-08-01 00:00:00").cast("timestamp_ntz").alias("updated_at"))


class Damaged(Tables):
    """The sound tables after ``DAMAGE``; what is derived from others is derived before the damage."""

    variant, changed = "damaged", tuple(DAMAGE)

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir)
        self.sound = Tables(spark, sf_dir)

    def broken(self, name: str) -> DataFrame:
        sound = self.sound.named(name)
        columns, kept, repeated = DAMAGE[name]
        rows = sound.where(kept).unionByName(sound.where(f"({kept}) AND ({repeated})"))
        return rows.select(*[F.expr(columns.get(c, c)).alias(c) for c in sound.columns])


for _name in DAMAGE:
    setattr(Damaged, _name, property(lambda self, name=_name: self.broken(name)))
