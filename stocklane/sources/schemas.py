"""The ten canonical tables: explicit schemas, keys and domains."""

from __future__ import annotations

#: Column contracts, in file order.
SCHEMAS = {
    "product_categories": "category_id INT, category_name STRING",
    "products": "product_id BIGINT, sku STRING, product_name STRING, category_id INT, unit_price DECIMAL(12,2), unit_cost DECIMAL(12,2), weight_kg DECIMAL(10,3), active BOOLEAN, created_at TIMESTAMP_NTZ",
    "warehouses": "warehouse_id INT, warehouse_code STRING, warehouse_name STRING, city STRING, country_code STRING, capacity_units INT, created_at TIMESTAMP_NTZ",
    "customers": "customer_id BIGINT, customer_external_id STRING, country_code STRING, region STRING, created_at TIMESTAMP_NTZ",
    "inventory": "warehouse_id INT, product_id BIGINT, on_hand_qty INT, reserved_qty INT, reorder_point INT, updated_at TIMESTAMP_NTZ",
    "orders": "order_id BIGINT, order_external_id STRING, customer_id BIGINT, warehouse_id INT, order_status STRING, shipping_method STRING, payment_method STRING, destination_country STRING, destination_region STRING, order_ts TIMESTAMP_NTZ, promised_delivery_ts TIMESTAMP_NTZ, total_amount DECIMAL(14,2), created_at TIMESTAMP_NTZ",
    "order_items": "order_item_id BIGINT, order_id BIGINT, product_id BIGINT, quantity INT, unit_price DECIMAL(12,2)",
    "shipments": "shipment_id BIGINT, shipment_external_id STRING, order_id BIGINT, warehouse_id INT, carrier STRING, shipment_status STRING, shipped_at TIMESTAMP_NTZ, expected_delivery_at TIMESTAMP_NTZ, delivered_at TIMESTAMP_NTZ, shipping_cost DECIMAL(12,2), created_at TIMESTAMP_NTZ",
    "inventory_movements": "movement_id BIGINT, warehouse_id INT, product_id BIGINT, order_id BIGINT, movement_type STRING, quantity_change INT, event_ts TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ",
    "order_events": "event_id BIGINT, event_key STRING, order_id BIGINT, warehouse_id INT, event_type STRING, event_ts TIMESTAMP_NTZ, source STRING, payload STRING, ingested_at TIMESTAMP_NTZ",
}
#: Allowed words.
ORDER_STATUSES = ("created", "payment_confirmed", "processing", "packed", "shipped", "delivered", "cancelled")
SHIPPING_METHODS = ("standard", "express", "same_day")
SHIPMENT_STATUSES = ("pending", "label_created", "in_transit", "delivered", "exception", "returned")
MOVEMENT_TYPES = ("receipt", "reservation", "release", "shipment", "adjustment", "return")
EVENT_TYPES = (
    "order_created", "payment_confirmed", "inventory_reserved", "processing_started", "order_packed", "shipment_created",
    "order_shipped", "order_delivered", "delivery_exception", "order_cancelled", "inventory_released",
)
CARRIERS = ("DHL", "UPS", "FedEx", "DPD", "GLS")
EVENT_SOURCE = "synthetic_generator"
