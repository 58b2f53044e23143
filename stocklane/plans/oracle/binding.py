"""DuckDB text of the canonical tables, and small text helpers. Written apart from the Spark side."""

from __future__ import annotations

PARTS = {
    "c_categories": "SELECT CAST(row_number() OVER (ORDER BY p_type) AS INTEGER) AS category_id, p_type AS category_name FROM (SELECT DISTINCT p_type FROM part)",
    "c_parts": "SELECT p.*, category_id, (CAST(substr(p_brand, 7) AS BIGINT) - 1) * 6 + category_id AS product_id FROM part p JOIN c_categories ON p_type = category_name",
    "c_products": """SELECT product_id, printf('SKU-%06d', product_id) AS sku, min(p_name) AS product_name, category_id,
  CAST(CAST(CAST(round(max(p_retailprice) * 100) AS BIGINT) AS DECIMAL(12,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS unit_price,
  CAST(CAST(CAST(round(max(p_retailprice) * 100) AS BIGINT) * 6 // 10 AS DECIMAL(12,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS unit_cost,
  CAST(CAST(max(p_size) AS DECIMAL(10,0)) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(10,3)) AS weight_kg, true AS active, TIMESTAMP '2025-08-01' AS created_at FROM c_parts GROUP BY product_id, category_id""",
    "c_warehouses": """SELECT CAST(r_regionkey + 1 AS INTEGER) AS warehouse_id, printf('WH-%02d', r_regionkey + 1) AS warehouse_code, 'Warehouse ' || r_name AS warehouse_name,
  array_to_string(list_transform(string_split(lower(r_name), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS city, upper(substr(r_name, 1, 2)) AS country_code,
  CAST((r_regionkey + 1) * 100000 AS INTEGER) AS capacity_units, TIMESTAMP '2025-08-01' AS created_at FROM region""",
    "c_customers": """SELECT c_custkey AS customer_id, printf('CUS-%08d', c_custkey) AS customer_external_id, n_name AS country_code, r_name AS region, TIMESTAMP '2025-08-01' AS created_at, CAST(r_regionkey + 1 AS INTEGER) AS home
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "c_items": """SELECT order_id * 1000 + product_id AS order_item_id, order_id, product_id, quantity, unit_price FROM (
  SELECT l_orderkey AS order_id, product_id, CAST(sum(1 + l_linenumber % 4) AS INTEGER) AS quantity FROM lineitem JOIN c_parts ON l_partkey = p_partkey GROUP BY ALL) JOIN c_products USING (product_id)""",
    "c_order_base": """SELECT *, order_ts + to_hours(CASE shipping_method WHEN 'same_day' THEN 12 WHEN 'express' THEN 72 ELSE 144 END) AS promised_delivery_ts, order_ts AS created_at FROM (
  SELECT o_orderkey AS order_id, printf('ORD-%08d', o_orderkey) AS order_external_id, o_custkey AS customer_id, home AS warehouse_id,
    CASE WHEN o_orderstatus = 'P' THEN 'cancelled' WHEN o_orderstatus = 'O' AND o_orderkey % 5 = 0 THEN 'shipped' ELSE 'delivered' END AS order_status,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'same_day' WHEN '2-HIGH' THEN 'express' ELSE 'standard' END AS shipping_method,
    ['card', 'wallet', 'bank_transfer', 'invoice'][o_orderkey % 4 + 1] AS payment_method, country_code AS destination_country, region AS destination_region,
    TIMESTAMP '2025-08-01' + to_seconds(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 365 * 86400 + (o_orderkey * 7919) % 86400) AS order_ts
  FROM orders JOIN c_customers ON o_custkey = customer_id WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))""",
    "c_orders": """SELECT b.*, CAST(coalesce(t, 0) AS DECIMAL(14,2)) AS total_amount FROM c_order_base b LEFT JOIN (SELECT order_id, sum(quantity * unit_price) AS t FROM c_items GROUP BY order_id) USING (order_id)""",
    "c_shipments": """SELECT order_id AS shipment_id, printf('SHP-%08d', order_id) AS shipment_external_id, order_id, warehouse_id, ['DHL', 'UPS', 'FedEx', 'DPD', 'GLS'][order_id % 5 + 1] AS carrier,
  CASE WHEN order_status = 'shipped' THEN 'exception' ELSE 'delivered' END AS shipment_status, shipped_at,
  shipped_at + to_hours(CASE shipping_method WHEN 'same_day' THEN 10 WHEN 'express' THEN 60 ELSE 96 END) AS expected_delivery_at,
  CASE WHEN order_status = 'delivered' THEN shipped_at + to_hours(order_id * 7 % 120) END AS delivered_at,
  CAST(CAST(CASE shipping_method WHEN 'same_day' THEN 1800 WHEN 'express' THEN 1000 ELSE 500 END + order_id % 400 AS DECIMAL(12,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS shipping_cost, created_at
  FROM (SELECT order_id, warehouse_id, order_status, shipping_method, order_ts + to_hours(2 + order_id % 34) AS created_at, order_ts + to_hours(3 + order_id % 34 + order_id % 3) AS shipped_at FROM c_order_base WHERE order_status <> 'cancelled')""",
    "c_timed": """SELECT *, CASE WHEN stage = 'post_reservation' THEN order_cancelled_ts + to_minutes(1 + order_id % 15) END AS inventory_released_ts FROM (
  SELECT *, CASE stage WHEN 'pre_payment' THEN order_ts WHEN 'post_payment' THEN pay WHEN 'post_reservation' THEN res END + to_minutes(5 + order_id % 10) AS order_cancelled_ts FROM (
  SELECT order_id, warehouse_id, order_status, stage, order_ts, s_created, s_shipped, s_status, s_delivered, s_expected, CAST(coalesce(pack0 > s_created, false) AS INTEGER) AS compressed,
    CASE WHEN pack0 > s_created THEN order_ts + to_seconds(gap * 15 // 100) ELSE pay0 END AS pay, CASE WHEN pack0 > s_created THEN order_ts + to_seconds(gap * 30 // 100) ELSE res0 END AS res,
    CASE WHEN pack0 > s_created THEN order_ts + to_seconds(gap * 50 // 100) ELSE proc0 END AS proc, CASE WHEN pack0 > s_created THEN order_ts + to_seconds(gap * 80 // 100) ELSE pack0 END AS pack
  FROM (SELECT o.order_id, o.warehouse_id, order_status, order_ts, s.created_at AS s_created, shipped_at AS s_shipped, shipment_status AS s_status, delivered_at AS s_delivered, expected_delivery_at AS s_expected,
      CASE WHEN order_status = 'cancelled' THEN ['pre_payment', 'post_payment', 'post_reservation'][o.order_id % 3 + 1] END AS stage, greatest(date_diff('second', order_ts, s.created_at), 5) AS gap,
      order_ts + to_minutes(1 + o.order_id % 20) AS pay0, order_ts + to_minutes(2 + o.order_id % 20 + o.order_id % 15) AS res0, order_ts + to_minutes(7 + o.order_id % 20 + o.order_id % 15 + o.order_id % 41) AS proc0,
      order_ts + to_minutes(67 + o.order_id % 20 + o.order_id % 15 + o.order_id % 41 + 60 * (o.order_id % 8)) AS pack0
    FROM c_order_base o LEFT JOIN c_shipments s USING (order_id))))""",
    "c_events": """SELECT order_id * 16 + seq AS event_id, printf('EVT-%09d', order_id * 16 + seq) AS event_key, order_id, warehouse_id, event_type, event_ts, 'synthetic_generator' AS source,
  '{"order_id":' || order_id || CASE WHEN event_type = 'order_cancelled' THEN ',"stage":"' || stage || '"' ELSE '' END || ',"status":"' || order_status || '"}' AS payload, event_ts + to_seconds(1) AS ingested_at FROM (
  SELECT order_id, warehouse_id, order_status, stage, 0 AS seq, 'order_created' AS event_type, order_ts AS event_ts FROM c_timed
  UNION ALL SELECT order_id, warehouse_id, order_status, stage, 1, 'payment_confirmed', pay FROM c_timed WHERE stage IS NULL OR stage <> 'pre_payment'
  UNION ALL SELECT order_id, warehouse_id, order_status, stage, 2, 'inventory_reserved', res FROM c_timed WHERE stage IS NULL OR stage = 'post_reservation'
  UNION ALL SELECT order_id, warehouse_id, order_status, stage, 3, 'processing_started', proc FROM c_timed WHERE stage IS NULL
  UNION ALL SELECT order_id, warehouse_id, order_status, stage, 4, 'order_packed', pack FROM c_timed WHERE stage IS NULL
  UNION ALL SELECT order_id, warehouse_id, order_status, stage, 5, 'shipment_created', s_created FROM c_timed WHERE stage IS NULL
  UNION ALL SELECT order_id, warehouse_id, order_status, stage, 6, 'order_shipped', s_shipped FROM c_timed WHERE stage IS NULL
  UNION ALL SELECT order_id, warehouse_id, order_status, stage, 7, 'order_delivered', s_delivered FROM c_timed WHERE s_status = 'delivered'
  UNION ALL SELECT order_id, warehouse_id, order_status, stage, 8, 'delivery_exception', s_expected FROM c_timed WHERE s_status = 'exception'
  UNION ALL SELECT order_id, warehouse_id, order_status, stage, 9, 'order_cancelled', order_cancelled_ts FROM c_timed WHERE stage IS NOT NULL
  UNION ALL SELECT order_id, warehouse_id, order_status, stage, 10, 'inventory_released', inventory_released_ts FROM c_timed WHERE stage = 'post_reservation')""",
    "c_positions": "SELECT warehouse_id, product_id, CAST(coalesce(sum(quantity) FILTER (WHERE order_status <> 'cancelled'), 0) AS BIGINT) AS sold FROM c_items JOIN c_order_base USING (order_id) GROUP BY ALL",
    "c_inventory": """SELECT warehouse_id, product_id, CAST(200 + (13 * product_id + 7 * warehouse_id) % 300 AS INTEGER) AS on_hand_qty, CAST((product_id + warehouse_id) % 20 AS INTEGER) AS reserved_qty,
  CAST(20 + product_id % 80 AS INTEGER) AS reorder_point, TIMESTAMP '2025-08-01' AS updated_at FROM c_positions""",
    "c_movements": """SELECT *, event_ts AS created_at FROM (
  SELECT warehouse_id * 1000 + product_id AS movement_id, warehouse_id, product_id, CAST(NULL AS BIGINT) AS order_id, 'receipt' AS movement_type, on_hand_qty AS quantity_change, TIMESTAMP '2025-08-01' AS event_ts FROM c_inventory
  UNION ALL SELECT m * 10000 + warehouse_id * 1000 + product_id, warehouse_id, product_id, NULL, 'receipt', CAST(sold * (5 + product_id % 10) // 120 AS INTEGER), TIMESTAMP '2025-08-01' + to_months(CAST(m AS INTEGER)) FROM c_positions, range(1, 12) t(m) WHERE sold * (5 + product_id % 10) // 120 > 0
  UNION ALL SELECT 1000000 + order_item_id * 4 + CASE event_type WHEN 'inventory_reserved' THEN 1 WHEN 'inventory_released' THEN 2 ELSE 3 END, warehouse_id, product_id, i.order_id,
    CASE event_type WHEN 'inventory_reserved' THEN 'reservation' WHEN 'inventory_released' THEN 'release' ELSE 'shipment' END, CASE WHEN event_type = 'inventory_released' THEN quantity ELSE -quantity END, event_ts
    FROM c_items i JOIN c_events e USING (order_id) WHERE event_type IN ('inventory_reserved', 'inventory_released', 'order_shipped'))""",
}
NAMES = {
    "product_categories": "c_categories", "products": "c_products", "warehouses": "c_warehouses", "customers": "c_customers", "inventory": "c_inventory", "orders": "c_orders",
    "order_items": "c_items", "shipments": "c_shipments", "inventory_movements": "c_movements", "order_events": "c_events",
}


def bound(body: str, **more: str) -> str:
    """``body`` behind the common table expressions that it uses."""
    from stocklane.plans.oracle.views import VIEWS

    from stocklane.plans import dq, reports

    known = PARTS | VIEWS | reports.MORE | dq.MORE | more
    used: set[str] = set()

    def need(text: str) -> None:
        import re

        for name in set(re.findall(r"\b[cv]_\w+\b", text)) & known.keys() - used:
            used.add(name)
            need(known[name])

    need(body + " " + " ".join(more.values()))
    used |= more.keys()
    order = [k for k in known if k in used]
    return "WITH " + ",\n".join(f"{k} AS MATERIALIZED ({known[k]})" for k in order) + "\n" + body if order else body


def r(x: str, digits: int = 2) -> str:
    """Half away from zero, by plain arithmetic on doubles."""
    u = float(10**digits)
    return f"(sign(CAST({x} AS DOUBLE)) * (floor(abs(CAST({x} AS DOUBLE)) * {u} + 0.5) / {u}) + 0.0)"


def pct(a: str, b: str) -> str:
    return r(f"100.0::DOUBLE * CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)")


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def n(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def total(x: str, condition: str | None = None) -> str:
    return f"CAST(sum({x})" + (f" FILTER (WHERE {condition})" if condition else "") + " AS BIGINT)"


def secs(a: str, b: str) -> str:
    return f"date_diff('second', {a}, {b})"


def span(a: str, b: str, unit: float) -> str:
    return r(f"{secs(a, b)} / {unit}::DOUBLE")


def mean_span(a: str, b: str, unit: float, condition: str | None = None) -> str:
    f = f" FILTER (WHERE {condition})" if condition else ""
    return r(f"CAST(sum({secs(a, b)}){f} AS DOUBLE) / nullif(CAST(count({secs(a, b)}){f} AS DOUBLE), 0) / {unit}::DOUBLE")


def mean(x: str, condition: str | None = None, digits: int = 2) -> str:
    """The mean of whole numbers or decimals from an exact sum."""
    f = f" FILTER (WHERE {condition})" if condition else ""
    return r(f"CAST(sum({x}){f} AS DOUBLE) / nullif(CAST(count({x}){f} AS DOUBLE), 0)", digits)
