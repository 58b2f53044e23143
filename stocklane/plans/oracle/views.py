"""DuckDB text of the analytical models, written apart from the Spark side over the bound tables."""

from __future__ import annotations

from stocklane.plans.oracle.binding import div, n, pct, r, secs, span, total

KINDS = ("receipt", "reservation", "release", "shipment")
STAGES = {
    "order_created": "order_created_event_ts", "payment_confirmed": "payment_confirmed_ts", "inventory_reserved": "inventory_reserved_ts", "processing_started": "processing_started_ts",
    "order_packed": "order_packed_ts", "shipment_created": "shipment_created_event_ts", "order_shipped": "order_shipped_event_ts", "order_delivered": "order_delivered_event_ts",
    "delivery_exception": "delivery_exception_ts", "order_cancelled": "order_cancelled_ts",
}
P = "PARTITION BY warehouse_id, product_id ORDER BY demand_date"
WEEK, MONTH, NEXT = (f"({P} ROWS BETWEEN {f})" for f in ("7 PRECEDING AND 1 PRECEDING", "28 PRECEDING AND 1 PRECEDING", "CURRENT ROW AND 6 FOLLOWING"))


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def dow(x: str) -> str:
    return f"CAST(isodow({x}) AS INTEGER)"


def bit(x: str) -> str:
    return f"CAST(coalesce({x}, false) AS INTEGER)"


def part(name: str, x: str) -> str:
    return f"CAST({name}({x}) AS INTEGER)"


def supply(a: str, avg: str) -> str:
    return f"CASE WHEN {a} <= 0 THEN 0.0::DOUBLE WHEN {avg} > 0 THEN {r(div(a, avg))} END"


VIEWS = {
    "v_m1_items": f"SELECT order_id, count(*) AS order_item_lines, {total('quantity')} AS units_ordered, count(DISTINCT product_id) AS distinct_products, {r('sum(quantity * unit_price)')} AS item_gross_value, {r(div('sum(unit_price)', 'count(unit_price)'))} AS average_item_price FROM c_items GROUP BY order_id",
    "v_m1_shipments": f"SELECT order_id, count(*) AS shipment_count, min(shipment_id) AS shipment_id, min(shipment_external_id) AS shipment_external_id, min(carrier) AS carrier, min(shipment_status) AS shipment_status, min(shipped_at) AS shipped_at, min(expected_delivery_at) AS expected_delivery_at, min(delivered_at) AS delivered_at, {r('sum(shipping_cost)')} AS shipping_cost FROM c_shipments GROUP BY order_id",
    "v_m1_events": "SELECT order_id, count(*) AS lifecycle_event_count, min(event_ts) AS first_event_ts, max(event_ts) AS last_event_ts, " + ", ".join(f"min(event_ts) FILTER (WHERE event_type = '{k}') AS {v}" for k, v in STAGES.items()) + " FROM c_events GROUP BY order_id",
    "v_m1": f"""SELECT o.order_id, order_external_id, o.customer_id, customer_external_id, c.country_code AS customer_country_code, c.region AS customer_region, o.warehouse_id, warehouse_code, warehouse_name, w.city AS warehouse_city,
  w.country_code AS warehouse_country_code, capacity_units AS warehouse_capacity_units, order_status, shipping_method, payment_method, destination_country, destination_region, order_ts, promised_delivery_ts, o.created_at AS order_record_created_at,
  CAST(total_amount AS DOUBLE) AS total_amount, CAST(order_ts AS DATE) AS order_date, CAST(date_trunc('week', order_ts) AS DATE) AS order_week, CAST(date_trunc('month', order_ts) AS DATE) AS order_month, {part('year', 'order_ts')} AS order_year,
  {part('month', 'order_ts')} AS order_month_number, {dow('order_ts')} AS order_day_of_week, {part('hour', 'order_ts')} AS order_hour, {bit('isodow(order_ts) > 5')} AS is_weekend,
  coalesce(order_item_lines, 0) AS order_item_lines, coalesce(units_ordered, 0) AS units_ordered, coalesce(distinct_products, 0) AS distinct_products, coalesce(item_gross_value, 0) AS item_gross_value, coalesce(average_item_price, 0) AS average_item_price,
  coalesce(shipment_count, 0) AS shipment_count, shipment_id, shipment_external_id, carrier, shipment_status, shipped_at, expected_delivery_at, delivered_at, coalesce(shipping_cost, 0) AS shipping_cost,
  {bit("order_status = 'cancelled'")} AS is_cancelled, {bit('shipment_id IS NOT NULL')} AS has_shipment, {bit("shipment_status = 'delivered'")} AS is_delivered, {bit("shipment_status = 'exception'")} AS is_delivery_exception,
  {bit("shipment_status = 'delivered' AND delivered_at > expected_delivery_at")} AS is_late_delivery, {bit("shipment_status = 'delivered' AND delivered_at <= expected_delivery_at")} AS is_on_time_delivery,
  coalesce(lifecycle_event_count, 0) AS lifecycle_event_count, first_event_ts, last_event_ts, {', '.join(STAGES.values())},
  {span('order_created_event_ts', 'payment_confirmed_ts', 60)} AS payment_confirmation_minutes, {span('payment_confirmed_ts', 'inventory_reserved_ts', 60)} AS inventory_reservation_minutes, {span('inventory_reserved_ts', 'processing_started_ts', 60)} AS processing_start_minutes,
  {span('processing_started_ts', 'order_packed_ts', 3600)} AS packing_hours, {span('order_ts', 'shipped_at', 3600)} AS order_to_ship_hours, {span('shipped_at', 'delivered_at', 3600)} AS transit_hours, {span('order_ts', 'delivered_at', 3600)} AS order_to_delivery_hours,
  {span('shipped_at', 'expected_delivery_at', 3600)} AS expected_transit_hours, {span('expected_delivery_at', 'delivered_at', 3600)} AS delivery_variance_hours,
  CASE WHEN order_status = 'cancelled' THEN CASE WHEN payment_confirmed_ts IS NULL THEN 'pre_payment' WHEN inventory_reserved_ts IS NULL THEN 'post_payment' ELSE 'post_reservation' END END AS cancellation_stage
  FROM c_orders o LEFT JOIN c_customers c USING (customer_id) LEFT JOIN c_warehouses w ON o.warehouse_id = w.warehouse_id LEFT JOIN v_m1_items USING (order_id) LEFT JOIN v_m1_shipments USING (order_id) LEFT JOIN v_m1_events USING (order_id)""",
    "v_m2_spine": "SELECT CAST(d AS DATE) AS demand_date FROM (SELECT unnest(generate_series(min(CAST(order_ts AS DATE)), max(CAST(order_ts AS DATE)), INTERVAL 1 DAY)) AS d FROM c_orders)",
    "v_m2_positions": """SELECT category_id, product_id, warehouse_id, on_hand_qty, reserved_qty, reorder_point, warehouse_code, warehouse_name, w.city AS warehouse_city, w.country_code AS warehouse_country_code, sku, product_name,
  CAST(unit_price AS DOUBLE) AS catalog_unit_price, CAST(unit_cost AS DOUBLE) AS catalog_unit_cost, CAST(weight_kg AS DOUBLE) AS weight_kg, category_name FROM c_inventory JOIN c_warehouses w USING (warehouse_id) JOIN c_products USING (product_id) JOIN c_categories USING (category_id)""",
    "v_m2_tx": f"""SELECT CAST(order_ts AS DATE) AS demand_date, warehouse_id, product_id, count(DISTINCT order_id) AS gross_order_count, {total('quantity')} AS gross_units_requested, {r('sum(quantity * unit_price)')} AS gross_requested_value,
  count(DISTINCT order_id) FILTER (WHERE order_status <> 'cancelled') AS order_count, coalesce({total('quantity', "order_status <> 'cancelled'")}, 0) AS units_sold,
  {r("coalesce(sum(quantity * unit_price) FILTER (WHERE order_status <> 'cancelled'), 0)")} AS revenue, count(DISTINCT order_id) FILTER (WHERE order_status = 'cancelled') AS cancelled_order_count,
  coalesce({total('quantity', "order_status = 'cancelled'")}, 0) AS cancelled_units, {r(div("sum(unit_price) FILTER (WHERE order_status <> 'cancelled')", "count(unit_price) FILTER (WHERE order_status <> 'cancelled')"))} AS avg_selling_price
  FROM c_orders JOIN c_items USING (order_id) GROUP BY ALL""",
    "v_m2_base": f"""SELECT demand_date, product_id, warehouse_id, category_id, on_hand_qty AS snapshot_on_hand_qty, reserved_qty AS snapshot_reserved_qty, reorder_point AS snapshot_reorder_point, warehouse_code, warehouse_name, warehouse_city, warehouse_country_code,
  sku, product_name, catalog_unit_price, catalog_unit_cost, weight_kg, category_name, coalesce(gross_order_count, 0) AS gross_order_count, coalesce(gross_units_requested, 0) AS gross_units_requested, coalesce(gross_requested_value, 0) AS gross_requested_value,
  coalesce(order_count, 0) AS order_count, coalesce(units_sold, 0) AS units_sold, coalesce(revenue, 0) AS revenue, coalesce(cancelled_order_count, 0) AS cancelled_order_count, coalesce(cancelled_units, 0) AS cancelled_units, avg_selling_price,
  CAST(date_trunc('week', demand_date) AS DATE) AS demand_week, CAST(date_trunc('month', demand_date) AS DATE) AS demand_month, {part('year', 'demand_date')} AS demand_year, {part('month', 'demand_date')} AS demand_month_number, {dow('demand_date')} AS day_of_week,
  {part('dayofyear', 'demand_date')} AS day_of_year, {bit('isodow(demand_date) > 5')} AS is_weekend, {r('catalog_unit_price - catalog_unit_cost')} AS catalog_unit_margin,
  CASE WHEN catalog_unit_price > 0 THEN {r('(catalog_unit_price - catalog_unit_cost) / catalog_unit_price * 100')} END AS catalog_margin_pct
  FROM v_m2_spine CROSS JOIN v_m2_positions LEFT JOIN v_m2_tx USING (demand_date, warehouse_id, product_id)""",
    "v_m2": f"""SELECT *, {', '.join(f'lag(units_sold, {k}) OVER ({P}) AS lag_{k}_units' for k in (1, 7, 14, 28))}, {big(f'sum(units_sold) OVER {WEEK}')} AS rolling_7d_units, {r(div(f'sum(units_sold) OVER {WEEK}', f'count(units_sold) OVER {WEEK}'))} AS rolling_7d_avg_units,
  {big(f'sum(units_sold) OVER {MONTH}')} AS rolling_28d_units, {r(div(f'sum(units_sold) OVER {MONTH}', f'count(units_sold) OVER {MONTH}'))} AS rolling_28d_avg_units, {big(f'sum(order_count) OVER {WEEK}')} AS rolling_7d_orders,
  CAST(sum(CAST(round(revenue * 100) AS BIGINT)) OVER {WEEK} AS DOUBLE) / 100.0::DOUBLE AS rolling_7d_revenue FROM v_m2_base""",
    "v_m3_moves": f"""SELECT CAST(event_ts AS DATE) AS demand_date, warehouse_id, product_id, count(*) AS movement_event_count, {', '.join(f"{n(f"movement_type = '{k}'")} AS {k}_event_count, coalesce({total('abs(quantity_change)', f"movement_type = '{k}'")}, 0) AS {k}_units" for k in KINDS)}
  FROM c_movements WHERE CAST(event_ts AS DATE) BETWEEN (SELECT min(demand_date) FROM v_m2_spine) AND (SELECT max(demand_date) FROM v_m2_spine) GROUP BY ALL""",
    "v_m3_ledger": f"""SELECT *, receipt_units - shipment_units AS net_on_hand_change, reservation_units - release_units - shipment_units AS net_reserved_change, receipt_units - reservation_units + release_units AS net_available_change FROM (
  SELECT d.*, coalesce(movement_event_count, 0) AS movement_event_count, {', '.join(f'coalesce({k}_event_count, 0) AS {k}_event_count, coalesce({k}_units, 0) AS {k}_units' for k in KINDS)} FROM v_m2 d LEFT JOIN v_m3_moves USING (demand_date, warehouse_id, product_id))""",
    "v_m3_state": f"""SELECT *, {', '.join(f'lag(ending_{x}_qty) OVER ({P}) AS prior_day_{x}_qty' for x in ('on_hand', 'reserved', 'available'))} FROM (SELECT *, ending_on_hand_qty - ending_reserved_qty AS ending_available_qty FROM (
  SELECT *, {big(f'sum(net_on_hand_change) OVER ({P} ROWS UNBOUNDED PRECEDING)')} AS ending_on_hand_qty, {big(f'sum(net_reserved_change) OVER ({P} ROWS UNBOUNDED PRECEDING)')} AS ending_reserved_qty FROM v_m3_ledger))""",
    "v_m3": f"""SELECT *, {bit('ending_available_qty <= 0')} AS is_stockout, {bit('ending_available_qty > 0 AND ending_available_qty <= snapshot_reorder_point')} AS is_below_reorder_point, {bit('ending_available_qty <= snapshot_reorder_point')} AS requires_reorder,
  {bit('receipt_units > 0')} AS is_receipt_day, {bit('reservation_units > 0')} AS has_reservation_activity, {bit('shipment_units > 0')} AS has_shipment_activity, greatest(snapshot_reorder_point - ending_available_qty, 0) AS reorder_gap_units,
  CASE WHEN ending_on_hand_qty > 0 THEN {pct('ending_reserved_qty', 'ending_on_hand_qty')} END AS reserved_inventory_pct, {supply('ending_available_qty', 'rolling_7d_avg_units')} AS days_of_supply_7d, {supply('ending_available_qty', 'rolling_28d_avg_units')} AS days_of_supply_28d,
  CASE WHEN ending_available_qty > 0 THEN {r(div('rolling_28d_units', 'ending_available_qty'), 4)} END AS demand_inventory_pressure_28d,
  CASE WHEN ending_available_qty <= 0 THEN 'STOCKOUT' WHEN ending_available_qty <= snapshot_reorder_point THEN 'CRITICAL' WHEN ending_available_qty <= snapshot_reorder_point * 1.5 THEN 'LOW' ELSE 'HEALTHY' END AS stock_status FROM v_m3_state""",
    "v_m4_items": f"SELECT order_id, count(*) AS order_item_lines, {total('quantity')} AS total_units, count(DISTINCT product_id) AS distinct_products, {r(div('sum(unit_price)', 'count(unit_price)'))} AS avg_item_price, {r('max(unit_price)')} AS max_item_price FROM c_items GROUP BY order_id",
    "v_m4_weight": f"SELECT order_id, {r('sum(quantity * weight_kg)', 3)} AS total_weight_kg FROM c_items JOIN c_products USING (product_id) GROUP BY order_id",
    "v_m4": f"""SELECT *, CASE WHEN order_value > 0 THEN {pct('shipping_cost', 'order_value')} END AS shipping_cost_pct_of_order, CASE WHEN total_units > 0 THEN {r(div('shipping_cost', 'total_units'))} END AS shipping_cost_per_unit,
  CASE WHEN total_weight_kg > 0 THEN {r(div('shipping_cost', 'total_weight_kg'))} END AS shipping_cost_per_kg FROM (
  SELECT s.warehouse_id, s.order_id, shipment_id, shipment_external_id, carrier, shipment_status, shipped_at, expected_delivery_at, delivered_at, CAST(shipping_cost AS DOUBLE) AS shipping_cost, order_external_id, destination_country, destination_region, shipping_method,
  payment_method, CAST(total_amount AS DOUBLE) AS order_value, order_ts, promised_delivery_ts, warehouse_code, warehouse_name, w.city AS warehouse_city, w.country_code AS warehouse_country_code, coalesce(order_item_lines, 0) AS order_item_lines, coalesce(total_units, 0) AS total_units,
  coalesce(distinct_products, 0) AS distinct_products, avg_item_price, max_item_price, total_weight_kg, CAST(order_ts AS DATE) AS order_date, {part('hour', 'order_ts')} AS order_hour, {dow('order_ts')} AS order_day_of_week, {part('month', 'order_ts')} AS order_month,
  {bit('isodow(order_ts) > 5')} AS order_is_weekend, CAST(shipped_at AS DATE) AS ship_date, {part('hour', 'shipped_at')} AS ship_hour, {dow('shipped_at')} AS ship_day_of_week, {bit('isodow(shipped_at) > 5')} AS ship_is_weekend, {span('order_ts', 'shipped_at', 3600)} AS processing_hours,
  {span('order_ts', 'promised_delivery_ts', 3600)} AS promised_total_hours, {span('shipped_at', 'expected_delivery_at', 3600)} AS expected_transit_hours, {bit("shipment_status = 'exception'")} AS is_delivery_exception,
  {bit("shipment_status = 'delivered' AND delivered_at > expected_delivery_at")} AS is_late_delivery, {bit("shipment_status = 'delivered'")} AS is_delivered, {span('shipped_at', 'delivered_at', 3600)} AS actual_transit_hours, {span('expected_delivery_at', 'delivered_at', 3600)} AS delivery_delay_hours
  FROM c_shipments s JOIN c_orders USING (order_id) JOIN c_warehouses w ON s.warehouse_id = w.warehouse_id LEFT JOIN v_m4_items ON s.order_id = v_m4_items.order_id LEFT JOIN v_m4_weight ON s.order_id = v_m4_weight.order_id)""",
    "v_m5_history": f"""SELECT demand_date, warehouse_id, warehouse_code, product_id, sku, category_name, snapshot_reorder_point, units_sold, revenue, ending_on_hand_qty, ending_reserved_qty, ending_available_qty, prior_day_on_hand_qty, prior_day_reserved_qty, prior_day_available_qty,
  lag_1_units, lag_7_units, lag_14_units, lag_28_units, count(units_sold) OVER {WEEK} AS historical_observation_days_7d, {big(f'sum(units_sold) OVER {WEEK}')} AS historical_7d_units, {div(f'sum(units_sold) OVER {WEEK}', f'count(units_sold) OVER {WEEK}')} AS historical_7d_avg_units,
  count(units_sold) OVER {MONTH} AS historical_observation_days_28d, {big(f'sum(units_sold) OVER {MONTH}')} AS historical_28d_units, {div(f'sum(units_sold) OVER {MONTH}', f'count(units_sold) OVER {MONTH}')} AS historical_28d_avg_units,
  CASE WHEN count(units_sold) OVER {MONTH} > 1 THEN sqrt(CAST(count(units_sold) OVER {MONTH} * sum(units_sold * units_sold) OVER {MONTH} - (sum(units_sold) OVER {MONTH}) * (sum(units_sold) OVER {MONTH}) AS DOUBLE) / CAST((count(units_sold) OVER {MONTH}) * (count(units_sold) OVER {MONTH} - 1) AS DOUBLE)) END AS historical_28d_demand_stddev,
  {', '.join(f'{big(f"sum({k}_units) OVER {WEEK}")} AS historical_7d_{k}_units' for k in KINDS)}, count(*) OVER {NEXT} AS future_observation_days, min(ending_available_qty) OVER {NEXT} AS future_min_available_qty_raw,
  {big(f'sum(CASE WHEN ending_available_qty <= 0 THEN 1 ELSE 0 END) OVER {NEXT}')} AS future_stockout_days_raw, max(CASE WHEN ending_available_qty <= snapshot_reorder_point THEN 1 ELSE 0 END) OVER {NEXT} AS future_reorder_breach_raw FROM v_m3""",
    "v_m5_engineered": f"""SELECT *, {dow('demand_date')} AS day_of_week, {part('month', 'demand_date')} AS month_of_year, {bit('isodow(demand_date) > 5')} AS is_weekend, CASE WHEN snapshot_reorder_point > 0 THEN {r(div('prior_day_available_qty', 'snapshot_reorder_point'), 4)} END AS available_to_reorder_ratio,
  CASE WHEN prior_day_on_hand_qty > 0 THEN {pct('prior_day_reserved_qty', 'prior_day_on_hand_qty')} END AS prior_reserved_inventory_pct, {supply('prior_day_available_qty', 'historical_7d_avg_units')} AS historical_days_of_supply_7d,
  {supply('prior_day_available_qty', 'historical_28d_avg_units')} AS historical_days_of_supply_28d, CASE WHEN historical_28d_avg_units > 0 THEN {r(div('historical_7d_avg_units', 'historical_28d_avg_units'), 4)} END AS demand_acceleration_ratio,
  CASE WHEN historical_28d_avg_units > 0 THEN {r(div('historical_28d_demand_stddev', 'historical_28d_avg_units'), 4)} END AS demand_coefficient_of_variation_28d, {bit('prior_day_available_qty <= 0')} AS prior_day_stockout_flag,
  {bit('prior_day_available_qty <= snapshot_reorder_point')} AS prior_day_reorder_flag, greatest(snapshot_reorder_point - prior_day_available_qty, 0) AS prior_day_reorder_gap_units,
  CASE WHEN future_observation_days = 7 THEN {bit('future_stockout_days_raw > 0')} END AS target_stockout_next_7d, CASE WHEN future_observation_days = 7 THEN future_stockout_days_raw END AS target_stockout_days_next_7d,
  CASE WHEN future_observation_days = 7 THEN future_reorder_breach_raw END AS target_reorder_breach_next_7d, CASE WHEN future_observation_days = 7 THEN future_min_available_qty_raw END AS target_min_available_next_7d,
  {bit('historical_observation_days_28d = 28 AND prior_day_available_qty IS NOT NULL AND future_observation_days = 7')} AS ml_feature_eligible FROM v_m5_history""",
    "v_m5": """SELECT *, CASE WHEN prior_day_available_qty IS NULL THEN 'UNKNOWN' WHEN historical_observation_days_7d < 7 THEN 'WARMUP' WHEN prior_day_available_qty <= 0 THEN 'STOCKOUT' WHEN prior_day_available_qty <= snapshot_reorder_point THEN 'CRITICAL'
  WHEN historical_days_of_supply_7d <= 3 THEN 'HIGH' WHEN historical_days_of_supply_7d <= 7 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band FROM v_m5_engineered""",
}
__all__ = ["KINDS", "VIEWS", "big", "bit", "secs"]
