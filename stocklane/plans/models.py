"""The analytical models: order facts, daily demand, inventory state, delivery features, stock-risk features.

Each function takes the canonical tables and returns a lazy DataFrame; inner steps are functions of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stocklane.functions.columns import flag, hours, iso_day, minutes, money, percent, ratio, rounded, sum_where, weekend, zero
from stocklane.operators import blocks
from stocklane.operators.series import ahead, before, date_spine, dense, first_times, lags, so_far
from stocklane.sources.binding import Tables

POSITION = ["warehouse_id", "product_id"]
DAY = ["demand_date", *POSITION]
STAGES = {
    "order_created": "order_created_event_ts", "payment_confirmed": "payment_confirmed_ts", "inventory_reserved": "inventory_reserved_ts", "processing_started": "processing_started_ts",
    "order_packed": "order_packed_ts", "shipment_created": "shipment_created_event_ts", "order_shipped": "order_shipped_event_ts", "order_delivered": "order_delivered_event_ts",
    "delivery_exception": "delivery_exception_ts", "order_cancelled": "order_cancelled_ts",
}


def order_lines(t: Tables) -> DataFrame:
    """Lines dealt by order. ``first`` is 1 on one line of an order and product, 0 on others, so sums count distinct pairs without a hash table of them.

    Items are unique by order and product, so counting rows would do; this keeps the meaning for any input.
    """
    same = Window.partitionBy("order_id", "product_id").orderBy("quantity")
    return t.dealt(t.order_items.select("order_id", "product_id", "quantity", "unit_price")).withColumn("first", flag(F.row_number().over(same) == 1))


def m1_item_metrics(t: Tables) -> DataFrame:
    return order_lines(t).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("order_item_lines"), F.sum("quantity").alias("units_ordered"), F.sum(F.when(F.col("product_id").isNotNull(), F.col("first")).otherwise(0)).alias("distinct_products"),
        rounded(F.sum(F.expr("quantity * unit_price"))).alias("item_gross_value"), rounded(ratio(F.sum("unit_price"), F.count("unit_price"))).alias("average_item_price"),
    )


def m1_shipment_metrics(t: Tables) -> DataFrame:
    least = ["shipment_id", "shipment_external_id", "carrier", "shipment_status", "shipped_at", "expected_delivery_at", "delivered_at"]
    return t.shipments.groupBy("order_id").agg(F.count(F.lit(1)).alias("shipment_count"), *[F.min(c).alias(c) for c in least], rounded(F.sum("shipping_cost")).alias("shipping_cost"))


def m1_event_metrics(t: Tables) -> DataFrame:
    return t.order_events.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("lifecycle_event_count"), F.min("event_ts").alias("first_event_ts"), F.max("event_ts").alias("last_event_ts"), *first_times(t.order_events, ["order_id"], STAGES)
    )


def calendar(ts: str, prefix: str) -> dict:
    return {
        f"{prefix}_date": F.to_date(ts), f"{prefix}_week": F.to_date(F.date_trunc("week", ts)), f"{prefix}_month": F.to_date(F.date_trunc("month", ts)), f"{prefix}_year": F.year(ts),
        f"{prefix}_month_number": F.month(ts),
    }


def m1_order_facts(t: Tables) -> DataFrame:
    customers = t.customers.select("customer_id", "customer_external_id", F.col("country_code").alias("customer_country_code"), F.col("region").alias("customer_region"))
    warehouses = t.warehouses.select("warehouse_id", "warehouse_code", "warehouse_name", F.col("city").alias("warehouse_city"), F.col("country_code").alias("warehouse_country_code"), F.col("capacity_units").alias("warehouse_capacity_units"))
    f = t.orders.withColumnRenamed("created_at", "order_record_created_at").join(customers, "customer_id", "left").join(F.broadcast(warehouses), "warehouse_id", "left")
    f = f.join(m1_item_metrics(t), "order_id", "left").join(m1_shipment_metrics(t), "order_id", "left").join(m1_event_metrics(t), "order_id", "left")
    f = f.withColumns(calendar("order_ts", "order") | {"order_day_of_week": iso_day("order_ts"), "order_hour": F.hour("order_ts"), "is_weekend": weekend("order_ts")})
    counts = ["order_item_lines", "units_ordered", "distinct_products", "item_gross_value", "average_item_price", "shipment_count", "shipping_cost", "lifecycle_event_count"]
    f = f.withColumns({c: zero(c) for c in counts} | {"total_amount": money("total_amount")})
    f = f.withColumns({
        "is_cancelled": flag("order_status = 'cancelled'"), "has_shipment": flag("shipment_id IS NOT NULL"), "is_delivered": flag("shipment_status = 'delivered'"),
        "is_delivery_exception": flag("shipment_status = 'exception'"), "is_late_delivery": flag("shipment_status = 'delivered' AND delivered_at > expected_delivery_at"),
        "is_on_time_delivery": flag("shipment_status = 'delivered' AND delivered_at <= expected_delivery_at"),
        "payment_confirmation_minutes": minutes("order_created_event_ts", "payment_confirmed_ts"), "inventory_reservation_minutes": minutes("payment_confirmed_ts", "inventory_reserved_ts"),
        "processing_start_minutes": minutes("inventory_reserved_ts", "processing_started_ts"), "packing_hours": hours("processing_started_ts", "order_packed_ts"),
        "order_to_ship_hours": hours("order_ts", "shipped_at"), "transit_hours": hours("shipped_at", "delivered_at"), "order_to_delivery_hours": hours("order_ts", "delivered_at"),
        "expected_transit_hours": hours("shipped_at", "expected_delivery_at"), "delivery_variance_hours": hours("expected_delivery_at", "delivered_at"),
    })
    stage = F.when(F.col("is_cancelled") == 0, None).when(F.col("payment_confirmed_ts").isNull(), "pre_payment").when(F.col("inventory_reserved_ts").isNull(), "post_payment").otherwise("post_reservation")
    return f.withColumn("cancellation_stage", stage)


def m2_date_spine(t: Tables) -> DataFrame:
    return date_spine(t.orders, "order_ts")


def m2_position_spine(t: Tables) -> DataFrame:
    w = t.warehouses.select("warehouse_id", "warehouse_code", "warehouse_name", F.col("city").alias("warehouse_city"), F.col("country_code").alias("warehouse_country_code"))
    p = t.products.select("product_id", "sku", "product_name", "category_id", money("unit_price").alias("catalog_unit_price"), money("unit_cost").alias("catalog_unit_cost"), money("weight_kg").alias("weight_kg"))
    return t.inventory.drop("updated_at").join(F.broadcast(w), "warehouse_id").join(p, "product_id").join(F.broadcast(t.product_categories), "category_id")


def m2_daily_transactions(t: Tables) -> DataFrame:
    return t.kept("daily_transactions", ("order_items", "orders"), lambda: daily_transactions(t))


def daily_transactions(t: Tables) -> DataFrame:
    """Orders have one date and warehouse, so the orders of a day and position are its distinct pairs of order and product."""
    orders = t.dealt(t.orders.select("order_id", "warehouse_id", "order_status", F.to_date("order_ts").alias("demand_date")))
    lines = order_lines(t).join(orders, "order_id").withColumns({"v": F.expr("quantity * unit_price"), "k": flag("unit_price IS NOT NULL")})
    live, gone = "order_status <> 'cancelled'", "order_status = 'cancelled'"
    return lines.groupBy(*DAY).agg(
        F.sum("first").alias("gross_order_count"), F.sum("quantity").alias("gross_units_requested"), rounded(F.sum("v")).alias("gross_requested_value"),
        zero(sum_where("first", live)).alias("order_count"), zero(sum_where("quantity", live)).alias("units_sold"), rounded(zero(sum_where("v", live))).alias("revenue"),
        zero(sum_where("first", gone)).alias("cancelled_order_count"), zero(sum_where("quantity", gone)).alias("cancelled_units"), rounded(ratio(sum_where("unit_price", live), sum_where("k", live))).alias("avg_selling_price"),
    )


MEASURES = ["gross_order_count", "gross_units_requested", "gross_requested_value", "order_count", "units_sold", "revenue", "cancelled_order_count", "cancelled_units"]


def m2_daily_base(t: Tables) -> DataFrame:
    b = dense(m2_date_spine(t), m2_position_spine(t), m2_daily_transactions(t), DAY)
    b = b.withColumnsRenamed({"on_hand_qty": "snapshot_on_hand_qty", "reserved_qty": "snapshot_reserved_qty", "reorder_point": "snapshot_reorder_point"})
    d = "demand_date"
    return b.withColumns({c: zero(c) for c in MEASURES} | {
        "demand_week": F.to_date(F.date_trunc("week", d)), "demand_month": F.to_date(F.date_trunc("month", d)), "demand_year": F.year(d), "demand_month_number": F.month(d), "day_of_week": iso_day(d),
        "day_of_year": F.dayofyear(d), "is_weekend": weekend(d), "catalog_unit_margin": rounded(F.expr("catalog_unit_price - catalog_unit_cost")),
        "catalog_margin_pct": F.when(F.expr("catalog_unit_price > 0"), rounded(F.expr("(catalog_unit_price - catalog_unit_cost) / catalog_unit_price * 100D"))),
    })


#: Windows over days run within blocks of a position's days, which hold copies of the days around them.
SPAN = [*POSITION, blocks.BLOCK]


def m2_daily_demand(t: Tables) -> DataFrame:
    return blocks.own(demand_in_blocks(t))


def demand_in_blocks(t: Tables) -> DataFrame:
    week, month = before(SPAN, "demand_date", 7), before(SPAN, "demand_date", 28)
    units, cents = F.col("units_sold"), F.round(F.col("revenue") * 100).cast("long")
    return blocks.with_halo(m2_daily_base(t), "demand_date").withColumns(lags(SPAN, "demand_date", "units_sold", (1, 7, 14, 28)) | {
        "rolling_7d_units": F.sum(units).over(week), "rolling_7d_avg_units": rounded(ratio(F.sum(units).over(week), F.count(units).over(week))),
        "rolling_28d_units": F.sum(units).over(month), "rolling_28d_avg_units": rounded(ratio(F.sum(units).over(month), F.count(units).over(month))),
        "rolling_7d_orders": F.sum("order_count").over(week), "rolling_7d_revenue": F.sum(cents).over(week) / 100.0,
    })


MOVED = ("receipt", "reservation", "release", "shipment")


def m3_daily_movements(t: Tables) -> DataFrame:
    return t.kept("daily_movements", ("inventory_movements", "orders"), lambda: daily_movements(t))


def daily_movements(t: Tables) -> DataFrame:
    moved = t.inventory_movements.withColumn("demand_date", F.to_date("event_ts"))
    ends = m2_date_spine(t).agg(F.min("demand_date").alias("lo"), F.max("demand_date").alias("hi"))
    inside = moved.crossJoin(F.broadcast(ends)).where("demand_date BETWEEN lo AND hi")
    each = [c for k in MOVED for c in (F.count_if(F.col("movement_type") == k).alias(f"{k}_event_count"), zero(sum_where("abs(quantity_change)", f"movement_type = '{k}'")).alias(f"{k}_units"))]
    return inside.groupBy(*DAY).agg(F.count(F.lit(1)).alias("movement_event_count"), *each)


NET = {
    "net_on_hand_change": "receipt_units - shipment_units", "net_reserved_change": "reservation_units - release_units - shipment_units",
    "net_available_change": "receipt_units - reservation_units + release_units",
}


def m3_daily_ledger(t: Tables) -> DataFrame:
    return blocks.own(ledger_in_blocks(t))


def ledger_in_blocks(t: Tables) -> DataFrame:
    moved = m3_daily_movements(t)
    joined = demand_in_blocks(t).join(blocks.with_halo(moved, "demand_date").drop(blocks.OWN), [*DAY, blocks.BLOCK], "left")
    joined = joined.withColumns({c: zero(c) for c in moved.columns if c not in DAY})
    return joined.withColumns({name: F.expr(net) for name, net in NET.items()})


def m3_inventory_state(t: Tables) -> DataFrame:
    return blocks.own(state_in_blocks(t))


def state_in_blocks(t: Tables) -> DataFrame:
    """Running sums inside a block, on top of what a position's moves before the block add up to."""
    run = so_far(SPAN, "demand_date")
    changes = m3_daily_movements(t).withColumns({name: F.expr(net) for name, net in NET.items()})
    s = blocks.with_starts(ledger_in_blocks(t), changes, POSITION, "demand_date", {"_hand": "net_on_hand_change", "_held": "net_reserved_change"}, m2_date_spine(t))
    s = s.withColumns({"ending_on_hand_qty": F.col("_hand") + F.sum("net_on_hand_change").over(run), "ending_reserved_qty": F.col("_held") + F.sum("net_reserved_change").over(run)}).drop("_hand", "_held")
    s = s.withColumn("ending_available_qty", F.expr("ending_on_hand_qty - ending_reserved_qty"))
    return s.withColumns({f"prior_day_{x}_qty": lags(SPAN, "demand_date", f"ending_{x}_qty", (1,), "{}")["1"] for x in ("on_hand", "reserved", "available")})


def supply(available: str, average: str):
    return F.when(F.col(available) <= 0, F.lit(0.0)).when(F.col(average) > 0, rounded(ratio(available, average)))


def m3_warehouse_product_daily(t: Tables) -> DataFrame:
    return blocks.own(daily_in_blocks(t))


def daily_in_blocks(t: Tables) -> DataFrame:
    a, point = "ending_available_qty", "snapshot_reorder_point"
    return state_in_blocks(t).withColumns({
        "is_stockout": flag(f"{a} <= 0"), "is_below_reorder_point": flag(f"{a} > 0 AND {a} <= {point}"), "requires_reorder": flag(f"{a} <= {point}"), "is_receipt_day": flag("receipt_units > 0"),
        "has_reservation_activity": flag("reservation_units > 0"), "has_shipment_activity": flag("shipment_units > 0"), "reorder_gap_units": F.expr(f"greatest({point} - {a}, 0)"),
        "reserved_inventory_pct": F.when(F.expr("ending_on_hand_qty > 0"), percent("ending_reserved_qty", "ending_on_hand_qty")),
        "days_of_supply_7d": supply(a, "rolling_7d_avg_units"), "days_of_supply_28d": supply(a, "rolling_28d_avg_units"),
        "demand_inventory_pressure_28d": F.when(F.expr(f"{a} > 0 AND rolling_28d_units IS NOT NULL"), rounded(ratio("rolling_28d_units", a), 4)),
        "stock_status": F.expr(f"CASE WHEN {a} <= 0 THEN 'STOCKOUT' WHEN {a} <= {point} THEN 'CRITICAL' WHEN 2 * {a} <= 3 * {point} THEN 'LOW' ELSE 'HEALTHY' END"),
    })


def item_metrics() -> list:
    return [
        F.count(F.lit(1)).alias("order_item_lines"), F.sum("quantity").alias("total_units"), F.sum(F.when(F.col("product_id").isNotNull(), F.col("first")).otherwise(0)).alias("distinct_products"),
        rounded(ratio(F.sum("unit_price"), F.count("unit_price"))).alias("avg_item_price"), rounded(F.max("unit_price")).alias("max_item_price"),
    ]


def weight():
    return rounded(F.sum(F.expr("quantity * weight_kg")), 3).alias("total_weight_kg")


def m4_order_item_metrics(t: Tables) -> DataFrame:
    return order_lines(t).groupBy("order_id").agg(*item_metrics())


def m4_order_weight(t: Tables) -> DataFrame:
    weighed = t.dealt(t.order_items.select("order_id", "product_id", "quantity")).join(t.products.select("product_id", "weight_kg"), "product_id")
    return weighed.groupBy("order_id").agg(weight())


def m4_order_lines(t: Tables) -> DataFrame:
    """Metrics and weight of an order in one shuffle of its lines; lines of unknown products weigh nothing. Products are one row each."""
    return order_lines(t).join(t.products.select("product_id", "weight_kg"), "product_id", "left").groupBy("order_id").agg(*item_metrics(), weight())


def m4_delivery_features(t: Tables) -> DataFrame:
    w = t.warehouses.select("warehouse_id", "warehouse_code", "warehouse_name", F.col("city").alias("warehouse_city"), F.col("country_code").alias("warehouse_country_code"))
    o = t.orders.select("order_id", "order_external_id", "destination_country", "destination_region", "shipping_method", "payment_method", money("total_amount").alias("order_value"), "order_ts", "promised_delivery_ts")
    f = t.dealt(t.shipments.drop("created_at").withColumn("shipping_cost", money("shipping_cost"))).join(t.dealt(o), "order_id").join(F.broadcast(w), "warehouse_id")
    f = f.join(m4_order_lines(t), "order_id", "left").withColumns({c: zero(c) for c in ("order_item_lines", "total_units", "distinct_products")})
    f = f.select("warehouse_id", "order_id", *[c for c in f.columns if c not in ("warehouse_id", "order_id")])
    per = lambda below: F.when(F.col(below) > 0, rounded(ratio("shipping_cost", below)))
    late = "shipment_status = 'delivered' AND delivered_at > expected_delivery_at"
    return f.withColumns({
        "order_date": F.to_date("order_ts"), "order_hour": F.hour("order_ts"), "order_day_of_week": iso_day("order_ts"), "order_month": F.month("order_ts"), "order_is_weekend": weekend("order_ts"),
        "ship_date": F.to_date("shipped_at"), "ship_hour": F.hour("shipped_at"), "ship_day_of_week": iso_day("shipped_at"), "ship_is_weekend": weekend("shipped_at"),
        "processing_hours": hours("order_ts", "shipped_at"), "promised_total_hours": hours("order_ts", "promised_delivery_ts"), "expected_transit_hours": hours("shipped_at", "expected_delivery_at"),
        "is_delivery_exception": flag("shipment_status = 'exception'"), "is_late_delivery": flag(late), "is_delivered": flag("shipment_status = 'delivered'"),
        "actual_transit_hours": hours("shipped_at", "delivered_at"), "delivery_delay_hours": hours("expected_delivery_at", "delivered_at"),
        "shipping_cost_pct_of_order": F.when(F.expr("order_value > 0"), percent("shipping_cost", "order_value")), "shipping_cost_per_unit": per("total_units"), "shipping_cost_per_kg": per("total_weight_kg"),
    })


def m5_history(t: Tables) -> DataFrame:
    kept = ["demand_date", "warehouse_id", "warehouse_code", "product_id", "sku", "category_name", "snapshot_reorder_point", "units_sold", "revenue", "ending_on_hand_qty", "ending_reserved_qty", "ending_available_qty"]
    d = daily_in_blocks(t).select(blocks.BLOCK, blocks.OWN, *kept, *[f"prior_day_{x}_qty" for x in ("on_hand", "reserved", "available")], *[f"lag_{k}_units" for k in (1, 7, 14, 28)], *[f"{k}_units" for k in MOVED])
    week, month, next7 = before(SPAN, "demand_date", 7), before(SPAN, "demand_date", 28), ahead(SPAN, "demand_date", 7)
    u = F.col("units_sold")
    n, s, s2 = F.count(u).over(month), F.sum(u).over(month), F.sum(u * u).over(month)
    # The sample deviation from exact whole sums.
    deviation = F.when(n > 1, F.sqrt((n * s2 - s * s).cast("double") / (n * (n - 1)).cast("double")))
    d = d.withColumns({
        "historical_observation_days_7d": F.count(u).over(week), "historical_7d_units": F.sum(u).over(week), "historical_7d_avg_units": ratio(F.sum(u).over(week), F.count(u).over(week)),
        "historical_observation_days_28d": n, "historical_28d_units": s, "historical_28d_avg_units": ratio(s, n), "historical_28d_demand_stddev": deviation,
    } | {f"historical_7d_{k}_units": F.sum(f"{k}_units").over(week) for k in MOVED} | {
        "future_observation_days": F.count(F.lit(1)).over(next7), "future_min_available_qty_raw": F.min("ending_available_qty").over(next7),
        "future_stockout_days_raw": F.sum(flag("ending_available_qty <= 0")).over(next7), "future_reorder_breach_raw": F.max(flag("ending_available_qty <= snapshot_reorder_point")).over(next7),
    })
    return blocks.own(d.drop(*[f"{k}_units" for k in MOVED]))


def m5_engineered(t: Tables) -> DataFrame:
    p, point, whole = "prior_day_available_qty", "snapshot_reorder_point", F.col("future_observation_days") == 7
    busy = F.col("historical_28d_avg_units") > 0
    return m5_history(t).withColumns({
        "day_of_week": iso_day("demand_date"), "month_of_year": F.month("demand_date"), "is_weekend": weekend("demand_date"), "available_to_reorder_ratio": F.when(F.col(point) > 0, rounded(ratio(p, point), 4)),
        "prior_reserved_inventory_pct": F.when(F.expr("prior_day_on_hand_qty > 0"), percent("prior_day_reserved_qty", "prior_day_on_hand_qty")),
        "historical_days_of_supply_7d": supply(p, "historical_7d_avg_units"), "historical_days_of_supply_28d": supply(p, "historical_28d_avg_units"),
        "demand_acceleration_ratio": F.when(busy, rounded(ratio("historical_7d_avg_units", "historical_28d_avg_units"), 4)),
        "demand_coefficient_of_variation_28d": F.when(busy, rounded(ratio("historical_28d_demand_stddev", "historical_28d_avg_units"), 4)),
        "prior_day_stockout_flag": flag(f"{p} <= 0"), "prior_day_reorder_flag": flag(f"{p} <= {point}"), "prior_day_reorder_gap_units": F.expr(f"greatest({point} - {p}, 0)"),
        "target_stockout_next_7d": F.when(whole, flag("future_stockout_days_raw > 0")), "target_stockout_days_next_7d": F.when(whole, F.col("future_stockout_days_raw")),
        "target_reorder_breach_next_7d": F.when(whole, F.col("future_reorder_breach_raw")), "target_min_available_next_7d": F.when(whole, F.col("future_min_available_qty_raw")),
        "ml_feature_eligible": flag(f"historical_observation_days_28d = 28 AND {p} IS NOT NULL AND future_observation_days = 7"),
    })


def m5_risk_features(t: Tables) -> DataFrame:
    p, dos = "prior_day_available_qty", "historical_days_of_supply_7d"
    band = f"CASE WHEN {p} IS NULL THEN 'UNKNOWN' WHEN historical_observation_days_7d < 7 THEN 'WARMUP' WHEN {p} <= 0 THEN 'STOCKOUT' WHEN {p} <= snapshot_reorder_point THEN 'CRITICAL' WHEN {dos} <= 3 THEN 'HIGH' WHEN {dos} <= 7 THEN 'MEDIUM' ELSE 'LOW' END"
    return m5_engineered(t).withColumn("risk_band", F.expr(band))
