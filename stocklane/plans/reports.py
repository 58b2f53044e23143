"""Executive, warehouse, product, inventory, lifecycle and carrier reports over the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stocklane.functions.columns import count_where, flag, mean_seconds, money, percent, ratio, rounded, sum_where, zero
from stocklane.operators.ranges import dense_ranks, quantiles
from stocklane.operators.series import first_times, share
from stocklane.operators.storage import materialize
from stocklane.plans.checks import beside
from stocklane.plans.models import order_lines
from stocklane.plans.oracle.binding import div, mean as text_mean, mean_span, n, pct, r, secs, total
from stocklane.plans.oracle.views import bit
from stocklane.sources.binding import Tables

LIVE, GONE = "order_status <> 'cancelled'", "order_status = 'cancelled'"
DONE, FAILED, LATE = "shipment_status = 'delivered'", "shipment_status = 'exception'", "shipment_status = 'delivered' AND delivered_at > expected_delivery_at"
ALL = "*"


def average(c: str, condition: str | None = None):
    """Mean of whole numbers or decimals from an exact sum."""
    top, below = (F.sum(c), F.count(c)) if condition is None else (sum_where(c, condition), F.count_if(F.expr(f"({condition}) AND {c} IS NOT NULL")))
    return rounded(ratio(top, below))


def a1_executive_kpis(t: Tables) -> DataFrame:
    orders = t.orders.agg(
        F.count(ALL).alias("total_orders"), count_where(GONE).alias("cancelled_orders"), percent(count_where(GONE), F.count(ALL)).alias("cancellation_rate_pct"),
        rounded(sum_where("total_amount", LIVE)).alias("gross_merchandise_value"), average("total_amount", LIVE).alias("average_order_value"),
    )
    baskets = t.order_items.join(t.orders.where(LIVE).select("order_id"), "order_id").groupBy("order_id").agg(F.sum("quantity").alias("units"))
    basket = baskets.agg(zero(F.sum("units")).alias("units_sold"), average("units").alias("average_basket_size"))
    shipped = t.shipments.agg(
        F.count(ALL).alias("total_shipments"), count_where(DONE).alias("completed_orders"), percent(count_where(DONE), F.count(ALL)).alias("delivery_success_rate_pct"),
        percent(count_where(FAILED), F.count(ALL)).alias("exception_rate_pct"), percent(count_where(LATE), count_where(DONE)).alias("late_delivery_rate_pct"),
    )
    return beside(orders, basket, shipped)


def a2_warehouse_performance(t: Tables) -> DataFrame:
    key = "warehouse_id"
    orders = t.orders.groupBy(key).agg(
        F.count(ALL).alias("total_orders"), count_where(GONE).alias("cancelled_orders"), count_where(LIVE).alias("non_cancelled_orders"), percent(count_where(GONE), F.count(ALL)).alias("cancellation_rate_pct"),
        rounded(F.sum("total_amount")).alias("gross_order_value"), average("total_amount").alias("average_order_value"),
    )
    per = t.order_items.groupBy("order_id").agg(F.count(ALL).alias("lines"), F.sum("quantity").alias("units"))
    items = per.join(t.orders.select("order_id", key), "order_id").groupBy(key).agg(F.sum("lines").alias("order_item_lines"), F.sum("units").alias("units_ordered"), rounded(ratio(F.sum("units"), F.count(ALL))).alias("average_units_per_order"))
    sent = t.shipments.join(t.orders.select("order_id", "order_ts"), "order_id").groupBy(key).agg(
        F.count(ALL).alias("total_shipments"), count_where(DONE).alias("delivered_shipments"), count_where(FAILED).alias("exception_shipments"), count_where(LATE).alias("late_deliveries"),
        percent(count_where(DONE), F.count(ALL)).alias("delivery_success_rate_pct"), percent(count_where(FAILED), F.count(ALL)).alias("exception_rate_pct"), percent(count_where(LATE), count_where(DONE)).alias("late_delivery_rate_pct"),
        mean_seconds("order_ts", "shipped_at", 3600).alias("average_fulfillment_hours"), mean_seconds("shipped_at", "delivered_at", 3600, F.expr(DONE)).alias("average_transit_hours"),
        rounded(F.sum("shipping_cost")).alias("total_shipping_cost"), rounded(ratio(F.sum("shipping_cost"), F.count(ALL))).alias("average_shipping_cost"),
    )
    low = "on_hand_qty <= reorder_point"
    stock = t.inventory.groupBy(key).agg(F.count(ALL).alias("inventory_positions"), F.sum("on_hand_qty").alias("on_hand_units"), F.sum("reserved_qty").alias("reserved_units"), count_where(low).alias("low_stock_positions"), percent(count_where(low), F.count(ALL)).alias("low_stock_rate_pct"))
    out = t.warehouses.select(key, "warehouse_code", "warehouse_name", "city", "country_code", "capacity_units")
    measures = [c for part in (orders, items, sent, stock) for c in part.columns if c != key]
    for part in (orders, items, sent, stock):  # a row a warehouse each
        out = out.join(part, key, "left")
    return out.withColumns({c: zero(c) for c in measures}).orderBy(F.desc("total_orders"), key)


def distinct_orders(t: Tables, key: str) -> DataFrame:
    """Orders by a product attribute: one row an order and key first, so that counting needs no distinct."""
    lines = t.order_items.join(t.products.select("product_id", "category_id", "unit_cost"), "product_id").join(t.orders.select("order_id", "order_status"), "order_id")
    value, margin = "quantity * unit_price", "(unit_price - unit_cost) * quantity"
    per = lines.groupBy(key, "order_id", "order_status").agg(F.sum("quantity").alias("q"), F.sum(F.expr(value)).alias("v"), F.sum(F.expr(margin)).alias("m"))
    return per.groupBy(key).agg(
        F.count(ALL).alias("orders"), count_where(GONE).alias("cancelled"), F.sum("q").alias("units_ordered"), sum_where("q", LIVE).alias("fulfilled_units"), rounded(F.sum("v")).alias("gross_demand_value"),
        rounded(sum_where("v", LIVE)).alias("fulfilled_revenue"), rounded(sum_where("m", LIVE)).alias("gross_margin_value"),
    )


def a3_category_performance(t: Tables) -> DataFrame:
    sold = t.order_items.select("product_id").distinct().join(t.products.select("product_id", "category_id"), "product_id").groupBy("category_id").agg(F.count(ALL).alias("products_sold"))
    m = t.product_categories.join(distinct_orders(t, "category_id"), "category_id", "left").join(sold, "category_id", "left")
    cents = F.round(F.col("fulfilled_revenue") * 100).cast("long")
    total_cents = F.sum(cents).over(Window.partitionBy(F.lit(1)))
    return m.select(
        "category_id", "category_name", zero("products_sold").alias("products_sold"), zero("orders").alias("orders_containing_category"), zero("cancelled").alias("cancelled_orders"), "units_ordered", "fulfilled_units", "gross_demand_value",
        "fulfilled_revenue", "gross_margin_value", percent("cancelled", "orders").alias("cancellation_exposure_pct"), percent(cents, total_cents).alias("revenue_share_pct"),
    ).orderBy(F.desc_nulls_first("fulfilled_revenue"), "category_id")


def a3_top_products(t: Tables) -> DataFrame:
    # A product is once in an order and an order has one shipment, but neither is taken for granted.
    per = t.order_items.select("product_id", "order_id").distinct().join(t.shipments.select("order_id", "shipment_id", "shipment_status", "delivered_at", "expected_delivery_at"), "order_id")
    sent = per.groupBy("product_id", "shipment_id").agg(F.max(flag(DONE)).alias("d"), F.max(flag(FAILED)).alias("x"), F.max(flag(LATE)).alias("l")).groupBy("product_id").agg(
        F.count(ALL).alias("shipments"), F.sum("d").alias("delivered_shipments"), F.sum("x").alias("exception_shipments"), F.sum("l").alias("late_deliveries")
    )
    low = "on_hand_qty <= reorder_point"
    stock = t.inventory.groupBy("product_id").agg(
        F.count(ALL).alias("inventory_positions"), F.count_distinct("warehouse_id").alias("stocked_warehouses"), F.sum("on_hand_qty").alias("total_on_hand_qty"), F.sum("reserved_qty").alias("total_reserved_qty"),
        count_where(low).alias("low_stock_positions"), percent(count_where(low), F.count(ALL)).alias("low_stock_position_pct"),
    )
    sold = distinct_orders(t, "product_id").withColumnsRenamed({"orders": "order_count", "cancelled": "cancelled_order_count"})
    p = t.products.select("product_id", "sku", "product_name", "category_id", money("unit_price").alias("unit_price"), money("unit_cost").alias("unit_cost")).join(F.broadcast(t.product_categories), "category_id").drop("category_id")
    a = p.join(sold, "product_id", "left").join(sent, "product_id", "left").join(stock, "product_id", "left")
    a = a.withColumns({
        "cancellation_exposure_pct": percent(zero("cancelled_order_count"), "order_count"), "gross_margin_pct": percent(zero("gross_margin_value"), "fulfilled_revenue"),
        "shipment_exception_rate_pct": percent(zero("exception_shipments"), "shipments"), "late_delivery_rate_pct": percent(zero("late_deliveries"), "delivered_shipments"),
    })
    a = a.withColumns({c: zero(c) for part in (sold, sent, stock) for c in part.columns if c != "product_id"})
    # The first products by revenue, ranked among the distinct values of the whole catalogue.
    a = materialize(a, "top_products")
    order = [F.desc("fulfilled_revenue"), F.asc("product_id")]
    top = a.orderBy(*order).limit(20)
    for name, column in (("revenue_rank", "fulfilled_revenue"), ("unit_demand_rank", "fulfilled_units")):
        top = dense_ranks(top, [F.desc(column)], [column], name, among=a).withColumn(name, F.col(name).cast("int"))
    return top.orderBy(*order)


def demand_by_position(t: Tables) -> DataFrame:
    lines = order_lines(t).join(t.dealt(t.orders.where(LIVE).select("order_id", "warehouse_id")), "order_id")
    return lines.groupBy("warehouse_id", "product_id").agg(F.sum("first").alias("fulfilled_orders"), F.sum("quantity").alias("fulfilled_units"))


UNITS = {"reservation": "reservation_units", "release": "released_units", "shipment": "shipped_units", "receipt": "received_units"}


def movements_by_position(t: Tables) -> DataFrame:
    return t.inventory_movements.groupBy("warehouse_id", "product_id").agg(
        F.count(ALL).alias("total_movements"), *[count_where(f"movement_type = '{k}'").alias(f"{k}_events") for k in UNITS], *[zero(sum_where("abs(quantity_change)", f"movement_type = '{k}'")).alias(v) for k, v in UNITS.items()]
    )


def positions(t: Tables) -> DataFrame:
    demand, moved = demand_by_position(t), movements_by_position(t)
    p = t.inventory.drop("updated_at").join(demand, ["warehouse_id", "product_id"], "left").join(moved, ["warehouse_id", "product_id"], "left")
    p = p.withColumns({c: zero(c) for part in (demand, moved) for c in part.columns if c not in ("warehouse_id", "product_id")})
    p = p.withColumn("available_qty", F.expr("greatest(on_hand_qty - reserved_qty, 0)"))
    return p.withColumns({
        "reserved_pct": percent("reserved_qty", "on_hand_qty"), "avg_daily_demand": rounded(F.col("fulfilled_units") / F.lit(365.0)),
        "estimated_days_of_supply": rounded(F.col("available_qty").cast("double") * 365.0 / F.nullif(F.col("fulfilled_units").cast("double"), F.lit(0.0))),
    })


def a4_warehouse_health(t: Tables) -> DataFrame:
    p = positions(t).join(F.broadcast(t.warehouses.select("warehouse_id", "warehouse_code", "warehouse_name")), "warehouse_id")
    sums = {"on_hand_qty": "snapshot_on_hand_units", "reserved_qty": "reserved_units", "available_qty": "available_units", "fulfilled_units": "annual_fulfilled_units", "total_movements": "inventory_movements"} | {u: u for u in UNITS.values()}
    low, short = "on_hand_qty <= reorder_point", "available_qty <= reorder_point"
    return p.groupBy("warehouse_id", "warehouse_code", "warehouse_name").agg(
        F.count(ALL).alias("inventory_positions"), *[F.sum(c).alias(v) for c, v in sums.items()], count_where(low).alias("low_stock_positions"), percent(count_where(low), F.count(ALL)).alias("low_stock_rate_pct"),
        count_where(short).alias("available_below_reorder_positions"), percent(count_where(short), F.count(ALL)).alias("available_below_reorder_pct"),
    ).orderBy(F.desc("available_below_reorder_pct"), "warehouse_id")


#: Risk rules in order, as (condition, level, score).
RISK = (
    ("available_qty <= 0", "CRITICAL", 100), ("on_hand_qty <= reorder_point", "CRITICAL", 90), ("available_qty <= reorder_point", "HIGH", 80),
    ("estimated_days_of_supply < 14", "HIGH", 70), ("estimated_days_of_supply < 30", "MEDIUM", 50), ("true", "HEALTHY", 10),
)


def a4_stockout_risk(t: Tables) -> DataFrame:
    named = t.products.select("product_id", "sku", "product_name", "category_id").join(F.broadcast(t.product_categories), "category_id").drop("category_id")
    p = positions(t).join(named, "product_id").join(F.broadcast(t.warehouses.select("warehouse_id", "warehouse_code", "warehouse_name")), "warehouse_id")
    cases = lambda k: "CASE " + " ".join(f"WHEN {rule[0]} THEN {rule[k]!r}" for rule in RISK) + " END"
    p = p.withColumns({"risk_level": F.expr(cases(1)), "risk_score": F.expr(cases(2))})
    return p.orderBy(F.desc("risk_score"), F.asc_nulls_last("estimated_days_of_supply"), F.desc("fulfilled_units"), "warehouse_id", "product_id").limit(30)


PIVOT = {k: f"{k}_ts" for k in ("order_created", "payment_confirmed", "inventory_reserved", "processing_started", "order_packed", "shipment_created", "order_shipped", "order_delivered", "delivery_exception", "order_cancelled")}


def a5_lifecycle_summary(t: Tables) -> DataFrame:
    kept = ["order_id", "order_external_id", "warehouse_id", "order_status", "shipping_method", "payment_method", "order_ts"]
    pivot = t.order_events.groupBy("order_id").agg(*first_times(t.order_events, ["order_id"], PIVOT), *[F.count_if(F.col("event_type") == k).alias(f"{k}_events") for k in PIVOT])
    return t.orders.select(kept).join(pivot, "order_id", "left").withColumns({f"{k}_events": zero(f"{k}_events") for k in PIVOT})


FUNNEL = {"created": "order_created_ts", "payment_confirmed": "payment_confirmed_ts", "inventory_reserved": "inventory_reserved_ts", "processing_started": "processing_started_ts", "packed": "order_packed_ts", "shipment_created": "shipment_created_ts", "shipped": "order_shipped_ts", "delivered": "order_delivered_ts", "delivery_exceptions": "delivery_exception_ts", "cancelled": "order_cancelled_ts"}
CONVERSIONS = {"payment_conversion_pct": "payment_confirmed", "reservation_conversion_pct": "inventory_reserved", "shipment_conversion_pct": "shipment_created", "delivery_conversion_pct": "delivered", "cancellation_rate_pct": "cancelled"}


def a5_funnel(t: Tables) -> DataFrame:
    one = a5_lifecycle_summary(t).agg(F.count(ALL).alias("total_orders"), *[F.count(c).alias(v) for v, c in FUNNEL.items()])
    return one.withColumns({v: percent(c, "total_orders") for v, c in CONVERSIONS.items()})


#: Stage pairs with the unit of their average.
TIMINGS = {
    "avg_created_to_payment_minutes": ("order_created_ts", "payment_confirmed_ts", 60), "avg_payment_to_reservation_minutes": ("payment_confirmed_ts", "inventory_reserved_ts", 60),
    "avg_reservation_to_processing_minutes": ("inventory_reserved_ts", "processing_started_ts", 60), "avg_processing_to_packed_hours": ("processing_started_ts", "order_packed_ts", 3600),
    "avg_packed_to_shipment_creation_minutes": ("order_packed_ts", "shipment_created_ts", 60), "avg_shipment_creation_to_shipped_minutes": ("shipment_created_ts", "order_shipped_ts", 60),
    "avg_shipping_to_delivery_hours": ("order_shipped_ts", "order_delivered_ts", 3600), "avg_end_to_end_fulfillment_hours": ("order_created_ts", "order_delivered_ts", 3600),
}
BY_WAREHOUSE = {
    "avg_payment_minutes": ("order_created_ts", "payment_confirmed_ts", 60), "avg_reservation_minutes": ("payment_confirmed_ts", "inventory_reserved_ts", 60), "avg_packing_hours": ("processing_started_ts", "order_packed_ts", 3600),
    "avg_transit_hours": ("order_shipped_ts", "order_delivered_ts", 3600), "avg_end_to_end_hours": ("order_created_ts", "order_delivered_ts", 3600),
}


def a5_stage_timing(t: Tables) -> DataFrame:
    return a5_lifecycle_summary(t).agg(*[mean_seconds(*x).alias(v) for v, x in TIMINGS.items()])


def a5_warehouse_lifecycle(t: Tables) -> DataFrame:
    keys = ["warehouse_id", "warehouse_code", "warehouse_name", "city", "country_code"]
    counted = a5_lifecycle_summary(t).join(F.broadcast(t.warehouses.select(keys)), "warehouse_id").groupBy(keys).agg(
        F.count(ALL).alias("orders"), F.count("order_cancelled_ts").alias("cancelled_orders"), F.count("shipment_created_ts").alias("shipments"), F.count("order_delivered_ts").alias("delivered_orders"),
        F.count("delivery_exception_ts").alias("delivery_exceptions"), *[mean_seconds(*x).alias(v) for v, x in BY_WAREHOUSE.items()],
    )
    rates = {"cancellation_rate_pct": percent("cancelled_orders", "orders"), "exception_rate_pct": percent("delivery_exceptions", "shipments"), "delivery_success_rate_pct": percent("delivered_orders", "shipments")}
    return counted.withColumns(rates).orderBy(F.desc_nulls_last("avg_end_to_end_hours"), "warehouse_id")


def a5_cancellation_stage(t: Tables) -> DataFrame:
    stage = F.when(F.col("payment_confirmed_ts").isNull(), "pre_payment").when(F.col("inventory_reserved_ts").isNull(), "post_payment").otherwise("post_reservation")
    gone = a5_lifecycle_summary(t).where(GONE).groupBy(stage.alias("cancellation_stage")).agg(F.count(ALL).alias("cancelled_orders"), mean_seconds("order_created_ts", "order_cancelled_ts", 60).alias("avg_minutes_until_cancellation"))
    place = F.expr("array_position(array('pre_payment', 'post_payment', 'post_reservation'), cancellation_stage)")
    return gone.withColumn("cancelled_order_share_pct", share("cancelled_orders")).orderBy(place)


#: Contradictions of an order's lifecycle.
EVENT_FAULTS = {
    "invalid_order_created_counts": "order_created_events <> 1", "duplicate_payment_events": "payment_confirmed_events > 1", "duplicate_inventory_reservation_events": "inventory_reserved_events > 1",
    "duplicate_shipment_created_events": "shipment_created_events > 1", "duplicate_order_shipped_events": "order_shipped_events > 1", "duplicate_order_delivered_events": "order_delivered_events > 1",
    "duplicate_order_cancelled_events": "order_cancelled_events > 1", "cancelled_orders_missing_cancel_event": "order_status = 'cancelled' AND order_cancelled_ts IS NULL",
    "non_cancelled_orders_with_cancel_event": "order_status <> 'cancelled' AND order_cancelled_ts IS NOT NULL", "shipment_without_pack_event": "shipment_created_ts IS NOT NULL AND order_packed_ts IS NULL",
    "shipped_without_shipment_created": "order_shipped_ts IS NOT NULL AND shipment_created_ts IS NULL", "delivered_without_shipped_event": "order_delivered_ts IS NOT NULL AND order_shipped_ts IS NULL",
    "payment_before_creation": "payment_confirmed_ts < order_created_ts", "reservation_before_payment": "inventory_reserved_ts < payment_confirmed_ts", "processing_before_reservation": "processing_started_ts < inventory_reserved_ts",
    "packed_before_processing": "order_packed_ts < processing_started_ts", "shipment_created_before_packed": "shipment_created_ts < order_packed_ts", "shipped_before_shipment_created": "order_shipped_ts < shipment_created_ts",
    "delivered_before_shipped": "order_delivered_ts < order_shipped_ts",
}


def a5_event_audit(t: Tables) -> DataFrame:
    return a5_lifecycle_summary(t).agg(*[count_where(c).alias(v) for v, c in EVENT_FAULTS.items()])


def a6_shipping_base(t: Tables) -> DataFrame:
    w = t.warehouses.select("warehouse_id", "warehouse_code", "warehouse_name", "city", "country_code")
    s = t.shipments.withColumnRenamed("created_at", "shipment_created_at").withColumn("shipping_cost", money("shipping_cost"))
    s = s.join(t.orders.select("order_id", "shipping_method"), "order_id").join(F.broadcast(w), "warehouse_id")
    hours = lambda a, b: F.expr(f"timestampdiff(SECOND, {a}, {b})") / F.lit(3600.0)
    return s.withColumns({
        "delivered_flag": flag(DONE), "exception_flag": flag(FAILED), "late_flag": flag(LATE), "on_time_flag": flag("shipment_status = 'delivered' AND delivered_at <= expected_delivery_at"),
        "actual_transit_hours": hours("shipped_at", "delivered_at"), "expected_transit_hours": hours("shipped_at", "expected_delivery_at"), "delay_hours": F.when(F.expr(LATE), hours("expected_delivery_at", "delivered_at")),
    })


def cost_cents():
    return F.round(F.col("shipping_cost") * 100).cast("long")


def sent() -> list:
    return [F.count(ALL).alias("shipments"), F.sum("delivered_flag").alias("delivered"), F.sum("exception_flag").alias("exceptions"), F.sum("late_flag").alias("late_deliveries")]


def costs() -> list:
    """Hours from whole seconds, money from whole cents: sums are exact in any order."""
    cents = F.sum(cost_cents()).cast("double")
    return [mean_seconds("shipped_at", "delivered_at", 3600).alias("avg_transit_hours"), rounded(cents / 100.0 / F.nullif(F.count("shipping_cost").cast("double"), F.lit(0.0))).alias("avg_shipping_cost"), (cents / 100.0).alias("total_shipping_cost")]


def success() -> dict:
    return {"delivery_success_rate_pct": percent("delivered", "shipments")}


def failures() -> dict:
    return {"exception_rate_pct": percent("exceptions", "shipments"), "late_delivery_rate_pct": percent("late_deliveries", "delivered")}


def a6_carrier(t: Tables) -> DataFrame:
    base = a6_shipping_base(t)
    c = base.groupBy("carrier").agg(*sent(), *costs(), F.sum("on_time_flag").alias("on_time_deliveries"), mean_seconds("expected_delivery_at", "delivered_at", 3600, F.col("late_flag") == 1).alias("avg_late_delay_hours"))
    middle = quantiles(base, ["carrier"], "actual_transit_hours", {"median_transit_hours": 0.5, "p95_transit_hours": 0.95}).withColumnRenamed("carrier", "of")
    c = c.join(middle, c["carrier"].eqNullSafe(middle["of"]), "left").drop("of").withColumns({x: rounded(x) for x in ("median_transit_hours", "p95_transit_hours")})
    return c.withColumns(success() | failures() | {"shipment_share_pct": share("shipments"), "on_time_delivery_rate_pct": percent("on_time_deliveries", "delivered")}).orderBy(F.desc("shipments"), "carrier")


def a6_method(t: Tables) -> DataFrame:
    m = a6_shipping_base(t).groupBy("shipping_method").agg(*sent(), *costs(), mean_seconds("shipped_at", "expected_delivery_at", 3600).alias("avg_expected_transit_hours")).withColumnRenamed("avg_transit_hours", "avg_actual_transit_hours")
    place = F.expr("array_position(array('standard', 'express', 'same_day'), shipping_method)")
    return m.withColumns(success() | failures() | {"shipment_share_pct": share("shipments")}).orderBy(place)


def a6_carrier_method(t: Tables) -> DataFrame:
    c = a6_shipping_base(t).groupBy("carrier", "shipping_method").agg(*sent(), *costs())
    return c.withColumns(failures() | {"method_carrier_share_pct": share("shipments", ["shipping_method"])}).orderBy("shipping_method", F.desc("shipments"), "carrier")


def a6_warehouse_carrier(t: Tables) -> DataFrame:
    c = a6_shipping_base(t).groupBy("warehouse_id", "warehouse_code", "warehouse_name", "city", "country_code", "carrier").agg(*sent(), *costs())
    return c.withColumns(success() | failures()).orderBy("warehouse_id", F.desc("shipments"), "carrier")


def a6_scorecard(t: Tables) -> DataFrame:
    raw = [ratio(F.sum(F.expr("timestampdiff(SECOND, shipped_at, delivered_at)")), F.count("delivered_at")).alias("speed"), ratio(F.sum(cost_cents()), F.count("shipping_cost")).alias("cost")]
    c = a6_shipping_base(t).groupBy("carrier").agg(*sent(), *costs(), *raw).withColumn("fail", ratio("exceptions", "shipments"))
    rank = lambda x: F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_last(x)))
    c = c.withColumns(success() | failures() | {"reliability_rank": rank("fail"), "speed_rank": rank("speed"), "cost_rank": rank("cost")})
    return c.drop("fail", "speed", "cost", "delivered", "exceptions", "late_deliveries", "total_shipping_cost").orderBy("reliability_rank", "speed_rank", "cost_rank", "carrier")


#: Faults of a shipment row.
SHIPPING_FAULTS = {
    "null_shipment_ids": "shipment_id IS NULL", "null_order_references": "order_id IS NULL", "null_warehouse_references": "warehouse_id IS NULL", "missing_carriers": "carrier IS NULL",
    "missing_shipping_methods": "shipping_method IS NULL", "negative_shipping_costs": "shipping_cost < 0", "missing_shipped_timestamps": "shipped_at IS NULL", "missing_expected_delivery_timestamps": "expected_delivery_at IS NULL",
    "delivered_missing_delivery_timestamp": "shipment_status = 'delivered' AND delivered_at IS NULL", "shipped_before_shipment_created": "shipped_at < shipment_created_at",
    "expected_delivery_before_shipment": "expected_delivery_at < shipped_at", "delivery_before_shipment": "delivered_at < shipped_at",
}


def a6_audit(t: Tables) -> DataFrame:
    return a6_shipping_base(t).agg(*[count_where(c).alias(v) for v, c in SHIPPING_FAULTS.items()], (F.count(ALL) - F.count_distinct("shipment_id")).alias("duplicate_shipment_ids"))


def a6_reconciliation(t: Tables) -> DataFrame:
    return a6_shipping_base(t).agg(*sent(), *costs(), F.sum("on_time_flag").alias("on_time_deliveries")).withColumnRenamed("shipments", "total_shipments").withColumns({
        "delivery_success_rate_pct": percent("delivered", "total_shipments"), "exception_rate_pct": percent("exceptions", "total_shipments"), "late_delivery_rate_pct": percent("late_deliveries", "delivered")
    })


# DuckDB texts.
_LOW, _SHORT = "on_hand_qty <= reorder_point", "available_qty <= reorder_point"
_CENTS = "CAST(sum(CAST(round(shipping_cost * 100) AS BIGINT)) AS DOUBLE)"
_COSTS = f"{mean_span('shipped_at', 'delivered_at', 3600)} AS avg_transit_hours, {r(f'{_CENTS} / 100.0::DOUBLE / nullif(CAST(count(shipping_cost) AS DOUBLE), 0)')} AS avg_shipping_cost, {_CENTS} / 100.0::DOUBLE AS total_shipping_cost"
_SENT = f"count(*) AS shipments, {total('delivered_flag')} AS delivered, {total('exception_flag')} AS exceptions, {total('late_flag')} AS late_deliveries"
_SUCCESS = f"{pct('sum(delivered_flag)', 'count(*)')} AS delivery_success_rate_pct"
_FAILURES = f"{pct('sum(exception_flag)', 'count(*)')} AS exception_rate_pct, {pct('sum(late_flag)', 'sum(delivered_flag)')} AS late_delivery_rate_pct"
MORE = {
    "v_a3": f"SELECT i.product_id, category_id, i.order_id, order_status, quantity, quantity * i.unit_price AS v, (i.unit_price - unit_cost) * quantity AS m FROM c_items i JOIN c_orders USING (order_id) JOIN c_products p ON i.product_id = p.product_id",
    "v_a4": f"""SELECT *, greatest(on_hand_qty - reserved_qty, 0) AS available_qty, {pct('reserved_qty', 'on_hand_qty')} AS reserved_pct, {r('CAST(fulfilled_units AS DOUBLE) / 365.0::DOUBLE')} AS avg_daily_demand,
  {r('CAST(greatest(on_hand_qty - reserved_qty, 0) AS DOUBLE) * 365.0::DOUBLE / nullif(CAST(fulfilled_units AS DOUBLE), 0)')} AS estimated_days_of_supply FROM (
  SELECT warehouse_id, product_id, on_hand_qty, reserved_qty, reorder_point, coalesce(fulfilled_orders, 0) AS fulfilled_orders, coalesce(fulfilled_units, 0) AS fulfilled_units, coalesce(total_movements, 0) AS total_movements,
    {', '.join(f'coalesce({k}_events, 0) AS {k}_events, coalesce({v}, 0) AS {v}' for k, v in UNITS.items())} FROM c_inventory
  LEFT JOIN (SELECT warehouse_id, product_id, count(DISTINCT order_id) AS fulfilled_orders, {total('quantity')} AS fulfilled_units FROM c_items JOIN c_orders USING (order_id) WHERE {LIVE} GROUP BY ALL) USING (warehouse_id, product_id)
  LEFT JOIN (SELECT warehouse_id, product_id, count(*) AS total_movements, {', '.join(f"{n(f"movement_type = '{k}'")} AS {k}_events, coalesce({total('abs(quantity_change)', f"movement_type = '{k}'")}, 0) AS {v}" for k, v in UNITS.items())} FROM c_movements GROUP BY ALL) USING (warehouse_id, product_id))""",
    "v_a5": f"""SELECT order_id, order_external_id, o.warehouse_id, order_status, shipping_method, payment_method, order_ts, {', '.join(f"min(event_ts) FILTER (WHERE event_type = '{k}') AS {v}" for k, v in PIVOT.items())},
  {', '.join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}_events" for k in PIVOT)} FROM c_orders o LEFT JOIN c_events e USING (order_id) GROUP BY ALL""",
    "v_a6": f"""SELECT s.warehouse_id, order_id, shipment_id, shipment_external_id, carrier, shipment_status, shipped_at, expected_delivery_at, delivered_at, CAST(shipping_cost AS DOUBLE) AS shipping_cost, s.created_at AS shipment_created_at, shipping_method,
  warehouse_code, warehouse_name, city, country_code, {bit(DONE)} AS delivered_flag, {bit(FAILED)} AS exception_flag, {bit(LATE)} AS late_flag, {bit("shipment_status = 'delivered' AND delivered_at <= expected_delivery_at")} AS on_time_flag,
  {secs('shipped_at', 'delivered_at')} / 3600.0::DOUBLE AS actual_transit_hours, {secs('shipped_at', 'expected_delivery_at')} / 3600.0::DOUBLE AS expected_transit_hours, CASE WHEN {LATE} THEN {secs('expected_delivery_at', 'delivered_at')} / 3600.0::DOUBLE END AS delay_hours
  FROM c_shipments s JOIN c_orders o USING (order_id) JOIN c_warehouses w ON s.warehouse_id = w.warehouse_id""",
}
TEXTS = {
    "a1_executive_kpis": f"""SELECT * FROM (SELECT count(*) AS total_orders, {n(GONE)} AS cancelled_orders, {pct(n(GONE), 'count(*)')} AS cancellation_rate_pct, {r(f'sum(total_amount) FILTER (WHERE {LIVE})')} AS gross_merchandise_value, {text_mean('total_amount', LIVE)} AS average_order_value FROM c_orders),
  (SELECT coalesce({total('units')}, 0) AS units_sold, {text_mean('units')} AS average_basket_size FROM (SELECT sum(quantity) AS units FROM c_items JOIN c_orders USING (order_id) WHERE {LIVE} GROUP BY order_id)),
  (SELECT count(*) AS total_shipments, {n(DONE)} AS completed_orders, {pct(n(DONE), 'count(*)')} AS delivery_success_rate_pct, {pct(n(FAILED), 'count(*)')} AS exception_rate_pct, {pct(n(LATE), n(DONE))} AS late_delivery_rate_pct FROM c_shipments)""",
    "a3_category_performance": f"""SELECT *, {pct('CAST(round(fulfilled_revenue * 100) AS BIGINT)', 'sum(CAST(round(fulfilled_revenue * 100) AS BIGINT)) OVER ()')} AS revenue_share_pct FROM (
  SELECT c.category_id, category_name, count(DISTINCT product_id) AS products_sold, count(DISTINCT order_id) AS orders_containing_category, count(DISTINCT order_id) FILTER (WHERE {GONE}) AS cancelled_orders, {total('quantity')} AS units_ordered, {total('quantity', LIVE)} AS fulfilled_units,
    {r('sum(v)')} AS gross_demand_value, {r(f'sum(v) FILTER (WHERE {LIVE})')} AS fulfilled_revenue, {r(f'sum(m) FILTER (WHERE {LIVE})')} AS gross_margin_value, {pct(f'count(DISTINCT order_id) FILTER (WHERE {GONE})', 'count(DISTINCT order_id)')} AS cancellation_exposure_pct
  FROM c_categories c LEFT JOIN v_a3 ON c.category_id = v_a3.category_id GROUP BY ALL)""",
    "a3_top_products": f"""SELECT CAST(dense_rank() OVER (ORDER BY fulfilled_revenue DESC) AS INTEGER) AS revenue_rank, CAST(dense_rank() OVER (ORDER BY fulfilled_units DESC) AS INTEGER) AS unit_demand_rank, * FROM (
  SELECT p.product_id, sku, product_name, category_name, CAST(unit_price AS DOUBLE) AS unit_price, CAST(unit_cost AS DOUBLE) AS unit_cost, coalesce(oc, 0) AS order_count, coalesce(cc, 0) AS cancelled_order_count, {pct('coalesce(cc, 0)', 'oc')} AS cancellation_exposure_pct,
    coalesce(uo, 0) AS units_ordered, coalesce(fu, 0) AS fulfilled_units, coalesce(gd, 0) AS gross_demand_value, coalesce(fr, 0) AS fulfilled_revenue, coalesce(gm, 0) AS gross_margin_value, {pct('coalesce(gm, 0)', 'fr')} AS gross_margin_pct, coalesce(sh, 0) AS shipments,
    coalesce(ds, 0) AS delivered_shipments, coalesce(es, 0) AS exception_shipments, {pct('coalesce(es, 0)', 'sh')} AS shipment_exception_rate_pct, coalesce(ld, 0) AS late_deliveries, {pct('coalesce(ld, 0)', 'ds')} AS late_delivery_rate_pct, coalesce(ip, 0) AS inventory_positions,
    coalesce(sw, 0) AS stocked_warehouses, coalesce(oh, 0) AS total_on_hand_qty, coalesce(rs, 0) AS total_reserved_qty, coalesce(lp, 0) AS low_stock_positions, coalesce(lr, 0) AS low_stock_position_pct
  FROM c_products p JOIN c_categories USING (category_id)
  LEFT JOIN (SELECT product_id, count(DISTINCT order_id) AS oc, count(DISTINCT order_id) FILTER (WHERE {GONE}) AS cc, {total('quantity')} AS uo, {total('quantity', LIVE)} AS fu, {r('sum(v)')} AS gd, {r(f'sum(v) FILTER (WHERE {LIVE})')} AS fr, {r(f'sum(m) FILTER (WHERE {LIVE})')} AS gm FROM v_a3 GROUP BY 1) a ON a.product_id = p.product_id
  LEFT JOIN (SELECT product_id, count(DISTINCT shipment_id) AS sh, count(DISTINCT shipment_id) FILTER (WHERE {DONE}) AS ds, count(DISTINCT shipment_id) FILTER (WHERE {FAILED}) AS es, count(DISTINCT shipment_id) FILTER (WHERE {LATE}) AS ld FROM c_items JOIN c_shipments USING (order_id) GROUP BY 1) b ON b.product_id = p.product_id
  LEFT JOIN (SELECT product_id, count(*) AS ip, count(DISTINCT warehouse_id) AS sw, {total('on_hand_qty')} AS oh, {total('reserved_qty')} AS rs, {n(_LOW)} AS lp, {pct(n(_LOW), 'count(*)')} AS lr FROM c_inventory GROUP BY 1) c ON c.product_id = p.product_id)
  ORDER BY fulfilled_revenue DESC, product_id LIMIT 20""",
    "a4_warehouse_health": f"""SELECT warehouse_id, warehouse_code, warehouse_name, count(*) AS inventory_positions, {total('on_hand_qty')} AS snapshot_on_hand_units, {total('reserved_qty')} AS reserved_units, {total('available_qty')} AS available_units, {total('fulfilled_units')} AS annual_fulfilled_units,
  {total('total_movements')} AS inventory_movements, {', '.join(f'{total(v)} AS {v}' for v in UNITS.values())}, {n(_LOW)} AS low_stock_positions, {pct(n(_LOW), 'count(*)')} AS low_stock_rate_pct, {n(_SHORT)} AS available_below_reorder_positions, {pct(n(_SHORT), 'count(*)')} AS available_below_reorder_pct
  FROM v_a4 JOIN c_warehouses USING (warehouse_id) GROUP BY 1, 2, 3""",
    "a4_stockout_risk": """SELECT v_a4.*, warehouse_code, warehouse_name, sku, product_name, category_name,
  CASE WHEN available_qty <= 0 OR on_hand_qty <= reorder_point THEN 'CRITICAL' WHEN available_qty <= reorder_point OR estimated_days_of_supply < 14 THEN 'HIGH' WHEN estimated_days_of_supply < 30 THEN 'MEDIUM' ELSE 'HEALTHY' END AS risk_level,
  CASE WHEN available_qty <= 0 THEN 100 WHEN on_hand_qty <= reorder_point THEN 90 WHEN available_qty <= reorder_point THEN 80 WHEN estimated_days_of_supply < 14 THEN 70 WHEN estimated_days_of_supply < 30 THEN 50 ELSE 10 END AS risk_score
  FROM v_a4 JOIN c_warehouses USING (warehouse_id) JOIN c_products USING (product_id) JOIN c_categories USING (category_id) ORDER BY risk_score DESC, estimated_days_of_supply ASC NULLS LAST, fulfilled_units DESC, warehouse_id, product_id LIMIT 30""",
    "a5_lifecycle_summary": "SELECT * FROM v_a5",
    "a5_funnel": f"SELECT count(*) AS total_orders, {', '.join(f'count({c}) AS {v}' for v, c in FUNNEL.items())}, {', '.join(f'{pct(f"count({FUNNEL[c]})", "count(*)")} AS {v}' for v, c in CONVERSIONS.items())} FROM v_a5",
    "a5_stage_timing": f"SELECT {', '.join(f'{mean_span(*x)} AS {v}' for v, x in TIMINGS.items())} FROM v_a5",
    "a5_warehouse_lifecycle": f"""SELECT warehouse_id, warehouse_code, warehouse_name, city, country_code, count(*) AS orders, count(order_cancelled_ts) AS cancelled_orders, count(shipment_created_ts) AS shipments, count(order_delivered_ts) AS delivered_orders, count(delivery_exception_ts) AS delivery_exceptions,
  {pct('count(order_cancelled_ts)', 'count(*)')} AS cancellation_rate_pct, {pct('count(delivery_exception_ts)', 'count(shipment_created_ts)')} AS exception_rate_pct, {pct('count(order_delivered_ts)', 'count(shipment_created_ts)')} AS delivery_success_rate_pct, {', '.join(f'{mean_span(*x)} AS {v}' for v, x in BY_WAREHOUSE.items())}
  FROM v_a5 JOIN c_warehouses USING (warehouse_id) GROUP BY 1, 2, 3, 4, 5""",
    "a5_cancellation_stage": f"""SELECT cancellation_stage, cancelled_orders, avg_minutes_until_cancellation, {pct('cancelled_orders', 'sum(cancelled_orders) OVER ()')} AS cancelled_order_share_pct FROM (SELECT CASE WHEN payment_confirmed_ts IS NULL THEN 'pre_payment' WHEN inventory_reserved_ts IS NULL THEN 'post_payment' ELSE 'post_reservation' END AS cancellation_stage,
  count(*) AS cancelled_orders, {mean_span('order_created_ts', 'order_cancelled_ts', 60)} AS avg_minutes_until_cancellation FROM v_a5 WHERE {GONE} GROUP BY 1)""",
    "a5_event_audit": f"SELECT {', '.join(f'{n(c)} AS {v}' for v, c in EVENT_FAULTS.items())} FROM v_a5",
    "a6_shipping_base": "SELECT * FROM v_a6",
    "a6_carrier": f"""SELECT carrier, {_SENT}, {_COSTS}, {_SUCCESS}, {_FAILURES}, {total('on_time_flag')} AS on_time_deliveries, {pct('sum(on_time_flag)', 'sum(delivered_flag)')} AS on_time_delivery_rate_pct, {r('quantile_cont(actual_transit_hours, 0.5)')} AS median_transit_hours, {r('quantile_cont(actual_transit_hours, 0.95)')} AS p95_transit_hours,
  {mean_span('expected_delivery_at', 'delivered_at', 3600, 'late_flag = 1')} AS avg_late_delay_hours, {pct('count(*)', 'sum(count(*)) OVER ()')} AS shipment_share_pct FROM v_a6 GROUP BY carrier""",
    "a6_method": f"SELECT shipping_method, {_SENT}, {_COSTS.replace('avg_transit_hours', 'avg_actual_transit_hours')}, {_SUCCESS}, {_FAILURES}, {mean_span('shipped_at', 'expected_delivery_at', 3600)} AS avg_expected_transit_hours, {pct('count(*)', 'sum(count(*)) OVER ()')} AS shipment_share_pct FROM v_a6 GROUP BY 1",
    "a6_carrier_method": f"SELECT carrier, shipping_method, {_SENT}, {_COSTS}, {_FAILURES}, {pct('count(*)', 'sum(count(*)) OVER (PARTITION BY shipping_method)')} AS method_carrier_share_pct FROM v_a6 GROUP BY 1, 2",
    "a6_warehouse_carrier": f"SELECT warehouse_id, warehouse_code, warehouse_name, city, country_code, carrier, {_SENT}, {_COSTS}, {_SUCCESS}, {_FAILURES} FROM v_a6 GROUP BY 1, 2, 3, 4, 5, 6",
    "a6_scorecard": f"""SELECT * EXCLUDE (fail, speed, cost, total_shipping_cost), CAST(dense_rank() OVER (ORDER BY fail NULLS LAST) AS INTEGER) AS reliability_rank, CAST(dense_rank() OVER (ORDER BY speed NULLS LAST) AS INTEGER) AS speed_rank, CAST(dense_rank() OVER (ORDER BY cost NULLS LAST) AS INTEGER) AS cost_rank FROM (
  SELECT carrier, count(*) AS shipments, {_COSTS}, {_SUCCESS}, {_FAILURES}, {div('sum(exception_flag)', 'count(*)')} AS fail, {div(f"sum({secs('shipped_at', 'delivered_at')})", 'count(delivered_at)')} AS speed, {div('sum(CAST(round(shipping_cost * 100) AS BIGINT))', 'count(shipping_cost)')} AS cost FROM v_a6 GROUP BY 1)""",
    "a6_audit": f"SELECT {', '.join(f'{n(c)} AS {v}' for v, c in SHIPPING_FAULTS.items())}, count(*) - count(DISTINCT shipment_id) AS duplicate_shipment_ids FROM v_a6",
    "a6_reconciliation": f"SELECT {_SENT.replace('AS shipments', 'AS total_shipments')}, {_COSTS}, {_SUCCESS}, {_FAILURES}, {total('on_time_flag')} AS on_time_deliveries FROM v_a6",
}
_PARTS2 = {
    "o": f"SELECT warehouse_id, count(*) AS total_orders, {n(GONE)} AS cancelled_orders, {n(LIVE)} AS non_cancelled_orders, {pct(n(GONE), 'count(*)')} AS cancellation_rate_pct, {r('sum(total_amount)')} AS gross_order_value, {text_mean('total_amount')} AS average_order_value FROM c_orders GROUP BY 1",
    "i": f"SELECT warehouse_id, count(*) AS order_item_lines, {total('quantity')} AS units_ordered, {r(div('sum(quantity)', 'count(DISTINCT order_id)'))} AS average_units_per_order FROM c_items JOIN c_orders USING (order_id) GROUP BY 1",
    "s": f"""SELECT s.warehouse_id, count(*) AS total_shipments, {n(DONE)} AS delivered_shipments, {n(FAILED)} AS exception_shipments, {n(LATE)} AS late_deliveries, {pct(n(DONE), 'count(*)')} AS delivery_success_rate_pct, {pct(n(FAILED), 'count(*)')} AS exception_rate_pct, {pct(n(LATE), n(DONE))} AS late_delivery_rate_pct,
  {mean_span('order_ts', 'shipped_at', 3600)} AS average_fulfillment_hours, {mean_span('shipped_at', 'delivered_at', 3600, DONE)} AS average_transit_hours, {r('sum(coalesce(shipping_cost, 0))')} AS total_shipping_cost, {text_mean('coalesce(shipping_cost, 0)')} AS average_shipping_cost FROM c_shipments s JOIN c_orders USING (order_id) GROUP BY 1""",
    "k": f"SELECT warehouse_id, count(*) AS inventory_positions, {total('on_hand_qty')} AS on_hand_units, {total('reserved_qty')} AS reserved_units, {n(_LOW)} AS low_stock_positions, {pct(n(_LOW), 'count(*)')} AS low_stock_rate_pct FROM c_inventory GROUP BY 1",
}
_A2 = "total_orders cancelled_orders non_cancelled_orders cancellation_rate_pct gross_order_value average_order_value order_item_lines units_ordered average_units_per_order total_shipments delivered_shipments exception_shipments late_deliveries delivery_success_rate_pct exception_rate_pct late_delivery_rate_pct average_fulfillment_hours average_transit_hours total_shipping_cost average_shipping_cost inventory_positions on_hand_units reserved_units low_stock_positions low_stock_rate_pct".split()
TEXTS["a2_warehouse_performance"] = f"SELECT w.warehouse_id, warehouse_code, warehouse_name, city, country_code, capacity_units, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _A2)} FROM c_warehouses w " + " ".join(f"LEFT JOIN ({q}) {k} ON {k}.warehouse_id = w.warehouse_id" for k, q in _PARTS2.items())


def registered():
    for name, text in TEXTS.items():
        yield name, globals()[name], text
