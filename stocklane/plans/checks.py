"""Validations of the analytical models: grain, reconciliation, integrity and previews, one aggregate pass each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklane.functions.columns import count_where, mean, money, percent, rounded, sum_where
from stocklane.operators.series import share
from stocklane.plans import models
from stocklane.plans.oracle.binding import div, mean as text_mean, n, pct, r, total
from stocklane.sources.binding import Tables

#: Contradictions that a model must not hold, as (name, condition) of its rows.
CONTRADICTIONS = {
    "m1_v3_integrity": ("m1_order_facts", {
        "orders_without_items": "order_item_lines = 0", "orders_without_positive_units": "units_ordered <= 0", "negative_order_values": "total_amount < 0", "orders_with_multiple_shipments": "shipment_count > 1",
        "cancelled_orders_with_shipments": "is_cancelled = 1 AND has_shipment = 1", "active_orders_without_shipments": "is_cancelled = 0 AND has_shipment = 0",
        "delivered_orders_missing_timestamp": "is_delivered = 1 AND delivered_at IS NULL", "late_but_not_delivered": "is_late_delivery = 1 AND is_delivered = 0", "orders_without_events": "lifecycle_event_count = 0",
    }),
    "m2_v7_integrity": ("m2_daily_base", {
        "negative_units": "units_sold < 0", "negative_orders": "order_count < 0", "negative_revenue": "revenue < 0", "negative_cancelled_units": "cancelled_units < 0",
        "realized_exceeds_gross": "gross_units_requested < units_sold", "gross_demand_reconciliation_failures": "gross_units_requested <> units_sold + cancelled_units",
    }),
    "m3_v4_state_integrity": ("m3_warehouse_product_daily", {
        "negative_on_hand_rows": "ending_on_hand_qty < 0", "negative_reserved_rows": "ending_reserved_qty < 0", "negative_available_rows": "ending_available_qty < 0",
        "reserved_exceeds_on_hand_rows": "ending_reserved_qty > ending_on_hand_qty", "invalid_stockout_flags": "is_stockout = 1 AND ending_available_qty > 0",
        "invalid_reorder_flags": "requires_reorder = 0 AND ending_available_qty <= snapshot_reorder_point",
    }),
    "m4_v4_references": ("m4_delivery_features", {
        "missing_order_id": "order_id IS NULL", "missing_warehouse_id": "warehouse_id IS NULL", "missing_carrier": "carrier IS NULL", "missing_shipping_method": "shipping_method IS NULL",
        "invalid_total_units": "total_units <= 0", "invalid_item_lines": "order_item_lines <= 0",
    }),
    "m4_v5_timestamps": ("m4_delivery_features", {
        "shipped_before_order": "shipped_at < order_ts", "expected_before_shipment": "expected_delivery_at < shipped_at", "delivered_before_shipment": "delivered_at < shipped_at",
        "negative_processing_hours": "processing_hours < 0", "negative_expected_transit_hours": "expected_transit_hours < 0",
    }),
    "m4_v6_labels": ("m4_delivery_features", {
        "late_but_not_delivered": "is_late_delivery = 1 AND is_delivered = 0", "exception_and_delivered": "is_delivery_exception = 1 AND is_delivered = 1",
        "delivered_without_timestamp": "is_delivered = 1 AND delivered_at IS NULL", "invalid_late_label": "is_late_delivery = 1 AND delivered_at <= expected_delivery_at",
    }),
    "m5_v2_coverage": ("m5_risk_features", {
        "total_rows": "true", "rows_with_28d_history": "historical_observation_days_28d = 28", "rows_with_full_7d_target": "future_observation_days = 7", "ml_eligible_rows": "ml_feature_eligible = 1",
        "incomplete_target_rows": "future_observation_days < 7",
    }),
    "m5_v4_target_integrity": ("m5_risk_features", {
        "incomplete_horizon_with_stockout_target": "future_observation_days < 7 AND target_stockout_next_7d IS NOT NULL", "incomplete_horizon_with_reorder_target": "future_observation_days < 7 AND target_reorder_breach_next_7d IS NOT NULL",
        "invalid_stockout_labels": "target_stockout_next_7d NOT IN (0, 1)", "invalid_reorder_labels": "target_reorder_breach_next_7d NOT IN (0, 1)",
        "eligible_without_full_history": "ml_feature_eligible = 1 AND historical_observation_days_28d <> 28", "eligible_without_full_target": "ml_feature_eligible = 1 AND future_observation_days <> 7",
    }),
    "m5_v5_history_integrity": ("m5_risk_features", {
        "negative_prior_on_hand": "prior_day_on_hand_qty < 0", "negative_prior_reserved": "prior_day_reserved_qty < 0", "prior_reserved_exceeds_on_hand": "prior_day_reserved_qty > prior_day_on_hand_qty",
        "negative_historical_7d_demand": "historical_7d_units < 0", "negative_historical_28d_demand": "historical_28d_units < 0",
    }),
}
VIEW = {"m1_order_facts": "v_m1", "m2_daily_base": "v_m2_base", "m2_daily_demand": "v_m2", "m3_warehouse_product_daily": "v_m3", "m4_delivery_features": "v_m4", "m5_risk_features": "v_m5"}

#: Preview columns, order and length.
PREVIEWS = {
    "m1_v5_preview": ("m1_order_facts", "true", ["order_id"], 10, "order_id order_external_id customer_country_code warehouse_code order_date order_status shipping_method order_item_lines units_ordered total_amount carrier shipment_status is_cancelled is_delivered is_delivery_exception is_late_delivery order_to_ship_hours transit_hours order_to_delivery_hours cancellation_stage"),
    "m2_v9_preview": ("m2_daily_demand", "demand_date >= {lo} + 28", ["warehouse_id", "product_id", "demand_date"], 20, "demand_date warehouse_code sku category_name units_sold order_count revenue is_weekend lag_1_units lag_7_units lag_14_units lag_28_units rolling_7d_units rolling_7d_avg_units rolling_28d_units rolling_28d_avg_units"),
    "m3_v8_preview": ("m3_warehouse_product_daily", "demand_date >= {hi} - 7", ["warehouse_id", "product_id", "demand_date"], 30, "demand_date warehouse_code sku category_name units_sold rolling_7d_avg_units rolling_28d_avg_units receipt_units reservation_units release_units shipment_units ending_on_hand_qty ending_reserved_qty ending_available_qty prior_day_available_qty snapshot_reorder_point reorder_gap_units days_of_supply_7d days_of_supply_28d reserved_inventory_pct stock_status"),
    "m4_v9_preview": ("m4_delivery_features", "true", ["shipment_id"], 20, "shipment_id order_id warehouse_code destination_country shipping_method carrier order_value total_units distinct_products total_weight_kg order_day_of_week order_is_weekend processing_hours promised_total_hours expected_transit_hours shipping_cost is_delivery_exception is_late_delivery"),
    "m5_v8_preview": ("m5_risk_features", "ml_feature_eligible = 1", ["warehouse_id", "product_id", "demand_date"], 30, "demand_date warehouse_code sku category_name snapshot_reorder_point prior_day_on_hand_qty prior_day_reserved_qty prior_day_available_qty lag_1_units lag_7_units historical_7d_units historical_7d_avg_units historical_28d_units historical_28d_avg_units historical_days_of_supply_7d historical_days_of_supply_28d available_to_reorder_ratio demand_acceleration_ratio demand_coefficient_of_variation_28d historical_7d_receipt_units historical_7d_shipment_units risk_band target_stockout_next_7d target_reorder_breach_next_7d"),
}
ROUNDED = {"m5_v8_preview": ("historical_7d_avg_units", "historical_28d_avg_units")}
LIVE = "order_status <> 'cancelled'"


def contradictions(df: DataFrame, conditions: dict[str, str]) -> DataFrame:
    return df.agg(*[count_where(c).alias(name) for name, c in conditions.items()])


def preview(name: str, t: Tables) -> DataFrame:
    model, condition, order, limit, columns = PREVIEWS[name]
    df = getattr(models, model)(t)
    if "{" in condition:  # the bound is a one-row table of the calendar
        ends = models.m2_date_spine(t).agg(F.min("demand_date").alias("lo"), F.max("demand_date").alias("hi"))
        df = df.crossJoin(F.broadcast(ends)).where(condition.replace("{lo} + 28", "date_add(lo, 28)").replace("{hi} - 7", "date_sub(hi, 7)"))
    else:
        df = df.where(condition)
    return df.orderBy(*order).limit(limit).select(*[rounded(c).alias(c) if c in ROUNDED.get(name, ()) else c for c in columns.split()])


def preview_text(name: str) -> str:
    model, condition, order, limit, columns = PREVIEWS[name]
    condition = condition.format(lo="(SELECT min(demand_date) FROM v_m2_spine)", hi="(SELECT max(demand_date) FROM v_m2_spine)")
    shown = ", ".join(f"{r(c)} AS {c}" if c in ROUNDED.get(name, ()) else c for c in columns.split())
    return f"SELECT {shown} FROM {VIEW[model]} WHERE {condition} ORDER BY {', '.join(order)} LIMIT {limit}"


def position_grain(df: DataFrame, name: str) -> DataFrame:
    """Rows, days, positions and repeated keys from one count by key, the only exchange of the model's rows; both sums read its columns alike, so
    Spark reuses it."""
    per = df.groupBy("demand_date", "warehouse_id", "product_id").agg(F.count(F.lit(1)).alias("k"))
    days = per.groupBy("demand_date").agg(F.sum("k").alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("model_rows"), F.count("demand_date").alias("calendar_days"))
    places = per.groupBy("warehouse_id", "product_id").agg(F.sum("k").alias("k"), F.count(F.lit(1)).alias("keys"))
    return beside(days, places.agg(F.count(F.lit(1)).alias(name), (F.coalesce(F.sum("k"), F.lit(0)) - F.coalesce(F.sum("keys"), F.lit(0))).alias("duplicate_grain_rows")))


def position_grain_text(view: str, name: str) -> str:
    return f"SELECT count(*) AS model_rows, count(DISTINCT demand_date) AS calendar_days, count(DISTINCT (warehouse_id, product_id)) AS {name}, count(*) - count(DISTINCT (demand_date, warehouse_id, product_id)) AS duplicate_grain_rows FROM {view}"


def beside(*rows: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    out = rows[0]
    for row in rows[1:]:
        out = out.crossJoin(F.broadcast(row))
    return out


def difference(left: str, right: str, name: str, digits: int | None = None):
    gap = F.col(left) - F.col(right)
    return (rounded(gap, digits) if digits else gap).alias(name)


def m1_v1_grain(t):
    return models.m1_order_facts(t).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("order_id").alias("distinct_orders"), (F.count(F.lit(1)) - F.count_distinct("order_id")).alias("duplicate_order_rows"))


def m1_v2_totals(t):
    sums = {"is_cancelled": "cancelled_orders", "has_shipment": "shipments", "is_delivered": "delivered_orders", "is_delivery_exception": "delivery_exceptions", "order_item_lines": "order_item_lines", "units_ordered": "units_ordered"}
    value = F.sum(F.round(F.col("total_amount") * 100).cast("long")) / 100.0
    return models.m1_order_facts(t).agg(F.count(F.lit(1)).alias("total_orders"), *[F.sum(c).alias(v) for c, v in sums.items()], value.alias("total_order_value"))


def m1_v4_cancel_stage(t):
    counted = models.m1_order_facts(t).where("is_cancelled = 1").groupBy("cancellation_stage").agg(F.count(F.lit(1)).alias("orders"))
    place = F.expr("CASE cancellation_stage WHEN 'pre_payment' THEN 1 WHEN 'post_payment' THEN 2 WHEN 'post_reservation' THEN 3 ELSE 4 END")
    return counted.withColumn("cancellation_share_pct", share("orders")).orderBy(place)


def m2_v2_bounds(t):
    return models.m2_daily_base(t).agg(F.min("demand_date").alias("first_date"), F.max("demand_date").alias("last_date"), F.count_distinct("demand_date").alias("calendar_days"))


def m2_v3_gross_recon(t):
    both = beside(models.m2_daily_base(t).agg(F.sum("gross_units_requested").alias("model_gross_units")), t.order_items.agg(F.sum("quantity").alias("source_gross_units")))
    return both.select("*", difference("model_gross_units", "source_gross_units", "gross_unit_difference"))


def sold(t):
    lines = t.order_items.join(t.orders.select("order_id", "order_status"), "order_id").where(LIVE)
    return lines.agg(F.sum("quantity").alias("source_units_sold"), F.sum(F.expr("quantity * unit_price")).cast("double").alias("source_revenue"))


def exact_sum(c: str):
    """Sum of two-digit doubles, exact through whole cents."""
    return F.sum(F.round(F.col(c) * 100).cast("long")) / 100.0


def m2_v4_realized_recon(t):
    both = beside(models.m2_daily_base(t).agg(F.sum("units_sold").alias("model_units_sold")), sold(t).select("source_units_sold"))
    return both.select("*", difference("model_units_sold", "source_units_sold", "units_difference"))


def m2_v5_revenue_recon(t):
    both = beside(models.m2_daily_base(t).agg(exact_sum("revenue").alias("model_revenue")), sold(t).select("source_revenue"))
    return both.select("*", difference("model_revenue", "source_revenue", "revenue_difference", 2))


def m2_v6_zero_share(t):
    one = models.m2_daily_base(t).agg(F.count(F.lit(1)).alias("model_rows"), count_where("units_sold = 0").alias("zero_demand_rows"), count_where("units_sold > 0").alias("positive_demand_rows"))
    return one.withColumn("zero_demand_pct", percent("zero_demand_rows", "model_rows"))


def m2_v8_summary(t):
    return models.m2_daily_base(t).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("order_count").alias("daily_order_product_occurrences"), F.sum("units_sold").alias("total_units_sold"), exact_sum("revenue").alias("total_revenue"),
        mean(F.sum("units_sold"), F.count("units_sold"), 4).alias("avg_units_per_position_day"), F.max("units_sold").alias("max_units_single_position_day"),
    )


def m3_v2_ledger_recon(t):
    ends = models.m2_date_spine(t).agg(F.min("demand_date").alias("lo"), F.max("demand_date").alias("hi"))
    inside = t.inventory_movements.crossJoin(F.broadcast(ends)).where("CAST(event_ts AS DATE) BETWEEN lo AND hi")
    source = inside.agg(*[F.coalesce(sum_where("abs(quantity_change)", f"movement_type = '{k}'"), F.lit(0)).alias(f"source_{k}_units") for k in models.MOVED], F.count(F.lit(1)).alias("source_movement_events"))
    model = models.m3_daily_ledger(t).agg(*[F.sum(f"{k}_units").alias(f"model_{k}_units") for k in models.MOVED], F.sum("movement_event_count").alias("model_movement_events"))
    gaps = [difference(f"model_{k}_units", f"source_{k}_units", f"{k}_difference") for k in models.MOVED]
    return beside(model, source).select("*", *gaps, difference("model_movement_events", "source_movement_events", "event_difference"))


def m3_v3_unknown_types(t):
    ends = models.m2_date_spine(t).agg(F.min("demand_date").alias("lo"), F.max("demand_date").alias("hi"))
    inside = t.inventory_movements.crossJoin(F.broadcast(ends)).where("CAST(event_ts AS DATE) BETWEEN lo AND hi")
    return inside.agg(F.count_if(~F.col("movement_type").isin(*models.MOVED)).alias("unknown_movement_events"))


def m3_v5_demand_unchanged(t):
    model = models.m3_warehouse_product_daily(t).agg(F.sum("units_sold").alias("operational_model_units"), exact_sum("revenue").alias("operational_model_revenue"))
    demand = models.m2_daily_demand(t).agg(F.sum("units_sold").alias("demand_model_units"), exact_sum("revenue").alias("demand_model_revenue"))
    return beside(model, demand).select("*", difference("operational_model_units", "demand_model_units", "units_difference"), difference("operational_model_revenue", "demand_model_revenue", "revenue_difference", 2))


def final_day(t):
    last = models.m2_date_spine(t).agg(F.max("demand_date").alias("demand_date"))
    return models.m3_warehouse_product_daily(t).join(F.broadcast(last), "demand_date")


def m3_v6_final_day(t):
    flags = {"is_stockout": "stockout_positions", "is_below_reorder_point": "below_reorder_positions", "requires_reorder": "reorder_positions"}
    return final_day(t).groupBy("demand_date").agg(
        F.count(F.lit(1)).alias("inventory_positions"), *[F.sum(f"ending_{x}_qty").alias(f"network_{x}_units") for x in ("on_hand", "reserved", "available")], *[count_where(f"{c} = 1").alias(v) for c, v in flags.items()]
    )


def m3_v7_status_mix(t):
    counted = final_day(t).groupBy("stock_status").agg(F.count(F.lit(1)).alias("positions"))
    place = F.expr("CASE stock_status WHEN 'STOCKOUT' THEN 1 WHEN 'CRITICAL' THEN 2 WHEN 'LOW' THEN 3 WHEN 'HEALTHY' THEN 4 ELSE 5 END")
    return counted.withColumn("position_pct", share("positions")).orderBy(place)


def m4_v1_grain(t):
    return models.m4_delivery_features(t).agg(F.count(F.lit(1)).alias("model_rows"), F.count_distinct("shipment_id").alias("distinct_shipments"), (F.count(F.lit(1)) - F.count_distinct("shipment_id")).alias("duplicate_shipment_rows"))


def m4_v2_source_recon(t):
    both = beside(models.m4_delivery_features(t).agg(F.count(F.lit(1)).alias("model_shipments")), t.shipments.agg(F.count(F.lit(1)).alias("source_shipments")))
    return both.select("*", difference("model_shipments", "source_shipments", "difference"))


def outcomes():
    return [F.count(F.lit(1)).alias("shipments"), F.sum("is_delivered").alias("delivered"), F.sum("is_delivery_exception").alias("exceptions"), F.sum("is_late_delivery").alias("late_deliveries")]


def rates():
    return {"exception_rate_pct": percent("exceptions", "shipments"), "late_delivery_rate_pct": percent("late_deliveries", "delivered")}


def hundredths(c: str, digits: int = 2):
    """Mean of rounded doubles from an exact sum of their hundredths."""
    return rounded(F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / 100.0 / F.nullif(F.count(c).cast("double"), F.lit(0.0)), digits)


def m4_v3_outcomes(t):
    return models.m4_delivery_features(t).agg(*outcomes()).withColumns(rates())


def m4_v7_by_carrier(t):
    more = [hundredths("processing_hours").alias("avg_processing_hours"), hundredths("expected_transit_hours").alias("avg_expected_transit_hours")]
    return models.m4_delivery_features(t).groupBy("carrier").agg(*outcomes(), *more).withColumns(rates()).orderBy(F.desc("shipments"), "carrier")


def m4_v8_by_method(t):
    names = {"order_value": "avg_order_value", "total_units": "avg_units", "processing_hours": "avg_processing_hours", "expected_transit_hours": "avg_expected_transit_hours", "shipping_cost": "avg_shipping_cost"}
    weight = rounded(F.sum(F.round(F.col("total_weight_kg") * 1000).cast("long")).cast("double") / 1000.0 / F.nullif(F.count("total_weight_kg").cast("double"), F.lit(0.0)))
    counted = models.m4_delivery_features(t).groupBy("shipping_method").agg(*outcomes(), *[hundredths(c).alias(v) for c, v in names.items()], weight.alias("avg_weight_kg"))
    return counted.withColumns(rates()).drop("delivered", "exceptions", "late_deliveries").orderBy(F.desc("shipments"), "shipping_method")


def m5_v3_demand_recon(t):
    model = models.m5_risk_features(t).agg(F.sum("units_sold").alias("risk_model_units"), exact_sum("revenue").alias("risk_model_revenue"))
    other = models.m3_warehouse_product_daily(t).agg(F.sum("units_sold").alias("operational_model_units"), exact_sum("revenue").alias("operational_model_revenue"))
    return beside(model, other).select("*", difference("risk_model_units", "operational_model_units", "units_difference"), difference("risk_model_revenue", "operational_model_revenue", "revenue_difference", 2))


def m5_v6_target_mix(t):
    one = models.m5_risk_features(t).where("ml_feature_eligible = 1").agg(F.count(F.lit(1)).alias("eligible_rows"), count_where("target_stockout_next_7d = 1").alias("stockout_positive_rows"), count_where("target_reorder_breach_next_7d = 1").alias("reorder_positive_rows"))
    return one.withColumns({"stockout_positive_rate_pct": percent("stockout_positive_rows", "eligible_rows"), "reorder_positive_rate_pct": percent("reorder_positive_rows", "eligible_rows")})


def m5_v7_band_mix(t):
    counted = models.m5_risk_features(t).groupBy("risk_band").agg(F.count(F.lit(1)).alias("rows"))
    place = F.expr("array_position(array('STOCKOUT', 'CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'WARMUP', 'UNKNOWN'), risk_band)")
    return counted.withColumn("row_pct", share("rows")).orderBy(place)


def cents_text(c: str) -> str:
    return f"(CAST(sum(CAST(round({c} * 100) AS BIGINT)) AS DOUBLE) / 100.0::DOUBLE)"


def hundredths_text(c: str, unit: int = 100) -> str:
    return r(f"CAST(sum(CAST(round({c} * {unit}) AS BIGINT)) AS DOUBLE) / {unit}.0::DOUBLE / nullif(CAST(count({c}) AS DOUBLE), 0)")


RATE_TEXT = f"{pct('sum(is_delivery_exception)', 'count(*)')} AS exception_rate_pct, {pct('sum(is_late_delivery)', 'sum(is_delivered)')} AS late_delivery_rate_pct"
OUTCOME_TEXT = f"count(*) AS shipments, {total('is_delivered')} AS delivered, {total('is_delivery_exception')} AS exceptions, {total('is_late_delivery')} AS late_deliveries, {RATE_TEXT}"
INSIDE = "CAST(event_ts AS DATE) BETWEEN (SELECT min(demand_date) FROM v_m2_spine) AND (SELECT max(demand_date) FROM v_m2_spine)"
SOLD = f"FROM c_items JOIN c_orders USING (order_id) WHERE {LIVE}"
LAST = "demand_date = (SELECT max(demand_date) FROM v_m2_spine)"


def triple(name: str, model: str, source: str, left: str, right: str, gap: str) -> str:
    return f"(SELECT {model}) AS {left}, (SELECT {source}) AS {right}, (SELECT {model}) - (SELECT {source}) AS {gap}"


TEXTS = {
    "m1_v1_grain": "SELECT count(*) AS rows, count(DISTINCT order_id) AS distinct_orders, count(*) - count(DISTINCT order_id) AS duplicate_order_rows FROM v_m1",
    "m1_v2_totals": f"SELECT count(*) AS total_orders, {total('is_cancelled')} AS cancelled_orders, {total('has_shipment')} AS shipments, {total('is_delivered')} AS delivered_orders, {total('is_delivery_exception')} AS delivery_exceptions, {total('order_item_lines')} AS order_item_lines, {total('units_ordered')} AS units_ordered, {cents_text('total_amount')} AS total_order_value FROM v_m1",
    "m1_v4_cancel_stage": f"SELECT cancellation_stage, orders, {pct('orders', 'sum(orders) OVER ()')} AS cancellation_share_pct FROM (SELECT cancellation_stage, count(*) AS orders FROM v_m1 WHERE is_cancelled = 1 GROUP BY 1)",
    "m2_v1_grain": position_grain_text("v_m2", "warehouse_product_positions"),
    "m2_v2_bounds": "SELECT min(demand_date) AS first_date, max(demand_date) AS last_date, count(DISTINCT demand_date) AS calendar_days FROM v_m2_base",
    "m2_v3_gross_recon": "SELECT " + triple("", f"{total('gross_units_requested')} FROM v_m2_base", f"{total('quantity')} FROM c_items", "model_gross_units", "source_gross_units", "gross_unit_difference"),
    "m2_v4_realized_recon": "SELECT " + triple("", f"{total('units_sold')} FROM v_m2_base", f"{total('quantity')} {SOLD}", "model_units_sold", "source_units_sold", "units_difference"),
    "m2_v5_revenue_recon": f"SELECT a AS model_revenue, b AS source_revenue, {r('a - b')} AS revenue_difference FROM (SELECT {cents_text('revenue')} AS a FROM v_m2_base), (SELECT CAST(sum(quantity * unit_price) AS DOUBLE) AS b {SOLD})",
    "m2_v6_zero_share": f"SELECT count(*) AS model_rows, {n('units_sold = 0')} AS zero_demand_rows, {n('units_sold > 0')} AS positive_demand_rows, {pct(n('units_sold = 0'), 'count(*)')} AS zero_demand_pct FROM v_m2_base",
    "m2_v8_summary": f"SELECT count(*) AS rows, {total('order_count')} AS daily_order_product_occurrences, {total('units_sold')} AS total_units_sold, {cents_text('revenue')} AS total_revenue, {text_mean('units_sold', digits=4)} AS avg_units_per_position_day, max(units_sold) AS max_units_single_position_day FROM v_m2_base",
    "m3_v1_grain": position_grain_text("v_m3", "warehouse_product_positions"),
    "m3_v2_ledger_recon": "SELECT " + ", ".join(triple(k, f"{total(f'{k}_units')} FROM v_m3_ledger", f"coalesce({total('abs(quantity_change)', f"movement_type = '{k}'")}, 0) FROM c_movements WHERE {INSIDE}", f"model_{k}_units", f"source_{k}_units", f"{k}_difference") for k in models.MOVED) + ", " + triple("", f"{total('movement_event_count')} FROM v_m3_ledger", f"count(*) FROM c_movements WHERE {INSIDE}", "model_movement_events", "source_movement_events", "event_difference"),
    "m3_v3_unknown_types": f"SELECT count(*) AS unknown_movement_events FROM c_movements WHERE {INSIDE} AND movement_type NOT IN ('receipt', 'reservation', 'release', 'shipment')",
    "m3_v5_demand_unchanged": f"SELECT a AS operational_model_units, c AS demand_model_units, a - c AS units_difference, b AS operational_model_revenue, d AS demand_model_revenue, {r('b - d')} AS revenue_difference FROM (SELECT {total('units_sold')} AS a, {cents_text('revenue')} AS b FROM v_m3), (SELECT {total('units_sold')} AS c, {cents_text('revenue')} AS d FROM v_m2)",
    "m3_v6_final_day": f"SELECT demand_date, count(*) AS inventory_positions, {total('ending_on_hand_qty')} AS network_on_hand_units, {total('ending_reserved_qty')} AS network_reserved_units, {total('ending_available_qty')} AS network_available_units, {n('is_stockout = 1')} AS stockout_positions, {n('is_below_reorder_point = 1')} AS below_reorder_positions, {n('requires_reorder = 1')} AS reorder_positions FROM v_m3 WHERE {LAST} GROUP BY 1",
    "m3_v7_status_mix": f"SELECT stock_status, positions, {pct('positions', 'sum(positions) OVER ()')} AS position_pct FROM (SELECT stock_status, count(*) AS positions FROM v_m3 WHERE {LAST} GROUP BY 1)",
    "m4_v1_grain": "SELECT count(*) AS model_rows, count(DISTINCT shipment_id) AS distinct_shipments, count(*) - count(DISTINCT shipment_id) AS duplicate_shipment_rows FROM v_m4",
    "m4_v2_source_recon": "SELECT " + triple("", "count(*) FROM v_m4", "count(*) FROM c_shipments", "model_shipments", "source_shipments", "difference"),
    "m4_v3_outcomes": f"SELECT {OUTCOME_TEXT} FROM v_m4",
    "m4_v7_by_carrier": f"SELECT carrier, {OUTCOME_TEXT}, {hundredths_text('processing_hours')} AS avg_processing_hours, {hundredths_text('expected_transit_hours')} AS avg_expected_transit_hours FROM v_m4 GROUP BY carrier",
    "m4_v8_by_method": f"SELECT shipping_method, count(*) AS shipments, {hundredths_text('order_value')} AS avg_order_value, {hundredths_text('total_units')} AS avg_units, {hundredths_text('total_weight_kg', 1000)} AS avg_weight_kg, {hundredths_text('processing_hours')} AS avg_processing_hours, {hundredths_text('expected_transit_hours')} AS avg_expected_transit_hours, {hundredths_text('shipping_cost')} AS avg_shipping_cost, {RATE_TEXT} FROM v_m4 GROUP BY 1",
    "m5_v1_grain": position_grain_text("v_m5", "positions"),
    "m5_v3_demand_recon": f"SELECT a AS risk_model_units, c AS operational_model_units, a - c AS units_difference, b AS risk_model_revenue, d AS operational_model_revenue, {r('b - d')} AS revenue_difference FROM (SELECT {total('units_sold')} AS a, {cents_text('revenue')} AS b FROM v_m5), (SELECT {total('units_sold')} AS c, {cents_text('revenue')} AS d FROM v_m3)",
    "m5_v6_target_mix": f"SELECT count(*) AS eligible_rows, {n('target_stockout_next_7d = 1')} AS stockout_positive_rows, {pct(n('target_stockout_next_7d = 1'), 'count(*)')} AS stockout_positive_rate_pct, {n('target_reorder_breach_next_7d = 1')} AS reorder_positive_rows, {pct(n('target_reorder_breach_next_7d = 1'), 'count(*)')} AS reorder_positive_rate_pct FROM v_m5 WHERE ml_feature_eligible = 1",
    "m5_v7_band_mix": f"SELECT risk_band, rows, {pct('rows', 'sum(rows) OVER ()')} AS row_pct FROM (SELECT risk_band, count(*) AS rows FROM v_m5 GROUP BY 1)",
}


def registered():
    """name, function of the tables, oracle text."""
    for name, (model, conditions) in CONTRADICTIONS.items():
        counts = ", ".join(f"{n(c)} AS {k}" for k, c in conditions.items())
        yield name, lambda t, m=model, c=conditions: contradictions(getattr(models, m)(t), c), f"SELECT {counts} FROM {VIEW[model]}"
    for name in PREVIEWS:
        yield name, lambda t, k=name: preview(k, t), preview_text(name)
    grains = {"m2_v1_grain": ("m2_daily_demand", "warehouse_product_positions"), "m3_v1_grain": ("m3_warehouse_product_daily", "warehouse_product_positions"), "m5_v1_grain": ("m5_risk_features", "positions")}
    for name, text in TEXTS.items():
        if name in grains:
            model, label = grains[name]
            yield name, lambda t, m=model, c=label: position_grain(getattr(models, m)(t), c), text
        else:
            yield name, globals()[name], text


__all__ = ["div", "money", "registered"]
