"""Derivations over orders: totals, statuses, milestones, the event log and the movement ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklane.sources.schemas import ORDER_STATUSES


def order_totals(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders with ``total_amount``, the sum of quantity times price of their lines (0 without lines)."""
    totals = items.groupBy("order_id").agg(F.sum(F.expr("quantity * unit_price")).cast("decimal(14,2)").alias("total_amount"))
    kept = orders.select([c for c in orders.columns if c != "total_amount"])
    return kept.join(totals, "order_id", "left").withColumn("total_amount", F.coalesce("total_amount", F.lit(0).cast("decimal(14,2)")))


def order_status(orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """Orders with an exception shipment stay ``shipped``; the other statuses hold."""
    failed = shipments.where("shipment_status = 'exception'").select("order_id").distinct().withColumn("failed", F.lit(True))
    joined = orders.join(failed, "order_id", "left")
    return joined.withColumn("order_status", F.when(F.col("failed"), "shipped").otherwise(F.col("order_status"))).select(orders.columns)


def later(start: str, amount: str, unit: str) -> Column:
    return F.expr(f"timestampadd({unit}, CAST({amount} AS INT), {start})")


#: Shares of the time from order to shipment at which packed-in milestones lie, and the least span.
COMPRESSED = {"payment_confirmed_ts": 15, "inventory_reserved_ts": 30, "processing_started_ts": 50, "order_packed_ts": 80}
LEAST_SPAN = 5


def compress(timed: DataFrame) -> DataFrame:
    """Where packing would pass the shipment's creation, all milestones move into the time before it."""
    late = "order_packed_ts > shipment_created_ts"
    span = f"greatest(timestampdiff(SECOND, order_ts, shipment_created_ts), {LEAST_SPAN})"
    marked = timed.withColumn("late", F.coalesce(F.expr(late), F.lit(False))).withColumn("span", F.expr(span))
    for name, share in COMPRESSED.items():
        marked = marked.withColumn(name, F.when(F.col("late"), later("order_ts", f"span * {share} DIV 100", "SECOND")).otherwise(F.col(name)))
    return marked.withColumn("compressed", F.col("late").cast("int")).drop("late", "span")


#: How far a cancelled order can have come.
CANCELLED_AT = ("pre_payment", "post_payment", "post_reservation")


def milestones(orders: DataFrame) -> DataFrame:
    """Orders (left joined to their shipments) with the time of every lifecycle stage they reach.

    ``stage``: how far a cancelled order came, null for others.
    """
    timed = orders.withColumn("stage", F.when(F.col("order_status") == "cancelled", F.element_at(F.array(*map(F.lit, CANCELLED_AT)), F.expr("CAST(order_id % 3 AS INT) + 1"))))
    timed = timed.withColumn("payment_confirmed_ts", later("order_ts", "1 + order_id % 20", "MINUTE")).withColumn("inventory_reserved_ts", later("payment_confirmed_ts", "1 + order_id % 15", "MINUTE"))
    timed = timed.withColumn("processing_started_ts", later("inventory_reserved_ts", "5 + order_id % 41", "MINUTE")).withColumn("order_packed_ts", later("processing_started_ts", "1 + order_id % 8", "HOUR"))
    timed = compress(timed)
    last = F.expr("CASE stage WHEN 'pre_payment' THEN order_ts WHEN 'post_payment' THEN payment_confirmed_ts ELSE inventory_reserved_ts END")
    timed = timed.withColumn("last", last).withColumn("order_cancelled_ts", F.when(F.col("stage").isNotNull(), later("last", "5 + order_id % 10", "MINUTE")))
    return timed.withColumn("inventory_released_ts", F.when(F.col("stage") == "post_reservation", later("order_cancelled_ts", "1 + order_id % 15", "MINUTE"))).drop("last")


#: The stages that move stock, and the movements that they cause.
MOVING = {"inventory_reserved": "reservation", "inventory_released": "release", "order_shipped": "shipment"}


def stages(timed: DataFrame, among=None) -> DataFrame:
    """One row per order and stage reached, of the stages ``among`` (all): its place in the lifecycle, name and time."""
    active, paid = F.col("stage").isNull(), F.expr("stage IS NULL OR stage <> 'pre_payment'")
    reserved = F.expr("stage IS NULL OR stage = 'post_reservation'")
    steps = [
        ("order_created", F.col("order_ts"), F.lit(True)),
        ("payment_confirmed", F.col("payment_confirmed_ts"), paid),
        ("inventory_reserved", F.col("inventory_reserved_ts"), reserved),
        ("processing_started", F.col("processing_started_ts"), active),
        ("order_packed", F.col("order_packed_ts"), active),
        ("shipment_created", F.col("shipment_created_ts"), active),
        ("order_shipped", F.col("order_shipped_ts"), active),
        ("order_delivered", F.col("delivered_at"), active & (F.col("shipment_status") == "delivered")),
        ("delivery_exception", F.col("expected_delivery_at"), active & (F.col("shipment_status") == "exception")),
        ("order_cancelled", F.col("order_cancelled_ts"), F.col("stage").isNotNull()),
        ("inventory_released", F.col("inventory_released_ts"), F.col("stage") == "post_reservation"),
    ]
    kept = [F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(k).alias("seq"), F.lit(name).alias("event_type"), ts.alias("event_ts"))) for k, (name, ts, on) in enumerate(steps) if among is None or name in among]
    return timed.select("order_id", "warehouse_id", "order_status", "stage", F.explode(F.filter(F.array(*kept), lambda x: x.isNotNull())).alias("e")).select("*", "e.*")


def order_events(timed: DataFrame, source: str) -> DataFrame:
    """One row per order and stage reached; ids are unique by order and place in the lifecycle."""
    long = stages(timed)
    stage = F.when(F.col("event_type") == "order_cancelled", F.col("stage"))
    payload = F.to_json(F.struct(F.col("order_id"), stage.alias("stage"), F.col("order_status").alias("status")))
    # The same text without a writer by row, where both words are plain.
    plain = F.col("order_id").isNotNull() & F.col("order_status").isin(*ORDER_STATUSES) & (stage.isNull() | stage.isin(*CANCELLED_AT))
    text = F.concat(F.lit('{"order_id":'), F.col("order_id").cast("string"), F.coalesce(F.concat(F.lit(',"stage":"'), stage, F.lit('"')), F.lit("")), F.lit(',"status":"'), F.col("order_status"), F.lit('"}'))
    payload = F.when(plain, text).otherwise(payload)
    event_id = F.expr("order_id * 16 + seq")
    # The padding as text; a format by row costs several times as much and is for numbers of another length only.
    event_key = F.when(event_id.between(0, 999_999_999), F.concat(F.lit("EVT-"), F.lpad(event_id.cast("string"), 9, "0"))).otherwise(F.format_string("EVT-%09d", event_id))
    return long.select(
        event_id.alias("event_id"), event_key.alias("event_key"), "order_id", "warehouse_id", "event_type", "event_ts", F.lit(source).alias("source"), payload.alias("payload"),
        later("event_ts", "1", "SECOND").alias("ingested_at"),
    )


def opening_receipts(inventory: DataFrame, start: Column) -> DataFrame:
    """Opening stock as receipts at ``start``."""
    return inventory.where("on_hand_qty > 0").select(
        F.expr("warehouse_id * 1000 + product_id").alias("movement_id"), "warehouse_id", "product_id", F.lit(None).cast("bigint").alias("order_id"),
        F.lit("receipt").alias("movement_type"), F.col("on_hand_qty").alias("quantity_change"), start.alias("event_ts"),
    )


def line_movements(items: DataFrame, events: DataFrame) -> DataFrame:
    """A movement per order line and stock-changing event: reserved and shipped lower, released raises."""
    kind = F.expr("CASE event_type " + " ".join(f"WHEN '{event}' THEN '{move}'" for event, move in MOVING.items()) + " END")
    moving = events.withColumn("movement_type", kind).where("movement_type IS NOT NULL").select("order_id", "warehouse_id", "movement_type", "event_ts")
    number = F.expr("1000000 + order_item_id * 4 + CASE movement_type WHEN 'reservation' THEN 1 WHEN 'release' THEN 2 ELSE 3 END")
    return items.join(moving, "order_id").select(
        number.alias("movement_id"), "warehouse_id", "product_id", "order_id", "movement_type", F.expr("CASE WHEN movement_type = 'release' THEN quantity ELSE -quantity END").alias("quantity_change"), "event_ts"
    )
