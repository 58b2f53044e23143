"""The data-quality suite over the canonical tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stocklane.functions.columns import count_where, percent, ratio, rounded
from stocklane.operators import quality as q
from stocklane.operators.ranges import running
from stocklane.operators.storage import materialize
from stocklane.plans.oracle.binding import div, n, pct, r
from stocklane.sources.schemas import CARRIERS, EVENT_SOURCE, EVENT_TYPES, MOVEMENT_TYPES, ORDER_STATUSES, SHIPMENT_STATUSES, SHIPPING_METHODS

START = "TIMESTAMP_NTZ'2025-08-01 00:00:00'"
#: Required columns, keys, references, words, ranges and comparisons of columns.
REQUIRED = {
    "products": "product_id sku product_name category_id unit_price", "warehouses": "warehouse_id warehouse_code capacity_units", "customers": "customer_id customer_external_id country_code",
    "inventory": "warehouse_id product_id on_hand_qty reserved_qty reorder_point", "orders": "order_id order_external_id customer_id order_status shipping_method order_ts promised_delivery_ts total_amount",
    "order_items": "order_item_id order_id product_id quantity unit_price", "shipments": "shipment_id order_id warehouse_id shipment_status", "inventory_movements": "movement_id warehouse_id product_id movement_type quantity_change event_ts",
    "order_events": "event_id event_key order_id event_type event_ts source payload",
}
KEYS = {"products": "product_id", "warehouses": "warehouse_id", "customers": "customer_id", "orders": "order_id", "order_items": "order_item_id", "shipments": "shipment_id", "inventory_movements": "movement_id", "order_events": "event_key"}
COMPOSITE = {"inventory": "warehouse_id product_id", "order_items": "order_id product_id"}
REFERENCES = (
    ("products", "category_id", "product_categories"), ("inventory", "product_id", "products"), ("inventory", "warehouse_id", "warehouses"), ("orders", "customer_id", "customers"), ("orders", "warehouse_id", "warehouses"),
    ("order_items", "order_id", "orders"), ("order_items", "product_id", "products"), ("shipments", "order_id", "orders"), ("inventory_movements", "order_id", "orders"), ("inventory_movements", "product_id", "products"), ("order_events", "order_id", "orders"),
)
DOMAINS = (
    ("orders", "order_status", ORDER_STATUSES), ("orders", "shipping_method", SHIPPING_METHODS), ("shipments", "shipment_status", SHIPMENT_STATUSES), ("shipments", "carrier", CARRIERS),
    ("inventory_movements", "movement_type", MOVEMENT_TYPES), ("order_events", "event_type", EVENT_TYPES),
)
RANGES = {
    "products": {"price_not_negative": "unit_price < 0", "weight_positive": "weight_kg <= 0"}, "warehouses": {"capacity_positive": "capacity_units <= 0"},
    "inventory": {"on_hand_not_negative": "on_hand_qty < 0", "reserved_not_negative": "reserved_qty < 0"}, "orders": {"total_not_negative": "total_amount < 0"},
    "order_items": {"quantity_positive": "quantity <= 0", "item_price_not_negative": "unit_price < 0"}, "shipments": {"cost_not_negative": "shipping_cost < 0"}, "inventory_movements": {"quantity_not_zero": "quantity_change = 0"},
}
CROSS = {
    "products": {"cost_within_price": "unit_cost > unit_price"}, "inventory": {"reserved_within_on_hand": "reserved_qty > on_hand_qty"}, "orders": {"promised_after_order": "promised_delivery_ts < order_ts"},
    "shipments": {"delivered_after_shipped": "delivered_at < shipped_at"},
}
SIGNS = {"receipt_positive": "movement_type = 'receipt' AND quantity_change <= 0", "release_positive": "movement_type = 'release' AND quantity_change <= 0", "return_positive": "movement_type = 'return' AND quantity_change <= 0", "reservation_negative": "movement_type = 'reservation' AND quantity_change >= 0", "shipment_negative": "movement_type = 'shipment' AND quantity_change >= 0"}
ORDER_REFS = {"receipt_without_order": "movement_type = 'receipt' AND order_id IS NOT NULL", "transaction_with_order": "movement_type IN ('reservation', 'release', 'shipment') AND order_id IS NULL"}
STAMPS = {"delivered_has_timestamp": "shipment_status = 'delivered' AND delivered_at IS NULL", "exception_lacks_timestamp": "shipment_status = 'exception' AND delivered_at IS NOT NULL"}
C = {"product_categories": "c_categories", "products": "c_products", "warehouses": "c_warehouses", "customers": "c_customers", "inventory": "c_inventory", "orders": "c_orders", "order_items": "c_items", "shipments": "c_shipments", "inventory_movements": "c_movements", "order_events": "c_events"}


def row(check: str, table: str, count: str) -> str:
    return f"""SELECT '{check}' AS "check", '{table}' AS "table", CAST(x AS BIGINT) AS violations, x = 0 AS passed FROM (SELECT {count})"""


def rows(found: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(row(*x) for x in found)


def where(table: str, rules: dict[str, str]) -> list[tuple[str, str, str]]:
    return [(k, table, f"count(*) AS x FROM {C[table]} WHERE {c}") for k, c in rules.items()]


def dq_not_null(t):
    return q.combined([q.not_null(t.named(k), k, c.split()) for k, c in REQUIRED.items()])


def dq_unique(t):
    return q.combined([q.unique(t.named(k), k, [c]) for k, c in KEYS.items()])


def dq_unique_composite(t):
    return q.combined([q.unique(t.named(k), k, c.split()) for k, c in COMPOSITE.items()])


def dq_foreign_key(t):
    return q.combined([q.foreign_key(t.named(k), k, c, t.named(p)) for k, c, p in REFERENCES])


def dq_domain(t):
    return q.combined([q.domain(t.named(k), k, c, words) for k, c, words in DOMAINS])


def dq_range(t):
    return q.combined([q.violations(t.named(k), k, rules) for k, rules in RANGES.items()])


def dq_cross_column(t):
    return q.combined([q.violations(t.named(k), k, rules) for k, rules in CROSS.items()])


def dq_expected_count(t):
    return q.combined([q.expected_count(t.warehouses, "warehouses", 5), q.expected_count(t.product_categories, "product_categories", 6)])


def dq_inventory_summary(t):
    low = count_where("on_hand_qty <= reorder_point")
    return t.inventory.agg(F.count(F.lit(1)).alias("positions"), F.count_distinct("product_id").alias("products"), F.count_distinct("warehouse_id").alias("warehouses"), low.alias("low_stock_positions"), percent(low, F.count(F.lit(1))).alias("low_stock_rate_pct"))


def dq_orders_without_items(t):
    return q.missing(t.orders, t.order_items, ["order_id"], "orders", "orders_without_items")


def dq_item_stocked_at_warehouse(t):
    lines = t.order_items.join(t.orders.where("warehouse_id IS NOT NULL").select("order_id", "warehouse_id"), "order_id")
    return q.missing(lines, t.inventory, ["warehouse_id", "product_id"], "order_items", "item_stocked_at_warehouse")


def dq_order_total_recon(t):
    sums = t.order_items.groupBy("order_id").agg(F.sum(F.expr("quantity * unit_price")).alias("expected"))
    return q.violations(t.orders.join(sums, "order_id", "left"), "orders", {"order_total": "abs(total_amount - coalesce(expected, 0)) > 0.01"})


def dq_order_summary(t):
    counts = t.order_items.agg(F.count(F.lit(1)).alias("items"))
    orders = t.orders.agg(F.count(F.lit(1)).alias("orders"), count_where("order_status = 'cancelled'").alias("cancelled"))
    both = orders.crossJoin(F.broadcast(counts))
    return both.select("orders", "items", rounded(ratio("items", "orders")).alias("average_items"), percent("cancelled", "orders").alias("cancellation_rate_pct"))


#: Expected shares and tolerances of the bound tables.
METHODS, METHOD_TOLERANCE = {"standard": 0.6, "express": 0.2, "same_day": 0.2}, 0.02
FAILURES, FAILURE_TOLERANCE = {"exception": 0.1, "delivered": 0.9}, 0.015


def dq_distribution_drift(t):
    carriers = {c: 1 / len(CARRIERS) for c in CARRIERS}
    return q.combined([q.drift(t.orders, "orders", "shipping_method", METHODS, METHOD_TOLERANCE), q.drift(t.shipments, "shipments", "carrier", carriers, METHOD_TOLERANCE), q.drift(t.shipments, "shipments", "shipment_status", FAILURES, FAILURE_TOLERANCE)])


def dq_shipment_cardinality(t):
    per = t.shipments.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
    joined = t.orders.select("order_id", "order_status").join(per, "order_id", "left")
    return q.violations(joined, "shipments", {"active_orders_with_one": "order_status <> 'cancelled' AND coalesce(n, 0) <> 1", "cancelled_orders_with_none": "order_status = 'cancelled' AND n IS NOT NULL"})


def dq_shipment_warehouse_match(t):
    joined = t.shipments.select("order_id", "warehouse_id").join(t.orders.select("order_id", F.col("warehouse_id").alias("own")), "order_id")
    return q.violations(joined, "shipments", {"warehouse_match": "warehouse_id <> own"})


def dq_status_timestamp(t):
    return q.violations(t.shipments, "shipments", STAMPS)


def dq_shipment_temporal(t):
    joined = t.shipments.join(t.orders.select("order_id", "order_ts"), "order_id")
    return q.violations(joined, "shipments", {"shipped_after_order": "shipped_at < order_ts", "delivered_after_shipped": "delivered_at < shipped_at"})


def dq_movement_sign(t):
    return q.violations(t.inventory_movements, "inventory_movements", SIGNS)


def dq_movement_order_ref(t):
    return q.violations(t.inventory_movements, "inventory_movements", ORDER_REFS)


def dq_opening_recon(t):
    opened = t.inventory_movements.where(f"movement_type = 'receipt' AND event_ts = {START}").groupBy("warehouse_id", "product_id").agg(F.sum("quantity_change").alias("opened"))
    return q.violations(t.inventory.join(opened, ["warehouse_id", "product_id"], "left"), "inventory_movements", {"opening_receipts": "on_hand_qty <> coalesce(opened, 0)"})


def dq_order_line_recon(t):
    out = []
    for event, kind in (("inventory_reserved", "reservation"), ("inventory_released", "release"), ("order_shipped", "shipment")):
        reached = t.order_events.where(F.col("event_type") == event).select("order_id")
        lines = t.order_items.join(reached, "order_id", "left_semi").groupBy("order_id", "product_id").agg(F.sum("quantity").alias("want"))
        moved = t.inventory_movements.where(F.col("movement_type") == kind).groupBy("order_id", "product_id").agg(F.sum(F.abs("quantity_change")).alias("got"))
        out.append(q.violations(lines.join(moved, ["order_id", "product_id"], "full_outer"), "inventory_movements", {f"line_units:{kind}": "coalesce(want, 0) <> coalesce(got, 0)"}))
    return q.combined(out)


def dq_ledger_replay(t):
    """The ordered replay is linear, so prior states are running sums of the signed changes, over ranges of a position's moves."""
    moves = t.inventory_movements.withColumns({
        "hand": F.expr("CASE WHEN movement_type IN ('receipt', 'shipment', 'return', 'adjustment') THEN quantity_change ELSE 0 END"),
        "held": F.expr("CASE WHEN movement_type IN ('reservation', 'release') THEN -quantity_change WHEN movement_type = 'shipment' THEN quantity_change ELSE 0 END"),
    }).drop("order_id", "created_at")
    m = running(moves, ["warehouse_id", "product_id"], ["event_ts", "movement_id"], {"hand_after": "hand", "held_after": "held"})
    m = m.withColumns({"hand_before": F.expr("hand_after - hand"), "held_before": F.expr("held_after - held")})
    size = "abs(quantity_change)"
    steps = q.violations(m, "inventory_movements", {
        "reservation_within_available": f"movement_type = 'reservation' AND hand_before - held_before < {size}", "release_within_reserved": f"movement_type = 'release' AND held_before < {size}",
        "shipment_within_on_hand": f"movement_type = 'shipment' AND hand_before < {size}", "shipment_within_reserved": f"movement_type = 'shipment' AND held_before < {size}", "never_negative": "hand_after < 0 OR held_after < 0",
    })
    final = moves.groupBy("warehouse_id", "product_id").agg(F.sum("held").alias("held"))  # what the last running sum is
    return steps.unionByName(q.violations(final, "inventory_movements", {"ends_without_reserved": "held <> 0"}))


def dq_movement_summary(t):
    m = t.inventory_movements
    kinds = [F.count_if(F.col("movement_type") == k).alias(f"{k}_movements") for k in ("receipt", "reservation", "release", "shipment")]
    return m.agg(F.count(F.lit(1)).alias("movements"), *kinds, count_where(f"movement_type = 'receipt' AND event_ts = {START}").alias("opening_receipts"), count_where(f"movement_type = 'receipt' AND event_ts > {START}").alias("replenishments"))


def dq_event_source(t):
    return q.violations(t.order_events, "order_events", {"source": F.col("source") != EVENT_SOURCE})


def dq_json_payload(t):
    return q.violations(t.order_events, "order_events", {"payload_is_object": "json_object_keys(payload) IS NULL"})


def dq_created_event(t):
    made = t.order_events.where("event_type = 'order_created'").groupBy("order_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_ts").alias("at"))
    return q.violations(t.orders.select("order_id", "order_ts").join(made, "order_id", "left"), "order_events", {"one_created_event": "coalesce(n, 0) <> 1", "created_at_order_time": "at <> order_ts"})


def dq_event_order(t):
    """By event id, not by time, so that a wrong order can show."""
    before = F.lag("event_ts").over(Window.partitionBy("order_id").orderBy("event_id"))
    return q.violations(t.order_events.withColumn("before", before), "order_events", {"chronological": "event_ts < before"})


#: Events that a path needs and those that it forbids.
PATHS = {
    "delivered": (("order_created", "payment_confirmed", "inventory_reserved", "processing_started", "order_packed", "shipment_created", "order_shipped", "order_delivered"), ("delivery_exception", "order_cancelled", "inventory_released")),
    "shipped": (("order_created", "payment_confirmed", "inventory_reserved", "processing_started", "order_packed", "shipment_created", "order_shipped", "delivery_exception"), ("order_delivered", "order_cancelled", "inventory_released")),
    "pre_payment": (("order_created", "order_cancelled"), ("payment_confirmed", "inventory_reserved", "inventory_released", "shipment_created")),
    "post_payment": (("order_created", "payment_confirmed", "order_cancelled"), ("inventory_reserved", "inventory_released", "shipment_created")),
    "post_reservation": (("order_created", "payment_confirmed", "inventory_reserved", "order_cancelled", "inventory_released"), ("shipment_created", "order_shipped")),
}


def lifecycle_paths(t):
    """Orders with the set of their events (at most eleven kinds) and the path they should have taken."""
    stage = F.max(F.when(F.col("event_type") == "order_cancelled", F.get_json_object("payload", "$.stage"))).alias("stage")
    seen = t.order_events.groupBy("order_id").agg(F.collect_set("event_type").alias("kinds"), stage)
    return t.orders.select("order_id", "order_status").join(seen, "order_id", "left").withColumns({"kinds": F.coalesce("kinds", F.array().cast("array<string>")), "path": F.when(F.col("order_status") == "cancelled", F.col("stage")).otherwise(F.col("order_status"))})


def dq_lifecycle_conformance(t):
    rules = {"known_path": ~F.coalesce(F.col("path"), F.lit("")).isin(*PATHS)}
    for path, (needed, forbidden) in PATHS.items():
        listed = lambda words: F.array(*map(F.lit, words))
        rules[f"required:{path}"] = (F.col("path") == path) & (F.size(F.array_except(listed(needed), "kinds")) > 0)
        rules[f"forbidden:{path}"] = (F.col("path") == path) & (F.size(F.array_intersect(listed(forbidden), "kinds")) > 0)
    return q.violations(lifecycle_paths(t), "order_events", rules)


def dq_lifecycle_summary(t):
    has = lambda k: F.array_contains("kinds", k)
    return lifecycle_paths(t).agg(F.count_if(has("order_delivered")).alias("delivered"), F.count_if(has("delivery_exception")).alias("exceptions"), F.count_if(has("order_cancelled")).alias("cancelled"), F.count_if(has("inventory_released")).alias("post_reservation"))


#: JSON objects that need no parser to be told: fields of letters, with letters or a whole number each.
FLAT_OBJECT = r'^\{"[a-z_]+":(?:"[a-z_]*"|0|[1-9][0-9]{0,17})(?:,"[a-z_]+":(?:"[a-z_]*"|0|[1-9][0-9]{0,17}))*\}\z'


def row_rules(t) -> dict[str, dict]:
    """By table every rule that one row can break, so that a report reads each table once for all of them."""
    rules: dict[str, dict] = {k: {f"not_null:{c}": F.col(c).isNull() for c in cs.split()} for k, cs in REQUIRED.items()}
    for k, c, words in DOMAINS:
        rules[k][f"domain:{c}"] = ~F.col(c).isin(*words)
    for more in (RANGES, CROSS, {"inventory_movements": SIGNS | ORDER_REFS, "shipments": STAMPS}):
        for k, own in more.items():
            rules[k] |= {name: F.expr(c) for name, c in own.items()}
    # A flat object of plain words and numbers is seen without a parser; json_object_keys judges all other texts.
    rules["order_events"] |= {"source": F.col("source") != EVENT_SOURCE, "payload_is_object": F.expr(f"IF(payload RLIKE r'{FLAT_OBJECT}', false, json_object_keys(payload) IS NULL)")}
    return rules


#: The events that a line's units have to be moved for, and the kind of move.
REACHED = (("inventory_reserved", "reservation"), ("inventory_released", "release"), ("order_shipped", "shipment"))


def mask(kinds) -> int:
    """A set of event kinds as bits."""
    return sum(1 << (EVENT_TYPES.index(k) + 1) for k in kinds)


#: Stages by name: ``placed_stage`` numbers them, so that the largest stage of an order is a number and sums need no sort.
STAGES = sorted(PATHS)


def placed_stage(stage: str) -> str:
    """SQL: twice the number of ``STAGES`` before a text, and one more for one of them; larger texts have no smaller numbers."""
    before = " + ".join(f"CAST({stage} > '{k}' AS INT)" for k in STAGES)
    return f"2 * ({before}) + CAST({stage} IN {tuple(STAGES)} AS INT)"


def order_facts(t):
    """A row an order id: what orders, items, shipments, moves and events say of it. Each table is read once. Items and moves are dealt by order, about
    ``ROWS`` lines a task, and added up by order and product there; those without an order after partial sums, so they gather in no task."""
    known = ", ".join(f"'{k}'" for k in EVENT_TYPES)
    gots = [f"got_{kind}" for _, kind in REACHED]
    items = t.order_items.selectExpr("order_id", "product_id", "CAST(quantity AS BIGINT) AS want", "quantity * unit_price AS amount", "1L AS items", "0L AS moves", *[f"0L AS {g}" for g in gots])
    moves = t.inventory_movements.selectExpr("order_id", "product_id", "0L AS want", "CAST(NULL AS DECIMAL(23,2)) AS amount", "0L AS items", "1L AS moves", *[f"CAST(IF(movement_type = '{kind}', abs(quantity_change), 0) AS BIGINT) AS got_{kind}" for _, kind in REACHED])
    rows = items.unionByName(moves)
    # Lines that break the rule if the order has reached the event, and if it has not (nothing is wanted then).
    apart = [F.sum(F.expr(f"IF(product_id IS NULL, IF(want <> 0, 1L, 0L) + IF({g} <> 0, 1L, 0L), IF(want <> {g}, 1L, 0L))")).alias(f"apart_{g}") for g in gots]
    loose = [F.sum(F.expr(f"IF({g} <> 0, 1L, 0L)")).alias(f"loose_{g}") for g in gots]

    def summed(part):
        lines = part.groupBy("order_id", "product_id").agg(*[F.sum(c).alias(c) for c in ("items", "moves", "amount")], *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("want", *gots)])
        return lines.groupBy("order_id").agg(*[F.sum(c).alias(c) for c in ("items", "moves", "amount")], F.sum(F.expr("greatest(items - 1, 0L)")).alias("again"), *apart, *loose)

    lines = summed(t.dealt(rows.where("order_id IS NOT NULL"))).unionByName(summed(rows.where("order_id IS NULL")))
    events = t.order_events.selectExpr(
        "order_id", "event_id", "event_ts", f"shiftleft(1L, CAST(array_position(array({known}), event_type) AS INT)) AS kinds", "IF(event_type = 'order_cancelled', get_json_object(payload, '$.stage'), NULL) AS name",
    )
    events = t.dealt(events.select("order_id", "event_id", "event_ts", "kinds", F.expr(placed_stage("name")).alias("stage")))
    before = F.lag("event_ts").over(Window.partitionBy("order_id").orderBy("event_id"))
    made = f"kinds = {mask(['order_created'])}"
    events = events.withColumn("before", before).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("events"), F.bit_or("kinds").alias("kinds"), F.max("stage").alias("stage"), F.count_if(F.expr(made)).alias("made"), F.min(F.when(F.expr(made), F.col("event_ts"))).alias("made_at"),
        F.count_if(F.expr("event_ts < before")).alias("late"),
    )
    facts = t.shipments.selectExpr("order_id", "1L AS ships")
    for more in (t.orders.selectExpr("order_id", "1L AS known"), lines, events):
        facts = facts.unionByName(more, allowMissingColumns=True)
    sums = ("known", "items", "ships", "moves", "events", "made", "late", "again", "amount", *[f"{x}_{g}" for x in ("apart", "loose") for g in gots])
    return facts.groupBy("order_id").agg(*[F.sum(c).alias(c) for c in sums], F.bit_or("kinds").alias("kinds"), F.max("stage").alias("stage"), F.min("made_at").alias("made_at"))


#: Tables whose rows refer to orders, and the column of facts that counts these rows.
OF_ORDERS = {"order_items": "items", "shipments": "ships", "inventory_movements": "moves", "order_events": "events"}


def order_rules(t):
    """All rules of orders against their items, shipments, moves and events, and their keys and references, from one table of facts an order."""
    facts = materialize(order_facts(t), "order-facts")
    units = {f"line_units:{kind}": F.coalesce(F.sum(F.expr(f"IF(order_id IS NOT NULL AND coalesce(kinds, 0) & {mask([event])} <> 0, apart_got_{kind}, loose_got_{kind})")), F.lit(0)) for event, kind in REACHED}
    total = lambda text: F.coalesce(F.sum(F.expr(text)), F.lit(0))
    found = {("inventory_movements", name): x for name, x in units.items()}
    found |= {("order_events", "chronological"): total("late"), ("orders", "unique:order_id"): total("greatest(coalesce(known, 0) - 1, 0)"), ("order_items", "unique:order_id,product_id"): total("again")}
    found |= {(k, "foreign_key:order_id"): total(f"IF(order_id IS NOT NULL AND known IS NULL, {c}, 0)") for k, c in OF_ORDERS.items()}
    of_keys = stacked(facts.agg(*[x.alias(f"c{i}") for i, x in enumerate(found.values())]), [*found])
    met = t.orders.select("order_id", "order_status", "order_ts", "total_amount").join(facts, "order_id", "left")
    stage = " ".join(f"WHEN {2 * i + 1} THEN '{k}'" for i, k in enumerate(STAGES))
    met = met.withColumns({"kinds": F.coalesce("kinds", F.lit(0).cast("bigint")), "path": F.expr(f"IF(order_status = 'cancelled', CASE stage {stage} END, order_status)")})
    rules = {"orders": {"orders_without_items": "coalesce(items, 0) = 0", "order_total": "abs(total_amount - coalesce(amount, 0)) > 0.01"}}
    rules["shipments"] = {"active_orders_with_one": "order_status <> 'cancelled' AND coalesce(ships, 0) <> 1", "cancelled_orders_with_none": "order_status = 'cancelled' AND ships > 0"}
    rules["order_events"] = {"one_created_event": "coalesce(made, 0) <> 1", "created_at_order_time": "made_at <> order_ts", "known_path": f"coalesce(path, '') NOT IN {tuple(PATHS)}"}
    for path, (needed, forbidden) in PATHS.items():
        rules["order_events"] |= {f"required:{path}": f"path = '{path}' AND kinds & {mask(needed)} <> {mask(needed)}", f"forbidden:{path}": f"path = '{path}' AND kinds & {mask(forbidden)} <> 0"}
    names = [(k, name, c) for k, own in rules.items() for name, c in own.items()]
    of_orders = stacked(met.agg(*[F.count_if(F.expr(c)).alias(f"c{i}") for i, (_, _, c) in enumerate(names)]), [(k, name) for k, name, _ in names])
    return q.combined([of_keys, of_orders])


def stacked(counts, names):
    """A one-row frame of counts c0, c1, ..., turned into a row each; ``names``: their tables and checks."""
    pairs = ", ".join(f"'{name}', '{k}', CAST(c{i} AS BIGINT)" for i, (k, name) in enumerate(names))
    return counts.selectExpr(f"stack({len(names)}, {pairs}) AS (check, table, violations)").withColumn("passed", F.col("violations") == 0)


def shipment_rules(t):
    """Shipments against their orders, both rules in one join."""
    joined = t.shipments.join(t.orders.select("order_id", "order_ts", F.col("warehouse_id").alias("own")), "order_id")
    return q.violations(joined, "shipments", {"warehouse_match": "warehouse_id <> own", "shipped_after_order": "shipped_at < order_ts", "delivered_after_shipped": "delivered_at < shipped_at"})


def key_rules(t):
    """Every unique column and reference of all tables, but those of orders that ``order_rules`` finds."""
    unique = [(k, [c]) for k, c in KEYS.items()] + [(k, c.split()) for k, c in COMPOSITE.items()] + [(k, [c]) for k, cs in MORE_KEYS.items() for c in cs]
    by_facts = [("orders", ["order_id"]), ("order_items", ["order_id", "product_id"])]
    references = [x for x in (*REFERENCES, *MORE_REFERENCES) if x[1] != "order_id"]
    return q.keys({k: t.named(k) for k in C}, [x for x in unique if x not in by_facts], references)


#: Checks that the fused passes of the report cover.
FUSED = (
    "dq_not_null", "dq_domain", "dq_range", "dq_cross_column", "dq_movement_sign", "dq_movement_order_ref", "dq_status_timestamp", "dq_event_source", "dq_json_payload", "dq_unique", "dq_unique_composite", "dq_foreign_key",
    "dq_unique_declared", "dq_warehouse_reference", "dq_orders_without_items", "dq_order_total_recon", "dq_shipment_cardinality", "dq_shipment_warehouse_match", "dq_shipment_temporal", "dq_order_line_recon", "dq_created_event",
    "dq_event_order", "dq_lifecycle_conformance",
)


def dq_report(t):
    """Every check: one pass a table for the rules of a row, one shuffle for all keys and references, one table of facts an order for the
    rules of orders, and one query a check for the others."""
    fused = [q.violations(t.named(k), k, rules) for k, rules in row_rules(t).items()]
    return q.combined([*fused, key_rules(t), order_rules(t), shipment_rules(t), *(globals()[name](t) for name in (*CHECKS, *DECLARED) if name not in FUSED)])


#: Unique columns and references that the schema declares besides ``KEYS`` and ``REFERENCES``, and expected rows.
MORE_KEYS = {"product_categories": ("category_name",), "products": ("sku",), "warehouses": ("warehouse_code",), "customers": ("customer_external_id",), "orders": ("order_external_id",), "shipments": ("shipment_external_id",)}
MORE_REFERENCES = (("shipments", "warehouse_id", "warehouses"), ("inventory_movements", "warehouse_id", "warehouses"), ("order_events", "warehouse_id", "warehouses"))
RATES = {"cancellation_rate": ("orders", "order_status = 'cancelled'", "true", 0.333, 0.02), "late_delivery_rate": ("shipments", "delivered_at > expected_delivery_at", "shipment_status = 'delivered'", 0.25, 0.1)}


def dq_unique_declared(t):
    return q.combined([q.unique(t.named(k), k, [c]) for k, cs in MORE_KEYS.items() for c in cs])


def dq_warehouse_reference(t):
    return q.combined([q.foreign_key(t.named(k), k, c, t.named(p)) for k, c, p in MORE_REFERENCES])


def dq_expected_rows(t):
    """The bound tables' rows against those of the tables they come from: a row a brand and type, customer, order with lines."""
    rows = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    raw = t.raw("lineitem").select("l_orderkey").distinct()
    wanted = {"products": rows(t.raw("part").select("p_brand", "p_type").distinct()), "customers": rows(t.raw("customer")), "orders": rows(raw.join(t.raw("orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi"))}
    gap = lambda k: rows(t.named(k)).crossJoin(F.broadcast(wanted[k].withColumnRenamed("n", "want")))
    return q.combined([q.verdicts(gap(k).select(F.abs(F.col("n") - F.col("want")).alias("expected_count")), k) for k in wanted])


def dq_rate_drift(t):
    """Shares of cancelled orders and of late deliveries against their expected values."""
    out = []
    for name, (k, hit, among, expected, tolerance) in RATES.items():
        share = F.count_if(F.expr(f"({among}) AND ({hit})")) / F.nullif(F.count_if(F.expr(among)).cast("double"), F.lit(0.0))
        out.append(q.verdicts(t.named(k).agg(F.coalesce(F.abs(share - F.lit(expected)) > tolerance, F.lit(True)).cast("int").alias(f"drift:{name}")), k))
    return q.combined(out)


def recon_text(event: str, kind: str) -> str:
    return f"""count(*) AS x FROM (SELECT order_id, product_id, sum(quantity) AS want FROM c_items WHERE order_id IN (SELECT order_id FROM c_events WHERE event_type = '{event}') GROUP BY ALL) a
  FULL JOIN (SELECT order_id, product_id, sum(abs(quantity_change)) AS got FROM c_movements WHERE movement_type = '{kind}' GROUP BY ALL) b USING (order_id, product_id) WHERE coalesce(want, 0) <> coalesce(got, 0)"""


_RUN = "(PARTITION BY warehouse_id, product_id ORDER BY event_ts, movement_id ROWS UNBOUNDED PRECEDING)"
MORE = {
    "v_replay": f"""SELECT *, ha - h AS hb, ra - v AS rb, abs(quantity_change) AS k FROM (SELECT *, sum(h) OVER {_RUN} AS ha, sum(v) OVER {_RUN} AS ra FROM (SELECT *, CASE WHEN movement_type IN ('receipt', 'shipment', 'return', 'adjustment') THEN quantity_change ELSE 0 END AS h,
  CASE movement_type WHEN 'reservation' THEN -quantity_change WHEN 'release' THEN -quantity_change WHEN 'shipment' THEN quantity_change ELSE 0 END AS v FROM c_movements))""",
    "v_paths": """SELECT order_id, list_distinct(list(event_type) FILTER (WHERE event_type IS NOT NULL)) AS kinds, CASE WHEN order_status = 'cancelled' THEN max(json_extract_string(payload, '$.stage')) FILTER (WHERE event_type = 'order_cancelled') ELSE order_status END AS path
  FROM c_orders o LEFT JOIN c_events e USING (order_id) GROUP BY order_id, order_status""",
}
_DRIFT = [(f"drift:{c}={v}", k, f"CAST(abs(CAST({n(f"{c} = '{v}'")} AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0) - {e}::DOUBLE) > {tol}::DOUBLE AS INTEGER) AS x FROM {C[k]}") for k, c, words, tol in (("orders", "shipping_method", METHODS, METHOD_TOLERANCE), ("shipments", "carrier", {c: 1 / len(CARRIERS) for c in CARRIERS}, METHOD_TOLERANCE), ("shipments", "shipment_status", FAILURES, FAILURE_TOLERANCE)) for v, e in words.items()]
CHECKS = {
    "dq_not_null": [(f"not_null:{c}", k, f"count(*) AS x FROM {C[k]} WHERE {c} IS NULL") for k, cs in REQUIRED.items() for c in cs.split()],
    "dq_unique": [(f"unique:{c}", k, f"count(*) - count(DISTINCT {c}) AS x FROM {C[k]}") for k, c in KEYS.items()],
    "dq_unique_composite": [(f"unique:{','.join(c.split())}", k, f"count(*) - count(DISTINCT ({', '.join(c.split())})) AS x FROM {C[k]}") for k, c in COMPOSITE.items()],
    "dq_foreign_key": [(f"foreign_key:{c}", k, f"count(*) AS x FROM {C[k]} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {c} FROM {C[p]})") for k, c, p in REFERENCES],
    "dq_domain": [(f"domain:{c}", k, f"count(*) AS x FROM {C[k]} WHERE {c} NOT IN {words}") for k, c, words in DOMAINS],
    "dq_range": [x for k, rules in RANGES.items() for x in where(k, rules)],
    "dq_cross_column": [x for k, rules in CROSS.items() for x in where(k, rules)],
    "dq_expected_count": [("expected_count", "warehouses", "abs(count(*) - 5) AS x FROM c_warehouses"), ("expected_count", "product_categories", "abs(count(*) - 6) AS x FROM c_categories")],
    "dq_orders_without_items": [("orders_without_items", "orders", "count(*) AS x FROM c_orders WHERE order_id NOT IN (SELECT order_id FROM c_items)")],
    "dq_item_stocked_at_warehouse": [("item_stocked_at_warehouse", "order_items", "count(*) AS x FROM c_items JOIN c_orders USING (order_id) WHERE (warehouse_id, product_id) NOT IN (SELECT (warehouse_id, product_id) FROM c_inventory)")],
    "dq_order_total_recon": [("order_total", "orders", "count(*) AS x FROM c_orders LEFT JOIN (SELECT order_id, sum(quantity * unit_price) AS e FROM c_items GROUP BY 1) USING (order_id) WHERE abs(total_amount - coalesce(e, 0)) > 0.01")],
    "dq_distribution_drift": _DRIFT,
    "dq_shipment_cardinality": [("active_orders_with_one", "shipments", "count(*) AS x FROM c_orders o WHERE order_status <> 'cancelled' AND (SELECT count(*) FROM c_shipments s WHERE s.order_id = o.order_id) <> 1"), ("cancelled_orders_with_none", "shipments", "count(*) AS x FROM c_orders WHERE order_status = 'cancelled' AND order_id IN (SELECT order_id FROM c_shipments)")],
    "dq_shipment_warehouse_match": [("warehouse_match", "shipments", "count(*) AS x FROM c_shipments s JOIN c_orders o USING (order_id) WHERE s.warehouse_id <> o.warehouse_id")],
    "dq_status_timestamp": where("shipments", STAMPS),
    "dq_shipment_temporal": [("shipped_after_order", "shipments", "count(*) AS x FROM c_shipments JOIN c_orders USING (order_id) WHERE shipped_at < order_ts"), ("delivered_after_shipped", "shipments", "count(*) AS x FROM c_shipments WHERE delivered_at < shipped_at")],
    "dq_movement_sign": where("inventory_movements", SIGNS),
    "dq_movement_order_ref": where("inventory_movements", ORDER_REFS),
    "dq_opening_recon": [("opening_receipts", "inventory_movements", "count(*) AS x FROM c_inventory LEFT JOIN (SELECT warehouse_id, product_id, sum(quantity_change) AS o FROM c_movements WHERE movement_type = 'receipt' AND event_ts = TIMESTAMP '2025-08-01' GROUP BY ALL) USING (warehouse_id, product_id) WHERE on_hand_qty <> coalesce(o, 0)")],
    "dq_order_line_recon": [(f"line_units:{k}", "inventory_movements", recon_text(e, k)) for e, k in (("inventory_reserved", "reservation"), ("inventory_released", "release"), ("order_shipped", "shipment"))],
    "dq_ledger_replay": [(name, "inventory_movements", f"count(*) AS x FROM v_replay WHERE {c}") for name, c in (("reservation_within_available", "movement_type = 'reservation' AND hb - rb < k"), ("release_within_reserved", "movement_type = 'release' AND rb < k"), ("shipment_within_on_hand", "movement_type = 'shipment' AND hb < k"), ("shipment_within_reserved", "movement_type = 'shipment' AND rb < k"), ("never_negative", "ha < 0 OR ra < 0"))]
    + [("ends_without_reserved", "inventory_movements", "count(*) AS x FROM (SELECT arg_max(ra, (event_ts, movement_id)) AS z FROM v_replay GROUP BY warehouse_id, product_id) WHERE z <> 0")],
    "dq_event_source": [("source", "order_events", f"count(*) AS x FROM c_events WHERE source <> '{EVENT_SOURCE}'")],
    "dq_json_payload": [("payload_is_object", "order_events", "count(*) AS x FROM c_events WHERE payload IS NULL OR NOT json_valid(payload) OR json_type(payload) <> 'OBJECT'")],
    "dq_created_event": [("one_created_event", "order_events", "count(*) AS x FROM c_orders o WHERE (SELECT count(*) FROM c_events e WHERE e.order_id = o.order_id AND event_type = 'order_created') <> 1"), ("created_at_order_time", "order_events", "count(*) AS x FROM (SELECT order_id, min(event_ts) AS m FROM c_events WHERE event_type = 'order_created' GROUP BY 1) JOIN c_orders USING (order_id) WHERE m <> order_ts")],
    "dq_event_order": [("chronological", "order_events", "count(*) AS x FROM (SELECT event_ts, lag(event_ts) OVER (PARTITION BY order_id ORDER BY event_id) AS b FROM c_events) WHERE event_ts < b")],
    "dq_lifecycle_conformance": [("known_path", "order_events", f"count(*) AS x FROM v_paths WHERE coalesce(path, '') NOT IN {tuple(PATHS)}")]
    + [(f"{word}:{p}", "order_events", f"count(*) AS x FROM v_paths WHERE path = '{p}' AND " + (f"NOT list_has_all(coalesce(kinds, []), {list(need)})" if word == "required" else f"list_has_any(coalesce(kinds, []), {list(bad)})")) for p, (need, bad) in PATHS.items() for word in ("required", "forbidden")],
}
#: Texts of the checks besides, written by hand.
DECLARED = {
    "dq_unique_declared": [
        ("unique:category_name", "product_categories", "count(*) - count(DISTINCT category_name) AS x FROM c_categories"), ("unique:sku", "products", "count(*) - count(DISTINCT sku) AS x FROM c_products"),
        ("unique:warehouse_code", "warehouses", "count(*) - count(DISTINCT warehouse_code) AS x FROM c_warehouses"), ("unique:customer_external_id", "customers", "count(*) - count(DISTINCT customer_external_id) AS x FROM c_customers"),
        ("unique:order_external_id", "orders", "count(*) - count(DISTINCT order_external_id) AS x FROM c_orders"), ("unique:shipment_external_id", "shipments", "count(*) - count(DISTINCT shipment_external_id) AS x FROM c_shipments"),
    ],
    "dq_warehouse_reference": [(f"foreign_key:warehouse_id", k, f"count(*) AS x FROM {c} f WHERE warehouse_id IS NOT NULL AND NOT EXISTS (FROM c_warehouses w WHERE w.warehouse_id = f.warehouse_id)") for k, c in (("shipments", "c_shipments"), ("inventory_movements", "c_movements"), ("order_events", "c_events"))],
    "dq_expected_rows": [
        ("expected_count", "products", "abs((SELECT count(*) FROM c_products) - (SELECT count(DISTINCT (p_brand, p_type)) FROM part)) AS x"), ("expected_count", "customers", "abs((SELECT count(*) FROM c_customers) - (SELECT count(*) FROM customer)) AS x"),
        ("expected_count", "orders", "abs((SELECT count(*) FROM c_orders) - (SELECT count(DISTINCT o_orderkey) FROM orders JOIN lineitem ON o_orderkey = l_orderkey)) AS x"),
    ],
    "dq_rate_drift": [
        ("drift:cancellation_rate", "orders", "CAST(abs(avg(CASE WHEN order_status = 'cancelled' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) - 0.333::DOUBLE) > 0.02::DOUBLE AS INTEGER) AS x FROM c_orders"),
        ("drift:late_delivery_rate", "shipments", "CAST(abs(avg(CASE WHEN delivered_at > expected_delivery_at THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) - 0.25::DOUBLE) > 0.1::DOUBLE AS INTEGER) AS x FROM c_shipments WHERE shipment_status = 'delivered'"),
    ],
}
SUMMARIES = {
    "dq_inventory_summary": f"SELECT count(*) AS positions, count(DISTINCT product_id) AS products, count(DISTINCT warehouse_id) AS warehouses, {n('on_hand_qty <= reorder_point')} AS low_stock_positions, {pct(n('on_hand_qty <= reorder_point'), 'count(*)')} AS low_stock_rate_pct FROM c_inventory",
    "dq_order_summary": f"SELECT a AS orders, b AS items, {r(div('b', 'a'))} AS average_items, {pct('x', 'a')} AS cancellation_rate_pct FROM (SELECT count(*) AS a, {n("order_status = 'cancelled'")} AS x FROM c_orders), (SELECT count(*) AS b FROM c_items)",
    "dq_movement_summary": f"SELECT count(*) AS movements, {', '.join(f"{n(f"movement_type = '{k}'")} AS {k}_movements" for k in ('receipt', 'reservation', 'release', 'shipment'))}, {n("movement_type = 'receipt' AND event_ts = TIMESTAMP '2025-08-01'")} AS opening_receipts, {n("movement_type = 'receipt' AND event_ts > TIMESTAMP '2025-08-01'")} AS replenishments FROM c_movements",
    "dq_lifecycle_summary": f"SELECT count(DISTINCT order_id) FILTER (WHERE event_type = 'order_delivered') AS delivered, count(DISTINCT order_id) FILTER (WHERE event_type = 'delivery_exception') AS exceptions, count(DISTINCT order_id) FILTER (WHERE event_type = 'order_cancelled') AS cancelled, count(DISTINCT order_id) FILTER (WHERE event_type = 'inventory_released') AS post_reservation FROM c_events",
    "dq_report": rows([x for found in (*CHECKS.values(), *DECLARED.values()) for x in found]),
}


def registered():
    for name, found in CHECKS.items():
        yield name, globals()[name], rows(found)
    for name, found in DECLARED.items():
        yield name, globals()[name], rows(found)
    for name, text in SUMMARIES.items():
        yield name, globals()[name], text
