"""Every query of the fulfillment engine by name, and its independent DuckDB text."""

from __future__ import annotations

from stocklane.plans import checks, dq, features, models, reports
from stocklane.plans.oracle import variants as texts
from stocklane.plans.oracle.binding import bound
from stocklane.sources import files
from stocklane.sources.binding import Tables
from stocklane.sources.variants import Damaged, Scarce

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


#: Queries that run on the other bindings too, where branches and checks show that stay empty on the plain one.
ON_SCARCE = (
    "m3_v4_state_integrity", "m3_v6_final_day", "m3_v7_status_mix", "m3_v8_preview", "m5_risk_features", "m5_v5_history_integrity", "m5_v6_target_mix", "m5_v7_band_mix", "m5_v8_preview", "a4_warehouse_health",
    "a4_stockout_risk", "plan_replenishment",
)
ON_DAMAGED = ("dq_report", "dq_unique_declared", "dq_warehouse_reference", "dq_order_line_recon", "dq_ledger_replay", "m1_v3_integrity", "m3_v3_unknown_types", "m4_v4_references", "m4_v5_timestamps", "m4_v6_labels", "a5_event_audit", "a6_audit")


def register(name: str, build, oracle: str | None = None) -> None:
    """``build`` takes the canonical tables; ``oracle`` is text over the bound tables and models."""
    QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    if oracle is not None:
        ORACLES[name] = bound(oracle)
    for names, suffix, tables, text in ((ON_SCARCE, "scarce", Scarce, texts.scarce), (ON_DAMAGED, "damaged", Damaged, texts.damaged)):
        if name in names:
            QUERIES[f"{name}_{suffix}"] = lambda spark, sf_dir, tables=tables: build(tables(spark, sf_dir))
            ORACLES[f"{name}_{suffix}"] = text(oracle)


for _name, _view in {
    "m1_item_metrics": "v_m1_items", "m1_shipment_metrics": "v_m1_shipments", "m1_event_metrics": "v_m1_events", "m1_order_facts": "v_m1", "m2_date_spine": "v_m2_spine", "m2_position_spine": "v_m2_positions",
    "m2_daily_transactions": "v_m2_tx", "m2_daily_base": "v_m2_base", "m2_daily_demand": "v_m2", "m3_daily_movements": "v_m3_moves", "m3_daily_ledger": "v_m3_ledger", "m3_inventory_state": "v_m3_state",
    "m3_warehouse_product_daily": "v_m3", "m4_order_item_metrics": "v_m4_items", "m4_order_weight": "v_m4_weight", "m4_delivery_features": "v_m4", "m5_history": "v_m5_history", "m5_engineered": "v_m5_engineered",
    "m5_risk_features": "v_m5",
}.items():
    register(_name, getattr(models, _name), f"SELECT * FROM {_view}")

for _name, _build, _text in checks.registered():
    register(_name, _build, _text)

for _name, _build, _text in [*reports.registered(), *dq.registered(), *features.registered(), *files.registered()]:
    register(_name, _build, _text)
