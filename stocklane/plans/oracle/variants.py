"""DuckDB text over the scarce and the damaged tables."""

from __future__ import annotations

import re

from stocklane.plans.oracle.binding import NAMES, PARTS
from stocklane.sources.variants import DAMAGE, SCARCE, SCARCE_RESTOCK


def behind(body: str, parts: dict[str, str]) -> str:
    """``body`` behind those of the ordered ``parts`` and of the views that it uses."""
    from stocklane.plans import dq, reports
    from stocklane.plans.oracle.views import VIEWS

    known, used = parts | VIEWS | reports.MORE | dq.MORE, set()

    def need(text: str) -> None:
        for name in set(re.findall(r"\b[cv]_\w+\b", text)) & known.keys() - used:
            used.add(name)
            need(known[name])

    need(body)
    return "WITH " + ",\n".join(f"{k} AS MATERIALIZED ({known[k]})" for k in known if k in used) + "\n" + body


def scarce(body: str) -> str:
    columns = ", ".join(f"{x} AS {c}" for c, x in SCARCE.items())
    moved = PARTS["c_movements"].replace("5 + product_id % 10", SCARCE_RESTOCK)
    return behind(body, PARTS | {"c_inventory": f"SELECT warehouse_id, product_id, {columns}, TIMESTAMP '2025-08-01' AS updated_at FROM c_positions", "c_movements": moved})


def damaged(body: str) -> str:
    """The sound tables under names of their own, and the damaged ones over them."""
    sound = {f"{k}_sound": re.sub(rf"\b({'|'.join(PARTS)})\b", r"\1_sound", v) for k, v in PARTS.items()}
    parts = {}
    for name, (columns, kept, repeated) in DAMAGE.items():
        own = NAMES[name]
        swap = ", ".join(f"{x} AS {c}" for c, x in columns.items())
        source = f"SELECT * FROM {own}_sound WHERE {kept} UNION ALL SELECT * FROM {own}_sound WHERE ({kept}) AND ({repeated})"
        parts[own] = f"SELECT * REPLACE ({swap}) FROM ({source})"
    return behind(body, sound | parts)
