"""Leakage-safe feature datasets: contracts, validation, chronological split, materialisation; and order derivations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stocklane.functions.columns import flag
from stocklane.operators import lifecycle
from stocklane.operators.ranges import accumulate, placed
from stocklane.operators.series import chronological_ids
from stocklane.operators.storage import materialize, new_path, once
from stocklane.plans import models
from stocklane.plans.oracle.binding import n
from stocklane.sources.binding import Tables
from stocklane.sources.versions import publish, published


@dataclass(frozen=True)
class Dataset:
    """A feature contract. ``excluded``: columns that are no predictors although they are in the view."""

    name: str
    model: str
    view: str
    key: tuple[str, ...]
    split_column: str
    targets: tuple[str, ...]
    binary: bool
    eligible: str | None
    excluded: tuple[str, ...]


#: The registered datasets, and the columns that a contract keeps from the predictors besides key, date and targets.
DATASETS = (
    Dataset("demand_forecasting", "m2_daily_demand", "v_m2", ("demand_date", "warehouse_id", "product_id"), "demand_date", ("units_sold",), False, None,
            ("gross_units_requested", "cancelled_units", "revenue")),
    Dataset("delivery_prediction", "m4_delivery_features", "v_m4", ("shipment_id",), "order_date", ("is_delivery_exception", "is_late_delivery"), True, None,
            ("is_delivered", "shipment_status", "delivered_at", "actual_transit_hours", "delivery_delay_hours", "order_id", "customer_id")),
    Dataset("inventory_risk", "m5_risk_features", "v_m5", ("demand_date", "warehouse_id", "product_id"), "demand_date", ("target_stockout_next_7d", "target_reorder_breach_next_7d"), True, "ml_feature_eligible = 1",
            ("target_stockout_days_next_7d", "target_min_available_next_7d", "future_observation_days", "future_min_available_qty_raw", "future_stockout_days_raw", "future_reorder_breach_raw",
             "ending_on_hand_qty", "ending_reserved_qty", "ending_available_qty", "units_sold", "revenue", "ml_feature_eligible")),
)
#: Last day of each split.
SPLITS = (("train", "2026-04-30"), ("validation", "2026-05-31"), ("test", "2026-07-31"))
NUMERIC = ("int", "bigint", "double", "float", "smallint")


def source(t: Tables, d: Dataset) -> DataFrame:
    """The model's whole table, computed and written once a session; a folder with other files gets its own."""
    return once(t.spark, f"{t.variant}:{t.sf_dir}", d.model, lambda: getattr(models, d.model)(t), t.state)


def eligible(t: Tables, d: Dataset) -> DataFrame:
    return source(t, d).where(d.eligible) if d.eligible else source(t, d)


def predictors(df: DataFrame, d: Dataset) -> list[str]:
    """What the contract leaves for predictors, order kept; the split is none, and names of targets or the future are refused."""
    dropped = {*d.excluded, *d.targets, *d.key, d.split_column, "split"}
    kept = [c for c in df.columns if c not in dropped]
    if leaks := [c for c in kept if c.startswith(("target_", "future_"))]:
        raise ValueError(f"{d.name}: {', '.join(leaks)} would leak the target")
    return kept


def numeric(df: DataFrame, d: Dataset) -> list[str]:
    kinds = dict(df.dtypes)
    return [c for c in predictors(df, d) if kinds[c] in NUMERIC]


def each(rows) -> DataFrame:
    out = rows[0]
    for other in rows[1:]:
        out = out.unionByName(other)
    return out


def named(df: DataFrame, d: Dataset) -> DataFrame:
    return df.select(F.lit(d.name).alias("dataset"), "*")


def required(df: DataFrame, d: Dataset) -> DataFrame:
    """``df``, refused without the columns of its contract or without rows."""
    missing = [c for c in dict.fromkeys((*d.key, d.split_column, *d.targets)) if c not in df.columns]
    if missing:
        raise ValueError(f"{d.name}: columns {', '.join(missing)} are missing")
    if not df.limit(1).count():
        raise ValueError(f"{d.name}: no rows")
    return df


def extract_features(t):
    """The delivery view in the order of its contract; the datasets that are built pass the same ``required``."""
    d = DATASETS[1]
    return required(source(t, d), d).orderBy(*dict.fromkeys((d.split_column, *d.key)))


def extraction_summary(t):
    return each([named(source(t, d).agg(F.count(F.lit(1)).alias("rows"), F.min(d.split_column).alias("first_date"), F.max(d.split_column).alias("last_date")), d) for d in DATASETS])


def fp_eligible(t):
    d = DATASETS[2]
    return source(t, d).agg(F.count(F.lit(1)).alias("source_rows"), F.count_if(F.expr(d.eligible)).alias("eligible_rows"), F.count_if(~F.col("ml_feature_eligible").isin(0, 1)).alias("invalid_flags"))


def fp_predictors(t):
    d = DATASETS[2]
    df = eligible(t, d)
    return df.select(predictors(df, d))


def fp_primary_key(t):
    rows = []
    for d in DATASETS:
        null = " OR ".join(f"{k} IS NULL" for k in d.key)
        per = eligible(t, d).groupBy(*d.key).agg(F.count(F.lit(1)).alias("n"))
        rows.append(named(per.agg(F.coalesce(F.sum(F.expr(f"CASE WHEN {null} THEN n END")), F.lit(0)).alias("null_key_rows"), F.coalesce(F.sum(F.expr("CASE WHEN n > 1 THEN n END")), F.lit(0)).alias("duplicate_rows")), d))
    return each(rows)


def fp_chronology(t):
    last = SPLITS[-1][1]
    return each([named(eligible(t, d).agg(F.count_if(F.col(d.split_column).isNull()).alias("null_dates"), F.count_if(F.col(d.split_column) > F.lit(last).cast("date")).alias("late_dates"), F.min(d.split_column).alias("first_date"), F.max(d.split_column).alias("last_date")), d) for d in DATASETS])


def invalid(c: str, d: Dataset):
    """Whether a target has a value that it cannot have."""
    x = F.col(c).cast("double")
    return ~F.col(c).isin(0, 1) if d.binary else (F.col(c) < 0) | F.isnan(x) | (x == float("inf"))


def fp_targets(t):
    """Nulls and invalid values of every target, in one pass over a dataset."""
    rows = []
    for d in DATASETS:
        found = eligible(t, d).agg(*[f for c in d.targets for f in (F.count_if(F.col(c).isNull()).alias(f"nulls_{c}"), F.count_if(invalid(c, d)).alias(f"invalid_{c}"))])
        triples = ", ".join(f"'{c}', nulls_{c}, invalid_{c}" for c in d.targets)
        rows.append(named(found.selectExpr(f"stack({len(d.targets)}, {triples}) AS (target, nulls, invalid)"), d))
    return each(rows)


def fp_finite(t):
    rows = []
    for d in DATASETS:
        df = eligible(t, d)
        bad = [F.count_if(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))) for c in numeric(df, d)]
        rows.append(named(df.agg(sum(bad[1:], bad[0]).alias("non_finite_values")), d))
    return each(rows)


def fp_inventory_eligibility(t):
    return eligible(t, DATASETS[2]).agg(F.count_if(F.col("historical_observation_days_28d") != 28).alias("short_history"), F.count_if(F.col("future_observation_days") != 7).alias("short_future"))


def constants(df: DataFrame, d: Dataset) -> DataFrame:
    """Predictors with one value at most, from a minimum and a maximum each in one pass."""
    names = predictors(df, d)
    one = df.agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in names])
    pairs = ", ".join(f"'{c}', `{c}`" for c in names)
    return named(one.selectExpr(f"stack({len(names)}, {pairs}) AS (predictor, constant)").where("constant").select("predictor"), d)


def fp_constant_predictors(t):
    return each([constants(eligible(t, d), d) for d in DATASETS])


def split_of(column: str):
    """The split of a date; null outside all splits."""
    out = F.lit(None).cast("string")
    for name, last in reversed(SPLITS):
        out = F.when(F.col(column) <= F.lit(last).cast("date"), name).otherwise(out)
    return out


def split(t: Tables, d: Dataset) -> DataFrame:
    return eligible(t, d).withColumn("split", split_of(d.split_column))


def fp_split(t):
    """Every eligible row with its split, sorted within it."""
    d = DATASETS[1]
    return in_order(split(t, d).select(*d.key, d.split_column, *d.targets, "split"), d)


def in_order(df: DataFrame, d: Dataset) -> DataFrame:
    """Rows by split, date and key, each split in many tasks: one of them holds most of a year."""
    order = [*dict.fromkeys(("split", d.split_column, *d.key))]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def parts(df: DataFrame, d: Dataset) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min(d.split_column).alias("first_date"), F.max(d.split_column).alias("last_date"))


def fp_split_integrity(t):
    rows = []
    for d in DATASETS:
        place = F.expr("array_position(array('train', 'validation', 'test'), split)")
        p = parts(split(t, d), d).withColumn("before", F.lag("last_date").over(Window.partitionBy(F.lit(1)).orderBy(place)))  # three rows
        rows.append(named(p.select("split", "rows", (F.col("rows") > 0).alias("non_empty"), F.coalesce(F.col("first_date") > F.col("before"), F.lit(True)).alias("after_previous")), d))
    return each(rows)


def fp_split_summary(t):
    return each([named(parts(split(t, d), d), d) for d in DATASETS])


def artifact_metadata(t):
    """Per split the rows and dates of the demand dataset; ``build_manifest_all`` has columns and digests of all."""
    return parts(split(t, DATASETS[0]), DATASETS[0])


#: A digest counts in this many values.
DIGEST_SIZE = 1 << 60


def shown(name: str, kind: str):
    """A value as text that any engine can write: doubles as whole ten-thousandths, null as ``~``."""
    x = F.floor(F.col(f"`{name}`") * 10000 + 0.5).cast("long") if kind in ("double", "float") else F.col(f"`{name}`")
    return F.coalesce(x.cast("string"), F.lit("~"))


def digest(df: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """Per split a digest of its rows as a multiset: the sum of 60 bits of every row's MD5, columns of ``key`` first, so rows that occur twice
    count twice, and digests of parts add up to that of the whole."""
    kinds = dict(df.dtypes)
    row = F.md5(F.concat_ws("|", *[shown(c, kinds[c]) for c in (*key, *[c for c in df.columns if c not in key])]))
    bits = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)")
    return df.groupBy("split").agg((F.sum(bits) % F.lit(DIGEST_SIZE).cast("decimal(20,0)")).cast("long").alias("row_digest"), F.count(F.lit(1)).alias("rows"))


def written(df: DataFrame, d: Dataset, folder: str | None = None) -> DataFrame:
    """``df`` published by split: staged, verified, then switched. A folder that holds the dataset gets its new version."""
    folder = folder or new_path(df.sparkSession, "features")
    publish({d.name: in_order(df, d)}, folder, replace=True, split="split")
    return published(df.sparkSession, folder, d.name).select(df.columns)


def sink_feature_parquet(t):
    """Whole rows of the delivery dataset; ``sink_feature_parquet_all`` writes every dataset."""
    d = DATASETS[1]
    return parts(written(materialize(split(t, d), "split"), d), d)


def sink_feature_parquet_all(t):
    return each([named(parts(written(materialize(split(t, d), "split"), d), d), d) for d in DATASETS])


def validated(df: DataFrame, d: Dataset) -> dict[str, int]:
    """Counts of an eligible frame with its splits; any violation is an error."""
    required(df, d)
    predictors(df, d)
    null = " OR ".join(f"{k} IS NULL" for k in d.key)
    bad = [F.count_if(F.col(c).isNull() | (~F.col(c).isin(0, 1) if d.binary else (F.col(c) < 0))) for c in d.targets]
    finite = [F.count_if(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))) for c in numeric(df, d)]
    found = df.agg(F.count(F.lit(1)).alias("eligible_rows"), F.count_if(F.expr(null)).alias("null_keys"), F.count_if(F.col("split").isNull()).alias("outside_splits"), sum(bad[1:], bad[0]).alias("bad_targets"), sum(finite[1:], finite[0]).alias("non_finite")).first().asDict()
    found["duplicate_keys"] = found["eligible_rows"] - df.select(*d.key).distinct().count()
    wrong = {k: v for k, v in found.items() if v and k != "eligible_rows"}
    if wrong:
        raise ValueError(f"{d.name}: {wrong}")
    before = None
    held = {r["split"]: r for r in parts(df, d).collect()}  # a row a split
    for name, _ in SPLITS:
        if name not in held:
            raise ValueError(f"{d.name}: split {name} is empty")
        if before is not None and held[name]["first_date"] <= before:
            raise ValueError(f"{d.name}: split {name} begins before the one before it ends")
        before = held[name]["last_date"]
    return found


def fp_validation_result(t):
    rows = []
    for d in DATASETS:
        df = eligible(t, d)
        counted = df.agg(F.count(F.lit(1)).alias("eligible_rows"), F.sum(sum((flag(F.col(c).isNull()) for c in d.targets), F.lit(0))).alias("null_targets"), F.min(d.split_column).alias("first_date"), F.max(d.split_column).alias("last_date"))
        rows.append(named(counted.select(F.lit(len(df.columns)).alias("columns"), F.lit(len(predictors(df, d))).alias("predictors"), "*"), d))
    return each(rows)


def build_manifest(t):
    """A row a dataset and split: counts of the source against those of its splits; ``build_manifest_all`` has the rest."""
    rows = []
    for d in DATASETS:
        total = eligible(t, d).agg(F.count(F.lit(1)).alias("eligible_rows"))
        rows.append(named(parts(split(t, d), d).crossJoin(F.broadcast(total)), d))
    return each(rows)


def built(t: Tables, d: Dataset) -> DataFrame:
    ready = materialize(split(t, d), "eligible")
    counts = validated(ready, d)
    back = parts(written(ready, d), d)
    return named(back.select("*", (F.sum("rows").over(Window.partitionBy(F.lit(1))) == F.lit(counts["eligible_rows"])).alias("conserved")), d)


def fp_build_dataset(t):
    """Extract, validate, split, write, read back: rows by split and whether the whole was kept."""
    return built(t, DATASETS[2])


def fp_build_dataset_all(t):
    return each([built(t, d) for d in DATASETS])


def build_manifest_all(t):
    """A record a dataset and split, through JSON: contract, validation counts, rows, dates, columns and row digest of what readers get. Lists are
    sorted and comma-joined."""
    path = new_path(t.spark, "manifest")
    rows = []
    for d in DATASETS:
        ready = materialize(split(t, d), "eligible")
        counts = validated(ready, d)
        contract = [F.lit(",".join(sorted(x))).alias(k) for k, x in (("key", d.key), ("targets", d.targets), ("predictors", predictors(ready, d)), ("columns", ready.columns))]
        back = written(ready, d)
        stats = parts(back, d).join(digest(back, d.key).drop("rows"), "split")
        rows.append(named(stats.select("*", *contract, F.lit(d.split_column).alias("split_column"), *[F.lit(v).cast("bigint").alias(k) for k, v in counts.items()]), d))
    out = each(rows)
    out.write.json(path)
    return t.spark.read.schema(out.schema).json(path)


def derive_order_totals(t):
    return lifecycle.order_totals(t.orders.select("order_id", "order_status"), t.order_items).select("order_id", "order_status", F.col("total_amount").cast("double").alias("total_amount"))


def derive_order_status(t):
    raw = t.orders.withColumn("order_status", F.when(F.col("order_status") == "cancelled", "cancelled").otherwise("delivered"))
    return lifecycle.order_status(raw.select("order_id", "order_status"), t.shipments)


def derive_order_events(t):
    """The event log numbered in time order."""
    return chronological_ids(t.order_events.select("order_id", "event_type", "event_ts", "payload", "event_id"), ["event_ts", "event_id"], "number")


def derive_compressed_milestones(t):
    return t._timed.where("stage IS NULL").select("order_id", "compressed", "payment_confirmed_ts", "inventory_reserved_ts", "processing_started_ts", "order_packed_ts", "shipment_created_ts")


def derive_inventory_movements(t):
    return chronological_ids(t.inventory_movements.drop("created_at"), ["event_ts", "movement_id"], "number")


#: The least replenishment, and the moment after which one can happen.
LEAST_REPLENISHMENT, FIRST_REPLENISHMENT = 50, "2025-08-01 00:00:01"


POSITION = ["warehouse_id", "product_id"]


def replenishments(moves: DataFrame) -> DataFrame:
    """Receipts just before the moves that stock cannot cover: as much as is short, twice the reorder point or ``LEAST_REPLENISHMENT``.

    Reserved units are a running sum that shipments cannot take below zero: the sum, less its least value so far at a shipment. What a
    move lacks without replenishments (``gap``) follows from running sums too. A move falls short if its gap exceeds all replenishments before
    it, which cover every gap before it; so only moves whose gap exceeds all earlier ones can, and a position's few such moves
    are folded in order. Everything before that runs over ranges of moves, so a position of any length is many tasks. A move of
    another type, of a position without inventory, or a release of more than is reserved is an error.
    """
    kind = F.col("movement_type")
    known = kind.isin("receipt", "release", "reservation", "shipment")
    fault = F.when(F.col("reorder_point").isNull(), F.lit(" is of a position without inventory")).when(~F.coalesce(known, F.lit(False)), F.concat(F.lit(" has the type "), F.coalesce(kind, F.lit("null"))))
    size = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("movement "), F.col("movement_id").cast("string"), fault)).cast("bigint")).otherwise(F.abs(F.col("quantity_change").cast("bigint")))
    m = moves.withColumn("size", size).withColumns({
        "step": F.when(kind == "reservation", F.col("size")).when(kind.isin("release", "shipment"), -F.col("size")).otherwise(0), "change": F.when(kind == "receipt", F.col("size")).when(kind == "shipment", -F.col("size")).otherwise(0),
    })
    m = accumulate(placed(m, [*POSITION, "event_ts", "movement_id"]), POSITION, sums={"reserved": "step", "stock": "change"})
    m = materialize(m.withColumn("below", F.when(kind == "shipment", -F.col("reserved"))), "balances")
    m = accumulate(m, POSITION, before={"lifted": "below"})
    held_before = F.col("reserved") - F.col("step") + F.greatest(F.coalesce("lifted", F.lit(0)), F.lit(0))
    over = F.raise_error(F.concat(F.lit("movement "), F.col("movement_id").cast("string"), F.lit(" releases more than is reserved"))).cast("bigint")
    gap = F.when(kind == "reservation", F.col("size") - (F.col("stock") - held_before)).when(kind == "shipment", F.col("size") - (F.col("stock") - F.col("change"))).when((kind == "release") & (F.col("size") > held_before), over)
    m = accumulate(materialize(m.withColumn("gap", gap), "gaps"), POSITION, before={"most": "gap"})
    short = m.where("gap > greatest(0, coalesce(most, 0))").groupBy(*POSITION).agg(F.array_sort(F.collect_list(F.struct("event_ts", "movement_id", "gap", F.col("reorder_point").cast("bigint").alias("point")))).alias("moves"))
    amount = f"greatest(x.gap - a.added, 2 * x.point, {LEAST_REPLENISHMENT}L)"
    start = "named_struct('added', 0L, 'out', CAST(array() AS array<struct<movement_id: bigint, amount: bigint, event_ts: timestamp_ntz>>))"
    step = f"IF(x.gap > a.added, named_struct('added', a.added + {amount}, 'out', concat(a.out, array(named_struct('movement_id', x.movement_id, 'amount', {amount}, 'event_ts', x.event_ts)))), a)"
    found = short.select(*POSITION, F.explode(F.expr(f"aggregate(moves, {start}, (a, x) -> {step}, a -> a.out)")).alias("r"))
    at = F.greatest(F.expr(f"TIMESTAMP_NTZ'{FIRST_REPLENISHMENT}'"), F.expr("r.event_ts - INTERVAL 1 SECOND"))
    return found.select(*POSITION, F.col("r.movement_id").alias("before_movement_id"), F.col("r.amount").alias("quantity_change"), at.alias("event_ts"))


def plan_replenishment(t):
    """The replenishments that the bound moves need, from the opening receipts on."""
    moves = t.inventory_movements.where("movement_type <> 'receipt' OR event_ts = TIMESTAMP_NTZ'2025-08-01 00:00:00'")
    points = t.inventory.select(*POSITION, "reorder_point")
    return replenishments(moves.join(points, POSITION, "left").select(*POSITION, F.col("movement_id").cast("bigint").alias("movement_id"), "movement_type", "quantity_change", "event_ts", "reorder_point"))


# Every dataset, whole rows.

SHORT = {"demand_forecasting": "demand", "delivery_prediction": "delivery", "inventory_risk": "risk"}


def extracted(t: Tables, d: Dataset) -> DataFrame:
    """The source view in the order of its contract; missing columns or no rows are an error."""
    return required(source(t, d), d).orderBy(*dict.fromkeys((d.split_column, *d.key)))


def whole_split(t: Tables, d: Dataset) -> DataFrame:
    """Every eligible row, all columns and its split, by split and date."""
    return in_order(split(t, d), d)


def contract_frame(t: Tables, d: Dataset) -> DataFrame:
    df = eligible(t, d)
    return df.select(predictors(df, d))


def fp_validation_counts(t):
    """What the validation of each dataset counts; ``validated`` raises on the same counts while a dataset is built.

    Two passes over a written model: one grouping by key from which all row counts follow, one for constant predictors.
    """
    rows = []
    for d in DATASETS:
        df = source(t, d).withColumn("split", split_of(d.split_column))
        fits = F.expr(d.eligible) if d.eligible else F.lit(True)
        bad = [F.count_if(F.coalesce(invalid(c, d), F.lit(False)) & fits) for c in d.targets]
        nulls = [F.count_if(F.col(c).isNull() & fits) for c in d.targets]
        per = df.groupBy(*d.key).agg(F.count(F.lit(1)).alias("k"), F.count_if(fits).alias("n"), sum(nulls[1:], nulls[0]).alias("nulls"), sum(bad[1:], bad[0]).alias("bad"), F.count_if(F.col("split").isNull() & fits).alias("outside"))
        total = lambda x: F.coalesce(F.sum(x), F.lit(0))
        null = " OR ".join(f"{k} IS NULL" for k in d.key)
        counts = per.agg(
            total("n").alias("eligible_rows"), total(F.when(F.expr(null), F.col("n"))).alias("null_key_rows"), total("nulls").alias("null_targets"), total("bad").alias("invalid_targets"),
            total("outside").alias("rows_outside_splits"), total("k").alias("source_rows"), total(F.when(F.col("n") > 1, F.col("n"))).alias("duplicate_key_rows"),
        )
        fixed = constants(eligible(t, d), d).agg(F.count(F.lit(1)).alias("constant_predictors"))
        rows.append(named(counts.crossJoin(F.broadcast(fixed)), d))
    return each(rows)


def fp_split_conservation(t):
    """Whether the splits hold every eligible row once, and only rows of their own dates."""
    ends = dict(SPLITS)
    starts = {"validation": ends["train"], "test": ends["validation"]}
    rows = []
    for d in DATASETS:
        date = F.col(d.split_column)
        out = F.lit(False)
        for name, last in SPLITS:
            wrong = date > F.lit(last).cast("date")
            wrong = wrong | (date <= F.lit(starts[name]).cast("date")) if name in starts else wrong
            out = F.when(F.col("split") == name, wrong).otherwise(out)
        counted = split(t, d).agg(F.count(F.lit(1)).alias("eligible_rows"), F.count("split").alias("split_rows"), F.count_if(out).alias("rows_out_of_bounds"))
        rows.append(named(counted.withColumn("conserved", F.col("eligible_rows") == F.col("split_rows")), d))
    return each(rows)


def artifact_metadata_all(t):
    """Per dataset and split: rows, dates, and how many columns and contract predictors the artifact has."""
    rows = []
    for d in DATASETS:
        df = split(t, d)
        rows.append(named(parts(df, d).withColumns({"columns": F.lit(len(df.columns) - 1), "predictors": F.lit(len(predictors(df.drop("split"), d)))}), d))
    return each(rows)


def count_where_text(d: Dataset) -> str:
    return f" WHERE {d.eligible}" if d.eligible else ""


def union_text(f) -> str:
    return " UNION ALL ".join(f(d) for d in DATASETS)


def cases(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} <= DATE '{last}' THEN '{name}'" for name, last in SPLITS) + " END"


def parts_text(d: Dataset, lead: str = "") -> str:
    return f"SELECT {lead}{cases(d.split_column)} AS split, count(*) AS rows, min({d.split_column}) AS first_date, max({d.split_column}) AS last_date FROM {d.view}{count_where_text(d)} GROUP BY ALL"


def columns_text(d: Dataset, drop: tuple[str, ...] = (), nulls: str = "") -> str:
    """A row for every eligible row and column not dropped: ``predictor``, and the value ``x`` as text."""
    names = "lambda c: c NOT IN (" + ", ".join(f"'{c}'" for c in dict.fromkeys(drop)) + ")" if drop else "*"
    return f"(FROM (SELECT CAST(COLUMNS({names}) AS VARCHAR) FROM {d.view}{count_where_text(d)}) UNPIVOT {nulls} (x FOR predictor IN (COLUMNS(*))))"


def not_predictors(d: Dataset) -> tuple[str, ...]:
    return (*d.excluded, *d.targets, *d.key, d.split_column)


def whole_text(d: Dataset) -> str:
    return f"sum(rows) OVER () = (SELECT count(*) FROM {d.view}{count_where_text(d)})"


def names_text(d: Dataset, drop: tuple[str, ...] = (), more: str = "") -> str:
    """The sorted, comma-joined columns of a view but ``drop``, and one more."""
    extra = f" UNION ALL SELECT '{more}'" if more else ""
    return f"(SELECT string_agg(predictor, ',' ORDER BY predictor) FROM (SELECT DISTINCT predictor FROM {columns_text(d, drop, 'INCLUDE NULLS')}{extra}))"


def digest_text(d: Dataset) -> str:
    """Per split the digest of its rows; a column's type decides how its values are written."""
    value = "CASE WHEN typeof(COLUMNS(*)) IN ('DOUBLE', 'FLOAT') THEN CAST(CAST(floor(TRY_CAST(CAST(COLUMNS(*) AS VARCHAR) AS DOUBLE) * 10000 + 0.5) AS BIGINT) AS VARCHAR) ELSE CAST(COLUMNS(*) AS VARCHAR) END"
    rows = f"SELECT coalesce({value}, '~') FROM (SELECT {', '.join(d.key)}, * EXCLUDE ({', '.join(d.key)}), {cases(d.split_column)} AS split FROM {d.view}{count_where_text(d)})"
    bits = "('0x' || substr(md5(concat_ws('|', *COLUMNS(*))), 1, 15))::BIGINT::HUGEINT"
    return f"SELECT any_value(split) AS split, (sum(bits) % {DIGEST_SIZE})::BIGINT AS row_digest FROM (SELECT split, {bits} AS bits FROM ({rows})) GROUP BY split"


def manifest_text(d: Dataset) -> str:
    constants = {"key": ",".join(sorted(d.key)), "targets": ",".join(sorted(d.targets)), "split_column": d.split_column}
    fixed = ", ".join(f"'{v}' AS {k}" for k, v in constants.items())
    zeros = ", ".join(f"CAST(0 AS BIGINT) AS {k}" for k in ("null_keys", "outside_splits", "bad_targets", "non_finite", "duplicate_keys"))
    return f"""SELECT '{d.name}' AS dataset, p.*, g.row_digest, {fixed}, {names_text(d, not_predictors(d))} AS predictors, {names_text(d, (), 'split')} AS columns,
        (SELECT count(*) FROM {d.view}{count_where_text(d)}) AS eligible_rows, {zeros} FROM ({parts_text(d)}) p JOIN ({digest_text(d)}) g ON p.split = g.split"""


TEXTS = {
    "extract_features": "SELECT * FROM v_m4",
    "extraction_summary": union_text(lambda d: f"SELECT '{d.name}' AS dataset, count(*) AS rows, min({d.split_column}) AS first_date, max({d.split_column}) AS last_date FROM {d.view}"),
    "fp_eligible": f"SELECT count(*) AS source_rows, {n('ml_feature_eligible = 1')} AS eligible_rows, {n('ml_feature_eligible NOT IN (0, 1)')} AS invalid_flags FROM v_m5",
    "fp_predictors": f"SELECT * EXCLUDE ({', '.join(dict.fromkeys((*DATASETS[2].excluded, *DATASETS[2].targets, *DATASETS[2].key)))}) FROM v_m5 WHERE ml_feature_eligible = 1",
    "fp_primary_key": union_text(lambda d: f"SELECT '{d.name}' AS dataset, CAST(coalesce(sum(k) FILTER (WHERE {' OR '.join(f'{x} IS NULL' for x in d.key)}), 0) AS BIGINT) AS null_key_rows, CAST(coalesce(sum(k) FILTER (WHERE k > 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT {', '.join(d.key)}, count(*) AS k FROM {d.view}{count_where_text(d)} GROUP BY ALL)"),
    "fp_chronology": union_text(lambda d: f"SELECT '{d.name}' AS dataset, {n(f'{d.split_column} IS NULL')} AS null_dates, {n(f"{d.split_column} > DATE '2026-07-31'")} AS late_dates, min({d.split_column}) AS first_date, max({d.split_column}) AS last_date FROM {d.view}{count_where_text(d)}"),
    "fp_targets": " UNION ALL ".join(f"SELECT '{d.name}' AS dataset, '{c}' AS target, {n(f'{c} IS NULL')} AS nulls, {n(f'{c} NOT IN (0, 1)' if d.binary else f'{c} < 0')} AS invalid FROM {d.view}{count_where_text(d)}" for d in DATASETS for c in d.targets),
    "fp_inventory_eligibility": f"SELECT {n('historical_observation_days_28d <> 28')} AS short_history, {n('future_observation_days <> 7')} AS short_future FROM v_m5 WHERE ml_feature_eligible = 1",
    "fp_split": f"SELECT shipment_id, order_date, is_delivery_exception, is_late_delivery, {cases('order_date')} AS split FROM v_m4",
    "fp_split_integrity": union_text(lambda d: f"SELECT '{d.name}' AS dataset, split, rows, rows > 0 AS non_empty, coalesce(first_date > lag(last_date) OVER (ORDER BY first_date), true) AS after_previous FROM ({parts_text(d)})"),
    "fp_split_summary": union_text(lambda d: parts_text(d, f"'{d.name}' AS dataset, ")),
    "artifact_metadata": parts_text(DATASETS[0]),
    "sink_feature_parquet": parts_text(DATASETS[1]),
    "build_manifest": union_text(lambda d: f"SELECT '{d.name}' AS dataset, p.*, (SELECT count(*) FROM {d.view}{count_where_text(d)}) AS eligible_rows FROM ({parts_text(d)}) p"),
    "fp_build_dataset": f"SELECT 'inventory_risk' AS dataset, *, {whole_text(DATASETS[2])} AS conserved FROM ({parts_text(DATASETS[2])})",
    "sink_feature_parquet_all": union_text(lambda d: parts_text(d, f"'{d.name}' AS dataset, ")),
    "fp_build_dataset_all": union_text(lambda d: f"SELECT '{d.name}' AS dataset, *, {whole_text(d)} AS conserved FROM ({parts_text(d)})"),
    "build_manifest_all": union_text(lambda d: manifest_text(d)),
    "derive_order_totals": "SELECT order_id, order_status, CAST(total_amount AS DOUBLE) AS total_amount FROM c_orders",
    "derive_order_status": "SELECT order_id, CASE WHEN order_status = 'cancelled' THEN 'cancelled' WHEN order_id IN (SELECT order_id FROM c_shipments WHERE shipment_status = 'exception') THEN 'shipped' ELSE 'delivered' END AS order_status FROM c_orders",
    "derive_order_events": "SELECT order_id, event_type, event_ts, payload, event_id, row_number() OVER (ORDER BY event_ts, event_id) AS number FROM c_events",
    "derive_compressed_milestones": "SELECT order_id, compressed, pay AS payment_confirmed_ts, res AS inventory_reserved_ts, proc AS processing_started_ts, pack AS order_packed_ts, s_created AS shipment_created_ts FROM c_timed WHERE stage IS NULL",
    "derive_inventory_movements": "SELECT * EXCLUDE created_at, row_number() OVER (ORDER BY event_ts, movement_id) AS number FROM c_movements",
    "fp_finite": union_text(lambda d: f"SELECT '{d.name}' AS dataset, {n("lower(x) IN ('inf', '-inf', 'nan', '-nan')")} AS non_finite_values FROM {columns_text(d, not_predictors(d))}"),
    "fp_constant_predictors": union_text(lambda d: f"SELECT '{d.name}' AS dataset, predictor FROM {columns_text(d, not_predictors(d), 'INCLUDE NULLS')} GROUP BY predictor HAVING count(DISTINCT x) <= 1"),
    "fp_validation_result": union_text(lambda d: f"SELECT '{d.name}' AS dataset, CAST((SELECT count(DISTINCT predictor) FROM {columns_text(d, (), 'INCLUDE NULLS')}) AS INTEGER) AS columns, CAST((SELECT count(DISTINCT predictor) FROM {columns_text(d, not_predictors(d), 'INCLUDE NULLS')}) AS INTEGER) AS predictors, count(*) AS eligible_rows, CAST(sum({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in d.targets)}) AS BIGINT) AS null_targets, min({d.split_column}) AS first_date, max({d.split_column}) AS last_date FROM {d.view}{count_where_text(d)}"),
    "plan_replenishment": """SELECT warehouse_id, product_id, movement_id AS before_movement_id, amount AS quantity_change, greatest(TIMESTAMP '2025-08-01 00:00:01', event_ts - INTERVAL 1 SECOND) AS event_ts FROM (
        WITH RECURSIVE moves AS MATERIALIZED (
            SELECT m.warehouse_id, m.product_id, movement_id, event_ts, movement_type AS kind, CAST(abs(quantity_change) AS BIGINT) AS size, CAST(reorder_point AS BIGINT) AS point, row_number() OVER (PARTITION BY m.warehouse_id, m.product_id ORDER BY event_ts, movement_id) AS k
            FROM c_movements m JOIN c_inventory i ON m.warehouse_id = i.warehouse_id AND m.product_id = i.product_id WHERE movement_type <> 'receipt' OR event_ts = TIMESTAMP '2025-08-01'),
        fold AS (
            SELECT warehouse_id, product_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS hand, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS amount, CAST(NULL AS BIGINT) AS movement_id, CAST(NULL AS TIMESTAMP) AS event_ts FROM moves WHERE k = 1
            UNION ALL
            SELECT warehouse_id, product_id, k, hand + added + CASE kind WHEN 'receipt' THEN size WHEN 'release' THEN 0 WHEN 'reservation' THEN 0 ELSE -size END,
                CASE kind WHEN 'receipt' THEN held WHEN 'release' THEN held - size WHEN 'reservation' THEN held + size ELSE greatest(0, held - size) END, added, movement_id, event_ts
            FROM (SELECT m.*, f.hand, f.held, CASE WHEN kind IN ('receipt', 'release') OR size <= hand - CASE kind WHEN 'reservation' THEN held ELSE 0 END THEN 0 ELSE greatest(size - hand + CASE kind WHEN 'reservation' THEN held ELSE 0 END, 2 * point, 50) END AS added
                FROM fold f JOIN moves m ON m.warehouse_id = f.warehouse_id AND m.product_id = f.product_id AND m.k = f.k + 1))
        SELECT * FROM fold WHERE amount > 0)""",
}


def contract_text(d: Dataset) -> str:
    hidden = "', '".join(dict.fromkeys((*d.excluded, *d.targets, *d.key, d.split_column)))
    return f"SELECT COLUMNS(lambda c: c NOT IN ('{hidden}')) FROM {d.view}{count_where_text(d)}"


def width_text(d: Dataset, text: str) -> str:
    return f"CAST((SELECT count(DISTINCT predictor) FROM (FROM (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM ({text}) LIMIT 1) UNPIVOT INCLUDE NULLS (x FOR predictor IN (COLUMNS(*))))) AS INTEGER)"


#: Texts of the queries over every dataset, apart from those above.
WHOLE = {
    "fp_validation_counts": union_text(lambda d: f"SELECT '{d.name}' AS dataset, count(*) AS eligible_rows, {n(' OR '.join(f'{k} IS NULL' for k in d.key))} AS null_key_rows, " + " + ".join(n(f"{c} IS NULL") for c in d.targets) + " AS null_targets, " + " + ".join(n(f"{c} NOT IN (0, 1)" if d.binary else f"{c} < 0") for c in d.targets) + f""" AS invalid_targets,
        {n(f"{d.split_column} > DATE '2026-07-31' OR {d.split_column} IS NULL")} AS rows_outside_splits, (SELECT count(*) FROM {d.view}) AS source_rows, (SELECT CAST(coalesce(sum(k), 0) AS BIGINT) FROM (SELECT count(*) AS k FROM {d.view}{count_where_text(d)} GROUP BY {', '.join(d.key)} HAVING count(*) > 1)) AS duplicate_key_rows,
        (SELECT count(*) FROM (SELECT predictor FROM {columns_text(d, not_predictors(d), 'INCLUDE NULLS')} GROUP BY predictor HAVING count(DISTINCT x) <= 1)) AS constant_predictors FROM {d.view}{count_where_text(d)}"""),
    "fp_split_conservation": union_text(lambda d: f"SELECT '{d.name}' AS dataset, count(*) AS eligible_rows, {n(f"{d.split_column} <= DATE '2026-07-31'")} AS split_rows, CAST(0 AS BIGINT) AS rows_out_of_bounds, count(*) = {n(f"{d.split_column} <= DATE '2026-07-31'")} AS conserved FROM {d.view}{count_where_text(d)}"),
    "artifact_metadata_all": union_text(lambda d: f"SELECT '{d.name}' AS dataset, p.*, {width_text(d, f'SELECT * FROM {d.view}')} AS columns, {width_text(d, contract_text(d))} AS predictors FROM ({parts_text(d)}) p"),
}


def registered():
    for name, text in (TEXTS | WHOLE).items():
        yield name, globals()[name], text
    for d in DATASETS:
        short, rows = SHORT[d.name], f"FROM {d.view}{count_where_text(d)}"
        yield f"extract_{short}_rows", lambda t, d=d: extracted(t, d), f"SELECT * FROM {d.view}"
        yield f"fp_split_{short}_rows", lambda t, d=d: whole_split(t, d), f"SELECT *, {cases(d.split_column)} AS split {rows}"
        yield f"fp_contract_{short}_rows", lambda t, d=d: contract_frame(t, d), contract_text(d)
