from __future__ import annotations

import glob
import os
import random
import re
from datetime import datetime, timedelta
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stocklane.operators import blocks, quality, ranges, series, storage
from stocklane.plans import dq, features, models, registry, reports
from stocklane.sources import binding, files, versions
from stocklane.sources.binding import Tables
from stocklane.sources.schemas import SCHEMAS
from stocklane.sources.variants import Damaged

SF = "/root/testdata/sf0.001"
CHEAP = ("a1_executive_kpis", "a3_category_performance", "a5_event_audit", "a6_carrier", "m1_order_facts", "m4_delivery_features", "dq_order_line_recon", "dq_ledger_replay", "derive_order_events")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return c


def cells(table):
    """Sorted rows of an Arrow table as text; numbers of any type compare as doubles, dates stay dates."""

    def cell(v):
        return "" if v is None else repr(float(v)) if isinstance(v, (int, float, Decimal)) else str(v)

    names = sorted(table.column_names)
    return names, sorted(tuple(map(cell, row)) for row in zip(*(table.column(c).to_pylist() for c in names), strict=True))


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_oracle(spark, con, name):
    assert cells(registry.QUERIES[name](spark, SF).toArrow()) == cells(con.sql(registry.ORACLES[name]).to_arrow_table())


def test_registry_is_whole(spark):
    known = __spark_entry__.queries()
    assert set(registry.QUERIES) <= set(known) and set(__spark_entry__.oracle_sql()) <= set(known)
    assert __spark_entry__.entry(spark).count() == 1


def test_checks_can_fail(spark):
    bad = spark.createDataFrame([(1, "a", 5), (1, None, -1), (2, "z", 0)], "k int, w string, v int")
    parent = spark.createDataFrame([(1,)], "k int")
    found = quality.combined([
        quality.not_null(bad, "t", ["w"]), quality.unique(bad, "t", ["k"]), quality.foreign_key(bad, "t", "k", parent), quality.domain(bad, "t", "w", ("a",)),
        quality.violations(bad, "t", {"positive": "v <= 0"}), quality.expected_count(bad, "t", 4), quality.missing(bad, parent, ["k"], "t", "missing"), quality.drift(bad, "t", "w", {"a": 0.9}, 0.1),
    ])
    assert {r.check: r.violations for r in found.collect()} == {"not_null:w": 1, "unique:k": 1, "foreign_key:k": 1, "domain:w": 1, "positive": 2, "expected_count": 1, "missing": 1, "drift:w=a": 1}
    assert not [r for r in found.collect() if r.passed]


def test_predictors_refuse_leaks(spark):
    d = features.DATASETS[1]
    with pytest.raises(ValueError, match="leak"):
        features.predictors(spark.createDataFrame([(1, 2)], "total_units int, future_x int"), d)


def test_spine_and_ids(spark):
    days = spark.createDataFrame([("2025-01-30 05:00:00",), ("2025-02-02 01:00:00",)], "ts string").selectExpr("CAST(ts AS TIMESTAMP_NTZ) AS ts")
    assert series.date_spine(days, "ts").count() == 4 and series.date_spine(days.limit(0), "ts").count() == 0
    numbered = series.chronological_ids(spark.range(100).selectExpr("99 - id AS k"), ["k"]).collect()
    assert all(r.number == r.k + 1 for r in numbered)


MOVES = "warehouse_id int, product_id bigint, movement_id bigint, movement_type string, quantity_change bigint, reorder_point int, event_ts timestamp_ntz"


def folded(rows):
    """Replenishments of moves in order, one after another."""
    state, out = {}, []
    for place, product, move, kind, change, point, at in sorted(rows, key=lambda r: (r[0], r[1], r[6], r[2])):
        hand, held = state.get((place, product), (0, 0))
        size = abs(change)
        if kind == "receipt":
            hand += size
        elif kind == "release":
            held -= size
        else:
            lack = size - (hand - held if kind == "reservation" else hand)
            if lack > 0:
                out.append((place, product, move, max(lack, 2 * point, 50), max(datetime(2025, 8, 1, 0, 0, 1), at - timedelta(seconds=1))))
                hand += out[-1][3]
            hand, held = (hand, held + size) if kind == "reservation" else (hand - size, max(0, held - size))
        state[place, product] = hand, held
    return sorted(out)


def test_replenishment_against_a_fold(spark):
    """Positions short and long, shipments of more than is reserved, a position that lies in many ranges of moves."""
    rng, rows = random.Random(5), []
    for product, n in ((1, 0), (2, 5), (3, 60), (4, 4000)):
        held = 0
        for k in range(n):
            kind = rng.choices(["receipt", "reservation", "release", "shipment"], [1, 6, 2, 4])[0]
            size = rng.randint(1, 30) if kind != "release" else rng.randint(0, held)
            held = max(0, held + {"receipt": 0, "reservation": size, "release": -size, "shipment": -size}[kind])
            rows.append((1, product, 10_000 * product + k, kind, -size if kind in ("reservation", "shipment") else size, 5 * product, datetime(2025, 8, 1) + timedelta(minutes=k // 2)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = features.replenishments(spark.createDataFrame(rows, MOVES).repartition(3))
        assert sorted(map(tuple, got.collect())) == folded(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(folded(rows)) > 50 and features.replenishments(spark.createDataFrame([], MOVES)).count() == 0


def test_all_ten_tables_are_published(spark, con):
    got = registry.QUERIES["publish_all_tables"](spark, SF).toArrow()
    assert set(got.column("table").to_pylist()) == set(SCHEMAS) and all(got.column("passed").to_pylist())
    assert cells(got) == cells(con.sql(registry.ORACLES["publish_all_tables"]).to_arrow_table())


def test_manifest_covers_every_dataset(spark, con):
    rows = registry.QUERIES["build_manifest_all"](spark, SF).collect()
    assert {(r.dataset, r.split) for r in rows} == {(d.name, s) for d in features.DATASETS for s, _ in features.SPLITS}
    for r in rows:
        predictors, columns = set(r.predictors.split(",")), set(r.columns.split(","))
        assert r.row_digest is not None and predictors < columns and "split" in columns - predictors
    assert sum({r.dataset: r.eligible_rows for r in rows}.values()) == sum(r.rows for r in rows)
    got = registry.QUERIES["sink_feature_parquet"](spark, SF).toArrow()
    assert cells(got) == cells(con.sql(registry.ORACLES["sink_feature_parquet"]).to_arrow_table())


def test_build_refuses_bad_rows(spark):
    d = features.DATASETS[1]
    columns = dict.fromkeys((*d.key, d.split_column, *d.targets, *d.excluded))
    places = F.expr("element_at(array('train', 'validation', 'test'), CAST(id + 1 AS INT))")
    row = spark.range(3).select(*[(F.col("id") if c in (*d.key, d.split_column) else F.lit(1)).alias(c) for c in columns], F.lit(1).alias("total_units"), places.alias("split"))
    good = row.drop("id")
    assert features.validated(good, d)["eligible_rows"] == 3
    bad = {
        "no rows": good.limit(0), "missing": good.drop("is_late_delivery"), "duplicate_keys": good.unionByName(good), "bad_targets": good.withColumn("is_late_delivery", F.lit(2)),
        "validation is empty": good.where("split <> 'validation'"), "validation begins": good.withColumn(d.split_column, F.lit(3) - F.col(d.split_column)), "outside_splits": good.withColumn("split", F.nullif("split", F.lit("test"))),
    }
    for said, frame in bad.items():
        with pytest.raises(ValueError, match=said):
            features.validated(frame, d)


def test_digest_is_a_multiset_and_adds_up(spark):
    one = spark.createDataFrame([(1, 0.12345, "a", "s"), (2, None, None, "s")], "k int, x double, w string, split string")
    value = lambda df: features.digest(df).first().row_digest
    assert value(one.unionByName(one)) == 2 * value(one) % features.DIGEST_SIZE != 0
    assert value(one) == sum(value(one.where(f"k = {k}")) for k in (1, 2)) % features.DIGEST_SIZE
    assert value(one) == value(one.orderBy(F.desc("k"))) != value(one.withColumn("w", F.lit("a")))


def broken(df):
    """``df`` whose last row cannot be computed."""
    return df.withColumn("id", F.when(F.col("id") == 2, F.raise_error(F.lit("the writer died")).cast("bigint")).otherwise(F.col("id")))


def test_a_writer_that_dies_leaves_the_old_publication(spark, tmp_path, monkeypatch):
    old = {name: spark.range(5).withColumn("name", F.lit(name)) for name in ("a", "b")}
    versions.publish(old, str(tmp_path))
    kept = lambda: {name: versions.published(spark, str(tmp_path), name).count() for name in ("a", "b")}
    with pytest.raises(Exception, match="the writer died"):
        versions.publish({"a": spark.range(7).withColumn("name", F.lit("a")), "b": broken(old["b"])}, str(tmp_path), replace=True)
    assert kept() == {"a": 5, "b": 5}
    with monkeypatch.context() as m:
        m.setattr(versions, "read_back", lambda spark, path, columns: spark.read.parquet(path).select(columns).where("id < 3"))
        with pytest.raises(ValueError, match="a, b: rows differ"):
            versions.publish(old, str(tmp_path), replace=True)
    assert kept() == {"a": 5, "b": 5}
    versions.publish({name: df.limit(1) for name, df in old.items()}, str(tmp_path), replace=True)
    assert kept() == {"a": 1, "b": 1}
    with pytest.raises(ValueError, match="holds no c"):
        versions.published(spark, str(tmp_path), "c")
    with pytest.raises(ValueError, match="already holds b"):
        versions.publish({"b": old["b"]}, str(tmp_path))


def test_feature_files_switch_as_a_whole(spark, tmp_path):
    d = features.DATASETS[1]
    good = features.split(Tables(spark, SF), d).where("shipment_id % 4 = 0")
    features.written(good, d, str(tmp_path))
    before = versions.published(spark, str(tmp_path), d.name).count()
    bad = good.withColumn("carrier", F.when(F.col("split") == "test", F.raise_error(F.lit("the writer died"))).otherwise(F.col("carrier")))
    with pytest.raises(Exception, match="the writer died"):
        features.written(bad, d, str(tmp_path))
    assert versions.published(spark, str(tmp_path), d.name).count() == before == good.count()


def test_changed_files_are_read_anew(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    use = lambda: storage.once(spark, str(tmp_path), "t", lambda: spark.read.parquet(f"{tmp_path}/t.parquet"), storage.listing(spark, str(tmp_path)))
    assert use().count() == use().count() == 3
    assert use().inputFiles() == use().inputFiles()
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    assert use().count() == 8


ELSEWHERE = ("m3_v7_status_mix_scarce", "m5_v7_band_mix_scarce", "plan_replenishment_scarce", "dq_report_damaged", "m1_v3_integrity_damaged", "a5_event_audit_damaged", "a6_audit_damaged", "fp_validation_counts", "fp_split_conservation", "dq_unique_declared", "dq_rate_drift")


@pytest.mark.parametrize("name", ELSEWHERE)
def test_more_queries_equal_their_oracle(spark, con, name):
    got = cells(registry.QUERIES[name](spark, SF).toArrow())
    assert got == cells(con.sql(registry.ORACLES[name]).to_arrow_table()) and got[1]


def test_every_branch_occurs_on_scarce_stock(spark):
    rows = lambda name: registry.QUERIES[name](spark, SF).collect()
    assert {r.stock_status for r in rows("m3_v7_status_mix_scarce")} == {"STOCKOUT", "CRITICAL", "LOW", "HEALTHY"}
    assert {r.risk_band for r in rows("m5_v7_band_mix_scarce")} == {"STOCKOUT", "CRITICAL", "HIGH", "MEDIUM", "LOW", "WARMUP", "UNKNOWN"}
    mix = rows("m5_v6_target_mix_scarce")[0]
    assert 0 < mix.stockout_positive_rows < mix.reorder_positive_rows < mix.eligible_rows


def test_damage_is_counted(spark):
    """Counts that follow from the damage alone, worked out from the sound tables' keys."""
    sound = Tables(spark, SF)
    keys = lambda name, c: [r[0] for r in sound.named(name).select(c).collect()]
    found = {(r.table, r.check): r.violations for r in registry.QUERIES["dq_report_damaged"](spark, SF).collect()}
    events = [k for k in keys("order_events", "event_id") if k % 73]
    events += [k for k in events if k % 71 == 0]
    assert found["order_events", "source"] == sum(k % 43 == 0 for k in events) > 0
    assert found["order_events", "domain:event_type"] == sum(k % 41 == 0 for k in events) > 0
    moves = keys("inventory_movements", "movement_id")
    assert found["inventory_movements", "quantity_not_zero"] == sum(k % 43 == 0 and k % 41 != 0 for k in moves) > 0
    assert found["inventory_movements", "domain:movement_type"] == sum(k % 47 == 0 for k in moves) > 0
    orders = keys("orders", "order_id")
    assert found["orders", "not_null:customer_id"] == sum(k % 127 == 0 and k % 113 != 0 for k in orders) > 0
    assert found["orders", "promised_after_order"] == sum(k % 101 == 0 for k in orders) > 0
    broken = {check for (_, check), n in found.items() if n}
    assert len(broken) >= 60 and {"line_units:reservation", "order_total", "known_path", "chronological", "never_negative", "one_created_event"} <= broken


def test_report_equals_its_checks_one_by_one(spark):
    """The fused passes against the query of each check, on damaged tables."""
    t = Damaged(spark, SF)
    rows = lambda df: sorted(map(tuple, df.collect()))
    fused = rows(quality.combined([dq.key_rules(t), dq.order_rules(t), dq.shipment_rules(t)]))
    by_row = dq.FUSED[: dq.FUSED.index("dq_unique")]
    assert fused == rows(quality.combined([getattr(dq, name)(t) for name in dq.FUSED if name not in by_row]))
    assert sum(n > 0 for _, _, n, _ in fused) > 25


def test_keys_of_nulls_repeats_and_strangers(spark):
    own = spark.createDataFrame([(1, "a"), (1, "b"), (None, "b"), (None, None)], "k int, w string")
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k bigint")
    found = quality.keys({"own": own, "child": child}, [("own", ["k"]), ("own", ["k", "w"]), ("child", ["k"])], [("child", "k", "own")])
    assert sorted(map(tuple, found.collect())) == [("foreign_key:k", "child", 2, False), ("unique:k", "child", 1, False), ("unique:k", "own", 2, False), ("unique:k,w", "own", 0, True)]
    none = quality.keys({"own": own.limit(0), "child": child.limit(0)}, [("own", ["k"])], [("child", "k", "own")])
    assert sorted(map(tuple, none.collect())) == [("foreign_key:k", "child", 0, True), ("unique:k", "own", 0, True)]


def test_publication_is_all_or_nothing(spark, tmp_path):
    tables = {name: spark.range(n).toDF(name) for name, n in (("a", 3), ("b", 2))}
    spark.range(1).write.parquet(f"{tmp_path}/b")
    with pytest.raises(ValueError, match="already holds b"):
        files.publish(tables, str(tmp_path))
    assert not (tmp_path / "a").exists()
    assert [(r.table, r.expected, r.passed) for r in files.publish(tables, str(tmp_path), replace=True).collect()] == [("a", 3, True), ("b", 2, True)]


def test_feature_files_are_checked_after_the_write(spark):
    d = features.DATASETS[1]
    back = features.written(features.split(Tables(spark, SF), d), d)
    assert back.columns[-1] == "split" and back.count() == features.source(Tables(spark, SF), d).count()
    with pytest.raises(ValueError, match="missing"):
        features.required(spark.range(1), d)


def test_replenishment_refuses_unknown_moves(spark):
    move = lambda kind, point: spark.createDataFrame([(1, 2, 3, kind, -5, point, datetime(2025, 9, 1))], MOVES)
    assert features.replenishments(move("shipment", 40)).first().quantity_change == 80
    for kind, point, said in (("return", 40, "type return"), ("shipment", None, "without inventory"), ("release", 40, "releases more")):
        with pytest.raises(Exception, match=said):
            features.replenishments(move(kind, point)).collect()


def test_raw_tables_are_read_once_for_all_models(spark):
    """Models read the canonical tables that the session has written, not the raw line items again; the report reads these once, to count expected rows."""
    plan = lambda name: registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    for name, reads in (("m3_warehouse_product_daily", 0), ("m5_risk_features", 0), ("a1_executive_kpis", 0), ("dq_report", 1)):
        assert plan(name).count("Relation [l_orderkey") == reads, name


def test_windows_of_blocks_equal_windows_of_the_whole(spark):
    """Lags, rolling sums, windows ahead and running sums of a series of 700 days, and of one that begins late."""
    days = spark.range(700).selectExpr("date_add(DATE'2024-11-20', CAST(id AS INT)) AS day", "id AS i")
    rows = days.selectExpr("1 AS k", "day", "i * 7919 % 101 AS v").unionByName(days.where("i > 300").selectExpr("2 AS k", "day", "i % 13 AS v"))
    changes = rows.where("v % 3 = 0 AND (k = 1 OR v = 6)").withColumn("c", F.col("v") - 40)
    whole = rows.join(changes.select("k", "day", "c"), ["k", "day"], "left").fillna(0, ["c"])

    def measured(df, keys, start):
        w = lambda f, n: f(keys, "day", n)
        return df.withColumns(series.lags(keys, "day", "v", (1, 28)) | {
            "back": F.sum("v").over(w(series.before, 28)), "next": F.max("v").over(w(series.ahead, 7)), "run": start + F.sum("c").over(series.so_far(keys, "day")),
        })

    cut = blocks.with_starts(blocks.with_halo(whole, "day"), changes, ["k"], "day", {"_start": "c"}, days)
    got = blocks.own(measured(cut, ["k", blocks.BLOCK], F.col("_start")).drop("_start"))
    want = measured(whole, ["k"], F.lit(0))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(got.columns).collect()), key=str)
    assert cut.select("k", blocks.BLOCK).distinct().count() >= 9


def test_daily_models_do_not_gather_a_position(spark):
    """No exchange or window of the dense models goes by position alone."""
    for name in ("m2_daily_demand", "m3_warehouse_product_daily", "m5_risk_features"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        windows = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[demand_date", plan)
        assert windows and all("_block" in w for w in windows), name


def test_ranks_and_running_sums_of_one_long_group(spark):
    """A group of 20,000 rows, ties and null keys; the rows of one key stand in several ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(20_000).selectExpr("CASE WHEN id % 100 = 0 THEN NULL WHEN id % 50 = 1 THEN 'b' ELSE 'a' END AS k", "id DIV 2 AS o", "id % 7 - 3 AS v")
        got = ranges.running(rows.withColumn("id", F.monotonically_increasing_id()), ["k"], ["o", "id"], {"total": "v"})
        ranked = ranges.ranks(rows, ["k"], ["o"], "n")
        parts = ranges.placed(rows, ["k", "o"])
        assert parts.where("k = 'a'").select("_part").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    frame = got.toPandas().sort_values(["o", "id"])
    assert (frame.groupby("k", dropna=False).v.cumsum() == frame.total).all() and len(frame) == 20_000
    numbers = ranked.toPandas()
    for _, own in numbers.groupby("k", dropna=False):
        assert sorted(own.n) == list(range(1, len(own) + 1)) and own.sort_values("n").o.is_monotonic_increasing
    assert ranges.running(rows.limit(0), ["k"], ["o"], {"total": "v"}).count() == ranges.ranks(rows.limit(0), [], ["o"]).count() == 0
    dense = ranges.dense_ranks(rows, [F.desc_nulls_last("k")], ["k"], "d").groupBy("k").agg(F.min("d").alias("d"), F.max("d").alias("e")).collect()
    assert {(r.k, r.d, r.e) for r in dense} == {("b", 1, 1), ("a", 2, 2), (None, 3, 3)}


def test_records_of_one_file_are_counted_in_many_tasks(spark, tmp_path):
    """Quoted newlines, doubled quotes, blank lines, quotes open over many byte ranges, a last line without its end."""
    rng = random.Random(2)
    values = ["plain", "two\nlines", 'with ""quotes""\n\n', "x" * 300 + "\n" * 40, "", '""']
    for name, size, last in (("a", 400, "\n"), ("b", 3, ""), ("c", 0, "\n")):
        rows = ["k,text", *(f'{k},"{rng.choice(values)}"' + rng.choice(["", "", "\n"]) for k in range(size))]
        (tmp_path / f"{name}.csv").write_text("\n".join(rows) + last, newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = files.count_records(spark, str(tmp_path), "t")
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        assert got.first().records == 403 and tasks > 20
        plain = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
        assert plain.count() == 403
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_task_by_order_holds_as_many_lines_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(binding, "ROWS", 100)
    t = Tables(spark, SF)
    assert t.pieces >= t.raw("lineitem").count() / 100
    assert models.order_lines(t).rdd.getNumPartitions() == t.pieces


def test_stock_does_not_write_the_event_log(spark):
    t = Tables(spark, f"{SF}/.")  # a name of the folder under which nothing is written yet
    assert t.inventory_movements.where("movement_type = 'release'").count() > 0
    assert not [k for k in storage._WRITTEN if k[1] == f"plain:{SF}/." and k[2] == "order_events"]


def test_orders_of_a_day_are_distinct(spark):
    class Twice(Tables):
        order_items = property(lambda self: Tables(spark, SF).order_items.unionByName(Tables(spark, SF).order_items))

    key = ["demand_date", "warehouse_id", "product_id"]
    found = models.daily_transactions(Twice(spark, SF)).join(models.m2_daily_transactions(Tables(spark, SF)).withColumnsRenamed({"gross_order_count": "n", "gross_units_requested": "u"}).select(*key, "n", "u"), key)
    assert found.count() > 0 and found.where("gross_order_count <> n OR gross_units_requested <> 2 * u").count() == 0


def test_orders_of_a_position_are_distinct(spark):
    class Twice(Tables):
        order_items = property(lambda self: Tables(spark, SF).order_items.unionByName(Tables(spark, SF).order_items))

    pairs = [{(r.warehouse_id, r.product_id): (r.fulfilled_orders, r.fulfilled_units * k) for r in reports.demand_by_position(t).collect()} for t, k in ((Tables(spark, SF), 2), (Twice(spark, SF), 1))]
    assert pairs[0] and pairs[0] == pairs[1]
    assert reports.demand_by_position(Tables(spark, SF))._jdf.queryExecution().executedPlan().toString().count("HashAggregate") == 2


def test_report_adds_up_orders_and_keys_without_sorts_or_texts(spark):
    """texts among the sums made every aggregate of the report's facts a sort, and every number a text to count keys by."""
    t = Tables(spark, SF)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan(dq.order_facts(t))
    frames = {"p": spark.createDataFrame([(1, "x"), (2, "x"), (None, "y"), (None, None)], "id bigint, name string"), "c": spark.createDataFrame([(1, 1), (1, 3), (1, 3), (2, None)], "a int, id int")}
    found = quality.keys(frames, [("p", ["id"]), ("p", ["name"]), ("c", ["a", "id"])], [("c", "id", "p")])
    assert {(r["check"], r["table"]): r["violations"] for r in found.collect()} == {("unique:id", "p"): 1, ("unique:name", "p"): 1, ("unique:a,id", "c"): 1, ("foreign_key:id", "c"): 2}


def test_stages_and_payloads_are_judged_as_before(spark):
    names = ["", "a", "delivered", "delivered ", "post_payment", "post_paymenu", "post_reservation", "pre_payment", "shipped", "z", None]
    rows = spark.createDataFrame([(x,) for x in names], "s string").selectExpr("s", f"{dq.placed_stage('s')} AS k").collect()
    ranked = sorted((r for r in rows if r["s"] is not None), key=lambda r: r["s"])
    assert [r["k"] for r in ranked] == sorted(r["k"] for r in ranked) and [r["k"] for r in rows if r["s"] is None] == [None]
    assert {r["s"]: dq.STAGES[r["k"] // 2] for r in ranked if r["k"] % 2} == {s: s for s in dq.STAGES}
    texts = ['{"order_id":12,"status":"x"}', '{"a":"b"}\n', '{"a":01}', '{"a":"b",}', "[]", "{}", '{"a":{"b":1}}', "", "null", '{"a":"\\"}', '{"a":0}', '{"a":"b"} x', None]
    judged = spark.createDataFrame([(x,) for x in texts], "payload string").selectExpr(f"payload RLIKE r'{dq.FLAT_OBJECT}' AS flat", "json_object_keys(payload) IS NOT NULL AS object").collect()
    assert not [r for r in judged if r["flat"] and not r["object"]] and judged[0]["flat"] and judged[10]["flat"]


def test_joins_of_lines_give_a_task_as_many_rows_at_any_size(spark, monkeypatch, capsys):
    usual = Tables(spark, SF)
    items, positions = usual.order_items, usual._positions
    assert binding.ROWS <= 250_000
    monkeypatch.setattr(binding, "ROWS", 100)
    monkeypatch.setattr(binding, "once", lambda spark, source, name, build, state="": build())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        t = Tables(spark, SF)
        for df, stored in ((t.order_items, items), (t._positions, positions)):
            df.explain()
            dealt = re.findall(r"hashpartitioning\((?:order_id|l_orderkey|o_orderkey|l_partkey)#\d+L?, (\d+)\)", capsys.readouterr().out)
            assert len(dealt) >= 3 and set(dealt) == {str(t.pieces)}
            assert df.count() == stored.count() and not df.exceptAll(stored).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_are_dealt_once_for_delivery_features(spark, capsys):
    t = Tables(spark, SF)
    apart = models.m4_order_item_metrics(t).join(models.m4_order_weight(t), "order_id", "left")
    assert apart.count() and not apart.exceptAll(models.m4_order_lines(t).select(apart.columns)).count()
    models.m4_delivery_features(t).explain()
    assert len(re.findall(r"/order_items-", capsys.readouterr().out)) == 1
