import json
from datetime import datetime
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from martlake.operators import quality
from martlake.plans import lakehouse, reports, runner
from martlake.sources import store as st
from martlake.sources import synth
from martlake.streaming import ingest as ing

SMALL = synth.Profile("small", 200, 40, 800, 1500)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("landing"))
    rates = synth.DirtRates(0.01, 0.01, 0.01, 0.01, 0.01, 0.05, 0.02)
    return root, [synth.generate_batch(spark, SMALL, b, root, dirt=rates) for b in (0, 1)]


def test_manifests_and_dirt(spark, landed):
    root, (first, second) = landed
    assert synth.read_manifest(spark, root, 0) == first and first["rows"]["web_events"] == 1500
    orders = spark.read.parquet(f"{root}/orders/batch_000")
    assert all(t == "string" for _, t in orders.dtypes)
    n = first["anomalies"]
    assert orders.count() == 800 + n["duplicate_orders"] and n["duplicate_orders"] == 8
    clean = orders.dropDuplicates(["order_id"])
    assert clean.where("customer_id LIKE 'CUS-9%'").count() == n["orphan_customer_id"] == 8
    assert clean.where(F.col("order_date").try_cast("timestamp").isNull()).count() == n["invalid_timestamp"]
    assert clean.where("status <> trim(lower(status))").count() == n["inconsistent_status"] == 40
    assert spark.read.parquet(f"{root}/customers/batch_000").where("email NOT LIKE '%@%'").count() == n["malformed_email"]
    items = spark.read.parquet(f"{root}/order_items/batch_000")
    assert items.where("quantity = '0'").count() == n["non_positive_quantity"] and items.where("unit_price LIKE '-%'").count() == n["negative_price"]


def test_clean_batches_hold_their_invariants(spark):
    b = synth.typed_batch(spark, SMALL, 7, 0)
    o, i = b["orders"], b["order_items"]
    assert o.where("total_amount <> gross_amount - discount_amount").count() == 0
    assert i.where("line_total <> quantity * unit_price - discount_amount").count() == 0
    sums = i.groupBy("order_id").agg(F.sum("line_total").alias("t"))
    assert o.join(sums, "order_id").where("t <> total_amount").count() == 0 and sums.count() == o.count() == 800
    assert b["customers"].select("email").distinct().count() == 200
    assert b["products"].where("cost < price * 0.39 OR cost > price * 0.76").count() == 0
    assert b["returns"].join(i, "order_item_id").where("refund_amount > line_total").count() == 0
    assert b["web_events"].where("event_type = 'page_view' AND product_id IS NOT NULL").count() == 0
    assert b["web_events"].count() == 1500 and b["reviews"].where("rating NOT BETWEEN 1 AND 5").count() == 0
    for e, df in b.items():
        assert df.where(f"{synth.contract(e).key} IS NULL").count() == 0 and df.columns == synth.contract(e).columns


def test_batches_depend_on_nothing_but_their_arguments(spark):
    rows = lambda seed, batch: sorted(map(str, synth.typed_batch(spark, SMALL, seed, batch)["orders"].repartition(3).collect()))
    assert rows(1, 0) == rows(1, 0) != rows(2, 0)
    old = {r.order_id: r for r in synth.typed_batch(spark, SMALL, 1, 0)["orders"].collect()}
    rank = {s: k for k, s in enumerate(synth.CYCLE)}
    later = synth.typed_batch(spark, SMALL, 1, 1)["orders"].collect()
    again = [r for r in later if r.order_id in old]
    assert again and len(later) - len(again) == 16
    for r in again:
        before = old[r.order_id]
        assert rank[r.status] == rank[before.status] + 1 and r.updated_at > before.updated_at and r.total_amount == before.total_amount and r.order_date == before.order_date
    with pytest.raises(ValueError):
        synth.profile("huge")


@pytest.fixture(scope="module")
def lake(spark, landed, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    runs = [lakehouse.pipeline(spark, landed[0], root, "run0", datetime(2026, 9, 2)), lakehouse.pipeline(spark, landed[0], root, "run1", datetime(2026, 9, 3))]
    return st.Store(spark, root), runs, root


def test_the_run(spark, lake, landed, tmp_path_factory):
    store, runs, _ = lake
    assert all(r.passed for r in runs), [r.errors for r in runs]
    assert list(runs[0].status) == ["ingest_bronze", "build_silver", "quality_gate", "build_gold"]
    raw = store.table("bronze", "orders_raw").read()
    assert raw.count() == sum(m["rows"]["orders"] for m in landed[1])  # the second run found nothing new
    assert {r._batch_id for r in raw.select("_batch_id").distinct().collect()} == {"batch_000", "batch_001"}
    silver, aside = store.table("silver", "orders").read(), store.table("silver", "orders_quarantine").read()
    assert silver.count() + aside.count() == raw.select("order_id").distinct().count()
    assert silver.join(aside, "order_id").count() == 0 and aside.where("size(_errors) = 0").count() == 0
    net = store.table("gold", "daily_sales").read().agg(F.sum("net_revenue")).first()[0]
    assert net == silver.where("status IN ('paid', 'shipped', 'delivered')").agg(F.sum("total_amount")).first()[0]
    views = {t: store.table("gold", t).read() for t in store.tables("gold")} | {"orders": silver, "orders_raw": raw, "orders_quarantine": aside, "quality_results": store.table("ops", "quality_results").read(), "web_events": store.table("silver", "web_events").read()}
    for name in reports.REPORTS:
        assert reports.run(spark, name, views).collect() is not None, name
    assert reports.run(spark, "reconciliation", views).first().difference == 0
    funnel = store.table("gold", "marketing_funnel").read().agg(*(F.sum(c) for c in ("page_views", "add_to_carts", "checkouts", "purchases"))).first()
    assert funnel[0] > funnel[1] > funnel[2] > funnel[3]
    history = store.table("silver", "customers").read()
    assert history.where("is_current").count() == 200 and history.count() > 200
    exported, path = reports.dashboard(views), str(tmp_path_factory.mktemp("dash") / "dashboard.json")
    assert {d["name"] for d in exported["datasets"]} >= {"kpis", "funnel", "quality"} and all(d["columns"] for d in exported["datasets"])
    assert reports.is_stale(path, exported) and reports.export(path, exported) and not reports.export(path, exported)
    assert reports.is_stale(path, {**exported, "title": "other"})


def test_churn_of_the_run(spark, lake, monkeypatch):
    store, _, _ = lake
    monkeypatch.setattr(lakehouse.churn, "ALGORITHMS", {"logistic_regression": lakehouse.churn.ALGORITHMS["logistic_regression"]})
    best = lakehouse.score_churn(store, datetime(2026, 9, 3))
    assert best.algorithm == "logistic_regression" and store.table("gold", "customer_churn_predictions").read().count() > 50
    assert store.table("ops", "model_metrics").read().count() == 2
    assert store.table("gold", "customer_churn_predictions").schema()["risk_band"].metadata["comment"]


def test_gold_waits_for_the_gate(spark, landed, tmp_path, monkeypatch):
    real = quality.evaluate
    monkeypatch.setattr(lakehouse.quality, "evaluate", lambda df, rules, refs, before: (real(df, [], refs, before)[0], [quality.Outcome("orders", "order_id", "unique", "fail", 2, 1)]))
    run = lakehouse.pipeline(spark, landed[0], str(tmp_path), "bad", datetime(2026, 9, 2), ["customers", "products"])
    assert run.status == {"ingest_bronze": "done", "build_silver": "done", "quality_gate": "failed", "build_gold": "skipped"} and not run.passed


def test_ingest_rescues_what_the_contract_lacks(spark, tmp_path):
    store = st.Store(spark, str(tmp_path / "s"))
    table, land = store.table("bronze", "returns_raw"), str(tmp_path / "land")
    spark.createDataFrame([("r1", 3, "new")], "return_id string, quantity int, extra string").write.parquet(f"{land}/returns/batch_007")
    assert ing.ingest(spark, land, "returns", table, str(tmp_path / "state"), "run") == 1
    r = table.read().first()
    assert (r.return_id, r.quantity, r.reason, r._rescued_data, r._batch_id, r._pipeline_run_id) == ("r1", "3", None, '{"extra":"new"}', "batch_007", "run")
    assert r._ingestion_timestamp and r._source_file.endswith(".parquet")
    assert ing.ingest(spark, land, "returns", table, str(tmp_path / "state"), "run2") == 1
    spark.createDataFrame([("r2",)], "return_id string").write.parquet(f"{land}/returns/other")
    assert ing.ingest(spark, land, "returns", table, str(tmp_path / "state"), "run3") == 2
    assert {x._batch_id for x in table.read().collect()} == {"batch_007", None}
    assert ing.options("returns", "/x")["checkpointLocation"] == "/x/returns"
    with pytest.raises(ValueError):
        ing.options("nothing", "/x")


def test_lineage_and_plain_append(spark, tmp_path):
    df = spark.createDataFrame([("1", "2")], "order_id string, total string")
    df.write.parquet(str(tmp_path / "in/batch_003"))
    read = ing.add_lineage(spark.read.parquet(str(tmp_path / "in/batch_003")), "run")
    assert read.first()._batch_id == "batch_003" and read.columns[-4:] == ["_ingestion_timestamp", "_source_file", "_batch_id", "_pipeline_run_id"]
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for _ in range(2):
        ing.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_store(spark, tmp_path):
    store = st.Store(spark, str(tmp_path))
    t = store.table("gold", "t")
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, n int, v string")
    assert not t.exists() and store.tables("gold") == []
    with pytest.raises(LookupError):
        t.read()
    assert t.create(frame(("a", 1, "x")).schema) == 0 and t.read().count() == 0 and t.create(t.schema()) == 0
    t.append(frame(("a", 1, "x"), ("b", 2, "y")), batch_id=5)
    assert t.append(frame(("a", 1, "x")), batch_id=5) == 1 and t.read().count() == 2
    t.upsert(frame(("a", 3, "z"), ("b", 1, "old"), ("c", 1, "new")), "k", "n")
    rows = lambda v=None: sorted((r.k, r.n, r.v) for r in t.read(v).collect())
    assert rows() == [("a", 3, "z"), ("b", 2, "y"), ("c", 1, "new")] and len(rows(1)) == 2
    t.delete("k = 'c'")
    t.update("n >= 3", {"v": "upper(v)"})
    t.replace_where(frame(("d", 9, "w")), "n > 2")
    assert rows() == [("b", 2, "y"), ("d", 9, "w")]
    with pytest.raises(Exception, match="doesn't meet"):
        t.replace_where(frame(("d", 1, "w")), "n > 2")
    t.delete_keys(frame(("d", 0, "")), "k")
    t.restore(2)
    assert rows() == [("a", 3, "z"), ("b", 2, "y"), ("c", 1, "new")]
    more = frame(("e", 5, "q")).withColumn("extra", F.lit(1.5))
    with pytest.raises(ValueError):
        t.append(more)
    t.append(more, merge_schema=True)
    assert t.read().where("extra IS NULL").count() == 3 and t.read().columns == ["k", "n", "v", "extra"]
    with pytest.raises(ValueError):
        t.append(frame(("e", 5, "q")).withColumn("n", F.lit("text")))
    t.insert([("f", 1, "i", None)])
    t.comment({"v": "a value"})
    t.optimize("n")
    d = t.detail().first()
    assert (d.num_files, list(d.clustering_columns)) == (1, ["n"]) and d.size_bytes > 0 and t.schema()["v"].metadata["comment"] == "a value"
    ops = [r.operation for r in t.history().collect()]
    assert ops[0] == "OPTIMIZE" and ops[-1] == "CREATE" and len(ops) == t.version() + 1
    assert t.read(2).count() == 3 and store.tables("gold") == ["t"]
    other = store.table("gold", "t")
    with pytest.raises(st.ConflictError):
        other._commit({"folders": [], "schema": json.loads(t.schema().json()), "cluster": None}, "X", t.version() - 1)
    t.drop()
    assert not t.exists()


def test_writes_keep_files_without_affected_rows(spark, tmp_path):
    t = st.Store(spark, str(tmp_path)).table("gold", "n")
    t.overwrite(spark.range(1000).selectExpr("id", "id % 7 AS v", "'x' AS s"), cluster_by="id")
    t.optimize("id", files=5)
    kept = lambda: json.loads(t.history().first().details)["files_kept"]
    total = lambda: t.read().selectExpr("count(*)", "sum(v)").first()
    before = set(t._files(t._entry()))
    t.update("id < 10", {"v": "100"})
    assert kept() == 4 and total()[0] == 1000 and t.read().where("v = 100").count() == 10 and len(before & set(t._files(t._entry()))) == 4
    t.delete("id >= 990")
    assert kept() == 4 and total()[0] == 990
    t.delete("id > 5000")
    assert json.loads(t.history().first().details)["files_rewritten"] == 0 and total()[0] == 990
    t.upsert(spark.range(3, 5).selectExpr("id", "id + 500 AS v", "'y' AS s"), "id", "v")
    assert kept() >= 4 and t.read().where("s = 'y'").count() == 2 and total()[0] == 990
    t.upsert(spark.range(2000, 2002).selectExpr("id", "id AS v", "'z' AS s"), "id", "v")
    assert json.loads(t.history().first().details)["files_rewritten"] == 0 and total()[0] == 992
    t.replace_where(spark.range(4, 5).selectExpr("id", "id AS v", "'w' AS s"), "id BETWEEN 3 AND 4")
    assert t.read().where("id BETWEEN 2 AND 5").count() == 3 and kept() >= 4
    assert t.read(1).count() == 1000 and t.read(1).where("v = 100").count() == 0


def test_z_order_over_columns(spark, tmp_path):
    t = st.Store(spark, str(tmp_path)).table("gold", "z")
    rows = spark.range(4096).selectExpr("id % 64 AS a", "CAST(id DIV 64 AS INT) AS b", "IF(id = 7, NULL, concat('k', lpad(CAST(id % 50 AS STRING), 2, '0'))) AS z", "DATE'2020-01-01' + CAST(id % 9 AS INT) AS d")
    t.overwrite(rows, cluster_by="a")
    t.optimize(["a", "b"], files=16)
    assert list(t.detail().first().clustering_columns) == ["a", "b"] and t.read().columns == ["a", "b", "z", "d"]
    assert t.read().exceptAll(rows).count() == 0 and t.read().count() == 4096
    files = t.read().groupBy(F.input_file_name().alias("f")).agg(*(f(c).alias(f"{n}_{c}") for c in "ab" for n, f in (("lo", F.min), ("hi", F.max))))
    for c in "ab":  # four of 16 tiles hold a range of either column; as bounds are sampled, a file may lie in two
        assert 2 <= files.where(f"lo_{c} <= 3 AND hi_{c} >= 0").count() <= 8
    t.append(rows.limit(3))
    t.optimize(files=4)  # keeps the columns
    assert list(t.detail().first().clustering_columns) == ["a", "b"]
    t.optimize(["z", "d", "b"], files=4)
    assert t.read().count() == 4099 and t.read().where("z IS NULL").count() >= 1
    with pytest.raises(ValueError):
        t.optimize([*"abzdabzd"])
    t.overwrite(rows.select("b"))
    assert list(t.detail().first().clustering_columns) == ["b"]


def test_popularity_is_lognormal(spark):
    d, n = synth.Draws(3), 1000
    drawn = [r.x for r in spark.range(100_000).select(d.popular(n, 1.1, "s", F.col("id")).alias("x")).collect()]
    assert min(drawn) == 0 and max(drawn) == n - 1
    normal = NormalDist()
    for share in (0.01, 0.1, 0.5, 0.9):  # the heaviest part of the weights draws what a lognormal's does
        expected = normal.cdf(normal.inv_cdf(share) + 1.1)
        assert sum(x < n * share for x in drawn) / len(drawn) == pytest.approx(expected, abs=0.01)


def test_chunks_bound_the_landed_files(spark, tmp_path):
    synth.generate_batch(spark, SMALL, 0, str(tmp_path), chunk_orders=100, chunk_events=500)
    for entity, most in (("orders", 100), ("web_events", 500)):
        sizes = [r[1] for r in spark.read.parquet(f"{tmp_path}/{entity}/batch_000").groupBy(F.input_file_name()).count().collect()]
        assert max(sizes) <= most < sum(sizes)
    with pytest.raises(ValueError):
        synth.generate_batch(spark, SMALL, 0, str(tmp_path), chunk_orders=0)


def test_version_diff(spark):
    a, b = (spark.createDataFrame(x, "d string, v int") for x in ([("1", 1), ("2", 2), ("3", 3)], [("1", 1), ("2", 5), ("4", 4)]))
    assert [tuple(r) for r in st.version_diff(a, b, "d", "v").collect()] == [("2", 2, 5, 3)]


def test_runner(spark, capsys):
    text = "-- a; comment\nSELECT 1 AS a;\n\nSELECT 2 AS b -- kept\n;"
    assert len(runner.split_statements(text)) == 2
    assert [df.first()[0] for df in runner.run_sql(spark, text)] == [1, 2] and "a" in capsys.readouterr().out
    with pytest.raises(Exception):
        runner.run_sql(spark, "SELECT nothing_here; SELECT 1")
    seen = []
    tasks = [runner.Task("c", lambda: seen.append("c"), ("b",)), runner.Task("a", lambda: seen.append("a")), runner.Task("b", lambda: 1 / 0, ("a",)), runner.Task("d", lambda: seen.append("d"), ("a",))]
    run = runner.run_tasks(tasks)
    assert run.status == {"a": "done", "b": "failed", "c": "skipped", "d": "done"} and seen == ["a", "d"] and isinstance(run.errors["b"], ZeroDivisionError)
    for bad in ([runner.Task("a", print, ("b",)), runner.Task("b", print, ("a",))], [runner.Task("a", print, ("z",))], [runner.Task("a", print)] * 2):
        with pytest.raises(ValueError):
            runner.in_order(bad)
    assert runner.time_queries(spark, {"q": lambda: spark.range(3)})["q"] > 0


def test_measured_queries(spark, tmp_path):
    t = st.Store(spark, str(tmp_path)).table("ops", "measured")
    paths = {n: str(tmp_path / n) for n in ("many", "few")}
    spark.range(1000).repartition(6).write.parquet(paths["many"])
    spark.range(1000).repartition(1).write.parquet(paths["few"])
    read = lambda n: spark.read.parquet(paths[n])
    for k, n in enumerate(("many", "few")):
        t.append(runner.measure_queries(spark, {"sum": lambda n=n: read(n).agg(F.sum("id")), "joined": lambda n=n: read(n).join(read(n), "id"), "none": lambda: spark.range(3)}, n, datetime(2026, 9, 1 + k)))
    rows = {(r.phase, r.query): r for r in t.read().collect()}
    assert rows["many", "sum"].files_read == 6 and rows["few", "sum"].files_read == 1 and rows["few", "none"].bytes_read == 0
    assert rows["many", "joined"].files_read in (6, 12) and all(r.seconds > 0 for r in rows.values())
    both = {r.query: r for r in runner.compare_phases(t.read(), "many", "few").collect()}
    assert both["sum"].files_read_saved == pytest.approx(5 / 6) and both["none"].files_read_saved is None and both["sum"].bytes_read_saved > 0
