"""The queries that the entry module registers, with the statement that checks each."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlake.functions import cleaning
from martlake.functions.staging import temporary
from martlake.operators import churn, deltas, history, marts, quality
from martlake.operators.differences import unreconciled_days
from martlake.operators.distinct_counts import DistinctCounts, counted
from martlake.operators.upsert import replace_where, retract, update_where, upsert
from martlake.plans import adapters as a
from martlake.plans import reports
from martlake.plans import oracles
from martlake.plans.oracles import with_views
from martlake.sources import synth
from martlake.sources.contracts import contract, history_schema
from martlake.sources.store import Store, version_diff
from martlake.streaming.ingest import ingest

CUTOFF = date(2001, 2, 1)
#: Output kinds: s text, l long, d double (6 decimals), t day, u time, b boolean; in Spark and in the other engine.
SPARK_CASTS = {"s": lambda c: c.cast("string"), "l": lambda c: c.cast("long"), "d": lambda c: F.round(c.cast("double"), 6) + 0.0, "t": lambda c: F.date_format(c, "yyyy-MM-dd"), "u": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"), "b": lambda c: c.cast("boolean")}
SQL_CASTS = {"s": "CAST({0} AS VARCHAR)", "l": "CAST({0} AS BIGINT)", "d": "round(CAST({0} AS DOUBLE), 6) + 0.0", "t": "strftime({0}, '%Y-%m-%d')", "u": "strftime({0}, '%Y-%m-%d %H:%M:%S')", "b": "CAST({0} AS BOOLEAN)"}


@dataclass(frozen=True)
class Query:
    """A query with its output columns and kinds, and the statement over views that must give the same rows."""

    build: Callable[[SparkSession, str], DataFrame]
    columns: dict[str, str]
    views: tuple[str, ...] = ()
    sql: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(spark, sf_dir).select(*(SPARK_CASTS[k](F.col(f"`{c}`")).alias(c) for c, k in self.columns.items()))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cast = ", ".join(f'{SQL_CASTS[k].format(chr(34) + c + chr(34))} AS "{c}"' for c, k in self.columns.items())
        return with_views(self.views, f"SELECT {cast} FROM ({self.sql})")


def _kinds(text: str) -> dict[str, str]:
    """'a:s b:l' as {a: s, b: l}."""
    return dict(x.split(":") for x in text.split())


# Inputs --------------------------------------------------------------------------------------------------------------


def _raw_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Events as an untyped batch of orders, with texts that aren't times or amounts."""
    e = a.table(spark, sf, "events")
    time = F.when(F.col("event_id") % 7 == 0, "not-a-date").when(F.col("event_id") % 7 == 1, "").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    amount = F.when(F.col("event_id") % 5 == 0, "N/A").otherwise(F.col("value").cast("string"))
    return e.select(F.col("event_id").cast("string").alias("order_id"), time.alias("order_date"), F.concat(F.lit(" "), F.upper("event_type"), F.lit(" ")).alias("status"), amount.alias("total_amount"))


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    rows = cleaning.normalise(cleaning.trim(_raw_orders(spark, sf), ["order_id"]), ["status"])
    return cleaning.combine_errors(cleaning.cast_to_contract(cleaning.with_cast_errors(rows, "orders"), "orders"))


def _dq_orders(spark: SparkSession, sf: str) -> DataFrame:
    o, n = a.orders(spark, sf), F.col("order_id").cast("long")
    spoiled = o.withColumns(
        {
            "customer_id": F.when(n % 50 == 0, F.lit(None)).when(n % 50 == 1, "CUS-404").otherwise(F.col("customer_id")),
            "status": F.when(n % 40 == 3, "unknown").otherwise(F.col("status")),
            "total_amount": F.when(n % 60 == 7, -F.col("total_amount")).otherwise(F.col("total_amount")).cast("decimal(12,2)"),
        }
    )
    return spoiled.unionByName(o.where(n % 500 == 2))


def _dq(spark: SparkSession, sf: str) -> tuple[DataFrame, list[quality.Outcome]]:
    return quality.evaluate(_dq_orders(spark, sf), quality.load_rules()["orders"], {"customers": a.customers(spark, sf)}, {"orders": 20_000})


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return quality.results(spark, _dq(spark, sf)[1], "run", datetime(2026, 1, 1))


def _marts(spark: SparkSession, sf: str) -> dict[str, Callable[[], DataFrame]]:
    return {
        "orders": lambda: a.orders(spark, sf),
        "web_events": lambda: a.web_events(spark, sf),
        "daily_sales": lambda: marts.daily_sales(a.orders(spark, sf)),
        "product_performance": lambda: marts.product_performance(a.order_items(spark, sf), a.orders(spark, sf), a.products(spark, sf), a.returns(spark, sf)),
        "category_performance": lambda: marts.category_performance(a.order_items(spark, sf), a.orders(spark, sf), a.products(spark, sf)),
        "customer_lifetime_value": lambda: marts.customer_lifetime_value(a.orders(spark, sf), a.customers(spark, sf)),
        "customer_segments": lambda: marts.customer_segments(marts.customer_lifetime_value(a.orders(spark, sf), a.customers(spark, sf))),
        "marketing_funnel": lambda: marts.marketing_funnel(a.web_events(spark, sf)),
        "orders_raw": lambda: _dq_orders(spark, sf),
        "orders_quarantine": lambda: cleaning.split_quarantine(cleaning.combine_errors(_dq(spark, sf)[0]))[1],
        "quality_results": lambda: _outcomes(spark, sf),
    }


def _mart(name: str):
    return lambda spark, sf: _marts(spark, sf)[name]()


def _report(name: str):
    def build(spark: SparkSession, sf: str) -> DataFrame:
        made = _marts(spark, sf)
        return reports.run(spark, name, {v: made[v]() for v in reports.REPORTS[name].needs})

    return build


def _store(spark: SparkSession) -> Store:
    return Store(spark, temporary(spark, "store"))


def _versioned(spark: SparkSession, sf: str):
    """Daily sales as a table with an update and a restore: versions 0, 1 and 2."""
    t = _store(spark).table("gold", "daily_sales")
    t.overwrite(marts.daily_sales(a.orders(spark, sf)), cluster_by="date")
    t.update("date >= DATE'2000-01-01'", {"net_revenue": "net_revenue * 1.15"})
    t.restore(0)
    return t


def _upserted(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches of order versions, the second partly late: an upsert twice over."""
    o, n = a.orders(spark, sf).select("order_id", "status", F.col("order_date").alias("updated_at")), F.col("order_id").cast("long")
    first = o.where(n % 4 != 3)
    second = o.where(n % 4 >= 2).withColumns({"status": F.lit("returned"), "updated_at": F.col("updated_at") + F.expr("INTERVAL 1 DAY")}).unionByName(o.where(n % 4 == 1).withColumns({"status": F.lit("late"), "updated_at": F.col("updated_at") - F.expr("INTERVAL 1 DAY")}))
    once = upsert(first, second, "order_id", "updated_at")
    return upsert(once, second, "order_id", "updated_at")


def _scd2_in_batches(spark: SparkSession, sf: str) -> DataFrame:
    log = a.product_log(spark, sf)
    out = history.replay(log.where("updated_at < TIMESTAMP'1995-01-01'"), "product_id", "updated_at")
    for _ in range(2):
        out = history.apply_history(out, log.where("updated_at >= TIMESTAMP'1995-01-01'"), "product_id", "updated_at")
    return out


def _hot_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Events at the price of their product, half of all on one product whose price changes nearly every day."""
    product = lambda n: F.when(n % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("p"), n % 1000)).alias("product_id")
    n = F.col("order_id").cast("long")
    log = a.orders(spark, sf).groupBy(product(n), F.col("order_date").alias("valid_at")).agg(F.min(n).alias("price"))
    moment = F.expr("timestamp'1991-06-01' + make_dt_interval(int(event_id * 37 % 4000))").alias("moment")
    facts = a.table(spark, sf, "events").select("event_id", product(F.col("event_id")), moment)
    priced = history.join_as_of(facts, history.replay(log, "product_id", "valid_at"), "product_id", "moment", method="auto")
    return priced.withColumn("price", F.coalesce("price", F.lit(-1)))


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Stored bitmaps of sessions, added in two batches of which the second comes twice."""
    events, stored = a.web_events(spark, sf), DistinctCounts(_store(spark), "gold", "sessions", ["channel", "event_type"])
    for part in (0, 1, 1):
        stored.add(marts.session_values(events.where(F.col("event_id").cast("long") % 2 == part)))
    return stored.read()


def _weekly_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return counted(_sessions(spark, sf).withColumn("week", F.trunc("date", "week")), ["week"], "sessions")


def _daily_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct customers by month from the days' bitmaps, of which a window was spoiled and rebuilt from its own days."""
    values = lambda orders: marts.revenue_orders(orders).select(F.to_date("order_date").alias("date"), F.col("customer_id").alias("value"))
    o, span = a.orders(spark, sf), (date(1997, 6, 1), date(1997, 8, 31))
    stored = DistinctCounts(_store(spark), "gold", "customers", [])
    stored.add(values(o))
    stored.add(values(o).where(F.col("date").between(*span)).withColumn("value", F.concat("value", F.lit("x"))))
    stored.rebuild(values(marts.day_range(o, *span)), *span)
    days = stored.read().withColumn("month", F.trunc("date", "month"))
    return counted(days, ["month"], "customers")


def _by_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Daily sales kept up to date by a batch of new, moved, late and retracted orders."""
    n = F.col("order_id").cast("long")
    o = a.orders(spark, sf).withColumn("updated_at", F.col("order_date"))
    stored, later = o.where(n % 10 != 9), F.expr("INTERVAL 1 DAY")
    moved = o.where(n % 10 == 1).withColumns({"order_date": F.col("order_date") + later, "updated_at": F.col("updated_at") + later, "total_amount": (F.col("total_amount") + 10).cast("decimal(12,2)")})
    late = o.where(n % 10 == 2).withColumns({"updated_at": F.col("updated_at") - later, "total_amount": F.lit(0).cast("decimal(12,2)")})
    void, new = deltas.replaced(stored, o.where(n % 10 == 9).unionByName(moved).unionByName(late), "order_id", "updated_at", o.where(n % 10 == 3))
    return deltas.apply_to_daily_sales(marts.daily_sales(stored), marts.customer_days(stored), deltas.changes(void, new))


def _unreconciled(spark: SparkSession, sf: str) -> DataFrame:
    o = a.orders(spark, sf)
    return unreconciled_days(update_where(marts.daily_sales(o), "year(date) = 1997 AND day(date) = 13", {"net_revenue": "net_revenue + 5"}), o)


def _window_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """Daily sales of three months, rebuilt and put in place of themselves scaled down."""
    o, span = a.orders(spark, sf), (date(1997, 6, 1), date(1997, 8, 31))
    old = update_where(marts.daily_sales(o), marts.window_condition(*span), {"net_revenue": "net_revenue / 2", "orders": "0"})
    return replace_where(old, marts.daily_sales_window(o, *span), marts.window_condition(*span))


def _ingested(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches of orders through the incremental reader, with a second run that finds nothing new."""
    store = _store(spark)
    o = a.orders(spark, sf)
    landing, table = f"{store.root}/landing", store.table("bronze", "orders_raw")
    for b in (0, 1):
        names = contract("orders").columns
        batch = o.where(F.col("order_id").cast("long") % 2 == b)
        batch.select(*((F.col(c).cast("string") if c in o.columns else F.lit(None).cast("string")).alias(c) for c in names), F.lit("x").alias("surprise")).write.parquet(f"{landing}/orders/batch_{b:03d}")
        for _ in range(2):
            ingest(spark, landing, "orders", table, f"{store.root}/_state", f"run{b}")
    return table.read().groupBy("_batch_id", "_pipeline_run_id", "_rescued_data").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("order_id").alias("orders"))


def _evolved(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that land as text, typed with a column more, and wider with yet another: the first two meet in one micro-batch."""
    store, o = _store(spark), a.orders(spark, sf)
    n = F.col("order_id").cast("long")
    landing, table = f"{store.root}/landing", store.table("bronze", "orders_raw")
    text = o.select(*(F.col(c).cast("string").alias(c) for c in o.columns))
    typed = o.withColumns({"order_id": n, "priority": (n % 5).cast("int")})
    wider = o.withColumns({"total_amount": F.col("total_amount").cast("decimal(18,4)"), "priority": F.concat(F.lit("p"), n % 5), "channel": F.struct(F.lit("web").alias("kind"), (n % 5).alias("place"))})
    for run, batches in enumerate(((text, typed), (wider,))):
        for batch in batches:
            b = (text, typed, wider).index(batch)
            batch.where(n % 3 == b).write.parquet(f"{landing}/orders/batch_{b:03d}")
        for _ in range(2):
            ingest(spark, landing, "orders", table, f"{store.root}/_state", f"run{run}", evolve=True)
    return table.read()


def _training(spark: SparkSession, sf: str) -> DataFrame:
    return churn.training_set(a.orders(spark, sf), a.returns(spark, sf), CUTOFF)


def _baseline_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = churn.evaluate(churn.baseline(_training(spark, sf)))
    return spark.createDataFrame([(m.auc_roc, m.auc_pr, m.n, m.positive_rate)], "auc_roc double, auc_pr double, n long, positive_rate double")


def _gate(spark: SparkSession, sf: str) -> DataFrame:
    try:
        quality.gate(_outcomes(spark, sf))
        verdict = "passed"
    except quality.GateError as e:
        verdict = str(e)
    return spark.createDataFrame([(verdict,)], "verdict string")


def _churn_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = _training(spark, sf)
    return churn.risk_bands(churn.predict(churn.train(rows), rows))


def _appended(spark: SparkSession, sf: str) -> DataFrame:
    """Odd orders, then even ones with a column that the table didn't have."""
    o, t = a.orders(spark, sf).select("order_id", "status", "total_amount"), _store(spark).table("bronze", "orders")
    odd = F.col("order_id").cast("long") % 2 == 1
    t.append(o.where(odd).drop("total_amount"))
    t.append(o.where(~odd), merge_schema=True)
    return t.read()


def _created(spark: SparkSession, sf: str) -> DataFrame:
    """Empty tables by contract, plain and as a history, made twice."""
    store, rows = _store(spark), []
    for entity, schema in (("returns", contract("returns").nullable()), ("products", history_schema("products"))):
        t = store.table("silver", entity)
        for _ in range(2):
            t.create(schema)
        rows.append((entity, t.schema().simpleString(), t.read().count(), t.version()))
    return spark.createDataFrame(rows, "entity string, columns string, rows long, version long")


def _maintained(spark: SparkSession, sf: str) -> DataFrame:
    """Layers, insert, comment, compaction by a column and drop, with what each leaves."""
    store, rows = _store(spark), []
    store.create_layers("gold", "ops")
    t = store.table("ops", "days")
    t.overwrite(marts.daily_sales(a.orders(spark, sf)).select("date", "orders").repartition(5))
    before = t.read().agg(F.sum("orders")).first()[0]
    t.insert([(date(2030, 1, 1), 7)])
    t.comment({"orders": "revenue orders"})
    t.optimize("date", files=1)
    after, d = t.read().agg(F.sum("orders")).first()[0], t.detail().first()
    rows += [("tables", ",".join(store.tables("ops"))), ("inserted", str(after - before)), ("comment", t.schema()["orders"].metadata["comment"]), ("layout", f"{d.num_files} {','.join(d.clustering_columns)}"), ("versions", str(d.version))]
    t.drop()
    rows.append(("dropped", str(not t.exists())))
    return spark.createDataFrame(rows, "step string, outcome string")


def _pruned(change: Callable[[object, DataFrame], int]):
    """Daily sales in files by date, after a write to a few days: the rows, and whether most files were kept."""

    def build(spark: SparkSession, sf: str) -> DataFrame:
        t, days = _store(spark).table("gold", "daily_sales"), marts.daily_sales(a.orders(spark, sf))
        t.overwrite(days, cluster_by="date")
        t.optimize("date", files=8)
        change(t, days)
        kept = json.loads(t.history().first().details)["files_kept"]
        return t.read().withColumn("pruned", F.lit(kept >= 5))

    return build


_SPAN = "date BETWEEN DATE'1997-06-01' AND DATE'1997-06-30'"


def _generated(spark: SparkSession, sf: str) -> DataFrame:
    """A small batch of generated data: what landed and what its manifest says of it."""
    root = f"{_store(spark).root}/landing"
    made = synth.generate_batch(spark, synth.Profile("small", 100, 20, 1000, 5000), 0, root)
    kept = synth.read_manifest(spark, root, 0)
    rows = [(f"rows of {e}", spark.read.parquet(f"{root}/{e}/batch_000").count()) for e in ("customers", "products", "orders", "web_events")]
    rows += [(f"anomalies: {n}", k) for n, k in kept["anomalies"].items() if n in ("duplicate_orders", "orphan_customer_id", "invalid_timestamp", "inconsistent_status")]
    landed = spark.read.parquet(f"{root}/orders/batch_000")
    rows += [("distinct orders", landed.select("order_id").distinct().count()), ("text columns", sum(k == "string" for _, k in landed.dtypes)), ("manifest is whole", int(kept == made and kept["rows"]["orders"] == landed.count()))]
    return spark.createDataFrame(rows, "what string, n long")


def _initialised(spark: SparkSession, sf: str) -> DataFrame:
    return history.initialise(a.customer_log(spark, sf).where("updated_at < TIMESTAMP'1995-01-01'"), "updated_at")


def _affected(spark: SparkSession, sf: str) -> DataFrame:
    """The days that one run's raw orders may change."""
    runs = a.orders(spark, sf).withColumn("_pipeline_run_id", F.concat(F.lit("run"), F.col("order_id").cast("long") % 2))
    return spark.createDataFrame([marts.affected_range(runs.where(F.col("_pipeline_run_id") == "run1"))], "first date, last date")


def _scoped_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = [quality.Rule("orders", "matches", "order_id", "warn", "status = 'shipped'", {"pattern": "^[0-9]*0$"}), quality.Rule("orders", "max_value", "total_amount", "quarantine", "status <> 'shipped'", {"value": 200_000})]
    return quality.results(spark, quality.evaluate(a.orders(spark, sf), rules)[1], "run", datetime(2026, 1, 1))


def _last_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The counts that the next run compares with, of two runs."""
    rows = _outcomes(spark, sf)
    older = rows.withColumns({"checked_at": F.col("checked_at") - F.expr("INTERVAL 1 DAY"), "rows_checked": F.lit(5).cast("long")})
    return spark.createDataFrame(list(quality.baselines(rows.unionByName(older)).items()), "table string, rows long")


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    chosen = churn.Selection("none", None, {}, churn.evaluate(churn.baseline(_training(spark, sf))))
    return churn.metrics_table(spark, chosen, CUTOFF, CUTOFF, datetime(2026, 1, 1))


# The registry --------------------------------------------------------------------------------------------------------

_DAILY = _kinds("date:t orders:l customers:l gross_revenue:d discounts:d net_revenue:d average_order_value:d")
_HISTORY = _kinds("product_id:s product_name:s category:s cost:d valid_from:u valid_to:u is_current:b")
_PRODUCTS_SQL = "SELECT *, valid_to IS NULL AS is_current FROM products_"
_FEATURES = _kinds("customer_id:s recency_days:l frequency:l monetary:d avg_order_value:d tenure_days:l orders_last_30d:l orders_last_90d:l spend_last_90d:d avg_days_between_orders:d return_rate:d")
_ORDER = _kinds("order_id:s customer_id:s order_date:u status:s total_amount:d")
_RAW_SQL = """SELECT order_id, TRY_CAST(order_date AS TIMESTAMP) AS order_date, lower(trim(status)) AS status, TRY_CAST(total_amount AS DECIMAL(12,2)) AS total_amount,
    concat_ws(',', CASE WHEN order_date IS NOT NULL AND TRY_CAST(order_date AS TIMESTAMP) IS NULL THEN 'order_date' END, CASE WHEN TRY_CAST(total_amount AS DECIMAL(12,2)) IS NULL THEN 'total_amount' END) AS errors FROM raw_"""
_DQ_SQL = """SELECT q.*, count(*) OVER (PARTITION BY order_id) > 1 AS twice, c.customer_id IS NULL AND q.customer_id IS NOT NULL AS orphan FROM dq_ q LEFT JOIN (SELECT DISTINCT customer_id FROM customers_) c ON c.customer_id = q.customer_id"""
_RANKED = "(SELECT *, percent_rank() OVER (ORDER BY churn_probability DESC) AS r FROM baseline_)"

QUERIES: dict[str, Query] = {
    # cleaning
    "trim_normalise": Query(lambda s, d: cleaning.normalise(_raw_orders(s, d), ["status"]), _kinds("order_id:s status:s"), ("raw_",), "SELECT order_id, lower(trim(status)) AS status FROM raw_"),
    "safe_cast": Query(lambda s, d: _typed(s, d).withColumn("errors", F.concat_ws(",", "_errors")), _kinds("order_id:s order_date:u status:s total_amount:d errors:s"), ("raw_",), _RAW_SQL),
    "quarantine_valid": Query(lambda s, d: cleaning.split_quarantine(_typed(s, d))[0], _kinds("order_id:s order_date:u status:s total_amount:d"), ("raw_",), f"SELECT * FROM ({_RAW_SQL}) WHERE errors = ''"),
    "quarantine_rejected": Query(lambda s, d: cleaning.split_quarantine(_typed(s, d))[1].withColumn("errors", F.concat_ws(",", "_errors")), _kinds("order_id:s status:s errors:s"), ("raw_",), f"SELECT * FROM ({_RAW_SQL}) WHERE errors <> ''"),
    "revenue_filter": Query(lambda s, d: marts.revenue_orders(a.orders(s, d)), _ORDER, ("sold_",), "SELECT * FROM sold_"),
    "day_range": Query(lambda s, d: marts.day_range(a.orders(s, d), date(1997, 6, 1), date(1997, 8, 31)), _ORDER, ("orders_",), "SELECT * FROM orders_ WHERE CAST(order_date AS DATE) BETWEEN DATE '1997-06-01' AND DATE '1997-08-31'"),
    # dedupe, upsert, retract
    "dedupe_latest": Query(lambda s, d: a.lines(s, d), _kinds("l_orderkey:l l_linenumber:l l_partkey:l l_quantity:d l_extendedprice:d l_shipdate:u"), ("lines_",), "SELECT * FROM lines_"),
    "upsert_latest": Query(_upserted, _kinds("order_id:s status:s updated_at:u"), ("orders_",), "SELECT order_id, CASE WHEN CAST(order_id AS BIGINT) % 4 >= 2 THEN 'returned' ELSE status END AS status, CASE WHEN CAST(order_id AS BIGINT) % 4 >= 2 THEN order_date + INTERVAL 1 DAY ELSE order_date END AS updated_at FROM orders_"),
    "retract_quarantined": Query(lambda s, d: retract(a.orders(s, d), _dq_orders(s, d).where("status = 'unknown'"), "order_id"), _ORDER, ("orders_",), "SELECT * FROM orders_ WHERE CAST(order_id AS BIGINT) % 40 <> 3"),
    "update_where": Query(lambda s, d: update_where(a.orders(s, d), "order_date >= TIMESTAMP'2000-01-01'", {"total_amount": "total_amount * 2"}), _ORDER, ("orders_",), "SELECT * REPLACE (CASE WHEN order_date >= TIMESTAMP '2000-01-01' THEN total_amount * 2 ELSE total_amount END AS total_amount) FROM orders_"),
    # history
    "scd2_replay": Query(lambda s, d: a.products(s, d), _HISTORY, ("products_",), _PRODUCTS_SQL),
    "scd2_incremental": Query(_scd2_in_batches, _HISTORY, ("products_",), _PRODUCTS_SQL),
    "scd2_current": Query(lambda s, d: history.current(a.products(s, d)), _HISTORY, ("products_",), f"SELECT * FROM ({_PRODUCTS_SQL}) WHERE is_current"),
    "scd2_as_of": Query(lambda s, d: history.as_of(a.customers(s, d), datetime(1998, 1, 1)), _kinds("customer_id:s country:s city:s valid_from:u"), ("customers_",), "SELECT * FROM customers_ WHERE valid_from <= TIMESTAMP '1998-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1998-01-01')"),
    "asof_join": Query(lambda s, d: history.join_as_of(a.orders(s, d), a.customers(s, d), "customer_id", "order_date"), {**_ORDER, "country": "s"}, ("orders_", "customers_"), "SELECT o.*, c.country FROM orders_ o ASOF LEFT JOIN customers_ c ON o.customer_id = c.customer_id AND o.order_date >= c.valid_from"),
    # quality
    "dq_outcomes": Query(_outcomes, _kinds("column:s rule:s severity:s rows_checked:l rows_failed:l pass_rate:d passed:b"), ("dq_", "customers_"), f"""
        SELECT "column", rule, severity, n AS rows_checked, f AS rows_failed, round(100.0 * (n - f) / n, 4) AS pass_rate, f = 0 AS passed FROM (SELECT count(*) AS n FROM dq_) CROSS JOIN (
            SELECT '' AS "column", 'row_count_delta' AS rule, 'warn' AS severity, (SELECT CASE WHEN abs(100.0 * (count(*) - 20000) / 20000) > 30 THEN count(*) ELSE 0 END FROM dq_) AS f
            UNION ALL SELECT 'order_id', 'not_null', 'fail', count(*) FILTER (WHERE order_id IS NULL) FROM dq_
            UNION ALL SELECT 'order_id', 'unique', 'fail', count(*) FILTER (WHERE twice) FROM ({_DQ_SQL})
            UNION ALL SELECT 'customer_id', 'not_null', 'quarantine', count(*) FILTER (WHERE customer_id IS NULL) FROM dq_
            UNION ALL SELECT 'customer_id', 'foreign_key', 'quarantine', count(*) FILTER (WHERE orphan) FROM ({_DQ_SQL})
            UNION ALL SELECT 'order_date', 'not_null', 'quarantine', count(*) FILTER (WHERE order_date IS NULL) FROM dq_
            UNION ALL SELECT 'status', 'in_set', 'quarantine', count(*) FILTER (WHERE status NOT IN ('pending', 'paid', 'shipped', 'delivered', 'cancelled', 'returned')) FROM dq_
            UNION ALL SELECT 'total_amount', 'min_value', 'quarantine', count(*) FILTER (WHERE total_amount < 0) FROM dq_
            UNION ALL SELECT 'gross_amount', 'min_value', 'quarantine', count(*) FILTER (WHERE gross_amount < 0) FROM dq_
            UNION ALL SELECT 'discount_amount', 'min_value', 'quarantine', count(*) FILTER (WHERE discount_amount < 0) FROM dq_)"""),
    "dq_errors": Query(lambda s, d: _dq(s, d)[0].withColumn("errors", F.concat_ws(",", "_rule_errors")), {**_ORDER, "errors": "s"}, ("dq_", "customers_"), f"""
        SELECT *, concat_ws(',', CASE WHEN order_id IS NULL THEN 'order_id:not_null' END, CASE WHEN twice THEN 'order_id:unique' END, CASE WHEN customer_id IS NULL THEN 'customer_id:not_null' END,
            CASE WHEN orphan THEN 'customer_id:foreign_key' END, CASE WHEN order_date IS NULL THEN 'order_date:not_null' END,
            CASE WHEN status NOT IN ('pending', 'paid', 'shipped', 'delivered', 'cancelled', 'returned') THEN 'status:in_set' END, CASE WHEN total_amount < 0 THEN 'total_amount:min_value' END) AS errors FROM ({_DQ_SQL})"""),
    "dq_gate": Query(_gate, _kinds("verdict:s"), ("dq_",), "SELECT CASE WHEN count(*) > count(DISTINCT order_id) THEN 'blocked by orders.order_id:unique' ELSE 'passed' END AS verdict FROM dq_"),
    "dq_matches_where": Query(_scoped_rules, _kinds("column:s rule:s severity:s rows_checked:l rows_failed:l passed:b"), ("orders_",), """
        SELECT 'order_id' AS "column", 'matches' AS rule, 'warn' AS severity, count(*) AS rows_checked, count(*) FILTER (WHERE order_id NOT LIKE '%0') AS rows_failed, count(*) FILTER (WHERE order_id NOT LIKE '%0') = 0 AS passed FROM orders_ WHERE status = 'shipped'
        UNION ALL SELECT 'total_amount', 'max_value', 'quarantine', count(*), count(*) FILTER (WHERE total_amount > 200000), count(*) FILTER (WHERE total_amount > 200000) = 0 FROM orders_ WHERE status <> 'shipped'"""),
    "dq_baselines": Query(_last_counts, _kinds("table:s rows:l"), ("dq_",), """SELECT 'orders' AS "table", count(*) AS rows FROM dq_"""),
    # marts
    "daily_sales": Query(_mart("daily_sales"), _DAILY, ("daily_sales",), "SELECT * FROM daily_sales"),
    "daily_sales_window": Query(_window_rebuilt, _DAILY, ("daily_sales",), "SELECT * FROM daily_sales"),
    "product_performance": Query(_mart("product_performance"), _kinds("product_id:s product_name:s category:s units_sold:l revenue:d cost:d orders:l returned_units:l refunded_amount:d profit:d return_rate:d"), ("product_performance",), "SELECT * FROM product_performance"),
    "category_performance": Query(_mart("category_performance"), _kinds("category:s month:t orders:l units_sold:l revenue:d cost:d profit:d"), ("category_performance",), "SELECT * FROM category_performance"),
    "customer_lifetime_value": Query(_mart("customer_lifetime_value"), _kinds("customer_id:s orders:l total_spend:d first_order:t last_order:t country:s average_order_value:d active_days:l lifetime_value:d"), ("customer_lifetime_value",), "SELECT * FROM customer_lifetime_value"),
    "customer_segments": Query(_mart("customer_segments"), _kinds("customer_id:s orders:l total_spend:d recency_days:l r_score:l f_score:l m_score:l segment:s"), ("customer_segments",), "SELECT * FROM customer_segments"),
    "marketing_funnel": Query(_mart("marketing_funnel"), _kinds("date:t channel:s sessions:l page_views:l add_to_carts:l checkouts:l purchases:l cart_rate:d checkout_rate:d payment_rate:d conversion_rate:d"), ("marketing_funnel",), "SELECT * FROM marketing_funnel"),
    "funnel_from_bitmaps": Query(lambda s, d: marts.funnel_from_bitmaps(_sessions(s, d)), _kinds("date:t channel:s sessions:l page_views:l add_to_carts:l checkouts:l purchases:l cart_rate:d checkout_rate:d payment_rate:d conversion_rate:d"), ("marketing_funnel",), "SELECT * FROM marketing_funnel"),
    "weekly_sessions": Query(_weekly_sessions, _kinds("week:t sessions:l"), ("events_",), "SELECT CAST(date_trunc('week', event_timestamp) AS DATE) AS week, count(DISTINCT session_id) AS sessions FROM events_ WHERE event_timestamp IS NOT NULL GROUP BY 1"),
    "event_sessions_from_bitmaps": Query(lambda s, d: counted(_sessions(s, d), ["event_type"], "sessions"), _kinds("event_type:s sessions:l"), ("events_",), "SELECT event_type, count(DISTINCT session_id) AS sessions FROM events_ WHERE event_timestamp IS NOT NULL GROUP BY 1"),
    "monthly_customers": Query(_daily_customers, _kinds("month:t customers:l"), ("sold_",), "SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, count(DISTINCT customer_id) AS customers FROM sold_ GROUP BY 1"),
    "daily_sales_by_deltas": Query(_by_deltas, _DAILY, ("orders_",), """
        SELECT CAST(order_date AS DATE) AS date, count(*) AS orders, count(DISTINCT customer_id) AS customers, sum(gross_amount) AS gross_revenue, sum(discount_amount) AS discounts, sum(total_amount) AS net_revenue,
            (CAST(sum(total_amount) * 100 AS BIGINT) * 2 + count(*)) // (2 * count(*)) / 100.0 AS average_order_value
        FROM (SELECT customer_id, gross_amount, discount_amount, CASE WHEN n % 10 = 1 THEN order_date + INTERVAL 1 DAY ELSE order_date END AS order_date, total_amount + CASE WHEN n % 10 = 1 THEN 10 ELSE 0 END AS total_amount
              FROM (SELECT *, CAST(order_id AS BIGINT) AS n FROM orders_) WHERE n % 10 <> 3 AND status IN ('paid', 'shipped', 'delivered') AND order_date IS NOT NULL) GROUP BY 1"""),
    "unreconciled_days": Query(_unreconciled, _kinds("date:t gold:d silver:d difference:d"), ("daily_sales",), "SELECT date, net_revenue + 5 AS gold, net_revenue AS silver, 5 AS difference FROM daily_sales WHERE strftime(date, '%Y-%d') = '1997-13'"),
    # joins
    "asof_join_hot_key": Query(_hot_as_of, _kinds("event_id:l product_id:s moment:u price:l"), ("orders_",), """
        SELECT e.*, coalesce(v.price, -1) AS price FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'hot' ELSE 'p' || (event_id % 1000) END AS product_id, TIMESTAMP '1991-06-01' + to_days(CAST(event_id * 37 % 4000 AS INTEGER)) AS moment FROM events) e
        ASOF LEFT JOIN (SELECT CASE WHEN CAST(order_id AS BIGINT) % 2 = 0 THEN 'hot' ELSE 'p' || (CAST(order_id AS BIGINT) % 1000) END AS product_id, order_date, min(CAST(order_id AS BIGINT)) AS price FROM orders_ GROUP BY ALL) v
        ON e.product_id = v.product_id AND e.moment >= v.order_date"""),
    "returns_by_product": Query(lambda s, d: a.returns(s, d).groupBy("product_id").agg(F.sum("quantity").alias("returned_units"), F.sum("refund_amount").alias("refunded_amount")), _kinds("product_id:s returned_units:l refunded_amount:d"), ("returns_",), "SELECT product_id, sum(quantity) AS returned_units, sum(refund_amount) AS refunded_amount FROM returns_ GROUP BY 1"),
    "churn_label": Query(lambda s, d: churn.labels(a.orders(s, d), CUTOFF), _kinds("customer_id:s churned:l"), ("label_",), "SELECT * FROM label_"),
    # store
    "time_travel_read": Query(lambda s, d: _versioned(s, d).read(1), _kinds("date:t orders:l net_revenue:d"), ("daily_sales",), "SELECT date, orders, CASE WHEN date >= DATE '2000-01-01' THEN CAST(net_revenue * 1.15 AS DECIMAL(22,2)) ELSE net_revenue END AS net_revenue FROM daily_sales"),
    "restore": Query(lambda s, d: _versioned(s, d).read(), _DAILY, ("daily_sales",), "SELECT * FROM daily_sales"),
    "version_diff": Query(lambda s, d: (lambda t: version_diff(t.read(0), t.read(1), "date", "net_revenue"))(_versioned(s, d)), _kinds("date:t before:d after:d"), ("daily_sales",), "SELECT date, net_revenue AS before, CAST(net_revenue * 1.15 AS DECIMAL(22,2)) AS after FROM daily_sales WHERE date >= DATE '2000-01-01' AND net_revenue <> 0"),
    "table_history": Query(lambda s, d: _versioned(s, d).history(), _kinds("version:l operation:s"), (), "SELECT * FROM (VALUES (0, 'OVERWRITE'), (1, 'UPDATE'), (2, 'RESTORE')) t(version, operation)"),
    "table_detail": Query(lambda s, d: (lambda t: (t.optimize(files=1), t.detail())[1])(_versioned(s, d)).withColumn("clustering", F.concat_ws(",", "clustering_columns")), _kinds("version:l num_files:l clustering:s"), (), "SELECT 3 AS version, 1 AS num_files, 'date' AS clustering"),
    "append_new_columns": Query(_appended, _kinds("order_id:s status:s total_amount:d"), ("orders_",), "SELECT order_id, status, CASE WHEN CAST(order_id AS BIGINT) % 2 = 0 THEN total_amount END AS total_amount FROM orders_"),
    "create_from_contract": Query(_created, _kinds("entity:s columns:s rows:l version:l"), (), """SELECT * FROM (VALUES
        ('returns', 'struct<return_id:string,order_id:string,order_item_id:string,product_id:string,quantity:int,reason:string,refund_amount:decimal(12,2),return_date:timestamp>', 0, 0),
        ('products', 'struct<product_id:string,product_name:string,category:string,subcategory:string,brand:string,price:decimal(10,2),cost:decimal(10,2),is_active:boolean,valid_from:timestamp,valid_to:timestamp,is_current:boolean>', 0, 0)) t(entity, columns, rows, version)"""),
    "store_maintenance": Query(_maintained, _kinds("step:s outcome:s"), (), "SELECT * FROM (VALUES ('tables', 'days'), ('inserted', '7'), ('comment', 'revenue orders'), ('layout', '1 date'), ('versions', '3'), ('dropped', 'True')) t(step, outcome)"),
    "store_replace_where": Query(_pruned(lambda t, days: t.replace_where(days.where(_SPAN).withColumn("orders", F.lit(1).cast("long")), _SPAN)), _kinds("date:t orders:l net_revenue:d pruned:b"), ("daily_sales",), "SELECT date, CASE WHEN date BETWEEN DATE '1997-06-01' AND DATE '1997-06-30' THEN 1 ELSE orders END AS orders, net_revenue, true AS pruned FROM daily_sales"),
    "store_upsert": Query(_pruned(lambda t, days: t.upsert(days.where(_SPAN).withColumn("orders", F.col("orders") + 1000).unionByName(days.where("date = DATE'1997-07-01'").withColumn("date", F.lit(date(2040, 1, 1)))), "date", "orders")), _kinds("date:t orders:l net_revenue:d pruned:b"), ("daily_sales",), """
        SELECT date, orders + CASE WHEN date BETWEEN DATE '1997-06-01' AND DATE '1997-06-30' THEN 1000 ELSE 0 END AS orders, net_revenue, true AS pruned FROM daily_sales
        UNION ALL SELECT DATE '2040-01-01', orders, net_revenue, true FROM daily_sales WHERE date = DATE '1997-07-01'"""),
    "store_delete": Query(_pruned(lambda t, days: t.delete(_SPAN)), _kinds("date:t orders:l net_revenue:d pruned:b"), ("daily_sales",), "SELECT *, true AS pruned FROM daily_sales WHERE strftime(date, '%Y-%m') <> '1997-06'"),
    "store_delete_keys": Query(_pruned(lambda t, days: t.delete_keys(days.where(_SPAN), "date")), _kinds("date:t orders:l net_revenue:d pruned:b"), ("daily_sales",), "SELECT *, true AS pruned FROM daily_sales WHERE strftime(date, '%Y-%m') <> '1997-06'"),
    "store_update": Query(_pruned(lambda t, days: t.update(_SPAN, {"orders": "orders * 2"})), _kinds("date:t orders:l net_revenue:d pruned:b"), ("daily_sales",), "SELECT date, CASE WHEN strftime(date, '%Y-%m') = '1997-06' THEN 2 ELSE 1 END * orders AS orders, net_revenue, true AS pruned FROM daily_sales"),
    "contract_projection": Query(lambda s, d: cleaning.to_contract(a.returns(s, d).withColumns({"reason": F.lit("none"), "_source_file": F.lit("x")}), "returns"), _kinds("return_id:s order_id:s order_item_id:s product_id:s quantity:l reason:s refund_amount:d"), ("returns_",), "SELECT *, order_item_id AS return_id, 'none' AS reason FROM returns_"),
    "scd2_initialise": Query(_initialised, _kinds("customer_id:s country:s city:s valid_from:u valid_to:u is_current:b"), ("customer_log_",), "SELECT *, updated_at AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, true AS is_current FROM customer_log_ WHERE updated_at = TIMESTAMP '1990-01-01'"),
    "affected_range": Query(_affected, _kinds("first:t last:t"), ("orders_",), "SELECT CAST(min(order_date) AS DATE) - 7 AS first, CAST(max(order_date) AS DATE) AS last FROM orders_ WHERE CAST(order_id AS BIGINT) % 2 = 1"),
    # generator
    "generator_batch": Query(_generated, _kinds("what:s n:l"), (), """SELECT * FROM (VALUES ('rows of customers', 100), ('rows of products', 20), ('rows of orders', 1003), ('rows of web_events', 5000), ('distinct orders', 1000), ('text columns', 11), ('manifest is whole', 1),
        ('anomalies: duplicate_orders', 3), ('anomalies: orphan_customer_id', 1), ('anomalies: invalid_timestamp', 1), ('anomalies: inconsistent_status', 20)) t(what, n)"""),
    # streaming
    "bronze_ingest": Query(_ingested, {"_batch_id": "s", "_pipeline_run_id": "s", "_rescued_data": "s", "rows": "l", "orders": "l"}, ("orders_",), """
        SELECT 'batch_00' || (CAST(order_id AS BIGINT) % 2) AS _batch_id, 'run' || (CAST(order_id AS BIGINT) % 2) AS _pipeline_run_id, '{"surprise":"x"}' AS _rescued_data, count(*) AS rows, count(DISTINCT order_id) AS orders FROM orders_ GROUP BY 1, 2"""),
    "bronze_evolving": Query(_evolved, {**_ORDER, "priority": "s", "channel": "s", "_batch_id": "s", "_pipeline_run_id": "s", "_rescued_data": "s"}, ("orders_",), """
        SELECT *, CASE n % 3 WHEN 1 THEN CAST(n % 5 AS VARCHAR) WHEN 2 THEN 'p' || (n % 5) END AS priority, CASE WHEN n % 3 = 2 THEN '{"kind":"web","place":' || (n % 5) || '}' END AS channel,
            'batch_00' || (n % 3) AS _batch_id, 'run' || CASE WHEN n % 3 = 2 THEN 1 ELSE 0 END AS _pipeline_run_id, NULL AS _rescued_data FROM (SELECT *, CAST(order_id AS BIGINT) AS n FROM orders_)"""),
    # churn
    "churn_features": Query(lambda s, d: churn.features(a.orders(s, d), a.returns(s, d), CUTOFF), _FEATURES, ("features_",), "SELECT * FROM features_"),
    "churn_training_set": Query(_training, {**_FEATURES, "churned": "l"}, ("features_", "label_"), "SELECT * FROM features_ JOIN label_ USING (customer_id)"),
    "recency_baseline": Query(lambda s, d: churn.baseline(_training(s, d)), _kinds("customer_id:s churn_probability:d"), ("baseline_",), "SELECT * FROM baseline_"),
    "auc_ap_of_baseline": Query(_baseline_metrics, _kinds("auc_roc:d auc_pr:d n:l positive_rate:d"), ("baseline_",), """
        SELECT sum((n - p) * (hits - p / 2.0)) / (max(tp) * (max(tn) - max(tp))) AS auc_roc, sum(p * hits / CAST(seen AS DOUBLE)) / max(tp) AS auc_pr, max(tn) AS n, max(tp) / CAST(max(tn) AS DOUBLE) AS positive_rate
        FROM (SELECT s, CAST(n AS DOUBLE) AS n, CAST(p AS DOUBLE) AS p, CAST(sum(n) OVER (ORDER BY s DESC) AS DOUBLE) AS seen, CAST(sum(p) OVER (ORDER BY s DESC) AS DOUBLE) AS hits, CAST(sum(n) OVER () AS DOUBLE) AS tn, CAST(sum(p) OVER () AS DOUBLE) AS tp
              FROM (SELECT churn_probability AS s, count(*) AS n, sum(churned) AS p FROM baseline_ GROUP BY 1))"""),
    "risk_bands": Query(lambda s, d: churn.risk_bands(churn.baseline(_training(s, d))), _kinds("customer_id:s risk_band:s"), ("baseline_",), f"SELECT customer_id, CASE WHEN r < 0.10 THEN 'alto' WHEN r < 0.30 THEN 'medio' ELSE 'bajo' END AS risk_band FROM {_RANKED}"),
    "risk_band_summary": Query(lambda s, d: churn.risk_bands(churn.baseline(_training(s, d))).groupBy("risk_band").agg(F.count(F.lit(1)).alias("customers"), F.avg("churn_probability").alias("average_probability"), F.sum("monetary").alias("monetary")), _kinds("risk_band:s customers:l average_probability:d monetary:d"), ("baseline_",), f"SELECT CASE WHEN r < 0.10 THEN 'alto' WHEN r < 0.30 THEN 'medio' ELSE 'bajo' END AS risk_band, count(*) AS customers, avg(churn_probability) AS average_probability, sum(monetary) AS monetary FROM {_RANKED} GROUP BY 1"),
    "predictions_mart": Query(lambda s, d: churn.predictions_mart(churn.baseline(_training(s, d)), "recency", datetime(2026, 1, 1)), _kinds("customer_id:s risk_band:s model:s scored_at:u"), ("baseline_",), f"SELECT customer_id, CASE WHEN r < 0.10 THEN 'alto' WHEN r < 0.30 THEN 'medio' ELSE 'bajo' END AS risk_band, 'recency' AS model, TIMESTAMP '2026-01-01' AS scored_at FROM {_RANKED}"),
    "churn_cutoffs": Query(lambda s, d: s.createDataFrame([churn.cutoffs(a.orders(s, d))], "training date, test date"), _kinds("training:t test:t"), ("sold_",), "SELECT m - 180 AS training, m - 90 AS test FROM (SELECT CAST(max(order_date) AS DATE) AS m FROM sold_)"),
    "model_metrics": Query(_metrics, _kinds("model:s train_cutoff:t horizon_days:l test_rows:l positive_rate:d selected:b"), ("label_",), "SELECT 'recency_baseline' AS model, DATE '2001-02-01' AS train_cutoff, 90 AS horizon_days, count(*) AS test_rows, avg(churned) AS positive_rate, false AS selected FROM label_"),
    "churn_scores": Query(_churn_scores, _kinds("customer_id:s churned:l risk_band:s churn_probability:d")),
}

_REPORT_COLUMNS = {
    "kpis": "days:l orders:l net_revenue:d discounts:d average_ticket:d first_day:t last_day:t",
    "reconciliation": "gold_revenue:d silver_revenue:d difference:d",
    "batch_traceability": "bronze_rows:l bronze_distinct:l silver_valid:l silver_quarantined:l",
    "best_days": "date:t orders:l customers:l net_revenue:d average_order_value:d",
    "rfm_composition": "segment:s customers:l pct_of_base:d average_spend:d total_spend:d average_orders:d average_recency:l",
    "revenue_concentration": "band:s customers:l revenue:d pct_of_revenue:d",
    "value_by_country": "country:s customers:l revenue:d average_ticket:d",
    "at_risk_top": "customer_id:s country:s segment:s orders:l total_spend:d recency_days:l last_order:t",
    "funnel_steps": "step:s sessions:l place:l",
    "funnel_by_channel": "channel:s visits:l purchases:l pct_to_cart:d pct_to_checkout:d pct_paid:d conversion:d",
    "weekly_conversion": "week:t visits:l purchases:l conversion_pct:d",
    "funnel_losses": "lost_before_cart:l lost_before_checkout:l lost_before_payment:l",
    "top_products": "product_name:s category:s units_sold:l revenue:d profit:d margin_pct:d return_pct:d",
    "low_margin": "product_name:s category:s units_sold:l revenue:d margin_pct:d",
    "high_returns": "product_name:s category:s units_sold:l returned_units:l return_pct:d refunded_amount:d",
    "category_months": "category:s month:t orders:l units_sold:l revenue:d profit:d margin_pct:d",
    "category_growth": "category:s month:t revenue:d previous_month:d growth_pct:d",
    "dashboard_kpis": "net_revenue:d orders:l average_ticket:d customers:l",
    "dashboard_daily": "date:t net_revenue:d orders:l customers:l",
    "dashboard_country": "country:s revenue:d customers:l",
    "dashboard_segments": "segment:s customers:l revenue:d",
    "dashboard_products": "product_name:s category:s units_sold:l revenue:d profit:d margin_pct:d return_pct:d",
    "dashboard_funnel": "channel:s visits:l added:l checkouts:l purchases:l conversion_pct:d",
    "dashboard_quality": "table:s column:s rule:s severity:s rows_checked:l rows_failed:l pass_pct:d",
    "bench_daily_total": "revenue:d days:l",
    "bench_daily_window": "revenue:d",
    "bench_orders_range": "orders:l amount:d",
    "bench_event_sessions": "event_type:s sessions:l",
}
QUERIES |= {name: Query(_report(name), _kinds(kinds), *oracles.REPORTS.get(name, ())) for name, kinds in _REPORT_COLUMNS.items()}
_TRACE_ERRORS = "twice OR customer_id IS NULL OR orphan OR order_date IS NULL OR status NOT IN ('pending', 'paid', 'shipped', 'delivered', 'cancelled', 'returned') OR total_amount < 0"
QUERIES["batch_traceability"] = Query(_report("batch_traceability"), _kinds(_REPORT_COLUMNS["batch_traceability"]), ("dq_", "customers_", "orders_"), f"SELECT (SELECT count(*) FROM dq_) AS bronze_rows, (SELECT count(DISTINCT order_id) FROM dq_) AS bronze_distinct, (SELECT count(*) FROM orders_) AS silver_valid, (SELECT count(*) FROM ({_DQ_SQL}) WHERE {_TRACE_ERRORS}) AS silver_quarantined")
QUERIES["dashboard_quality"] = Query(_report("dashboard_quality"), _kinds(_REPORT_COLUMNS["dashboard_quality"]), QUERIES["dq_outcomes"].views, f"""SELECT 'orders' AS "table", *, round(pass_rate, 2) AS pass_pct FROM ({QUERIES['dq_outcomes'].sql}) WHERE rows_failed > 0""")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, q in QUERIES.items() if (sql := q.oracle())}
