"""The lakehouse run: landing -> bronze -> silver with quarantine -> quality gate -> gold, over a versioned store."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlake.functions import cleaning
from martlake.operators import churn, history, marts, quality
from martlake.operators.upsert import latest
from martlake.plans.runner import Run, Task, run_tasks
from martlake.sources.contracts import CONTRACTS, contract, history_schema, quarantine_schema
from martlake.sources.store import Store
from martlake.streaming.ingest import ingest_all

LAYERS = ("landing", "bronze", "silver", "gold", "ops")
#: Parents before children, as foreign keys read the loaded parents.
ORDER = ["customers", "products", "orders", "order_items", "payments", "returns", "reviews", "web_events"]
#: Columns that are codes, and what each mart is clustered by.
CODES = {"orders": ["status", "payment_method"], "payments": ["payment_status", "payment_method"], "returns": ["reason"], "web_events": ["event_type", "device", "utm_source"]}
CLUSTERS = {"daily_sales": "date", "category_performance": "month", "marketing_funnel": "date"}
COMMENTS = {"daily_sales": {"net_revenue": "sum of total_amount of revenue orders", "average_order_value": "net revenue by orders"}, "customer_churn_predictions": {"churn_probability": "probability of no order within the horizon", "risk_band": "by percent_rank of the probability"}}


def clean(raw: DataFrame, entity: str) -> DataFrame:
    """Typed rows of the raw text, one for each version of a key, with cast errors."""
    c = contract(entity)
    own = raw.select(*c.columns)
    own = cleaning.trim(own, [f.name for f in c.schema if isinstance(f.dataType, T.StringType)])
    own = cleaning.normalise(own, CODES.get(entity, []))
    typed = cleaning.cast_to_contract(cleaning.with_cast_errors(own, entity), entity)
    return latest(typed, [c.key, c.version] if c.history else c.key, c.version)


def load_silver(store: Store, entity: str, run_id: str, checked_at: datetime, rules: dict | None = None) -> list[quality.Outcome]:
    """Clean, check, set aside, load and retract one entity; its outcomes are added to ops.quality_results."""
    c, spark = contract(entity), store.spark
    results = store.table("ops", "quality_results")
    before = quality.baselines(results.read()) if results.exists() else {}
    references = {e: store.table("silver", e).read() for e in CONTRACTS if e != entity and store.table("silver", e).exists()}
    own = (rules or quality.load_rules()).get(entity, [])
    marked, outcomes = quality.evaluate(clean(store.table("bronze", f"{entity}_raw").read(), entity), own, references, before)
    valid, rejected = cleaning.split_quarantine(cleaning.combine_errors(marked))
    aside, silver = store.table("silver", f"{entity}_quarantine"), store.table("silver", entity)
    aside.create(quarantine_schema(entity))
    aside.overwrite(cleaning.to_contract(rejected, entity, "_errors"))
    rows = cleaning.to_contract(valid, entity)
    if c.history:
        silver.create(history_schema(entity))
        silver.overwrite(history.apply_history(silver.read(), rows, c.key, c.version).select(silver.schema().names), "SCD2")
    else:
        silver.create(c.nullable())
        silver.upsert(rows, c.key, c.version)
        silver.delete_keys(aside.read(), c.key)
    results.append(quality.results(spark, outcomes, run_id, checked_at), merge_schema=True)
    return outcomes


def build_silver(store: Store, run_id: str, checked_at: datetime, entities: Iterable[str] | None = None) -> list[quality.Outcome]:
    wanted = set(entities or ORDER)
    return [o for e in ORDER if e in wanted for o in load_silver(store, e, run_id, checked_at)]


def build_gold(store: Store, run_id: str | None = None) -> dict[str, int]:
    """All marts. With a run id, daily sales are rebuilt only for the days that the run's raw orders may touch."""
    silver = {e: store.table("silver", e).read() for e in ORDER}
    days = store.table("gold", "daily_sales")
    window = None
    if run_id and days.exists():
        batch = store.table("bronze", "orders_raw").read().where(F.col("_pipeline_run_id") == run_id)
        window = marts.affected_range(cleaning.cast_to_contract(batch.select(*contract("orders").columns), "orders"))
    if window:
        days.replace_where(marts.daily_sales_window(silver["orders"], *window), marts.window_condition(*window))
    elif not (run_id and days.exists()):
        days.overwrite(marts.daily_sales(silver["orders"]), cluster_by=CLUSTERS["daily_sales"], comments=COMMENTS["daily_sales"])
    built = {
        "product_performance": marts.product_performance(silver["order_items"], silver["orders"], silver["products"], silver["returns"]),
        "category_performance": marts.category_performance(silver["order_items"], silver["orders"], silver["products"]),
        "customer_lifetime_value": marts.customer_lifetime_value(silver["orders"], silver["customers"]),
        "marketing_funnel": marts.marketing_funnel(silver["web_events"]),
    }
    for name, df in built.items():
        store.table("gold", name).overwrite(df, cluster_by=CLUSTERS.get(name))
    store.table("gold", "customer_segments").overwrite(marts.customer_segments(store.table("gold", "customer_lifetime_value").read()))
    return {t: store.table("gold", t).version() for t in store.tables("gold")}


def score_churn(store: Store, scored_at: datetime) -> churn.Selection:
    """Train on the earlier cutoff, choose on the later, score the customers of the last day."""
    orders, returns = (store.table("silver", e).read() for e in ("orders", "returns"))
    earlier, later = churn.cutoffs(orders)
    best = churn.select_best(churn.training_set(orders, returns, earlier), churn.training_set(orders, returns, later))
    last = orders.agg(F.max(F.to_date("order_date"))).first()[0]
    scored = churn.predict(best.model, churn.features(orders, returns, last))
    store.table("gold", "customer_churn_predictions").overwrite(churn.predictions_mart(scored, best.algorithm, scored_at), comments=COMMENTS["customer_churn_predictions"])
    store.table("ops", "model_metrics").overwrite(churn.metrics_table(store.spark, best, earlier, later, scored_at))
    return best


def pipeline(spark: SparkSession, landing: str, root: str, run_id: str, now: datetime, entities: Iterable[str] | None = None) -> Run:
    """One run of the task graph; gold waits for the gate."""
    store, wanted = Store(spark, root), list(entities or ORDER)
    store.create_layers(*LAYERS)
    tasks = [
        Task("ingest_bronze", lambda: ingest_all(spark, landing, store, f"{root}/_state", run_id, wanted)),
        Task("build_silver", lambda: build_silver(store, run_id, now, wanted), ("ingest_bronze",)),
        Task("quality_gate", lambda: quality.gate(store.table("ops", "quality_results").read(), run_id), ("build_silver",)),
        Task("build_gold", lambda: build_gold(store, run_id), ("quality_gate",)),
    ]
    return run_tasks(tasks)
