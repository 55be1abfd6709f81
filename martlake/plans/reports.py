"""The analytical reports and dashboard datasets, as plans over the marts and tables they read.

A report names its inputs and builds its result from them. Shares are taken of sums, never of rounded shares, and are
null where there is no whole; orders are total, so limits are the same in every run. Customers are ranked by ranges of
their spend, not in one window.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martlake.functions.order_statistics import By, select_ranks, within
from martlake.operators.marts import FUNNEL, revenue_orders

#: Shares of customers, by spend from the top, that a concentration band ends with.
CONCENTRATION = {"01 - top 1%": "0.01", "02 - top 5%": "0.05", "03 - top 20%": "0.20", "04 - top 50%": "0.50"}
LAST_CONCENTRATION = "05 - rest"
#: The steps of the funnel as they're shown.
STEPS = dict(zip(FUNNEL, ("page views", "added to cart", "started checkout", "purchased")))
#: The spans that the benchmark statements read.
BENCH_DAYS, BENCH_TIMES = (date(1997, 6, 1), date(1997, 8, 31)), (datetime(1997, 6, 1), datetime(1997, 9, 1))


@dataclass(frozen=True)
class Report:
    needs: tuple[str, ...]
    build: Callable[..., DataFrame]


REPORTS: dict[str, Report] = {}


def _reads(*needs: str):
    """Register a plan over these inputs under its own name."""

    def register(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REPORTS[build.__name__.strip("_")] = Report(needs, build)
        return build

    return register


def _pct(part: Column, whole: Column, digits: int) -> Column:
    return F.round(F.lit(Decimal("100.0")) * part / F.nullif(whole, F.lit(0)), digits)


def _sums(**columns: str) -> list[Column]:
    return [F.sum(of).alias(name) for name, of in columns.items()]


def _average(of: str, name: str, digits: int = 2) -> Column:
    return F.round(F.avg(of), digits).alias(name)


def _rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


# Sales ---------------------------------------------------------------------------------------------------------------


@_reads("daily_sales")
def kpis(days: DataFrame) -> DataFrame:
    totals = _sums(orders="orders", net_revenue="net_revenue", discounts="discounts")
    return days.agg(_rows("days"), *totals, _average("average_order_value", "average_ticket"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@_reads("daily_sales", "orders")
def reconciliation(days: DataFrame, orders: DataFrame) -> DataFrame:
    """Revenue of the mart and of the orders it's made of, in one sum over both."""
    sides = days.select(F.col("net_revenue").alias("gold"), F.lit(None).alias("silver")).unionByName(revenue_orders_by_status(orders).select(F.lit(None).alias("gold"), F.col("total_amount").alias("silver")))
    return sides.agg(*_sums(gold_revenue="gold", silver_revenue="silver")).withColumn("difference", F.col("gold_revenue") - F.col("silver_revenue"))


def revenue_orders_by_status(orders: DataFrame) -> DataFrame:
    """Orders that count by their status, whether they have a day or not: a missing day shows as a difference."""
    return revenue_orders(orders.withColumn("order_date", F.coalesce("order_date", F.lit(datetime(1970, 1, 1)))))


@_reads("orders_raw", "orders", "orders_quarantine")
def batch_traceability(raw: DataFrame, valid: DataFrame, aside: DataFrame) -> DataFrame:
    """Rows on each side of the cleaning: three counts joined as single rows."""
    counts = [raw.agg(_rows("bronze_rows"), F.count_distinct("order_id").alias("bronze_distinct")), valid.agg(_rows("silver_valid")), aside.agg(_rows("silver_quarantined"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


@_reads("daily_sales")
def best_days(days: DataFrame) -> DataFrame:
    return days.orderBy(F.desc("net_revenue"), "date").limit(10).select("date", "orders", "customers", "net_revenue", "average_order_value")


@_reads("category_performance")
def category_months(months: DataFrame) -> DataFrame:
    return months.select("category", "month", "orders", "units_sold", "revenue", "profit", _pct(F.col("profit"), F.col("revenue"), 1).alias("margin_pct")).orderBy(F.desc("month"), F.desc("revenue"), "category")


@_reads("category_performance")
def category_growth(months: DataFrame) -> DataFrame:
    """Each month of a category beside the one before it."""
    own = months.select("category", "month", "revenue", F.lag("revenue").over(Window.partitionBy("category").orderBy("month")).alias("previous_month"))
    return own.withColumn("growth_pct", _pct(F.col("revenue") - F.col("previous_month"), F.col("previous_month"), 1)).orderBy("category", "month")


# Customers -----------------------------------------------------------------------------------------------------------


@_reads("customer_segments")
def rfm_composition(segments: DataFrame) -> DataFrame:
    own = segments.groupBy("segment").agg(
        _rows("customers"), _average("total_spend", "average_spend"), F.sum("total_spend").alias("total_spend"), _average("orders", "average_orders", 1), _average("recency_days", "average_recency", 0)
    )
    base = F.broadcast(own.agg(F.sum("customers").alias("base")))  # one row
    whole = own.crossJoin(base).withColumn("pct_of_base", _pct(F.col("customers"), F.col("base"), 1))
    return whole.select("segment", "customers", "pct_of_base", "average_spend", "total_spend", "average_orders", "average_recency").orderBy(F.desc("total_spend"), "segment")


@_reads("customer_lifetime_value")
def revenue_concentration(customers: DataFrame) -> DataFrame:
    """How much of the revenue the best customers make: spend compared with that of the last customer of each share."""
    order = [By("total_spend", True), By("customer_id")]
    last = lambda n: [int(n * Decimal(share)) for share in CONCENTRATION.values()]
    n, found = select_ranks(customers, {"spend": order}, last)
    ends = {name: found["spend"][k] for name, k in zip(CONCENTRATION, last(n), strict=True) if k}
    bands = customers.groupBy(within(list(ends.values()), order, list(ends), LAST_CONCENTRATION, customers.schema).alias("band"))
    sums = bands.agg(_rows("customers"), F.sum("total_spend").alias("revenue"))
    whole = F.broadcast(sums.agg(F.sum("revenue").alias("all")))  # one row
    return sums.crossJoin(whole).select("band", "customers", "revenue", _pct(F.col("revenue"), F.col("all"), 1).alias("pct_of_revenue")).orderBy("band")


def _by_country(customers: DataFrame, *more: Column) -> DataFrame:
    known = customers.where(F.col("country").isNotNull()).groupBy("country")
    return known.agg(_rows("customers"), F.sum("total_spend").alias("revenue"), *more).orderBy(F.desc("revenue"), "country")


@_reads("customer_lifetime_value")
def value_by_country(customers: DataFrame) -> DataFrame:
    return _by_country(customers, _average("average_order_value", "average_ticket"))


@_reads("customer_segments")
def at_risk_top(segments: DataFrame) -> DataFrame:
    worst = segments.where(F.col("segment") == "At Risk").orderBy(F.desc("total_spend"), "customer_id").limit(20)
    return worst.select("customer_id", "country", "segment", "orders", "total_spend", "recency_days", "last_order")


# Funnel --------------------------------------------------------------------------------------------------------------


def _channels(funnel: DataFrame) -> DataFrame:
    """Sums of all steps for each channel, most visited first."""
    return funnel.groupBy("channel").agg(*(F.sum(x).alias(x) for x in FUNNEL)).orderBy(F.desc("page_views"), "channel")


def _rate(part: str, whole: str, digits: int, name: str) -> Column:
    return _pct(F.col(part), F.col(whole), digits).alias(name)


@_reads("marketing_funnel")
def funnel_steps(funnel: DataFrame) -> DataFrame:
    """One row for each step, unfolded from one row of sums."""
    totals = funnel.agg(*(F.sum(x).alias(x) for x in FUNNEL))
    rows = [F.struct(F.lit(shown).alias("step"), F.col(x).alias("sessions"), F.lit(k).alias("place")) for k, (x, shown) in enumerate(STEPS.items(), 1)]
    return totals.select(F.inline(F.array(*rows))).orderBy("place")


@_reads("marketing_funnel")
def funnel_by_channel(funnel: DataFrame) -> DataFrame:
    steps = list(FUNNEL)
    rates = [_rate(b, a, 1, name) for a, b, name in zip(steps, steps[1:], ("pct_to_cart", "pct_to_checkout", "pct_paid"))]
    return _channels(funnel).select("channel", F.col("page_views").alias("visits"), "purchases", *rates, _rate("purchases", "page_views", 2, "conversion"))


@_reads("marketing_funnel")
def weekly_conversion(funnel: DataFrame) -> DataFrame:
    weeks = funnel.groupBy(F.date_trunc("week", "date").cast("date").alias("week")).agg(*_sums(visits="page_views", purchases="purchases"))
    return weeks.withColumn("conversion_pct", _rate("purchases", "visits", 2, "conversion_pct")).orderBy(F.desc("week")).limit(20)


@_reads("marketing_funnel")
def funnel_losses(funnel: DataFrame) -> DataFrame:
    """Sessions that a step loses against the one before, summed day by day."""
    steps = list(FUNNEL)
    names = ("lost_before_cart", "lost_before_checkout", "lost_before_payment")
    return funnel.agg(*(F.sum(F.col(a) - F.col(b)).alias(name) for a, b, name in zip(steps, steps[1:], names)))


# Products ------------------------------------------------------------------------------------------------------------


def _shown(products: DataFrame, *columns: str) -> DataFrame:
    """Products with their shares rounded; the full ones order them."""
    return products.withColumns({"margin_pct": F.round("margin_pct", 1), "return_pct": F.round("return_rate", 1)}).select("product_name", "category", "units_sold", *columns)


@_reads("product_performance")
def top_products(products: DataFrame) -> DataFrame:
    return _shown(products.orderBy(F.desc("revenue"), "product_id").limit(20), "revenue", "profit", "margin_pct", "return_pct")


@_reads("product_performance")
def low_margin(products: DataFrame) -> DataFrame:
    sold = products.where(F.col("units_sold") > 0)
    return _shown(sold.orderBy(F.desc("revenue"), "margin_pct", "product_id").limit(15), "revenue", "margin_pct")


@_reads("product_performance")
def high_returns(products: DataFrame) -> DataFrame:
    often = products.where(F.col("units_sold") >= 5)
    return _shown(often.orderBy(F.desc("return_rate"), "product_id").limit(15), "returned_units", "return_pct", "refunded_amount")


# Dashboard -----------------------------------------------------------------------------------------------------------


@_reads("daily_sales", "customer_lifetime_value")
def dashboard_kpis(days: DataFrame, customers: DataFrame) -> DataFrame:
    return kpis(days).select("net_revenue", "orders", "average_ticket").crossJoin(customers.agg(_rows("customers")))


@_reads("daily_sales")
def dashboard_daily(days: DataFrame) -> DataFrame:
    return days.select("date", "net_revenue", "orders", "customers").orderBy("date")


@_reads("customer_lifetime_value")
def dashboard_country(customers: DataFrame) -> DataFrame:
    return _by_country(customers)


@_reads("customer_segments")
def dashboard_segments(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment").agg(_rows("customers"), F.sum("total_spend").alias("revenue")).orderBy(F.desc("revenue"), "segment")


@_reads("product_performance")
def dashboard_products(products: DataFrame) -> DataFrame:
    return top_products(products)


@_reads("marketing_funnel")
def dashboard_funnel(funnel: DataFrame) -> DataFrame:
    return _channels(funnel).select("channel", F.col("page_views").alias("visits"), F.col("add_to_carts").alias("added"), "checkouts", "purchases", _rate("purchases", "page_views", 2, "conversion_pct"))


@_reads("quality_results")
def dashboard_quality(results: DataFrame) -> DataFrame:
    """Failed rules of the last run."""
    last = results.agg(F.max_by("run_id", "checked_at").alias("run_id"))  # one row
    failed = results.where(F.col("rows_failed") > 0).join(F.broadcast(last), "run_id")
    return failed.select("table", "column", "rule", "severity", "rows_checked", "rows_failed", F.round("pass_rate", 2).alias("pass_pct")).orderBy(F.desc("rows_failed"), "table", "column", "rule")


# Benchmark -----------------------------------------------------------------------------------------------------------


@_reads("daily_sales")
def bench_daily_total(days: DataFrame) -> DataFrame:
    return days.agg(F.sum("net_revenue").alias("revenue"), _rows("days"))


@_reads("daily_sales")
def bench_daily_window(days: DataFrame) -> DataFrame:
    return days.where(F.col("date").between(*BENCH_DAYS)).agg(F.sum("net_revenue").alias("revenue"))


@_reads("orders")
def bench_orders_range(orders: DataFrame) -> DataFrame:
    first, after = map(F.lit, BENCH_TIMES)
    return orders.where((F.col("order_date") >= first) & (F.col("order_date") < after)).agg(_rows("orders"), F.sum("total_amount").alias("amount"))


@_reads("web_events")
def bench_event_sessions(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count_distinct("session_id").alias("sessions"))


def run(spark: SparkSession, name: str, views: Mapping[str, DataFrame]) -> DataFrame:
    """A report over the given frames."""
    report = REPORTS[name]
    return report.build(*(views[v] for v in report.needs))


# Export --------------------------------------------------------------------------------------------------------------


def dashboard(views: Mapping[str, DataFrame], title: str = "Retail marts") -> dict:
    """The dashboard's datasets with their columns, for export; each is a small table."""
    made = {n.removeprefix("dashboard_"): REPORTS[n].build(*(views[v] for v in REPORTS[n].needs)) for n in REPORTS if n.startswith("dashboard_")}
    return {"title": title, "datasets": [{"name": n, "columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema]} for n, df in made.items()]}


def rendered(exported: dict) -> str:
    return json.dumps(exported, indent=1, sort_keys=True) + "\n"


def is_stale(path: str, exported: dict) -> bool:
    """Whether the file isn't what an export would write now."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read() != rendered(exported)
    except FileNotFoundError:
        return True


def export(path: str, exported: dict) -> bool:
    """Write the export; whether it was stale."""
    if stale := is_stale(path, exported):
        with open(path, "w", encoding="utf-8") as f:
            f.write(rendered(exported))
    return stale
