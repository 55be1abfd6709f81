"""Synthetic retail batches, generated by Spark.

Every value is a hash of (seed, stream, row id), so a row's values depend on nothing but its id: the data are the same
for any number of partitions, and batches of any size are made side by side. Batch 0 is the history; each later batch
has new rows with ids that go on, and new states of old ones. Anomalies are put into exact numbers of rows at the end,
on the text that lands, and reported in the batch's manifest.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict, dataclass, fields
from datetime import date, datetime, timedelta
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlake.sources.contracts import contract

# Fixed values of the model -------------------------------------------------------------------------------------------

REFERENCE_DATE, HISTORY_DAYS = date(2026, 9, 1), 24 * 30
COUNTRIES = {"US": 0.34, "MX": 0.18, "BR": 0.14, "ES": 0.12, "AR": 0.08, "CO": 0.06, "CL": 0.05, "PE": 0.03}
TAXONOMY = {
    "Electronics": ["Smartphones", "Laptops", "Audio", "Wearables"],
    "Home": ["Kitchen", "Furniture", "Decor", "Bedding"],
    "Fashion": ["Shoes", "Shirts", "Accessories", "Outerwear"],
    "Sports": ["Fitness", "Outdoor", "Cycling", "Team Sports"],
    "Beauty": ["Skincare", "Fragrance", "Makeup", "Haircare"],
}
STATUSES = {"delivered": 0.62, "shipped": 0.12, "paid": 0.10, "pending": 0.06, "cancelled": 0.06, "returned": 0.04}
METHODS = {"credit_card": 0.44, "debit_card": 0.24, "paypal": 0.18, "bank_transfer": 0.08, "wallet": 0.06}
BASKET = {1: 0.45, 2: 0.25, 3: 0.15, 4: 0.10, 5: 0.05}
UNITS = {1: 0.72, 2: 0.20, 3: 0.08}
DISCOUNTED, DISCOUNT_FROM, DISCOUNT_TO = 0.22, 0.05, 0.30
PAID, PAYMENT_STATUS = 0.98, {"delivered": "completed", "shipped": "completed", "paid": "completed", "pending": "pending", "cancelled": "failed", "returned": "refunded"}
REVIEWED, RATINGS = 0.30, {1: 0.04, 2: 0.06, 3: 0.12, 4: 0.30, 5: 0.48}
SENT_BACK, REASONS = 0.04, {"damaged": 0.18, "wrong_item": 0.12, "not_as_described": 0.20, "changed_mind": 0.28, "size_issue": 0.15, "late_delivery": 0.07}
STEPS, DEPTH, STEP_SECONDS = ["page_view", "add_to_cart", "checkout_start", "purchase"], {1: 0.55, 2: 0.24, 3: 0.13, 4: 0.08}, 45
DEVICES = {"mobile": 0.62, "desktop": 0.33, "tablet": 0.05}
CHANNELS = {"organic": 0.30, "paid_search": 0.22, "social": 0.18, "email": 0.12, "direct": 0.13, "referral": 0.05}
IDENTIFIED = 0.28
CYCLE = ["pending", "paid", "shipped", "delivered", "returned"]
NEW_ORDERS, MUTATED, LATE, LATE_DAYS, MOVED, REPRICED, PRICE_FROM, PRICE_TO = 0.02, 0.03, 0.10, 5, 0.02, 0.03, 0.85, 1.25
BAD_TIMES = ["", "N/A", "not-a-date", "0000-00-00 00:00:00", "2026-13-45 99:99:99"]
CUSTOMER_SPREAD, PRODUCT_SPREAD = 1.1, 1.3
#: Rows of a landed file at most.
CHUNK_ORDERS, CHUNK_EVENTS = 250_000, 2_000_000
MEAN_STEPS = sum(k * p for k, p in DEPTH.items())


@dataclass(frozen=True)
class Profile:
    name: str
    customers: int
    products: int
    orders: int
    web_events: int


PROFILES = {p.name: p for p in (Profile("dev", 1_000, 200, 10_000, 100_000), Profile("demo", 50_000, 2_000, 500_000, 5_000_000), Profile("full", 200_000, 5_000, 5_000_000, 50_000_000))}


def profile(name: str) -> Profile:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; known: {', '.join(PROFILES)}")
    return PROFILES[name]


@dataclass(frozen=True)
class DirtRates:
    """Shares of rows that get each anomaly."""

    duplicate_orders: float = 0.0030
    orphan_customer_id: float = 0.0010
    non_positive_quantity: float = 0.0005
    negative_price: float = 0.0002
    invalid_timestamp: float = 0.0010
    inconsistent_status: float = 0.0200
    malformed_email: float = 0.0050

    @classmethod
    def clean(cls) -> DirtRates:
        return cls(**{f.name: 0.0 for f in fields(cls)})


# Draws ---------------------------------------------------------------------------------------------------------------


class Draws:
    """Uniform numbers and picks by stream and row id."""

    def __init__(self, seed: int):
        self.seed = seed

    def bits(self, stream: str, *ids: Column) -> Column:
        return F.xxhash64(F.lit(self.seed), F.lit(stream), *ids)

    def uniform(self, stream: str, *ids: Column) -> Column:
        return F.shiftrightunsigned(self.bits(stream, *ids), 11) / F.lit(float(1 << 53))

    def normal(self, stream: str, *ids: Column) -> Column:
        """Standard normal numbers, from two uniform ones each."""
        radius = F.sqrt(-2 * F.log(F.greatest(self.uniform(f"{stream}_a", *ids), F.lit(1e-12))))
        return radius * F.cos(2 * 3.141592653589793 * self.uniform(f"{stream}_b", *ids))

    def popular(self, n: int, spread: float, stream: str, *ids: Column) -> Column:
        """Numbers below ``n``, each drawn in proportion to a lognormal weight; small numbers have the large weights.

        If weights are exp(spread * z) for normal z, what is drawn in proportion to them has z + spread for z. So its
        place among the weights is a value of the normal distribution function, and no table of sums is needed."""
        place = _below(self.normal(stream, *ids) - F.lit(spread))
        return F.least(F.floor(n * place), F.lit(max(n - 1, 0)))

    def integer(self, low: int, high: int, stream: str, *ids: Column) -> Column:
        """From low to high, both included."""
        return (F.floor(self.uniform(stream, *ids) * (high - low + 1)) + low).cast("int")

    def pick(self, weights: dict, stream: str, *ids: Column) -> Column:
        u, bounds = self.uniform(stream, *ids), list(accumulate(weights.values()))[:-1]
        passed = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= u))
        return F.element_at(F.array(*map(F.lit, weights)), passed + 1)


def _below(x: Column) -> Column:
    """The normal distribution function, to seven digits (Hastings' polynomial)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    sum_ = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        sum_ = (sum_ + F.lit(c)) * t
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * sum_
    return F.when(x < 0, tail).otherwise(1 - tail)


def _id(prefix: str, n: Column, width: int = 8) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.lpad(n.cast("string"), width, "0"))


def _money(cents: Column, kind: str) -> Column:
    return (cents.cast("decimal(18,0)") / 100).cast(kind)


def _time(day: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + seconds)


def _start() -> date:
    return REFERENCE_DATE - timedelta(days=HISTORY_DAYS)


def _batch_day(batch: int) -> date:
    return REFERENCE_DATE + timedelta(days=batch - 1)


# Entities, typed -----------------------------------------------------------------------------------------------------


def customers(spark: SparkSession, p: Profile, d: Draws, batch: int) -> DataFrame:
    """All customers in batch 0; later those that moved."""
    i = F.col("id")
    rows = spark.range(p.customers)
    if batch:
        rows = rows.where(d.uniform(f"moves{batch}", i) < MOVED)
    stream = f"country{batch}" if batch else "country"
    registered = F.date_sub(F.lit(_start()), d.integer(0, 700, "registered", i))
    return rows.select(
        _id("CUS", i).alias("customer_id"),
        F.concat(F.lit("First"), (F.pmod(d.bits("first", i), F.lit(400))).cast("string")).alias("first_name"),
        F.concat(F.lit("Last"), (F.pmod(d.bits("last", i), F.lit(900))).cast("string")).alias("last_name"),
        F.concat(F.lit("user"), i.cast("string"), F.lit("@mail.example.com")).alias("email"),
        d.pick(COUNTRIES, stream, i).alias("country"),
        F.concat(F.lit("City"), F.pmod(d.bits(f"city{batch}", i), F.lit(300)).cast("string")).alias("city"),
        registered.alias("registration_date"),
        (_time(F.lit(_batch_day(batch)), F.lit(0)) if batch else registered.cast("timestamp")).alias("updated_at"),
    )


def _price_cents(d: Draws, i: Column) -> Column:
    """A lognormal price from 5 to 2000."""
    return F.round(100 * F.least(F.greatest(F.exp(3.8 + 0.9 * d.normal("price", i)), F.lit(5.0)), F.lit(2000.0))).cast("long")


def products(spark: SparkSession, p: Profile, d: Draws, batch: int) -> DataFrame:
    """All products in batch 0; later those with a new price. Cost never changes."""
    i = F.col("id")
    rows = spark.range(p.products)
    if batch:
        rows = rows.where(d.uniform(f"reprices{batch}", i) < REPRICED)
    kinds = [(c, s) for c, subs in TAXONOMY.items() for s in subs]
    kind = F.element_at(F.array(*(F.struct(F.lit(c).alias("c"), F.lit(s).alias("s")) for c, s in kinds)), (F.pmod(d.bits("kind", i), F.lit(len(kinds))) + 1).cast("int"))
    price = _price_cents(d, i)
    factor = PRICE_FROM + (PRICE_TO - PRICE_FROM) * d.uniform(f"factor{batch}", i)
    return rows.select(
        _id("PRD", i, 6).alias("product_id"),
        F.concat(kind["s"], F.lit(" "), i.cast("string")).alias("product_name"),
        kind["c"].alias("category"),
        kind["s"].alias("subcategory"),
        F.concat(F.lit("Brand"), F.pmod(d.bits("brand", i), F.lit(40)).cast("string")).alias("brand"),
        _money(F.round(price * factor) if batch else price, "decimal(10,2)").alias("price"),
        _money(F.round(price * (0.40 + 0.35 * d.uniform("cost", i))), "decimal(10,2)").alias("cost"),
        (d.uniform(f"active{batch}" if batch else "active", i) >= 0.05).alias("is_active"),
        (_time(F.lit(_batch_day(batch)), F.lit(3600)) if batch else F.lit(_start()).cast("timestamp")).alias("updated_at"),
    )


def _order_ids(spark: SparkSession, p: Profile, batch: int) -> DataFrame:
    new = round(p.orders * NEW_ORDERS)
    return spark.range(p.orders) if not batch else spark.range(p.orders + (batch - 1) * new, p.orders + batch * new)


def _order_base(rows: DataFrame, p: Profile, d: Draws) -> DataFrame:
    """What an order has for good: customer, time, first status, method, lines."""
    i, new = F.col("id"), max(1, round(p.orders * NEW_ORDERS))
    born = F.when(i < p.orders, 0).otherwise(F.floor((i - p.orders) / new) + 1).cast("int")
    late = F.when(d.uniform("late", i) < LATE, d.integer(1, LATE_DAYS, "late_days", i)).otherwise(0)
    # later days are busier; a later batch covers its day, but for orders that come late
    history_day = F.floor(HISTORY_DAYS * F.pow(d.uniform("day", i), 1 / 1.7)).cast("int")
    day = F.when(born == 0, F.date_add(F.lit(_start()), history_day)).otherwise(F.date_sub(F.date_add(F.lit(REFERENCE_DATE), born - 1), late))
    basket = d.pick(BASKET, "basket", i)
    line = F.transform(F.sequence(F.lit(1), basket), lambda k: _line(p, d, i, k))
    return rows.select(
        "id",
        born.alias("born"),
        d.popular(p.customers, CUSTOMER_SPREAD, "customer", i).alias("customer"),
        _time(day, d.integer(0, 86_399, "second", i)).alias("order_date"),
        F.when(born == 0, d.pick(STATUSES, "status", i)).otherwise(d.pick({"pending": 0.5, "paid": 0.5}, "status", i)).alias("status"),
        d.pick(METHODS, "method", i).alias("payment_method"),
        d.pick(COUNTRIES, "country", d.popular(p.customers, CUSTOMER_SPREAD, "customer", i)).alias("shipping_country"),
        line.alias("lines"),
    )


def _line(p: Profile, d: Draws, i: Column, k: Column) -> Column:
    product = d.popular(p.products, PRODUCT_SPREAD, "product", i, k).cast("long")
    price, units = _price_cents(d, product), d.pick(UNITS, "units", i, k)
    share = F.when(d.uniform("discounted", i, k) < DISCOUNTED, DISCOUNT_FROM + (DISCOUNT_TO - DISCOUNT_FROM) * d.uniform("discount", i, k)).otherwise(0.0)
    return F.struct(k.cast("int").alias("k"), product.alias("product"), units.cast("int").alias("units"), price.alias("price"), F.round(price * units * share).cast("long").alias("discount"))


def _advanced(base: DataFrame, d: Draws, batch: int) -> DataFrame:
    """With the status after the mutations of all batches up to this one, and when it last changed."""
    rank = F.array_position(F.array(*map(F.lit, CYCLE)), F.col("status")).cast("int") - 1
    steps = [F.when((F.col("born") < b) & (d.uniform(f"mutates{b}", F.col("id")) < MUTATED), b) for b in range(1, batch + 1)]
    hits = F.array_compact(F.array(*steps)) if steps else F.array().cast("array<int>")
    room = F.when(rank < 0, 0).otherwise(len(CYCLE) - 1 - rank)  # cancelled is final, and so is the cycle's end
    used = F.slice(hits, 1, F.greatest(F.least(F.size(hits), room), F.lit(0)))
    status = F.when(F.size(used) > 0, F.element_at(F.array(*map(F.lit, CYCLE)), (rank + F.size(used) + 1).cast("int"))).otherwise(F.col("status"))
    changed = F.when(F.size(used) > 0, F.element_at(used, -1)).otherwise(-1)
    touched = F.when(changed > 0, _time(F.date_add(F.lit(REFERENCE_DATE), changed - 1), F.lit(7200))).otherwise(F.col("order_date") + F.expr("INTERVAL 1 HOUR"))
    return base.withColumns({"status": status, "changed": changed, "updated_at": F.greatest(touched, F.col("order_date") + F.expr("INTERVAL 1 HOUR"))})


def orders_with_lines(spark: SparkSession, p: Profile, d: Draws, batch: int) -> DataFrame:
    """The batch's orders, typed, with their lines: new ones, and in later batches those that advanced."""
    rows = _order_base(_order_ids(spark, p, batch), p, d)
    if batch:
        old = spark.range(p.orders + (batch - 1) * round(p.orders * NEW_ORDERS)).where(d.uniform(f"mutates{batch}", F.col("id")) < MUTATED)
        rows = rows.unionByName(_order_base(old, p, d))
    moved = _advanced(rows, d, batch)
    return moved.where((F.col("born") == batch) | (F.col("changed") == batch))


def _sum(lines: Column, value) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + value(x))


def orders(base: DataFrame) -> DataFrame:
    gross, off = _sum(F.col("lines"), lambda x: x["price"] * x["units"]), _sum(F.col("lines"), lambda x: x["discount"])
    return base.select(
        _id("ORD", F.col("id"), 10).alias("order_id"), _id("CUS", F.col("customer")).alias("customer_id"), "order_date", "status", "payment_method", "shipping_country",
        _money(gross, "decimal(12,2)").alias("gross_amount"), _money(off, "decimal(12,2)").alias("discount_amount"), _money(gross - off, "decimal(12,2)").alias("total_amount"),
        F.col("order_date").alias("created_at"), "updated_at",
    )


def order_items(base: DataFrame, batch: int) -> DataFrame:
    """Lines of the batch's new orders."""
    x = F.col("x")
    return base.where(F.col("born") == batch).select("id", F.explode("lines").alias("x")).select(
        F.concat(_id("ITM", F.col("id"), 10), F.lit("-"), x["k"].cast("string")).alias("order_item_id"), _id("ORD", F.col("id"), 10).alias("order_id"), _id("PRD", x["product"], 6).alias("product_id"),
        x["units"].alias("quantity"), _money(x["price"], "decimal(10,2)").alias("unit_price"), _money(x["discount"], "decimal(10,2)").alias("discount_amount"), _money(x["price"] * x["units"] - x["discount"], "decimal(12,2)").alias("line_total"),
    )


def payments(base: DataFrame, d: Draws) -> DataFrame:
    state = F.element_at(F.create_map(*(F.lit(x) for kv in PAYMENT_STATUS.items() for x in kv)), F.col("status"))
    total = _sum(F.col("lines"), lambda x: x["price"] * x["units"] - x["discount"])
    return base.where(d.uniform("paid", F.col("id")) < PAID).select(
        _id("PAY", F.col("id"), 10).alias("payment_id"), _id("ORD", F.col("id"), 10).alias("order_id"), "payment_method", _money(total, "decimal(12,2)").alias("amount"),
        state.alias("payment_status"), F.timestamp_seconds(F.unix_timestamp("order_date") + d.integer(60, 7200, "pay_delay", F.col("id"))).alias("payment_date"), "updated_at",
    )


def reviews(base: DataFrame, d: Draws, batch: int) -> DataFrame:
    i, x = F.col("id"), F.col("lines")[0]
    done = base.where((F.col("status") == "delivered") & (F.col("born") == batch) & (d.uniform("reviewed", i) < REVIEWED))
    return done.select(
        _id("REV", i, 10).alias("review_id"), _id("ORD", i, 10).alias("order_id"), _id("PRD", x["product"], 6).alias("product_id"), _id("CUS", F.col("customer")).alias("customer_id"),
        d.pick(RATINGS, "rating", i).cast("int").alias("rating"), F.timestamp_seconds(F.unix_timestamp("order_date") + 86_400 * d.integer(3, 30, "review_days", i)).alias("review_date"),
    )


def returns(base: DataFrame, d: Draws, batch: int) -> DataFrame:
    """Lines of delivered orders that came back, with a refund in proportion."""
    i, x = F.col("id"), F.col("x")
    lines = base.where((F.col("status") == "delivered") & (F.col("born") == batch)).select("id", "order_date", F.explode("lines").alias("x"))
    back = lines.where(d.uniform("sent_back", i, x["k"]) < SENT_BACK).withColumn("n", F.greatest(F.ceil(x["units"] * d.uniform("back_units", i, x["k"])), F.lit(1)).cast("int"))
    refund = F.floor((x["price"] * x["units"] - x["discount"]) * F.col("n") / x["units"])
    return back.select(
        F.concat(_id("RET", i, 10), F.lit("-"), x["k"].cast("string")).alias("return_id"), _id("ORD", i, 10).alias("order_id"), F.concat(_id("ITM", i, 10), F.lit("-"), x["k"].cast("string")).alias("order_item_id"), _id("PRD", x["product"], 6).alias("product_id"),
        F.col("n").alias("quantity"), d.pick(REASONS, "reason", i, x["k"]).alias("reason"), _money(refund, "decimal(12,2)").alias("refund_amount"), F.timestamp_seconds(F.unix_timestamp("order_date") + 86_400 * d.integer(5, 30, "return_days", i)).alias("return_date"),
    )


def web_events(spark: SparkSession, p: Profile, d: Draws, batch: int) -> DataFrame:
    """Exactly the profile's events (a fiftieth in later batches): sessions as deep as they get, cut at the number."""
    total = p.web_events if not batch else max(1, round(p.web_events * NEW_ORDERS))
    sessions = int(total / MEAN_STEPS * 1.15) + 40
    i, k = F.col("id"), F.col("k")
    day = F.date_add(F.lit(_start()), F.floor(HISTORY_DAYS * F.pow(d.uniform("session_day", i), 1 / 1.7)).cast("int")) if not batch else F.lit(_batch_day(batch))
    rows = spark.range(batch << 32, (batch << 32) + sessions).withColumns({"t": _time(day, d.integer(0, 86_000, "session_second", i)), "k": F.explode(F.sequence(F.lit(1), d.pick(DEPTH, "depth", i)))})
    # of the last sessions so many steps fall away that the number is met: by order of (session, step)
    steps = spark.range(batch << 32, (batch << 32) + sessions).select("id", d.pick(DEPTH, "depth", i).alias("n"))
    extra = steps.agg(F.sum("n")).first()[0] - total
    if extra < 0:
        raise ValueError("too few sessions were drawn")
    dropped = rows.select("id", "k").orderBy(F.desc("id"), F.desc("k")).limit(extra)
    rows = rows.join(dropped, ["id", "k"], "left_anti") if extra else rows
    known = d.uniform("identified", i) < IDENTIFIED
    product = _id("PRD", d.popular(p.products, PRODUCT_SPREAD, "seen_product", i), 6)
    return rows.select(
        F.concat(_id("EVT", i, 12), F.lit("-"), k.cast("string")).alias("event_id"), F.timestamp_seconds(F.unix_timestamp("t") + (k - 1) * STEP_SECONDS).alias("event_timestamp"), _id("SES", i, 12).alias("session_id"),
        F.when(known, _id("CUS", d.popular(p.customers, CUSTOMER_SPREAD, "visitor", i))).alias("customer_id"), F.element_at(F.array(*map(F.lit, STEPS)), k).alias("event_type"), F.when(k > 1, product).alias("product_id"),
        d.pick(DEVICES, "device", i).alias("device"), d.pick(CHANNELS, "channel", i).alias("utm_source"),
    )


def typed_batch(spark: SparkSession, p: Profile, seed: int, batch: int) -> dict[str, DataFrame]:
    """All entities of a batch, clean and typed."""
    d, base = Draws(seed), orders_with_lines(spark, p, Draws(seed), batch)
    out = {"customers": customers(spark, p, d, batch), "products": products(spark, p, d, batch), "orders": orders(base), "order_items": order_items(base, batch), "payments": payments(base, d), "reviews": reviews(base, d, batch), "returns": returns(base, d, batch), "web_events": web_events(spark, p, d, batch)}
    return {e: df.select(contract(e).columns) for e, df in out.items()}


# Landing -------------------------------------------------------------------------------------------------------------


def as_text(df: DataFrame) -> DataFrame:
    """All columns as the text that lands."""
    form = {"timestamp": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")}
    return df.select(*(form.get(t, lambda c: F.col(c).cast("string"))(c).alias(c) for c, t in df.dtypes))


def _chosen(df: DataFrame, key: str, d: Draws, stream: str, rate: float) -> tuple[DataFrame, int]:
    """``df`` with a flag on exactly round(rate * rows) rows, those of least hash."""
    n = round(rate * df.count())
    keys = df.select(key).orderBy(d.bits(stream, F.col(key)), key).limit(n).withColumn("__hit", F.lit(True))
    return df.join(keys, key, "left").withColumn("__hit", F.coalesce("__hit", F.lit(False))), n


def soil(batch: dict[str, DataFrame], d: Draws, rates: DirtRates) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The text batch with anomalies, and how many rows got each."""
    out, made = dict(batch), {}

    def spoil(entity: str, name: str, column: str, value: Column) -> None:
        key = contract(entity).key
        marked, made[name] = _chosen(out[entity], key, d, name, getattr(rates, name))
        out[entity] = marked.withColumn(column, F.when(F.col("__hit"), value).otherwise(F.col(column))).select(batch[entity].columns)

    spoil("customers", "malformed_email", "email", F.regexp_replace("email", "@", " at "))
    spoil("orders", "orphan_customer_id", "customer_id", F.concat(F.lit("CUS-9"), F.substring("order_id", -9, 9)))
    bad = F.element_at(F.array(*map(F.lit, BAD_TIMES)), (F.pmod(d.bits("bad_time", F.col("order_id")), F.lit(len(BAD_TIMES))) + 1).cast("int"))
    spoil("orders", "invalid_timestamp", "order_date", bad)
    spoil("orders", "inconsistent_status", "status", F.concat(F.lit(" "), F.upper("status"), F.lit(" ")))
    spoil("order_items", "non_positive_quantity", "quantity", F.lit("0"))
    spoil("order_items", "negative_price", "unit_price", F.concat(F.lit("-"), F.col("unit_price")))
    marked, made["duplicate_orders"] = _chosen(out["orders"], "order_id", d, "duplicate_orders", rates.duplicate_orders)
    own = batch["orders"].columns
    out["orders"] = marked.select(own).unionByName(marked.where("__hit").select(own))
    return out, made


def generate_batch(spark: SparkSession, scale: Profile | str, batch: int, root: str, seed: int = 42, dirt: DirtRates | None = None, chunk_orders: int = CHUNK_ORDERS, chunk_events: int = CHUNK_EVENTS) -> dict:
    """Write the batch below ``root/<entity>/batch_NNN`` and its manifest at ``root/_manifests/batch_NNN``; the manifest.

    The result is a function of (seed, profile, batch, rates). A file holds ``chunk_orders`` rows at most (of web
    events ``chunk_events``): then the writer begins the next."""
    if min(chunk_orders, chunk_events) < 1:
        raise ValueError("a file holds at least one row")
    p = profile(scale) if isinstance(scale, str) else scale
    d, rates = Draws(seed), dirt if dirt is not None else DirtRates()
    rows, made = soil({e: as_text(df) for e, df in typed_batch(spark, p, seed, batch).items()}, d, rates)
    counts = {}
    for entity, df in rows.items():
        path = f"{root.rstrip('/')}/{entity}/batch_{batch:03d}"
        df.write.mode("overwrite").option("maxRecordsPerFile", chunk_events if entity == "web_events" else chunk_orders).parquet(path)
        counts[entity] = spark.read.parquet(path).count()
    manifest = {"profile": asdict(p), "batch": batch, "seed": seed, "generated_for": str(_batch_day(batch)), "rates": asdict(rates), "rows": counts, "anomalies": made}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{root.rstrip('/')}/_manifests/batch_{batch:03d}")
    return manifest


def read_manifest(spark: SparkSession, root: str, batch: int) -> dict:
    return json.loads(spark.read.text(f"{root.rstrip('/')}/_manifests/batch_{batch:03d}").first()[0])


def main(argv: list[str] | None = None) -> dict:
    a = argparse.ArgumentParser(description="Generate a batch of retail data.")
    a.add_argument("--profile", default="dev", choices=PROFILES)
    a.add_argument("--batch", type=int, default=0)
    a.add_argument("--seed", type=int, default=42)
    a.add_argument("--out", required=True)
    a.add_argument("--chunk-orders", type=int, default=CHUNK_ORDERS, help="rows of a file at most")
    a.add_argument("--chunk-events", type=int, default=CHUNK_EVENTS, help="web events of a file at most")
    a.add_argument("--clean", action="store_true", help="without anomalies")
    x = a.parse_args(argv)
    began = datetime.now()
    manifest = generate_batch(SparkSession.builder.getOrCreate(), x.profile, x.batch, x.out, x.seed, DirtRates.clean() if x.clean else None, x.chunk_orders, x.chunk_events)
    print(json.dumps(manifest, indent=1), f"\n{datetime.now() - began}")
    return manifest


if __name__ == "__main__":
    main()
