"""The retail model's entities derived from a star schema of orders, lines, parts, customers and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlake.operators.history import replay
from martlake.operators.upsert import latest

#: Fixed values of the derivation.
STATUS = {"F": "delivered", "O": "shipped", "P": "pending"}
EVENTS = {"view": "page_view", "click": "add_to_cart", "signup": "checkout_start", "purchase": "purchase"}
CHANNELS = ["organic", "paid_search", "social", "email", "direct", "referral"]
FIRST_DAY, CHANGE_DAY = "1990-01-01", "1998-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _renamed(column: str, names: dict[str, str]):
    out = F.col(column)
    for old, new in names.items():
        out = F.when(F.col(column) == old, F.lit(new)).otherwise(out)
    return out


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.col("o_totalprice").cast("decimal(12,2)")
    off = (total * F.lit("0.05").cast("decimal(2,2)")).cast("decimal(12,2)")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderdate").cast("timestamp").alias("order_date"),
        _renamed("o_orderstatus", STATUS).alias("status"),
        (total + off).cast("decimal(12,2)").alias("gross_amount"),
        off.alias("discount_amount"),
        total.alias("total_amount"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without the natural duplicates of (order, line number): the last shipped stays, ties by the other columns."""
    own = table(spark, sf_dir, "lineitem")
    order = [F.struct(F.col("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"), F.col("l_returnflag"))]
    return latest(own.withColumn("__order", order[0]), ["l_orderkey", "l_linenumber"], "__order").drop("__order")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    off = (price * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(10,2)")
    return lines(spark, sf_dir).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("order_item_id"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        off.alias("discount_amount"),
        (price - off).cast("decimal(12,2)").alias("line_total"),
        F.col("l_shipdate").cast("timestamp").alias("shipped"),
        "l_returnflag",
    )


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = order_items(spark, sf_dir).where("l_returnflag = 'R'")
    return back.select(F.col("order_item_id").alias("return_id"), "order_id", "order_item_id", "product_id", "quantity", F.col("line_total").alias("refund_amount"), F.col("shipped").alias("return_date"))


def product_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of products: cost is 60 % of the price, and 70 % of it for every third product from a day on; a last
    version of some products repeats the one before."""
    price = F.col("p_retailprice").cast("decimal(10,2)")
    cost = lambda share: (price * F.lit(share).cast("decimal(2,2)")).cast("decimal(10,2)").alias("cost")
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string").alias("product_id")
    own = [key, F.col("p_name").alias("product_name"), F.col("p_type").alias("category")]
    at = lambda day: F.lit(day).cast("timestamp").alias("updated_at")
    third = part.where("p_partkey % 3 = 0")
    return part.select(*own, cost("0.60"), at(FIRST_DAY)).unionByName(third.select(*own, cost("0.70"), at(CHANGE_DAY))).unionByName(third.where("p_partkey % 2 = 0").select(*own, cost("0.70"), at("1999-01-01")))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(product_log(spark, sf_dir), "product_id", "updated_at")


def customer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of customers: every fifth moves to the next nation on a day."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"), "c_custkey", "c_nationkey", F.col("c_mktsegment").alias("city"))
    first = customer.withColumns({"n_nationkey": F.col("c_nationkey"), "updated_at": F.lit(FIRST_DAY).cast("timestamp")})
    moved = customer.where("c_custkey % 5 = 0").withColumns({"n_nationkey": (F.col("c_nationkey") + 1) % 25, "updated_at": F.lit(CHANGE_DAY).cast("timestamp")})
    return first.unionByName(moved).join(nation, "n_nationkey", "left").select("customer_id", "country", "city", "updated_at")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(customer_log(spark, sf_dir), "customer_id", "updated_at")


def web_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a session for each user and day, and a channel from their properties."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").cast("timestamp").alias("event_timestamp"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        _renamed("event_type", EVENTS).alias("event_type"),
        F.element_at(F.array(*map(F.lit, CHANNELS)), (k % 6 + 1).cast("int")).alias("utm_source"),
        F.when(F.col("event_type") != "view", F.col("value").cast("string")).alias("product_id"),
    )
