"""Entity contracts: columns, types, primary key and version column, declared in Spark's types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Contract:
    """One entity. ``version`` breaks ties between rows of a key; an immutable entity has its key there."""

    name: str
    schema: T.StructType
    key: str
    version: str
    history: bool = False

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    @property
    def mutable(self) -> bool:
        return self.version != self.key

    def landing(self) -> T.StructType:
        """The same columns as nullable text, which is how batches arrive."""
        return T.StructType([T.StructField(c, T.StringType(), True) for c in self.columns])

    def nullable(self) -> T.StructType:
        """The typed columns, all nullable, which is how tables are created."""
        return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in self.schema])


#: The types that contracts take. Money is never floating.
KINDS: dict[str, T.DataType] = {
    "string": T.StringType(), "timestamp": T.TimestampType(), "date": T.DateType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "decimal(10,2)": T.DecimalType(10, 2), "decimal(12,2)": T.DecimalType(12, 2),
}


def _contract(name: str, columns: str, version: str | None = None, history: bool = False) -> Contract:
    """A contract of 'name type, name type'; without Spark's parser, which needs a session."""
    fields = []
    for column in columns.split(", "):
        own, kind = column.split(" ")
        if kind not in KINDS:
            raise ValueError(f"{name}.{own} has the type {kind}, which contracts don't take")
        fields.append(T.StructField(own, KINDS[kind], bool(fields)))
    return Contract(name, T.StructType(fields), fields[0].name, version or fields[0].name, history)


CONTRACTS: dict[str, Contract] = {
    c.name: c
    for c in (
        _contract("customers", "customer_id string, first_name string, last_name string, email string, country string, city string, registration_date date, updated_at timestamp", "updated_at", True),
        _contract("products", "product_id string, product_name string, category string, subcategory string, brand string, price decimal(10,2), cost decimal(10,2), is_active boolean, updated_at timestamp", "updated_at", True),
        _contract("orders", "order_id string, customer_id string, order_date timestamp, status string, payment_method string, shipping_country string, gross_amount decimal(12,2), discount_amount decimal(12,2), total_amount decimal(12,2), created_at timestamp, updated_at timestamp", "updated_at"),
        _contract("order_items", "order_item_id string, order_id string, product_id string, quantity int, unit_price decimal(10,2), discount_amount decimal(10,2), line_total decimal(12,2)"),
        _contract("payments", "payment_id string, order_id string, payment_method string, amount decimal(12,2), payment_status string, payment_date timestamp, updated_at timestamp", "updated_at"),
        _contract("returns", "return_id string, order_id string, order_item_id string, product_id string, quantity int, reason string, refund_amount decimal(12,2), return_date timestamp"),
        _contract("reviews", "review_id string, order_id string, product_id string, customer_id string, rating int, review_date timestamp"),
        _contract("web_events", "event_id string, event_timestamp timestamp, session_id string, customer_id string, event_type string, product_id string, device string, utm_source string"),
    )
}

#: Columns that ingestion adds; they stay in the raw tables.
LINEAGE = ("_ingestion_timestamp", "_source_file", "_batch_id", "_pipeline_run_id")
#: Columns that a history table has in place of the version column.
VALIDITY = ("valid_from", "valid_to", "is_current")


def contract(entity: str) -> Contract:
    if entity not in CONTRACTS:
        raise ValueError(f"unknown entity {entity!r}; known: {', '.join(CONTRACTS)}")
    return CONTRACTS[entity]


def history_schema(entity: str) -> T.StructType:
    c = contract(entity)
    own = [f for f in c.nullable() if f.name != c.version]
    return T.StructType([*own, T.StructField("valid_from", T.TimestampType()), T.StructField("valid_to", T.TimestampType()), T.StructField("is_current", T.BooleanType())])


def quarantine_schema(entity: str) -> T.StructType:
    return T.StructType([*contract(entity).nullable(), T.StructField("_errors", T.ArrayType(T.StringType()))])
