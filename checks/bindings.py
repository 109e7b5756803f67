"""The given tables in the shape of the failure facts, with the report instant of each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmetrics.session import session_zone


@dataclass(frozen=True)
class Binding:
    """One table as facts: Spark columns for the queries, SQL texts for the oracle."""

    table: str
    report_ts: str
    columns: Callable[[], dict[str, Column]]
    sql: dict[str, str]

    def facts(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The event times carry no zone in the files; they are UTC."""
        with session_zone(spark, "UTC"):
            table = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
            return table.select(*[c.alias(name) for name, c in self.columns().items()])

    @property
    def facts_sql(self) -> str:
        columns = ", ".join(f"{expr} AS {name}" for name, expr in self.sql.items())
        return f"SELECT {columns} FROM {self.table}"


EVENTS = Binding(
    "events",
    "2024-01-30T12:00:00Z",
    lambda: {
        "site": F.concat(F.lit("site_"), F.col("user_id")),
        "timestamp": F.col("ts").cast("timestamp"),
        "failure_type": F.col("event_type"),
        "document_id": F.col("event_id").cast("string"),
    },
    {
        "site": "'site_' || user_id",
        "timestamp": "ts",
        "failure_type": "event_type",
        "document_id": "CAST(event_id AS VARCHAR)",
    },
)

ORDERS = Binding(
    "orders",
    "1998-12-01T00:00:00Z",
    lambda: {
        "site": F.concat(F.lit("site_"), F.col("o_custkey")),
        "timestamp": F.col("o_orderdate").cast("timestamp"),
        "failure_type": F.col("o_orderpriority"),
        "document_id": F.col("o_orderkey").cast("string"),
    },
    {
        "site": "'site_' || o_custkey",
        "timestamp": "o_orderdate",
        "failure_type": "o_orderpriority",
        "document_id": "CAST(o_orderkey AS VARCHAR)",
    },
)

LINEITEM = Binding(
    "lineitem",
    "1998-12-01T00:00:00Z",
    lambda: {
        "site": F.concat(F.lit("site_"), F.col("l_suppkey")),
        "timestamp": F.col("l_shipdate").cast("timestamp"),
        "failure_type": F.col("l_returnflag"),
        "document_id": F.concat_ws("-", "l_orderkey", "l_linenumber"),
    },
    {
        "site": "'site_' || l_suppkey",
        "timestamp": "l_shipdate",
        "failure_type": "l_returnflag",
        "document_id": "l_orderkey || '-' || l_linenumber",
    },
)


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(custkey, client)``: the market segment of each customer; one segment counts as unknown."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    segment = F.nullif(F.col("c_mktsegment"), F.lit(UNKNOWN_SEGMENT))
    return customers.select(F.col("c_custkey").alias("custkey"), segment.alias("client"))


def client_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as facts, with the client of their customer; NULL if there is none."""
    with session_zone(spark, "UTC"):
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        columns = [c.alias(name) for name, c in ORDERS.columns().items()]
        facts = orders.select(*columns, F.col("o_custkey").alias("custkey"))
    return facts.join(clients(spark, sf_dir), "custkey", "left").drop("custkey")


UNKNOWN_SEGMENT = "MACHINERY"
CLIENT_ORDERS_SQL = (
    f"SELECT o.*, NULLIF(c.c_mktsegment, '{UNKNOWN_SEGMENT}') AS client"
    f" FROM ({ORDERS.facts_sql}) o LEFT JOIN customer c ON o.site = 'site_' || c.c_custkey"
)
