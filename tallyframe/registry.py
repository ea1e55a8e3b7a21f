"""Registry of queries: each has a name, a function of the tables and, where SQL can express it, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> (function, sql)
REGISTERED: dict[str, tuple[Callable, str | None]] = {}
ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

#: The line items as an ordered event table: season, entity, 0/1 target, contexts and measurements.
EV = """ev AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_suppkey AS entity, l_partkey AS part, l_orderkey AS basket,
    CAST(year(l_shipdate) AS INTEGER) AS season, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_linestatus AS status, l_returnflag AS flag,
    l_linenumber AS line, l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax
  FROM lineitem)"""
ORD = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"


class Tables:
    """The tables of a folder; columns and rows are pruned by the scans."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        return self.lineitem.select(
            *ORDER, F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("basket"),
            F.year("l_shipdate").alias("season"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_linestatus").alias("status"),
            F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"),
            F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
        )


def query(name: str, sql: str | None = None):
    """Register a function of Tables under a name. `{EV}` in the SQL stands for the event table."""

    def add(f: Callable[[Tables], DataFrame]):
        if name in REGISTERED:
            raise ValueError(f"query {name} is registered twice")
        REGISTERED[name] = (f, sql and sql.replace("{EV}", EV).replace("{ORD}", ORD))
        return f

    return add


def r6(x):
    """Rounded to six digits, as both engines do alike."""
    return F.round(x, 6)
