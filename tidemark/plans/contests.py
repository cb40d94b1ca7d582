"""The canonical relation of paired contests, derived from orders and lineitem.

Two lines of an order by different suppliers are the two sides of a contest. One row for each side (an observation).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contest_id, event_day, grp, entity_id, opponent_id, attempts, successes, seconds, method, result, won.

    won is 1, 0, or null for draws and contests without a result. The shuffle is by order key only: both the ranking
    of lines and the pairing of sides use that partitioning.
    """
    lines = load(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_orderkey", "l_returnflag", "l_linestatus")
    by = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    both = Window.partitionBy("l_orderkey")
    first = lines.withColumn("rn", F.row_number().over(by)).filter("rn <= 2")
    other = lambda c: F.coalesce(F.lag(c).over(by), F.lead(c).over(by))
    paired = first.withColumns({f"o_{c}": other(c) for c in ("l_suppkey", "l_extendedprice", "l_tax", "l_returnflag")}).withColumn("n", F.count(F.lit(1)).over(both)).filter("n = 2 and l_suppkey <> o_l_suppkey")
    result = (
        F.when((F.col("l_returnflag") == "N") & (F.col("o_l_returnflag") == "N"), "no_contest")
        .when(F.col("l_tax") == F.col("o_l_tax"), "draw")
        .when(F.col("l_extendedprice") > F.col("o_l_extendedprice"), "win")
        .when(F.col("l_extendedprice") < F.col("o_l_extendedprice"), "loss")
        .otherwise("draw")
    )
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("event_day"), F.col("o_orderpriority").alias("grp"))
    return paired.join(orders, "l_orderkey").select(
        F.col("l_orderkey").alias("contest_id"),
        "event_day",
        "grp",
        F.col("l_suppkey").alias("entity_id"),
        F.col("o_l_suppkey").alias("opponent_id"),
        F.col("l_quantity").alias("attempts"),
        F.floor(F.col("l_quantity") * F.col("l_discount") * 10).cast("double").alias("successes"),
        (F.col("l_linenumber") * 60).cast("double").alias("seconds"),
        F.when(F.col("l_linestatus") == "O", "KO/TKO").when(F.col("l_returnflag") == "A", "Submission").otherwise("Decision").alias("method"),
        result.alias("result"),
        F.when(result == "win", 1).when(result == "loss", 0).alias("won"),
    )


#: The same relation for DuckDB, as the start of a WITH list; ends without a comma.
OBSERVATIONS_SQL = """
    lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS rn FROM lineitem),
    obs AS MATERIALIZED (
        SELECT a.l_orderkey AS contest_id, CAST(o.o_orderdate AS DATE) AS event_day, o.o_orderpriority AS grp, a.l_suppkey AS entity_id, b.l_suppkey AS opponent_id,
               a.l_quantity AS attempts, CAST(floor(a.l_quantity * a.l_discount * 10) AS DOUBLE) AS successes, CAST(a.l_linenumber * 60 AS DOUBLE) AS seconds,
               CASE WHEN a.l_linestatus = 'O' THEN 'KO/TKO' WHEN a.l_returnflag = 'A' THEN 'Submission' ELSE 'Decision' END AS method,
               CASE WHEN a.l_returnflag = 'N' AND b.l_returnflag = 'N' THEN 'no_contest' WHEN a.l_tax = b.l_tax THEN 'draw'
                    WHEN a.l_extendedprice > b.l_extendedprice THEN 'win' WHEN a.l_extendedprice < b.l_extendedprice THEN 'loss' ELSE 'draw' END AS result,
               CASE WHEN a.l_returnflag = 'N' AND b.l_returnflag = 'N' THEN NULL WHEN a.l_tax = b.l_tax THEN NULL
                    WHEN a.l_extendedprice > b.l_extendedprice THEN 1 WHEN a.l_extendedprice < b.l_extendedprice THEN 0 END AS won
        FROM lines a JOIN lines b ON a.l_orderkey = b.l_orderkey AND a.rn <= 2 AND b.rn <= 2 AND a.rn <> b.rn AND a.l_suppkey <> b.l_suppkey
        JOIN orders o ON o.o_orderkey = a.l_orderkey)"""
