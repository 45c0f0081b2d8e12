"""Matrices made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.matrix import SparseMatrix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counted(edges: DataFrame) -> DataFrame:
    return edges.groupBy("i", "j").agg(F.count("*").cast("double").alias("v"))


def nation_trade(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Line items by nation of supplier (i) and customer (j); 25 nations, counts."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("j"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customers, "o_custkey")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("i"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").join(suppliers, "l_suppkey")
    return SparseMatrix.of(counted(lines.join(orders, "o_orderkey")), 25, 25)


def supplier_orders(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """How often two suppliers share an order, over pairs of its line items."""
    n = table(spark, sf_dir, "supplier").count()
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("i")).groupBy("l_orderkey", "i").agg(F.count("*").alias("a"))
    other = lines.select("l_orderkey", F.col("i").alias("j"), F.col("a").alias("b"))
    pairs = lines.join(other, "l_orderkey").where("i < j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))
    both = F.inline(F.array(F.struct("i", "j", "v"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "v")))
    return SparseMatrix.of(pairs.select(both), n, n)


def user_hops(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """From the user of an event (j) to the user of the next one (i). The order is made within days, and the last event
    of a day is joined with the first of the next day that has any, so that no task orders all events."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id").withColumn("day", F.to_date("ts"))
    n = events.agg(F.max("user_id")).first()[0] + 1
    within = Window.partitionBy("day").orderBy("ts", "event_id")
    next_user = F.lead("user_id").over(within)
    inside = events.withColumn("next", next_user).where("next is not null").select(F.col("next").alias("i"), F.col("user_id").alias("j"))
    stamp = F.struct("ts", "event_id", "user_id")
    days = events.groupBy("day").agg(F.min(stamp).alias("first"), F.max(stamp).alias("last"))
    across = days.withColumn("next", F.lead("first").over(Window.orderBy("day"))).where("next is not null").select(F.col("next.user_id").alias("i"), F.col("last.user_id").alias("j"))
    return SparseMatrix.of(counted(inside.unionByName(across)), n, n)


def part_supplier(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Parts and suppliers of line items, both ways; suppliers follow the parts."""
    parts, suppliers = table(spark, sf_dir, "part").count(), table(spark, sf_dir, "supplier").count()
    pairs = counted(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("i"), (F.col("l_suppkey") + parts).alias("j")))
    both = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return SparseMatrix.of(both, parts + suppliers, parts + suppliers)


def embedding_gram(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Products of the embeddings' components, summed over vectors. A vector's products are made within its row, so
    that the shuffle has partial sums of a matrix as small as the components' number squared."""
    vectors = table(spark, sf_dir, "embeddings").select("embedding")
    n = vectors.agg(F.max(F.size("embedding"))).first()[0]
    left = vectors.select("embedding", F.posexplode("embedding").alias("i", "a"))
    pairs = left.select("i", "a", F.posexplode("embedding").alias("j", "b"))
    return SparseMatrix.of(pairs.groupBy("i", "j").agg(F.sum(F.col("a").cast("double") * F.col("b").cast("double")).alias("v")), n, n)
