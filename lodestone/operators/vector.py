"""Sparse matrix-vector products, norms and differences of vectors (i, x)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.codec import cut
from lodestone.operators.matrix import SparseMatrix

#: A vector of at most so many numbers (16 bytes each) goes to all tasks; a longer one is joined by its index.
BROADCAST_ROWS = 1_000_000


def constant(spark, n: int, value: float) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.lit(float(value)).alias("x"))


def products(a: SparseMatrix, x: DataFrame, in_bytes: int) -> DataFrame:
    """(i, p): the products whose sums by i are a x, x cut to in_bytes."""
    read = cut(x.select(F.col("i").alias("j"), "x"), "x", F.col("x"), in_bytes)
    if a.n_cols <= BROADCAST_ROWS:
        read = F.broadcast(read)
    return a.entries.join(read, "j").select("i", (F.col("v") * F.col("x")).alias("p"))


def spmv(a: SparseMatrix, x: DataFrame, in_bytes: int = 8, out_bytes: int = 8, damping: float | None = None) -> DataFrame:
    """(i, x) of the product, one row for each row of a.

    x is cut to in_bytes when read and the result to out_bytes when written; products and sums are doubles. With damping
    c the result is c * sum + (1 - c) / n_cols. Rows without entries come out of a zero for each row that is summed with
    the products, so there is one shuffle, after partial sums.
    """
    zeros = a.spark.range(a.n_rows).select(F.col("id").alias("i"), F.lit(0.0).alias("p"))
    sums = products(a, x, in_bytes).unionByName(zeros).groupBy("i").agg(F.sum("p").alias("z"))
    return cut(sums.select("i", damped(F.col("z"), damping, a.n_cols).alias("x")), "x", F.col("x"), out_bytes)


def spmv_with_old(a: SparseMatrix, x: DataFrame, in_bytes: int, out_bytes: int, damping: float | None) -> DataFrame:
    """(i, x, before): spmv of a square matrix beside the vector itself, whose rows take the place of the zeros."""
    old = x.select("i", F.lit(0.0).alias("p"), F.col("x").alias("before"))
    sums = products(a, x, in_bytes).withColumn("before", F.lit(None).cast("double")).unionByName(old).groupBy("i").agg(F.sum("p").alias("z"), F.max("before").alias("before"))
    return cut(sums.select("i", damped(F.col("z"), damping, a.n_cols).alias("x"), "before"), "x", F.col("x"), out_bytes).select("i", "x", "before")


def damped(z: Column, damping: float | None, n: int) -> Column:
    return z if damping is None else F.lit(damping) * z + F.lit((1 - damping) / n)


def norm_column(x: Column, p: int) -> Column:
    if p == 1:
        return F.sum(F.abs(x))
    return F.pow(F.sum(F.pow(F.abs(x), F.lit(float(p)))), F.lit(1.0 / p))


def norm(x: DataFrame, p: int, width: int = 8) -> float:
    return cut(x.select("x"), "x", F.col("x"), width).agg(norm_column(F.col("x"), p)).first()[0] or 0.0


def normalise(x: DataFrame, p: int, width: int = 8) -> tuple[DataFrame, bool]:
    """x divided by its norm, read and written at the width; x itself and False if the norm is zero."""
    size = norm(x, p, width)
    if size == 0:
        return x, False
    read = cut(x.select("i", "x"), "x", F.col("x"), width)
    return cut(read, "x", F.col("x") / F.lit(size), width), True


def l1_difference(a: DataFrame, b: DataFrame, width: int = 8) -> float:
    left = cut(a.select("i", "x"), "x", F.col("x"), width)
    right = cut(b.select("i", F.col("x").alias("y")), "y", F.col("y"), width)
    return left.join(right, "i").agg(F.sum(F.abs(F.col("x") - F.col("y")))).first()[0] or 0.0


def elementwise_product(rows: DataFrame, a: str, b: str, width: int, name: str = "x") -> DataFrame:
    """rows with the product of two columns, read and written at the width."""
    read = cut(cut(rows, "_lodestone_l", F.col(a).cast("double"), width), "_lodestone_r", F.col(b).cast("double"), width)
    return cut(read, name, F.col("_lodestone_l") * F.col("_lodestone_r"), width).drop("_lodestone_l", "_lodestone_r")


def duplicates(rows: DataFrame, column: str) -> DataFrame:
    """(column, n): the values that occur more than once, and how often."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def lines(x: DataFrame, part: Column | None = None) -> DataFrame:
    """(part, line): the numbers of a vector in the order of i as one line of text for each part, for small vectors."""
    placed = x.select((F.lit(0) if part is None else part).cast("long").alias("part"), F.struct("i", "x").alias("e"))
    return placed.groupBy("part").agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["x"].cast("string")), " ").alias("line"))
