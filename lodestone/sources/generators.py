"""Seeded random matrices. A draw is a number made of the MD5 of seed, purpose and place, so that it does not depend on
partitions and any engine that has MD5 makes the same matrix.

The columns of a row are the first different ones of a series of draws, so that the work follows the entries, not the
places. Rows that are more than half full are made from all their places instead."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.matrix import SparseMatrix


def draw(seed: int, purpose: str, *place) -> Column:
    """Uniform in [0, 1)."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *[F.col(p).cast("string") for p in place])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def cells(spark: SparkSession, first: int, end: int, n_cols: int) -> DataFrame:
    rows = spark.range(first, end).select(F.col("id").alias("i"))
    return rows.select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_cols - 1).cast("long"))).alias("j"))


def draws_for(wanted: int, places: int) -> int:
    """Draws among places that nearly always give wanted different ones."""
    return wanted + math.ceil(places * -math.log1p(-wanted / places) - wanted + 6 * math.sqrt(wanted)) + 8


def chosen(spark: SparkSession, first: int, end: int, per_row: int, seed: int, n_cols: int, diagonal: bool) -> DataFrame:
    """(i, j): per_row different columns of each row from first to end - 1; with diagonal, (i, i) among them.

    If the draws of a row should not give enough, the columns from the row's own on follow them.
    """
    own = F.when(F.lit(diagonal), F.array("i")).otherwise(F.array().cast("array<bigint>"))
    if 2 * per_row <= n_cols:
        series = F.sequence(F.lit(0), F.lit(draws_for(per_row, n_cols) - 1))
        text = lambda t: F.concat_ws(":", F.lit(str(seed)), F.lit("draw"), F.col("i").cast("string"), t.cast("string"))
        drawn = F.transform(series, lambda t: F.floor(F.conv(F.substring(F.md5(text(t)), 1, 13), 16, 10).cast("double") / F.lit(2.0**52) * n_cols))
        more = F.transform(F.sequence(F.lit(0), F.lit(per_row - 1)), lambda t: F.pmod(F.col("i") + t, F.lit(n_cols)).cast("long"))
        different = F.slice(F.array_distinct(F.concat(own, drawn, more)), 1, per_row)
        return spark.range(first, end).select(F.col("id").alias("i")).select("i", F.explode(different).alias("j"))
    u = draw(seed, "cell", "i", "j")
    ranked = cells(spark, first, end, n_cols).withColumn("o", F.when(F.lit(diagonal) & (F.col("i") == F.col("j")), F.lit(-1.0)).otherwise(u))
    rank = F.row_number().over(Window.partitionBy("i").orderBy("o", "j"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= per_row).select("i", "j")


def row_stochastic(spark: SparkSession, n: int, density: float, seed: int, n_cols: int | None = None) -> SparseMatrix:
    """Every row has floor(density * n_cols) entries in different columns, each one over their number."""
    n_cols = n if n_cols is None else n_cols
    k = math.floor(density * n_cols)
    if k < 1:
        raise ValueError("density leaves rows empty")
    places = chosen(spark, 0, n, k, seed, n_cols, False)
    return SparseMatrix(places.select("i", "j", F.lit(1.0 / k).alias("v")), n, n_cols)


def column_stochastic(spark: SparkSession, n: int, density: float, seed: int) -> SparseMatrix:
    """The transpose of row_stochastic with the same seed."""
    return row_stochastic(spark, n, density, seed).transpose()


def diagonally_dominant(spark: SparkSession, n: int, density: float, seed: int) -> SparseMatrix:
    """ceil(density * n) entries in each row with the diagonal: others in [1, 10) + 0.0625, the diagonal in
    [dn * 10, dn * 10 + 10), entry (0, 0) (3 dn - 2) * 10 + 11, so that it dominates."""
    k = math.ceil(density * n)
    if k < 1:
        raise ValueError("density leaves rows empty")
    u = draw(seed, "value", "i", "j")
    value = F.when((F.col("i") == 0) & (F.col("j") == 0), F.lit((3 * k - 2) * 10.0 + 11)).when(F.col("i") == F.col("j"), k * 10 + u * 10).otherwise(1 + u * 9 + 0.0625)
    return SparseMatrix(chosen(spark, 0, n, k, seed, n, True).select("i", "j", value.alias("v")), n, n)


def diagonally_dominant_slice(spark: SparkSession, n: int, density: float, seed: int, first: int, last: int) -> SparseMatrix:
    """Rows first to last, last included, of a wide-ranged diagonally dominant matrix: others in [1, 10000) + 0.0625,
    the diagonal in [n * 10000 + 1, n * 10001 + 1). Row numbers start at 0 again."""
    k = math.ceil(density * n)
    if k < 1:
        raise ValueError("density leaves rows empty")
    u = draw(seed, "value", "i", "j")
    value = F.when(F.col("i") == F.col("j"), n * 10000.0 + 1 + u * n).otherwise(1 + u * 9999 + 0.0625)
    places = chosen(spark, first, last + 1, k, seed, n, True).select("i", "j", value.alias("v"))
    return SparseMatrix(places.withColumn("i", F.col("i") - first), last + 1 - first, n)


def fixed_eta(spark: SparkSession, n: int, density: float, eta: float, seed: int) -> SparseMatrix:
    """The two largest eigenvalues are 10 and 10 * eta: two rows hold only them, on the diagonal; in the other rows the
    diagonal is in (l2 / 4, 3 l2 / 4] and the others are so small that no Gershgorin disc reaches l2."""
    if not 0 < eta < 1:
        raise ValueError("eta must lie between 0 and 1")
    k = math.ceil(density * n)
    if density * n < 2:
        raise ValueError("density * n must be 2 at least")
    l1, l2 = 10.0, 10.0 * eta
    most = 0.9 * (l2 - 0.75 * l2) / math.floor(density * n - 1)
    first = spark.range(n).select(F.col("id").alias("i")).orderBy(draw(seed, "eta", "i"), "i").limit(2)
    top = [r["i"] for r in first.collect()]
    u = draw(seed, "value", "i", "j")
    special = F.col("i").isin(top)
    value = F.when(special, F.when(F.col("i") == top[0], l1).otherwise(l2)).when(F.col("i") == F.col("j"), 0.75 * l2 - u * (0.5 * l2)).otherwise(most * (1 - u))
    places = chosen(spark, 0, n, k, seed, n, True).where(~special | (F.col("i") == F.col("j")))
    return SparseMatrix(places.select("i", "j", value.alias("v")), n, n)


def random(spark: SparkSession, width: int, height: int, density: float, seed: int) -> SparseMatrix:
    """Exactly ceil(width * height * density) entries in different places, values in [0.001, 100000).

    Of a series of draws the first different places are taken, or of all places those with the least draws where more
    than half are wanted: counted in a histogram first, so that only the last class has to be sorted.
    """
    places = width * height
    wanted, classes = math.ceil(places * density), 4096
    n = draws_for(wanted, places) if 2 * wanted <= places else 0
    while True:
        if n:
            each = spark.range(n).select(F.col("id").alias("t"))
            place = F.floor(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("place"), F.col("t").cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(2.0**52) * places)
            at = each.select("t", place.alias("p")).groupBy("p").agg(F.min("t").alias("t"))
            drawn = at.select(F.floor(F.col("p") / width).alias("i"), (F.col("p") % width).alias("j"), F.col("t").alias("u"), F.floor(F.col("t") * classes / n).alias("c"))
        else:
            drawn = cells(spark, 0, height, width).withColumn("u", draw(seed, "cell", "i", "j")).withColumn("c", F.floor(F.col("u") * classes))
        counts = {r["c"]: r["n"] for r in drawn.groupBy("c").agg(F.count("*").alias("n")).collect()}
        if not n or sum(counts.values()) >= wanted:
            break
        n *= 2  # hardly ever
    taken = last = 0
    while last < classes and taken + counts.get(last, 0) <= wanted:
        taken += counts.get(last, 0)
        last += 1
    rest = drawn.where(F.col("c") == last).orderBy("u", "i", "j").limit(wanted - taken)
    value = 0.001 + draw(seed, "value", "i", "j") * (100000 - 0.001)
    return SparseMatrix(drawn.where(F.col("c") < last).unionByName(rest).select("i", "j", value.alias("v")), height, width)
