"""Sparse matrices as DataFrames of (i, j, v)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.plans.state import written

SCHEMA = "i long, j long, v double"


@dataclass(frozen=True)
class SparseMatrix:
    """Entries (i, j, v) with 0 <= i < n_rows and 0 <= j < n_cols; entries at the same place add up."""

    entries: DataFrame
    n_rows: int
    n_cols: int

    @classmethod
    def of(cls, entries: DataFrame, n_rows: int, n_cols: int) -> SparseMatrix:
        return cls(entries.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")), n_rows, n_cols)

    @classmethod
    def from_csr(cls, spark: SparkSession, values: list[float], columns: list[int], row_starts: list[int], n_cols: int) -> SparseMatrix:
        """A literal matrix in compressed rows; the arrays are checked."""
        if len(values) != len(columns):
            raise ValueError("values and columns differ in length")
        if row_starts[0] < 0 or row_starts[-1] != len(values) or any(a > b for a, b in zip(row_starts, row_starts[1:])):
            raise ValueError("row starts must ascend to the number of values")
        if any(not 0 <= c < n_cols for c in columns):
            raise ValueError("column out of range")
        rows = [(r, columns[k], float(values[k])) for r in range(len(row_starts) - 1) for k in range(row_starts[r], row_starts[r + 1])]
        return cls(spark.createDataFrame(rows, SCHEMA), len(row_starts) - 1, n_cols)

    @classmethod
    def empty(cls, spark: SparkSession, n_cols: int, n_rows: int) -> SparseMatrix:
        return cls(spark.createDataFrame([], SCHEMA), n_rows, n_cols)

    @classmethod
    def unit(cls, spark: SparkSession, n: int) -> SparseMatrix:
        return cls(spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")), n, n)

    @property
    def spark(self) -> SparkSession:
        return self.entries.sparkSession

    def validated(self) -> SparseMatrix:
        inside = F.col("i").between(0, self.n_rows - 1) & F.col("j").between(0, self.n_cols - 1) & F.col("v").isNotNull()
        if bad := self.entries.where(~F.coalesce(inside, F.lit(False))).take(1):
            raise ValueError(f"entry outside the {self.n_rows} x {self.n_cols} matrix: {bad[0]}")
        return self

    def kept(self) -> SparseMatrix:
        """The same matrix, computed once: what an iteration reads again and again."""
        return SparseMatrix(written(self.entries), self.n_rows, self.n_cols)

    def bucketed(self, name: str, parts: int) -> SparseMatrix:
        """The same matrix as a table bucketed and sorted by column: joining it with a vector moves the vector alone."""
        self.entries.repartition(parts, "j").write.bucketBy(parts, "j").sortBy("j").saveAsTable(name)
        return SparseMatrix(self.spark.table(name), self.n_rows, self.n_cols)

    def n_values(self) -> int:
        return self.entries.count()

    def transpose(self) -> SparseMatrix:
        return SparseMatrix(self.entries.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.n_cols, self.n_rows)

    def stack_below(self, other: SparseMatrix) -> SparseMatrix:
        if self.n_cols != other.n_cols:
            raise ValueError("numbers of columns differ")
        moved = other.entries.withColumn("i", F.col("i") + self.n_rows)
        return SparseMatrix(self.entries.unionByName(moved), self.n_rows + other.n_rows, self.n_cols)

    def stack_right(self, other: SparseMatrix) -> SparseMatrix:
        if self.n_rows != other.n_rows:
            raise ValueError("numbers of rows differ")
        moved = other.entries.withColumn("j", F.col("j") + self.n_cols)
        return SparseMatrix(self.entries.unionByName(moved), self.n_rows, self.n_cols + other.n_cols)

    def rows_between(self, first: int, end: int) -> SparseMatrix:
        """Rows first to end - 1 as a matrix of their own, with all columns."""
        part = self.entries.where((F.col("i") >= first) & (F.col("i") < end)).withColumn("i", F.col("i") - first)
        return SparseMatrix(part, end - first, self.n_cols)

    def scaled_columns(self) -> SparseMatrix:
        """Every column divided by its sum: column-stochastic where no column sums to zero."""
        sums = self.entries.groupBy("j").agg(F.sum("v").alias("s"))
        return SparseMatrix(self.entries.join(sums, "j").select("i", "j", (F.col("v") / F.col("s")).alias("v")), self.n_rows, self.n_cols)

    def row_counts(self) -> DataFrame:
        """(i, n) for every row, empty ones too."""
        zero = self.spark.range(self.n_rows).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("n"))
        return self.entries.select("i", F.lit(1).cast("long").alias("n")).unionByName(zero).groupBy("i").agg(F.sum("n").alias("n"))

    def row_starts(self, block: int = 1 << 16) -> DataFrame:
        """(i, start, end): where each row lies among the entries by rows. Sums run within blocks of rows and over the
        blocks' totals, so that no task holds all rows."""
        counts = self.row_counts().withColumn("block", F.floor(F.col("i") / block))
        before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.groupBy("block").agg(F.sum("n").alias("total")).withColumn("offset", F.coalesce(F.sum("total").over(before), F.lit(0)))
        running = F.sum("n").over(Window.partitionBy("block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
        return counts.withColumn("running", running).join(offsets, "block").select("i", (F.col("offset") + F.col("running") - F.col("n")).alias("start"), (F.col("offset") + F.col("running")).alias("end"))

    def packed_rows(self) -> DataFrame:
        """(i, entries): each row's (j, v) in the order of columns; rows without entries have an empty array."""
        packed = self.entries.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("entries"))
        index = self.spark.range(self.n_rows).select(F.col("id").alias("i"))
        return index.join(packed, "i", "left").select("i", F.coalesce("entries", F.array().cast("array<struct<j:bigint,v:double>>")).alias("entries"))

    def grid(self) -> DataFrame:
        """(i, line): the matrix as lines of text, ``_`` where nothing is stored. For small matrices."""
        cells = F.transform(F.sequence(F.lit(0), F.lit(self.n_cols - 1)), lambda k: F.array_join(F.transform(F.filter("entries", lambda e: e["j"] == k), lambda e: e["v"].cast("string")), "+"))
        return self.packed_rows().select("i", F.array_join(F.transform(cells, lambda c: F.when(c == "", F.lit("_")).otherwise(c)), " ").alias("line"))

    def show(self) -> None:
        for row in self.grid().orderBy("i").toLocalIterator():
            print(row["line"])


def row_blocks(spark: SparkSession, n: int, parts: int) -> DataFrame:
    """(part, first, end): contiguous blocks of n rows; some are empty if there are more parts than rows."""
    edge = lambda k: F.floor(F.lit(n).cast("long") * k / parts).cast("long")
    return spark.range(parts).select(F.col("id").alias("part"), edge(F.col("id")).alias("first"), edge(F.col("id") + 1).alias("end"))


def partitioned_by_rows(m: SparseMatrix, parts: int) -> SparseMatrix:
    """The same matrix with equal rows in one partition."""
    return SparseMatrix(m.entries.repartition(parts, "i"), m.n_rows, m.n_cols)
