"""Iterating a vector to a fixpoint, by two plans with the same steps, the same errors and the same metadata.

The array plan runs in one task, with numpy over Arrow, and in more of them, at the same time, where a matrix has more than
ARRAY_VALUES entries: each holds some rows, and the first gathers the product's numbers and sends them to all. It is for
matrices of at most ARRAY_ROWS rows, TASK_VALUES entries for each task that can run at the same time, and steps that send
SENT numbers together; a step takes less time than a Spark job does, and sums are always made in the same order. The join plan takes any size: each step is a product by join
and aggregation, written to the shared folder (which cuts the lineage and survives lost executors). The old vector
travels with the products, so that the job that writes a step also sums the differences, and only that sum returns to the
driver; a step's table goes when the next one is written. Where the vector is too long to broadcast, the matrix is
bucketed by column once, so that no step moves it for the join.
"""

from __future__ import annotations

import math
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodestone.functions.codec import adjusted_epsilon, cut
from lodestone.operators import vector
from lodestone.operators.matrix import SparseMatrix
from lodestone.operators.vector import spmv_with_old
from lodestone.plans import local
from lodestone.plans.state import discard, written

ARRAY_ROWS, ARRAY_VALUES, TASK_VALUES = 2_000_000, 2_000_000, 16_000_000
SENT = 1 << 24
BASE_EPSILON = 10 * 2.0**-52


@dataclass(frozen=True)
class Stage:
    """One run of iterations at a width.

    power: iterate A x with the product cut to the width and then normalised (L2) in double; otherwise PageRank steps,
    with the whole state cut to the width, from an initial vector normalised (L1) at it. renormalize: L1 after each
    step. every_third: sum the differences of every third number only. start_normalised: normalise the first vector.
    """

    width: int = 8
    power: bool = False
    damping: float = 0.85
    epsilon: float = BASE_EPSILON
    renormalize: bool = False
    every_third: bool = False
    start_normalised: bool = True

    @property
    def tolerance(self) -> float:
        return adjusted_epsilon(self.width, self.epsilon)

    @property
    def state_width(self) -> int:
        return 8 if self.power else self.width


@dataclass
class StageRun:
    stage: int
    converged: bool
    iterations: int
    total_ns: int = 0
    prep_ns: int = 0
    spmv_ns: list[int] = field(default_factory=list)
    exchange_ns: list[int] = field(default_factory=list)
    overhead_ns: list[int] = field(default_factory=list)


META = "stage int, converged boolean, iterations int, total_ns long, prep_ns long, spmv_ns array<long>, exchange_ns array<long>, overhead_ns array<long>"


@dataclass
class Result:
    """vector: (i, x). metadata: a row for each stage."""

    vector: DataFrame
    metadata: DataFrame


def fixpoint(a: SparseMatrix, initial: DataFrame, stages: list[Stage], limit: int = 1000, plan: str = "auto") -> Result:
    """Run the stages one after the other on one budget of limit iterations; a stage starts even if the one before it
    did not converge. A stage that cannot normalise its first vector returns it as it is, with no iteration."""
    if a.n_rows != a.n_cols:
        raise ValueError("the matrix must be square")
    kept = a
    if plan == "auto":
        kept = a.kept()
        tasks = array_tasks(kept)
        plan = "array" if tasks else "join"
    else:
        tasks = 1
    result = array_plan(kept, initial, stages, limit, tasks) if plan == "array" else join_plan(kept, initial, stages, limit)
    if kept is not a:
        discard(kept.entries)
    return result


def checked(finite: bool) -> None:
    if not finite:
        raise ArithmeticError("the iteration left the finite numbers")


def slots(spark) -> int:
    """How many tasks can run at the same time; executors that come and go cannot hold a barrier stage."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 1
    context = spark.sparkContext._jsc.sc()
    return context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())


def array_tasks(a: SparseMatrix) -> int:
    """How many tasks the array plan takes for a matrix, 0 where it is too large for it."""
    if a.n_rows > ARRAY_ROWS:
        return 0
    values = a.n_values()
    if values <= ARRAY_VALUES:
        return 1
    tasks = max(1, min(-(-values // ARRAY_VALUES), slots(a.spark), SENT // a.n_rows))
    return tasks if values <= tasks * TASK_VALUES else 0


def array_plan(a: SparseMatrix, initial: DataFrame, stages: list[Stage], limit: int, tasks: int = 1) -> Result:
    rows = a.entries.select("i", "j", "v").unionByName(initial.select("i", F.lit(-1).cast("long").alias("j"), F.col("x").alias("v")))
    dealt = rows.repartition(1) if tasks == 1 else rows.repartitionById(tasks, F.pmod(F.hash("i"), F.lit(tasks)))
    dealt = dealt.sortWithinPartitions(F.col("i") * (a.n_cols + 1) + F.col("j"))  # Spark sorts one number by its bits
    run = local.task(stages, limit, a.n_rows, tasks > 1)
    found = written(dealt.mapInArrow(run, "i long, x double, " + META.replace("converged boolean", "converged boolean, finite boolean"), barrier=tasks > 1))
    metadata = found.where("stage is not null")
    checked(all(r["finite"] for r in metadata.select("finite").collect()))  # a row for each stage
    return Result(found.where("stage is null").select("i", "x"), metadata.drop("i", "x", "finite"))


# The join plan: a driver loop.


def observed(rows: DataFrame, value) -> tuple[DataFrame, float]:
    """rows written, and the sum of value over them, by the same job."""
    seen = Observation()
    out = written(rows.observe(seen, F.sum(value).alias("s")))
    return out, seen.get["s"] or 0.0


def divided(rows: DataFrame, size: float, width: int) -> DataFrame:
    return cut(rows, "x", F.col("x") / F.lit(size), width)


def stepped(a: SparseMatrix, x: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame, float] | None:
    """(the table written, the next vector (i, x), the sum of differences); None if there is nothing to divide by."""
    counted = (F.col("i") % 3 == 0) if stage.every_third else F.lit(True)
    apart = F.when(counted, F.abs(F.col("x") - F.col("before")))
    if not (stage.power or stage.renormalize):
        table, difference = observed(spmv_with_old(a, x, stage.width, stage.width, stage.damping), apart)
        return table, table.select("i", "x"), difference
    raw = spmv_with_old(a, x, 8, stage.width, None if stage.power else stage.damping)
    table, total = observed(raw, F.col("x") * F.col("x") if stage.power else F.abs("x"))
    size = math.sqrt(total) if stage.power else total
    if not size:
        discard(table)
        return None
    new = divided(table, size, stage.state_width)
    return table, new.select("i", "x"), new.agg(F.sum(apart)).first()[0] or 0.0


def join_stage(a: SparseMatrix, initial: DataFrame, stage: Stage, budget: int, number: int) -> tuple[DataFrame, DataFrame, StageRun]:
    """(the table that the vector is read from, the vector, the stage's metadata)"""
    began = time.monotonic_ns()
    run = StageRun(number, False, 0)
    value = F.col("x") * F.col("x") if stage.power else F.abs("x")
    table, total = observed(cut(initial.select("i", "x"), "x", F.col("x"), stage.state_width), value)
    x = table
    if stage.start_normalised:
        size = math.sqrt(total) if stage.power else total
        if not size:
            return table, x, run
        x = divided(table, size, stage.state_width)
    run.prep_ns = time.monotonic_ns() - began
    while not run.converged and run.iterations < budget:
        t0 = time.monotonic_ns()
        step = stepped(a, x, stage)
        if step is None:
            break
        t1 = time.monotonic_ns()
        old, (table, x, difference) = table, step
        discard(old)
        checked(math.isfinite(difference))
        run.converged = difference < stage.tolerance
        run.iterations += 1
        run.spmv_ns.append(t1 - t0)  # the product, its shuffle and the difference are one job
        run.exchange_ns.append(0)
        run.overhead_ns.append(time.monotonic_ns() - t1)
    run.total_ns = time.monotonic_ns() - began
    return table, x, run


def join_plan(a: SparseMatrix, initial: DataFrame, stages: list[Stage], limit: int) -> Result:
    spark, x, runs, left = a.spark, initial, [], limit
    large = a.n_cols > vector.BROADCAST_ROWS
    name = f"lodestone_{uuid.uuid4().hex}"
    a = a.bucketed(name, int(spark.conf.get("spark.sql.shuffle.partitions"))) if large else a.kept()
    table = None
    try:
        for k, stage in enumerate(stages):
            old = table
            table, x, run = join_stage(a, x, stage, left, k)
            if old is not None:
                discard(old)
            left -= run.iterations
            runs.append(run)
    finally:
        if large:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            discard(a.entries)
    return Result(x, spark.createDataFrame([tuple(vars(r).values()) for r in runs], META))
