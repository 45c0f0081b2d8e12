"""Workloads that measure the engine: sweeps over sizes, densities and widths. Each returns rows as dictionaries."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import vector
from lodestone.operators.eigen import pagerank, power_iteration
from lodestone.operators.matrix import SparseMatrix
from lodestone.plans.fixpoint import Result
from lodestone.sources import generators as gen


def timed(action: Callable[[], object]) -> tuple[object, float]:
    began = time.perf_counter()
    return action(), time.perf_counter() - began


def repeated(action: Callable[[], object], runs: int, warmup: int = 0) -> dict[str, float]:
    for _ in range(warmup):
        action()
    times = [timed(action)[1] for _ in range(runs)]
    return {"median_s": statistics.median(times), "average_s": statistics.fmean(times)}


def iterations(result: Result) -> list[tuple[bool, int]]:
    return [(r["converged"], r["iterations"]) for r in result.metadata.orderBy("stage").collect()]


def convergence(spark: SparkSession, sizes: Iterable[int], densities: Iterable[float], seeds: Iterable[int], limit: int = 200) -> list[dict]:
    """Iterations of PageRank on random column-stochastic matrices."""
    out = []
    for n in sizes:
        for density in densities:
            for seed in seeds:
                found, seconds = timed(lambda: iterations(pagerank(gen.column_stochastic(spark, n, density, seed), limit=limit)))
                out.append({"n": n, "density": density, "seed": seed, "stages": found, "seconds": seconds})
    return out


def precision_levels(spark: SparkSession, n: int, density: float, seed: int) -> list[dict]:
    """PageRank of one matrix at every width, and how far each is from the one of doubles."""
    a = gen.column_stochastic(spark, n, density, seed).kept()
    exact = pagerank(a).vector
    out = []
    for widths in ((2,), (4,), (6,), (8,), (2, 4, 6, 8)):
        result = pagerank(a, widths)
        out.append({"widths": widths, "stages": iterations(result), "distance": vector.l1_difference(result.vector, exact)})
    return out


def distances(a: SparseMatrix, pipelines: Iterable[tuple[int, ...]]) -> DataFrame:
    """(a, b, distance): the L1 distance between the PageRanks of every two pipelines of widths."""
    found = [("_".join(map(str, w)), pagerank(a, w).vector) for w in pipelines]
    rows = [(x, y, vector.l1_difference(v, u)) for k, (x, v) in enumerate(found) for y, u in found[k + 1 :]]
    return a.spark.createDataFrame(rows, "a string, b string, distance double")


def pagerank_sweep(spark: SparkSession, sizes: Iterable[int], densities: Iterable[float], tests: int = 2, samples: int = 2, widths: Iterable[tuple[int, ...]] = ((4, 8), (4, 6, 8), (8,))) -> list[dict]:
    """Seconds of PageRank through each series of widths, over sizes and densities: tests matrices each, run samples
    times; and how far the vectors are from that of doubles."""
    out = []
    for n in sizes:
        for density in densities:
            for seed in range(tests):
                a = gen.column_stochastic(spark, n, density, seed).kept()
                exact = pagerank(a).vector
                for w in widths:
                    result = pagerank(a, w)
                    times = repeated(lambda w=w, a=a: pagerank(a, w), samples)
                    out.append({"n": n, "density": density, "seed": seed, "widths": w, "stages": iterations(result), "distance": vector.l1_difference(result.vector, exact), **times})
    return out


def staged_speed(spark: SparkSession, n: int, density: float, seed: int, widths: Iterable[tuple[int, ...]] = ((4, 8), (4, 6, 8), (8,)), runs: int = 1, warmup: int = 0) -> list[dict]:
    """Seconds of PageRank through each series of widths on one matrix, and of one 6-byte step."""
    a = gen.column_stochastic(spark, n, density, seed).kept()
    out = [{"widths": w, "stages": iterations(pagerank(a, w)), **repeated(lambda w=w: pagerank(a, w).vector.count(), runs, warmup)} for w in widths]
    x = vector.constant(spark, n, 1.0 / n)
    return [*out, {"widths": "one 6-byte step", "stages": [], **repeated(lambda: vector.spmv(a, x, 6, 6, 0.85).agg(F.sum("x")).collect(), max(runs, 3))}]


def power_iterations(spark: SparkSession, sizes: Iterable[int], densities: Iterable[float], etas: Iterable[float], seed: int = 1) -> list[dict]:
    """Iterations of power iteration through several widths, for given convergence ratios."""
    out = []
    for n in sizes:
        for density in densities:
            for eta in etas:
                a = gen.fixed_eta(spark, n, density, eta, seed).kept()
                for widths in ((2, 4, 6, 8), (4, 6, 8), (4, 8), (6, 8), (8,)):
                    out.append({"n": n, "density": density, "eta": eta, "widths": widths, "stages": iterations(power_iteration(a, widths, local=True))})
    return out


def power_speed(spark: SparkSession, n: int, density: float, eta: float, seed: int = 1, runs: int = 3, warmup: int = 1) -> list[dict]:
    """Seconds of power iteration through two series of widths, over the runs that converged."""
    a = gen.fixed_eta(spark, n, density, eta, seed).kept()
    out = []
    for w in ((4, 8), (8,)):
        for _ in range(warmup):
            power_iteration(a, w)
        found = [(iterations(result)[-1][0], seconds) for result, seconds in (timed(lambda w=w: power_iteration(a, w)) for _ in range(runs))]
        times = [seconds for converged, seconds in found if converged]
        out.append({"widths": w, "converged": len(times), "median_s": statistics.median(times) if times else None, "average_s": statistics.fmean(times) if times else None})
    return out


def spmv_speed(spark: SparkSession, sizes: Iterable[int], densities: Iterable[float], runs: int = 5, warmup: int = 1) -> list[dict]:
    """Seconds of a product in doubles, with 4-byte vectors cut inside, and cut before and after."""
    out = []
    for n in sizes:
        for density in densities:
            a = gen.diagonally_dominant(spark, n, density, 1).kept()
            x = vector.constant(spark, n, 1.1)
            forms = {
                "doubles": lambda a=a, x=x: vector.spmv(a, x),
                "4 bytes, cut inside": lambda a=a, x=x: vector.spmv(a, x, 4, 4),
                "4 bytes, cut outside": lambda a=a, x=x: cut(vector.spmv(a, cut(x))),
            }
            for form, make in forms.items():
                out.append({"n": n, "density": density, "form": form, **repeated(lambda make=make: make().agg(F.sum("x")).collect(), runs, warmup)})
    return out


def cut(x, width: int = 4):
    return vector.cut(x, "x", F.col("x"), width)


def elementwise_speed(spark: SparkSession, n: int, runs: int = 5, warmup: int = 1) -> list[dict]:
    rows = spark.range(n).select((F.col("id") * 1.1).alias("a"), (F.col("id") * 0.7).alias("b"))
    return [{"width": w, **repeated(lambda w=w: vector.elementwise_product(rows, "a", "b", w).agg(F.sum("x")).collect(), runs, warmup)} for w in (8, 2, 4, 6)]


def slices_agree(a: SparseMatrix, x, edges: list[int], damping: float = 0.85) -> bool:
    """Whether the products of row slices, put together, are the product of the whole."""
    whole = {r["i"]: r["x"] for r in vector.spmv(a, x, damping=damping).collect()}
    parts = {}
    for first, end in zip(edges, edges[1:], strict=False):
        parts |= {r["i"] + first: r["x"] for r in vector.spmv(a.rows_between(first, end), x, damping=damping).collect()}
    return whole == parts
