"""PageRank and power iteration at one width or through several."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodestone.operators.matrix import SparseMatrix
from lodestone.operators.vector import constant
from lodestone.plans.fixpoint import BASE_EPSILON, Result, Stage, fixpoint


def pagerank(
    a: SparseMatrix,
    widths: tuple[int, ...] = (8,),
    initial: DataFrame | None = None,
    damping: float = 0.85,
    epsilon: float = BASE_EPSILON,
    limit: int = 1000,
    renormalize: bool = False,
    every_third: bool = False,
    plan: str = "auto",
) -> Result:
    """PageRank of a column-stochastic matrix through stages of the widths, (8,), (4, 8) or (2, 4, 6, 8) for instance.

    Nothing makes up for columns that sum to zero: without renormalize their mass leaks. every_third tests the 6-byte
    stage's convergence on every third number.
    """
    stages = [Stage(w, damping=damping, epsilon=epsilon, renormalize=renormalize, every_third=every_third and w == 6) for w in widths]
    return fixpoint(a, initial if initial is not None else constant(a.spark, a.n_rows, 1.0), stages, limit, plan)


def power_iteration(a: SparseMatrix, widths: tuple[int, ...] = (8,), initial: DataFrame | None = None, limit: int = 1000, local: bool = False, plan: str = "auto") -> Result:
    """The dominant eigenvector. The state stays double; only products are cut to a stage's width.

    local: the last stage does not normalise its first vector.
    """
    stages = [Stage(w, power=True, start_normalised=not (local and k == len(widths) - 1)) for k, w in enumerate(widths)]
    return fixpoint(a, initial if initial is not None else constant(a.spark, a.n_rows, 1.0), stages, limit, plan)
