import re
from pathlib import Path

import pytest

from lodestone.functions.statistics import average, median, timing_report
from lodestone.operators import vector
from lodestone.operators.eigen import pagerank, power_iteration
from lodestone.operators.matrix import SparseMatrix
from lodestone.operators.vector import constant
from lodestone.plans import fixpoint
from lodestone.plans.state import shared_dir, written
from lodestone.workloads import iterations
from pyspark.sql import functions as F

from .test_matrix import toy, values

FIXPOINT = [0.312342079689018, 0.162745383867833, 0.332167152575315, 0.03, 0.162745383867833]


@pytest.fixture(scope="module")
def links(spark):
    return toy(spark).transpose().kept()


@pytest.mark.parametrize(
    ("widths", "third", "expected"),
    [
        ((8,), False, [207]),
        ((2, 4, 6, 8), True, [2, 68, 48, 89]),
        ((4, 6, 8), False, [70, 68, 68]),
        ((4, 8), False, [70, 137]),
        ((6, 8), True, [4, 203]),
        ((6, 8), False, [138, 69]),
    ],
)
def test_stages(links, widths, third, expected):
    result = pagerank(links, widths, every_third=third)
    assert values(result.vector) == pytest.approx(FIXPOINT, abs=1e-12)
    found = iterations(result)
    assert all(done for done, _ in found)
    assert [n for _, n in found] == pytest.approx(expected, abs=2)


def test_narrow_stages_alone(links):
    two = pagerank(links, (2,))
    assert values(two.vector) == [0.453125, 0.109375, 0.234375, 0.029296875, 0.109375] and iterations(two) == [(True, 2)]
    assert values(pagerank(links, (4,)).vector) == pytest.approx([0.31233978, 0.16274440, 0.33216906, 0.02999999, 0.16274440], abs=1e-8)


@pytest.mark.parametrize(("widths", "options"), [((4,), {}), ((8,), {"renormalize": True}), ((2, 6), {"every_third": True})])
def test_plans_agree(links, widths, options):
    a, b = (pagerank(links, widths, limit=4, plan=p, **options) for p in ("array", "join"))
    assert values(a.vector) == pytest.approx(values(b.vector), abs=1e-15)
    assert iterations(a) == iterations(b)
    for result in (a, b):
        times = result.metadata.collect()
        assert all(len(r["spmv_ns"]) == r["iterations"] and r["total_ns"] > 0 for r in times)
        assert timing_report(result.metadata).where("phase = 'spmv_ns' and median_ns > 0").count() >= 1


def test_an_iteration_leaves_one_table(spark, links):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = len(list(folder.iterdir()))
    for plan in ("array", "join", "auto"):
        pagerank(links, (4, 8), limit=4, plan=plan)
    assert len(list(folder.iterdir())) == before + 3


def test_power_iteration_plans_agree(spark):
    m = SparseMatrix.of(spark.createDataFrame([(0, 0, 4.0), (0, 1, 1.0), (1, 1, 2.0), (1, 2, 1.0), (2, 2, 1.0)], "i long, j long, v double"), 3, 3)
    assert [iterations(power_iteration(m, (w,)))[0] for w in (2, 4, 6, 8)] == [(True, n) for n in (2, 17, 33, 49)]
    assert values(power_iteration(m).vector)[0] == pytest.approx(1.0)
    a, b = (power_iteration(m, (4, 8), limit=6, local=True, plan=p) for p in ("array", "join"))
    assert values(a.vector) == pytest.approx(values(b.vector), abs=1e-15)
    assert iterations(a) == iterations(b) == [(False, 6), (False, 0)]


@pytest.mark.parametrize("plan", ["array", "join"])
def test_dangling_column(spark, plan):
    d = SparseMatrix.of(spark.createDataFrame([(1, 0, 1.0)], "i long, j long, v double"), 2, 2)
    assert values(pagerank(d, plan=plan).vector) == pytest.approx([0.075, 0.13875])
    if plan == "array":
        assert values(pagerank(d, renormalize=True).vector) == pytest.approx([0.22163688, 0.77836312], abs=1e-8)


@pytest.mark.parametrize("plan", ["array", "join"])
def test_zero_vector_and_zero_budget(spark, links, plan):
    zero = pagerank(links, initial=constant(spark, 5, 0.0), plan=plan)
    assert values(zero.vector) == [0.0] * 5 and iterations(zero) == [(False, 0)]
    none = pagerank(links, limit=0, plan=plan)
    assert values(none.vector) == [0.2] * 5 and iterations(none) == [(False, 0)]
    nothing = power_iteration(SparseMatrix.empty(spark, 2, 2), plan=plan)
    assert iterations(nothing) == [(False, 0)] and values(nothing.vector) == pytest.approx([0.5**0.5] * 2)


def test_long_vectors_meet_a_bucketed_matrix(spark, links, monkeypatch):
    monkeypatch.setattr(vector, "BROADCAST_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        far, near = (pagerank(links, limit=3, plan=p) for p in ("join", "array"))
        assert values(far.vector) == pytest.approx(values(near.vector), abs=1e-15)
        table = links.bucketed("lodestone_test_links", 4)
        plan = vector.spmv(table, constant(spark, 5, 1.0))._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan
        assert plan.count("hashpartitioning(j") == 1  # the vector alone moves for the join
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS lodestone_test_links")


def test_symmetric_spectrum_never_converges(spark):
    flip = SparseMatrix.of(spark.createDataFrame([(0, 1, 1.0), (1, 0, 2.0)], "i long, j long, v double"), 2, 2)
    assert iterations(power_iteration(flip, limit=30)) == [(False, 30)]


@pytest.mark.parametrize("plan", ["array", "join"])
def test_overflow_is_an_error(spark, plan):
    big = SparseMatrix.of(spark.createDataFrame([(0, 0, 1e308), (0, 1, 1e308), (1, 0, 1e308)], "i long, j long, v double"), 2, 2)
    with pytest.raises(ArithmeticError):
        pagerank(big, plan=plan, limit=9)


def test_statistics(spark):
    got = spark.createDataFrame([(1,), (2,), (3,), (4,)], "x int").agg(median(F.col("x")).alias("m"), average(F.col("x")).alias("a"), median(F.col("x"), False).alias("e")).first()
    assert tuple(got) == (2, 2, 2.5)


def test_several_tasks_take_the_same_steps(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "ARRAY_VALUES", 300)
    place = F.col("id") * 7919 % 4000  # of 100 rows and columns, rows 90 to 99 and column 99 are empty
    entries = spark.range(1500).select((place % 90).alias("i"), (F.floor(place / 90) * 2 % 99).alias("j"), (F.col("id") % 5 + 0.1).alias("v"))
    m = SparseMatrix.of(entries, 100, 100).kept()
    assert fixpoint.array_tasks(m) == min(5, fixpoint.slots(spark))
    for run in (lambda plan: pagerank(m.scaled_columns(), (4, 8), limit=50, plan=plan), lambda plan: power_iteration(m, (6, 8), limit=20, plan=plan)):
        several, one, joined = (run(plan) for plan in ("auto", "array", "join"))
        assert values(several.vector) == values(one.vector) == pytest.approx(values(joined.vector), abs=1e-12)
        assert iterations(several) == iterations(one)
    monkeypatch.setattr(fixpoint, "TASK_VALUES", 100)
    assert fixpoint.array_tasks(m) == 0


def test_rounds_that_repeat_are_counted_and_not_taken(spark):
    turn = SparseMatrix.of(spark.createDataFrame([(1, 0, 1.0), (2, 1, 2.0), (0, 2, 4.0)], "i long, j long, v double"), 3, 3)
    for limit in (998, 999, 1000):
        few, many = (power_iteration(turn, limit=n, plan="array") for n in (limit % 3 + 30, limit))
        assert values(few.vector) == values(many.vector)
        assert iterations(many) == [(False, limit)]
        assert len(many.metadata.first()["spmv_ns"]) < 30


@pytest.mark.parametrize("widths", [(2, 4, 6, 8), (4, 6, 8), (4, 8), (8,)])
def test_power_iteration_in_several_tasks_converges_by_the_same_steps(spark, monkeypatch, widths):
    n = 60
    entries = spark.range(n * n).select(F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j"), (F.col("id") * 7919 % 13 + 1.0).alias("v"))
    m = SparseMatrix.of(entries, n, n).kept()
    one = power_iteration(m, widths, local=True)
    monkeypatch.setattr(fixpoint, "ARRAY_VALUES", 1200)
    several = power_iteration(m, widths, local=True)
    assert fixpoint.array_tasks(m) == min(3, fixpoint.slots(spark))
    assert iterations(one) == iterations(several) and all(done for done, _ in iterations(several))
    assert values(one.vector) == values(several.vector)


def test_many_rows_of_few_entries_need_no_job_a_step(spark):
    n = 90_000
    hops = spark.range(n).select(((F.col("id") + 1) % n).alias("i"), F.col("id").alias("j"), (F.col("id") % 3 + 1.0).alias("v"))
    m = SparseMatrix.of(hops, n, n).kept()
    assert fixpoint.array_tasks(m) == 1
    result = power_iteration(m, limit=200)
    assert iterations(result) == [(False, 200)]
    assert result.vector.count() == n


def test_a_task_holds_little_more_than_its_entries():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from lodestone.plans import local

    n, rows, size = 2_000_000, 2000, 10_000

    def batches():
        for low in range(0, n, size):
            place = np.arange(low, low + size)
            i, j = place // (n // rows), place % (n // rows) * 2
            first = j == 0  # a row's number of the vector comes before its entries
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.where(first, -1, j)), pa.array(np.ones(size))], names=["i", "j", "v"])

    run = local.task([fixpoint.Stage(power=True)], 3, rows)
    next(batches())  # what Arrow imports is not counted
    tracemalloc.start()
    try:
        vector, metadata = run(batches())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert vector.column("x").to_numpy() == pytest.approx(rows**-0.5) and metadata.column("iterations").to_pylist() == [1]
    assert peak < 24 * n


def test_the_array_plan_sorts_by_one_number(spark, links, monkeypatch):
    seen = []

    def kept(df):
        seen.append(df._jdf.queryExecution().sparkPlan().toString())
        return written(df)

    monkeypatch.setattr(fixpoint, "written", kept)
    result = pagerank(links, plan="array")
    assert values(result.vector) == pytest.approx(FIXPOINT, abs=1e-12)
    (orders,) = re.findall(r"Sort \[(.*?)\], false", seen[0])
    assert orders.count("ASC") == 1


def test_entries_at_the_same_place_add_up_in_one_order(spark):
    places = [(i, j) for i in range(3) for j in range(3)]
    rows = [(i, j, v + k) for k, (i, j) in enumerate(places) for v in (1e16, 1.0, 1.0, -1e16, 0.3, 7.1e-9)]
    found = set()
    for turn in range(4):
        dealt = spark.createDataFrame(rows[turn * 13 :] + rows[: turn * 13], "i long, j long, v double").repartition(turn + 1)
        found.add(tuple(values(power_iteration(SparseMatrix.of(dealt, 3, 3), limit=3, plan="array").vector)))
    assert len(found) == 1


def test_rows_of_a_product_are_added_at_the_same_time(monkeypatch):
    import numpy as np

    from lodestone.plans import local

    rng = np.random.default_rng(4)
    added, bincount = [], np.bincount
    monkeypatch.setattr(local.np, "bincount", lambda place, weights, n: (added.append(len(place)), bincount(place, weights, n))[1])
    for sizes, alone in ((rng.integers(1, 60, 3000), 0.02), (np.append(rng.integers(1, 9, 2000), [4000, 3000]), 0.6), (np.full(10, 700), 1.1), (np.full(1, 5), 2), (np.zeros(0, int), 0)):
        i = np.repeat(3 * np.arange(len(sizes)), sizes).astype(np.int32)
        j, v, x = rng.integers(0, 9000, len(i)).astype(np.int32), rng.normal(size=len(i)), rng.normal(size=9000)
        x[:3] = np.inf, np.nan, -0.0
        want = bincount(i, v * x[j], 9000)  # each row one by one, in the order of its entries
        for held in (local.Matrix.HELD, 5000):
            monkeypatch.setattr(local.Matrix, "HELD", held)
            added.clear()
            a = local.Matrix(i.copy(), j.copy(), v.copy(), 9000, local.alone)
            assert np.array_equal(a.all(a.own(x)), want, equal_nan=True)
            assert held == 5000 or sum(added) <= alone * len(i)
