import pytest
from pyspark.sql import functions as F

from lodestone.operators import vector
from lodestone.operators.matrix import SparseMatrix, row_blocks
from lodestone.sources import generators as gen
from lodestone.workloads import slices_agree


def toy(spark):
    return SparseMatrix.from_csr(spark, [0.5, 0.5, 1, 1, 1, 1], [1, 4, 2, 0, 2, 2], [0, 2, 3, 4, 5, 6], 5)


def cells(m):
    return sorted((r["i"], r["j"], r["v"]) for r in m.entries.collect())


def values(x):
    return [r["x"] for r in x.orderBy("i").collect()]


def test_transpose_and_back(spark):
    t = toy(spark).transpose()
    assert cells(t) == [(0, 2, 1.0), (1, 0, 0.5), (2, 1, 1.0), (2, 3, 1.0), (2, 4, 1.0), (4, 0, 0.5)]
    assert cells(t.transpose()) == cells(toy(spark))


def test_stacks_rows_and_shapes(spark):
    m, wide = toy(spark), SparseMatrix.empty(spark, 4, 0)
    below = m.stack_below(m)
    assert (below.n_rows, below.n_cols, below.n_values()) == (10, 5, 12)
    assert cells(below.rows_between(5, 10)) == cells(m)
    right = m.stack_right(SparseMatrix.unit(spark, 5))
    assert right.n_cols == 10 and (3, 8, 1.0) in cells(right)
    with pytest.raises(ValueError):
        m.stack_below(wide)
    with pytest.raises(ValueError):
        m.stack_right(wide)
    assert [tuple(r) for r in m.transpose().row_starts(block=2).orderBy("i").collect()] == [(0, 0, 1), (1, 1, 2), (2, 2, 5), (3, 5, 5), (4, 5, 6)]
    assert [r["line"] for r in m.transpose().grid().orderBy("i").collect()][3] == "_ _ _ _ _"


def test_validation(spark):
    for entries in ([(5, 0, 1.0)], [(0, -1, 1.0)], [(0, 0, None)], [(None, 0, 1.0)]):
        with pytest.raises(ValueError):
            SparseMatrix.of(spark.createDataFrame(entries, "i long, j long, v double"), 5, 5).validated()
    with pytest.raises(ValueError):
        SparseMatrix.from_csr(spark, [1.0], [0], [0, 2], 1)
    with pytest.raises(ValueError):
        SparseMatrix.from_csr(spark, [1.0], [3], [0, 1], 1)


def test_row_blocks(spark):
    blocks = lambda n, p: [(r["first"], r["end"]) for r in row_blocks(spark, n, p).orderBy("part").collect()]
    assert blocks(10, 3) == [(0, 3), (3, 6), (6, 10)]
    assert blocks(5, 4) == [(0, 1), (1, 2), (2, 3), (3, 5)]
    assert sum(a == b for a, b in blocks(5, 8)) == 3


def test_damped_product(spark):
    m, one = toy(spark).transpose(), vector.constant(spark, 5, 1.0)
    assert values(vector.spmv(m, one, damping=0.85)) == pytest.approx([0.88, 0.455, 2.58, 0.03, 0.455])
    assert slices_agree(m, one, [0, 1, 2, 3, 5])


def test_one_step_at_each_width(spark):
    m, x = toy(spark).transpose(), vector.constant(spark, 5, 0.2)
    assert values(vector.spmv(m, x, 2, 2, 0.85)) == [0.1953125, 0.109375, 0.5, 0.029296875, 0.109375]
    assert values(vector.spmv(m, x, 4, 4, 0.85)) == [0.19999992847442627, 0.11499994993209839, 0.5399994850158691, 0.0299999862909317, 0.11499994993209839]
    assert values(vector.spmv(m, x, 6, 6, 0.85)) == pytest.approx([0.1999999999989086, 0.11499999999887223, 0.5399999999935972, 0.029999999999972715, 0.11499999999887223], abs=1e-15)


def test_duplicate_entries_add_up_and_long_vectors_need_no_broadcast(spark, monkeypatch):
    m = SparseMatrix.of(spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0)], "i long, j long, v double"), 2, 1)
    monkeypatch.setattr(vector, "BROADCAST_ROWS", 0)
    assert values(vector.spmv(m, vector.constant(spark, 1, 3.0))) == [9.0, 0.0]


def test_normalise(spark):
    x = vector.constant(spark, 4, 3.0)
    assert values(vector.normalise(x, 2)[0]) == [0.5] * 4
    same, done = vector.normalise(vector.constant(spark, 2, 0.0), 1)
    assert not done and values(same) == [0.0, 0.0]
    assert vector.l1_difference(x, vector.constant(spark, 4, 1.0)) == 8.0


def test_stochastic_generators(spark):
    for n, density in ((10, 0.5), (20, 0.6)):
        m = gen.row_stochastic(spark, n, density, 3)
        rows = m.entries.groupBy("i").agg(F.count("*").alias("n"), F.countDistinct("j").alias("d"), F.sum("v").alias("s")).collect()
        assert len(rows) == n and all(r["n"] == r["d"] == int(n * density) and abs(r["s"] - 1) < 1e-12 for r in rows)
        assert cells(gen.column_stochastic(spark, n, density, 3)) == cells(m.transpose())
    with pytest.raises(ValueError):
        gen.row_stochastic(spark, 10, 0.01, 1)


def test_dominant_generators(spark):
    got = cells(gen.diagonally_dominant(spark, 64, 1 / 8, 5))
    assert len(got) == 64 * 8 and (0, 0, 231.0) in got
    assert all(80 <= v < 90 if i == j else 1.0625 <= v < 10.0625 for i, j, v in got if (i, j) != (0, 0))
    part = cells(gen.diagonally_dominant_slice(spark, 64, 1 / 8, 5, 3, 5))
    assert {i for i, _, _ in part} == {0, 1, 2} and all(640001 <= v < 640065 for i, j, v in part if j == i + 3)


@pytest.mark.parametrize("eta", [0.3, 0.6, 0.9])
def test_fixed_eta(spark, eta):
    got = cells(gen.fixed_eta(spark, 64, 1 / 8, eta, 5))
    rows = {i: [(j, v) for r, j, v in got if r == i] for i in range(64)}
    single = sorted(v for i, r in rows.items() if len(r) == 1 for j, v in r if j == i)
    assert single == pytest.approx([10 * eta, 10.0])
    for i, r in rows.items():
        if len(r) > 1:
            centre = dict(r)[i]
            assert centre + sum(abs(v) for j, v in r if j != i) < 10 * eta


def test_random_has_an_exact_count(spark):
    got = cells(gen.random(spark, 30, 20, 0.1, 9))
    assert len(got) == len({g[:2] for g in got}) == 60
    assert all(i < 20 and j < 30 and 0.001 <= v < 1e5 for i, j, v in got)
