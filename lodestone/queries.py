"""The engine's queries over the test tables, and the same in SQL.

Sums of doubles depend on their order, so results that are not exact are rounded to nine digits on both sides; inputs of
truncated results are integers, whose sums are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import workloads
from lodestone.functions import codec
from lodestone.functions.statistics import average, median, timing_report
from lodestone.operators import vector
from lodestone.operators.eigen import pagerank, power_iteration
from lodestone.operators.matrix import SparseMatrix, partitioned_by_rows, row_blocks
from lodestone.sources import generators as gen
from lodestone.sources import graphs
from lodestone.sources.graphs import table
from lodestone.workloads import distances

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def bits(x: str, width: int) -> str:
    """x cut to width bytes, in DuckDB."""
    return f"((({x})::DOUBLE::BIT & (repeat('1', {8 * width}) || repeat('0', {64 - 8 * width}))::BIT)::DOUBLE)"


def code(x: str, width: int) -> str:
    return f"((({x})::DOUBLE::BIT >> {64 - 8 * width})::BIGINT)" if width < 8 else f"((({x})::DOUBLE::BIT)::BIGINT)"


# Precision codec


for w in (2, 4, 6):

    @query(f"codec_trunc_{w}", f"SELECT l_orderkey, l_linenumber, {bits('l_extendedprice', w)} AS x FROM lineitem")
    def _(spark, d, w=w):
        return codec.cut(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x")), "x", F.col("x"), w)

    @query(f"codec_code_{w}", f"SELECT c_custkey, {code('c_acctbal', w)} AS code FROM customer")
    def _(spark, d, w=w):
        return table(spark, d, "customer").select("c_custkey", codec.encode(F.col("c_acctbal"), w).alias("code"))

    @query(f"codec_decode_{w}", f"SELECT o_orderkey, {bits('o_totalprice', w)} AS x FROM orders")
    def _(spark, d, w=w):
        return table(spark, d, "orders").select("o_orderkey", codec.decode(codec.encode(F.col("o_totalprice"), w), w).alias("x"))


@query("codec_code_8", f"SELECT c_custkey, {code('c_acctbal', 8)} AS code FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", codec.encode(F.col("c_acctbal"), 8).alias("code"))


_c6 = code("c_acctbal", 6)


@query("codec_words_6", f"SELECT c_custkey, ({_c6} & 65535)::INT AS w0, (({_c6} >> 16) & 65535)::INT AS w1, (({_c6} >> 32) & 65535)::INT AS w2, {bits('c_acctbal', 6)} AS x FROM customer")
def _(spark, d):
    words = codec.code_words(codec.encode(F.col("c_acctbal"), 6))
    cut = table(spark, d, "customer").select("c_custkey", words.alias("w"))
    return cut.select("c_custkey", *[F.col("w")[k].alias(f"w{k}") for k in range(3)], codec.decode(codec.words_code(F.col("w")), 6).alias("x"))


for w in codec.WIDTHS:
    _a, _b = bits("l_quantity", w), bits("l_extendedprice", w)

    @query(f"elementwise_mul_{w}", f"SELECT l_orderkey, l_linenumber, {bits(f'{_a} * {_b}', w)} AS x FROM lineitem")
    def _(spark, d, w=w):
        lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
        return vector.elementwise_product(lines, "l_quantity", "l_extendedprice", w).select("l_orderkey", "l_linenumber", "x")


# Matrices

NATION = """n AS (SELECT s_nationkey::BIGINT AS i, c_nationkey::BIGINT AS j, count(*)::DOUBLE AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def matrix_query(name: str, sql: str):
    return query(name, f"WITH {NATION}{sql}" if sql.startswith(",") else f"WITH {NATION} {sql}")


@matrix_query("matrix_build", "SELECT i, j, v FROM n")
def _(spark, d):
    return graphs.nation_trade(spark, d).validated().entries


@matrix_query("matrix_transpose", "SELECT j AS i, i AS j, v FROM n")
def _(spark, d):
    return graphs.nation_trade(spark, d).transpose().entries


@query("matrix_unit", "SELECT range AS i, range AS j, 1.0::DOUBLE AS v FROM range(25)")
def _(spark, d):
    return SparseMatrix.unit(spark, 25).entries


@query("matrix_empty", "SELECT 0::BIGINT AS n_values, 4::BIGINT AS n_rows, 5::BIGINT AS n_cols")
def _(spark, d):
    m = SparseMatrix.empty(spark, 5, 4)
    return m.entries.agg(F.count("*").alias("n_values")).select("n_values", F.lit(m.n_rows).cast("long").alias("n_rows"), F.lit(m.n_cols).cast("long").alias("n_cols"))


@matrix_query("matrix_stack_below", "SELECT i, j, v FROM n UNION ALL SELECT j + 25, i, v FROM n")
def _(spark, d):
    m = graphs.nation_trade(spark, d)
    return m.stack_below(m.transpose()).entries


@matrix_query("matrix_stack_right", "SELECT i, j, v FROM n UNION ALL SELECT j, i + 25, v FROM n")
def _(spark, d):
    m = graphs.nation_trade(spark, d)
    return m.stack_right(m.transpose()).entries


@matrix_query("matrix_rows_between", "SELECT i - 5 AS i, j, v FROM n WHERE i >= 5 AND i < 12")
def _(spark, d):
    return graphs.nation_trade(spark, d).rows_between(5, 12).entries


@matrix_query("matrix_scaled_columns", "SELECT i, j, round(v / sum(v) OVER (PARTITION BY j), 9) AS v FROM n")
def _(spark, d):
    return graphs.nation_trade(spark, d).scaled_columns().entries.select("i", "j", F.round("v", 9).alias("v"))


ROWS = "c AS (SELECT range AS i, count(n.i)::BIGINT AS n FROM range(25) LEFT JOIN n ON n.i = range GROUP BY ALL)"


@matrix_query("matrix_row_counts", f", {ROWS} SELECT i, n FROM c")
def _(spark, d):
    return graphs.nation_trade(spark, d).row_counts()


@matrix_query("matrix_row_starts", f', {ROWS} SELECT i, (sum(n) OVER (ORDER BY i) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY i))::BIGINT AS "end" FROM c')
def _(spark, d):
    return graphs.nation_trade(spark, d).row_starts(block=4)


@matrix_query(
    "matrix_grid",
    ", g AS (SELECT r.range AS i, c.range AS j, v FROM range(25) r CROSS JOIN range(25) c LEFT JOIN n ON n.i = r.range AND n.j = c.range) SELECT i, string_agg(coalesce(v::VARCHAR, '_'), ' ' ORDER BY j) AS line FROM g GROUP BY i",
)
def _(spark, d):
    return graphs.nation_trade(spark, d).grid()


@query("row_blocks", "SELECT range AS part, 1000003 * range // 7 AS first, 1000003 * (range + 1) // 7 AS \"end\" FROM range(7)")
def _(spark, d):
    return row_blocks(spark, 1_000_003, 7)


@matrix_query("partitioned_rows", "SELECT i, count(*) AS n, sum(v) AS total FROM n GROUP BY i")
def _(spark, d):
    return partitioned_by_rows(graphs.nation_trade(spark, d), 4).entries.groupBy("i").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


SUPPLIERS = """m AS (SELECT l_orderkey, l_suppkey AS s, count(*) AS c FROM lineitem GROUP BY ALL),
n AS (SELECT a.s AS i, b.s AS j, sum(a.c * b.c)::DOUBLE AS v FROM m a JOIN m b USING (l_orderkey) WHERE a.s <> b.s GROUP BY ALL)"""
HOPS = """e AS (SELECT user_id AS j, lead(user_id) OVER (ORDER BY ts, event_id) AS i FROM events),
n AS (SELECT i, j, count(*)::DOUBLE AS v FROM e WHERE i IS NOT NULL GROUP BY ALL)"""
PARTS = """p AS (SELECT l_partkey AS i, l_suppkey + (SELECT count(*) FROM part) AS j, count(*)::DOUBLE AS v FROM lineitem GROUP BY ALL),
n AS (SELECT i, j, v FROM p UNION ALL SELECT j, i, v FROM p)"""
GRAPHS = {
    "nation": (graphs.nation_trade, NATION, "25"),
    "supplier": (graphs.supplier_orders, SUPPLIERS, "(SELECT count(*) FROM supplier)"),
    "user": (graphs.user_hops, HOPS, "(SELECT max(user_id) + 1 FROM events)"),
    "part_supplier": (graphs.part_supplier, PARTS, "((SELECT count(*) FROM part) + (SELECT count(*) FROM supplier))"),
}
for _name, (_make, _sql, _n) in GRAPHS.items():

    @query(f"graph_{_name}", f"WITH {_sql} SELECT i, j, v FROM n")
    def _(spark, d, make=_make):
        return make(spark, d).entries


@query("graph_gram", "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS a, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT x.i, y.i AS j, round(sum(x.a * y.a), 6) AS v FROM e x JOIN e y USING (vec_id) GROUP BY ALL")
def _(spark, d):
    return graphs.embedding_gram(spark, d).entries.select("i", "j", F.round("v", 6).alias("v"))


# Products: integers, so that every sum is exact


def ramp(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") * 1000 + 37).cast("double").alias("x"))


RAMP = "x AS (SELECT range AS j, (range * 1000 + 37)::DOUBLE AS x FROM range(25)), r AS (SELECT range AS i FROM range(25))"


def product_sql(in_bytes: int, out_bytes: int, damping: float | None) -> str:
    z = "coalesce(sum(v * xx), 0.0)"
    z = z if damping is None else f"{damping}::DOUBLE * {z} + {(1 - damping) / 25!r}::DOUBLE"
    return f"WITH {NATION}, {RAMP}, y AS (SELECT j, {bits('x', in_bytes)} AS xx FROM x) SELECT r.i, {bits(z, out_bytes)} AS x FROM r LEFT JOIN n ON n.i = r.i LEFT JOIN y ON y.j = n.j GROUP BY r.i"


PRODUCTS = {"spmv_8": (8, 8, None), "pr_step_8": (8, 8, 0.85)}
for w in (2, 4, 6):
    PRODUCTS |= {f"spmv_calc_{w}": (w, w, None), f"spmv_out_{w}": (8, w, None), f"pr_step_{w}": (w, w, 0.85)}
for _name, (_in, _out, _c) in PRODUCTS.items():

    @query(_name, product_sql(_in, _out, _c))
    def _(spark, d, in_bytes=_in, out_bytes=_out, damping=_c):
        return vector.spmv(graphs.nation_trade(spark, d), ramp(spark, 25), in_bytes, out_bytes, damping)


@query("spmv_pre_4", product_sql(4, 4, None))
def _(spark, d):
    cut = ramp(spark, 25).select("i", codec.decode(codec.encode(F.col("x"), 4), 4).alias("x"))
    whole = vector.spmv(graphs.nation_trade(spark, d), cut)
    return codec.cut(whole, "x", F.col("x"), 4)


# Norms and differences


for w in codec.WIDTHS:
    _x = bits("c_acctbal", w)

    @query(f"norms_{w}", f"SELECT round(sum(abs({_x})), 6) AS l1, round(sqrt(sum({_x} * {_x})), 6) AS l2 FROM customer")
    def _(spark, d, w=w):
        x = codec.cut(table(spark, d, "customer").select(F.col("c_acctbal").alias("x")), "x", F.col("x"), w)
        return x.agg(F.round(vector.norm_column(F.col("x"), 1), 6).alias("l1"), F.round(vector.norm_column(F.col("x"), 2), 6).alias("l2"))

    _p = bits("p_size", w)

    @query(f"normalise_{w}", f"SELECT p_partkey AS i, {bits(f'{_p} / sum({_p}) OVER ()', w)} AS x FROM part")
    def _(spark, d, w=w):
        return vector.normalise(table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("x")), 1, w)[0]


@query("l1_difference", f"SELECT round(sum(abs(c_acctbal - {bits('c_acctbal', 2)})), 6) AS difference FROM customer")
def _(spark, d):
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("i"), F.col("c_acctbal").alias("x"))
    value = vector.l1_difference(x, codec.cut(x, "x", F.col("x"), 2))
    return spark.range(1).select(F.round(F.lit(value), 6).alias("difference"))


# PageRank and power iteration


def rounded(v: DataFrame, digits: int = 9) -> DataFrame:
    return v.select("i", F.round("x", digits).alias("x"))


def pagerank_sql(graph: str, n: str, steps: int) -> str:
    # the counter travels by itself: rows without entries have no partner that could carry it
    return f"""WITH RECURSIVE {graph}, links AS (SELECT i, j, v / sum(v) OVER (PARTITION BY j) AS v FROM n UNION ALL SELECT range, 0, 0.0 FROM range({n})),
pr(it, i, x) AS (SELECT 0, range, 1.0::DOUBLE / {n} FROM range({n})
    UNION ALL SELECT max(p.it) + 1, m.i, 0.85 * sum(m.v * p.x) + 0.15 / {n} FROM links m JOIN pr p ON p.i = m.j WHERE p.it < {steps} GROUP BY m.i)
SELECT i, round(x, 9) AS x FROM pr WHERE it = {steps}"""


for _name, (_make, _sql, _n) in GRAPHS.items():

    @query(f"pagerank_{_name}", pagerank_sql(_sql, _n, 230 if _name == "part_supplier" else 40))
    def _(spark, d, make=_make):
        return rounded(pagerank(make(spark, d).scaled_columns()).vector)


NATION_RANK = pagerank_sql(NATION, "25", 40)


@query("pagerank_local", NATION_RANK)
def _(spark, d):
    return rounded(pagerank(graphs.nation_trade(spark, d).scaled_columns(), renormalize=True).vector)


@query("pagerank_join_plan", NATION_RANK)
def _(spark, d):
    return rounded(pagerank(graphs.nation_trade(spark, d).scaled_columns(), plan="join").vector)


for _widths in ((2, 4, 6, 8), (4, 6, 8), (4, 8), (6, 8)):

    @query("pagerank_" + "_".join(map(str, _widths)), NATION_RANK)
    def _(spark, d, widths=_widths):
        return rounded(pagerank(graphs.nation_trade(spark, d).scaled_columns(), widths).vector)


def stages_sql(widths: tuple[int, ...], steps: int, power: bool = False) -> str:
    """CTEs f0, f1, ...: each stage's vector (i, x) and number of iterations (it), from CTEs links (i, j, v) and nodes (n)."""
    out, start = [], "SELECT range AS i, 1.0::DOUBLE AS x FROM range((SELECT n FROM nodes))"
    for k, w in enumerate(widths):
        s = 8 if power else w
        size = "sqrt(sum(x * x) OVER ())" if power else "sum(abs(x)) OVER ()"
        out.append(f"c{k} AS (SELECT i, {bits('x', s)} AS x FROM ({start}))")
        z = "sum(m.v * p.x)"
        new = bits(z, w) if power else bits(f"0.85 * {z} + 0.15 / (SELECT n FROM nodes)", w)
        step = f"SELECT max(p.it) + 1 AS it, m.i AS i, {new} AS x FROM links m JOIN p{k} p ON p.i = m.j WHERE p.it < {steps} GROUP BY m.i"
        step = f"SELECT it, i, x / sqrt(sum(x * x) OVER ()) FROM ({step})" if power else step
        out.append(f"p{k}(it, i, x) AS (SELECT 0, i, {bits(f'x / {size}', s)} FROM c{k} UNION ALL {step})")
        apart = f"SELECT a.it, sum(abs(a.x - b.x)) AS d FROM p{k} a JOIN p{k} b ON a.i = b.i AND b.it = a.it - 1 GROUP BY a.it"
        out.append(f"t{k} AS (SELECT min(it) AS it FROM ({apart}) WHERE d < {codec.adjusted_epsilon(w, 10 * 2.0**-52)!r}::DOUBLE)")
        out.append(f"f{k} AS (SELECT i, x, p.it FROM p{k} p JOIN t{k} USING (it))")
        start = f"SELECT i, x FROM f{k}"
    return ", ".join(out)


LINKS = f"{NATION}, nodes AS (SELECT 25 AS n), links AS (SELECT i, j, v / sum(v) OVER (PARTITION BY j) AS v FROM n UNION ALL SELECT range, 0, 0.0 FROM range(25))"
PAIRS = f"{SUPPLIERS}, nodes AS (SELECT count(*) AS n FROM supplier), links AS (SELECT i, j, v FROM n UNION ALL SELECT range, 0, 0.0 FROM range((SELECT n FROM nodes)))"
for w in (2, 4, 6):

    @query(f"pagerank_{w}", f"WITH RECURSIVE {LINKS}, {stages_sql((w,), 60)} SELECT i, round(x, 9) AS x FROM f0")
    def _(spark, d, w=w):
        return rounded(pagerank(graphs.nation_trade(spark, d).scaled_columns(), (w,)).vector)


@query("pagerank_every_third", NATION_RANK)
def _(spark, d):
    return rounded(pagerank(graphs.nation_trade(spark, d).scaled_columns(), (6, 8), every_third=True).vector)


STAGED = " UNION ALL ".join(f"SELECT {k}::INT AS stage, true AS converged, max(it)::INT AS iterations FROM f{k}" for k in range(3))


@query("pagerank_metadata", f"WITH RECURSIVE {LINKS}, {stages_sql((2, 4, 6), 60)} {STAGED}")
def _(spark, d):
    return pagerank(graphs.nation_trade(spark, d).scaled_columns(), (2, 4, 6)).metadata.select("stage", "converged", "iterations")


@query("pagerank_metadata_join_plan", f"WITH RECURSIVE {LINKS}, {stages_sql((2, 4, 6), 60)} {STAGED}")
def _(spark, d):
    return pagerank(graphs.nation_trade(spark, d).scaled_columns(), (2, 4, 6), plan="join").metadata.select("stage", "converged", "iterations")


@query("pagerank_distances", f"WITH RECURSIVE {LINKS}, {stages_sql((2,), 60)}, g0 AS (SELECT i, x FROM f0) SELECT '2' AS a, '8' AS b, round(sum(abs(g0.x - r.x)), 7) AS distance FROM g0 JOIN (WITH RECURSIVE pr(it, i, x) AS (SELECT 0, range, 0.04::DOUBLE FROM range(25) UNION ALL SELECT max(p.it) + 1, m.i, 0.85 * sum(m.v * p.x) + 0.15 / 25 FROM links m JOIN pr p ON p.i = m.j WHERE p.it < 40 GROUP BY m.i) SELECT i, x FROM pr WHERE it = 40) r USING (i)")
def _(spark, d):
    found = distances(graphs.nation_trade(spark, d).scaled_columns(), ((2,), (8,)))
    return found.select("a", "b", F.round("distance", 7).alias("distance"))


def power_sql(graph: str, n: str, steps: int) -> str:
    return f"""WITH RECURSIVE {graph}, pw(it, i, x) AS (SELECT 0, range, 1.0::DOUBLE FROM range({n})
    UNION ALL SELECT max(p.it) + 1, n.i, sum(n.v * p.x) FROM n JOIN pw p ON p.i = n.j WHERE p.it < {steps} GROUP BY n.i)
SELECT i, round(x / sqrt(sum(x * x) OVER ()), 9) AS x FROM pw WHERE it = {steps}"""


SUPPLIER_POWER = power_sql(SUPPLIERS, "(SELECT count(*) FROM supplier)", 25)
for _widths in ((8,), (2, 4, 6, 8), (4, 6, 8), (4, 8), (6, 8)):

    @query("power_" + "_".join(map(str, _widths)), SUPPLIER_POWER)
    def _(spark, d, widths=_widths):
        return rounded(power_iteration(graphs.supplier_orders(spark, d), widths, local=True).vector)


@query("power_user", power_sql(HOPS, "(SELECT max(user_id) + 1 FROM events)", 40))
def _(spark, d):
    return rounded(power_iteration(graphs.user_hops(spark, d)).vector)


for w in (2, 4, 6):

    @query(f"power_{w}", f"WITH RECURSIVE {PAIRS}, {stages_sql((w,), 40, True)} SELECT i, round(x, 9) AS x FROM f0")
    def _(spark, d, w=w):
        return rounded(power_iteration(graphs.supplier_orders(spark, d), (w,)).vector)


# Generators


def draw_sql(purpose: str, place: str, seed: int = 7) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:{purpose}:' || {place}), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0)"


def long_draw_sql(purpose: str, place: str, seed: int = 7) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:{purpose}:' || {place}), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0)"


def chosen_sql(n: int, k: int, diagonal: bool, rows: str = "true") -> str:
    """The first k different columns of each row's draws."""
    series = f"SELECT i, t, floor({long_draw_sql('draw', 'i || ' + repr(':') + ' || t')} * {n})::BIGINT AS j FROM (SELECT a.range AS i, b.range AS t FROM range({n}) a, range({gen.draws_for(k, n)}) b) WHERE {rows}"
    own = f" UNION ALL SELECT range AS i, -1, range AS j FROM range({n}) WHERE {rows.replace('i BETWEEN', 'range BETWEEN')}" if diagonal else ""
    return f"SELECT i, j FROM (SELECT i, j, min(t) AS t FROM ({series}{own}) GROUP BY i, j) QUALIFY row_number() OVER (PARTITION BY i ORDER BY t) <= {k}"


VALUE = draw_sql("value", "i || ':' || j")


@query("gen_row_stochastic", f"SELECT i, j, 0.125::DOUBLE AS v FROM ({chosen_sql(64, 8, False)})")
def _(spark, d):
    return gen.row_stochastic(spark, 64, 0.125, 7).entries


@query("gen_column_stochastic", f"SELECT j AS i, i AS j, 0.125::DOUBLE AS v FROM ({chosen_sql(64, 8, False)})")
def _(spark, d):
    return gen.column_stochastic(spark, 64, 0.125, 7).entries


@query("gen_diagonally_dominant", f"SELECT i, j, round(CASE WHEN i = 0 AND j = 0 THEN 231.0 WHEN i = j THEN 80 + {VALUE} * 10 ELSE 1 + {VALUE} * 9 + 0.0625 END, 9) AS v FROM ({chosen_sql(64, 8, True)})")
def _(spark, d):
    return gen.diagonally_dominant(spark, 64, 0.125, 7).entries.select("i", "j", F.round("v", 9).alias("v"))


@query("gen_diagonally_dominant_slice", f"SELECT i - 10 AS i, j, round(CASE WHEN i = j THEN 640001 + {VALUE} * 64 ELSE 1 + {VALUE} * 9999 + 0.0625 END, 6) AS v FROM ({chosen_sql(64, 8, True, 'i BETWEEN 10 AND 20')})")
def _(spark, d):
    return gen.diagonally_dominant_slice(spark, 64, 0.125, 7, 10, 20).entries.select("i", "j", F.round("v", 6).alias("v"))


@query(
    "gen_fixed_eta",
    f"""WITH t AS (SELECT i, row_number() OVER (ORDER BY {draw_sql('eta', 'i')}, i) AS k FROM (SELECT range AS i FROM range(64)) QUALIFY k <= 2)
SELECT c.i, c.j, round(CASE WHEN t.k = 1 THEN 10.0 WHEN t.k = 2 THEN 6.0 WHEN c.i = c.j THEN 4.5 - u * 3.0 ELSE 0.9 * 1.5 / 7 * (1 - u) END, 9) AS v
FROM (SELECT i, j, {VALUE} AS u FROM ({chosen_sql(64, 8, True)})) c LEFT JOIN t ON t.i = c.i WHERE t.i IS NULL OR c.i = c.j""",
)
def _(spark, d):
    return gen.fixed_eta(spark, 64, 0.125, 0.6, 7).entries.select("i", "j", F.round("v", 9).alias("v"))


@query(
    "gen_random",
    f"""SELECT i, j, round(0.001 + {VALUE} * 99999.999, 6) AS v FROM (SELECT p // 30 AS i, p % 30 AS j FROM
(SELECT floor({long_draw_sql('place', 'range')} * 600)::BIGINT AS p, min(range) AS t FROM range({gen.draws_for(60, 600)}) GROUP BY 1) QUALIFY row_number() OVER (ORDER BY t) <= 60)""",
)
def _(spark, d):
    return gen.random(spark, 30, 20, 0.1, 7).entries.select("i", "j", F.round("v", 6).alias("v"))


# Statistics


@query("median_by_group", "SELECT l_returnflag, trunc(median(l_orderkey))::BIGINT AS m FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(median(F.col("l_orderkey")).alias("m"))


@query("average_by_group", "SELECT l_returnflag, trunc(avg(l_orderkey))::BIGINT AS m FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(average(F.col("l_orderkey")).alias("m"))


@query("tolerances", " UNION ALL ".join(f"SELECT {w}::INT AS width, (10 * power(2.0, -52) * power(2.0, {64 - 8 * w}))::DOUBLE AS adjusted, (240 * power(2.0, {12 - 8 * w}))::DOUBLE AS usual" for w in codec.WIDTHS))
def _(spark, d):
    rows = [(w, codec.adjusted_epsilon(w, 10 * 2.0**-52), codec.default_epsilon(w)) for w in codec.WIDTHS]
    return spark.createDataFrame(rows, "width int, adjusted double, usual double")


@query("duplicate_indices", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 1")
def _(spark, d):
    return vector.duplicates(table(spark, d, "lineitem"), "l_suppkey")


@query("vector_lines", "SELECT c_nationkey::BIGINT AS part, string_agg(c_custkey::VARCHAR || '.0', ' ' ORDER BY c_custkey) AS line FROM customer GROUP BY ALL")
def _(spark, d):
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("i"), F.col("c_custkey").cast("double").alias("x"), "c_nationkey")
    return vector.lines(x, F.col("c_nationkey"))


@query(
    "timing_report",
    """WITH t AS (SELECT p_size AS stage, unnest(['spmv_ns', 'exchange_ns', 'overhead_ns']) AS phase, unnest([p_partkey, p_partkey * 2, p_partkey * 7]) AS ns FROM part)
SELECT stage, phase, trunc(median(ns))::BIGINT AS median_ns, trunc(avg(ns))::BIGINT AS average_ns FROM t GROUP BY ALL""",
)
def _(spark, d):
    times = lambda k: F.collect_list(F.col("p_partkey") * k)
    metadata = table(spark, d, "part").groupBy(F.col("p_size").alias("stage")).agg(times(1).alias("spmv_ns"), times(2).alias("exchange_ns"), times(7).alias("overhead_ns"))
    return timing_report(metadata)


# Workloads at small sizes: what they report besides times


@query("workload_convergence", "SELECT * FROM (VALUES (10, 0.5, true), (10, 0.6, true), (20, 0.5, true), (20, 0.6, true)) t(n, density, converged)")
def _(spark, d):
    rows = workloads.convergence(spark, (10, 20), (0.5, 0.6), (1,))
    return spark.createDataFrame([(r["n"], r["density"], all(done for done, _ in r["stages"])) for r in rows], "n int, density double, converged boolean")


@query("workload_precision", "SELECT * FROM (VALUES ('2', true), ('4', true), ('6', true), ('8', true), ('2_4_6_8', true)) t(widths, near)")
def _(spark, d):
    rows = workloads.precision_levels(spark, 20, 0.5, 1)
    most = {2: 0.5, 4: 1e-4, 6: 1e-9, 8: 1e-12}
    return spark.createDataFrame([("_".join(map(str, r["widths"])), r["distance"] <= most[r["widths"][-1]]) for r in rows], "widths string, near boolean")


@query("workload_power", "SELECT unnest(['2_4_6_8', '4_6_8', '4_8', '6_8', '8']) AS widths, true AS converged")
def _(spark, d):
    rows = workloads.power_iterations(spark, (64,), (0.125,), (0.6,))
    return spark.createDataFrame([("_".join(map(str, r["widths"])), r["stages"][-1][0]) for r in rows], "widths string, converged boolean")


@query("workload_spmv", "SELECT unnest(['doubles', '4 bytes, cut inside', '4 bytes, cut outside']) AS form, 64 AS n, true AS timed")
def _(spark, d):
    rows = workloads.spmv_speed(spark, (64,), (0.125,), runs=1, warmup=0)
    return spark.createDataFrame([(r["form"], r["n"], r["median_s"] > 0) for r in rows], "form string, n int, timed boolean")


@query("workload_sweep", "SELECT * FROM (VALUES (10, '4_8', true), (10, '8', true), (20, '4_8', true), (20, '8', true)) t(n, widths, timed)")
def _(spark, d):
    rows = workloads.pagerank_sweep(spark, (10, 20), (0.5,), tests=1, samples=1, widths=((4, 8), (8,)))
    return spark.createDataFrame([(r["n"], "_".join(map(str, r["widths"])), r["median_s"] > 0) for r in rows], "n int, widths string, timed boolean")
