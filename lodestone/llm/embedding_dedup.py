"""Near-duplicate vectors by sorted projection passes.

Every pass orders the vectors by a key of concatenated random hashes and compares each with the WINDOW - 1 before it.
A hash is the side of a random plane; the plane's offset is the median of those vectors of a bounded sample that share
the key so far, so that keys halve dense places as they halve sparse ones, and vectors in a cone as those all around.
Only keys and ids are sorted. Ranks then make blocks of bounded size, and the vectors of a block, with the window before
it, meet in one task. Verified pairs of a block leave it as a forest, the forests of all passes are joined by connected
components.

A pass finds a pair if its planes don't part the two before their surroundings have shrunk to a window. For each vector
both are known: how many leading hashes narrow its surroundings to a window, and how far it and those around it lie from
the planes, from which follows the probability that a vector at the threshold's distance lies on the same side.
Passes are repeated, a few at a time, for the vectors for which all passes together could still have missed such a pair
with a probability over MISS: a pair is only missed if both its vectors' estimates allow it. Vectors so dense that
passes would cost several times as much as comparing them all are compared in blocks, which is exact.

Link counts are exact within a component without comparing all its pairs: vectors closer to the component's pivot than
half the threshold's angle all link with each other (the triangle inequality on the sphere); only the others are
compared with the component's vectors, in blocks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, discard, map_groups, materialise, sides, skew_join, table

WINDOW = 1024
BITS = 40
MISS = 1e-4
#: Rows and columns of the matrices of cosines.
BLOCK = 1024
#: Passes at a time: each moves every pending vector once.
PASSES = 3
#: Passes may cost so many times what comparing all pending vectors would.
PATIENCE = 4
#: The sample that the planes' offsets come from: at most so many vectors, and so many bytes, of each length; a place is
#: halved until it has CELL of them. Lengths beyond the MODELS most frequent have planes without offset.
FIT, FIT_BYTES, CELL, MODELS = 16_384, 1 << 25, 16, 8
SEED = 11


def unit_rows(raw: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in raw]


def normalised(rows: list[np.ndarray]) -> np.ndarray:
    x = np.stack(rows).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spanning(linked: np.ndarray, of: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect the rows and columns of linked as it does, in the numbers of: rows first, then columns."""
    n = len(linked)
    fresh, out = np.ones(linked.shape[1], bool), []
    todo = linked.any(axis=1)
    for i in np.flatnonzero(todo).tolist():
        if not todo[i]:
            continue
        todo[i] = False
        rows = np.array([i])
        while len(rows):
            columns = np.flatnonzero(linked[rows].any(axis=0) & fresh)
            fresh[columns] = False
            out += [(i, n + c) for c in columns.tolist()]
            rows = np.flatnonzero(linked[:, columns].any(axis=1) & todo)
            todo[rows] = False
            out += [(i, r) for r in rows.tolist()]
    return [(int(of[a]), int(of[b])) for a, b in out]


def planes_of(t: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, t, dim]).standard_normal((dim, BITS))


class Planes:
    """The hashes of one pass for vectors of one length."""

    def __init__(self, t: int, dim: int, sample: np.ndarray):
        """sample: unit vectors; without any, the planes have no offset."""
        self.t, self.dim, self.offsets, self.spreads = t, dim, [], []
        at = sample @ planes_of(t, dim)
        cell, fixed = np.zeros(len(sample), np.int64), 0
        for k in range(BITS):
            if len(sample) >= CELL << k:
                fixed = k
            size = 1 << fixed
            order = np.lexsort((at[:, k], cell >> (k - fixed)))
            of = (cell >> (k - fixed))[order]
            first = np.searchsorted(of, np.arange(size + 1))
            n = np.diff(first)
            value = np.append(at[order, k], 0.0)
            low, high = value[np.minimum(first[:-1] + np.maximum(n - 1, 0) // 2, len(sample))], value[np.minimum(first[:-1] + n // 2, len(sample))]
            self.offsets.append(np.where(n > 0, (low + high) / 2, 0.0))
            square = np.bincount(of, (at[order, k] - self.offsets[k][of]) ** 2, size)
            self.spreads.append(np.where(n > 1, np.sqrt(square / np.maximum(n, 1)), 1.0))
            cell = cell * 2 + (at[:, k] > self.offsets[k][cell >> (k - fixed)])

    def hashes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, distances from the planes, the spread of such distances around the vector) of unit vectors."""
        at = x @ planes_of(self.t, self.dim)
        key, apart, spread = np.zeros(len(x), np.int64), np.empty((len(x), BITS)), np.empty((len(x), BITS))
        for k, offset in enumerate(self.offsets):
            cell = key >> (k - (len(offset).bit_length() - 1))
            apart[:, k], spread[:, k] = at[:, k] - offset[cell], self.spreads[k][cell]
            key = key * 2 + (apart[:, k] > 0)
        return key, np.abs(apart), spread


_Z = np.linspace(0, 6, 1201)
_LOG_SAME = np.log([0.5 * (1 + math.erf(z / math.sqrt(2))) for z in _Z])


def together(apart: np.ndarray, spread: np.ndarray, threshold: float) -> np.ndarray:
    """The probability that a vector at the threshold's distance shares the first 0, 1, ... hashes. Seen from a plane both
    are draws of one normal distribution, as wide as the spread; their distance gives the correlation."""
    square = np.maximum(spread, 1e-9) ** 2
    rho = np.clip(1 - (1 - threshold) / square, 0, 1 - 1e-12)
    log_same = np.interp(rho * apart / np.sqrt((1 - rho**2) * square), _Z, _LOG_SAME)
    return np.exp(np.concatenate([np.zeros((len(apart), 1)), np.cumsum(log_same, axis=1)], axis=1))


def shared_signs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading hashes two keys share."""
    return BITS - np.frexp((a ^ b).astype(float))[1]


def linked_tree(forest: Forest, ids: np.ndarray, x: np.ndarray, near: np.ndarray, threshold: float, rows: slice, columns: slice, allowed=None) -> None:
    """Unite what the cosines of two slices of unit vectors link. near: x in single precision; what that leaves open is
    computed again."""
    slack = x.shape[1] * 1.2e-7 + 1e-6
    cosine = near[rows] @ near[columns].T
    linked = cosine >= threshold + slack
    open_ = np.argwhere((cosine >= threshold - slack) & ~linked)
    if len(open_):
        linked[open_[:, 0], open_[:, 1]] = np.einsum("ij,ij->i", x[rows][open_[:, 0]], x[columns][open_[:, 1]]) >= threshold
    if allowed is not None:
        linked &= allowed
    if linked.any():
        for v, w in spanning(linked, np.concatenate([ids[rows], ids[columns]])):
            forest.unite(v, w)


def models(classes: DataFrame, width: int) -> dict[int, np.ndarray]:
    """By length, the sample that planes are fitted on, as unit vectors."""
    out = {}
    lengths = classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(MODELS).collect()
    for dim, n in lengths:
        most = max(1, min(FIT, FIT_BYTES // (dim * width)))
        rows = classes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("cid"), F.lit(-(-n // most))) == 0)).select("raw").limit(2 * most).toPandas()["raw"]
        if len(rows):
            out[dim] = normalised([np.frombuffer(r, "<f4" if width == 4 else "<f8") for r in rows])
    return out


def ranked(rows: DataFrame, planes, passes: range, kind: str) -> DataFrame:
    """(pass, dim, key, cid, rank) of every row in every pass; ranks run over all passes in the order of the keys."""

    def run(batches):
        for batch in batches:
            raw, dims = batch.column("raw"), batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = normalised(unit_rows(raw.take(pa.array(at)), kind))
                for t in passes:
                    p = planes.value.get((t, dim)) or Planes(t, dim, np.zeros((0, dim)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), t, np.int32)), pa.array(np.full(len(at), dim, np.int32)), pa.array(p.hashes(x)[0]), batch.column("cid").take(pa.array(at))], names=["pass", "dim", "key", "cid"]
                    )

    def number(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(seen + np.arange(n))], names=[*batch.schema.names, "part", "place"])
            seen += n

    order = ["pass", "dim", "key", "cid"]
    sorted_ = rows.select("cid", "dim", "raw").mapInArrow(run, "pass int, dim int, key long, cid long").repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialise(sorted_.mapInArrow(number, "pass int, dim int, key long, cid long, part int, place long"))
    sizes, before, total = sorted(tuple(r) for r in numbered.groupBy("part").agg(F.count("*")).collect()), [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "part int, before long"))  # a row for each partition
    out = numbered.join(starts, "part").select(*order, (F.col("before") + F.col("place")).alias("rank"))
    out.scratch = numbered.scratch
    return out


def swept(rows: DataFrame, planes, passes: range, kind: str, threshold: float) -> DataFrame:
    """As rows with b the edges that the windows of the passes give; as rows without, for the vector a of each row and pass
    the logarithm of the probability that a pair at the threshold is missed."""
    window, span = WINDOW, 3 * WINDOW
    order = ranked(rows, planes, passes, kind)
    last, block = window - 1, F.floor(F.col("rank") / span)
    # a block has its own rows (0), the window before them (-1), and of the window after them the keys alone (1)
    places = F.array(
        F.struct(block.alias("block"), F.lit(0).alias("side")),
        *[F.when(ok, F.struct((block + step).alias("block"), F.lit(-step).alias("side"))) for step, ok in ((1, F.col("rank") % span >= span - window), (-1, (F.col("rank") % span < window) & (block > 0)))],
    )
    placed = order.withColumn("p", F.explode(F.filter(places, lambda p: p.isNotNull()))).select("pass", "dim", "key", "cid", "rank", "p.*")
    empty = F.lit(None).cast("binary")
    with_raw = placed.where("side < 1").join(rows.select("cid", "raw"), "cid")
    placed = with_raw.unionByName(placed.where("side = 1").withColumn("raw", empty))

    def sweep(_, t):
        side, dims, keys, ids = (t.column(c).to_numpy() for c in ("side", "dim", "key", "cid"))
        group = t.column("pass").to_numpy().astype(np.int64) << 32 | dims
        raws = t.column("raw").to_pylist()
        n, forest, at = len(side), Forest(), np.arange(len(side))
        missed = np.zeros(n)
        for g in np.unique(group[side == 0]).tolist():
            of = np.flatnonzero((group == g) & (side < 1))
            x = normalised([np.frombuffer(raws[i], kind) for i in of])
            near, mine = x.astype(np.float32), ids[of]
            for lo in range(int((side[of] < 0).sum()), len(of), BLOCK // 4):
                high, low = min(lo + BLOCK // 4, len(of)), max(0, lo - last)
                back = np.arange(lo, high)[:, None] - np.arange(low, high)
                linked_tree(forest, mine, x, near, threshold, slice(lo, high), slice(low, high), (back > 0) & (back <= last))
            own = of[side[of] == 0]
            # a window that starts or ends within the group need not be narrowed down on that side
            p = planes.value.get((g >> 32, g & 0xFFFFFFFF)) or Planes(g >> 32, g & 0xFFFFFFFF, np.zeros((0, g & 0xFFFFFFFF)))
            same, miss = together(*p.hashes(x[side[of] == 0])[1:], threshold), np.ones(len(own))
            for other in (own - window, own + window):
                # own rows are window rows away from what stands just outside of their window
                inside = (other >= 0) & (other < n)
                inside[inside] = group[other[inside]] == g
                need = np.zeros(len(own), np.int64)
                need[inside] = shared_signs(keys[own[inside]], keys[other[inside]]) + 1
                hit = np.where(need <= BITS, same[np.arange(len(own)), np.minimum(need, BITS)], 0.0)
                miss -= hit / 2
            missed[own] = np.log(np.maximum(miss, 1e-12))
        a, b = forest.edges()
        mine = at[side == 0]
        return {"a": [*a, *ids[mine].tolist()], "b": [*b, *[None] * len(mine)], "missed": [*[None] * len(a), *missed[mine].tolist()]}

    found = materialise(map_groups(placed, ["block"], sweep, "a long, b long, missed double", ["rank"]))
    discard(order)
    return found


def all_pairs(classes: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Edges (a, b) that connect what any pair of the classes links; every pair is compared, in blocks."""
    sizes = classes.groupBy("dim").agg(F.count("*").alias("n"))
    of = sizes.select("dim", F.greatest(F.lit(6), sides(F.col("n"), 8 * F.col("n") * F.col("dim"))).alias("blocks"))
    placed = skew_join(classes.select("cid", "dim", "raw"), of, ["dim"])
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = placed.select("dim", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).alias("left"), (F.col("mine") >= F.col("other")).alias("right"), "cid", "raw")

    def compare(key, rows):
        cid = rows.column("cid").to_numpy()
        left, right = (np.flatnonzero(rows.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
        order = np.concatenate([left, right])
        x = normalised([np.frombuffer(r, kind) for r in rows.column("raw").to_pylist()])[order]
        near, ids = x.astype(np.float32), cid[order]
        forest, n = Forest(), len(left)
        for a in range(0, n, BLOCK):
            for b in range(a if key[1] == key[2] else 0, len(right), BLOCK):
                linked_tree(forest, ids, x, near, threshold, slice(a, min(a + BLOCK, n)), slice(n + b, n + min(b + BLOCK, len(right))))
        a, b = forest.edges()
        return {"a": a, "b": b}

    return map_groups(pairs, ["dim", "i", "j"], compare, "a long, b long")


def found_edges(classes: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Edges (a, b) that connect linked classes."""
    context, width, goal = classes.sparkSession.sparkContext, int(kind[-1]), math.log(MISS)
    samples = models(classes, width)
    pending, n, t, edges = classes.select("cid", "dim", "raw", F.lit(0.0).alias("missed")), classes.count(), 0, []
    while n:
        passes = range(t, t + PASSES)
        planes = context.broadcast({(k, dim): Planes(k, dim, x) for k in passes for dim, x in samples.items()})
        found = swept(pending, planes, passes, kind, threshold)
        edges.append(found.where("b is not null").select("a", "b"))
        seen = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("missed").alias("more"))
        t += PASSES
        before, pending = pending, materialise(pending.join(seen, "cid").withColumn("missed", F.col("missed") + F.col("more")).drop("more").where(F.col("missed") > goal))
        if before is not classes and hasattr(before, "scratch"):
            discard(before)
        n, mean = pending.agg(F.count("*"), F.avg("missed")).first()
        if n and (goal - mean) / min(mean / t, -1e-9) * WINDOW > PATIENCE * n:
            edges.append(all_pairs(pending, kind, threshold))
            break
    out = edges[0] if edges else classes.sparkSession.createDataFrame([], "a long, b long")
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def link_counts(members: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(cid, n_links) from (comp, cid, w, raw): how many vectors, copies included, each links with."""
    near = math.cos(math.acos(threshold) / 2) + 1e-9

    def to_pivot(batches):
        for batch in batches:
            if batch.num_rows:
                dims = [len(x) for x in batch.column("raw").to_pylist()]
                cos = np.zeros(batch.num_rows)
                for dim in set(dims):
                    at = [i for i, d in enumerate(dims) if d == dim]
                    x, p = (normalised(unit_rows(batch.column(c).take(pa.array(at)), kind)) for c in ("raw", "pivot"))
                    cos[at] = np.einsum("ij,ij->i", x, p)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("comp", "cid", "w", "raw")), pa.array(cos >= near)], names=["comp", "cid", "w", "raw", "core"])

    pivots = members.where("cid = comp").select("comp", F.col("raw").alias("pivot"))
    placed = materialise(skew_join(members, pivots, ["comp"]).mapInArrow(to_pivot, "comp long, cid long, w long, raw binary, core boolean"))
    size = F.octet_length("raw") * 3
    sums = placed.groupBy("comp").agg(F.sum(F.when(F.col("core"), F.col("w"))).alias("core_w"), F.count("*").alias("m"), F.sum((~F.col("core")).cast("long")).alias("q"), F.sum(size).alias("s"))
    sums = sums.select("comp", "core_w", "q", sides(F.col("m"), F.col("s")).alias("mb"), sides(F.col("q"), F.col("s") * F.col("q") / F.col("m")).alias("qb"))
    known = materialise(skew_join(placed, sums, ["comp"]))
    rest = known.where("q > 0")
    block = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rest.where("not core").withColumn("i", block("qb")).withColumn("j", each("mb")).withColumn("query", F.lit(True))
    right = rest.withColumn("j", block("mb")).withColumn("i", each("qb")).withColumn("query", F.lit(False))
    columns = ["comp", "i", "j", "query", "cid", "w", "raw", "core"]

    def compare(key, rows):
        query = rows.column("query").to_numpy(zero_copy_only=False)
        core = rows.column("core").to_numpy(zero_copy_only=False)
        if query.all() or not query.any():
            return None
        x = normalised([np.frombuffer(r, kind) for r in rows.column("raw").to_pylist()])
        cid, w = rows.column("cid").to_numpy(), rows.column("w").to_numpy()
        asked, others = np.flatnonzero(query), np.flatnonzero(~query)
        n = np.zeros(len(cid), np.int64)
        for a in range(0, len(asked), BLOCK):
            for b in range(0, len(others), BLOCK):
                p, o = asked[a : a + BLOCK], others[b : b + BLOCK]
                linked = x[p] @ x[o].T >= threshold
                linked |= cid[p][:, None] == cid[o]
                n[p] += linked @ w[o]
                n[o] += w[p] @ linked
        told = np.concatenate([asked, others[core[others]]])
        return {"cid": cid[told], "n": n[told]}

    more = map_groups(left.select(columns).unionByName(right.select(columns)), ["comp", "i", "j"], compare, "cid long, n long").groupBy("cid").agg(F.sum("n").alias("n"))
    own = known.select("cid", F.when(F.col("core"), F.col("core_w")).otherwise(F.lit(0)).alias("own"))
    return own.join(more, "cid", "left").select("cid", (F.col("own") + F.coalesce("n", F.lit(0)) - 1).alias("n_links"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors link if their cosine in double precision is at least threshold (over 0). A vector that is null, empty or
    zero, holds null or non-finite components, or has a null id, links with nothing: n_links 0, component_id its own id,
    kept true. Vectors of different lengths don't link. Equal vectors are one class with a weight, so thousands of
    copies cost no more than one; rows that repeat an id each count as a vector. Other columns of the input are left
    out. An empty table gives an empty result.
    """
    element = dict(vectors.dtypes)[vec_col]
    kind, width = ("<f4", 4) if element == "array<float>" else ("<f8", 8)
    vec = F.col(vec_col) if width == 4 else F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    valid = F.coalesce(F.col(id_col).isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))
    # two hashes name a vector: equal ones are one class, however many there are
    name = [F.xxhash64("vec").alias("v1"), F.xxhash64(F.lit(1), "vec").alias("v2")]
    base = vectors.select(F.col(id_col).alias("id"), vec.alias("vec"), valid.alias("valid")).select("id", "vec", "valid", *name)
    grouped = base.where("valid").groupBy("v1", "v2").agg(F.min("id").alias("rep"), F.count("*").alias("w"), F.first("vec").alias("vec"))

    def pack(batches):
        for batch in batches:
            vecs = batch.column("vec")
            flat, off = vecs.flatten().to_numpy(zero_copy_only=False).astype(kind), vecs.offsets.to_numpy() - vecs.offsets[0].as_py()
            raw = [flat[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("v1", "v2", "rep", "w")), pa.array(np.diff(off).astype(np.int32)), pa.array(raw, pa.binary())], names=["v1", "v2", "rep", "w", "dim", "raw"])

    rep_type = dict(grouped.dtypes)["rep"]
    classes = materialise(grouped.mapInArrow(pack, f"v1 long, v2 long, rep {rep_type}, w long, dim int, raw binary"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()))
    comps = components(found_edges(classes, kind, threshold))
    members = materialise(classes.join(comps.select(F.col("id").alias("cid"), F.col("component").alias("comp")), "cid").select("comp", "cid", "w", "rep", "raw"))
    counts = link_counts(members.select("comp", "cid", "w", "raw"), kind, threshold)
    least = members.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = skew_join(members.select("comp", "cid"), least, ["comp"]).join(counts, "cid").select("cid", "component_id", "n_links")
    of_class = materialise(classes.join(named, "cid", "left").select("v1", "v2", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("n_links", F.col("w") - 1).alias("n_links")))
    linked = skew_join(base.where("valid").select("id", "v1", "v2"), of_class, ["v1", "v2"]).select("id", "n_links", "component_id")
    alone = base.where("not valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
