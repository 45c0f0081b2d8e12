"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with the same words are one class. Each class has the set of its five-word shingles and a MinHash signature; two
classes are candidates if all ROWS values of one of BANDS bands agree, which a pair at the threshold misses with a
probability of (1 - 0.8 ** ROWS) ** BANDS = 5e-8. Candidates are compared a few MinHash values at a time, and dropped
once the posterior probability of a similarity at the threshold or above is under TOLERANCE. The survivors of a bucket
leave it as a forest, for which a class that is tied to its tree is compared with none but those that are in no tree
yet; the trees, joined over all buckets, are groups within which the comparison is done between all classes, and the
survivors are verified exactly on their shingle sets. Large buckets and groups are split into blocks, every two of which
meet in a task, BLOCK classes of either at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, U, components, discard, grams, map_groups, materialise, mix, sides, skew_join, table, text_chunks
from .embedding_dedup import spanning

SHINGLE = 5
BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
TOLERANCE = 1e-6
STEP = 16
BLOCK = 512
_rng = np.random.default_rng(77)
MULTIPLY = (_rng.integers(0, 1 << 32, VALUES, dtype=np.uint64) | 1).astype(np.uint32)
FLIP = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> U(32)).astype(np.uint32)
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, ((x[i : i + 1024, None] ^ FLIP) * MULTIPLY).min(axis=0), out=out)
    return out


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n values, the fewest matches m with P(similarity >= threshold | m of n match) >= tolerance, for a uniform
    prior: that probability is P(Binomial(n + 1, threshold) <= m)."""
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def survivors(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of signatures in a and b that no step drops."""
    least = least_matches(threshold)
    same = np.zeros((len(a), len(b)), np.int16)
    for k in range(STEP):
        same += a[:, k, None] == b[None, :, k]
    i, j = np.nonzero(same >= least[STEP])
    matches = same[i, j]
    for n in range(STEP, VALUES, STEP):
        for lo in range(0, len(i), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            matches[s] += (a[i[s], n : n + STEP] == b[j[s], n : n + STEP]).sum(axis=1, dtype=np.int16)
        keep = matches >= least[n + STEP]
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def trees(a: np.ndarray, b: np.ndarray | None, threshold: float) -> list[tuple[int, int]]:
    """Edges that connect the signatures as their surviving pairs do, of a alone or, with numbers from len(a) on for b,
    between a and b. Trees grow one after the other, each from one signature, against those that are in no tree."""
    sig = a if b is None else np.concatenate([a, b])
    of_b = np.arange(len(sig)) >= len(a) if b is not None else np.zeros(len(sig), bool)
    free, out = np.ones(len(sig), bool), []
    for seed in range(len(a)):
        if not free[seed]:
            continue
        free[seed] = False
        todo = np.array([seed])
        while len(todo):
            now, todo = todo[:BLOCK], todo[BLOCK:]
            for side in (False, True) if b is not None else (False,):
                rows = now[of_b[now] == side]
                others = np.flatnonzero(free & (of_b != side)) if b is not None else np.flatnonzero(free)
                for lo in range(0, len(others) if len(rows) else 0, 1 << 14):
                    part = others[lo : lo + (1 << 14)]
                    i, j = survivors(sig[rows], sig[part], threshold)
                    found, first = np.unique(j, return_index=True)
                    out += zip(rows[i[first]].tolist(), part[found].tolist(), strict=True)
                    free[part[found]] = False
                    todo = np.concatenate([todo, part[found]])
    return out


def word_keys(w) -> list[np.ndarray]:
    """Two hashes of each text's sequence of words."""
    spread = w.hash * (2 * (np.arange(len(w.hash)) - w.first[:-1][w.text]).astype(U) + U(1))
    out = []
    for flip in (0, 0x5851F42D4C957F2D):
        sums = np.zeros(len(w.hash) + 1, U)
        np.cumsum(mix(spread ^ U(flip)), out=sums[1:])
        out.append(mix(np.diff(sums[w.first]) + np.diff(w.first).astype(U)).astype(np.int64))
    return out


def shingle_sets(w) -> list[np.ndarray]:
    """The set of shingle hashes of each text."""
    every = grams(w.hash, SHINGLE)
    sets = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        sets.append(np.unique(every[a : b - SHINGLE + 1]) if b - a >= SHINGLE else grams(w.hash[a:b], b - a) if b > a else np.zeros(0, U))
    return sets


def described(rows: DataFrame, with_sets: bool) -> DataFrame:
    """(id, key, k1, k2, data) from (id, key, text): data is the signature, null without words, or with_sets the shingles."""
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        for batch in batches:
            for low, high, w in text_chunks(batch.column("text")):
                k1, k2 = word_keys(w)
                data = [x.tobytes() if with_sets else signature(x).tobytes() if len(x) else None for x in shingle_sets(w)]
                own = [batch.column(c)[low:high] for c in ("id", "key")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(k1), pa.array(k2), pa.array(data, pa.binary())], names=["id", "key", "k1", "k2", "data"])

    return rows.select("id", "key", "text").mapInArrow(run, f"id {kind}, key long, k1 long, k2 long, data binary")


def blocks(rows: DataFrame, group: str, member: str, size) -> DataFrame:
    """rows of groups of several, each for every pair (i, j), i <= j, of blocks of its group in which its own block takes
    part. size: the bytes of a row in a task."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"), F.sum(size).alias("_s")).where("_n > 1").select(group, sides(F.col("_n"), F.col("_s")).alias("_b"))
    own = F.when(F.col("_b") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64(member), F.col("_b")).cast("int"))
    spread = skew_join(rows, sizes, [group]).withColumn("own", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return spread.withColumn("i", F.least("own", "_o")).withColumn("j", F.greatest("own", "_o")).drop("_b", "_o")


def two_sides(rows: pa.Table, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    own = rows.column("own").to_numpy()
    return np.flatnonzero(own == i), np.flatnonzero(own == j)


def bucket_edges(classes: DataFrame, threshold: float) -> DataFrame:
    """Forest edges (a, b) between classes that survive the pruning in some bucket."""

    def bands(batches):
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, VALUES)
                for k in range(BANDS):
                    part = sig[:, k * ROWS : (k + 1) * ROWS].astype(U)
                    key = np.full(len(sig), k + 1, U)
                    for c in range(ROWS):
                        key = mix(key + part[:, c])
                    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), batch.column("cid")], names=["bucket", "cid"])

    def short(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).astype(np.uint8).reshape(-1, VALUES)
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array([x.tobytes() for x in sig], pa.binary())], names=["cid", "sig"])

    def prune(key, rows):
        _, i, j = key
        left, right = two_sides(rows, i, j)
        cid = rows.column("cid").to_numpy()
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, VALUES)
        at = left if i == j else np.concatenate([left, right])
        forest = Forest()
        for x, y in trees(sig[left], None if i == j else sig[right], threshold):
            forest.unite(int(cid[at[x]]), int(cid[at[y]]))
        a, b = forest.edges()  # buckets of the same classes have the same edges, to the least of them
        return {"a": a, "b": b}

    banded = materialise(classes.select("cid", "sig").mapInArrow(bands, "bucket long, cid long"))
    # one byte of each value will do here: equal values have equal bytes, so that no pair looks less alike than it is
    bytes_of = classes.select("cid", "sig").mapInArrow(short, "cid long, sig binary")
    placed = blocks(banded, "bucket", "cid", F.lit(VALUES))
    edges = materialise(map_groups(placed.join(bytes_of, "cid"), ["bucket", "i", "j"], prune, "a long, b long"))
    discard(banded)
    return edges


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """(cid, other, n) for the groups comp of members (comp, cid, w, sig, shingles): as rows with n null a forest of
    exactly verified links, as rows with other null the documents that cid links with in one pair of blocks."""
    num, den = threshold_ratio(threshold)

    def verify(key, rows):
        _, i, j = key
        left, right = two_sides(rows, i, j)
        cid, w = rows.column("cid").to_pylist(), rows.column("w").to_numpy()
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(-1, VALUES)
        sets = [np.frombuffer(x.as_buffer(), U) for x in rows.column("shingles").combine_chunks()]
        size = np.array([len(s) for s in sets])
        n, forest = np.zeros(len(cid), np.int64), Forest()
        for lo in range(0, len(left), BLOCK):
            for at in range(lo if i == j else 0, len(right), BLOCK):
                l, r = left[lo : lo + BLOCK], right[at : at + BLOCK]
                a, b = survivors(sig[l], sig[r], threshold)
                x, y = l[a], r[b]
                if i == j and lo == at:
                    x, y = x[x < y], y[x < y]
                inter = common_counts(sets, x, y)
                good = den * inter >= num * (size[x] + size[y] - inter)
                x, y = x[good], y[good]
                np.add.at(n, x, w[y])
                np.add.at(n, y, w[x])
                new, first = np.unique(y, return_index=True)
                seen, again = np.unique(x, return_index=True)
                linked = np.zeros((len(seen), len(new)), bool)
                linked[np.searchsorted(seen, x), np.searchsorted(new, y)] = True
                for p, q in spanning(linked, np.concatenate([x[again], y[first]])):
                    forest.unite(cid[p], cid[q])
        some = np.flatnonzero(n).tolist()
        e, f = forest.edges()
        return {"cid": [cid[k] for k in some] + e, "other": [None] * len(some) + f, "n": n[some].tolist() + [None] * len(e)}

    placed = blocks(members, "comp", "cid", F.octet_length("sig") + F.octet_length("shingles"))
    return map_groups(placed, ["comp", "i", "j"], verify, "cid long, other long, n long")


def threshold_ratio(threshold: float) -> tuple[int, int]:
    """threshold as a ratio of integers, so that the exact check has no rounding."""
    scaled = round(threshold * 1000)
    return scaled, 1000


def common_counts(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Size of the intersection of sets x[k] and y[k] for each k, by products of incidence rows over the shared shingles."""
    out = np.zeros(len(x), np.int64)
    if not len(x):
        return out
    used = np.unique(np.concatenate([x, y]))
    if len(x) < 8 * len(used):
        return np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(x.tolist(), y.tolist(), strict=True)])
    flat = np.concatenate([sets[k] for k in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    values, slot, count = np.unique(flat, return_inverse=True, return_counts=True)
    often = np.cumsum(count > 1) - 1
    shared = count[slot] > 1
    owner, slot = owner[shared], often[slot[shared]]
    order = np.argsort(slot, kind="stable")
    owner, slot = owner[order], slot[order]
    xs, ys = np.searchsorted(used, x), np.searchsorted(used, y)
    total = int((count > 1).sum())
    width = max(1, min(total, 4_000_000 // max(1, len(used))))
    for lo in range(0, total, width):
        a, b = np.searchsorted(slot, [lo, lo + width])
        rows = np.zeros((len(used), min(width, total - lo)), np.float32)
        rows[owner[a:b], slot[a:b] - lo] = 1
        out += (rows @ rows.T)[xs, ys].astype(np.int64)
    return out


def classified(documents: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(id, key, n_links, best) for each row: key is a hash of its text, best the least (id, key) that links reach, null
    for rows that link with nothing."""
    texts = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    signed = materialise(described(texts, False).withColumn("valid", F.col("data").isNotNull() & F.col("id").isNotNull()))
    grouped = signed.where("valid").groupBy("k1", "k2").agg(F.min(F.struct("id", "key")).alias("rep"), F.count("*").alias("w"), F.first("data").alias("sig"))
    named = materialise(grouped.withColumn("cid", F.monotonically_increasing_id()))
    keys = materialise(signed.drop("data"))
    discard(signed)
    edges = bucket_edges(named.select("cid", "sig"), threshold)
    close = components(edges).select(F.col("id").alias("cid"), F.col("component").alias("comp"))
    discard(edges)
    of_group = materialise(named.join(close, "cid").select("comp", "cid", "w", "rep", "k1", "k2", "sig"))
    with_signatures, named = named, materialise(named.drop("sig"))
    discard(with_signatures)
    wanted = of_group.select("rep.id", "rep.key").distinct()
    # members grow with the corpus: their texts come by the same sort-merge join at every size
    sets = described(texts.join(wanted.hint("merge"), ["id", "key"]), True).dropDuplicates(["k1", "k2"]).select("k1", "k2", F.col("data").alias("shingles"))
    members = materialise(of_group.join(sets, ["k1", "k2"]).select("comp", "cid", "w", "sig", "shingles"))
    discard(of_group)
    found = materialise(verified(members, threshold))
    discard(members)
    linked = components(found.where("n is null").select(F.col("cid").alias("a"), F.col("other").alias("b"))).select(F.col("id").alias("cid"), F.col("component").alias("comp"))
    least = linked.join(named.select("cid", "rep"), "cid").groupBy("comp").agg(F.min("rep").alias("best"))
    best = skew_join(linked, least, ["comp"]).drop("comp")
    count = found.where("other is null").groupBy("cid").agg(F.sum("n").alias("n"))
    per_class = named.join(best, "cid", "left").join(count, "cid", "left").select("k1", "k2", F.coalesce("best", "rep").alias("best"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    per_class = materialise(per_class)
    discard(found)
    discard(named)
    alone = keys.where("not valid").select("id", "key", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast(dict(per_class.dtypes)["best"]).alias("best"))
    return skew_join(keys.where("valid").drop("valid"), per_class, ["k1", "k2"]).select("id", "key", "n_links", "best").unionByName(alone)


def jaccard_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per document: id, n_links, class_id, kept.

    Two documents link if their sets of five-word shingles have a Jaccard similarity of threshold or more; n_links
    counts the others that a document links with, copies included; class_id is the smallest id that links reach; kept
    is true for that document alone. A text of one to four words has one shingle, all its words. A null text, one
    without words, or a null id links with nothing: n_links 0, class_id its own id, kept true. Rows with the same words
    are copies, those that repeat an id too (here ids tell them not apart: all rows of the smallest id have kept true;
    keep_one keeps one of them). Other columns are left out; an empty table gives no rows.
    """
    found = classified(documents, id_col, text_col, threshold).withColumn("class_id", F.coalesce("best.id", "id"))
    return found.select(F.col("id").alias(id_col), "n_links", "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of each group of linked documents, with all its columns: the one with the smallest doc_id, of several such
    the one whose text has the smallest hash, of rows equal in both any one. So rows that share an id but not a group
    are judged each by itself. Rows with a null doc_id and texts without words link with nothing and stay, repeated ones
    too. An empty table gives no rows. documents is read several times.
    """
    rows = materialise(classified(documents, "doc_id", "text", threshold).where("best is not null"))
    mark = ["doc_id", "_lodestone_key"]
    named = lambda df: df.select(F.col("id").alias(mark[0]), F.col("key").alias(mark[1]))
    keyed = documents.withColumn(mark[1], F.xxhash64("text"))
    gone = named(rows.where((F.col("id") != F.col("best.id")) | (F.col("key") != F.col("best.key")))).distinct()
    repeated = materialise(named(rows.where((F.col("id") == F.col("best.id")) & (F.col("key") == F.col("best.key"))).groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1")))
    single = keyed.join(gone.unionByName(repeated), mark, "left_anti").select(*[keyed[c] for c in documents.columns])
    if not repeated.limit(1).count():
        return single
    # any_value is combined before the shuffle, so that a row repeated over and over is not gathered
    once = keyed.join(F.broadcast(repeated) if repeated.limit(100_001).count() <= 100_000 else repeated, mark, "left_semi")
    once = once.groupBy(*mark).agg(F.any_value(F.struct(*[keyed[c] for c in documents.columns])).alias("_lodestone_row"))
    return single.unionByName(once.select("_lodestone_row.*"))


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))
