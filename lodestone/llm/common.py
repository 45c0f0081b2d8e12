"""What the operators of this subpackage share: scratch tables, byte-level word hashing and grouped tasks.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere. The hashing kernels work on the UTF-8 bytes of an Arrow column, a few
hundred kilobytes at a time, so that a task's memory does not depend on how long its texts are together.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Bytes that separate words: space and U+0009 to U+000D.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"
IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(SEPARATORS)] = True
CHUNK_BYTES = 1 << 20
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where a single machine runs everything may it be
    unset; a temporary one takes its place then."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: survives lost executors and ends the lineage. Spark
    deletes the shuffle files of the job when it is over."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(schema).parquet(path)
    out.scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialise wrote, once nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.scratch)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(U, copy=True)
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def powers(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(max(n, CHUNK_BYTES + 1), base, U)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any stretch of data through span_hash."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; nulls become empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw


class Words:
    """The words of consecutive texts: byte spans in data, a hash for each, and first[i]:first[i+1] for text i."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, lower: bool = False):
        if lower:
            data = np.where((data >= 65) & (data <= 90), data | 32, data)
        self.data, self.offsets = data, offsets
        inside = ~IS_SEPARATOR[data]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offsets[offsets < len(data)]
        starts[edge] = inside[edge]
        edge = offsets[offsets > 0] - 1
        ends[edge] = inside[edge]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.prefix = prefix_hash(data)
        self.hash = span_hash(self.prefix, self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)

    @property
    def text(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_chunks(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """Texts low to high of the column at a time, about CHUNK_BYTES together (one text at least), as Words."""
    offsets, data = string_buffers(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES, "right")) - 1)
        yield low, high, Words(offsets[low : high + 1] - offsets[low], data[offsets[low] : offsets[high]], lower)
        low = high


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= U(0x100000001B3)
        out += hashes[i : i + n]
    return mix(out)


def gram_mask(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of n gram positions lie within one text; first: as in Words."""
    total = first[-1]
    limit = np.repeat(first[1:], np.diff(first))[: max(0, total - k + 1)]
    return np.arange(max(0, total - k + 1)) + k <= limit


def map_groups(df: DataFrame, keys: list[str], fn: Callable, schema: str, order: list[str] = (), placed: bool = False) -> DataFrame:
    """fn(key tuple, table) for the rows of each key, one group in memory at a time; fn returns a dict of columns or
    None. Groups must be bounded by construction; a partition may hold any number of them. placed: df already has equal
    keys in one partition."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    arrow = to_arrow_schema(parsed)

    def run(batches):
        held: list[pa.Table] = []
        out: list[pa.RecordBatch] = []
        size = 0

        def close():
            whole = pa.concat_tables(held).combine_chunks()
            held.clear()
            got = fn(tuple(whole.column(k)[0].as_py() for k in keys), whole)
            if got is not None:
                made = pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)
                if made.num_rows:
                    out.append(made)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            change = np.zeros(t.num_rows, bool)
            for k in keys:
                values = t.column(k).to_numpy()
                change[1:] |= values[1:] != values[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), t.num_rows]
            same = held and all(held[-1].column(k)[-1].as_py() == t.column(k)[0].as_py() for k in keys)
            if held and not same:
                close()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a and held:
                    close()
                held.append(t.slice(a, b - a))
            size = sum(x.num_rows for x in out)
            if size > 5000:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                out.clear()
        if held:
            close()
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return (df if placed else df.repartition(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, parsed)


def uniform(seed: str, *columns):
    """A number in [0, 1) that depends on the columns and the seed alone; the same in any engine that has MD5."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


#: A key is hot if it holds more than one HOT-th of the rows, and HOT_ROWS at least.
HOT, HOT_ROWS = 1000, 100


def hot_keys(df: DataFrame, keys: list[str]) -> list[tuple]:
    """The hot keys of df, HOT at most, each with the number of parts that it is to be split into."""
    rows = df.count()
    most = max(rows // HOT, HOT_ROWS)
    found = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most) if rows > most else None
    return [(*r[:-1], -(-r[-1] // most)) for r in found.collect()] if found is not None else []


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot: list[tuple] | None = None) -> DataFrame:
    """left joined with right, which has one row for each key. Rows of left with a hot key are dealt over several tasks by
    a hash of their columns, and right's row goes to each of them. hot: as from hot_keys; any keys give right results."""
    hot = hot_keys(left, keys) if hot is None else hot
    if not hot:
        return left.join(right, keys, how)
    kinds = dict(left.dtypes)
    salts = F.broadcast(left.sparkSession.createDataFrame(hot, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", _parts int"))
    own = F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_parts")), F.lit(0)).cast("int")
    salted = left.join(salts, keys, "left").withColumn("_salt", own).drop("_parts")
    spread = right.join(salts, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")


#: Bytes of a block of members that meet others in one task.
SIDE_BYTES = 1 << 26


def sides(n, size):
    """Into how many blocks a group of n members with size bytes is split for comparing all its members with each other:
    with the fourth root of n, for parallel work, and so many that a block's bytes stay bounded. What leaves the tasks
    so grows little faster than the group."""
    return F.greatest(F.when(n <= 512, F.lit(1)).otherwise(F.ceil(2 * F.pow(n / 1024, F.lit(0.25)))), F.ceil(size / SIDE_BYTES)).cast("int")


class Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        up = self.up
        while (b := up.setdefault(a, a)) != a:
            up[a] = up.setdefault(b, b)
            a = up[a]
        return a

    def unite(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        pairs = [(a, r) for a in self.up if (r := self.root(a)) != a]
        return [a for a, _ in pairs], [r for _, r in pairs]


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(id, component) for the ids in edges (a, b): component is the smallest id that links reach.

    Every round hooks each id to the smallest label around it and then follows labels once (pointer jumping), so paths
    shorten geometrically. Rounds are written to the shared folder; only counts and hot keys reach the driver. Minima
    are aggregated before the shuffle, and joins deal the links of a hub and the ids of a large component over tasks.
    First every task reduces the edges that it reads to a forest. Ids are longs.
    """

    def reduced(batches):
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                forest.unite(a, b)
        a, b = forest.edges()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    both = edges.select("a", "b").where("a <> b").mapInArrow(reduced, "a long, b long")
    both = materialise(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    hubs = hot_keys(both, ["b"])
    for _ in range(limit):
        around = skew_join(both, labels.select(F.col("id").alias("b"), "label"), ["b"], hot=hubs).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        hooked = labels.join(around, "id").select("id", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        common = hot_keys(labels.select(F.col("label").alias("next")), ["next"])
        moved = skew_join(hooked, jump, ["next"], "left", common)
        new = materialise(moved.select("id", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")))
        discard(labels)
        labels = new.select("id", "label")
        labels.scratch = new.scratch
        if not new.where("moved").limit(1).count():
            discard(both)
            out = labels.select("id", F.col("label").alias("component"))
            out.scratch = new.scratch
            return out
    raise RuntimeError("components did not settle")
