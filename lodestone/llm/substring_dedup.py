"""Removing passages that a document with a smaller id holds too, by suffix automata of reference shards.

A window is WINDOW words. Its anchor is the least hash of the ANCHOR-word grams in it, so equal windows have equal
anchors, and neighbouring windows mostly share theirs. Anchors that occur in one text alone are found first, in packed
form, and dropped with their windows; what is left are segments: stretches of a text whose windows share an anchor.
Equal segments are aggregated to their smallest document before anything is gathered. Shards are sets of anchors with a
bounded number of different segments. The task of a shard builds the suffix automaton of its segments in the order of
their documents, so that every state knows the first document that its words occur in, and streams the segments through
it: the matching statistics, cut to WINDOW words, give each window's first document. The results return to the
documents by the segments' hashes.

A driver-wide broadcast of all automata would grow with the corpus; here a shard's automaton is where its segments are.
An anchor with more than SEGMENTS different segments (the edge of a passage that very many documents share) would make
its shard too large: its segments are split again by the second least hash of their windows, then by the third, and so
on. With every step fewer words are left that can differ, so that equal segments become one and the shards stay small.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, discard, gram_mask, grams, map_groups, materialise, mix, powers, skew_join, table, text_chunks
from .ngram_join import word_keys

WINDOW, ANCHOR = 13, 7
#: Different segments for each shard, about, and most of one anchor that is not split.
SEGMENTS = 4000
#: Characters of text for each bucket in which anchors are counted.
BUCKET_CHARS = 5_000_000


class SuffixAutomaton:
    """Of several strings, added in the order of their documents; first: the first document of each state's words."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.first = [-1], [0], [-1]

    def state(self, size: int, link: int, first: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.size.append(size)
        self.link.append(link)
        self.first.append(first)
        return len(self.size) - 1

    def split(self, p: int, c: int, q: int) -> int:
        """The state of p's words with c, made out of q."""
        new = self.state(self.size[p] + 1, self.link[q], self.first[q], dict(self.next[q]))
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def add(self, word: list[int], doc: int) -> None:
        last = 0
        for c in word:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.size[q] == self.size[last] + 1 else self.split(last, c, q)
                continue
            new, p = self.state(self.size[last] + 1, 0, doc, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self.split(p, c, q)
            last = new

    def first_documents(self, word: list[int], window: int) -> list[int]:
        """For each window of word, the first document that holds it, or -1."""
        out, at, n = [], 0, 0
        for i, c in enumerate(word):
            while at and c not in self.next[at]:
                at = self.link[at]
                n = self.size[at]
            if c in self.next[at]:
                at, n = self.next[at][c], n + 1
            while at and self.size[self.link[at]] >= window:
                at = self.link[at]
            n = min(n, self.size[at])
            if i >= window - 1:
                out.append(self.first[at] if n >= window else -1)
        return out


def runs(w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor) of the segments of the texts of a chunk."""
    wide = WINDOW - ANCHOR + 1
    g = grams(w.hash, ANCHOR)
    m = g[: max(0, len(g) - wide + 1)].copy()
    for i in range(1, wide):
        np.minimum(m, g[i : i + len(m)], out=m)
    at = np.flatnonzero(gram_mask(w.first, len(w.hash), WINDOW))
    text, key = w.text[at], m[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    return at[start], np.diff(np.append(start, len(at))), key[start]


def pairs_of_many(key: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (key, cls), sorted by key, and whether the key has several cls."""
    order = np.lexsort((cls, key))
    key, cls = key[order], cls[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    key, cls = key[keep], cls[keep]
    same = key[1:] == key[:-1]
    many = np.zeros(len(key), bool)
    many[1:] |= same
    many[:-1] |= same
    return key, cls, many


def survey(texts: DataFrame) -> DataFrame:
    """(id, k1, k2, n_words, sha): each text's identity, and its digest if all words are kept."""

    def run(batches):
        for batch in batches:
            for low, high, w in text_chunks(batch.column("text")):
                raw = w.data.tobytes()
                off = w.offsets.tolist()
                sha = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(off[:-1], off[1:], strict=True)]
                k1, k2 = word_keys(w)
                yield pa.RecordBatch.from_arrays([batch.column("id")[low:high], pa.array(k1), pa.array(k2), pa.array(np.diff(w.first)), pa.array(sha)], names=["id", "k1", "k2", "n_words", "sha"])

    return texts.mapInArrow(run, "id long, k1 long, k2 long, n_words long, sha string")


def shared_anchors(texts: DataFrame) -> DataFrame:
    """(k1, keys): for each text, by its identity, its anchors that another text has too. A batch of texts sends each
    anchor once to the bucket that counts it, however many of its texts hold it."""
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-chars // BUCKET_CHARS))

    def collect(batches):
        names = ["bucket", "keys", "cls"]
        for batch in batches:
            keys, classes, seen = [], [], np.zeros(0, np.int64)
            for _, _, w in text_chunks(batch.column("text")):
                cls = word_keys(w)[0]
                fresh = ~np.isin(cls, seen)
                _, firsts = np.unique(cls, return_index=True)
                once = np.zeros(len(cls), bool)
                once[firsts] = True
                seen = np.concatenate([seen, cls])
                start, _, key = runs(w)
                text = w.text[start]
                use = (fresh & once)[text]
                keys.append(key[use])
                classes.append(cls[text[use]])
            if not keys:
                continue
            key, cls, many = pairs_of_many(np.concatenate(keys), np.concatenate(classes))
            one = np.ones(len(key), bool)
            one[1:] = key[1:] != key[:-1]
            rows = []
            for base, use in ((0, one), (buckets, many)):  # to be counted, or known to be shared already
                k, c = key[use], cls[use]
                bucket = ((k >> U(32)) * U(buckets) >> U(32)).astype(np.int64)  # rises with the key
                cut = np.searchsorted(bucket, np.arange(buckets + 1))
                rows += [(base + b, k[x:y].tobytes(), c[x:y].tobytes()) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

    def unpacked(table_: pa.Table, name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(table_.column(name).to_pylist()), kind)

    def count(bucket, rows):
        key, cls = unpacked(rows, "keys", U), unpacked(rows, "cls", np.int64)
        if bucket[0] < buckets:
            key, cls, many = pairs_of_many(key, cls)
            key, cls = key[many], cls[many]
        return {"k1": cls, "key": key.astype(np.int64)}

    packed = texts.select("text").mapInArrow(collect, "bucket long, keys binary, cls binary")
    counted = map_groups(packed, ["bucket"], count, "k1 long, key long")
    return materialise(counted.groupBy("k1").agg(F.collect_set("key").alias("keys")))


FLIP = 0x2545F4914F6CDD1D


def segments(marked: DataFrame) -> DataFrame:
    """(id, k1, start, key, s1, s2, least, words): segments with shared anchors of the texts (id, text, keys), with two
    hashes of their words. Of equal segments of a batch one has the words, and the least id among them."""

    def run(batches):
        for batch in batches:
            first: dict[int, int] = {}
            ids = np.array(batch.column("id").to_pylist(), np.int64)
            lists = batch.column("keys")
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            parts, words = [], []
            for low, high, w in text_chunks(batch.column("text")):
                k1 = word_keys(w)[0]
                start, n, key = runs(w)
                text = w.text[start]
                keep = np.zeros(len(start), bool)
                cut = np.searchsorted(text, np.arange(high - low + 1))
                for i in range(high - low):
                    s = slice(cut[i], cut[i + 1])
                    keep[s] = np.isin(key[s].astype(np.int64), flat[ends[low + i] : ends[low + i + 1]])
                start, n, key, text = start[keep], n[keep], key[keep], text[keep]
                if not len(start):
                    continue
                last = start + n + WINDOW - 2
                s1, s2 = (stretch_hash(w.hash ^ U(flip), start, last + 1).astype(np.int64) for flip in (0, FLIP))
                raw = w.data.tobytes()
                for s, a, b in zip(s1.tolist(), w.start[start].tolist(), w.end[last].tolist(), strict=True):
                    new = s not in first
                    words.append(raw[a:b] if new else None)
                    if new:
                        first[s] = len(words) - 1
                parts.append((ids[low + text], k1[text], start - w.first[text], key.astype(np.int64), s1, s2))
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                least = np.full(len(words), np.iinfo(np.int64).max)
                np.minimum.at(least, [first[s] for s in columns[4].tolist()], columns[0])
                none = np.array([x is None for x in words])
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(least, mask=none), pa.array(words, pa.binary())], names=["id", "k1", "start", "key", "s1", "s2", "least", "words"])

    return marked.select("id", "text", "keys").mapInArrow(run, "id long, k1 long, start long, key long, s1 long, s2 long, least long, words binary")


def stretch_hash(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(mix(hashes) * up[: len(hashes)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


def split_again(rows: DataFrame, level: int) -> DataFrame:
    """The segments of rows (r1, r2, at, key, s1, s2, doc, words) split where the hash of their windows that is the least
    but level changes; at counts words from the start of the first segment (r1, r2)."""
    names = ["r1", "r2", "at", "key", "s1", "s2", "doc", "words"]

    def run(batches):
        for batch in batches:
            out = []
            for r1, r2, at, key, doc, words in zip(*(batch.column(c).to_pylist() for c in ("r1", "r2", "at", "key", "doc", "words")), strict=True):
                for _, _, w in text_chunks(pa.array([words.decode()])):
                    g = grams(w.hash, ANCHOR)
                    nth = np.sort(np.lib.stride_tricks.sliding_window_view(g, WINDOW - ANCHOR + 1), axis=1)[:, level]
                    start = np.flatnonzero(np.concatenate([[True], nth[1:] != nth[:-1]]))
                    end = np.append(start[1:], len(nth)) + WINDOW - 1
                    s1, s2 = (stretch_hash(w.hash ^ U(flip), start, end).astype(np.int64).tolist() for flip in (0, FLIP))
                    keys = mix(nth[start] + mix(np.full(len(start), key, np.int64).astype(U))).astype(np.int64).tolist()
                    out += [(r1, r2, at + a, k, x, y, doc, words[w.start[a] : w.end[b - 1]]) for a, b, k, x, y in zip(start.tolist(), end.tolist(), keys, s1, s2, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 7, pa.binary()), strict=True)], names=names)

    return rows.select(names).mapInArrow(run, "r1 long, r2 long, at long, key long, s1 long, s2 long, doc long, words binary")


def searched(rows: DataFrame) -> DataFrame:
    """(s1, s2, firsts) of the different segments in rows (key, s1, s2, doc, words): each window's first document."""
    shards = -(-rows.count() // SEGMENTS) or 1
    sent = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).repartition("shard")
    # one shuffle, by shard: what a batch sends of equal segments is one row already
    quiet = sent.groupBy("shard", "s1", "s2").agg(F.min("doc").alias("doc"), F.first("words").alias("words"))

    def search(_, rows):
        symbols: dict[bytes, int] = {}
        words = [[symbols.setdefault(x, len(symbols)) for x in raw.split()] for raw in rows.column("words").to_pylist()]
        automaton = SuffixAutomaton()
        for word, doc in zip(words, rows.column("doc").to_pylist(), strict=True):
            automaton.add(word, doc)
        return {"s1": rows.column("s1").to_numpy(), "s2": rows.column("s2").to_numpy(), "firsts": [automaton.first_documents(x, WINDOW) for x in words]}

    return map_groups(quiet, ["shard"], search, "s1 long, s2 long, firsts array<long>", ["doc", "s1"], placed=True)


def first_documents(found: DataFrame) -> DataFrame:
    """(s1, s2, firsts) for the different segments among found: each window's first document."""
    rows = found.where("words is not null").select("key", "s1", "s2", F.col("least").alias("doc"), "words")
    least = lambda x: x.groupBy("s1", "s2").agg(F.min("key").alias("key"), F.min("doc").alias("doc"), F.first("words").alias("words"))
    out, deeper = None, None
    for level in range(1, WINDOW - ANCHOR + 2):
        # a table of its own, so that Spark knows its size: few keys are busy, and then the segments need not move for them
        busy = materialise(rows.select("key", "s1", "s2").distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SEGMENTS).select("key"))
        none = level > WINDOW - ANCHOR or not busy.limit(1).count()
        quiet = rows if none else rows.join(busy, "key", "left_anti")
        done = searched(quiet if level == 1 else least(quiet))
        if level == 1:
            out = done
        else:
            part = skew_join(quiet.select("r1", "r2", "at", "s1", "s2"), materialise(done), ["s1", "s2"]).select("r1", "r2", "at", "firsts")
            deeper = part if deeper is None else deeper.unionByName(part)
        if none:
            break
        again = rows.join(busy, "key", "left_semi")
        if level == 1:
            again = least(again).select(F.col("s1").alias("r1"), F.col("s2").alias("r2"), F.lit(0).cast("long").alias("at"), "key", "s1", "s2", "doc", "words")
        rows = materialise(split_again(again, level))
    if deeper is None:
        return out
    whole = deeper.groupBy("r1", "r2").agg(F.sort_array(F.collect_list(F.struct("at", "firsts"))).alias("x"))
    return out.unionByName(whole.select(F.col("r1").alias("s1"), F.col("r2").alias("s2"), F.flatten("x.firsts").alias("firsts")))


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256, and with_text what is left of it (kept_text).

    A word goes if a window of WINDOW words around it also starts in a document with a smaller id (a long). Texts of
    fewer words, empty and null ones lose nothing. Rows with the same id don't count as each other's copies; a row with
    a null id loses nothing and takes nothing from others. Texts with the same words are searched once, for their
    smallest id; the others lose all their words. Other columns are left out; an empty table gives no rows. kept_text
    is null for texts that lose nothing.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = materialise(survey(rows))
    named = rows.where("id is not null")
    classes = known.where("id is not null").groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    anchors = shared_anchors(named)
    keys = anchors.join(classes.select("k1", "rep"), "k1").groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
    found = materialise(segments(named.join(keys.withColumnRenamed("rep", "id"), "id")))
    discard(anchors)
    firsts = materialise(first_documents(found))
    judged = skew_join(found.select("id", "k1", "start", "s1", "s2"), firsts, ["s1", "s2"])
    covered = F.transform("firsts", lambda d: (d >= 0) & (d < F.col("id")))
    hits = judged.select("id", "k1", F.struct("start", covered.alias("mask")).alias("hit")).where(F.exists("hit.mask", lambda x: x))
    hits = materialise(hits.groupBy("id", "k1").agg(F.collect_list("hit").alias("hits")))
    discard(found)
    discard(firsts)

    def cut(batches):
        for batch in batches:
            out = []
            for doc, text, want, hit in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "want", "hits")), strict=True):
                raw = text.encode()
                for _, _, w in text_chunks(pa.array([text])):
                    k1, k2 = (int(x[0]) for x in word_keys(w))
                if k1 != want:
                    continue
                words = raw.split()
                cover = np.zeros(len(words) + 1, np.int64)
                for h in hit:
                    at = h["start"] + np.flatnonzero(h["mask"])
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + WINDOW, -1)
                gone = np.cumsum(cover)[:-1] > 0
                left = b" ".join(x for x, g in zip(words, gone.tolist(), strict=True) if not g)
                out.append((doc, k1, k2, int(gone.sum()), hashlib.sha256(left).hexdigest(), left.decode() if with_text else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 4, pa.string(), pa.string()), strict=True)], names=["rep", "k1", "k2", "removed", "left", "left_text"])

    texts = named.join(hits.withColumnRenamed("k1", "want"), "id")
    trimmed = texts.mapInArrow(cut, "rep long, k1 long, k2 long, removed long, left string, left_text string").dropDuplicates(["rep", "k1", "k2"])
    per_class = materialise(classes.join(trimmed, ["rep", "k1", "k2"], "left"))
    out = skew_join(known, per_class, ["k1", "k2"], "left")
    copy = (F.col("id") > F.col("rep")) & (F.col("n_words") >= WINDOW)
    of_rep = (F.col("id") == F.col("rep")) & F.col("removed").isNotNull()
    nothing = hashlib.sha256(b"").hexdigest()
    columns = [
        F.col("id").alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).when(of_rep, F.col("removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(nothing)).when(of_rep, F.col("left")).otherwise(F.col("sha")).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(copy, F.lit("")).when(of_rep, F.col("left_text")).alias("kept_text"))
    return out.select(*columns)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
