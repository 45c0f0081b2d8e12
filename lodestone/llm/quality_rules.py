"""Quality rules: counts of a text's own, and its divergence from the language references.

One pass over the texts makes the base counts and two histograms for each document: classes of characters, and common
words of several languages. The references are the sums of these histograms over all documents of a language that pass
the base rules. A document is compared with the references by Jensen-Shannon distance; texts under the minimum lengths
are not judged by it, and a prior of PRIOR observations from the reference keeps short texts from looking divergent
only because they are short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import IS_SEPARATOR, Words, discard, gram_mask, grams, materialise, mix, prefix_hash, span_hash, table, text_chunks
from .language_model import TEXT_ROWS, rows_at_a_time

SYMBOLS = b"#*$%&|<>"
#: Frequent words of the languages.
COMMON = {
    "en": "the of and to in a is that it was for on are as with be at this have from or by not but",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il avec",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero",
}
#: Character classes by first byte of a character; bytes inside a character have none.
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "other mark", "symbol", "bracket or quote", "accented", "other script", "control")
MIN_WORDS, MIN_CHARS = 40, 200
PRIOR = 40
#: Largest Jensen-Shannon distances (base 2, 0 to 1) from the nearest reference. A text without common words is never
#: further away in words than its reference's share of common words allows: 0.39 at 28%, 0.25 at 12%. At 28% it needs about
#: 130 words to get over 0.25, as the prior counts for PRIOR words.
MOST_CHARS, MOST_WORDS = 0.30, 0.25
#: References that are compared with the documents at a time, about 1 KB each; more languages take further passes.
AT_ONCE = 1000


def class_table() -> np.ndarray:
    t = np.full(256, len(CLASSES), np.uint8)
    put = lambda chars, k: t.__setitem__(list(chars), k)
    put(range(0x20), 11)
    put(range(0x21, 0x7F), 6)
    put(range(ord("a"), ord("z") + 1), 0)
    put(range(ord("A"), ord("Z") + 1), 1)
    put(range(ord("0"), ord("9") + 1), 2)
    put(b" \t", 3)
    put(b"\n\r\x0b\x0c", 4)
    put(b".,;:!?", 5)
    put(SYMBOLS, 7)
    put(b"()[]{}'\"", 8)
    put([0x7F], 11)
    put(range(0xC2, 0xCA), 9)
    put(range(0xCA, 0xF8), 10)
    return t


CLASS_OF = class_table()
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def letter_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each run of letters, A-Z lower-cased."""
    data = np.where((data >= 65) & (data <= 90), data | 32, data)
    inside = ~NO_LETTER[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, span_hash(prefix_hash(data), start, end)


def common_hashes() -> np.ndarray:
    words = sorted({w for text in COMMON.values() for w in text.split()})
    return np.unique(letter_words(np.frombuffer(" ".join(words).encode(), np.uint8))[1])


def repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an equal elsewhere, has an equal earlier) for each key."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    any_, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    any_[order[1:][same]] = any_[order[:-1][same]] = True
    later[order[1:][same]] = True
    return any_, later


def base_counts(w: Words, window: int = 8) -> dict[str, np.ndarray]:
    """The base counts of each text of the chunk."""
    n, data, text = len(w.first) - 1, w.data, w.text
    of = lambda at: np.searchsorted(w.offsets, at, "right") - 1  # noqa: E731  the text that holds a byte
    point = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~IS_SEPARATOR[data])])
    line_end = np.flatnonzero(data == 10)
    lo = np.sort(np.concatenate([w.offsets[:-1], line_end + 1]), kind="stable")
    owner = of(lo)
    after = np.searchsorted(line_end, lo)
    hi = np.minimum(np.append(line_end, len(data))[after], w.offsets[np.minimum(owner + 1, n)])
    words_in = np.searchsorted(w.start, hi) - np.searchsorted(w.start, lo)
    line = np.flatnonzero((hi > lo) & (words_in > 0))
    # a line start may be listed twice where a text ends with a line feed; an interval has one owner, so keep one
    line = line[np.concatenate([[True], lo[line][1:] != lo[line][:-1]])] if len(line) else line
    key = mix(span_hash(w.prefix, lo[line], hi[line]) + mix(owner[line].astype(np.uint64) + np.uint64(1)))
    dup = np.bincount(owner[line][repeated(key)[1]], minlength=n)
    g, ok = grams(w.hash, window), gram_mask(w.first, n, window)
    at = np.flatnonzero(ok)
    twice = at[repeated(mix(g[at] + mix(text[at].astype(np.uint64) + np.uint64(1))))[0]]
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    covered = np.cumsum(cover)[:-1] > 0
    return {
        "n_words": np.diff(w.first),
        "word_chars": np.diff(point[w.offsets]),
        "n_symbols": np.diff(np.concatenate([[0], np.cumsum(IS_SYMBOL[data])])[w.offsets]),
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(text[covered], minlength=n),
    }


def histograms(w: Words, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character classes and common words (the last column: any other word) of each text of the chunk."""
    n, k = len(w.first) - 1, len(CLASSES) + 1
    lengths = np.diff(w.offsets)
    chars = np.bincount(np.repeat(np.arange(n) * k, lengths) + CLASS_OF[w.data], minlength=n * k).reshape(n, k)[:, :-1]
    start, hashes = letter_words(w.data)
    slot = np.searchsorted(listed, hashes)
    slot[slot == len(listed)] = 0
    slot = np.where(listed[slot] == hashes, slot, len(listed))
    k = len(listed) + 1
    of = np.searchsorted(w.offsets, start, "right") - 1
    return chars, np.bincount(of * k + slot, minlength=n * k).reshape(n, k)


def js_distance(counts: np.ndarray, reference: np.ndarray, prior: float) -> np.ndarray:
    """Jensen-Shannon distance (the root of the divergence, base 2) of each row of counts, with the prior, from reference."""
    q = reference / reference.sum()
    p = (counts + prior * q) / (counts.sum(axis=1, keepdims=True) + prior)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.maximum(0, (a + b) / 2))


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])


def features(documents: DataFrame, id_col: str) -> DataFrame:
    kind = documents.select(id_col).dtypes[0][1]

    def run(batches):
        listed = common_hashes()
        for batch in batches:
            for low, high, w in text_chunks(batch.column("text")):
                counts = base_counts(w)
                chars, words = histograms(w, listed)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel().astype(np.int32))) for x in (chars, words)]
                yield pa.RecordBatch.from_arrays([batch.column("id")[low:high], batch.column("lang")[low:high], *(pa.array(counts[c].astype(np.int64)) for c in BASE), pa.array(base_failed(counts)), *lists], names=["id", "lang", *BASE, "base_failed", "chars", "words"])

    schema = f"id {kind}, lang string, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, chars array<int>, words array<int>"
    return documents.select(F.col(id_col).alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").alias("text")).mapInArrow(run, schema)


def references(found: DataFrame):
    """Lists of (characters, words) histograms of the languages, summed over all documents that pass the base rules; only
    one list, of AT_ONCE languages about, is on the driver at a time."""
    n_chars, n_words = len(CLASSES), len(common_hashes()) + 1
    sums = [F.sum(F.get("chars", F.lit(i))) for i in range(n_chars)] + [F.sum(F.get("words", F.lit(i))) for i in range(n_words)]
    by_language = materialise(found.where("not base_failed and lang is not null").groupBy("lang").agg(F.array(*sums).alias("h")))
    shards = -(-by_language.count() // AT_ONCE)
    for k in range(shards):
        rows = by_language.where(F.pmod(F.xxhash64("lang"), F.lit(shards)) == k).orderBy("lang").collect()
        yield [(np.array(r["h"][:n_chars], float), np.array(r["h"][n_chars:], float)) for r in rows if sum(r["h"][:n_chars])]
    discard(by_language)


def nearer(chars: np.ndarray, words: np.ndarray, known: list, near: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distances in characters and words from the nearest reference, the larger of them over its limit), given those of
    the references seen before."""
    for ref_chars, ref_words in known:
        d = np.stack([js_distance(chars, ref_chars, PRIOR), js_distance(words, ref_words, PRIOR)])
        over = np.maximum(d[0] / MOST_CHARS, d[1] / MOST_WORDS)
        near = np.where(over < best, d, near)
        best = np.minimum(best, over)
    return near, best


def verdict(n_words: np.ndarray, word_chars: np.ndarray, failed: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Whether each text is kept; best is infinite where there are no references."""
    judged = (n_words >= MIN_WORDS) & (word_chars >= MIN_CHARS) & np.isfinite(best)
    return ~failed & ~(judged & (best > 1))


def judge(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, the base counts, base_failed, char_distance, word_distance, kept.

    kept is false where the base rules fail, else true unless the text is long enough to be judged and no language
    reference is near in characters (MOST_CHARS) and words (MOST_WORDS) at once. A text under MIN_CHARS characters or
    MIN_WORDS words is judged by the base rules alone; so is every text where there are no references. A null text has
    no words and fails. lang only tells which documents make a reference; null langs make none, and a wrong one does no
    harm to its document, which may be near any reference. Repeated rows and null ids are kept as rows. Other columns
    are left out; an empty table gives no rows.
    """
    with rows_at_a_time(documents.sparkSession, TEXT_ROWS):
        found = materialise(features(documents, id_col))
    kind = dict(found.dtypes)["id"]
    numbers = ["char_distance", "word_distance", "best"]
    schema = f"id {kind}, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, chars array<int>, words array<int>, char_distance double, word_distance double, best double"
    out = found.drop("lang").withColumns({"char_distance": F.lit(0.0), "word_distance": F.lit(0.0), "best": F.lit(float("inf"))})
    for known in references(found):

        def compare(batches, known=known):
            for batch in batches:
                if batch.num_rows:
                    chars, words = (np.stack(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("chars", "words"))
                    seen = [batch.column(c).to_numpy() for c in numbers]
                    near, best = nearer(chars, words, known, np.stack(seen[:2]), seen[2])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", *BASE, "base_failed", "chars", "words")), *map(pa.array, (*near, best))], names=["id", *BASE, "base_failed", "chars", "words", *numbers])

        out = out.mapInArrow(compare, schema)
    judged = (F.col("n_words") >= MIN_WORDS) & (F.col("word_chars") >= MIN_CHARS) & (F.col("best") < float("inf"))
    kept = ~F.col("base_failed") & ~(judged & (F.col("best") > 1))
    return out.select(F.col("id").alias(id_col), *BASE, "base_failed", "char_distance", "word_distance", kept.alias("kept"))


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that judge keeps, with all their columns; nulls, empty texts, ties, repeated rows and empty tables
    as there. The texts are read twice and nothing is shuffled but the sums for the references."""
    shards = references(features(documents, "doc_id"))
    first = next(shards, [])
    described = ["_lodestone_n", "_lodestone_c", "_lodestone_best", "_lodestone_chars", "_lodestone_words"]
    more = next(shards, None)
    if more is None:

        def run(batches):
            listed = common_hashes()
            for batch in batches:
                for low, high, w in text_chunks(batch.column("text")):
                    counts = base_counts(w)
                    n = high - low
                    best = nearer(*histograms(w, listed), first, np.zeros((2, n)), np.full(n, np.inf))[1]
                    kept = verdict(counts["n_words"], counts["word_chars"], base_failed(counts), best)
                    yield batch.slice(low, n).filter(pa.array(kept))

        return documents.mapInArrow(run, documents.schema)

    def describe(batches):
        listed = common_hashes()
        for batch in batches:
            for low, high, w in text_chunks(batch.column("text")):
                counts = base_counts(w)
                n = high - low
                chars, words = histograms(w, listed)
                best = nearer(chars, words, first, np.zeros((2, n)), np.full(n, np.inf))[1]
                good = pa.array(~base_failed(counts))
                lists = [pa.array(list(x.astype(np.int32)), pa.list_(pa.int32())) for x in (chars, words)]
                added = [pa.array(counts["n_words"].astype(np.int64)), pa.array(counts["word_chars"].astype(np.int64)), pa.array(best), *lists]
                yield pa.RecordBatch.from_arrays([*batch.slice(low, n).columns, *added], names=[*batch.schema.names, *described]).filter(good)

    kinds = "_lodestone_n long, _lodestone_c long, _lodestone_best double, _lodestone_chars array<int>, _lodestone_words array<int>"
    schema = StructType(documents.schema.fields + StructType.fromDDL(kinds).fields)
    out = documents.mapInArrow(describe, schema)
    while more is not None:

        def compare(batches, known=more):
            for batch in batches:
                if batch.num_rows:
                    chars, words = (np.stack(batch.column(c).to_numpy(zero_copy_only=False)) for c in described[3:])
                    best = nearer(chars, words, known, np.zeros((2, batch.num_rows)), batch.column("_lodestone_best").to_numpy())[1]
                    yield batch.set_column(batch.schema.get_field_index("_lodestone_best"), "_lodestone_best", pa.array(best))

        out = out.mapInArrow(compare, schema)
        more = next(shards, None)
    judged = (F.col("_lodestone_n") >= MIN_WORDS) & (F.col("_lodestone_c") >= MIN_CHARS) & (F.col("_lodestone_best") < float("inf"))
    return out.where(~(judged & (F.col("_lodestone_best") > 1))).drop(*described)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
