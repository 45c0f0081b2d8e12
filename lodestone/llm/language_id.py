"""Language identification by segmentation-marginalised unigrams.

Every language has probabilities for the pieces of a fixed public vocabulary. The score of a word is the sum over all
its segmentations into pieces, made by the forward algorithm over its bytes for all words of one length and all
languages at once; a text's score is the product over its words. A run of letters over WORD_BYTES long goes through
the algorithm in blocks: what a block does to the forward state (the sums at the last positions before a cut) is a
matrix, made for all blocks at once and then applied one after the other, so that pieces across the cuts count too. The
probabilities are fitted by expectation maximisation (forward-backward) on the words of a bounded sample of labelled
documents; there alone a long run is cut into words, where a character starts.

Every language of the training documents is learned, AT_ONCE of them in one pass over the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, mix, powers, prefix_hash, span_hash, string_buffers, table
from .quality_rules import NO_LETTER

#: Different texts for each language that the probabilities are fitted on, shorter than LONG characters where there are
#: enough of them.
SAMPLE, LONG = 400, 20_000
AT_ONCE = 24
ROUNDS = 3
#: A longer run of letters is scored in blocks, of BLOCK_BYTES each but the first.
WORD_BYTES, BLOCK_BYTES = 64, 32
SMOOTH = 0.05
BYTE_FLOOR = 1e-7
CACHE = 300_000


def vocabulary(path: str | None = None) -> list[bytes]:
    """Pieces of the sentencepiece model at path, a leading word mark written as a space."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    pieces = set()
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            raw = model.id_to_piece(i).lower().replace("▁", " ").encode()
            if raw and b" " not in raw[1:]:
                pieces.add(raw)
    return sorted(pieces)


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of the Latin-1 block in lower case."""
    data = np.where((data >= 65) & (data <= 90), data | 32, data)
    if len(data) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][second] |= 0x20
    return data


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of letters in consecutive texts."""
    inside = ~NO_LETTER[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[offsets < len(data)]
    starts[edge] = inside[edge]
    edge = offsets[offsets > 0] - 1
    ends[edge] = inside[edge]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def cut_run(raw: bytes) -> list[bytes]:
    """Parts of raw of about WORD_BYTES, each from the start of a character."""
    out, low = [], 0
    while low < len(raw):
        high = min(len(raw), low + WORD_BYTES)
        while low + WORD_BYTES // 2 < high < len(raw) and raw[high] & 0xC0 == 0x80:
            high -= 1
        out.append(raw[low:high])
        low = high
    return out


class Pieces:
    """The vocabulary's hashes, and where its pieces occur in words of one length."""

    def __init__(self, pieces: list[bytes]):
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        h = span_hash(prefix_hash(flat), off[:-1], off[1:])
        order = np.argsort(h)
        self.hash, self.id, self.n = h[order], order, len(pieces)
        self.sizes = sorted({len(p) for p in pieces} | {1})
        self.longest = self.sizes[-1]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[h >> U(44)] = True

    def find(self, words: np.ndarray):
        """(start, length, rows, ids) of the pieces in words, a matrix of bytes; ids n + byte stand for a single byte."""
        k, size = words.shape
        prefix = np.zeros((k, size + 1), U)
        up, down = (p[:size] for p in powers(size + 1))
        np.cumsum((words.astype(U) + U(1)) * up, axis=1, out=prefix[:, 1:])
        for i in range(size):
            for n in self.sizes:
                if n > size - i:
                    break
                h = mix((prefix[:, i + n] - prefix[:, i]) * down[i])
                rows = np.flatnonzero(self.maybe[h >> U(44)])
                at = np.minimum(np.searchsorted(self.hash, h[rows]), self.n - 1)
                real = self.hash[at] == h[rows]
                rows, ids = rows[real], self.id[at[real]]
                if n == 1:
                    all_ids = self.n + words[:, i].astype(np.int64)
                    all_ids[rows] = ids
                    rows, ids = np.arange(k), all_ids
                if len(rows):
                    yield i, n, rows, ids

    def forward(self, found: list, shape: tuple[int, int], prob: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """alpha (rescaled), the logarithms taken out of it, and the scales by position."""
        k, size = shape
        alpha = np.zeros((size + 1, k, prob.shape[1]))
        alpha[0] = 1
        log = np.zeros((k, prob.shape[1]))
        scales: list = []
        last = 0
        for i, n, rows, ids in found:
            if i != last:
                last = i
                if i % 6 == 0:
                    s = alpha[i].copy()
                    alpha[i : i + self.longest] /= s
                    log += np.log(s)
                    scales.append((i, s))
            alpha[i + n][rows] += alpha[i][rows] * prob[ids]
        return alpha, log + np.log(alpha[size]), scales

    def expected(self, found: list, shape: tuple[int, int], prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, by language, in words that occur weight times."""
        k, size = shape
        alpha, _, scales = self.forward(found, shape, prob)
        # alpha[j] holds the scales up to j - longest + 1 at least; beta is scaled so that alpha * beta / z holds at each use
        beta = np.zeros_like(alpha)
        beta[size] = 1
        out = np.zeros_like(prob)
        z = alpha[size]
        pending = list(scales)
        for i, n, rows, ids in reversed(found):
            while pending and pending[-1][0] > i:
                at, s = pending.pop()
                beta[at:] /= s  # what lies from at on was seen by alpha after the division
            gain = prob[ids] * beta[i + n][rows]
            beta[i][rows] += gain
            np.add.at(out, ids, weight[rows] * alpha[i][rows] * gain / z[rows])
        return out


    def log_total(self, word: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Logarithm of the sum over all segmentations of one long word, by blocks."""
        state, size, languages = self.longest, len(word), prob.shape[1]
        head = size % BLOCK_BYTES + BLOCK_BYTES * (1 + state // BLOCK_BYTES)
        if head >= size:
            return self.forward(self.find(word[None, :]), (1, size), prob)[1][0]
        alpha, log, scales = self.forward(self.find(word[None, :head]), (1, head), prob)
        log = (log - np.log(alpha[head]))[0]
        for at, s in scales:
            alpha[:at] /= s
        vector = alpha[head - state + 1 : head + 1, 0]
        cuts = np.arange(head, size, BLOCK_BYTES)
        for lo in range(0, len(cuts), 256):
            # each block sees the bytes that a piece across its cut may begin with
            first = cuts[lo : lo + 256] - state + 1
            blocks = word[first[:, None] + np.arange(state - 1 + BLOCK_BYTES)]
            sums = np.zeros((state + BLOCK_BYTES, len(first), state, languages))
            sums[np.arange(state), :, np.arange(state)] = 1
            for i, n, rows, ids in self.find(blocks):
                if i + n >= state:
                    sums[i + n][rows] += sums[i][rows] * prob[ids][:, None, :]
            for k in range(len(first)):
                vector = np.einsum("jsl,sl->jl", sums[BLOCK_BYTES:, k], vector)
                top = vector.max(axis=0)
                log += np.log(top)
                vector = vector / top
        return log + np.log(vector[-1])


def by_length(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(indices, matrix of bytes, a space first) of the words of each length."""
    size = end - start
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        few = max(1, 1_000_000 // int(n + 1))
        for lo in range(0, len(at), few):
            part = at[lo : lo + few]
            yield part, np.concatenate([np.full((len(part), 1), 32, np.uint8), data[start[part][:, None] + np.arange(n)]], axis=1)


class Model:
    def __init__(self, pieces: list[bytes], languages: list[str], prob: np.ndarray):
        self.pieces, self.languages, self.prob = pieces, languages, prob
        self.index: Pieces | None = None
        self.known, self.values = np.zeros(0, U), np.zeros((0, len(languages)))

    def __getstate__(self):
        return self.pieces, self.languages, self.prob

    def __setstate__(self, state):
        self.__init__(*state)

    def scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log-probability of each word under each language."""
        self.index = self.index or Pieces(self.pieces)
        out = np.zeros((len(start), len(self.languages)))
        long = end - start > WORD_BYTES
        for i in np.flatnonzero(long).tolist():
            out[i] = self.index.log_total(np.concatenate([[np.uint8(32)], data[start[i] : end[i]]]), self.prob)
        short = np.flatnonzero(~long)
        for at, words in by_length(data, start[short], end[short]):
            out[short[at]] = self.index.forward(self.index.find(words), words.shape, self.prob)[1]
        return out

    def of_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the texts that have letters, their log-probabilities under each language)."""
        data = fold(data)
        start, end = letter_runs(data, offsets)
        first = np.searchsorted(start, offsets)
        word = self.of_words(span_hash(prefix_hash(data), start, end), data, start, end)
        good = np.flatnonzero(np.diff(first) > 0)
        ascii_letter = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
        for i in good[ascii_letter[offsets[good + 1]] == ascii_letter[offsets[good]]].tolist():
            if not any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")):
                good = good[good != i]
        # each text is summed by itself, so that its score does not depend on its neighbours
        return good, np.array([word[first[i] : first[i + 1]].sum(axis=0) for i in good.tolist()]).reshape(len(good), len(self.languages))

    def of_words(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """scores, of which those of up to CACHE words are remembered."""
        values, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, values), max(0, len(self.known) - 1))
        have = self.known[at] == values if len(self.known) else np.zeros(len(values), bool)
        out = np.zeros((len(values), len(self.languages)))
        out[have] = self.values[at[have]]
        new = np.flatnonzero(~have)
        out[new] = self.scores(data, start[first[new]], end[first[new]])
        if len(self.known) + len(new) > CACHE:
            self.known, self.values = values, out
        elif len(new):
            known = np.concatenate([self.known, values[new]])
            order = np.argsort(known)
            self.known, self.values = known[order], np.concatenate([self.values, out[new]])[order]
        return out[inverse]


def fit(counted: list[tuple[str, bytes, int]], pieces: list[bytes], languages: list[str]) -> Model:
    """EM on (language, word, count) rows from equal probabilities."""
    index = Pieces(pieces)
    number = {g: i for i, g in enumerate(languages)}
    counts: dict[bytes, np.ndarray] = {}
    for g, word, n in counted:
        counts.setdefault(bytes(word), np.zeros(len(languages)))[number[g]] += n
    words = sorted(counts)
    weight = np.stack([counts[w] for w in words]) if words else np.zeros((0, len(languages)))
    data = np.frombuffer(b"".join(words), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    n = len(pieces)
    prob = np.full((n + 256, len(languages)), 1 / n)
    prob[n:] = BYTE_FLOOR
    for _ in range(ROUNDS):
        uses = np.zeros_like(prob)
        for at, matrix in by_length(data, off[:-1], off[1:]):
            uses += index.expected(list(index.find(matrix)), matrix.shape, prob, weight[at])
        prob[:n] = (uses[:n] + SMOOTH) / (uses[:n].sum(axis=0) + SMOOTH * n)
    return Model(pieces, languages, prob)


def words_of(lang: list[str], texts: pa.Array) -> list[tuple[str, bytes, int]]:
    counts: dict[tuple[str, bytes], int] = {}
    offsets, data = string_buffers(texts)
    for i, g in enumerate(lang):
        part = fold(data[offsets[i] : offsets[i + 1]])
        raw = part.tobytes()
        for a, b in zip(*(x.tolist() for x in letter_runs(part, np.array([0, len(part)]))), strict=True):
            for word in cut_run(raw[a:b]):
                counts[g, word] = counts.get((g, word), 0) + 1
    return [(g, w, n) for (g, w), n in counts.items()]


def training_sample(rows: DataFrame, languages: list[str]) -> list[tuple[str, bytes, int]]:
    """(language, word, count) of SAMPLE different texts of each language, those of the least hashes, short ones first."""
    of = rows.where(F.col("lang").isin(languages))
    order = [F.length("text") >= LONG, F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    # copies of a text have one rank, so the first SAMPLE ranks are different texts; tasks keep only those before the shuffle
    ranked = of.select("lang", F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]).alias("o"), "text").withColumn("rank", F.dense_rank().over(Window.partitionBy("lang").orderBy("o")))
    few = ranked.where(F.col("rank") <= SAMPLE).groupBy("lang", "o").agg(F.any_value("text").alias("text"))

    def run(batches):
        for batch in batches:
            found = words_of(batch.column("lang").to_pylist(), batch.column("text"))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["lang", "word", "n"])

    counted = few.select("lang", "text").mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    return sorted(zip(*(found.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True))


def identify(documents: DataFrame, id_col: str = "doc_id", vocabulary_path: str | None = None) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score.

    held_out documents (crc32 of the id as text, mod 4, is 2; a null id counts as an empty text) teach nothing. A
    prediction sees the text alone: A-Z and Latin-1 capitals in lower case, runs of letters as words, of any length and
    number. lang_pred is the likeliest learned language and score its posterior probability under equal priors; a null
    text or one without letters, and any text where no language was learned, is ``und`` with score 0. Ties go to the
    first language by code point. The public vocabulary comes from the package public_tokenizers, or from vocabulary_path. Repeated rows are kept; other columns are left out; an empty table gives no rows.
    """
    kind = documents.select(id_col).dtypes[0][1]
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    rows = documents.select(F.col(id_col).alias("id"), F.col("text").alias("text"), F.col("lang").cast("string").alias("lang"), held.alias("held_out"))
    train = rows.where("not held_out and lang is not null and text is not null")
    languages = sorted(r["lang"] for r in train.select("lang").distinct().collect())
    pieces = vocabulary(vocabulary_path)
    out = rows.select("id", "text", "held_out", F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("best"), F.lit(0.0).alias("more"))
    # best: the log-probability of lang_pred; more: the sum of all languages' probabilities over that
    schema = f"id {kind}, text string, held_out boolean, lang_pred string, best double, more double"
    for k in range(0, len(languages), AT_ONCE):
        some = languages[k : k + AT_ONCE]
        model = documents.sparkSession.sparkContext.broadcast(fit(training_sample(train, some), pieces, some))
        last = k + AT_ONCE >= len(languages)

        def run(batches, model=model, last=last):
            m = model.value
            for batch in batches:
                n = batch.num_rows
                names, best, more = batch.column("lang_pred").to_pylist(), batch.column("best").to_numpy(zero_copy_only=False).copy(), batch.column("more").to_numpy(zero_copy_only=False).copy()
                best[np.isnan(best)] = -np.inf
                offsets, data = string_buffers(batch.column("text"))
                low = 0
                while low < n:
                    high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + (1 << 20), "right")) - 1)
                    good, total = m.of_texts(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                    for i, row in zip((low + good).tolist(), total, strict=True):
                        j = int(row.argmax())
                        top = max(best[i], row[j])
                        more[i] = np.exp(row - top).sum() + (more[i] * np.exp(best[i] - top) if names[i] else 0.0)
                        if row[j] > best[i]:  # of equal ones the first language stays
                            names[i] = m.languages[j]
                        best[i] = top
                    low = high
                texts = pa.nulls(n, pa.string()) if last else batch.column("text")
                yield pa.RecordBatch.from_arrays([batch.column("id"), texts, batch.column("held_out"), pa.array(names, pa.string()), pa.array(best, mask=np.isinf(best)), pa.array(more)], names=["id", "text", "held_out", "lang_pred", "best", "more"])

        out = out.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "held_out", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.when(F.col("lang_pred").isNotNull(), 1 / F.col("more")).otherwise(0.0).alias("score"))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
