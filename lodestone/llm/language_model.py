"""Scoring texts with a log-bilinear neural language model trained by noise-contrastive estimation.

Words are counted over all training documents. The model predicts units: the VOCABULARY most frequent words that occur
MIN_COUNT times, the end of a text, and, for all other words, ENDINGS groups by a hash of their last letters; such a word
has in addition its smoothed share of its group, so that the scores are probabilities over all words. The two units
before a token give its context vector ``r[w1] C1 + r[w2] C2``. Units are dealt into CLASSES classes of equal size by
the units that they follow in the corpus, a class's score is its product with the context plus a bias, and so is a
unit's within its class; both are normalised, by matrix products over all classes and over all members of a class.

Training sees all training documents, but neither their order nor their files matter: texts are dealt by a hash of
their words into groups of about GROUP_TOKENS tokens, a group's different trigrams are counted and trained on in an
order that follows from them, from common initial values. Each unit's parameters are averaged over the groups by how
often it occurs there, in whole numbers, so that sums don't depend on their order.

Counts of the FREQUENT most frequent words go to all tasks; the rarer words of a text are joined with their counts.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, discard, map_groups, materialise, mix, table, text_chunks

CLASSES, MEMBERS, WIDTH = 128, 128, 16
UNITS = CLASSES * MEMBERS
ENDINGS = 1023
VOCABULARY, END = UNITS - ENDINGS - 1, UNITS - 1
MIN_COUNT = 3
FREQUENT = 200_000
GROUP_TOKENS = 1 << 21
#: Tokens that a task holds at a time while it counts words or trigrams.
HELD = 1 << 19
#: Contexts whose scores are made at a time.
HELD_SCORES = 1 << 11
#: Rows that Spark hands to Python, and reads, at a time: texts, and packed trigrams, which are long. Both hold whole batches.
RECORDS, READ = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
TEXT_ROWS, PACKED_ROWS = 1000, 32
NOISE, BATCH, EPOCHS, RATE = 16, 16384, 1, 0.1
#: Preceding units that a unit's class is chosen by; all others are one.
NEIGHBOURS = 64
SEED = 5
#: Averages are sums of whole numbers of this fraction.
FINE = 1 << 16


def classes_of(after: np.ndarray) -> np.ndarray:
    """The class of each unit: units are halved again and again, each time in the direction in which the square roots of
    the shares of the units that they follow (after, a row of counts for each) vary most."""
    share = np.sqrt((after + 0.01) / (after + 0.01).sum(axis=1, keepdims=True))
    weight = np.sqrt(after.sum(axis=1) + 1.0)
    cls, parts = np.zeros(len(after), np.int64), [np.arange(len(after))]
    while len(parts) < CLASSES:
        halves = []
        for of in parts:
            x = share[of] - np.average(share[of], axis=0, weights=weight[of])
            axis = np.linalg.eigh((x * weight[of, None]).T @ x)[1][:, -1]
            axis *= np.sign(axis[np.abs(axis).argmax()])
            order = of[np.lexsort((of, np.round(x @ axis, 9)))]
            halves += [np.sort(order[: len(of) // 2]), np.sort(order[len(of) // 2 :])]
        parts = halves
    for k, of in enumerate(parts):
        cls[of] = k
    return cls


def row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different rows, the sums of their values)."""
    order = np.argsort(rows.astype(np.int16), kind="stable")  # units fit, and so narrow numbers are sorted by digits
    sorted_ = rows[order]
    start = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return sorted_[start], np.add.reduceat(values[order], start, axis=0)


class LogBilinear:
    """r, q, b: context vector, vector and bias of each unit; a, d: vector and bias of each class."""

    NAMES = ("r", "q", "b", "a", "d", "c1", "c2")

    def __init__(self, unigram: np.ndarray, cls: np.ndarray):
        """unigram: probability of each unit, over 0; cls: its class, of MEMBERS units."""
        rng = np.random.default_rng(SEED)
        self.unigram, self.cls = unigram / unigram.sum(), cls
        self.of_class = np.argsort(cls, kind="stable").reshape(CLASSES, MEMBERS)
        self.class_unigram = self.unigram[self.of_class].sum(axis=1)
        self.r, self.q = (rng.normal(0, 0.1, (UNITS, WIDTH)).astype(np.float32) for _ in range(2))
        self.a = rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32)
        self.c1, self.c2 = (np.eye(WIDTH, dtype=np.float32) * np.float32(0.5) for _ in range(2))
        self.d = np.log(self.class_unigram).astype(np.float32)
        self.b = np.log(self.unigram / self.class_unigram[cls]).astype(np.float32)

    def contexts(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        return self.r[w1] @ self.c1 + self.r[w2] @ self.c2

    @staticmethod
    def told(h, share, real_v, real_b, log_real) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of telling the real ones from noise: (of h, of their vectors, of their biases)."""
        real = np.einsum("ij,ij->i", h, real_v) + real_b - log_real
        g_real = share / (1 + np.exp(np.clip(real, -30, 30)))
        return g_real[:, None] * real_v, g_real[:, None] * h, g_real

    @staticmethod
    def refused(false: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Gradients of the scores of noise, which are overwritten."""
        np.clip(false, -30, 30, out=false)
        np.exp(np.negative(false, out=false), out=false)
        false += 1
        return np.divide(-share[:, None], false, out=false)

    def step(self, name: str, rows, gradient) -> None:
        """Adagrad; rows: those that the gradient has."""
        square = self.squares[name]
        square[rows] += gradient * gradient
        getattr(self, name)[rows] += np.float32(RATE) * gradient / np.sqrt(square[rows])

    def train(self, w2, w1, w0, weight, rng) -> None:
        """One pass of Adagrad over trigrams (w2, w1, w0) that occur weight times. Classes are told from NOISE classes,
        units from NOISE units of their class, drawn for each batch by how often they occur."""
        self.__dict__.setdefault("squares", {n: np.full(getattr(self, n).shape, 1e-6, np.float32) for n in self.NAMES})
        order = rng.permutation(len(w0))
        log_p = np.log(NOISE * self.class_unigram).astype(np.float32)
        log_own = np.log(NOISE * self.unigram / self.class_unigram[self.cls]).astype(np.float32)
        up_to = np.cumsum(self.unigram[self.of_class] / self.class_unigram[:, None], axis=1)
        size = min(BATCH, max(512, len(order) // 100))  # few trigrams take smaller steps
        for lo in range(0, len(order), size):
            at = order[lo : lo + size]
            at = at[np.argsort(self.cls[w0[at]].astype(np.int16), kind="stable")]
            x1, x2, y, c = w1[at], w2[at], w0[at], self.cls[w0[at]]
            share = (weight[at] / weight[at].sum()).astype(np.float32)
            h = self.contexts(x1, x2)
            noise = rng.choice(CLASSES, NOISE, p=self.class_unigram)
            noise_v = self.a[noise]
            g_h, g_v, g_b = self.told(h, share, self.a[c], self.d[c], log_p[c])
            g_false = self.refused(h @ noise_v.T + self.d[noise] - log_p[noise], share)
            g_h += g_false @ noise_v
            n_v, n_b = g_false.T @ h, g_false.sum(axis=0)
            a_rows, a_sums = row_sums(np.concatenate([c, noise]), np.concatenate([np.column_stack([g_v, g_b]), np.column_stack([n_v, n_b])]))
            cut = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
            draws = rng.random((CLASSES, NOISE))
            there = np.unique(c).tolist()
            noise = np.concatenate([self.of_class[k][np.minimum(np.searchsorted(up_to[k], draws[k]), MEMBERS - 1)] for k in there])
            noise_v, noise_b, log_noise = self.q[noise], self.b[noise], log_own[noise]
            own, g_v, g_b = self.told(h, share, self.q[y], self.b[y], log_own[y])
            places = [(slice(cut[k], cut[k + 1]), slice(n * NOISE, (n + 1) * NOISE)) for n, k in enumerate(there)]
            g_false = np.empty((len(y), NOISE), np.float32)
            for s, t in places:
                g_false[s] = h[s] @ noise_v[t].T + noise_b[t] - log_noise[t]
            self.refused(g_false, share)
            n_v = np.empty((len(noise), WIDTH + 1), np.float32)
            for s, t in places:
                own[s] += g_false[s] @ noise_v[t]
                n_v[t, :-1] = g_false[s].T @ h[s]
                n_v[t, -1] = g_false[s].sum(axis=0)
            g_h += own
            q_rows, q_sums = row_sums(np.concatenate([y, noise]), np.concatenate([np.column_stack([g_v, g_b]), n_v]))
            r_rows, r_sums = row_sums(np.concatenate([x1, x2]), np.concatenate([g_h @ self.c1.T, g_h @ self.c2.T]))
            g1, g2 = self.r[x1].T @ g_h, self.r[x2].T @ g_h
            self.step("a", a_rows, a_sums[:, :-1])
            self.step("d", a_rows, a_sums[:, -1])
            self.step("q", q_rows, q_sums[:, :-1])
            self.step("b", q_rows, q_sums[:, -1])
            self.step("r", r_rows, r_sums)
            self.step("c1", slice(None), g1)
            self.step("c2", slice(None), g2)

    def factors(self) -> tuple[np.ndarray, ...]:
        """(p1, p2: what a preceding unit adds to a context, with a last number that takes the bias; e1, t1, e2, t2: the
        exponentials of what it adds to each class's score, less the greatest one, and that one; each unit's place in
        its class)."""
        one = np.ones((UNITS, 1), np.float32)
        p1, p2 = (np.concatenate([x, last], axis=1) for x, last in ((self.r @ self.c1, one), (self.r @ self.c2, 0 * one)))
        classes = np.concatenate([self.a, self.d[:, None]], axis=1).T
        found = [p1, p2]
        for p in (p1, p2):
            scores = p @ classes
            top = scores.max(axis=1)
            found += [np.exp(scores - top[:, None]), top]
        place = np.empty(UNITS, np.int64)
        place[self.of_class.ravel()] = np.tile(np.arange(MEMBERS), CLASSES)
        return *found, place

    def log_class_sums(self, w2, w1, factors) -> np.ndarray:
        """log of the sum of exponentials of all classes' scores, for each context. An exponential is the product of
        what the two units give, so a context takes no exponentials of its own, but where the sum nearly vanishes."""
        p1, p2, e1, t1, e2, t2, _ = factors
        out = np.empty(len(w1))
        for lo in range(0, len(w1), HELD_SCORES):
            x1, x2 = w1[lo : lo + HELD_SCORES], w2[lo : lo + HELD_SCORES]
            sums = np.einsum("ij,ij->i", e1.take(x1, axis=0), e2.take(x2, axis=0))
            few = np.flatnonzero(sums < 1e-20)
            sums[few] = 1
            out[lo : lo + HELD_SCORES] = np.log(sums) + t1[x1] + t2[x2]
            if len(few):
                out[lo + few] = log_sums((p1[x1[few]] + p2[x2[few]]) @ np.concatenate([self.a, self.d[:, None]], axis=1).T)
        return out

    def log_probability(self, w2, w1, w0, factors=None) -> np.ndarray:
        """Of each token, normalised over all classes and all units of its class. Classes are summed up once for equal
        contexts in a row; then tokens are taken by their classes, so that a class's units are multiplied with as many
        contexts at a time as there are."""
        factors = factors or self.factors()
        p1, p2, *_, place = factors
        first = np.ones(len(w0), bool)
        first[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
        out = -self.log_class_sums(w2[first], w1[first], factors)[np.cumsum(first) - 1]
        cls = self.cls[w0].astype(np.int16)
        order = np.argsort(cls, kind="stable")
        cut = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        classes, units = (np.concatenate([v, bias[:, None]], axis=1) for v, bias in ((self.a, self.d), (self.q, self.b)))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            members = units[self.of_class[k]].T
            for lo in range(cut[k], cut[k + 1], HELD_SCORES):
                at = order[lo : min(lo + HELD_SCORES, cut[k + 1])]
                h = p1.take(w1[at], axis=0)
                h += p2.take(w2[at], axis=0)
                scores = h @ members
                value = h @ classes[k] + scores[np.arange(len(at)), place[w0[at]]]
                out[at] += value - log_sums(scores)
        return out

    def rows(self) -> np.ndarray:
        """All parameters in rows of equal length: the units', the classes', the matrices'."""
        units = np.concatenate([self.r, self.q, self.b[:, None]], axis=1)
        classes = np.concatenate([np.zeros_like(self.a), self.a, self.d[:, None]], axis=1)
        return np.concatenate([units, classes, np.concatenate([self.c1, self.c2, np.zeros((WIDTH, 1))], axis=1)])

    def set_rows(self, rows: np.ndarray) -> None:
        units, classes, c = np.split(rows.astype(np.float32), [UNITS, UNITS + CLASSES])
        self.r, self.q, self.b = units[:, :WIDTH], units[:, WIDTH:-1], units[:, -1]
        self.a, self.d = classes[:, WIDTH:-1], classes[:, -1]
        self.c1, self.c2 = c[:, :WIDTH], c[:, WIDTH:-1]


def log_sums(scores: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials of each row; scores are overwritten."""
    top = scores.max()
    if top > 60 or scores.min() < -60:
        top = scores.max(axis=1)
        scores -= top[:, None]
    else:
        top = 0
    return top + np.log(np.exp(scores, out=scores) @ np.ones(scores.shape[1], scores.dtype))


def endings(w, of=slice(None)) -> np.ndarray:
    """The group of some words by their last letters: three bytes, less where a word is shorter."""
    start, end = w.start[of], w.end[of]
    key = np.zeros(len(start), U)
    for back in (3, 2, 1):
        at = end - back
        key = key * U(257) + np.where(at >= start, w.data[np.maximum(at, 0)].astype(U) + U(1), U(0))
    return (mix(key) % U(ENDINGS)).astype(np.int64)


def training_counts(rows: DataFrame) -> DataFrame:
    """(h, c, e): how often each word, by its hash, occurs in the training documents, and its ending's group."""

    def summed_up(parts):
        hashes, times, groups = (np.concatenate(x) for x in zip(*parts, strict=True))
        h, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        c = np.bincount(back, times, len(h)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(c), pa.array(groups[first].astype(np.int32))], names=["h", "c", "e"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for _, _, w in text_chunks(batch.column("text"), lower=True):
                h, first, c = np.unique(w.hash, return_index=True, return_counts=True)
                parts.append((h, c, endings(w, first)))
                held += len(h)
                if held >= HELD // 4:
                    yield summed_up(parts)
                    parts, held = [], 0
        if parts:
            yield summed_up(parts)

    counted = rows.where("not held_out").select("text").mapInArrow(run, "h long, c long, e int")
    return counted.groupBy("h").agg(F.sum("c").alias("c"), F.min("e").alias("e"))


class Words:
    """The most frequent words' hashes, counts and, for the first of them, units."""

    def __init__(self, h: np.ndarray, c: np.ndarray):
        """In the order of frequency."""
        unit = np.full(len(h), -1, np.int64)
        n = min(VOCABULARY, int((c >= MIN_COUNT).sum()))
        unit[:n] = np.arange(n)
        order = np.argsort(h)
        self.h, self.c, self.unit = h[order], c[order].astype(float), unit[order]

    def find(self, w) -> tuple[np.ndarray, np.ndarray]:
        """(unit, count) of each word; count -1 where it is not among the frequent ones."""
        values, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        group = VOCABULARY + endings(w, first)
        if not len(self.h):
            return group[inverse], np.full(len(w.hash), -1.0)
        at = np.minimum(np.searchsorted(self.h, values), len(self.h) - 1)
        real = self.h[at] == values
        return np.where(real & (self.unit[at] >= 0), self.unit[at], group)[inverse], np.where(real, self.c[at], -1.0)[inverse]


def most_frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words in the order of frequency: all whose class of counts fits into
    FREQUENT with the classes above it. A class spans 1/16 of a doubling, so the driver gets a bounded histogram and
    then no more than FREQUENT words, however many tasks there are."""
    level = F.floor(F.log2("c") * 16)
    sizes = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for at, n in sizes:
        if (total := total + n) > FREQUENT:
            break
        least = at
    if least is None:
        return np.zeros(0, U), np.zeros(0, np.int64)
    top = counts.where(level >= least).toPandas().sort_values(["c", "h"], ascending=[False, True])
    return top["h"].to_numpy(np.int64).astype(U), top["c"].to_numpy(np.int64)


def sequences(first: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(w2, w1, w0, start) of the tokens of consecutive texts, each with its end; start of each text and the total."""
    n = len(first) - 1
    start = first + np.arange(n + 1)
    w0 = np.full(start[-1], END, np.int64)
    is_word = np.ones(start[-1], bool)
    is_word[start[1:] - 1] = False
    w0[is_word] = cls
    w1 = np.concatenate([[END], w0[:-1]])  # the token before a text's first is the end of the one before it
    w2 = np.concatenate([[END], w1[:-1]])
    second = start[:-1] + 1
    w2[start[:-1]] = END
    w2[second[second < start[1:]]] = END
    return w2, w1, w0, start


def trigrams(rows: DataFrame, words, groups: int) -> DataFrame:
    """(g, codes, counts): the different trigrams of the training texts of a group, packed after every HELD tokens."""

    def packed(parts):
        codes, counts = [], []
        for x in parts.values():
            code, count = np.unique(np.concatenate(x), return_counts=True)
            codes.append(code.tobytes())
            counts.append(count.astype(np.int32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(list(parts)), pa.array(codes, pa.binary()), pa.array(counts, pa.binary())], names=["g", "codes", "counts"])

    def run(batches):
        parts: dict[int, list] = {}
        held = 0
        for batch in batches:
            for _, _, w in text_chunks(batch.column("text"), lower=True):
                w2, w1, w0, start = sequences(w.first, words.value.find(w)[0])
                code = (w2 * UNITS + w1) * UNITS + w0
                sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(w.hash))])
                text = (mix(np.diff(sums[w.first])) % U(groups)).astype(np.int64)
                for g in np.unique(text).tolist():
                    of = np.repeat(text == g, np.diff(start))
                    parts.setdefault(g, []).append(code[of])
                held += len(code)
                if held >= HELD:
                    yield packed(parts)
                    parts, held = {}, 0
        if parts:
            yield packed(parts)

    return materialise(rows.where("not held_out").select("text").mapInArrow(run, "g long, codes binary, counts binary"))


def numbers(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """What the rows of a binary column hold together, read where it lies if there is one chunk."""
    parts = []
    for x in column.chunks:
        _, ends, data = x.buffers()
        ends = np.frombuffer(ends, np.int32)[x.offset : x.offset + len(x) + 1] if len(x) else [0, 0]
        parts.append(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if ends[-1] > ends[0] else np.zeros(0, kind))
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, kind), *parts])


def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(the different trigrams in order, how often each occurs)"""
    code, count = numbers(rows.column("codes"), np.int64), numbers(rows.column("counts"), np.int32)
    if not len(code):
        return code, count.astype(float)
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order].astype(float)
    start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[start], np.add.reduceat(count, start)


def pieces(batch: pa.RecordBatch):
    """Consecutive rows of a batch of packed trigrams, HELD trigrams together at most or one row."""
    ends = np.cumsum(pc.binary_length(batch.column("codes")).to_numpy()) // 8
    low = 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + HELD, "right")))
        yield pa.Table.from_batches([batch.slice(low, high - low)])
        low = high


def summed(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, n, v) of rows (k, n, v): sums by k, collected; there are no more k than parameter rows."""
    sums = rows.groupBy("k").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(size)]).alias("v"))
    got = sums.toArrow().sort_by("k")
    values = got.column("v").combine_chunks().flatten().to_numpy().reshape(-1, size)
    return got.column("k").to_numpy(), got.column("n").to_numpy(), values


def neighbours(packed: DataFrame) -> np.ndarray:
    """How often each unit follows each of the NEIGHBOURS most frequent ones, or another."""

    def run(batches):
        total = np.zeros(UNITS * NEIGHBOURS, np.int64)
        for batch in batches:
            for piece in pieces(batch):
                code, count = unpacked(piece)
                w0, w1 = code % UNITS, code // UNITS % UNITS
                before = np.where(w1 == END, NEIGHBOURS - 2, np.minimum(w1, NEIGHBOURS - 1))
                total += np.bincount(w0 * NEIGHBOURS + before, count, len(total)).astype(np.int64)
        total = total.reshape(UNITS, NEIGHBOURS)
        k = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k].sum(axis=1)), pa.array(list(total[k]), pa.list_(pa.int64()))], names=["k", "n", "v"])

    out = np.zeros((UNITS, NEIGHBOURS))
    k, _, v = summed(packed.mapInArrow(run, "k int, n long, v array<long>"), NEIGHBOURS)
    out[k] = v
    return out


def train(packed: DataFrame, unigram: np.ndarray, cls: np.ndarray) -> LogBilinear:
    """The average of the models that the groups train."""

    def run(key, rows):
        code, count = unpacked(rows)
        w2, w1, w0 = ((code // UNITS**k % UNITS).astype(np.int16) for k in (2, 1, 0))
        del code
        model, rng = LogBilinear(unigram, cls), np.random.default_rng(SEED)
        for _ in range(EPOCHS):
            model.train(w2, w1, w0, count, rng)
        uses = sum(np.bincount(w, count, UNITS) for w in (w2, w1, w0))
        n = np.concatenate([uses, np.full(CLASSES + WIDTH, count.sum())]).astype(np.int64)
        k = np.flatnonzero(n)
        values = np.round(model.rows()[k].astype(float) * FINE).astype(np.int64) * n[k, None]
        return {"k": k.astype(np.int32), "n": n[k], "v": list(values)}

    model = LogBilinear(unigram, cls)
    start = model.rows().astype(float)
    k, n, v = summed(map_groups(packed, ["g"], run, "k int, n long, v array<long>"), start.shape[1])
    start[k] = v / FINE / n[:, None]
    model.set_rows(start)
    return model


@contextmanager
def rows_at_a_time(session, n: int):
    before = {k: session.conf.get(k) for k in (RECORDS, READ)}
    try:
        for k, v in before.items():
            session.conf.set(k, str(min(int(v), n) if int(v) > 0 else n))
        yield
    finally:
        for k, v in before.items():
            session.conf.set(k, v)


def score(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts count as lower-cased in A-Z; a null text is an empty one, whose only token is its end. Documents whose
    crc32(id as text) mod 10 is 0 are held out and teach nothing (a null id counts as an empty text). base_score is
    the smoothed unigram score, score the model's log10 probability of the whole text; without any training document
    both stay defined (base_score 0). Repeated rows are scored, and learned from, each by itself. Other columns are
    left out; an empty table gives no rows. A text's score does not depend on how rows are dealt over files or tasks.
    """
    with rows_at_a_time(documents.sparkSession, TEXT_ROWS):
        return scores(documents, id_col)


def scores(documents: DataFrame, id_col: str) -> DataFrame:
    kind = documents.select(id_col).dtypes[0][1]
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    rows = documents.select(F.col(id_col).alias("id"), F.col("text").alias("text"), held.alias("held_out"))
    counts = materialise(training_counts(rows))
    ends = rows.where("not held_out").count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top_h, top_c = most_frequent(counts)
    frequent = Words(top_h, top_c)
    n_units = int((frequent.unit >= 0).sum())
    known = top_c[:n_units].astype(float)
    # words and distinct words of the endings' groups: all words less those that are units
    by_ending = np.zeros((ENDINGS, 2))
    for e, c, n in counts.groupBy("e").agg(F.sum("c"), F.count("*")).collect():
        by_ending[e] = c, n
    in_units = documents.sparkSession.createDataFrame([(int(h),) for h in top_h[:n_units].astype(np.int64)], "h long") if n_units else None
    if in_units is not None:
        for e, c, n in counts.join(F.broadcast(in_units), "h").groupBy("e").agg(F.sum("c"), F.count("*")).collect():
            by_ending[e] -= c, n
    unigram = np.full(UNITS, 0.1)
    unigram[:n_units] += known
    unigram[VOCABULARY:END] += by_ending[:, 0]
    unigram[END] += ends
    context = documents.sparkSession.sparkContext
    words = context.broadcast(frequent)
    packed = trigrams(rows, words, -(-int(total + ends) // GROUP_TOKENS) or 1)
    with rows_at_a_time(documents.sparkSession, PACKED_ROWS):
        model = train(packed, unigram, classes_of(neighbours(packed)))
    discard(packed)
    model.__dict__.pop("squares", None)
    log_group = np.log10(by_ending[:, 0] + 0.1 * (by_ending[:, 1] + 1))
    shared = context.broadcast((model, log_group))

    def run(batches):
        m, log_rest = shared.value
        factors = m.factors()
        for batch in batches:
            for low, high, w in text_chunks(batch.column("text"), lower=True):
                unit, c = words.value.find(w)
                w2, w1, w0, start = sequences(w.first, unit)
                code, back = np.unique((w2 * UNITS + w1) * UNITS + w0, return_inverse=True)
                log_p = m.log_probability(code // UNITS**2, code // UNITS % UNITS, code % UNITS, factors)[back]
                by_text = lambda x, at: np.array([x[a:b].sum() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                rare = c < 0
                part = np.where(rare, 0, np.log10(np.where(rare, 1, c + 0.1)))
                rest = unit >= VOCABULARY
                of_rest = np.where(rest, part - log_rest[np.where(rest, unit - VOCABULARY, 0)], 0)
                pair = np.flatnonzero(rare)
                lists = pa.LargeListArray.from_arrays(pa.array(np.searchsorted(pair, w.first)), pa.array(w.hash[pair].astype(np.int64))).cast(pa.list_(pa.int64()))
                columns = [by_text(log_p, start) / np.log(10), by_text(part, w.first), by_text(of_rest, w.first), by_text(~rare, w.first)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[low:high], batch.column("held_out")[low:high], pa.array(np.diff(w.first)), *(pa.array(x.astype(t)) for x, t in zip(columns, (float, float, float, int), strict=True)), lists],
                    names=["id", "held_out", "words", "model", "part", "rest_part", "known", "rare"],
                )

    schema = f"id {kind}, held_out boolean, words long, model double, part double, rest_part double, known long, rare array<long>"
    scored = materialise(rows.mapInArrow(run, schema).withColumn("k", F.monotonically_increasing_id()))
    words_of = scored.select("k", F.explode("rare").alias("h"))
    found = words_of.join(counts.select("h", "c"), "h", "left").groupBy("k").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("rare_part"), F.count("c").alias("rare_known"))
    log_all = float(np.log10(total + ends + 0.1 * (distinct + (ends > 0) + 1)))
    log_end = float(np.log10(ends + 0.1))
    rare_part = F.coalesce("rare_part", F.lit(0.0))
    n_tokens = F.col("words") + 1
    return scored.drop("rare").join(found, "k", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        n_tokens.alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(int(total + ends)).cast("long").alias("train_tokens"),
        (F.col("part") + rare_part + F.lit(log_end) - n_tokens * F.lit(log_all)).alias("base_score"),
        (F.col("model") + F.col("rest_part") + rare_part).alias("score"),
    )


def op6_language_model(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
