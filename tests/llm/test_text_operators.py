"""The text operators against brute force, on small documents with nulls, empty and long texts, copies and repeated rows."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import pytest

from lodestone.llm import common, language_id, language_model, mixture, ngram_join, packing, pii, quality_rules, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 long, row string"


def words(text):
    return WORD.findall(text or "")


def made_documents(seed: int, n: int = 70):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "and", "der", "und", "la", "de", "é😀", "x,", "#*", "Straße"] + [f"w{i}" for i in range(80)]
    text = lambda k: rnd.choice(["", " ", "\n"]) + "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", "\n", "\t", "  "]) for _ in range(k))
    texts = [text(rnd.choice([1, 4, 5, 12, 13, 40, 200])) for _ in range(n)]
    passage = text(30)
    for i in range(0, n, 6):
        texts[i] = text(20) + " " + passage + " " + text(rnd.choice([0, 15]))
    base = text(120).split()
    for i in range(1, n, 5):  # near copies
        copy = list(base)
        for _ in range(rnd.randint(0, 3)):
            copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
        texts[i] = " ".join(copy)
    texts[3] = texts[1]
    texts += [None, "", "  \n", "one", "one", "two words", " ".join(["again"] * 3000), text(9000), "a\x0bb\x0cc\rd e"]
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "a", None]), len(t or ""), 1, "clash") for i, t in enumerate(texts)]
    rows += [rows[1], rows[2], (None, texts[1], "en", "a", 1, 1, None), (None, None, None, None, None, None, None)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return made_documents(4)


@pytest.fixture(scope="module")
def documents(spark, rows):
    return common.materialise(spark.createDataFrame(rows, SCHEMA).repartition(5))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_hashing_kernels_split_words_as_the_pattern_does(rows):
    import numpy as np
    import pyarrow as pa

    texts = [r[1] for r in rows]
    at = 0
    by_word = {}
    for low, high, w in common.text_chunks(pa.array(texts)):
        assert low == at
        at = high
        for i in range(high - low):
            raw = w.data.tobytes()
            span = slice(w.first[i], w.first[i + 1])
            found = [raw[a:b].decode() for a, b in zip(w.start[span], w.end[span], strict=True)]
            assert found == words(texts[low + i])
            for x, h in zip(found, w.hash[span].tolist(), strict=True):
                assert by_word.setdefault(x, h) == h
    assert at == len(texts) and len(set(by_word.values())) == len(by_word)


# n-gram join


def brute_links(rows, threshold=0.8):
    kept = [(r[0], words(r[1])) for r in rows if r[0] is not None and words(r[1])]
    sets = [(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}) for i, w in kept]
    links, up = collections.Counter(), {i: i for i, _ in sets}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    n = [0] * len(sets)
    for a, (i, s) in enumerate(sets):
        for b, (j, t) in enumerate(sets[:a]):
            if len(s & t) >= threshold * len(s | t):
                n[a] += 1
                n[b] += 1
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, n[a], root(i)) for a, (i, _) in enumerate(sets))


def test_ngram_join(documents, rows, nothing, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)  # groups of several blocks
    got = ngram_join.jaccard_groups(documents)
    assert got.columns == ["doc_id", "n_links", "class_id", "kept"]
    all_rows = [tuple(r) for r in got.collect()]
    linked = sorted(r[:3] for r in all_rows if r[0] is not None and words(dict((x[0], x[1]) for x in rows)[r[0]]))
    assert linked == brute_links(rows)
    assert len(all_rows) == len(rows)
    assert all(n == 0 and c == i and k for i, n, c, k in all_rows if i is None or not words(dict((x[0], x[1]) for x in rows)[i]))
    assert ngram_join.jaccard_groups(nothing).count() == 0
    left = ngram_join.keep_one(documents)
    assert left.columns == documents.columns
    assert collections.Counter((r[0], tuple(words(r[1]))) for r in left.collect()) == brute_kept(rows)


def brute_kept(rows, threshold=0.8):
    """How often keep_one keeps each (id, words), from all pairs of rows."""
    free = [(r[0], tuple(words(r[1]))) for r in rows if r[0] is None or not words(r[1])]
    nodes = sorted({(r[0], tuple(words(r[1]))) for r in rows} - set(free), key=repr)
    sets = [{w[k : k + 5] for k in range(len(w) - 4)} or {w} for _, w in nodes]
    group = list(range(len(nodes)))
    for a in range(len(nodes)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    best = {}
    for g, node in zip(group, nodes, strict=True):
        best.setdefault(g, []).append(node)
    out = collections.Counter(free)
    for members in best.values():
        least = min(i for i, _ in members)
        tied = [m for m in members if m[0] == least]
        assert len(tied) == 1  # the test data have no two texts of one id in one group
        out[tied[0]] += 1
    return out


def test_rows_that_share_an_id_are_judged_each_by_itself(spark):
    base = {c: " ".join(f"{c}{k}" for k in range(60)) for c in "ab"}
    rows = [(1, base["a"]), (5, base["a"]), (5, base["b"]), (7, base["b"] + " more"), (7, base["b"] + " more"), (9, "alone again"), (9, "alone again"), (None, base["a"]), (3, None), (3, None)]
    docs = spark.createDataFrame([(i, t, {"x": 1}) for i, t in rows], "doc_id long, text string, extra map<string,int>").repartition(3)
    kept = collections.Counter((r[0], r[1]) for r in ngram_join.keep_one(docs).collect())
    assert kept == collections.Counter([(1, base["a"]), (5, base["b"]), (9, "alone again"), (None, base["a"]), (3, None), (3, None)])


def test_a_large_group_of_near_copies(spark, monkeypatch):
    from lodestone.llm import ngram_join as nj

    monkeypatch.setattr(common, "HOT_ROWS", 10)  # joins are salted
    monkeypatch.setattr(common, "SIDE_BYTES", 1 << 17)
    monkeypatch.setattr(nj, "BLOCK", 64)
    rnd = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join([*base[:k], f"x{i}", *base[k + 1 :]])) for i in range(400) for k in [rnd.randrange(120)]]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(2000 + i, f"quite another text of number {i} here") for i in range(100)]
    got = {r["doc_id"]: r for r in nj.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    want = brute_links(rows)
    assert [(i, got[i]["n_links"], got[i]["class_id"]) for i, _, _ in want] == want


def test_pruning_keeps_what_may_reach_the_threshold():
    least = ngram_join.least_matches(0.8)
    assert least[16] < 0.8 * 16 and least[128] < 0.8 * 128 and least[128] > 0.5 * 128


# Substring dedup


def brute_cut(rows, window=13):
    texts = [(r[0], words(r[1])) for r in rows]
    first = {}
    for i, w in texts:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest(), left))
    return sorted(out, key=repr)


@pytest.mark.parametrize("segments", [4000, 2])
def test_substring_dedup(documents, rows, nothing, monkeypatch, segments):
    monkeypatch.setattr(substring_dedup, "SEGMENTS", segments)  # 2: nearly all anchors are split again and again
    want = brute_cut(rows)
    assert sum(r[2] for r in want) > 500
    assert collected(substring_dedup.remove_repeats(documents)) == [r[:4] for r in want]
    if segments > 2:
        with_text = substring_dedup.remove_repeats(documents, with_text=True)
        assert sorted(r["kept_text"] for r in with_text.where("n_removed > 0").collect()) == sorted(r[4] for r in want if r[2])
        assert substring_dedup.remove_repeats(nothing).count() == 0


def test_suffix_automaton_finds_first_documents():
    rnd = random.Random(2)
    strings = [[rnd.randrange(3) for _ in range(rnd.randrange(4, 25))] for _ in range(60)]
    automaton = substring_dedup.SuffixAutomaton()
    for doc, s in enumerate(strings):
        automaton.add(s, doc)
    for s in strings + [[0, 1, 2] * 5, [9, 9, 9, 9]]:
        want = [next((d for d, t in enumerate(strings) if any(t[k : k + 4] == s[i : i + 4] for k in range(len(t)))), -1) for i in range(len(s) - 3)]
        assert automaton.first_documents(s, 4) == want


# Quality rules


def brute_counts(text):
    w = words(text)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def brute_distance(counts, reference, prior=quality_rules.PRIOR):
    total, n = sum(reference), sum(counts)
    out = 0.0
    for c, r in zip(counts, reference, strict=True):
        q = r / total
        p = (c + prior * q) / (n + prior)
        m = (p + q) / 2
        out += (p * math.log2(p / m) if p else 0) / 2 + (q * math.log2(q / m) if q else 0) / 2
    return math.sqrt(max(0, out))


def brute_histograms(text, listed):
    text = text or ""
    chars = [0] * len(quality_rules.CLASSES)
    for c in text:
        chars[quality_rules.CLASS_OF[c.encode()[0]]] += 1
    counts = collections.Counter(re.findall(r"(?:[A-Za-z]|[^\x00-\x7f])+", text))
    index = {w: i for i, w in enumerate(listed)}
    found = [0] * (len(listed) + 1)
    for w, n in counts.items():
        found[index.get(re.sub("[A-Z]", lambda m: m.group().lower(), w), len(listed))] += n
    return chars, found


@pytest.mark.parametrize("at_once", [1000, 1])
def test_quality_rules(documents, rows, nothing, monkeypatch, at_once):
    monkeypatch.setattr(quality_rules, "AT_ONCE", at_once)  # 1: a pass for each language
    got = quality_rules.judge(documents)
    base = collected(got.select("doc_id", *quality_rules.BASE, "base_failed"))
    assert base == sorted(((r[0], *brute_counts(r[1])) for r in rows), key=repr)
    listed = sorted({w for t in quality_rules.COMMON.values() for w in t.split()})
    references = {}
    for r in rows:
        if r[2] is not None and not brute_counts(r[1])[5]:
            sums = references.setdefault(r[2], [[0] * len(quality_rules.CLASSES), [0] * (len(listed) + 1)])
            for s, h in zip(sums, brute_histograms(r[1], listed), strict=True):
                s[:] = [a + b for a, b in zip(s, h, strict=True)]
    want = []
    for r in rows:
        n, chars, *_, failed = brute_counts(r[1])
        hist = brute_histograms(r[1], listed)
        over = min(max(brute_distance(hist[0], a) / quality_rules.MOST_CHARS, brute_distance(hist[1], b) / quality_rules.MOST_WORDS) for a, b in references.values())
        judged = n >= quality_rules.MIN_WORDS and chars >= quality_rules.MIN_CHARS
        want.append((r[0], not failed and not (judged and over > 1)))
    assert collected(got.select("doc_id", "kept")) == sorted(want, key=repr)
    kept = quality_rules.keep_good(documents)
    assert kept.schema == documents.schema
    assert sorted(map(repr, ((r["doc_id"]) for r in kept.collect()))) == sorted(repr(i) for i, k in want if k)
    assert quality_rules.judge(nothing).count() == 0 and quality_rules.keep_good(nothing).count() == 0


def test_symbols_instead_of_text_are_rejected(spark):
    prose = [(i, " ".join(random.Random(i).choices("the of and house river walked slowly home it was".split(), k=150)), "en") for i in range(30)]
    odd = [(99, " ".join(f"{w}***$$$###" for w in prose[0][1].split()), "en")]
    verdicts = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(prose + odd, "doc_id long, text string, lang string")).collect()}
    assert not verdicts.pop(99)
    plain = [brute_counts(t)[5] for _, t, _ in prose]
    assert all(verdicts[i] != failed for (i, _, _), failed in zip(prose, plain, strict=True))


def test_long_texts_without_common_words_are_rejected(spark):
    def text(seed, share, n=600):
        rnd = random.Random(seed)
        return " ".join(rnd.choice("the of and to in a is that it was".split()) if rnd.random() < share else rnd.choice("bcdfgh") + str.join("", rnd.choices("aeioulnrst", k=5)) for _ in range(n))

    rows = [(i, text(i, 0.28), "en") for i in range(40)] + [(100 + i, text(i, 0, 300 + 300 * i), "en") for i in range(3)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(kept[100 + i] for i in range(3)) and all(kept[i] for i in range(40))


# Language model


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("frequent", [200_000, 20])
def test_language_model(documents, rows, nothing, monkeypatch, frequent):
    monkeypatch.setattr(language_model, "FREQUENT", frequent)
    tokens = [(r[0], words((r[1] or "").translate(LOWER)) + [None]) for r in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = collections.Counter(t for i, ts in tokens if not held(i) for t in ts)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)) for i, ts in tokens), key=repr)
    got = language_model.score(documents).collect()
    for a, b in zip(sorted((tuple(r)[:6] for r in got), key=lambda r: (repr(r[:5]), r[5])), sorted(want, key=lambda r: (repr(r[:5]), r[5])), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    if frequent > 20:
        assert language_model.score(nothing).count() == 0
        again = language_model.score(documents.repartition(1)).collect()
        for a, b in zip(*(sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in x) for x in (again, got)), strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-6)


def test_language_model_against_a_plain_replay(spark, monkeypatch):
    """The scores of documents from the model's parameters, by plain loops, and better ones than those of single words."""
    import numpy as np

    kept = []
    train = language_model.train
    monkeypatch.setattr(language_model, "train", lambda *args: kept.append(train(*args)) or kept[-1])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in language_model.score(docs).collect()}
    rows = [(r["doc_id"], words((r["text"] or "").translate(LOWER))) for r in docs.select("doc_id", "text").collect()]
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["score"] for i in held) > 0.97 * sum(got[i]["base_score"] for i in held)
    model = kept[0]
    c = collections.Counter(t for i, ws in rows if not got[i]["held_out"] for t in ws)
    hashes = {}
    for _, _, w in common.text_chunks(__import__("pyarrow").array([" ".join(sorted({x for _, ws in rows for x in ws}))])):
        raw = w.data.tobytes()
        ends = language_model.endings(w)
        for a, b, h, e in zip(w.start.tolist(), w.end.tolist(), w.hash.astype(np.int64).tolist(), ends.tolist(), strict=True):
            hashes[raw[a:b].decode()] = h, e
    frequent = sorted((t for t in c if c[t] >= language_model.MIN_COUNT), key=lambda t: (-c[t], hashes[t][0]))[: language_model.VOCABULARY]
    unit = {t: k for k, t in enumerate(frequent)}
    group = collections.defaultdict(lambda: [0, 0])
    for t, n in c.items():
        if t not in unit:
            group[hashes[t][1]][0] += n
            group[hashes[t][1]][1] += 1
    softmax = lambda x: x - x.max() - math.log(np.exp(x - x.max()).sum())
    for i, ws in random.Random(1).sample([r for r in rows if len(r[1]) < 200], 12):
        w1 = w2 = language_model.END
        total = 0.0
        for t in [*ws, None]:
            u = language_model.END if t is None else unit.get(t, language_model.VOCABULARY + hashes[t][1])
            h = model.r[w1] @ model.c1 + model.r[w2] @ model.c2
            k = model.cls[u]
            members = np.flatnonzero(model.cls == k)
            total += softmax(model.a @ h + model.d)[k] + softmax(model.q[members] @ h + model.b[members])[members.tolist().index(u)]
            if t is not None and t not in unit:
                n, kinds = group[hashes[t][1]]
                total += math.log((c[t] + 0.1) / (n + 0.1 * (kinds + 1)))
            w1, w2 = u, w1
        assert got[i]["score"] == pytest.approx(total / math.log(10), rel=1e-4)


def test_model_is_normalised_and_learns():
    import numpy as np

    rng = np.random.default_rng(1)
    units = language_model.UNITS
    unigram = np.full(units, 1e-3)
    unigram[:4] = 1000
    cls = rng.permutation(np.repeat(np.arange(language_model.CLASSES), language_model.MEMBERS))
    model = language_model.LogBilinear(unigram, cls)
    w1 = rng.integers(0, 4, 20000)
    w2, w0 = rng.integers(0, 4, 20000), (w1 + 1) % 4  # the unit before tells the next
    before = model.log_probability(w2, w1, w0).mean()
    for _ in range(5):
        model.train(w2, w1, w0, np.ones(20000), rng)
    assert model.log_probability(w2, w1, w0).mean() > before + 0.3
    every = np.arange(units)
    for a, b in ((0, 1), (3, 200)):
        assert np.exp(model.log_probability(np.full(units, b), np.full(units, a), every)).sum() == pytest.approx(1, rel=1e-4)
    again = language_model.LogBilinear(unigram, cls)
    again.set_rows(model.rows())
    assert all((getattr(again, n) == getattr(model, n)).all() for n in model.NAMES)


def test_classes_keep_apart_what_follows_different_units():
    import numpy as np

    rng = np.random.default_rng(2)
    side = rng.integers(0, 2, language_model.UNITS)
    after = rng.poisson(3.0, (language_model.UNITS, language_model.NEIGHBOURS)) * np.where(np.arange(language_model.NEIGHBOURS) % 2 == side[:, None], 5, 0)
    cls = language_model.classes_of(after.astype(float))
    assert (np.bincount(cls) == language_model.MEMBERS).all()
    mixed = [len(set(side[cls == k].tolist())) for k in range(language_model.CLASSES)]
    assert sum(n > 1 for n in mixed) <= 2


# Language identification


def test_forward_algorithm_sums_all_segmentations():
    import numpy as np

    pieces = sorted({b" a", b"a", b"ab", b"b", b" ab", b"ba", b"bab", b" ", b"c"})
    index = language_id.Pieces(pieces)
    prob = np.full((len(pieces) + 256, 2), 1e-3)
    prob[: len(pieces)] = np.random.default_rng(0).random((len(pieces), 2))

    def segmentations(w):
        if not w:
            yield []
        for n in range(1, len(w) + 1):
            if w[:n] in pieces or n == 1:
                piece = pieces.index(w[:n]) if w[:n] in pieces else len(pieces) + w[0]
                yield from ([piece, *rest] for rest in segmentations(w[n:]))

    for w in (b"ab", b"babab", b"xabba", b"ababababcab"):
        matrix = np.frombuffer(b" " + w, np.uint8)[None, :]
        found = list(index.find(matrix))
        total, uses = np.zeros(2), np.zeros_like(prob)
        for s in segmentations(b" " + w):
            p = np.prod(prob[s], axis=0)
            total += p
            for k in s:
                uses[k] += p
        assert np.allclose(index.forward(found, matrix.shape, prob)[1][0], np.log(total))
        assert np.allclose(index.expected(found, matrix.shape, prob, np.ones((1, 2))), uses / total)


def test_long_words_are_scored_across_all_cuts():
    import numpy as np

    rnd = random.Random(9)
    pieces = sorted({bytes(rnd.choices(b"abc", k=rnd.randint(1, 12))) for _ in range(200)} | {b" a"})
    index = language_id.Pieces(pieces)
    prob = np.random.default_rng(1).random((len(pieces) + 256, 3)) * 0.01
    where = {p: k for k, p in enumerate(pieces)}
    for size in (60, 97, 128, 700, 9001):
        word = bytes([32]) + bytes(rnd.choices(b"abcd", k=size))
        total, log = [np.ones(3)] + [np.zeros(3)] * len(word), np.zeros(3)
        for i in range(len(word)):
            top = total[i]
            log += np.log(top)
            total[i : i + 13] = [x / top for x in total[i : i + 13]]
            for n in range(1, min(12, len(word) - i) + 1):
                k = where.get(word[i : i + n], len(pieces) + word[i] if n == 1 else None)
                if k is not None:
                    total[i + n] = total[i + n] + total[i] * prob[k]
        assert np.allclose(index.log_total(np.frombuffer(word, np.uint8), prob), log + np.log(total[len(word)]))
    assert b"".join(language_id.cut_run("äö".encode() * 100)) == "äö".encode() * 100
    assert all(part.decode() for part in language_id.cut_run("äöx".encode() * 100))


@pytest.mark.parametrize("at_once", [24, 1])
def test_language_id_on_held_out_documents(spark, nothing, monkeypatch, at_once):
    monkeypatch.setattr(language_id, "AT_ONCE", at_once)  # 1: a pass for each language
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows) > 100
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language_id.identify(nothing).count() == 0
    kept = _predictions.setdefault("rows", {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows})
    assert all(r["lang_pred"] == kept[r["doc_id"]][0] and r["score"] == pytest.approx(kept[r["doc_id"]][1]) for r in rows)


_predictions: dict = {}


def test_language_id_edges(documents, rows):
    got = language_id.identify(documents).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in got:
        if r["doc_id"] is not None:
            letters = any(c.isalpha() for c in texts[r["doc_id"]] or "")
            assert (r["lang_pred"] == "und") == (not letters)
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


# Personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}
            if fine[kind]:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_base_spans(spark, nothing):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aZ0159..@@+-- ()_%x,\n") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rnd.choice("0123456789 -+.") for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    texts += ["4539 1488 0343 6467 and 4539148803436467-1", "a@b.c@d.e", "a@b.c_x@d.e", "1.2.3.4.5.6.7.8", "001.002.003.255", "é😀 a@b.de 😀 +49 30 1234567", None, ""]
    texts += ["a@" + "b." * 30000 + "c", "1 " * 30000, "1" * 60000, "a" * 60000, "+1" + "2 " * 20000, "0-" * 3000 + "@" + "x-" * 30000]
    got = pii.counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        want = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert sum(r[f"n_{k}"] for k in PLAIN) == want.count(":") // 2
    assert pii.counts(nothing).count() == 0 and pii.sanitise(nothing).count() == 0


def test_terms_that_disclose_an_entity(spark):
    rows = [(i, f"the word{i} of Johannes Brandt, mail jb@corp.example or call; filler {i} text") for i in range(5)]
    rows += [(10 + i, f"the mail of x{i} a{i}@b.example or call filler text") for i in range(40)]
    rows += [(60, rows[0][1]), (100, "Johannes Brandt went home"), (101, None), (102, "")]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    found = {r["doc_id"]: r for r in pii.counts(docs).collect()}
    assert found[0]["spans"] == found[60]["spans"] == "term:13:21,term:22:28,email:35:50"
    assert found[10]["n_term"] == 0 and found[100]["spans"] == "" and found[101]["spans"] == ""
    clean = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    assert clean[0]["text"] == "the word0 of [TERM] [TERM], mail [EMAIL] or call; filler 0 text" and clean[0]["n_chars"] == len(clean[0]["text"])
    assert clean[100]["text"] == rows[-3][1] and clean[101]["text"] is None


def test_terms_that_disclose_an_entity_of_one_text(spark):
    far = "an ordinary sentence of filler text that all others have too, said again\n" * 5
    rows = [(i, f"{far}common text {'abcdefghij'[i % 10] * 4} number {i % 50} and {i}") for i in range(1100)]
    rows += [(5000, f"Zebulon Quist wrote\n{far}mail zq@corp.example, {far}at home in Wexbury")]
    rows += [(5001 + i, f"text {i} of Wexbury and its people") for i in range(9)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    # Wexbury stands in nine more texts: it discloses too little
    assert clean.pop(5000) == f"[TERM] [TERM] [TERM]\n{far}mail [EMAIL], {far}at [TERM] in Wexbury".replace("mail", "[TERM]")
    assert clean == {i: t for i, t in rows if i != 5000}


def test_very_many_matches_in_one_text(spark):
    n = 12_000
    text = " ".join(f"u{i}@a{i}.example 10.0.{i % 256}.{i % 255}" for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in pii.counts(docs).collect()}
    assert (got[1]["n_email"], got[1]["n_ip"]) == (n, n)
    assert got[1]["base_sha256"] == hashlib.sha256(plain_spans(text).encode()).hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[1] == " ".join(["[EMAIL] [IP]"] * n) and clean[2] == "short"
    assert time.perf_counter() - began < 120


def test_overlapping_spans_and_terms(spark):
    text = "+49 30 1.2.3.45678 abc, +1 2345678901abc"
    rows = [(1, text)] + [(10 + i, f"row {i} of plain text with words") for i in range(1100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.counts(docs).collect()}[1]
    spans = [x.split(":") for x in got["spans"].split(",")]
    assert ",".join(":".join(x) for x in spans if x[0] != "term") == plain_spans(text)
    assert [text[int(a) : int(b)] for k, a, b in spans if k == "term"] == ["abc", "abc"]


def test_sanitise_keeps_rows_and_columns(documents, rows):
    out = pii.sanitise(documents)
    assert out.schema == documents.schema and out.count() == len(rows)


# Packing


def brute_pack(lengths, packer):
    """The same rule with a plain search for the best bin."""
    left = collections.Counter(lengths)
    bins, where = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        left[n] -= 1
        fitting = [b for b in bins if b["room"] >= n]
        if fitting:
            room = min(b["room"] for b in fitting)
            b = [b for b in fitting if b["room"] == room][-1]
        else:
            costs = []
            for c in packer.sizes:
                if c >= n:
                    room, rest = c - n, +left
                    while any(x <= room and k > 0 for x, k in rest.items()):
                        x = max(x for x, k in rest.items() if x <= room and k > 0)
                        rest[x] -= 1
                        room -= x
                    costs.append(((room + packer.overhead) / c, c))
            b = {"room": min(costs)[1], "used": 0}
            bins.append(b)
        where[i] = (id(b), b["used"])
        b["room"] -= n
        b["used"] += n
    return sorted(min(c for c in packer.sizes if c >= b["used"]) for b in bins)


def test_packing_rule_against_a_plain_search():
    for seed in range(6):
        rnd = random.Random(seed)
        packer = packing.Packer((8, 16, 32), overhead=2)
        lengths = [rnd.choice([1, 2, 3, 5, 7, 11, 20, 32]) for _ in range(60)]
        where, offset, sizes = packer.pack(lengths)
        used = collections.Counter()
        for b, o, n in sorted(zip(where, offset, lengths, strict=True)):
            assert o == used[b]
            used[b] += n
        assert all(s == min(c for c in packer.sizes if c >= used[b]) for b, s in enumerate(sizes))
        assert sum(sizes) <= sum(brute_pack(lengths, packer)) * 1.1


def test_packing_places_every_word_once(documents, rows, nothing):
    got = packing.pack_documents(documents, capacities=(64, 128, 512), group=20).collect()
    placed = collections.Counter()
    bins = collections.defaultdict(list)
    for r in got:
        placed[r["doc_id"]] += r["n_words"]
        if r["n_words"]:
            bins[r["bin_id"]].append(r)
        else:
            assert r["bin_id"] is None and r["bin_capacity"] == 0
    want = collections.Counter()
    for r in rows:
        want[r[0]] += len(words(r[1]))
    assert placed == want
    for content in bins.values():
        content.sort(key=lambda r: r["bin_offset"])
        end = 0
        for r in content:
            assert r["bin_offset"] == end
            end += r["n_words"]
        assert {r["bin_capacity"] for r in content} == {min(c for c in (64, 128, 512) if c >= end)}
    assert packing.pack_documents(nothing).count() == 0
    again = packing.pack_documents(documents.repartition(1), capacities=(64, 128, 512), group=20).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    # each group on its own, by the packer whose rule is tested above
    groups = collections.defaultdict(list)
    for r in got:
        if r["n_words"]:
            groups[r["bin_id"] >> 32].append(r)
    for content in groups.values():
        content.sort(key=lambda r: -r["n_words"])
        sizes = packing.Packer((64, 128, 512)).pack([r["n_words"] for r in content])[2]
        assert sorted(sizes) == sorted({r["bin_id"]: r["bin_capacity"] for r in content}.values())
    same_rows = documents.sparkSession.createDataFrame([(5, "a b c")] * 300, "doc_id long, text string")
    assert len({r["bin_id"] >> 32 for r in packing.pack_documents(same_rows, group=20).collect()}) > 5


# Mixing


def test_mixing(documents, rows, nothing):
    got = mixture.mix(documents, __import__("pyspark.sql.functions", fromlist=["struct"]).struct("doc_id", "source"), mixture.word_count()).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.remove(s)
    taken, longest = collections.Counter(), max(len(words(r[1])) for r in rows)
    for r in got:
        s = r["row"]["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= longest for s in order)
    again = mixture.mix(documents.repartition(3), __import__("pyspark.sql.functions", fromlist=["struct"]).struct("doc_id", "source"), mixture.word_count()).collect()
    key = lambda rs: sorted((repr(r["row"]), r["size"], r["copies"]) for r in rs)
    assert key(got) == key(again)
    mixed = mixture.mix_documents(documents)
    assert mixed.schema == documents.schema and mixed.count() == sum(r["copies"] for r in got)
    assert mixture.mix_documents(nothing).count() == 0


def test_language_model_hands_few_rows_to_python_at_a_time(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from lodestone.llm import language_model as lm

    seen, before = {}, spark.conf.get(lm.RECORDS)
    for name in ("trigrams", "neighbours", "train"):
        step = lambda *a, f=getattr(lm, name), n=name: (seen.__setitem__(n, int(spark.conf.get(lm.RECORDS))), f(*a))[1]
        monkeypatch.setattr(lm, name, step)
    assert lm.score(spark.createDataFrame([(k, "one two three") for k in range(30)], "doc_id long, text string")).count() == 30
    assert seen == {"trigrams": 1000, "neighbours": 32, "train": 32} and spark.conf.get(lm.RECORDS) == before
    packed = pa.table({"codes": [np.array([7, k], np.int64).tobytes() for k in range(4)], "counts": [np.array([1, k], np.int32).tobytes() for k in range(4)]}, pa.schema([("codes", pa.binary()), ("counts", pa.binary())]))
    for rows in (packed, packed.slice(1, 2), pa.concat_tables([packed.slice(1, 1), packed.slice(2, 1)])):
        code, count = lm.unpacked(rows)
        want = {0: 0.0, 1: 1.0, 2: 2.0, 3: 3.0, 7: 4.0} if rows.num_rows == 4 else {1: 1.0, 2: 2.0, 7: 2.0}
        assert dict(zip(code.tolist(), count.tolist())) == want
    assert not len(lm.unpacked(packed.slice(0, 0))[0])


def test_quality_rules_hand_few_texts_to_python(spark, documents, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    seen, before = [], spark.conf.get(key)
    write = lambda df, f=quality_rules.materialise: (seen.append(int(spark.conf.get(key))), f(df))[1]
    monkeypatch.setattr(quality_rules, "materialise", write)
    quality_rules.judge(documents)
    assert seen[0] == 1000 and spark.conf.get(key) == before


@pytest.mark.parametrize("scale", [1.0, 4000.0])
def test_language_model_sums_classes_without_their_exponentials(monkeypatch, scale):
    import numpy as np

    from lodestone.llm import language_model as lm

    rng = np.random.default_rng(2)
    model = lm.LogBilinear(rng.random(lm.UNITS) + 0.1, rng.permutation(np.repeat(np.arange(lm.CLASSES), lm.MEMBERS)))
    model.r, model.d, model.b = (x * np.float32(s) for x, s in ((model.r, scale), (model.d, scale / 100), (model.b, 2.0)))
    w2, w1, w0 = (rng.integers(0, lm.UNITS, 3000) for _ in range(3))
    w2[1:1500], w1[1:1500] = w2[0], w1[0]  # equal contexts in a row
    summed, log_sums = [], lm.log_sums
    monkeypatch.setattr(lm, "log_sums", lambda scores: (summed.append(len(scores)), log_sums(scores))[1])
    got = model.log_probability(w2, w1, w0)
    h = (model.r[w1].astype(float) + model.r[w2]) / 2
    want = np.zeros(3000)
    for scores, of in ((h @ model.a.T.astype(float) + model.d, model.cls[w0][:, None] == np.arange(lm.CLASSES)), (np.einsum("ij,ikj->ik", h, model.q[model.of_class[model.cls[w0]]].astype(float)) + model.b[model.of_class[model.cls[w0]]], model.of_class[model.cls[w0]] == w0[:, None])):
        top = scores.max(axis=1)
        want += scores[of] - top - np.log(np.exp(scores - top[:, None]).sum(axis=1))
    assert np.allclose(got, want, rtol=1e-5, atol=2e-4)
    # the members of each token's class; of contexts all but those whose factors vanish in all classes
    assert sum(summed) == 3000 if scale == 1 else 3000 < sum(summed) < 4502
    assert not len(model.log_probability(*[np.zeros(0, int)] * 3))
