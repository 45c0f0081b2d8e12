"""Vectors, urls and the pipeline against brute force."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from lodestone.llm import common, embedding_dedup, mixture, pii, queries, url_rules

from ..test_queries import same
from .test_text_operators import SCHEMA, brute_counts, brute_links, made_documents, plain_spans, words

# Vectors


def made_vectors(seed, n=400, dim=16):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in rng.normal(size=dim)]) for i in range(n)]
    for i in range(0, n, 4):  # noisy copies, some beyond the half angle of their base
        rows[i] = (i, [float(a + b) for a, b in zip(rows[1][1], rng.normal(0, rng.choice([0.05, 0.3, 0.45]), dim), strict=True)])
    for i in range(2, n, 10):
        rows[i] = (i, [3 * v for v in rows[2][1]])  # the same direction
        rows[i + 1] = (i + 1, list(rows[3][1]))  # the same vector
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * dim), (n + 3, [None] + [1.0] * (dim - 1)), (n + 4, [float("nan")] * dim), (n + 5, [float("inf")] * dim), (None, rows[3][1])]
    rows += [(n + 6, [1e-300 * v for v in rows[3][1]]), (n + 7, [1e300 * v for v in rows[3][1]]), (n + 8, rows[3][1][:5]), rows[5]]
    return rows


def brute_vectors(rows, threshold=0.9):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = []
    for _, v in good:
        x = np.array(v) / np.abs(v).max()
        unit.append(x / np.linalg.norm(x))
    up = {i: i for i, _ in good}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    n = [0] * len(good)
    for a in range(len(good)):
        for b in range(a):
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                n[a] += 1
                n[b] += 1
                x, y = root(good[a][0]), root(good[b][0])
                up[max(x, y)] = min(x, y)
    found = [(i, n[k], root(i)) for k, (i, _) in enumerate(good)]
    rest = list(rows)
    for g in good:
        rest.remove(g)
    return sorted([*found, *((i, 0, i) for i, _ in rest)], key=repr)


@pytest.mark.parametrize(("window", "block"), [(64, 2048), (8, 16)])
def test_near_duplicate_vectors(spark, monkeypatch, window, block):
    monkeypatch.setattr(embedding_dedup, "WINDOW", window)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = made_vectors(1)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cid int, comp string").repartition(6)
    got = [tuple(r) for r in embedding_dedup.near_duplicates(df).collect()]
    assert sorted((r[:3] for r in got), key=repr) == brute_vectors(rows)
    assert all(r[3] == (r[0] == r[2] or r[0] is None) for r in got)


def test_vectors_of_floats_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "vec_id int, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True)}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def planted(x, pairs, low, high, rng):
    """x with row n + k at a cosine between low and high from row k, for k < pairs."""
    base = x[:pairs]
    w = unit(rng.normal(size=base.shape))
    w = unit(w - (w * base).sum(axis=1, keepdims=True) * base)
    c = np.linspace(low, high, pairs)[:, None]
    return np.concatenate([x, c * base + np.sqrt(1 - c**2) * w])


@pytest.mark.parametrize(("cosine", "patience"), [(0.0, 1000), (0.8, 1000), (0.75, 0)])
def test_pairs_inside_a_cone_or_a_dense_topic(spark, monkeypatch, cosine, patience):
    """patience 0: after the first passes all pending vectors are compared."""
    monkeypatch.setattr(embedding_dedup, "WINDOW", 128)
    monkeypatch.setattr(embedding_dedup, "PATIENCE", patience)
    monkeypatch.setattr(embedding_dedup, "PASSES", 12)
    rng = np.random.default_rng(3)
    mid = unit(rng.normal(size=64))
    x = unit(rng.normal(size=(2500, 64)))
    x = unit(math.sqrt(cosine) * mid + math.sqrt(1 - cosine) * x)
    x[2000:] = unit(rng.normal(size=(500, 64)))  # a topic and what is around it
    x = planted(x, 500, 0.9002, 0.93, rng)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    assert linked.sum() >= 1000
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    pairs = np.argwhere(linked).tolist()
    missed = [(a, b) for a, b in pairs if got[a]["component_id"] != got[b]["component_id"]]
    assert len(missed) <= (0.002 * len(pairs) if patience else 0)
    assert sum(got[i]["n_links"] for i in range(3000)) >= 0.998 * linked.sum()
    assert all(got[i]["n_links"] <= n for i, n in enumerate(linked.sum(axis=1).tolist()))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 300: 200, 200: 200}


# URLs


def brute_url(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def test_url_rules(spark, monkeypatch):
    rnd = random.Random(5)
    labels = ["org", "example", "com", "a", "b", "www", "Éa", "xorg"]
    host = lambda: ".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 4)))
    path = lambda: "".join("/" + rnd.choice(["es", "en", "1", "", "fr"]) for _ in range(rnd.randint(0, 3)))
    urls = [f"http://{host()}{path()}{rnd.choice(['', '?q=/es/', '#x', '/'])}" for _ in range(1500)]
    urls += [None, "", "no scheme", "http://", "://org/", "http://ORG/ES/", "ftp://a://b/c", "http://example.org?x", "http://a.org./es/", urls[0], urls[0]]
    urls += ["http://com\x01x/fr/", "http://x\x01com/fr/", "http://x.com\x01/fr/", "http://a.b/fr/"]
    pages = spark.createDataFrame([(None if i == 9 else i, u, "clash", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string").repartition(7)
    many = [(host(), path() or "/", rnd.choice(["allow", "block"])) for _ in range(120)]
    chosen = {}
    for h, p, v in many:
        chosen[h, p] = "block" if chosen.get((h, p)) == "block" else v
    many = [(h, p, v) for (h, p), v in chosen.items()] + [("b/a", "/fr/", "block")]
    for rules in (url_rules.RULES, many, []):
        want = sorted(((None if i == 9 else i, *brute_url(u, rules)) for i, u in enumerate(urls)), key=repr)
        assert sorted((tuple(r) for r in url_rules.filter_urls(pages, rules).collect()), key=repr) == want
    monkeypatch.setattr(url_rules, "RULES_PER_SWEEP", 40)
    table = spark.createDataFrame([*many, (None, "/", "block")], "host string, path string, verdict string")
    want = sorted(((None if i == 9 else i, *brute_url(u, many)) for i, u in enumerate(urls)), key=repr)
    for rules in (many, table):
        assert sorted((tuple(r) for r in url_rules.filter_urls(pages, rules).collect()), key=repr) == want
    assert url_rules.filter_urls(pages.limit(0), many).count() == 0


# The queries and their SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    same(spark, duck, name, __spark_entry__.queries(), __spark_entry__.oracle_sql())


from ..test_queries import duck  # noqa: E402, F401


def test_one_query_for_each_operator():
    names = [n for n in queries.QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries()


# The pipeline


def brute_copies(docs):
    """Copies of each document in the mix: the formula of the operator, with a plain rank over each source."""
    draw = lambda purpose, *place: int(hashlib.md5(":".join([purpose, *place]).encode()).hexdigest()[:8], 16) / 2**32
    sizes = collections.Counter()
    for r in docs:
        sizes[r["source"]] += len(words(r["text"]))
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: mixture.WEIGHTS[k % 3] for k, s in enumerate(order)}
    by_ratio = sorted(order, key=lambda s: 2 * sizes[s] / weight[s])
    left, total = float(sum(weight.values())), 1.5 * sum(sizes.values())
    target = {}
    for s in by_ratio:
        target[s] = min(2.0 * sizes[s], total / left * weight[s])
        total, left = total - target[s], left - weight[s]
    out = []
    for s in order:
        mine = [r for r in docs if r["source"] == s]
        h = {r["doc_id"]: draw("mix", str(r["doc_id"])) for r in mine}
        n = {r["doc_id"]: len(words(r["text"])) for r in mine}
        mine.sort(key=lambda r: (math.isqrt(n[r["doc_id"]]), math.floor(h[r["doc_id"]] * mixture.SALTS), h[r["doc_id"]]))
        e = target[s] / sizes[s] if sizes[s] else 0.0
        u = draw("offset", s or "", "true" if s is None else "false")
        out += [(r["doc_id"], math.floor(e * k + u) - math.floor(e * (k - 1) + u)) for k, r in enumerate(mine, 1)]
    return dict(out)


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, seen = [], set()
    for r in made_documents(8, 120):
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            text = r[1] if r[0] % 7 or not r[1] else r[1] + f" mail user{r[0]}@corp.example or +49 (30) 555-{r[0]:04d} now"
            rows.append((r[0], text, *r[2:]))
    docs = spark.createDataFrame(rows, SCHEMA).drop("k1", "row")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        steps.append(common.materialise(stage(spark, steps[-1] if steps else read, str(tmp_path))))
    assert all(s.schema == read.schema for s in steps[:-1])
    quality, single, clean, mixed = ([r.asDict() for r in s.collect()] for s in steps[:-1])
    texts = {r[0]: r[1] for r in rows}
    assert {r["doc_id"] for r in quality} <= {i for i, t in texts.items() if not brute_counts(t)[5]}
    assert len(quality) > 40
    classes = brute_links([(r["doc_id"], r["text"]) for r in quality])
    assert {r["doc_id"] for r in single} == {i for i, _, c in classes if i == c}
    for r in clean:
        want, at = "", 0
        spans = [x.split(":") for x in plain_spans(texts[r["doc_id"]]).split(",") if x]
        for kind, a, b in spans:
            want += texts[r["doc_id"]][at : int(a)] + f"[{kind.upper()}]"
            at = int(b)
        assert r["text"] == want + texts[r["doc_id"]][at:]
        assert not spans or r["n_chars"] == len(r["text"])
    assert any("[EMAIL]" in r["text"] for r in clean) and len(clean) == len(single)
    copies = brute_copies(clean)
    assert collections.Counter(r["doc_id"] for r in mixed) == collections.Counter({i: n for i, n in copies.items() if n})
    plan = steps[-1].collect()
    placed = collections.Counter()
    for r in plan:
        placed[r["doc_id"]] += r["n_words"]
    wanted = collections.Counter()
    for r in mixed:
        wanted[r["doc_id"]] += len(words(r["text"]))
    assert placed == wanted
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(plan)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert pii.find(spark.read.parquet(f"{tmp_path}/documents.parquet")).where(F.size("spans") > 0).count() == 0
