"""Embedding near-duplicates, spelling variants and ranked search against plain versions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from strata.llm import embedding_dups as dups, lexical, queries, variants

SF = "/root/testdata/sf0.001"


# --- embedding near-duplicates ---

def plain_links(vectors, cosine=0.95):
    """(n_links, smallest member of the component) for a list of vectors or None."""
    n = len(vectors)
    x = np.array([v if v is not None else np.full(len(vectors[0]), np.nan) for v in vectors], dtype=np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = np.nan_to_num(u @ u.T, nan=-1.0) >= cosine
    np.fill_diagonal(linked, False)
    root = np.arange(n)
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], n).min(axis=1))
        if (new == root).all():
            return linked.sum(axis=1), root
        root = new


def clustered(rng, n, d, groups, noise):
    """Random unit vectors, some of them in tight groups of the given sizes."""
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    at = 0
    for size in groups:
        near = x[at] + rng.normal(size=(size, d)) * noise / math.sqrt(d)
        x[at:at + size] = near / np.linalg.norm(near, axis=1)[:, None]
        at += size
    return x[rng.permutation(n)]


def test_forest_finds_the_links(spark, monkeypatch):
    """Several levels and rounds of splits, dense groups beyond a leaf and a block."""
    monkeypatch.setattr(dups, "LEAF", 64)
    monkeypatch.setattr(dups, "BLOCK", 128)
    monkeypatch.setattr(dups, "LEVELS", 3)
    rng = np.random.default_rng(4)
    x = clustered(rng, 4000, 32, [700, 150, 40, 5, 5, *[2] * 200], 0.2)
    x = np.concatenate([x, x[:300], x[:50] * 2.5])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(dups.near_duplicates(df.repartition(5)).collect(), key=lambda r: r["vec_id"])
    links, root = plain_links(list(x))
    found = np.array([r["n_links"] for r in got])
    assert (found <= links).all()  # no false link, and none counted twice
    assert found.sum() >= 0.98 * links.sum()
    same = np.array([r["component_id"] for r in got]) == root
    assert same.mean() > 0.995
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_more_trees_for_more_vectors():
    sizes = [dups.trees_for(n, 0.95) for n in (10, 10**4, 10**6, 10**9)]
    assert sizes == sorted(sizes) and sizes[0] == 1 and 3 <= sizes[1] < sizes[3] <= 40


def test_embedding_query(spark, as_table, no_docs):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {r["vec_id"]: r for r in queries.op11_embedding_dups(spark, SF).collect()}
    links, root = plain_links([r["embedding"] for r in rows])
    for r, n, c in zip(rows, links, root):
        assert (got[r["vec_id"]]["n_links"], got[r["vec_id"]]["component_id"]) == (n, rows[c]["vec_id"])


def test_embedding_cases(spark, as_table):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.0]
    nan = float("nan")
    rows = [(5, v), (3, [2.0, 4.0, 6.0]), (5, v), (None, v), (7, w), (7, w), (1, None), (2, [0.0] * 3), (4, [1.0, None, 2.0]),
            (6, [nan, 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (9, [1.0, 2.0]), (None, [0.0, 1.0, 0.0]), (10, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as row", "'x' as rep", "2 as n_links")
    got = Counter(tuple(r) for r in queries.op11_embedding_dups(spark, as_table(embeddings=df)).collect())
    want = Counter({(5, 3, 3, False): 2, (3, 3, 3, True): 1, (None, 3, 3, False): 1, (7, 1, 7, True): 2, (None, 0, None, True): 1})
    want.update((i, 0, i, True) for i in (1, 2, 4, 6, 8, 9, 10))
    assert got == want
    assert queries.op11_embedding_dups(spark, as_table(embeddings=df.limit(0))).count() == 0


# --- spelling variants ---

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1:] or len(a) == len(b) and a[i + 1:] == b[i + 1:]


def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if k >= 2 and len(w) >= 7}


def plain_variants(n):
    near = defaultdict(list)
    by_open = defaultdict(set)  # words that agree when one code point is taken out, or is there already
    for w in n:
        for i in range(len(w)):
            by_open[w[:i] + w[i + 1:]].add(w)
    for key, ws in by_open.items():
        ws |= {key} & n.keys()
        for a in ws:
            near[a] += [b for b in ws if one_edit(a, b)]
    out, form = {}, {}
    for w, k in n.items():
        others = sorted(set(near[w]), key=lambda o: (-n[o], o))
        form[w] = others[0] if others and n[others[0]] >= 10 * k else None
        out[w] = len(others)
    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n[w], out[w], n[form[w]] if form[w] else None) for w in n}


def as_set(df):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_variants_query(spark, edge, as_table, no_docs):
    for folder in (SF, as_table(documents=edge)):
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
        assert as_set(queries.op12_variants(spark, folder)) == plain_variants(plain_words(rows))
    assert queries.op12_variants(spark, as_table(documents=no_docs)).count() == 0


def test_variants_of_crowded_chunks(spark):
    """Words with common beginnings and ends, chains of forms, long words."""
    rng = np.random.default_rng(3)
    letters = list("abcé")
    n = {}
    for _ in range(3000):
        w = "prefix" + "".join(rng.choice(letters, rng.integers(2, 7)))
        n[w] = int(rng.integers(2, 2000))
    for _ in range(300):
        n["".join(rng.choice(letters, 3)) + "commonending"] = int(rng.integers(2, 50))
    n |= {"chained": 9000, "chaineds": 800, "chaineds" + "x": 70, "chainedsxy": 5, "a" * 5000: 4, "a" * 4999: 50, "a" * 5001: 2}
    words = variants.written(spark.createDataFrame(list(n.items()), "word string, n long"), "words")
    want = plain_variants({w: k for w, k in n.items() if len(w) < 100})
    want |= {("a" * 5000, "a" * 4999, "a" * 4999, 4, 2, 50), ("a" * 4999, None, "a" * 4999, 50, 1, None),
             ("a" * 5001, None, "a" * 5001, 2, 1, None)}
    assert as_set(variants.variants(words)) == want
    few = variants.near_words(words, crowd=2).count()
    assert few == variants.near_words(words).count() == sum(r[4] for r in want) // 2


# --- ranked search ---

def plain_ranking(docs, items, k=10):
    term = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def terms(t):
        return term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 25 + (75 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


def test_ranked_query(spark, edge, as_table, no_docs, monkeypatch):
    items = spark.createDataFrame([(1, "one two WORDS card"), (2, None), (3, ""), (4, "é中文😀 a b idiot a"), (None, "w1 w2 w976 here"),
                                   (1, "one two WORDS card"), (6, "unheard of"), (7, "x" * 50_000 + " y f")], "item_id long, text string")
    own = as_table(documents=edge, benchmark=items.selectExpr("*", "1 as rank", "2 as score"))
    for folder in (SF, own):
        docs, asked = ([tuple(r) for r in spark.read.parquet(f"{folder}/{t}.parquet").select(k, "text").collect()]
                       for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
        want = plain_ranking(docs, list(dict.fromkeys(asked)))
        for chunk in (lexical.CHUNK, 7):
            monkeypatch.setattr(lexical, "CHUNK", chunk)
            assert Counter(tuple(r) for r in queries.op13_ranked(spark, folder).collect()) == want
    monkeypatch.setattr(lexical, "ITEM_BYTES", 30_000)
    assert Counter(tuple(r) for r in queries.op13_ranked(spark, own).collect()) == want
    assert queries.op13_ranked(spark, as_table(documents=no_docs, benchmark=items)).count() == 0
    assert queries.op13_ranked(spark, as_table(documents=edge, benchmark=items.limit(0))).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.dictionaries(st.integers(0, 12), st.integers(1, 5), min_size=1, max_size=8), st.integers(25, 400)),
                min_size=1, max_size=40),
       st.lists(st.tuples(st.integers(0, 14), st.integers(1, 3000)), max_size=6, unique_by=lambda x: x[0]), st.integers(1, 5))
def test_branch_and_bound_is_exact(docs, item, k):
    rows = [([*sorted(d)], [d[t] for t in sorted(d)], m, i) for i, (d, m) in enumerate(docs)]
    best = []
    lexical.visit(lexical.tree(rows), item, best, k)
    scores = [(sum(lexical.gain(w, d[t], m) for t, w in item if t in d), -i) for i, (d, m) in enumerate(docs)]
    assert sorted(best) == sorted(sorted((s for s in scores if s[0] > 0), reverse=True)[:k])
