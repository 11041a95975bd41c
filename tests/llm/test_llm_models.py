"""Classifiers on held-out labels; exactness of the neighbour search; the pipeline."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brute import TEXTS
from strata.llm import quality_model, queries, simhash, toxicity
from strata.llm.common import written
from strata.llm.sampling import labelled_sample

MID = "/root/testdata/sf0.01"


def judged(spark, query, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    rows = query(spark, MID).collect()
    assert len(rows) == spark.read.parquet(f"{MID}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    return [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]


def auc(rows):
    pos, neg = ([s for s, _, y in rows if y == k] for k in (1, 0))
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_quality_on_held_out_labels(spark):
    rows = judged(spark, queries.op10_quality, "quality")
    assert auc(rows) >= 0.95
    assert np.mean([p == y for _, p, y in rows]) >= 0.9


def test_toxicity_on_held_out_labels(spark):
    rows = judged(spark, queries.op6_toxicity, "toxic")
    assert auc(rows) >= 0.95
    assert all(p == 0 for _, p, y in rows if not y) and np.mean([p for _, p, y in rows if y]) >= 0.5
    # every document with a word has neighbours
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    none = [r["doc_id"] for r in queries.op6_toxicity(spark, MID).collect() if not r["evidence"]]
    assert sum(bool((texts[i] or "").split()) for i in none) < 0.01 * len(texts)


def test_toxicity_query_against_plain_cosines(spark, edge, as_table):
    """Scores and evidence of the whole query from weights, cosines and votes over all pairs."""
    import math
    from collections import Counter
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    sample = labelled_sample(docs, labels, "toxic", toxicity.PER_CLASS, toxicity.CALIBRATION).collect()
    fit = [r for r in sample if r["part"] == "fit"]

    def counts(text):
        c = Counter()
        for w, n in Counter((text or "").split()).items():
            for t in toxicity.terms_of(w):
                c[t] += n
        return c
    own = {r["doc_id"]: counts(r["text"]) for r in fit}
    y = {r["doc_id"]: r["y"] for r in fit}
    n, pos = len(fit), sum(y.values())
    df, dp = Counter(t for c in own.values() for t in c), Counter(t for i, c in own.items() if y[i] for t in c)
    phi2 = {t: (dp[t] * n - df[t] * pos) ** 2 / (df[t] * (n - df[t]) * pos * (n - pos)) if df[t] < n else 0 for t in df}
    weight = {t: math.log(1 + n / df[t]) * (0.01 + max(0, phi2[t] - 1 / (n - 1))) for t in df}

    def unit(c):
        v = {t: (1 + math.log(k)) * weight[t] for t, k in c.items() if t in weight}
        z = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / z for t, x in v.items()}
    known = {i: v for i, v in ((i, unit(c)) for i, c in own.items()) if v}

    def vote(text):
        q = unit(counts(text))
        cos = {i: sum(x * v.get(t, 0) for t, x in q.items()) for i, v in known.items()}
        near = sorted((i for i in cos if cos[i] > 0), key=lambda i: (-round(cos[i], 12), i))[:15]
        w = [1 / (0.05 + max(0, 1 - cos[i])) for i in near]
        return (sum(a * y[i] for a, i in zip(w, near)) + 2 * pos / n) / (sum(w) + 2), near
    apart = sorted((r for r in sample if r["part"] == "calibrate"), key=lambda r: r["doc_id"])
    v = np.clip([vote(r["text"])[0] for r in apart], 1e-6, 1 - 1e-6)
    slope, shift = toxicity.logistic(v, np.array([r["y"] for r in apart], dtype=float))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op6_toxicity(spark, folder).collect():
        v, near = vote(texts[r["doc_id"]])
        v = min(max(v, 1e-6), 1 - 1e-6)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(slope * math.log(v / (1 - v)) + shift))), abs=1e-9)
        assert r["evidence"] == near


@pytest.mark.parametrize("query,name", [(queries.op10_quality, "quality"), (queries.op6_toxicity, "toxic")])
def test_scores_of_odd_tables(spark, edge, as_table, no_docs, query, name):
    labels = edge.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert query(spark, as_table(documents=edge, labels=labels)).count() == edge.count()
    one = labels.where("quality = 1")
    got = query(spark, as_table(documents=edge, labels=one)).collect()
    assert {r["score"] for r in got} == {1.0}
    got = query(spark, as_table(documents=edge, labels=labels.limit(0))).collect()
    assert len({r["score"] for r in got}) == 1 and len(got) == edge.count()
    assert query(spark, as_table(documents=no_docs, labels=labels)).count() == 0


def test_sample_is_bounded_and_apart(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(500)] + [(3, "again"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(500)] + [(8, None), (None, 1)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", {0: 50, 1: 20}, 30).collect()
    assert len({r["doc_id"] for r in got}) == len(got) == 100
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0 for r in got)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) == (r["part"] == "calibrate") for r in got)


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)

    def sparse():
        t = rng.choice(40, rng.integers(1, 6), replace=False)
        w = rng.random(len(t)) + 0.1
        return {int(a): float(b) for a, b in zip(t, w / np.linalg.norm(w))}
    vectors = [sparse() for _ in range(700)] + [{1: 1.0}] * 50
    index = toxicity.Index(vectors, [0] * 750, list(range(750)), 40)
    for q in [sparse() for _ in range(60)] + [{1: 1.0}, {39: 1.0}]:
        cosine = [round(sum(q[t] * v.get(t, 0) for t in q), 12) for v in vectors]
        want = sorted((i for i in range(750) if cosine[i] > 0), key=lambda i: (-cosine[i], i))[:15]
        assert index.ids[index.nearest(q, 15)[0]].tolist() == want


def test_index_vectors_are_sparse_and_balanced():
    v = quality_model.index_vectors()
    assert (np.abs(v).sum(axis=1) == quality_model.NONZERO).all() and (v.sum(axis=1) == 0).all()


def test_temperature_and_shift():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    t, shift = quality_model.calibrated(3 * z, y, y)
    assert abs(t - 3) < 0.4 and shift == 0


def test_pipeline_stages(spark, edge, as_table, no_docs):
    """Each stage against its operator's own verdicts, on all rows it was given."""
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    kept = {n: f for n, f in corpus_pipeline.STAGES}
    assert list(kept) == ["quality_classifier", "quality_rules", "simhash_dedup", "secret_scan", "packing"]
    good = written(kept["quality_classifier"](spark, docs, MID), "a")
    want = {r["doc_id"] for r in queries.op10_quality(spark, MID).collect() if r["score"] >= 0.3}
    assert {r["doc_id"] for r in good.collect()} == want and good.dtypes == docs.dtypes
    ruled = written(kept["quality_rules"](spark, docs, MID), "b")
    want = {r["doc_id"] for r in queries.op9_quality_rules(spark, MID).collect() if r["kept"]}
    assert {r["doc_id"] for r in ruled.collect()} == want and ruled.dtypes == docs.dtypes
    single = written(kept["simhash_dedup"](spark, docs, MID), "c")
    assert {r["doc_id"] for r in single.collect()} == {r["component_id"] for r in queries.op3_simhash(spark, MID).collect()}
    masked = written(kept["secret_scan"](spark, docs, MID), "d")
    assert masked.count() == docs.count() and masked.dtypes == docs.dtypes
    secret = {r["doc_id"] for r in queries.op5_secrets(spark, MID).collect() if r["spans"]}
    assert {r["doc_id"] for r in masked.where("text like '%[secret]%'").collect()} == secret
    assert masked.where("n_chars <> length(text)").count() == 0
    again = as_table(documents=masked)
    assert not [r for r in queries.op5_secrets(spark, again).collect() if r["n_assign"] + r["n_access"] + r["n_hex"]]
    assert kept["packing"](spark, masked, MID).groupBy("doc_id").count().count() == docs.count()


def test_pipeline_on_odd_rows(spark, edge, as_table, no_docs):
    labels = spark.read.parquet(f"{MID}/labels.parquet")
    folder = as_table(documents=edge, labels=labels)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, edge, folder)
        assert got.columns == edge.columns and stage(spark, no_docs, folder).count() == 0, name
        n = got.count()
        assert n == edge.count() if name == "secret_scan" else n <= edge.count()
    # one row of each group stays, whatever repeats
    groups = {simhash.fingerprint_of(t.encode() if t else None) for t in [*TEXTS, "no id here"]}
    assert corpus_pipeline.simhash_dedup(spark, edge, folder).count() <= len(groups)
    assert corpus_pipeline.run(spark, as_table(documents=no_docs, labels=labels)).count() == 0


def test_pipeline_runs_whole(spark):
    got = corpus_pipeline.run(spark, MID)
    assert got.count() > 700 and got.where("offset + length > 1024").count() == 0


def test_pipeline_keeps_the_tokens(spark, edge):
    """The packed table holds every id of every document, in place."""
    from strata.llm import packing
    docs = edge.where("doc_id is not null and doc_id <> 3")
    t = packing.tokenizer(queries.JSON, queries.PATTERN)
    got = {}
    for r in corpus_pipeline.packing(spark, docs, MID).collect():
        assert len(r["ids"]) == 4 * r["length"] and r["offset"] + r["length"] <= 1024
        got.setdefault(r["doc_id"], {})[r["start"]] = bytes(r["ids"])
    for r in docs.select("doc_id", "text").collect():
        ids = np.frombuffer(b"".join(x for _, x in sorted(got[r["doc_id"]].items())), dtype="<u4").tolist()
        assert ids[-1] == 0 and t.decode(ids[:-1]) == (r["text"] or "")
