"""SimHash, components, sharding and nearest neighbours against plain versions."""

import itertools
import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from strata.llm import ann, queries, sharding, simhash
from strata.llm.common import salted_rank, written
from strata.llm.components import components

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def check_simhash(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    fps = [brute.fingerprint(r["text"]) for r in rows]
    roots = brute.components(fps)
    least = {}
    for r, root in zip(rows, roots):
        if r["doc_id"] is not None:
            least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    want = sorted((str(r["doc_id"]), f"{f:016x}", str(least.get(root))) for r, f, root in zip(rows, fps, roots))
    assert sorted((str(a), b, str(c)) for a, b, c in queries.op3_simhash(spark, folder).collect()) == want


def test_simhash(spark, edge, as_table, no_docs):
    check_simhash(spark, SF)
    check_simhash(spark, as_table(documents=edge))
    assert queries.op3_simhash(spark, as_table(documents=no_docs)).count() == 0


def planted(seed, groups=40, dense=150):
    """Fingerprints: lone ones, chains of few flipped bits, and a dense group."""
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(300)]
    for _ in range(groups):
        x = r.getrandbits(64)
        for _ in range(r.randrange(2, 8)):
            out.append(x)
            for bit in r.sample(range(64), r.randrange(1, 6)):
                x ^= 1 << bit
    core = r.getrandbits(64)
    for _ in range(dense):
        x = core
        for bit in r.sample(range(64), r.randrange(0, 4)):
            x ^= 1 << bit
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("block", [16, 1024])
def test_links_keep_every_component(spark, block):
    fps = planted(block)
    df = written(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), "fps")
    label = {r["node"]: r["label"] for r in components(simhash.links(df, 3, block)).collect()}
    want = brute.components(fps)
    groups = defaultdict(set)
    for i, root in enumerate(want):
        groups[root].add(signed(fps[i]))
    for members in groups.values():
        if len(members) == 1:
            assert not members & label.keys()
        else:
            assert {label[m] for m in members} == {min(members)}


def test_links_are_not_all_pairs(spark):
    """2,000 fingerprints within two bits of one another leave as forests."""
    core = 0x0123456789ABCDEF
    fps = [core] + [core ^ (1 << i) for i in range(64)] + [core ^ (1 << i) ^ (1 << j)
                                                           for i, j in itertools.combinations(range(64), 2)]
    df = written(spark.createDataFrame([(signed(x),) for x in fps[:2000]], "fp long"), "fps")
    links = written(simhash.links(df), "links")
    assert links.count() < 27 * 2000 * 2
    assert components(links).groupBy("label").count().collect() == [(min(map(signed, fps[:2000])), 2000)]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2 ** 64 - 1), st.integers(0, 2 ** 64 - 1))
def test_manhattan_bounds_hamming(x, y):
    a, b = np.array([x], dtype=np.uint64), np.array([y], dtype=np.uint64)
    want = sum(abs((x >> 2 * i & 3).bit_count() - (y >> 2 * i & 3).bit_count()) for i in range(32))
    got = int(simhash.manhattan(simhash.segment_counts(a), simhash.segment_counts(b))[0])
    assert got == want <= (x ^ y).bit_count()


def test_components_of_long_paths(spark):
    r = random.Random(3)
    nodes = r.sample(range(10 ** 6), 400)
    path = list(zip(nodes, nodes[1:]))
    ordered = [(10 ** 7 + i, 10 ** 7 + i + 1) for i in range(300)]
    star = [(5 * 10 ** 7, 6 * 10 ** 7 + i) for i in range(300)] + [(7, 7)]
    edges = spark.createDataFrame(path + ordered + star, "a long, b long")
    got = defaultdict(set)
    for row in components(edges).collect():
        got[row["label"]].add(row["node"])
    assert sorted(map(len, got.values())) == [301, 301, 400] and set(got) == {min(nodes), 10 ** 7, 5 * 10 ** 7}


def test_salted_rank_with_null_keys(spark):
    rows = [(None if i % 5 == 0 else "hot" if i % 3 else "cold", i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long")
    got = defaultdict(list)
    for r in salted_rank(df, "k", ["i"], F.xxhash64("i"), "rank", buckets=7).collect():
        got[r["k"]].append(r["rank"])
    assert sum(map(len, got.values())) == 500
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=2, max_size=2), st.lists(st.integers(0, 4), min_size=3, max_size=3),
       st.lists(st.integers(0, 5), min_size=6, max_size=6))
def test_flow_costs_least(supply, capacity, costs):
    cost = [costs[:3], costs[3:]]
    if sum(supply) > sum(capacity):
        with pytest.raises(ValueError):
            sharding.min_cost_flow(supply, capacity, cost)
        return
    flow = sharding.min_cost_flow(supply, capacity, cost)
    assert [sum(x) for x in flow] == supply and all(sum(x) <= c for x, c in zip(zip(*flow), capacity))
    splits = [[p for p in itertools.product(range(5), repeat=3) if sum(p) == s] for s in supply]
    best = min(sum(c * n for row, p in zip(cost, pair) for c, n in zip(row, p)) for pair in itertools.product(*splits)
               if all(sum(x) <= c for x, c in zip(zip(*pair), capacity)))
    assert sum(c * n for row, p in zip(cost, flow) for c, n in zip(row, p)) == best


def test_sharding(spark, edge, as_table, no_docs):
    for folder in (SF, as_table(documents=edge)):
        texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        raw = [(r["doc_id"], (r["text"] or "").encode()) for r in texts]
        rows = queries.op8_sharding(spark, folder).collect()
        assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == \
            sorted((str(i), len(t) + 1, zlib.crc32(t)) for i, t in raw)
        slots, size = defaultdict(list), defaultdict(int)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            size[r["shard"]] += r["size"]
            assert r["law"] == "bytes" and r["grown_shard"] is None
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        if folder == SF:
            assert set(size) == set(range(8)) and max(size.values()) < 1.02 * min(size.values())
    assert queries.op8_sharding(spark, as_table(documents=no_docs)).count() == 0


def test_reshard_moves_the_fewest_bytes(spark):
    rows = [(i, 100, 0 if i < 600 else 1) for i in range(800)]  # 60,000 and 20,000 bytes in shards 0 and 1
    df = spark.createDataFrame(rows, "doc_id long, size long, old_shard int")
    got = sharding.reshard(df, 4).collect()
    assert sum(r["size"] for r in got if r["old_shard"] != r["shard"]) == 40_000
    assert {r["shard"]: 0 for r in got}.keys() == {0, 1, 2, 3}


def test_rewrite_leaves_other_shards_alone(spark, tmp_path):
    rows = [(i, i % 3, 5 if i == 3 else i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, old int, shard int")
    assert sharding.rewrite(df, "old", "shard", "elsewhere", f"{tmp_path}/out") == [0, 5]
    back = {r["doc_id"]: r["shard"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert back == {i: s for i, _, s in rows if s in (0, 5)}
    with pytest.raises(ValueError):
        sharding.rewrite(df, "old", "shard", "same", "same")


def test_move_writes_whole_rows(spark, edge, as_table, monkeypatch):
    """Every row arrives with its text in a file of its shard, those of untouched shards too."""
    rows = [(i, f"text {i} " * (i % 7), i % 3) for i in range(600)] + [(None, None, 0), (3, "twice", 1), (3, "twice", 1)]
    df = sharding.text_sizes(spark.createDataFrame(rows, "doc_id long, text string, old_shard int"), F.col("text"))
    for shards in (3, 8):
        got = sharding.move(df, shards, order=("doc_id", "size", "text_crc32"))
        assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(map(str, df.select("doc_id", "text").collect()))
        assert {r["shard"] for r in got.collect()} == set(range(shards))
    assert sharding.move(df.where("doc_id < 0"), 4).count() == 0
    one = sharding.move(df.where("old_shard = 0").limit(5), 1).collect()  # stays where it is
    assert len(one) == 5 and all(r["shard"] == 0 for r in one)
    calls = []
    rewrite = sharding.rewrite
    monkeypatch.setattr(sharding, "rewrite", lambda rows, *a: calls.append(rows.columns) or rewrite(rows, *a))
    assert queries.op8_sharding(spark, as_table(documents=edge)).count() == edge.count()
    assert calls and "text" in calls[0]


def exact(rows, k):
    """Brute force: query id -> [(vec_id, product)], and all products."""
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            near = sorted(((float(np.dot(x, y)), -v) for v, y in rows if v != q), reverse=True)
            out[q] = [(-v, s) for s, v in near[:k]]
    return out


def recall_of(got, want):
    hit = total = 0
    for q, near in want.items():
        rows = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert all((-a["score"], a["vec_id"]) < (-b["score"], b["vec_id"]) for a, b in zip(rows, rows[1:]))
        last = near[-1][1] - 1e-12 if near else 0
        hit += sum(r["score"] >= last for r in rows)
        total += len(near)
    assert {r["query_id"] for r in got} <= want.keys()
    return hit / total


def test_nearest_neighbours(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in table]
    assert recall_of(queries.op7_ann(spark, "/root/testdata/sf0.01").collect(), exact(rows, 20)) >= 0.9


def test_nearest_with_odd_vectors(spark, as_table):
    """Unequal norms, a large group of equal vectors, vectors that take no part."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.1, 9)).astype(np.float32).astype(float)) for i in range(700)]
    rows += [(700 + i, np.ones(8)) for i in range(300)]
    bad = [(2000, None), (2020, [0.0] * 8), (2040, [1.0] * 7 + [None]), (2060, [float("nan")] * 8),
           (2080, [float("inf")] + [1.0] * 7), (2100, [1.0, 2.0]), (None, [1.0] * 8)]
    data = [(i, x.tolist(), 0) for i, x in rows] + [(i, x, None) for i, x in bad] + [(0, rows[0][1].tolist(), 9)]
    folder = as_table(embeddings=spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"))
    got = queries.op7_ann(spark, folder).collect()
    want = exact(rows, 20)
    assert recall_of(got, want) >= 0.9 and {r["query_id"] for r in got} == want.keys()
    equal = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 700), key=lambda r: r["rank"]) if r["score"] == 8.0]
    assert equal == sorted(equal)
    few = as_table(embeddings=spark.createDataFrame(data[:3], "vec_id long, embedding array<float>, label int"))
    assert [(r["rank"], r["vec_id"]) for r in queries.op7_ann(spark, few).collect()] == \
        [(i + 1, v) for i, (v, _) in enumerate(exact(rows[:3], 20)[0])]
    none = as_table(embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert queries.op7_ann(spark, none).count() == 0


@pytest.mark.parametrize("n", [4, 21, 26])
def test_few_vectors_have_all_neighbours(spark, as_table, n):
    rng = np.random.default_rng(n)
    data = [(i, rng.normal(size=8).astype(np.float32).astype(float).tolist(), 0) for i in range(n)]
    folder = as_table(embeddings=spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"))
    got = defaultdict(set)
    for r in queries.op7_ann(spark, folder).collect():
        got[r["query_id"]].add(r["vec_id"])
    want = {q: len(near) for q, near in exact([(i, np.array(x)) for i, x, _ in data], 20).items()}
    assert {q: len(v) for q, v in got.items()} == want and set(want.values()) == {min(n - 1, 20)}


def test_scan_equals_a_full_scan():
    """The abandoned candidates of one list aren't among the nearest."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 48))
    ids = np.arange(3000)
    i, j, s = ann.scan(x[:50], ids[:50], np.full(50, -np.inf), x, ids, float((x * x).sum(axis=1).max()) * 1.001, 10)
    p = x[:50] @ x.T
    p[np.arange(50), np.arange(50)] = -np.inf
    want = {q: set(np.argsort(-p[q])[:10]) for q in range(50)}
    hit = sum(len(want[q] & set(j[i == q].tolist())) for q in range(50))
    assert hit >= 0.97 * 500 and np.allclose(s, p[i, j])


def test_clashing_names_are_refused(spark):
    """One rule: a column named like an output is refused, in any case of letters."""
    from strata.llm import sharding
    df = spark.createDataFrame([(1, "a", 5, 2, 0)], "doc_id long, text string, fp long, size long, old_shard int")
    for call in (lambda: simhash.near_duplicates(df.withColumn("Component_Id", F.lit(1))), lambda: sharding.text_sizes(df, F.col("text")),
                 lambda: sharding.reshard(df.withColumn("SLOT", F.lit(1)), 2), lambda: sharding.move(df.withColumn("shard", F.lit(1)), 2)):
        with pytest.raises(ValueError, match="already"):
            call()
    assert sharding.text_sizes(df, F.col("text"), "bytes", "crc").columns[-2:] == ["bytes", "crc"]
    got = simhash.near_duplicates(df.withColumn("component_id", F.lit("x")), component="c", root="r").first()
    assert (got["component_id"], got["c"], got["r"]) == ("x", 1, 5)
