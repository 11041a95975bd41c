import math
import random

from strata.operators import trees as TR


def embed_brute(n, edges, pts):
    """Independent sequential solver of the same placement rule (test oracle)."""
    adj = [[] for _ in range(n)]
    for u, v in edges:
        adj[u].append(v)
        adj[v].append(u)
    parent, order, seen, stack = [-1] * n, [], [False] * n, [0]
    seen[0] = True
    while stack:
        v = stack.pop()
        order.append(v)
        for w in adj[v]:
            if not seen[w]:
                seen[w], parent[w] = True, v
                stack.append(w)
    size = [1] * n
    for v in reversed(order):
        if parent[v] >= 0:
            size[parent[v]] += size[v]
    res = [-1] * n
    top = max(range(n), key=lambda i: (pts[i][1], -pts[i][0], -i))
    work = [(0, -1, [top] + [i for i in range(n) if i != top])]
    while work:
        v, par, chunk = work.pop()
        res[v] = chunk[0]
        mx, my = pts[chunk[0]]
        rest = chunk[1:]
        if not rest:
            continue
        pang = -math.pi / 2 if par < 0 else math.atan2(pts[res[par]][1] - my, pts[res[par]][0] - mx)

        def rel(x, y):
            a = math.atan2(y - my, x - mx) - pang
            if a < 0:
                a += 2 * math.pi
            if a >= 2 * math.pi:
                a -= 2 * math.pi
            return a

        ordered = sorted(rest, key=lambda q: (rel(*pts[q]), q))
        kids = [w for w in adj[v] if w != par]
        runs, i = [], 0
        for c in kids:
            runs.append(ordered[i:i + size[c]])
            i += size[c]
        keyed = []
        for c, run in zip(kids, runs):
            if run:
                cx = sum(pts[q][0] for q in run) / len(run)
                cy = sum(pts[q][1] for q in run) / len(run)
                keyed.append((rel(cx, cy), c, size[c]))
        keyed.sort()
        i = 0
        for _, c, sz in keyed:
            work.append((c, v, ordered[i:i + sz]))
            i += sz
    return res


def run_embed(spark, trees):
    e, p = [], []
    for t, (n, edges, pts) in enumerate(trees):
        e += [(t, k, u, v) for k, (u, v) in enumerate(edges)]
        p += [(t, i, float(x), float(y)) for i, (x, y) in enumerate(pts)]
    edf = spark.createDataFrame(e, "tree_id int, eid int, u long, v long")
    pdf = spark.createDataFrame(p, "tree_id int, point_id long, x double, y double")
    out = TR.embed(edf, pdf).collect()
    res = {t: [None] * trees[t][0] for t in range(len(trees))}
    for r in out:
        res[r["tree_id"]][r["vertex"]] = r["point_id"]
    return res


def test_known_case_and_brute_force(spark):
    # fixed values: the hand case with 3 vertices; expected 1-based answer "3 2 1"
    t2 = (3, [(1, 0), (0, 2)], [(38.082299, -593.978441), (-42.281845, -296.136429), (217.814614, -47.946068)])
    t1 = (2, [(0, 1)], [(292.365297, 561.624168), (28.742075, 869.836531)])
    rng = random.Random(9)
    trees = [t2, t1]
    for _ in range(4):
        n = rng.randint(2, 25)
        edges = [(rng.randint(0, k - 1), k) for k in range(1, n)]
        rng.shuffle(edges)
        edges = [(v, u) if rng.random() < 0.5 else (u, v) for u, v in edges]
        pts = [(rng.uniform(-100, 100), rng.uniform(-100, 100)) for _ in range(n)]
        trees.append((n, edges, pts))
    got = run_embed(spark, trees)
    assert [x + 1 for x in got[0]] == [3, 2, 1]
    assert [x + 1 for x in got[1]] == [2, 1]
    for t, (n, edges, pts) in enumerate(trees):
        assert got[t] == embed_brute(n, edges, pts)


def test_subtree_sizes_and_allocate(spark):
    e = spark.createDataFrame([(0, 1, 0, 1), (0, 2, 0, 2), (0, 3, 1, 3), (0, 4, 1, 4)],
                              "tree_id int, eid int, u long, v long")
    s = {r["vertex"]: r["size"] for r in TR.subtree_sizes(TR.orient(e)).collect()}
    assert s == {0: 5, 1: 3, 2: 1, 3: 1, 4: 1}
    items = spark.createDataFrame([(0, i, i) for i in range(1, 7)], "g int, item int, rank long")
    bins = spark.createDataFrame([(0, "a", 2, 3), (0, "b", 1, 2)], "g int, bin string, bin_order int, cap long")
    got = {r["item"]: r["bin"] for r in TR.allocate(items, TR.bin_starts(bins, ["g"], ["bin_order"]), ["g"]).collect()}
    assert got == {1: "b", 2: "b", 3: "a", 4: "a", 5: "a"}      # item 6 exceeds capacity


def test_allocate_long_and_empty_bins(spark):
    """Bins longer than a run of ranks, and bins that take nothing."""
    items = spark.createDataFrame([(0, i) for i in range(1, 3001)], "g int, rank long")
    bins = spark.createDataFrame([(0, 1, 0), (0, 2, 2500), (0, 3, 0), (0, 4, 400)], "g int, bin int, cap long")
    got = TR.allocate(items, TR.bin_starts(bins, ["g"], ["bin"]), ["g"]).groupBy("bin").count().collect()
    assert sorted(map(tuple, got)) == [(2, 2500), (4, 400)]


def test_deep_and_wide_trees(spark, monkeypatch):
    """A path of 10,000 vertices in few written rounds, a star, random trees with other roots."""
    rng = random.Random(4)
    trees = {0: [(k, k + 1) for k in range(9_999)], 1: [(0, k) for k in range(1, 500)]}
    for t in range(2, 8):
        trees[t] = [(rng.randint(max(0, k - 5), k - 1), k) for k in range(1, rng.randint(2, 300))]
    rows = []
    for t, edges in trees.items():
        edges = [(v, u) if rng.random() < 0.5 else (u, v) for u, v in edges]
        rng.shuffle(edges)
        rows += [(t, i, u, v) for i, (u, v) in enumerate(edges)]
    e = spark.createDataFrame(rows, "tree_id int, eid int, u long, v long")
    written, keep = [], TR.stored
    monkeypatch.setattr(TR, "stored", lambda df, name="stored": written.append(name) or keep(df, name))
    got = TR.orient(e).collect()
    assert written.count("tour") <= 20
    want = {}
    for t, edges in trees.items():
        depth, size = {0: 0}, {}
        for u, v in edges:
            depth[v] = depth[u] + 1
        for u, v in reversed(edges):
            size[v] = size.get(v, 1)
            size[u] = size.get(u, 1) + size[v]
        want |= {(t, v): (u, depth[v], size[v]) for u, v in edges} | {(t, 0): (-1, 0, size[0])}
    assert {(r["tree_id"], r["vertex"]): (r["parent"], r["depth"], r["size"]) for r in got} == want
    # the eid is the edge's own
    edge = {(t, i): {u, v} for t, i, u, v in rows}
    assert all({r["vertex"], r["parent"]} == edge[r["tree_id"], r["eid"]] for r in got if r["parent"] >= 0)
    plain = TR.subtree_sizes(spark.createDataFrame([(r["tree_id"], r["vertex"], r["parent"], r["eid"]) for r in got if r["tree_id"] > 1],
                                                   "tree_id int, vertex long, parent long, eid int"))
    assert {(r["tree_id"], r["vertex"]): r["size"] for r in plain.collect()} == {k: v[2] for k, v in want.items() if k[0] > 1}


def test_roots_and_what_they_reach(spark):
    e = spark.createDataFrame([(0, 0, 5, 6), (0, 1, 6, 7), (0, 2, 8, 9), (1, 0, 0, 1)], "tree_id int, eid int, u long, v long")
    roots = spark.createDataFrame([(0, 6), (1, 1), (2, 3)], "tree_id int, root long")
    got = sorted((r["tree_id"], r["vertex"], r["parent"], r["depth"], r["size"]) for r in TR.orient(e, roots).collect())
    assert got == [(0, 5, 6, 1, 1), (0, 6, -1, 0, 3), (0, 7, 6, 1, 1), (1, 0, 1, 1, 1), (1, 1, -1, 0, 2), (2, 3, -1, 0, 1)]
    assert TR.orient(e.limit(0)).count() == 0
