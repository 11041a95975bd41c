import random

import numpy as np

from strata.operators import routes as RT
from strata.operators.routes import staged_route_cost
from strata.sources.grid import explode_stops, read_grid

# fixed values: the two hand-made route cases (start is 1-based); both answers are 17
R1 = (1, 1, ["abcdefghijklmnopqrstuvwxyz", "abtxyzutalkhfdyutxzbzhhawj"], "nut", 17)
R2 = (4, 4, ["abcdefg", "xyzabch", "wnopqdi", "ymvwrej", "ulutsfk", "tkjihgl", "srqponm"], "squirrel", 17)


def brute(grid, start, stops):
    pos = {}
    for r, line in enumerate(grid):
        for c, ch in enumerate(line):
            pos.setdefault(ch, []).append((r, c))
    front = {start: 0}
    for ch in stops:
        if ch not in pos:
            continue
        front = {t: min(cost + abs(t[0] - p[0]) + abs(t[1] - p[1]) for p, cost in front.items()) for t in pos[ch]}
    return min(front.values())


def run(spark, cases):
    lines, routes, stops = [], [], []
    for i, (sr, sc, grid, st, _) in enumerate(cases):
        lines += [(i, r, line) for r, line in enumerate(grid)]
        routes.append((i, i, sr - 1, sc - 1))
        stops.append((i, st))
    cells = read_grid(spark.createDataFrame(lines, "grid_id int, r int, line string"))
    rt = spark.createDataFrame(routes, "route_id int, grid_id int, sr int, sc int")
    sp = explode_stops(spark.createDataFrame(stops, "route_id int, stops string"))
    out = staged_route_cost(rt, sp, cells)
    return {r["route_id"]: r["cost"] for r in out.collect()}


def test_known_answers(spark):
    got = run(spark, [R1, R2])
    assert got == {0: 17, 1: 17}


def test_random_grids_vs_brute_force(spark):
    rng = random.Random(11)
    cases = []
    for _ in range(6):
        n, m = rng.randint(2, 9), rng.randint(2, 9)
        grid = ["".join(rng.choice("abcd") for _ in range(m)) for _ in range(n)]
        st = "".join(rng.choice("abcdez") for _ in range(rng.randint(0, 7)))   # e, z: no cell → skipped
        cases.append((rng.randint(1, n), rng.randint(1, m), grid, st, None))
    got = run(spark, cases)
    for i, (sr, sc, grid, st, _) in enumerate(cases):
        assert got[i] == brute(grid, (sr - 1, sc - 1), st)


def test_segments_multiply_to_the_whole_route(spark, monkeypatch):
    """Routes of many segments, some without any valid stop, several rounds of products."""
    monkeypatch.setattr(RT, "SEGMENT", 2)
    rng = random.Random(5)
    grid = ["".join(rng.choice("abcd") for _ in range(5)) for _ in range(4)]
    cases = [(2, 3, grid, "".join(rng.choice("abcdzz") for _ in range(n)), None) for n in (0, 1, 2, 3, 5, 9, 17, 40)]
    got = run(spark, cases)
    for i, (sr, sc, g, st, _) in enumerate(cases):
        assert got[i] == brute(g, (sr - 1, sc - 1), st)


def test_valid_stops_and_nearest(spark):
    cells = spark.createDataFrame([(0, 0, 0, "a"), (0, 2, 2, "a"), (0, 0, 3, "b")], "grid_id int, r int, c int, type string")
    routes = spark.createDataFrame([(1, 0), (2, 0)], "route_id int, grid_id int")
    stops = spark.createDataFrame([(1, 1, "z"), (1, 2, "a"), (1, 3, "b"), (2, 1, "b")], "route_id int, seq int, type string")
    got = RT.valid_stops(stops, routes, cells).select("route_id", "seq", "type").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "b")]
    points = spark.createDataFrame([(7, 0, 1, 1, "a"), (8, 0, 2, 1, "a")], "route_id int, grid_id int, r int, c int, type string")
    near = {r["route_id"]: (r["to_r"], r["to_c"], r["dist"]) for r in RT.nearest_cell(points, cells).collect()}
    assert near == {7: (0, 0, 2), 8: (2, 2, 1)}


def test_all_unknown_stops_cost_zero(spark):
    got = run(spark, [(1, 1, ["ab", "ba"], "xyz", 0)])
    assert got == {0: 0}


def test_grid_scan_shapes(spark):
    cells = read_grid(spark.createDataFrame([(0, 0, "abc"), (0, 1, "def")], "grid_id int, r int, line string"))
    rows = sorted((r["r"], r["c"], r["type"]) for r in cells.collect())
    assert rows == [(0, 0, "a"), (0, 1, "b"), (0, 2, "c"), (1, 0, "d"), (1, 1, "e"), (1, 2, "f")]


def test_large_grids_and_ties(spark):
    """Distances over a grid with many cells a type; several stops at one place; ties to the smallest cell."""
    rng = random.Random(8)
    grid = ["".join(rng.choice("ab") if rng.random() < 0.7 else "c" for _ in range(60)) for _ in range(50)]
    cases = [(rng.randint(1, 50), rng.randint(1, 60), grid, "".join(rng.choice("abc") for _ in range(12)), None) for _ in range(3)]
    got = run(spark, cases)
    for i, (sr, sc, g, st, _) in enumerate(cases):
        assert got[i] == brute(g, (sr - 1, sc - 1), st)
    small = ["".join(rng.choice("aaabbc") for _ in range(9)) for _ in range(7)]
    at = [(r, c, ch) for r, line in enumerate(small) for c, ch in enumerate(line)]
    points = [(n, g, r, c, t) for n, (g, r, c, t) in enumerate((g, r, c, t) for g in (0, 1) for r in range(-2, 9) for c in range(-1, 11) for t in "abcz")]
    cells = spark.createDataFrame([(g, *x) for g in (0, 1) for x in at] + [(0, *at[0])], "grid_id int, r int, c int, type string")
    near = {r["n"]: (r["dist"], r["to_r"], r["to_c"]) for r in RT.nearest_cell(
        spark.createDataFrame(points, "n int, grid_id int, r int, c int, type string"), cells).collect()}
    want = {n: min((abs(r - y) + abs(c - x), y, x) for y, x, k in at if k == t) for n, _, r, c, t in points if t != "z"}
    assert near == want


def test_grids_are_swept_together():
    """Several grids at once, as each alone and as all pairs of cells tell."""
    rng = np.random.default_rng(3)
    rows, columns = np.array([0, 2, 3, 9]), np.array([-4, 1, 2])
    cost = np.where(rng.random((7, 4, 3)) < 0.3, RT.FAR, rng.integers(0, 9, (7, 4, 3)))
    got = RT.sweep(cost, rows, columns)
    way = np.abs(rows[:, None, None, None] - rows[None, None, :, None]) + np.abs(columns[None, :, None, None] - columns[None, None, None, :])
    for n in range(7):
        assert (got[n] == RT.sweep(cost[n], rows, columns)).all()
        assert (got[n] == (cost[n] + way).min(axis=(2, 3))).all()


def test_a_route_with_stops_needs_a_start():
    """A null start is an error for a route with a stop in the grid, and of no account for others."""
    import pyarrow as pa
    import pytest
    cells = pa.table({"r": [0, 1], "c": [0, 0], "type": ["a", "b"]})

    def parts(types, sr):
        return pa.table({"route_id": pa.array([7], pa.int64()), "types": pa.array([types], pa.list_(pa.string())), "sr": pa.array([sr], pa.int64()),
                         "sc": pa.array([2], pa.int64()), "last": pa.array([None], pa.string()), "costs": pa.array([None], pa.list_(pa.int64()))})
    assert RT.followed(parts(["a", "z", "b"], 3), cells).to_pylist() == [{"route_id": 7, "last": "b", "costs": [6]}]
    assert RT.followed(parts(["z"], None), cells).to_pylist() == [{"route_id": 7, "last": None, "costs": None}]
    with pytest.raises(ValueError, match="no start"):
        RT.followed(parts(["z", "a"], None), cells)
    assert RT.followed(parts(["a"], 3).slice(0, 0), cells).num_rows == 0
