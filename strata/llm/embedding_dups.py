"""Near-duplicate vectors by a forest of random-projection trees.

Equal vectors are one class. In each tree a node splits its classes at a random
direction: those up to the threshold plus ``SPILL`` go left, those from the
threshold minus it right, so classes near the threshold go both ways. The spill
is half a standard deviation of what the projections of two vectors at the link
distance differ by. Splits are fitted on a bounded sample of every node
(``SAMPLE`` vectors) and end at ``LEAF`` classes: of a few directions and
thresholds the first that parts hardly any linked pairs of the sample is taken.
A node in which all of them would part many is a dense group and stays whole.
``LEVELS`` levels are fitted at once; what is still large is split again.

A tree keeps a pair at the link distance together with a probability that
follows from the spill and the depth; the number of trees makes the chance to
miss it in all of them less than 1 - ``RECALL``. Closer pairs are missed less.

Within leaves all pairs are compared by the exact cosine of the original
vectors. A pair that meets in several leaves counts in the first of their common
leaves, which both rows name, so pairs are never written: a leaf returns the
number of links of each class and a spanning forest of them, and components
unite the forests. A leaf of more than ``BLOCK`` classes is cut into blocks, and
each pair of blocks is a group of its own.

Cases: vectors that are null, zero or hold null or non-finite components, and
those of another dimension than most, link with nothing. Every row is a vector
of its own, repeated ids and null ids too; a component without an id has a null
component_id, and ``kept`` compares nulls as equal. An empty table gives an
empty result. Extra columns aren't read.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.util import discard, recording
from .ann import embedding_type, matrix
from .common import written
from .components import components

COSINE, RECALL = 0.95, 0.995
LEAF, BLOCK = 1024, 2048
SAMPLE, LEVELS, LEAST, SEED = 8192, 7, 48, 17
SPILL, TRIES, PARTED, DENSE, FEW = 0.5, 4, 0.06, 0.08, 20
OPEN = 4096
#: Place of the tree in a node's number; below it the path from the root, which is 1.
TREE = 56


def link_distance(cosine: float) -> float:
    return math.sqrt(2 - 2 * cosine)


def spill_of(cosine: float, d: int) -> float:
    """Half the width of the overlap of two children."""
    return SPILL / 2 * link_distance(cosine) / math.sqrt(d)


def trees_for(n: int, cosine: float) -> int:
    """How many trees ``n`` vectors need. A level parts a pair at the link
    distance if its projections (normal, as the direction is random) differ by
    more than the overlap and the threshold falls between; of the others a part
    goes both ways, which makes the tree deeper."""
    density = 1 / math.sqrt(2 * math.pi)  # of projections at the median, in units of 1 / sqrt(d)
    tail = math.erfc(SPILL / math.sqrt(2)) / 2
    beyond = 2 * (math.exp(-SPILL * SPILL / 2) * density - SPILL * tail)
    parted = link_distance(cosine) * beyond * density
    child = 0.5 + SPILL / 2 * link_distance(cosine) * density
    depth = max(0.0, math.log(max(n, 1) / LEAF) / -math.log(child))
    met = (1 - parted) ** math.ceil(depth)
    return 1 if met >= 1 else max(3, math.ceil(math.log(1 - RECALL) / math.log(1 - met)))


def direction(tree: int, depth: int, nth: int, d: int):
    import numpy as np
    r = np.random.default_rng([SEED, tree, depth, nth]).normal(size=d)
    return r / np.linalg.norm(r)


def unit(column):
    import numpy as np
    x = matrix(column)
    return x / np.linalg.norm(x, axis=1)[:, None]


def depth_of(node: int) -> int:
    return (node & ((1 << TREE) - 1)).bit_length() - 1


def splits(x, node: int, n: int, cosine: float):
    """Thresholds and direction numbers of the ``LEVELS`` levels below a node of
    ``n`` classes, from the sample ``x``, by place (root 1, children 2p and
    2p + 1). NaN: small enough, or open; infinity: dense."""
    import numpy as np
    size = 1 << LEVELS
    thresholds, tries = np.full(size, np.nan), np.zeros(size, dtype=np.int32)
    tree, spill, scale = node >> TREE, spill_of(cosine, x.shape[1]), n / max(len(x), 1)
    work = [(1, np.arange(len(x)))]
    while work:
        place, rows = work.pop()
        if place >= size or len(rows) * scale <= LEAF or len(rows) < LEAST and place > 1:
            continue
        some = x[rows[:512]]
        i, j = np.nonzero(np.triu(some @ some.T >= cosine, 1))
        best = None
        for nth in range(TRIES):
            p = x[rows] @ direction(tree, depth_of(node) + place.bit_length() - 1, nth, x.shape[1])
            for q in (0.5, 0.35, 0.65):
                t = float(np.quantile(p, q))
                lo, hi = np.minimum(p[i], p[j]), np.maximum(p[i], p[j])
                # a few pairs say little: the share is drawn towards 0.05, what unrelated pairs at the distance lose
                parted = float((((lo < t - spill) & (hi > t + spill)).sum() + 0.05 * FEW) / (len(i) + FEW))
                if max((p <= t + spill).mean(), (p >= t - spill).mean()) > 0.95:
                    parted = 1.0  # no progress
                if best is None or parted < best[0]:
                    best = (parted, nth, t, p)
                if best[0] <= PARTED:
                    break
            if best[0] <= PARTED:
                break
        parted, nth, t, p = best
        if parted > DENSE:
            thresholds[place] = np.inf
            continue
        thresholds[place], tries[place] = t, nth
        work += [(2 * place, rows[p <= t + spill]), (2 * place + 1, rows[p >= t - spill])]
    return thresholds, tries


def fitted(state: DataFrame, open_nodes: dict[int, int], cosine: float) -> dict:
    """Splits of the given nodes (node -> number of classes), each from a sample by hash."""
    sizes = state.sparkSession.createDataFrame(list(open_nodes.items()), "node long, n long")  # OPEN rows at most
    sample = state.select("rep", "embedding", F.explode("leaves").alias("node")).join(F.broadcast(sizes), "node") \
        .where(F.pmod(F.xxhash64("rep", "node"), F.col("n")) < SAMPLE)

    def run(table: pa.Table) -> pa.Table:
        import numpy as np
        table = table.combine_chunks()
        order = np.argsort(table.column("rep").to_numpy(), kind="stable")
        x = unit(table.column("embedding").chunk(0))[order]
        node, n = table.column("node")[0].as_py(), table.column("n")[0].as_py()
        t, k = splits(x, node, n, cosine)
        return pa.table({"node": pa.array([node]), "thresholds": pa.array([t.tolist()]), "tries": pa.array([k.tolist()], pa.list_(pa.int32()))})
    rows = sample.groupBy("node").applyInArrow(run, "node long, thresholds array<double>, tries array<int>").collect()
    return {r["node"]: (r["thresholds"], r["tries"]) for r in rows}


def descended(state: DataFrame, fits: dict, cosine: float) -> DataFrame:
    """``state`` with the leaves that have a fit replaced by those below them."""
    numbers = {node: i for i, node in enumerate(fits)}

    def run(batches):
        import numpy as np
        nodes = np.array(sorted(numbers), dtype=np.int64)
        thresholds = np.array([fits[n][0] for n in nodes])
        tries = np.array([fits[n][1] for n in nodes])
        depths = np.array([depth_of(int(n)) for n in nodes])
        for b in batches:
            x, leaves = unit(b.column("embedding")), b.column("leaves")
            row = np.repeat(np.arange(b.num_rows), np.diff(leaves.offsets.to_numpy()))
            leaf = leaves.flatten().to_numpy()
            at = np.searchsorted(nodes, leaf)
            known = (at < len(nodes)) & (nodes[np.minimum(at, len(nodes) - 1)] == leaf)
            done = [(row[~known], leaf[~known])]
            row, at, place = row[known], at[known], np.ones(known.sum(), dtype=np.int64)
            spill = spill_of(cosine, x.shape[1])
            for level in range(LEVELS + 1):
                t = thresholds[at, np.minimum(place, thresholds.shape[1] - 1)] if level < LEVELS else np.full(len(at), np.nan)
                end = ~np.isfinite(t)
                path = nodes[at[end]] & ((1 << TREE) - 1)
                done.append((row[end], (nodes[at[end]] >> TREE << TREE) | (path << level) | (place[end] - (1 << level))))
                row, at, place, t = row[~end], at[~end], place[~end], t[~end]
                if not len(row):
                    break
                p = np.empty(len(row))
                key = ((nodes[at] >> TREE) * 64 + depths[at] + level) * TRIES + tries[at, place]
                for k in np.unique(key):
                    own = key == k
                    tree, depth, nth = int(k) // TRIES // 64, int(k) // TRIES % 64, int(k) % TRIES
                    p[own] = x[row[own]] @ direction(tree, depth, nth, x.shape[1])
                left, right = p <= t + spill, p >= t - spill
                row, at = np.append(row[left], row[right]), np.append(at[left], at[right])
                place = np.append(2 * place[left], 2 * place[right] + 1)
            row, leaf = (np.concatenate(z) for z in zip(*done))
            order = np.lexsort((leaf, row))
            ends = np.searchsorted(row[order], np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.ListArray.from_arrays(pa.array(ends), pa.array(leaf[order]))],
                                             names=["rep", "embedding", "copies", "leaves"])
    return state.mapInArrow(run, state.schema)


def dense_places(fits: dict) -> set[int]:
    """Numbers of the nodes that a fit found dense."""
    out = set()
    for node, (thresholds, _) in fits.items():
        path = node & ((1 << TREE) - 1)
        for place, t in enumerate(thresholds):
            if t == math.inf:
                level = place.bit_length() - 1
                out.add(node >> TREE << TREE | path << level | place - (1 << level))
    return out


def forest(classes: DataFrame, n: int, cosine: float = COSINE) -> DataFrame:
    """``classes`` (rep, embedding, copies; ``n`` rows) with ``leaves``, the
    numbers of the leaves of all trees that the class stands in, written."""
    trees = trees_for(n, cosine)
    state = classes.select("rep", "embedding", "copies", F.array(*[F.lit((t << TREE) | 1).cast("long") for t in range(trees)]).alias("leaves"))
    open_nodes, dense, old = {(t << TREE) | 1: n for t in range(trees)} if n > LEAF else {}, set(), []
    while open_nodes:
        fits = fitted(state, open_nodes, cosine)
        dense |= dense_places(fits)
        with recording() as made:
            state = written(descended(state, fits, cosine), "forest")
        discard(classes.sparkSession, old)
        old = made
        # a node of a sample too small for a split stays as it is and isn't asked again
        dense |= {node for node, (t, _) in fits.items() if not math.isfinite(t[1])}
        large = state.select(F.explode("leaves").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")) \
            .where(F.col("n") > BLOCK)
        if dense:
            large = large.join(F.broadcast(state.sparkSession.createDataFrame([(x,) for x in dense], "node long")), "node", "left_anti")
        open_nodes = {r["node"]: r["n"] for r in large.orderBy(F.col("n").desc(), "node").limit(OPEN).collect()}
    return state


def spanning(linked):
    """Pairs (parent, child) of a spanning forest of a symmetric boolean matrix."""
    import numpy as np
    left, out = np.ones(len(linked), dtype=bool), []
    for start in range(len(linked)):
        if not left[start]:
            continue
        left[start], front = False, [start]
        while front:
            i = front.pop()
            j = np.flatnonzero(linked[i] & left)
            left[j] = False
            out += [(i, int(x)) for x in j]
            front += j.tolist()
    return out


def compared(state: DataFrame, cosine: float) -> DataFrame:
    """(a, b, links): for a class its links found in a leaf (b null), and the
    forest of the leaf's links (links 0)."""
    leaf = F.explode("leaves").alias("leaf")
    crowded = written(state.select(leaf).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
                      .select("leaf", F.ceil(F.col("n") / (BLOCK // 2)).cast("int").alias("blocks")), "crowded-leaves")
    dealt = state.select("*", leaf).join(crowded, "leaf", "left")
    mine = F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1))).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1),
                        lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    dealt = dealt.select("leaf", "rep", "embedding", "copies", "leaves", mine.alias("block"), F.explode(pairs).alias("pair")) \
        .select("leaf", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "block", "rep", "embedding", "copies", "leaves")

    def run(table: pa.Table) -> pa.Table:
        import numpy as np
        table = table.combine_chunks().sort_by("rep")
        here = table.column("leaf")[0].as_py()
        rep, copies, block = (table.column(c).to_numpy() for c in ("rep", "copies", "block"))
        x = matrix(table.column("embedding").combine_chunks())
        norm = np.linalg.norm(x, axis=1)
        across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        first = block == table.column("i")[0].as_py() if across else np.ones(len(rep), dtype=bool)
        second = ~first if across else first
        linked = np.zeros((len(rep), len(rep)), dtype=bool)
        linked[np.ix_(first, second)] = x[first] @ x[second].T / (norm[first][:, None] * norm[second][None, :]) >= cosine
        linked |= linked.T
        np.fill_diagonal(linked, False)
        some = np.flatnonzero(linked.any(axis=1))
        linked = linked[np.ix_(some, some)]
        # pairs with a common leaf before this one count there
        leaves = table.column("leaves").combine_chunks().take(pa.array(some))
        row, other = np.repeat(np.arange(len(some)), np.diff(leaves.offsets.to_numpy())), leaves.flatten().to_numpy()
        row, other = row[other < here], other[other < here]
        names, at, times = np.unique(other, return_inverse=True, return_counts=True)
        stands = np.zeros((len(some), len(names)), dtype=np.float32)
        stands[row, at] = 1
        stands = stands[:, times > 1]
        linked &= stands @ stands.T == 0
        n = (linked * copies[some][None, :]).sum(axis=1)
        tree = spanning(linked)
        rep = rep[some]
        a = np.concatenate([rep[n > 0], rep[[i for i, _ in tree]]]) if len(some) else rep
        b = pa.array([*[None] * int((n > 0).sum()), *(int(rep[j]) for _, j in tree)], pa.int64())
        links = np.concatenate([n[n > 0], np.zeros(len(tree), dtype=np.int64)])
        return pa.table({"a": pa.array(a, pa.int64()), "b": b, "links": pa.array(links, pa.int64())})
    return dealt.groupBy("leaf", "i", "j").applyInArrow(run, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for every row of ``vectors``."""
    spark, inf = vectors.sparkSession, F.lit(float("inf"))
    # numbered as written: later reads see the same numbers
    given = written(vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(embedding_type(vectors, embedding)).alias("embedding"),
        F.monotonically_increasing_id().alias("row")), "vectors")
    usable = given.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
                         & F.exists("embedding", lambda x: x != 0))
    sizes = usable.groupBy(F.size("embedding").alias("d")).count().orderBy(F.col("count").desc(), F.col("d")).first()
    usable = usable.where(F.size("embedding") == (sizes["d"] if sizes else 0))
    with recording() as made:
        # equal vectors are combined before the shuffle: a group of copies costs a row a task
        classes = written(usable.groupBy("embedding").agg(
            F.min("row").alias("rep"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")), "classes")
        n = classes.count()
        found = written(compared(forest(classes, n, cosine), cosine), "leaf-links")
        label = components(found.where("b is not null"), "a", "b").select(F.col("node").alias("rep"), "label")
        links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
        rooted = written(classes.join(label, "rep", "left").join(links, "rep", "left").select(
            "embedding", "rep", "least", F.coalesce("label", "rep").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "rooted")
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        members = written(rooted.join(least, "root").select(
            F.col("embedding").alias("vector"), "n_links", "component_id"), "members")
    discard(spark, made[:-1])
    at = usable.join(members, F.col("embedding") == F.col("vector")).select("row", "n_links", "component_id", F.lit(True).alias("linked"))
    return given.select("row", "vec_id").join(at, "row", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")) \
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
