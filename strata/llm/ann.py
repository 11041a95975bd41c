"""Approximate nearest neighbours by inner product: probed lists and an adaptive
dimension scan.

Inner products become distances: with M the greatest norm, a vector x gets one
more component sqrt(M^2 - |x|^2), a query a zero, and the nearest in distance
have the largest products. Centroids come from k-means over a bounded sample
(``SAMPLE``); every vector is indexed in the list of its nearest centroid.

In a list, vectors are rotated at random and read in column blocks of
``COLUMNS``. After each block a hypothesis test compares the scaled partial
distance with the k-th best distance so far: for a rotated vector, the partial
distance over d of D dimensions, times D/d, exceeds the full one by a factor of
more than (1 + EPSILON / sqrt(d))^2 with small probability only, so a candidate
beyond that is abandoned. What is left is compared by the exact product of the
original vectors in double precision.

A query first probes its nearest lists (``FIRST``), which bounds the k-th best
product; the other probed lists only return what reaches that bound. ``SHARE`` of
all lists is probed: vectors without clusters, whose neighbours lie anywhere,
need that much for a recall of 0.9. Lists are cut into chunks of ``CHUNK`` vectors and their queries into chunks of
``QUERIES``, so no task holds an unbounded list.

Cases: vectors that are null, zero or hold null or non-finite components, and
those without an id or of another dimension than most, take no part. Of rows
with one id the least vector counts. Ties go to the smaller id. An empty table
gives an empty result. Extra columns aren't read, whatever their names.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SAMPLE, ROUNDS, SEED = 8192, 12, 11
LIST_ROWS, MIN_LISTS, MAX_LISTS = 512, 32, 1024
SHARE, FIRST = 0.75, 2
COLUMNS, EPSILON = 16, 2.1
CHUNK, QUERIES, TILE = 2048, 2048, 512
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the vectors that take part; floats stay floats
    until they are multiplied, other numbers become doubles."""
    inf = F.lit(float("inf"))
    kind = embedding_type(vectors, embedding)
    got = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("embedding"))
    got = got.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
                    & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
                    & F.exists("embedding", lambda x: x != 0))
    got = written(got.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    sizes = got.groupBy(F.size("embedding").alias("d")).count().orderBy(F.col("count").desc(), F.col("d")).first()
    return got.where(F.size("embedding") == (sizes["d"] if sizes else 0))


def embedding_type(df: DataFrame, embedding: str = "embedding") -> str:
    return "array<float>" if df.schema[embedding].dataType.elementType.typeName() == "float" else "array<double>"


def rotation(d: int):
    """A random orthogonal matrix, the same for every task."""
    import numpy as np
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.ListArray):
    import numpy as np
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def lifted(x, norm2: float, query: bool = False):
    """Vectors with the component that turns products into distances."""
    import numpy as np
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(norm2 - (x * x).sum(axis=1), 0.0))
    return np.concatenate([x, last[:, None]], axis=1)


def distances(x, y):
    """Squared distances of all rows of x (a block) and y (the centroids)."""
    import numpy as np
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0.0)


def centroids(x, lists: int):
    """k-means over the sample; an empty list restarts at the farthest vector."""
    import numpy as np
    rng = np.random.default_rng(SEED)
    c = x[rng.permutation(len(x))[:lists]].copy()
    for _ in range(ROUNDS):
        d = distances(x, c)
        near = d.argmin(axis=1)
        far = np.argsort(-d[np.arange(len(x)), near], kind="stable")
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        empty = np.flatnonzero(size == 0)
        c[empty] = x[far[:len(empty)]]
    return c


def probes(vectors: DataFrame, c, norm2: float, count: int, query: bool) -> DataFrame:
    """(vec_id, embedding, list, nth): the ``count`` nearest lists of each vector, nearest first."""
    def run(batches):
        import numpy as np
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                d = distances(lifted(matrix(part.column(1)), norm2, query), c)
                near = np.argsort(d, axis=1, kind="stable")[:, :count]
                i = np.repeat(np.arange(len(d)), near.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i)),
                     pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(near.shape[1], dtype=np.int32), len(d)))],
                    names=["vec_id", "embedding", "list", "nth"])
    return vectors.mapInArrow(run, f"vec_id long, embedding {embedding_type(vectors)}, list int, nth int")


def scan(queries, query_ids, bounds, vectors, vec_ids, norm2: float, k: int):
    """The k best of a chunk for each query, as (query row, vector row, product);
    ``bounds`` are products that a result has to reach."""
    import numpy as np
    dims = queries.shape[1] + 1
    turn = rotation(dims)
    q, x = lifted(queries, norm2, True) @ turn, lifted(vectors, norm2) @ turn
    blocks = [(s, min(s + COLUMNS, dims)) for s in range(0, dims, COLUMNS)]
    norms = (queries * queries).sum(axis=1) + norm2
    limit = np.where(np.isfinite(bounds), np.maximum(norms - 2 * bounds, 0.0), np.inf)  # squared distance of the bound
    rows, cols, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for start in range(0, len(x), TILE):
        tile = x[start:start + TILE]
        s, e = blocks[0]
        first = distances(q[:, s:e], tile[:, s:e])
        keep = first * (dims / e) <= (limit * (1 + EPSILON / math.sqrt(e)) ** 2 * (1 + 1e-9) + 1e-12)[:, None]
        i, j = np.nonzero(keep)
        part = first[i, j]
        for s, e in blocks[1:]:
            for at in range(0, len(i), 1 << 16):
                a, b = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
                part[at:at + (1 << 16)] += ((q[a, s:e] - tile[b, s:e]) ** 2).sum(axis=1)
            slack = (1 + EPSILON / math.sqrt(e)) ** 2 if e < dims else 1.0
            ok = part * (dims / e) <= limit[i] * slack * (1 + 1e-9) + 1e-9
            i, j, part = i[ok], j[ok], part[ok]
        exact = np.zeros(len(i))
        for at in range(0, len(i), 1 << 16):
            a, b = i[at:at + (1 << 16)], j[at:at + (1 << 16)] + start
            exact[at:at + (1 << 16)] = (queries[a] * vectors[b]).sum(axis=1)
        j = j + start
        ok = (query_ids[i] != vec_ids[j]) & (exact >= bounds[i])
        rows, cols, scores = np.append(rows, i[ok]), np.append(cols, j[ok]), np.append(scores, exact[ok])
        order = np.lexsort((vec_ids[cols], -scores, rows))
        rows, cols, scores = rows[order], cols[order], scores[order]
        begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else rows
        rank = np.arange(len(rows)) - np.repeat(begin, np.diff(np.append(begin, len(rows))))
        rows, cols, scores, rank = (z[rank < k] for z in (rows, cols, scores, rank))
        full = rank == k - 1  # queries with k results: the last bounds the rest
        limit[rows[full]] = np.minimum(limit[rows[full]], np.maximum(norms[rows[full]] - 2 * scores[full], 0.0))
    return rows, cols, scores


def search(index: DataFrame, asked: DataFrame, sizes: DataFrame, norm2: float, k: int) -> DataFrame:
    """(query_id, vec_id, score) within the lists that ``asked`` (query_id,
    embedding, list, bound) names. A group is one chunk of a list with one
    chunk of its queries."""
    load = written(asked.groupBy("list").agg(F.count(F.lit(1)).alias("q")).join(sizes, "list")
                   .select("list", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts"),
                           F.ceil(F.col("q") / QUERIES).cast("int").alias("turns")), "load")  # a row a list, MAX_LISTS at most

    def all_of(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def one_of(n):
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    stored = index.select("list", F.col("vec_id").alias("id"), "embedding", F.lit(None).cast("double").alias("bound")) \
        .join(F.broadcast(load), "list").withColumn("part", one_of("parts")).withColumn("turn", all_of("turns"))
    put = asked.select("list", F.col("query_id").alias("id"), "embedding", "bound") \
        .join(F.broadcast(load), "list").withColumn("turn", one_of("turns")).withColumn("part", all_of("parts"))
    cols = ["list", "part", "turn", "id", "embedding", "bound"]
    both = stored.select(*cols, F.lit(False).alias("asks")).unionByName(put.select(*cols, F.lit(True).alias("asks")))

    def run(table: pa.Table) -> pa.Table:
        import numpy as np
        table = table.combine_chunks()
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        ids = table.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
        bound = table.column("bound").to_numpy(zero_copy_only=False)
        x = matrix(table.column("embedding").chunk(0)) if len(ids) else np.zeros((0, 1))
        if not asks.any() or asks.all():
            i, j, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            i, j, score = scan(x[asks], ids[asks], bound[asks], x[~asks], ids[~asks], norm2, k)
        return pa.table({"query_id": pa.array(ids[asks][i]), "vec_id": pa.array(ids[~asks][j]), "score": pa.array(score)})
    return both.groupBy("list", "part", "turn").applyInArrow(run, FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest products with each of
    ``queries`` (rows of ``vectors``), which are written tables of (vec_id,
    embedding); a vector is no neighbour of its own id."""
    spark = vectors.sparkSession
    top = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate(
        F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)).alias("norm2")).first()
    if not top["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    import numpy as np
    sample = np.array([r["embedding"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
                       .select("embedding").collect()])
    norm2 = float(top["norm2"]) * (1 + 1e-12)
    c = centroids(lifted(sample, norm2), min(max(top["n"] // LIST_ROWS, MIN_LISTS), MAX_LISTS, len(sample)))
    count = max(FIRST, math.ceil(SHARE * len(c)))

    index = written(probes(vectors, c, norm2, 1, False), "index")
    sizes = index.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    asked = written(probes(queries, c, norm2, count, True).withColumnRenamed("vec_id", "query_id"), "probes")
    start = written(search(index, asked.where(F.col("nth") < FIRST).withColumn("bound", F.lit(float("-inf"))),
                           sizes, norm2, k), "first")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    bounds = start.withColumn("rank", rank).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    later = asked.where(F.col("nth") >= FIRST).join(bounds, "query_id", "left") \
        .withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    found = start.unionByName(search(index, written(later, "later"), sizes, norm2, k))
    if count < len(c):
        # queries with fewer than k results in their probed lists go on with all others
        found = written(found, "found")
        done = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id")
        short = queries.join(done, queries["vec_id"] == done["query_id"], "left_anti")
        rest = probes(short, c, norm2, len(c), True).withColumnRenamed("vec_id", "query_id").where(F.col("nth") >= count) \
            .withColumn("bound", F.lit(float("-inf")))
        found = found.unionByName(search(index, written(rest, "rest"), sizes, norm2, k))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
