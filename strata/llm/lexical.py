"""Ranked lexical search by a document FP-tree.

Only terms of the items matter, so a document becomes its vector of these: the
terms in the order of their document frequency, the commonest first, with their
counts. Vectors of a chunk of documents are put into a prefix tree, in which
documents with the same first terms share a path (single-child paths are one
node). A node knows the greatest count of every term and the least length ratio
``m`` among the documents below it. A term's gain grows with its count and falls
with ``m``, so the item's score over these extremes bounds every document below.

Per item the tree is searched depth first, the best bound first; a branch whose
bound is below the item's k-th best score so far is left out. What a task has
found goes on as the bound of its next chunks. Each task returns the best of
every item, and a window ranks those of all tasks.

Document counts, total length and frequencies are taken over all documents
first, while the restricted vectors are written. Items come in blocks of about
``ITEM_BYTES`` of text; a block's terms and weights go to the tasks. A chunk has
at most ``CHUNK`` documents and about ``ENTRIES`` counts.

Cases: null texts have no terms; documents and items without terms take no part.
Rows with one doc_id are documents of their own; a null doc_id comes after all
others among equal scores. Items equal in id and text count once; items with one
id and different texts are searched separately. Very long texts are read whole.
An empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CHUNK, ENTRIES = 4096, 400_000
ITEM_BYTES = 4 * 1024 * 1024
SCORES = "item int, item_id long, doc_id long, score long"
#: Bytes that end a term become spaces, A-Z become lower case; UTF-8 beyond ASCII stays.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32
             for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def restricted(docs: DataFrame, known: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts) of the documents that have a term at all."""
    def run(batches):
        from collections import Counter
        for b in batches:
            ids, ns, terms, counts, ends = [], [], [], [], [0]
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                words = terms_of(t)
                if not words:
                    continue
                got = Counter(map(known.get, words))
                got.pop(None, None)
                ids.append(i)
                ns.append(len(words))
                terms += got.keys()
                counts += got.values()
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))], names=["doc_id", "n", "terms", "counts"])
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(
        run, "doc_id long, n long, terms array<int>, counts array<long>")


def gain(weight: int, tf: int, m: int) -> int:
    """What ``tf`` occurrences add to the score of a document with ratio ``m``."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def tree(docs: list[tuple[list[int], list[int], int, int]]):
    """Root of the tree over (ranks of the terms, ascending; counts; m; id).

    A node is (maxima, m, children, id): counts by rank, least ratio, child
    nodes (None at a document), and the id at a document."""
    docs = sorted(docs, key=lambda d: d[0])
    leaf = [(dict(zip(d[0], d[1])), d[2], None, d[3]) for d in docs]
    root = ({}, 0, [], None)
    inner, work = [], [(0, len(docs), 0, root)]
    while work:
        lo, hi, depth, node = work.pop()
        inner.append(node)
        first, last = docs[lo][0], docs[hi - 1][0]
        # sorted, so what the first and the last share all share
        while depth < len(first) and depth < len(last) and first[depth] == last[depth]:
            depth += 1
        while lo < hi and len(docs[lo][0]) == depth:  # its vector ends here
            node[2].append(leaf[lo])
            lo += 1
        while lo < hi:
            end, rank = lo + 1, docs[lo][0][depth]
            while end < hi and docs[end][0][depth] == rank:
                end += 1
            if end - lo == 1:
                node[2].append(leaf[lo])
            else:
                child = ({}, 0, [], None)
                node[2].append(child)
                work.append((lo, end, depth + 1, child))
            lo = end
    # parents stand before their children
    done: dict[int, tuple] = {}
    for node in reversed(inner):
        maxima, kids = node[0], [done.get(id(c), c) for c in node[2]]
        for c in kids:
            for t, tf in c[0].items():
                if tf > maxima.get(t, 0):
                    maxima[t] = tf
        done[id(node)] = (maxima, min(c[1] for c in kids), kids, None)
    return done[id(root)]


def visit(root, item: list[tuple[int, int]], best: list[tuple[int, int]], k: int) -> None:
    """Put the documents below ``root`` that are among the ``k`` best of ``item``
    (rank, weight) into the heap ``best`` of (score, -id)."""
    def bound(node) -> int:
        # the sum of ``gain`` over the item's terms below, written out as it is the inner loop
        have, m, total = node[0].get, 8 * node[1], 0
        for t, w in item:
            tf = have(t)
            if tf:
                total += w * (1_000_000_000 * tf // (1000 * tf + m))
        return total

    work = [(bound(root), root)]
    while work:
        score, node = work.pop()
        if score <= 0 or len(best) == k and score < best[0][0]:
            continue
        if node[2] is None:  # a document: its bound is its score
            (heapq.heappush if len(best) < k else heapq.heappushpop)(best, (score, -node[3]))
        else:
            kids = [(bound(c), c) for c in node[2]]
            kids.sort(key=lambda x: x[0])  # the best is popped first
            work += kids


def search(vectors: DataFrame, ids: list[int], items: list[list[tuple[int, int]]], rank: list[int], n_docs: int,
           length: int, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): each task's ``k`` best of every item, given as (rank, weight)."""
    null = (1 << 63) - 1  # sorts after every id; no row has it as its id and a null beside it

    def run(batches):
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        chunk, entries = [], 0

        def searched():
            root = tree(chunk)
            for item, heap in zip(items, best):
                visit(root, item, heap, k)

        for b in batches:
            for i, n, terms, counts in zip(*(b.column(c).to_pylist() for c in range(4))):
                if not terms:
                    continue
                pair = sorted((rank[t], tf) for t, tf in zip(terms, counts))
                m = 25 + (75 * n * n_docs) // length
                chunk.append(([t for t, _ in pair], [tf for _, tf in pair], m, null if i is None else i))
                entries += len(pair)
                if len(chunk) == CHUNK or entries >= ENTRIES:
                    searched()
                    chunk, entries = [], 0
        if chunk:
            searched()
        rows = [(i, ids[i], None if -d == null else -d, s) for i, heap in enumerate(best) for s, d in heap]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)],
                                         names=["item", "item_id", "doc_id", "score"])
    return vectors.mapInArrow(run, SCORES)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / ITEM_BYTES))
    out = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        found = ranked_block(docs, [(r["item_id"], r["text"].encode()) for r in own], k, doc_id, text)
        out = found if out is None else out.unionByName(found)
    return out


def ranked_block(docs: DataFrame, items: list[tuple[int, bytes]], k: int, doc_id: str, text: str) -> DataFrame:
    from collections import Counter
    counted = [Counter(terms_of(t)) for _, t in items]
    known = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
    vectors = written(restricted(docs, known, doc_id, text), "vectors")
    total = vectors.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("length")).first()
    df = [0] * len(known)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
        df[r["t"]] = r["df"]  # a row a term of the items
    n = total["docs"]
    weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df]
    rank = [0] * len(known)
    for place, t in enumerate(sorted(range(len(known)), key=lambda t: (-df[t], t))):
        rank[t] = place
    wanted = [[(rank[known[t]], times * weight[known[t]]) for t, times in c.items() if df[known[t]] and weight[known[t]] > 0]
              for c in counted]
    found = search(vectors, [i for i, _ in items], wanted, rank, n, total["length"] or 1, k)
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score")
