"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine.

Terms are words in lower case without punctuation, and their first four and
five letters (so that inflected forms meet). All terms of the labelled sample
are indexed. A term's weight is its idf times ``EVEN`` plus the squared phi
coefficient of term and label over the sample, less what chance gives: the
cosine is exact over all terms, and those that go with a class count most.

The examples lie in an inverted index in blocks of ``BLOCK``. Terms that more
than one in ``DENSE`` examples has are columns of a dense matrix, whose part of
the cosine is one product for a batch of documents; the others are postings by
term and block. The greatest weight of a term in a block bounds what the block
can add. The k-th best dense part bounds the k-th best cosine, and every block
that reaches it is read, so the neighbours are exact.
Votes weigh ``1 / (0.05 + distance)``; the prior joins them with a weight of its
own, which is all that a document without any known term gets. A logistic curve,
fitted on rows apart, turns the vote into a probability.

The sample is bounded in rows (``PER_CLASS``, ``CALIBRATION``); what the tasks get
of it (terms, postings) is as large as these rows' texts. idf and phi are of the
sample, as part of the fit. Every document is scored on its whole text.

Cases: a null text counts as empty, and gets the score of the prior. Ties in
cosine go to the smaller id. Repeated rows are scored each; repeated ids count
once in the fit. Very long texts are read whole. An empty table gives an empty
result. Only the text travels, so other columns may have any name. Without
labels of both classes the score is the share of label 1 (0 without labels).
"""

from __future__ import annotations

import pickle
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import process_cache
from .sampling import labelled_sample

PER_CLASS = {0: 3000, 1: 1500}
CALIBRATION = 3000
EVEN = 0.01
NEAREST, BLOCK, DENSE, PRIOR_WEIGHT = 15, 256, 16, 2.0
BATCH = 512
MAX_WORDS = 300_000
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»…–—"


def terms_of(word: str) -> list[str]:
    """The terms of a word: itself and its beginnings."""
    w = word.strip(MARKS).lower()
    if not w:
        return []
    return ["=" + w, *(f"{k}{w[:k]}" for k in (4, 5) if len(w) > k - 1)]


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, n, positive): in how many documents, and in how many of label 1."""
    def run(batches):
        for b in batches:
            terms, ys = [], []
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = {x for w in set(t.split()) for x in terms_of(w)}
                terms += own
                ys += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(ys, pa.int32())], names=["term", "y"])
    return sample.select("text", "y").mapInArrow(run, "term string, y int").groupBy("term").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("positive"))


def vocabulary(sample: DataFrame, total: int, positive: int):
    """(term -> number, weight by number) of all terms of the sample, a bounded number of rows."""
    import numpy as np
    rows = term_counts(sample).toArrow().sort_by("term")
    n, a = (rows.column(c).to_numpy().astype(np.float64) for c in ("n", "positive"))
    spread = n * (total - n) * positive * (total - positive)
    phi2 = np.divide((a * total - n * positive) ** 2, spread, out=np.zeros(len(n)), where=spread > 0)
    weight = np.log(1 + total / n) * (EVEN + np.maximum(0.0, phi2 - 1 / max(total - 1, 1)))
    return {t: i for i, t in enumerate(rows.column("term").to_pylist())}, weight


def as_arrays(vector):
    """(terms, weights) of a sparse vector, which may be a dict as well."""
    import numpy as np
    if isinstance(vector, dict):
        return np.fromiter(vector, np.int64, len(vector)), np.fromiter(vector.values(), np.float64, len(vector))
    return vector


class Index:
    """Block-max inverted index of sparse unit vectors."""

    def __init__(self, vectors: list, labels: list[int], ids: list[int], terms: int):
        import numpy as np
        vectors = [as_arrays(v) for v in vectors]
        # examples with the same strongest term share blocks, which keeps the bounds low
        order = sorted(range(len(ids)), key=lambda i: (int(vectors[i][0][vectors[i][1] == vectors[i][1].max()].min()), ids[i]))
        self.ids = np.array([ids[i] for i in order], dtype=np.int64)
        self.labels = np.array([labels[i] for i in order], dtype=np.float64)
        self.blocks = -(-len(order) // BLOCK)
        term = np.concatenate([np.zeros(0, np.int32), *(vectors[i][0].astype(np.int32) for i in order)])
        weight = np.concatenate([np.zeros(0), *(vectors[i][1] for i in order)])
        row = np.repeat(np.arange(len(order), dtype=np.int32), [len(vectors[i][0]) for i in order])
        often = np.bincount(term, minlength=terms) * DENSE > len(order)
        self.column = np.where(often, np.cumsum(often) - 1, -1)  # of the dense matrix, by term
        self.dense = np.zeros((int(often.sum()), self.blocks * BLOCK))
        here = often[term]
        self.dense[self.column[term[here]], row[here]] = weight[here]
        # postings by (term, row); a run of one term and block is an entry of its block list
        term, row, weight = term[~here], row[~here], weight[~here]
        by = np.lexsort((row, term))
        term, self.row, self.weight = term[by], row[by], weight[by]
        block = self.row // BLOCK
        new = np.ones(len(term), dtype=bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        start = np.flatnonzero(new)
        self.first = np.append(start, len(term))
        self.block = block[start]
        self.top = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.lists = np.searchsorted(term[start], np.arange(terms + 1))

    def nearest(self, query, k: int):
        """(rows, cosines) of the k examples of greatest cosine above 0; ties to smaller ids."""
        return self.nearest_of([query], k)[0]

    def nearest_of(self, queries: list, k: int):
        """``nearest`` for a batch of queries."""
        import numpy as np
        terms, weights = zip(*map(as_arrays, queries))
        q = np.zeros((len(queries), len(self.dense)))
        for i, (t, w) in enumerate(zip(terms, weights)):
            c = self.column[t]
            q[i, c[c >= 0]] = w[c >= 0]
        return [self._nearest(t[self.column[t] < 0], w[self.column[t] < 0], dense, k)
                for t, w, dense in zip(terms, weights, q @ self.dense)]

    def _nearest(self, terms, weights, scores, k: int):
        """``scores`` is the dense part of the cosine with every row."""
        import numpy as np
        entry, weight = spread(self.lists[terms], self.lists[terms + 1], weights)
        block = self.block[entry]
        add = np.bincount(block, weights=weight * self.top[entry], minlength=self.blocks)
        bound = scores.reshape(-1, BLOCK).max(axis=1, initial=0.0) + add + 1e-12

        # the dense part bounds every cosine from below, so its k-th best bounds the k-th best cosine
        least = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else 0.0
        use = bound >= least - 1e-12
        if use.all():  # the postings of a term are one range over all blocks
            at, w = spread(self.first[self.lists[terms]], self.first[self.lists[terms + 1]], weights)
        else:
            own = np.flatnonzero(use[block])
            at, w = spread(self.first[entry[own]], self.first[entry[own] + 1], weight[own])
        scores = scores + np.bincount(self.row[at], weights=w * self.weight[at], minlength=len(scores))
        done = np.repeat(use, BLOCK)
        rows = np.flatnonzero(done & (scores > 0))
        rows = rows[rows < len(self.ids)]
        if len(rows) > k:  # all at the k-th cosine stay, as the ids decide
            cut = np.partition(scores[rows], len(rows) - k)[len(rows) - k]
            rows = rows[scores[rows] >= cut - 1e-11]
        rows = rows[np.lexsort((self.ids[rows], -np.round(scores[rows], 12)))[:k]]
        return rows, scores[rows]


def spread(start, end, values):
    """All numbers from start to end of each range, and the range's value with each."""
    import numpy as np
    n = end - start
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return at, np.repeat(values, n)


class Words:
    """The known terms of words, remembered by word: a row of ``numbers`` holds the
    numbers of the word and of its beginnings (see ``terms_of``), ``unknown`` for none."""

    def __init__(self, known: dict[str, int]):
        import numpy as np
        kinds: dict[str, dict[str, int]] = {"=": {}, "4": {}, "5": {}}
        for t, i in known.items():
            kinds[t[0]][t[1:]] = i
        self.whole, self.four, self.five = kinds["="], kinds["4"], kinds["5"]
        self.unknown = len(known)
        self.place: dict[str, int] = {}
        self.numbers = np.empty((1024, 3), dtype=np.int64)

    def learn(self, new) -> None:
        """Give the words, which aren't remembered, a row each."""
        import numpy as np
        whole, four, five, none, found = self.whole.get, self.four.get, self.five.get, self.unknown, []
        for word in new:
            w = word.strip(MARKS).lower()
            n = len(w)
            # a word of fewer than four or five letters has no such beginning
            found += (whole(w, none), four(w[:4], none) if n > 3 else none, five(w[:5], none) if n > 4 else none)
        start, end = len(self.place), len(self.place) + len(new)
        self.place.update(zip(new, range(start, end)))
        if end > len(self.numbers):
            more = max(end, 2 * len(self.numbers)) - len(self.numbers)
            self.numbers = np.concatenate([self.numbers, np.empty((more, 3), dtype=np.int64)])
        self.numbers[start:end] = np.array(found, dtype=np.int64).reshape(-1, 3)

    def of(self, words):
        """A row of three numbers for each of the words, the keys of a dict."""
        import numpy as np
        if len(self.place) > MAX_WORDS:
            self.place.clear()
        place = self.place
        if new := [w for w in words if w not in place]:
            self.learn(new)
        return self.numbers[np.fromiter(map(place.__getitem__, words), np.int64, len(words))]


def counted(text: str | None, words: Words):
    """(terms, counts) of a whole text, by number of the term."""
    from collections import Counter

    import numpy as np
    own = Counter((text or "").split())
    terms = words.of(own).ravel()
    counts = np.repeat(np.fromiter(own.values(), np.int64, len(own)), 3)
    known = np.flatnonzero(terms < words.unknown)
    known = known[np.argsort(terms[known])]
    terms = terms[known]
    if not len(terms):
        return terms, terms
    first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
    return terms[first], np.add.reduceat(counts[known], first)


def unit(terms, counts, weight):
    """Unit TF-IDF vector (terms, weights); empty if no term occurs."""
    import numpy as np
    out = (1 + np.log(counts)) * weight[terms]
    return terms, out / np.sqrt((out * out).sum())


def vector(text: str | None, words: Words, weight):
    return unit(*counted(text, words), weight)


def votes(model: dict, queries: list):
    """(weighted share of label 1, rows of the neighbours) of each query."""
    import numpy as np
    out = []
    for at in range(0, len(queries), BATCH):
        for rows, cosines in model["index"].nearest_of(queries[at:at + BATCH], NEAREST):
            w = 1 / (0.05 + np.maximum(0.0, 1 - cosines))
            out.append((float((w @ model["index"].labels[rows] + PRIOR_WEIGHT * model["prior"]) / (w.sum() + PRIOR_WEIGHT)), rows))
    return out


def logistic(v, y) -> tuple[float, float]:
    """Slope and intercept of a logistic curve over the vote's log-odds, by
    damped Newton steps with a slight pull towards (1, 0)."""
    import numpy as np
    x = np.log(v / (1 - v))
    beta, pull = np.array([1.0, 0.0]), np.array([0.05, 0.05])
    a = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -40, 40)))
        grad = a.T @ (p - y) + pull * (beta - [1.0, 0.0])
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        beta = beta - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text") -> dict:
    """Terms, weights, examples, prior and calibration curve (see ``loaded``), or a constant."""
    import numpy as np
    sample = labelled_sample(docs, labels, label, PER_CLASS, CALIBRATION, text)
    fits = {r["y"]: r["count"] for r in sample.where("part = 'fit'").groupBy("y").count().collect()}
    total = sum(fits.values())
    if len(fits) < 2:
        return {"constant": fits.get(1, 0) / total if total else 0.0}
    known, weight = vocabulary(sample.where("part = 'fit'"), total, fits[1])

    def run(batches):
        words = Words(known)
        for b in batches:
            v = [counted(t, words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), b.column("y"), b.column("part"),
                 *(pa.array([x[i].astype("<i4").tobytes() for x in v], pa.binary()) for i in (0, 1))],
                names=["doc_id", "y", "part", "terms", "counts"])
    # at most sum(PER_CLASS) + CALIBRATION rows, as long as their texts
    rows = sample.mapInArrow(run, "doc_id long, y int, part string, terms binary, counts binary").toArrow().sort_by("doc_id").to_pylist()
    examples = [(r["doc_id"], r["y"], r["terms"], r["counts"]) for r in rows if r["part"] == "fit" and r["terms"]]
    model = loaded({"terms": "\n".join(known), "weight": weight, "prior": fits[1] / total, "examples": examples, "curve": (1.0, 0.0)})
    apart = [r for r in rows if r["part"] == "calibrate"]
    v = np.array([x for x, _ in votes(model, [unit(np.frombuffer(r["terms"], "<i4"), np.frombuffer(r["counts"], "<i4"), weight) for r in apart])])
    y = np.array([r["y"] for r in apart], dtype=float)
    return model["packed"] | {"curve": logistic(np.clip(v, 1e-6, 1 - 1e-6), y) if len(y) else (1.0, 0.0)}


def loaded(packed: dict) -> dict:
    """What votes need, from what is sent: terms and counts of the examples, the
    weights of the terms. The index is built where it is used."""
    import numpy as np
    vectors = [unit(np.frombuffer(t, "<i4"), np.frombuffer(n, "<i4"), packed["weight"]) for _, _, t, n in packed["examples"]]
    index = Index(vectors, [x[1] for x in packed["examples"]], [x[0] for x in packed["examples"]], len(packed["weight"]))
    words = Words({t: i for i, t in enumerate(packed["terms"].split("\n"))})
    return {"words": words, "weight": packed["weight"], "index": index, "prior": packed["prior"], "curve": packed["curve"], "packed": packed}


def score(text: Column, model: dict) -> Column:
    """(score, evidence): probability of label 1, ids of the nearest examples, nearest first."""
    kind = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.int64()))])
    # a task gets a few MB, and a worker makes the index of them once
    packed, name = zlib.compress(pickle.dumps(model, protocol=5), 6), uuid.uuid4().hex

    def run(col: pa.Array) -> pa.Array:
        import math
        cache = process_cache("toxicity")
        if cache.get("toxicity of") != name:
            sent = pickle.loads(zlib.decompress(packed))
            cache["toxicity of"], cache["toxicity model"] = name, sent if "constant" in sent else loaded(sent)
        own = cache["toxicity model"]
        if "constant" in own:
            return pa.array([{"score": own["constant"], "evidence": []}] * len(col), kind)
        slope, shift = own["curve"]
        out = []
        for at in range(0, len(col), BATCH):
            for v, rows in votes(own, [vector(t, own["words"], own["weight"]) for t in col[at:at + BATCH].to_pylist()]):
                v = min(max(v, 1e-6), 1 - 1e-6)
                z = slope * math.log(v / (1 - v)) + shift
                out.append({"score": 1 / (1 + math.exp(-min(max(z, -40.0), 40.0))), "evidence": own["index"].ids[rows].tolist()})
        return pa.array(out, kind)
    return arrow_udf(run, returnType="struct<score:double,evidence:array<long>>")(text)
