"""Quality classifier: random-indexing word vectors and a two-layer network.

A word is reduced to two features: its letters in lower case, and its shape
(case, punctuation around it, digits; whether it repeats the word before, or
stands in a line that occurred before). Features are hashed to ``BUCKETS``.
Random indexing gives each bucket a fixed sparse vector of a few +1 and -1;
the context vector of a bucket is the sum of the index vectors of its
neighbours within two words, over the sample. A bucket's vector is the
normalised sum of both. A document is the mean of its letter vectors, the mean
of its shape vectors and a few ratios. A network with one hidden layer is
trained by Adam; a temperature, fitted on rows apart, scales its logits.

The fit reads a bounded sample of labelled rows (``PER_CLASS``, ``CALIBRATION``);
every document is scored on its whole text.

Cases: a null text counts as empty and has a score like any other. Without
labels of both classes the score is the share of label 1 (0.5 without labels).
Repeated rows get equal scores. Very long texts are pooled in blocks, whole. An
empty table gives an empty result. Only the text travels, so other columns may
have any name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import arrow_udf

from .common import process_cache
from .sampling import labelled_sample

PER_CLASS = {0: 2000, 1: 4000}
CALIBRATION = 2000
BUCKETS, DIM, NONZERO, WINDOW = 8192, 64, 8, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 60, 128, 3e-3, 1e-3, 7
MAX_WORDS = 300_000
PARTS = 4
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»…–—"


def word_features(word: bytes) -> int:
    """Letter bucket plus BUCKETS times shape bucket of a word by itself."""
    import zlib
    w = word.decode("utf-8", "replace")
    core = w.strip(MARKS)
    at = w.find(core) if core else len(w)
    shape = f"{w[:at][:4]} {w[at + len(core):][:4]} {'U' if core.isupper() and len(core) > 1 else ''}" \
            f"{'T' if core[:1].isupper() else ''}{'9' if any(c.isdigit() for c in core) else ''}{'' if core else '-'}"
    letters = zlib.crc32(core.lower().encode()) % BUCKETS
    return letters + BUCKETS * (zlib.crc32(b"shape " + shape.encode()) % BUCKETS)


def features(text: bytes | None):
    """(letter buckets, shape buckets, ratios) of a text."""
    import zlib

    import numpy as np
    text = text or b""
    known = process_cache("quality").setdefault("quality words", {})
    if len(known) > MAX_WORDS:
        known.clear()
    words = text.split()
    n = len(words)
    for w in set(words):
        if w not in known:
            known[w] = word_features(w)
    both = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=n)
    letters, shapes = both % BUCKETS, both // BUCKETS
    again = np.zeros(n, dtype=bool)
    again[1:] = letters[1:] == letters[:-1]
    line = np.zeros(n, dtype=bool)
    seen, at = set(), 0
    for x in text.split(b"\n"):
        k = len(x.split())
        if k:
            line[at:at + k] = x in seen
            seen.add(x)
        at += k
    shapes = np.where(line, zlib.crc32(b"again line") % BUCKETS, np.where(again, zlib.crc32(b"again word") % BUCKETS, shapes))
    per = max(n, 1)
    ratios = np.array([np.log1p(n) / 10, len(text) / per / 10, len(set(words)) / per, again.sum() / per, line.sum() / per,
                       sum(text.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"!")) / per,
                       float(n == 0)], dtype=np.float64)
    return letters, shapes, ratios


def index_vectors():
    """Sparse ternary vectors of the buckets, from a fixed seed."""
    import numpy as np
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    at = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, np.tile([1, -1], NONZERO // 2).astype(np.float32)[None, :], axis=1)
    return out


def context_sums(sample: DataFrame):
    """Sum of the neighbours' index vectors for each bucket. The sample, which
    is bounded, is read by ``PARTS`` tasks at most, whatever the number of
    shuffle partitions; each sends one matrix of fixed size."""
    def run(batches):
        import numpy as np
        index = index_vectors().astype(np.int32)
        total = np.zeros((BUCKETS, DIM), dtype=np.int32)  # whole numbers: the same in any order
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                letters, shapes, _ = features(t)
                for own in (letters, shapes):
                    for at in range(0, len(own), 1 << 14):  # blocks of a long text, with the words around
                        lo, hi = max(0, at - WINDOW), min(len(own), at + (1 << 14) + WINDOW)
                        near = index[own[lo:hi]]
                        around = np.zeros_like(near)
                        for d in range(1, WINDOW + 1):
                            around[d:] += near[:-d]
                            around[:-d] += near[d:]
                        inner = slice(at - lo, min(at + (1 << 14), len(own)) - lo)
                        np.add.at(total, own[lo:hi][inner], around[inner])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    import numpy as np
    got = np.zeros((BUCKETS, DIM), dtype=np.int64)
    for r in sample.select("text").coalesce(PARTS).mapInArrow(run, "m binary").collect():
        got += np.frombuffer(r["m"], dtype=np.int32).reshape(BUCKETS, DIM)
    return got.astype(np.float64)


def pooled(text: bytes | None, vectors):
    """Feature vector of a document; words are pooled in blocks."""
    import numpy as np
    letters, shapes, ratios = features(text)
    out = []
    for own in (letters, shapes):
        total = np.zeros(DIM)
        for at in range(0, len(own), 1 << 14):
            total += vectors[own[at:at + (1 << 14)]].sum(axis=0, dtype=np.float64)
        out.append(total / max(len(own), 1))
    return np.concatenate([*out, ratios])


def train(x, y):
    """Two-layer network on standardised features: (mean, scale, w1, b1, w2, b2)."""
    import numpy as np
    rng = np.random.default_rng(SEED)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
    m, v, step = [0.0 * a for a in p], [0.0 * a for a in p], 0
    for _ in range(max(EPOCHS, 2400 * BATCH // max(len(z), 1) // 4)):  # small samples get enough steps, too
        order = rng.permutation(len(z))
        for at in range(0, len(z), BATCH):
            i = order[at:at + BATCH]
            h = np.tanh(z[i] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[i]) / len(i)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grads = [z[i].T @ dh + DECAY * p[0], dh.sum(axis=0), h.T @ d + DECAY * p[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return mean, scale, *p


def logits(net, x):
    import numpy as np
    mean, scale, w1, b1, w2, b2 = net
    return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2[0]


def calibrated(z, y, fitted_on) -> tuple[float, float]:
    """(temperature, shift) for logits ``z`` of the calibration rows, whose
    classes have their natural shares. The shift makes up for the other shares
    of the rows fitted on; the temperature has the least log-loss on a grid."""
    import numpy as np
    if not len(z):
        return 1.0, 0.0

    def odds(a):
        return np.log((a.sum() + 1) / (len(a) - a.sum() + 1))
    shift = float(odds(y) - odds(fitted_on))
    grid = np.exp(np.linspace(np.log(0.2), np.log(20), 200))
    loss = [np.logaddexp(0, np.where(y > 0, -1, 1) * (z / t + shift)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))]), shift


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text") -> dict:
    """The model: word vectors, network and temperature, or a constant."""
    import numpy as np
    sample = labelled_sample(docs, labels, label, PER_CLASS, CALIBRATION, text)
    share = sample.groupBy("part", "y").count().collect()
    fits = {r["y"]: r["count"] for r in share if r["part"] == "fit"}
    if len(fits) < 2:
        n = sum(fits.values())
        return {"constant": fits.get(1, 0) / n if n else 0.5}
    vectors = context_sums(sample)
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9) \
        + index_vectors() / np.sqrt(NONZERO)
    vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def run(batches):
        for b in batches:
            x = [pooled(t, vectors).astype("<f8").tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("part"), b.column("doc_id").cast(pa.int64()), pa.array(x, pa.binary())],
                                             names=["y", "part", "doc_id", "x"])
    rows = sample.mapInArrow(run, "y int, part string, doc_id long, x binary").collect()
    rows.sort(key=lambda r: r["doc_id"])

    def part(name):
        own = [r for r in rows if r["part"] == name]
        x = np.stack([np.frombuffer(r["x"]) for r in own]) if own else np.zeros((0, 1))
        return x, np.array([r["y"] for r in own], dtype=np.float64)
    x, y = part("fit")
    net = train(x, y)
    cx, cy = part("calibrate")
    t, shift = calibrated(logits(net, cx) if len(cy) else cy, cy, y)
    return {"vectors": vectors, "net": net, "temperature": t, "shift": shift}


def score(text: Column, model: dict) -> Column:
    """Probability of label 1 for a string column."""
    def run(col: pa.Array) -> pa.Array:
        import numpy as np
        if "constant" in model:
            return pa.array(np.full(len(col), model["constant"], dtype=np.float64))
        x = [pooled(t, model["vectors"]) for t in col.cast(pa.binary()).to_pylist()]
        if not x:
            return pa.array([], pa.float64())
        z = logits(model["net"], np.stack(x)) / model["temperature"] + model["shift"]
        return pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))
    return arrow_udf(run, returnType="double")(text)
