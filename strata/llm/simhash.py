"""SimHash near-duplicates.

Fingerprints: 64 majority bits over the XXH64 values of word shingles.

Linking: a fingerprint is cut into 32 segments of two bits and mapped to the
number of set bits of each (0 to 2). The Manhattan distance of two such vectors
is at most the Hamming distance of the fingerprints. If it is 3 or less, it is
1 or less in one of the two halves (16 segments each), so a grid whose cells
are the vectors of a half finds every pair: each fingerprint stands in its own
cell of either half (home) and, to meet those one step above, in the cells with
one more bit in one segment (probe): 26 rows on average. Within a cell homes
are compared with homes and probes by the Manhattan bound over all segments,
then by the exact Hamming distance.

Links of a cell leave the task as a spanning forest: fewer rows than the cell
has, whatever the number of pairs. A cell of more than ``BLOCK`` rows (dense
groups of near copies) is cut into blocks, and each pair of blocks is a task's
work of its own. Equal fingerprints are merged before all this, so exact copies
add nothing.

Cases: null and wordless texts have fingerprint zero, linked like any other.
Texts under three words are one shingle. Ties of ``doc_id`` and repeated rows
stay separate rows of one component; a component without any non-null id has a
null component_id. An empty table gives an empty result. A column named like
an output is refused (``component`` and ``root`` give other names); other
columns stay.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..operators.util import discard, recording
from .common import free_name, process_cache, refuse, written
from .components import components

WORDS, SEED, MAX_BITS = 3, 42, 3
BLOCK = 1024
EVEN = 0x5555555555555555


def fingerprint_of(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned fingerprint; bytes.lower() and bytes.split() touch ASCII only."""
    import numpy as np
    import xxhash
    w = (text or b"").lower().split()
    if not w:
        return 0
    h, join = xxhash.xxh64_intdigest, b" ".join
    shingles = zip(*(w[i:] for i in range(words))) if len(w) >= words else [w]
    hashes = np.array([h(join(s), seed) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = WORDS, seed: int = SEED) -> Column:
    """Fingerprint of a string column, as a signed long."""
    def run(col: pa.Array) -> pa.Array:
        import numpy as np
        process_cache("simhash")  # frees what an earlier stage left in this worker
        got = [fingerprint_of(t, words, seed) for t in col.cast(pa.binary()).to_pylist()]
        return pa.array(np.array(got, dtype=np.uint64).view(np.int64))
    return arrow_udf(run, returnType="long")(text)


def segment_counts(x):
    """The 32 counts of set bits of a uint64 array, two bits each."""
    import numpy as np
    m, one = np.uint64(EVEN), np.uint64(1)
    return (((x >> one) & x & m) << one) | (((x >> one) ^ x) & m)


def manhattan(a, b):
    """Manhattan distance of segment counts: codes that differ by two have xor 2, by one 1 or 3."""
    import numpy as np
    y, m = a ^ b, np.uint64(EVEN)
    low, high = y & m, (y >> np.uint64(1)) & m
    return np.bitwise_count(low).astype(np.int16) + 2 * np.bitwise_count(high & ~low).astype(np.int16)


def close(x, y, bits: int):
    """Elementwise: the Manhattan bound, then the exact distance."""
    import numpy as np
    ok = manhattan(segment_counts(x), segment_counts(y)) <= bits
    ok &= np.bitwise_count(x ^ y) <= bits
    return ok


def grid_rows(fps: DataFrame) -> DataFrame:
    """(cell, probe, fp): the home and probe cells of each fingerprint in both halves."""
    def run(batches):
        import numpy as np
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            counts = segment_counts(fp)
            for half in (0, 1):
                own = (counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                for segment in range(-1, 16):
                    if segment < 0:
                        at, cell = slice(None), own
                    else:  # one more bit; codes 0, 1, 2 are the counts themselves
                        at = ((own >> np.uint64(2 * segment)) & np.uint64(3)) < 2
                        cell = own[at] + np.uint64(1 << (2 * segment))
                    cell = (cell | np.uint64(half << 32)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell), pa.array(np.full(len(cell), segment >= 0)),
                         pa.array(fp[at].view(np.int64))], names=["cell", "probe", "fp"])
    return fps.select("fp").mapInArrow(run, "cell long, probe boolean, fp long")


def forest(fp, home: int, bits: int):
    """Spanning forest of the links of one cell: ``home`` homes first, then probes."""
    import numpy as np
    n = len(fp)
    left = np.ones(n, dtype=bool)
    is_home = np.arange(n) < home
    parents, children = [], []
    for start in range(home):
        if not left[start]:
            continue
        left[start] = False
        front = [start]
        while front:
            i = front.pop()
            may = left if i < home else left & is_home  # probes are not compared with probes
            j = np.flatnonzero(may)
            j = j[close(fp[j], fp[i], bits)]
            left[j] = False
            parents.append(np.full(len(j), fp[i]))
            children.append(fp[j])
            front.extend(j.tolist())
    none = fp[:0]
    return np.concatenate([none, *parents]), np.concatenate([none, *children])


def cell_links(rows: DataFrame, bits: int) -> DataFrame:
    """(a, b) from rows (cell, block, probe, fp) that are dealt by cell and
    block and sorted by cell, block and probe."""
    def run(batches):
        import numpy as np

        def links(cell, block, probe, fp):
            n = len(fp)
            new = np.ones(n, dtype=bool)
            new[1:] = (cell[1:] != cell[:-1]) | (block[1:] != block[:-1])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, n))
            use = (size > 1) & ~probe[start]
            out = []
            # small cells: all their comparisons at once
            small = use & (size <= 32)
            s, z = start[small], size[small]
            if len(s):
                member = np.repeat(s, z) + (np.arange(z.sum()) - np.repeat(np.cumsum(z) - z, z))
                end = np.repeat(s + z, z)
                first = ~probe[member]
                member, end = member[first], end[first]
                for at in range(0, len(member), 1 << 16):
                    i, e = member[at:at + (1 << 16)], end[at:at + (1 << 16)]
                    k = e - i - 1
                    left = np.repeat(i, k)
                    right = left + 1 + (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))
                    ok = (fp[left] != fp[right]) & close(fp[left], fp[right], bits)
                    out.append((fp[left[ok]], fp[right[ok]]))
            for s, z in zip(start[use & (size > 32)], size[use & (size > 32)]):
                home = int((~probe[s:s + z]).sum())
                out.append(forest(fp[s:s + z], home, bits))
            a = np.concatenate([fp[:0], *(x for x, _ in out)])
            b = np.concatenate([fp[:0], *(y for _, y in out)])
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in pair], names=["a", "b"])

        rest = None  # the last cell of a batch may go on in the next
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            now[3] = now[3].view(np.uint64)
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            if not len(now[0]):
                continue
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = [x[cut:] for x in now]
            if cut:
                yield links(*(x[:cut] for x in now))
        if rest is not None:
            yield links(*rest)
    return rows.select("cell", "block", "probe", "fp").mapInArrow(run, "a long, b long")


def links(fps: DataFrame, bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) at ``bits``
    or fewer differing bits, at least a spanning forest of each component.
    ``bits`` is 3 at most, as the grid is made for a distance of 1 in a half."""
    if not 0 <= bits <= 3:
        raise ValueError("bits must be 0 to 3")
    rows = written(grid_rows(fps), "grid")
    crowded = written(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
                      .select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "crowded")
    dealt = rows.join(crowded, "cell", "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # a pair of blocks (i, j) with i <= j is numbered i * blocks + j; a row goes to all pairs with its block
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                        lambda j: F.least(mine, j).cast("long") * F.col("blocks") + F.greatest(mine, j))
    dealt = dealt.select("cell", "probe", "fp", F.explode(
        F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("block"))
    dealt = dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", "probe")
    return cell_links(dealt, bits)


def near_duplicates(marked: DataFrame, doc_id: str = "doc_id", fp: str = "fp", bits: int = MAX_BITS,
                    component: str = "component_id", root: str = "component_fp") -> DataFrame:
    """``marked`` (a written table with fingerprints in ``fp``, as it is read
    twice) with ``component``, the smallest id of the component, and ``root``,
    its smallest fingerprint, which tells components apart where ids repeat."""
    refuse(marked, component, root)
    with recording() as made:
        # ids are combined per fingerprint before the shuffle: a group of copies costs a row a task
        fps = written(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least")), "distinct-fps")
        linked = components(links(fps, bits)).withColumnRenamed("node", "fp")
        rooted = written(fps.join(linked, "fp", "left")
                         .select("fp", "least", F.coalesce("label", "fp").alias("root")), "roots")
        least = rooted.groupBy("root").agg(F.min("least").alias("least"))
        members = written(rooted.select("fp", "root").join(least, "root"), "members")
    discard(marked.sparkSession, made[:-1])  # all but the members
    key = free_name(marked, "__fp")
    members = members.select(F.col("fp").alias(key), F.col("least").alias(component), F.col("root").alias(root))
    return marked.join(members, F.col(fp) == F.col(key)).drop(key)
