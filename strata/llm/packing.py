"""Packing of token sequences: shortest-pack-first over the length histogram.

``pieces`` turns texts into pieces of at most ``size`` tokens. ``pack`` counts
the pieces of each length (at most ``size`` rows, the only thing the driver
gets) and fills packs on counts alone: lengths longest first, each into the
shortest open packs, those with the most room, as often as it fits, then into
new packs. The outcome is a list of patterns with counts. The k-th piece of a
length belongs to the k-th place of that length in the patterns, which the
rank of a piece within its length finds again. Ranks follow the order in which
the pieces were written.

Patterns: every length adds at most two to those it changes, so there are at
most 2 * size; a pattern holds at most sqrt(2 * size) different lengths. The
table of places that goes to the tasks has at most 2 * size * sqrt(2 * size)
rows, whatever the input.

Cases: a null or empty text is one piece with the end id alone. Repeated rows
are separate documents. Very long texts give many pieces. An empty table gives
no sequences. A column named like an output is refused; other columns stay.
"""

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..operators.util import broadcast_if_small
from .common import free_name, process_cache, refuse, written

PIECES = "array<struct<start:long,length:long,doc_tokens:long,ids:binary,nth:long>>"


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print
    stand for themselves, the others for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def tokenizer(path: str, pattern: str):
    """Encoder of a byte-level BPE tokenizer file, read once per Python worker.

    The ids of ``encoded`` are those of the ``tokenizers`` library (tested): a
    literal added token such as the end marker is that token, as it is by
    default there. The merges run in tiktoken, from the same file, at five
    times the speed.
    """
    import tiktoken
    cache = process_cache("packing")
    key = ("tokenizer", path, pattern)
    if key not in cache:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        back = byte_of_char()
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        cache[key] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    return cache[key]


def encoded(own, text: str) -> list[int]:
    """Ids of a text; the slower way is for texts that hold an added token."""
    if any(x in text for x in own.special_tokens_set):
        return own.encode(text, allowed_special="all")
    return own.encode_ordinary(text)


class Seen:
    """Numbers rows within their length, batch after batch of a partition: a
    count per length is all that a task keeps."""

    def __init__(self, size: int):
        import numpy as np
        self.count = np.zeros(size + 1, dtype=np.int64)

    def number(self, lengths):
        import numpy as np
        order = np.argsort(lengths, kind="stable")
        nth = np.empty(len(lengths), dtype=np.int64)
        nth[order] = np.arange(len(lengths)) - np.searchsorted(lengths[order], lengths[order], side="left")
        nth += self.count[lengths]
        self.count += np.bincount(lengths, minlength=len(self.count))
        return nth


def pieces(text: Column, path: str, pattern: str, size: int, end_id: int) -> Column:
    """Array of the pieces of a text: ids (unsigned, little-endian, 32 bits) in
    runs of ``size``, the end id after the last, and the piece's number among
    those of its length that the partition had before."""

    kind = to_arrow_type(_parse_datatype_string(PIECES))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        own, seen = tokenizer(path, pattern), Seen(size)
        for col in batches:
            start, length, total, ids, ends = [], [], [], [], [0]
            for i in range(len(col)):
                got = np.array([*encoded(own, col[i].as_py() or ""), end_id], dtype="<u4")
                for at in range(0, len(got), size):
                    part = got[at:at + size]
                    start.append(at)
                    length.append(len(part))
                    total.append(len(got))
                    ids.append(part.tobytes())
                ends.append(len(start))
            nth = seen.number(np.array(length, dtype=np.int64))
            fields = [*(pa.array(x, pa.int64()) for x in (start, length, total)), pa.array(ids, pa.binary()), pa.array(nth)]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                fields, fields=list(kind.value_type))).cast(kind)
    return arrow_udf(run, returnType=PIECES).asNondeterministic()(text)


def document_pieces(docs: DataFrame, path: str, pattern: str, size: int = 1024, end_id: int = 0) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, nth), a row per piece."""
    got = docs.select("doc_id", F.explode(pieces(F.col("text"), path, pattern, size, end_id)).alias("piece"))
    return got.select("doc_id", "piece.*")


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packs as (count, [(length, times), ...]) for a histogram of lengths."""
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def put(free: int, count: int, pack: list[tuple[int, int]]):
        if count:
            room.setdefault(free, []).append((count, pack))

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        changed = []  # packs that have got this length are not looked at again
        for free in sorted((f for f in room if f >= length), reverse=True):
            if not left:
                break
            times, kept = free // length, []
            for count, pack in room.pop(free):
                full = min(count, left // times)
                changed.append((free - times * length, full, [*pack, (length, times)]))
                left -= full * times
                count -= full
                if count and left:  # fewer than ``times`` are left: one pack takes them all
                    changed.append((free - left * length, 1, [*pack, (length, left)]))
                    left, count = 0, count - 1
                if count:
                    kept.append((count, pack))
            if kept:
                room[free] = kept
        times = size // length
        changed.append((size - times * length, left // times, [(length, times)]))
        if left % times:
            changed.append((size - left % times * length, 1, [(length, left % times)]))
        for x in changed:
            put(*x)
    return [x for free in sorted(room) for x in room[free]]


def places(histogram: dict[int, int], size: int):
    """For each place of a length in a pattern: length, first rank, times,
    first sequence, offset; sorted by length and rank."""
    import numpy as np
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for count, pack in patterns(histogram, size):
        offset = 0
        for length, times in pack:
            rows.append((length, used.get(length, 0), times, sequence, offset))
            used[length] = used.get(length, 0) + count * times
            offset += length * times
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def count_before(length: Column, size: int) -> Column:
    """How many earlier rows of the partition have this length."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        seen = Seen(size)
        for batch in batches:
            yield pa.array(seen.number(batch.to_numpy(zero_copy_only=False).astype(np.int64)))
    return arrow_udf(run, returnType="long").asNondeterministic()(length)


def pack(rows: DataFrame, size: int = 1024, sequence: str = "sequence_id", offset: str = "offset",
         numbers: str | None = None) -> DataFrame:
    """``rows`` (with a ``length`` of 1 to ``size``) with ``sequence`` and ``offset``.
    ``numbers`` names a column that has each row's number among those of its
    length in the partition already; it is left out of the result.

    ``rows`` is written once, each row with its partition and its number among
    the rows of its length there. Counts per partition and length, running over
    the partitions, turn that number into a rank, so the rows themselves (token
    ids and all) are neither sorted nor shuffled. The table of running counts
    is broadcast while it is small by the optimizer's measure; beyond that the
    join moves every row once."""
    refuse(rows, sequence, offset)
    part, nth, before, place = (free_name(rows, f"__{x}") for x in ("part", "nth", "before", "place"))
    given = F.col(numbers) if numbers else count_before(F.col("length"), size)
    numbered = written(rows.withColumn(part, F.spark_partition_id()).withColumn(nth, given), "pieces")
    counts = written(numbered.groupBy("length", part).agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    running = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.select("length", part, F.coalesce(F.sum("n").over(running), F.lit(0)).alias(before)), "starts")
    table = places(histogram, size)

    def run(length: pa.Array, rank: pa.Array) -> pa.Array:
        import numpy as np
        length, rank = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (length, rank))
        # lengths are at most 2**20 or so and ranks below 2**43
        i = np.searchsorted((table[:, 0] << 43) + table[:, 1], (length << 43) + rank, side="right") - 1
        at = rank - table[i, 1]
        return pa.StructArray.from_arrays(
            [pa.array(table[i, 3] + at // table[i, 2]), pa.array(table[i, 4] + at % table[i, 2] * length)],
            names=["sequence_id", "offset"])

    got = numbered.join(broadcast_if_small(starts), ["length", part]).withColumn(
        place, arrow_udf(run, returnType="struct<sequence_id:long,offset:long>")(F.col("length"), F.col(nth) + F.col(before)))
    return got.select(*(c for c in rows.columns if c != numbers), F.col(place)["sequence_id"].alias(sequence), F.col(place)["offset"].alias(offset))
