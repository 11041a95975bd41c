"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over
the vocabulary finds the longest token at every position. Starting from the
longest match, a token is accepted when it may stand after its predecessor: the
two stay apart when their bytes are merged by rank. That test is memoised for
each pair of tokens. A position from which nothing fits is marked and never
tried again, so the work is linear in the piece. The ids are those of merging
by rank.

Cases: null texts encode to null (``op4`` reads them as empty), empty texts to
no ids. Ids outside the vocabulary raise on decoding. The memos are bounded;
when full they start anew, which costs time only. Texts of any length are
encoded whole, in time linear in it. Repeated rows get equal ids. An empty table
gives an empty result. Only the column itself travels, so others may have any name.
"""

from __future__ import annotations

import base64
from array import array

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from .common import process_cache

MAX_PIECES, MAX_PAIRS = 600_000, 400_000

#: A split pattern and its equal in the standard library's syntax, which is
#: half again as fast. It serves texts within Latin-1 (a check that costs next
#: to nothing) without the few characters that the libraries class differently;
#: all others are split by the pattern itself.
STDLIB = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""":
    r"""'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""",
}


def splitter(pattern: str):
    """The function that splits a text into pieces."""
    import re

    import regex
    slow = regex.compile(pattern)
    if pattern not in STDLIB:
        return slow.findall
    latin = "".join(map(chr, range(256)))
    odd = {c for theirs, ours in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s"))
           for c in set(regex.findall(theirs, latin)) ^ set(re.findall(ours, latin))}
    fast = re.compile(STDLIB[pattern]).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return slow.findall(text)
        return slow.findall(text) if any(c in text for c in odd) else fast(text)
    return split


class Bpe:
    """Vocabulary of a rank file (base64 token, rank) with its encoder."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.text = [t.decode("latin-1") for t in self.bytes]
        self.size = [len(t) for t in self.bytes]
        self.rank = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.split = splitter(pattern)
        self.automaton = ahocorasick.Automaton()
        for t, i in self.rank.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.prefix: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = Pieces(self)

    def last_merge(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge gives ``token``; a byte gives itself twice."""
        if (got := self.halves.get(token)) is None:
            parts = list(self.text[token])
            while len(parts) > 2:
                pairs = [self.rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
                i = min(range(len(pairs)), key=pairs.__getitem__)
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            got = self.halves[token] = (token, token) if len(parts) == 1 else \
                (self.rank[parts[0]], self.rank[parts[1]])
        return got

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix, or -1."""
        if (got := self.prefix.get(token)) is None:
            t = self.text[token]
            got = next((self.rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.rank), -1)
            self.prefix[token] = got
        return got

    def apart(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves ``left`` and ``right`` as they are.

        Undoes their last merges, latest first, and looks whether a merge
        across the seam would have come before the one undone.
        """
        got = self.pairs.get((left, right))
        if got is not None:
            return got
        a, b, before, ok = left, right, 1 << 60, None
        while ok is None:
            across = self.rank.get(self.text[a] + self.text[b])
            if across is not None and across < before:
                ok = False
                break
            first = [(a, True), (b, False)] if a > b else [(b, False), (a, True)]
            for token, is_left in first:
                l, r = self.last_merge(token)
                if l == r == token:
                    continue  # a single byte: nothing to undo
                # of equal ranks the left merge comes first, so one in b may not be beaten by a tie
                before = token if is_left else token + 1
                if is_left:
                    a = r
                else:
                    b = l
                break
            else:
                ok = True
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = ok
        return ok

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece in Latin-1 characters."""
        if (whole := self.rank.get(piece)) is not None:
            return [whole]
        known, apart, matches = self.pairs.get, self.apart, self.automaton.iter_long
        # the longest matches one after another are the answer if all neighbours fit
        out = [i for _, i in matches(piece)]
        last, k = out[0], 0
        for token in out[1:]:
            k += 1
            if (ok := known((last, token))) is None:
                ok = apart(last, token)
            if not ok:
                break
            last = token
        else:
            return out
        # else go back to where they fit and search on from there
        del out[k:]
        n, size, shorter = len(piece), self.size, self.prefix
        dead = set()
        pos = sum([size[i] for i in out])
        while pos < n:
            while token >= 0:
                end = pos + size[token]
                if end not in dead:
                    if not out:
                        break
                    if (ok := known((out[-1], token))) is None:
                        ok = apart(out[-1], token)
                    if ok:
                        break
                if (less := shorter.get(token)) is None:
                    less = self.shorter(token)
                token = less
            if token >= 0:
                out.append(token)
                pos = end
                if pos < n:
                    token = next(matches(piece, pos))[1]
            else:
                dead.add(pos)
                token = out.pop()
                pos -= size[token]
                token = self.shorter(token)
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as native 32-bit integers."""
        if len(self.pieces) > MAX_PIECES:
            self.pieces.clear()
        return b"".join(map(self.pieces.__getitem__, self.split(text)))


class Pieces(dict):
    """Memo of encoded pieces; very long ones aren't kept."""

    def __init__(self, vocabulary: Bpe):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        got = array("i", self.vocabulary.encode_piece(piece.encode("utf-8").decode("latin-1"))).tobytes()
        if len(piece) <= 256:
            self[piece] = got
        return got


def vocabulary(path: str, pattern: str) -> Bpe:
    """The vocabulary, read once per Python worker."""
    cache = process_cache("bpe")
    key = ("bpe", path, pattern)
    if key not in cache:
        cache[key] = Bpe(path, pattern)
    return cache[key]


def _encoded(v: Bpe, texts) -> pa.ListArray:
    import numpy as np
    got = [None if t is None else v.encode(t) for t in texts]
    ends = np.cumsum([0, *(len(x or b"") // 4 for x in got)], dtype=np.int32)
    ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(x for x in got if x))])
    return pa.ListArray.from_arrays(pa.array(ends), ids, mask=pa.array([x is None for x in got], pa.bool_()))


def _decoded(v: Bpe, ids: pa.ListArray) -> pa.Array:
    import numpy as np
    if not hasattr(v, "flat"):
        v.flat = np.frombuffer(b"".join(v.bytes), dtype=np.uint8)
        v.sizes = np.array(v.size)
        v.starts = np.cumsum(v.sizes) - v.sizes

    def part(x):
        if len(x) and (x.min() < 0 or x.max() >= len(v.bytes)):
            raise ValueError("an id is outside the vocabulary")
        size = v.sizes[x]
        end = np.cumsum(size)
        at = np.arange(end[-1] if len(end) else 0) + np.repeat(v.starts[x] - (end - size), size)
        return v.flat[at].tobytes()

    def whole(x):  # in blocks, so that a long document needs no long index arrays
        return b"".join(part(x[at:at + (1 << 16)]) for at in range(0, len(x), 1 << 16))
    return pa.array([whole(x.values.to_numpy()) if (x := ids[i]).is_valid else None for i in range(len(ids))], pa.binary())


def encode(text: Column, path: str, pattern: str) -> Column:
    """Array of ids of a string column."""
    def run(col: pa.Array) -> pa.Array:
        return _encoded(vocabulary(path, pattern), col.to_pylist())
    return arrow_udf(run, returnType="array<int>")(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """Bytes of an array of ids."""
    def run(col: pa.Array) -> pa.Array:
        return _decoded(vocabulary(path, pattern), col)
    return arrow_udf(run, returnType="binary")(ids)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """(ids, decoded): the ids of a string column and the bytes that they decode
    to. One function, as a UDF over another's result would encode twice."""
    def run(col: pa.Array) -> pa.Array:
        v = vocabulary(path, pattern)
        ids = _encoded(v, col.to_pylist())
        return pa.StructArray.from_arrays([ids, _decoded(v, ids)], names=["ids", "decoded"])
    return arrow_udf(run, returnType="struct<ids:array<int>,decoded:binary>")(text)
