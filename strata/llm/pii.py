"""Personal data: regular expressions propose spans, checksums and ranges
confirm them, words nearby adjust a score.

Kinds of the base (kept whatever their score): email, ip, card, phone. The
method adds iban (mod-97) and ssn (needs a context word) where the score
reaches ``THRESHOLD`` and no base span overlaps.

Cases: a null text counts as empty and has no spans; work is linear in the
length of a text, runs of one character class included. Repeated rows get the
same spans. Positions are code points, ends exclusive. An empty table gives an
empty result. The spans are one column, so the table's other columns may have
any name.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean,score:double>>"
THRESHOLD = 0.5
NEAR = 40  # code points on either side that count as nearby

#: Score of a span by kind: without context, and the words that raise it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": re.compile(r"\b(e-?mail|contact|write|mail)\b"),
    "ip": re.compile(r"\b(ip|address|host|server|login)\b"),
    "card": re.compile(r"\b(card|visa|mastercard|amex|credit|debit|payment)\b"),
    "phone": re.compile(r"\b(phone|tel|telephone|call|mobile|cell|fax)\b"),
    "iban": re.compile(r"\b(iban|account|bank|konto|compte|cuenta)\b"),
    "ssn": re.compile(r"\b(ssn|social security|tax id|taxpayer)\b"),
}
AGAINST = re.compile(r"\b(version|order|invoice|isbn|part|serial|example|sample)\b")

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a shorter start inside a run of digits can't match where the run's first digit didn't
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def emails(text: str):
    """Leftmost matches: the local part is the run before an @ as far as the
    previous match, so no start is tried twice."""
    last = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def small_parts(ip: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in ip.split("."))


def digits_of(s: str) -> str:
    return "".join(DIGIT.findall(s))


def proposals(text: str):
    """(kind, start, end) of confirmed spans, kind by kind."""
    if "@" in text:
        for s, e in emails(text):
            yield "email", s, e
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if small_parts(m[0]):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        # the pattern may run into capital words that follow: try shorter ends at its spaces
        ends = [len(m[0]), *(i for i in range(len(m[0]) - 1, 14, -1) if m[0][i] == " ")]
        for e in ends:
            if len(s := m[0][:e].replace(" ", "")) >= 15 and mod97(s):
                yield "iban", m.start(), m.start() + e
                break
    if "-" in text:
        for m in SSN.finditer(text):
            if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
                yield "ssn", m.start(), m.end()


def score_of(text: str, kind: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - NEAR):start]} {text[end:end + NEAR]}".lower()
    score = PRIOR[kind] + 0.3 * bool(CONTEXT[kind].search(near)) - 0.2 * bool(AGAINST.search(near))
    return round(min(max(score, 0.0), 1.0), 3)


def spans_of(text: str) -> list[dict]:
    """All spans, by start, then kind as listed in KINDS."""
    base, added = [], []
    for kind, s, e in proposals(text):
        (base if kind in BASE else added).append((s, KINDS.index(kind), e, score_of(text, kind, s, e)))
    taken: list[list[int]] = []  # union of the base spans
    for s, e in sorted((s, e) for s, _, e, _ in base):
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])

    def clear(s, e):
        i = bisect_left(taken, [e])
        return not i or taken[i - 1][1] <= s

    found = base + [x for x in added if x[3] >= THRESHOLD and clear(x[0], x[2])]
    return [{"kind": KINDS[k], "start": s, "end": e, "base": k < len(BASE), "score": x}
            for s, k, e, x in sorted(found)]


def pii_spans(text: Column) -> Column:
    """Array of (kind, start, end, base, score) for a string column."""
    def run(texts):
        return [spans_of(t.decode("utf-8")) if t else [] for t in texts]
    return arrow_column(run, SPANS)(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; where spans
    overlap, the earlier one (then the longer one) names the replacement."""
    def run(texts):
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            t, parts, at = t.decode("utf-8"), [], 0
            for x in sorted(spans_of(t), key=lambda x: (x["start"], -x["end"])):
                if x["start"] >= at:
                    parts += [t[at:x["start"]], f"[{x['kind']}]"]
                at = max(at, x["end"])
            out.append("".join(parts) + t[at:])
        return out
    return docs.withColumn(text, arrow_column(run, "string")(F.col(text)))
