"""PII, quality rules, BPE, packing and secrets against plain versions."""

import base64
import hashlib
import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers as P
import pytest
from brute import TEXTS
from hypothesis import given, settings, strategies as st

from strata.llm import bpe, packing, pii, queries, quality_rules, secrets
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def texts_of(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()


def by_text(df):
    """Rows of an op's result joined to nothing: doc_id -> list of rows."""
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def check_digests(query, rules, spark, folder):
    rows = texts_of(spark, folder)
    got = query(spark, folder).collect()
    assert len(got) == len(rows)
    want = sorted((str(r["doc_id"]), *brute.digest(r["text"], rules)[0].values(), brute.digest(r["text"], rules)[1]) for r in rows)
    kinds = [k for k, _, _ in rules]
    have = sorted((str(r["doc_id"]), *(r[f"n_{k}"] for k in kinds), r["base_sha256"]) for r in got)
    assert have == want
    return got


def test_pii_base_spans(spark, edge, as_table):
    check_digests(queries.op1_pii, brute.PII, spark, SF)
    got = check_digests(queries.op1_pii, brute.PII, spark, as_table(documents=edge))
    spans = next(r["spans"] for r in got if r["doc_id"] == 9)
    text = TEXTS[9]
    iban = text.index("DE89")
    assert f"iban:{iban}:{iban + 27}" in spans
    assert f"ssn:{text.index('123-45-6789')}:" in spans and spans.count("ssn") == 2  # both within reach of "ssn"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1@.+- ()9%4\n", max_size=60))
def test_pii_proposals_are_the_patterns(text):
    spans = [x for x in pii.spans_of(text) if x["base"]]
    joined = ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in spans)
    assert hashlib.sha256(joined.encode()).hexdigest() == brute.digest(text, brute.PII)[1]


def test_pii_checksums_and_redaction(spark, edge):
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")
    got = {r["doc_id"]: r["text"] for r in pii.redact(edge).collect() if r["doc_id"] is not None}
    assert got[0] is None and got[1] == "" and "[card]" in got[8] and "4111" not in got[8]
    assert pii.redact(edge).columns == edge.columns


def test_quality_counts(spark, edge, as_table, no_docs):
    for folder in (SF, as_table(documents=edge)):
        rows = texts_of(spark, folder)
        want = sorted((str(r["doc_id"]), *brute.quality_counts(r["text"]).values()) for r in rows)
        got = queries.op9_quality_rules(spark, folder).collect()
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
        assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in got) == want
        assert all(not r["kept"] for r in got if r["base_failed"])
    assert queries.op9_quality_rules(spark, as_table(documents=no_docs)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=120))
def test_repeated_windows(text):
    want = brute.quality_counts(text)
    got = quality_rules.counts_of(text.encode())
    assert got == {k: want[k] for k in got}


def test_bad_hosts_are_held_to_soft_rules(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    noisy = " ".join(f"word{i} ##" for i in range(40))
    rows = [(i, "bad", "short") for i in range(60)] + [(100, "bad", clean), (101, "bad", noisy), (102, "good", noisy)] \
        + [(200 + i, "good", clean) for i in range(60)] + [(300, "tiny", "short"), (301, "tiny", noisy), (302, None, clean)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    counted = docs.select("doc_id", "source", quality_rules.document_counts(F.col("text")).alias("counts"))
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(counted).collect()}
    assert kept[100] and not kept[101] and kept[102] and kept[200] and kept[302] and not kept[300]


@pytest.fixture(scope="module")
def reference():
    import tiktoken
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), \
        bpe.Bpe(path, P.PATTERN)


@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=80) | st.text(alphabet="abcdest 'lr0é中\n ", max_size=80))
def test_bpe_is_merging_by_rank(reference, text):
    theirs, ours = reference
    ids = np.frombuffer(ours.encode(text), dtype=np.int32).tolist()
    assert ids == theirs.encode_ordinary(text)
    assert b"".join(ours.bytes[i] for i in ids) == text.encode()


def test_bpe_query(spark, edge, as_table, reference, no_docs):
    theirs, _ = reference
    for folder in (SF, as_table(documents=edge)):
        rows = texts_of(spark, folder)
        want = []
        for r in rows:
            ids = theirs.encode_ordinary(r["text"] or "")
            want.append((str(r["doc_id"]), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256((r["text"] or "").encode()).hexdigest()))
        assert sorted((str(r["doc_id"]), *r[1:]) for r in queries.op4_bpe(spark, folder).collect()) == sorted(want)
    assert queries.op4_bpe(spark, as_table(documents=no_docs)).count() == 0
    ids = spark.createDataFrame([([1, 2],), (None,), ([],)], "ids array<int>")
    got = [r[0] for r in ids.select(bpe.decode(F.col("ids"), queries.RANKS, P.PATTERN)).collect()]
    assert [g and bytes(g) for g in got] == [b'"#', None, b""]
    with pytest.raises(Exception, match="outside the vocabulary"):
        spark.createDataFrame([([-1],)], "ids array<int>").select(bpe.decode(F.col("ids"), queries.RANKS, P.PATTERN)).collect()


def test_packing_ids_are_those_of_tokenizers(spark, edge, as_table, no_docs):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    folders = (SF, as_table(documents=edge.where("doc_id is not null and doc_id <> 3")))
    for folder in folders:
        texts = dict(texts_of(spark, folder))
        docs, packs = defaultdict(list), defaultdict(list)
        for r in queries.op2_packing(spark, folder).collect():
            docs[r["doc_id"]].append(r)
            packs[r["sequence_id"]].append(r)
        assert set(docs) == set(texts)
        for k, rows in docs.items():
            ids, at = [*t.encode(texts[k] or "", add_special_tokens=False).ids, 0], 0
            for r in sorted(rows, key=lambda r: r["start"]):
                part = np.array(ids[at:at + r["length"]], dtype="<u4").tobytes()
                assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(part), len(ids))
                at += r["length"]
            assert at == len(ids)
        padding = total = 0
        for rows in packs.values():
            at = 0
            for r in sorted(rows, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 1024
            total, padding = total + at, padding + 1024 - at
        assert padding < 0.02 * total + 1024
    twice = edge.where("doc_id = 3 or doc_id is null")
    rows = queries.packed_digest(twice.select("doc_id", "text")).collect()
    assert len(rows) == 5 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 5
    assert queries.op2_packing(spark, as_table(documents=no_docs)).count() == 0


def test_pack_any_rows(spark):
    """Rows of any columns, numbered by the operator; names of outputs are refused."""
    df = spark.range(500).selectExpr("id", "cast(id % 37 + 1 as int) as length", "1 as nth", "2 as __part").repartition(7)
    rows = packing.pack(df, 64, sequence="s", offset="o").collect()
    assert [*rows[0].asDict()] == ["id", "length", "nth", "__part", "s", "o"] and len({r["id"] for r in rows}) == 500
    packs = defaultdict(list)
    for r in rows:
        packs[r["s"]].append((r["o"], r["length"]))
    for got in packs.values():
        assert [o for o, _ in sorted(got)] == [sum(n for _, n in sorted(got)[:i]) for i in range(len(got))] and sum(n for _, n in got) <= 64
    with pytest.raises(ValueError, match="offset"):
        packing.pack(df.withColumn("offset", F.lit(1)))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 500), max_size=20))
def test_patterns_place_every_length_once(histogram):
    used = defaultdict(int)
    for count, pack in packing.patterns(histogram, 64):
        assert count > 0 and sum(n * times for n, times in pack) <= 64
        for n, times in pack:
            used[n] += count * times
    assert dict(used) == {k: n for k, n in histogram.items() if n}


def test_shortest_pack_first():
    """A length goes into the open pack with the most room left."""
    got = packing.patterns({60: 1, 50: 1, 4: 1}, 64)
    assert sorted(p for _, p in got) == [[(50, 1), (4, 1)], [(60, 1)]]


def test_secret_base_spans(spark, edge, as_table, no_docs):
    check_digests(queries.op5_secrets, brute.SECRETS, spark, SF)
    got = check_digests(queries.op5_secrets, brute.SECRETS, spark, as_table(documents=edge))
    spans = next(r["spans"] for r in got if r["doc_id"] == 12)
    at = TEXTS[12].index("Zx81")
    assert f"random:{at}:{at + 24}" in spans.split(",")
    assert queries.op5_secrets(spark, as_table(documents=no_docs)).count() == 0


def test_randomness_battery(spark):
    """Random tokens pass; structured ones are dismissed among many of both."""
    rng = np.random.default_rng(5)
    chars = np.array(list(secrets.DIGITS + secrets.UPPER + secrets.LOWER))
    random = ["".join(rng.choice(chars, 40)) for _ in range(150)]
    random = [r for r in random if any(c.isdigit() for c in r)]
    plain = [("ab12" * 10)[:40 - i % 5] + "Q" * (i % 5) for i in range(150)]
    rows = [(i, f"see {t} here") for i, t in enumerate(random + plain)]
    found = secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    flagged = {r["doc_id"] for r in found if any(s["kind"] == "random" for s in r["found"])}
    assert len([i for i in range(len(random)) if i in flagged]) >= 0.9 * len(random)
    assert not [i for i in range(len(random), len(rows)) if i in flagged]


def test_random_values_after_names(spark):
    """Values after '=', of every encoding, are found and masked apart from their names."""
    rng = np.random.default_rng(8)
    upper = "".join(rng.choice(list("0123456789ABCDEF"), 40))
    letters = "".join(rng.choice(list(secrets.UPPER + secrets.LOWER), 40))
    low = "".join(rng.choice(list(secrets.LOWER), 40))
    both = "Zx8/kQp0+LmN7vB3-tYw9eRf2_gHs5JcUa1"
    values = ["Zx81kQp0LmN7vB3tYw9eRf2g", upper, letters, low, both, base64.b64encode(rng.bytes(16)).decode(), "Zx81kQp0LmN7vB3tYw==",
              "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzX9QKEYab"]
    forms = ["AccountKey={} end", "get ?sig={}&x=1", "aws_secret_access_key={}", "value {} alone"]
    rows = [(i, f.format(v)) for i, (f, v) in enumerate((f, v) for v in values for f in forms)]
    found = secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["found"] if s["kind"] == "random"] for r in found.collect()}
    for i, text in rows:
        value = values[i // len(forms)]
        at = text.index(value)
        assert (at, at + len(value)) in got[i], text
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(found).collect()}
    assert not [i for i, _ in rows if values[i // len(forms)] in masked[i]] and masked[0] == "AccountKey=[secret] end"


def test_p_values(spark):
    """The chain of SQL steps against the same statistics in numpy."""
    import math
    token = "a3f09b27cc15de8846f01b9a7c3d2e5f60718293"
    got = spark.sql(f"select {secrets.graded(repr(token))} as g").first()["g"]
    alphabet = secrets.ENCODINGS["hex"][1]
    v = np.array([alphabet.index(c) for c in token], dtype=float)
    n, k = len(v), 16
    chi = k / n * (np.bincount(v.astype(int), minlength=k) ** 2).sum() - n
    d = k - 1
    z1 = ((chi / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d))
    side = v >= k // 2
    z2 = abs((side[1:] != side[:-1]).sum() - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    c = v - v.mean()
    z3 = abs((c[1:] * c[:-1]).sum() / (c * c).sum() + 1 / n) * math.sqrt(n)
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    f = -math.log(tail(z1)) - math.log(min(2 * tail(z2), 1)) - math.log(min(2 * tail(z3), 1))
    p = math.exp(-f) * (1 + f + f * f / 2)
    assert got["stratum"] == "hex 5" and got["bin"] == int(-10 * math.log10(p))


def test_redaction(spark, edge):
    done = secrets.redact(secrets.secret_spans(edge, "text", "__found"), "text", "__found")
    got = {r["doc_id"]: r["text"] for r in done.collect() if r["doc_id"] is not None}
    assert got[10] == '[secret]" token: secret: abcdefghijklmnop api_key=short API-KEY=x [secret]'
    assert got[11] == "[secret] AKIASHORT [secret] [secret] 0123456789abcde [secret]"
    assert got[24] == "[secret]" and got[1] == "" and got[0] is None and got[26] == TEXTS[26]
    assert [c for c in done.columns if c != "__found"] == edge.columns


def test_long_runs_of_positions(spark):
    text = " ".join(["é", *("0123456789abcdef0" for _ in range(1000))])
    df = spark.createDataFrame([(text,)], "text string")
    base = secrets.scan(df).first()["base"]
    assert [(b["start"], b["end"]) for b in base] == [(2 + 18 * i, 19 + 18 * i) for i in range(1000)]
