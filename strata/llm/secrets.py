"""Secret scans, in DataFrame functions alone.

Patterns propose the base spans: assign (a value of 12 or more characters given
to a name such as password or token), access (key ids), hex (16 or more).

The method adds ``random`` spans: unbroken tokens of 20 or more characters with
letters that look like the output of a random generator; '=' stands only at
their end, as padding. Their encoding is inferred (hex, letters of one or both
cases, base32, lower or upper base36, base62, base64, url-safe base64, or the
symbols of both), which gives the alphabet, and three tests are made for it: chi-squared of the
symbol counts against uniformity, runs above and below the middle of the
alphabet, and serial correlation of neighbours; Fisher's method joins their
p-values. Benjamini-Hochberg, at level ``q`` and apart for each encoding and
doubling of the length (long tokens are judged with more power), then decides
over the whole corpus which tokens are not random: of those that it dismisses,
a share of ``q`` at most are random in truth. The others are reported.

p-values are counted in bins of a tenth of a decimal power, so the tables that
decide have at most 12 encodings * 32 lengths * 301 bins, of which the driver
gets one threshold per encoding and length.

Cases: a null text counts as empty. Positions are code points, ends exclusive.
Work is linear in the text, but for ``redact``, which costs the length of a
text for each of its spans. Repeated rows count each. Extra columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, written

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
CLASS = r"A-Za-z0-9+/_-"
#: An inner '=' ends a token, so a value is apart from its name; padding counts to the 20.
TOKEN = rf"(?<![{CLASS}])(?=[0-9+/_-]*+[A-Za-z])(?:[{CLASS}]{{20,}}+={{0,2}}|[{CLASS}]{{19}}={{1,2}}|[{CLASS}]{{18}}==)"
#: A cheap look whether a kind's pattern can match at all.
MAY = {"assign": r"(?i)password|passwd|secret|token|api_?key", "access": "AKIA", "hex": "[0-9a-f]{16}",
       "random": rf"[{CLASS}]{{18}}"}

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encoding: what its tokens look like without padding, alphabet in order.
ENCODINGS = {
    "hex": ("[0-9a-f]+", DIGITS + LOWER[:6]),
    "HEX": ("[0-9A-F]+", DIGITS + UPPER[:6]),
    "lower26": ("[a-z]+", LOWER),
    "upper26": ("[A-Z]+", UPPER),
    "letters52": ("[A-Za-z]+", UPPER + LOWER),
    "base32": ("[A-Z2-7]+", UPPER + DIGITS[2:8]),
    "lower36": ("[0-9a-z]+", DIGITS + LOWER),
    "upper36": ("[0-9A-Z]+", DIGITS + UPPER),
    "base62": ("[0-9A-Za-z]+", DIGITS + UPPER + LOWER),
    "base64": ("[0-9A-Za-z+/]+", UPPER + LOWER + DIGITS + "+/"),
    "base64url": ("[0-9A-Za-z_-]+", UPPER + LOWER + DIGITS + "-_"),
    "mixed66": ("[0-9A-Za-z+/_-]+", UPPER + LOWER + DIGITS + "+/-_"),
}
MAX_BIN = 300
BLOCK = 256


def running_sums(x: Column) -> Column:
    """Sum of the elements before each, for an array of longs. Built in blocks,
    so that long arrays aren't copied once per element."""
    def add(acc, v):
        return F.struct((acc["sum"] + v).alias("sum"), F.concat(acc["all"], F.array(acc["sum"])).alias("all"))

    def prefix(values):
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.expr("cast(array() as array<bigint>)").alias("all"))
        return F.aggregate(values, start, add, lambda acc: acc["all"])

    blocks = F.sequence(F.lit(0), F.ceil(F.size(x) / BLOCK).cast("int") - 1)

    def part(i):
        return F.slice(x, i * BLOCK + 1, F.lit(BLOCK))
    sums = F.transform(blocks, lambda i: F.aggregate(part(i), F.lit(0).cast("long"), lambda a, v: a + v))
    whole = F.flatten(F.transform(F.arrays_zip(blocks.alias("i"), prefix(sums).alias("at")), lambda z:
                                  F.transform(prefix(part(z["i"])), lambda v: v + z["at"])))
    return F.when(F.size(x) > 0, whole).otherwise(F.expr("cast(array() as array<bigint>)"))


def matches(df: DataFrame, text: Column, kind: str, pattern: str, out: str, group: int = 0) -> DataFrame:
    """``df`` with ``out``: array of (start, end, value) of the leftmost matches
    of ``pattern``; value is the text of ``group``. Positions come from the
    lengths of the matches and of the text between them."""
    p, tmp = F.lit(pattern), free_name(df, f"__{kind}")
    may = text.rlike(MAY[kind])
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, p, F.lit(0)).alias("hits"),
                     F.regexp_extract_all(text, p, F.lit(group)).alias("values"))
    df = df.withColumn(tmp, F.when(may, parts))
    gaps = F.transform(F.slice(F.col(tmp)["gaps"], F.lit(1), F.size(F.col(tmp)["hits"])), lambda s: F.length(s).cast("long"))
    hits = F.transform(F.col(tmp)["hits"], lambda s: F.length(s).cast("long"))
    lengths = free_name(df, f"__{kind}_lengths")
    df = df.withColumn(lengths, F.when(F.size(hits) > 0, F.struct(
        gaps.alias("gap"), hits.alias("hit"), F.zip_with(gaps, hits, lambda g, h: g + h).alias("both"))))
    at = free_name(df, f"__{kind}_at")
    df = df.withColumn(at, running_sums(F.col(lengths)["both"]))
    found = F.transform(
        F.arrays_zip(F.col(at).alias("at"), F.col(lengths)["gap"].alias("gap"), F.col(lengths)["hit"].alias("hit"),
                     F.col(tmp)["values"].alias("value")),
        lambda z: F.struct((z["at"] + z["gap"]).alias("start"), (z["at"] + z["gap"] + z["hit"]).alias("end"),
                           z["value"].alias("value")))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,value:string>>)")
    return df.withColumn(out, F.when(F.col(lengths).isNotNull(), found).otherwise(none)).drop(tmp, lengths, at)


def normal_tail(z: str) -> str:
    """SQL for the upper tail of the normal distribution at ``z`` (a rational
    approximation of the error function, error under 2e-7)."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    poly = f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    tail = f"(exp(-{z} * {z} / 2) / 2.5066282746310002 * {poly})"
    return f"(if({z} >= 0, {tail}, 1 - {tail}))"


def graded(token: str) -> str:
    """SQL for (stratum, bin) of a token: its encoding with the doubling of its
    length, and ten times minus the decimal logarithm of its p-value; null
    where no encoding fits. Bins at or above ``MAX_BIN`` are one."""
    encoding = " ".join(f"when y.s rlike '^{look}$' then '{e}'" for e, (look, _) in ENCODINGS.items())
    alphabet = " ".join(f"when '{e}' then '{a}'" for e, (_, a) in ENCODINGS.items())
    halves = " ".join(f"when '{e}' then '{'0' * (len(a) // 2)}{'1' * (len(a) - len(a) // 2)}'"
                      for e, (_, a) in ENCODINGS.items())
    keep = "'e', y.e, 'n', y.n, "
    steps = [
        f"named_struct('s', y.s, 'n', cast(length(y.s) as double), 'e', case {encoding} end)",
        f"named_struct('s', y.s, {keep} 'a', case y.e {alphabet} end, 'h', case y.e {halves} end)",
        f"""named_struct({keep} 'k', cast(length(y.a) as double),
            'v', transform(filter(split(y.s, ''), c -> c <> ''), c -> cast(instr(y.a, c) - 1 as double)),
            'runs', length(regexp_replace(translate(y.s, y.a, y.h), '0+|1+', 'r')),
            'sq', aggregate(filter(array_distinct(split(y.s, '')), c -> c <> ''), 0D,
                            (t, c) -> t + pow(y.n - length(replace(y.s, c, '')), 2)))""",
        f"""named_struct({keep} 'k', y.k, 'runs', y.runs, 'v', y.v, 'chi', y.k * y.sq / y.n - y.n,
            'm', aggregate(y.v, 0D, (t, c) -> t + c) / y.n)""",
        f"""named_struct({keep} 'k', y.k, 'runs', y.runs, 'chi', y.chi,
            'var', aggregate(y.v, 0D, (t, c) -> t + (c - y.m) * (c - y.m)),
            'cov', aggregate(zip_with(slice(y.v, 1, size(y.v) - 1), slice(y.v, 2, size(y.v) - 1),
                                      (c, d) -> (c - y.m) * (d - y.m)), 0D, (t, c) -> t + c))""",
        # Wilson-Hilferty for chi-squared; changes of side are binomial; r is about normal, of deviation 1/sqrt(n)
        f"""named_struct({keep}
            'z1', (pow(greatest(y.chi, 0D) / (y.k - 1), 1 / 3D) - (1 - 2 / (9 * (y.k - 1)))) / sqrt(2 / (9 * (y.k - 1))),
            'z2', abs(y.runs - 1 - (y.n - 1) / 2) / sqrt((y.n - 1) / 4),
            'z3', if(y.var = 0, sqrt(y.n), abs(y.cov / y.var + 1 / y.n) * sqrt(y.n)))""",
        f"""named_struct({keep} 'f', -ln(greatest({normal_tail('y.z1')}, 1e-99))
            - ln(least(greatest(2 * {normal_tail('y.z2')}, 1e-99), 1D))
            - ln(least(greatest(2 * {normal_tail('y.z3')}, 1e-99), 1D)))""",
        # Fisher: twice f is chi-squared with six degrees of freedom, whose tail is exp(-f) (1 + f + f^2 / 2)
        f"""if(y.e is null, null, named_struct('stratum', concat(y.e, ' ', cast(floor(log2(y.n)) as string)), 'bin',
            cast(least(greatest((y.f - ln(1 + y.f + y.f * y.f / 2)) * 4.342944819032518, 0D), {MAX_BIN}D) as int)))""",
    ]
    got = f"array(named_struct('s', rtrim('=', {token})))"
    for body in steps:  # transform over one element names a step's values for the next
        got = f"transform({got}, y -> {body})"
    return f"{got}[0]"


def scan(df: DataFrame, text: str = "text", base: str = "base", tokens: str = "tokens") -> DataFrame:
    """``df`` with the base spans (array of start, kind number, end) and the
    candidate tokens (array of start, end, stratum, bin)."""
    cols = df.columns
    t = free_name(df, "__text")
    got = df.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    kinds = {}
    for kind, pattern, group, least in (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16),
                                        ("random", TOKEN, 0, 20)):
        kinds[kind] = free_name(got, f"__{kind}_found")
        got = matches(got, F.col(t), kind, pattern, kinds[kind], group)
        got = got.withColumn(kinds[kind], F.filter(kinds[kind], _longer(least)))
    spans = F.concat(*[F.transform(kinds[k], _span(i)) for i, k in enumerate(BASE)])
    graded_tokens = F.expr(f"""filter(transform(`{kinds['random']}`, c -> named_struct(
        'start', c.start, 'end', c.end, 'grade', {graded('c.value')})), c -> c.grade is not null)""")
    return got.select(*cols, F.array_sort(spans).alias(base), graded_tokens.alias(tokens))


def _longer(least: int):
    return lambda x: F.length(x["value"]) >= least


def _span(kind: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))


def dismissed_from(scanned: DataFrame, tokens: str = "tokens", q: float = 0.05) -> dict[str, int]:
    """For each stratum the lowest bin that Benjamini-Hochberg calls not random."""
    grades = scanned.select(F.explode(F.col(tokens)).alias("c")).groupBy(
        F.col("c.grade.stratum").alias("stratum"), F.col("c.grade.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_ = Window.partitionBy("stratum")
    up_to = all_.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    # p-values of a bin are at most 10 ** (-bin / 10)
    ranked = grades.select("stratum", "bin", F.sum("n").over(up_to).alias("k"), F.sum("n").over(all_).alias("m"))
    kept = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 10) <= q * F.col("k") / F.col("m"))
    return {r["stratum"]: r["bin"] for r in kept.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def secret_spans(df: DataFrame, text: str = "text", out: str = "found", q: float = 0.05) -> DataFrame:
    """``df`` with ``out``: array of (kind, start, end, base) by start, then kind.
    The scanned table is written once: thresholds need all of it before any
    row can be finished. Columns of ``df`` that aren't needed later should be
    dropped before."""
    base, tokens = free_name(df, "__base"), free_name(df, "__tokens")
    scanned = written(scan(df, text, base, tokens), "scanned")
    return finished(scanned, dismissed_from(scanned, tokens, q), base, tokens, out)


def finished(scanned: DataFrame, limits: dict[str, int], base: str, tokens: str, out: str) -> DataFrame:
    """Base spans and the tokens that weren't dismissed, as (kind, start, end, base)."""
    limit = F.lit(MAX_BIN + 1)
    if limits:
        bounds = F.create_map(*[F.lit(x) for kv in sorted(limits.items()) for x in kv])
    kept = F.filter(tokens, lambda c: c["grade"]["bin"] < (
        F.coalesce(F.try_element_at(bounds, c["grade"]["stratum"]), limit) if limits else limit))
    spans = F.array_sort(F.concat(base, F.transform(kept, _span(len(BASE)))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return scanned.withColumn(out, F.transform(spans, lambda x: F.struct(
        names[x["kind"]].alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
        (x["kind"] < len(BASE)).alias("base")))).drop(base, tokens)


def redact(df: DataFrame, text: str = "text", found: str = "found", mask: str = "[secret]") -> DataFrame:
    """``df`` with the union of the spans in ``found`` replaced by ``mask``."""
    clean = F.expr(f"""aggregate(`{found}`, named_struct('at', 0L, 'out', ''),
        (a, x) -> named_struct(
            'at', greatest(a.at, x.end),
            'out', if(x.start >= a.at, concat(a.out, substring(`{text}`, cast(a.at as int) + 1, cast(x.start - a.at as int)),
                                              '{mask}'), a.out)),
        a -> concat(a.out, substring(`{text}`, cast(a.at as int) + 1)))""")
    return df.withColumn(text, F.when(F.size(found) > 0, clean).otherwise(F.col(text)))
