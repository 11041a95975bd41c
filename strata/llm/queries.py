"""The registered queries ``opN_<name>``: each applies its operator, with
production parameters, to the whole of its table and derives the digest
columns from what the operator returns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..plans.registry import query
from . import (ann, bpe, embedding_dups, lexical, packing, pii, quality_model, quality_rules as rules, secrets, sharding, simhash,
               toxicity, variants)
from .common import held_out, span_digests, table, written

JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
PATTERN = public_tokenizers.PATTERN


@query("op1_pii")
def op1_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", pii.pii_spans(F.col("text")).alias("found"))
    return found.select("doc_id", *[c.alias(k) for k, c in span_digests(F.col("found"), pii.BASE).items()])


@query("op2_packing")
def op2_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packed_digest(docs)


def packed(docs):
    """The pieces with their ids and places."""
    return packing.pack(packing.document_pieces(docs, JSON, PATTERN), numbers="nth")


def packed_digest(docs):
    return packed(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                               "sequence_id", "offset")


@query("op3_simhash")
def op3_simhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    marked = written(docs.select("doc_id", simhash.fingerprint(F.col("text")).alias("fp")), "fingerprints")
    return simhash.near_duplicates(marked).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op4_bpe")
def op4_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = docs.select("doc_id", bpe.round_trip(F.col("text"), RANKS, PATTERN).alias("got")).select("doc_id", "got.*")
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op5_secrets")
def op5_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base, tokens = "base", "tokens"
    scanned = written(secrets.scan(docs, "text", base, tokens).drop("text"), "scanned")
    found = secrets.finished(scanned, secrets.dismissed_from(scanned, tokens), base, tokens, "found")
    return found.select("doc_id", *[c.alias(k) for k, c in span_digests(F.col("found"), secrets.BASE).items()])


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.score(F.col("text"), model).alias("got"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("got.score").alias("score"),
                         (F.col("got.score") >= 0.5).cast("int").alias("predicted"), F.col("got.evidence").alias("evidence"))


@query("op7_ann")
def op7_ann(spark, sf_dir):
    vectors = ann.usable(table(spark, sf_dir, "embeddings"))
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


@query("op8_sharding")
def op8_sharding(spark, sf_dir):
    """Law ``bytes``: eight shards of near-equal bytes, from five old ones by host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sized = sharding.text_sizes(docs, F.col("text")).withColumn(
        "old_shard", F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(5)).cast("int"))
    moved = sharding.move(sized, 8, order=("doc_id", "size", "text_crc32"))
    # size and checksum of the texts that lie in the new shards
    return sharding.text_sizes(moved.select("doc_id", "text", "shard", "slot"), F.col("text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


#: The counts by list functions, and the host verdicts from the beta prior as ``host_rates`` fits it.
RULES_SQL = r"""
with w as (select doc_id, source, coalesce(text, '') as text,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
win as (select doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') as win
        from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w)),
rep as (select doc_id, win from win group by all having count(*) > 1),
cov as (select doc_id, count(distinct i + k) as n from (select doc_id, i, unnest(range(0, 8)) as k from win semi join rep using (doc_id, win))
        group by doc_id),
c as (select doc_id, source, cast(len(ws) as bigint) as n_words,
             cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
             cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls,
             cast(coalesce(cov.n, 0) as bigint) as n_repeat_words
      from w left join cov using (doc_id)),
m as (select *, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
             n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c),
f as (select *, base_failed or 10 * n_symbols > n_words or 5 * n_dup_lines > n_words
                or word_chars < 2 * n_words or word_chars > 14 * n_words as soft from m),
h as (select source, count(*) as n, sum(soft::int) as bad from f group by source),
p as (select (sum(bad) + 1) / (sum(n) + 2) as mean, var_pop(bad / n) as v, avg(1 / n) as inv from h),
q as (select mean, least(greatest(mean * (1 - mean) / greatest(v - mean * (1 - mean) * inv, 1e-6) - 1, 1), 1e6) as weight from p),
r as (select source, (bad + mean * weight) / (n + weight) as rate from h, q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (rate > 0.5 and soft) as kept
from f join r on f.source is not distinct from r.source
"""


@query("op9_quality_rules", RULES_SQL)
def op9_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    judged = rules.quality_rules(docs.select("doc_id", "source", rules.document_counts(F.col("text")).alias("counts")))
    return judged.select("doc_id", "counts.*", "base_failed", "kept")


@query("op10_quality")
def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality_model.score(F.col("text"), model).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op11_embedding_dups")
def op11_embedding_dups(spark, sf_dir):
    return embedding_dups.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op12_variants")
def op12_variants(spark, sf_dir):
    runs = variants.runs(table(spark, sf_dir, "documents"))
    worn = runs.select(variants.dropped_letter(F.col("run"), F.col("doc_id")).alias("word"))
    return variants.variants(written(variants.counted(worn), "words"))


#: The scores of all documents that hold a term of the item, in whole numbers.
RANKED_SQL = r"""
with t as (select doc_id, row_number() over () as r,
                  list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') as ts
           from documents where text is not null),
i as (select item_id, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) as term from benchmark),
q as (select item_id, term, count(*) as times from i group by all),
d as (select r, doc_id, cast(len(ts) as bigint) as n, ts from t where len(ts) > 0),
a as (select cast(count(*) as bigint) as nn, cast(sum(n) as bigint) as ll from d),
v as (select r, term, count(*) as tf from (select r, unnest(ts) as term from d) where term in (select term from q) group by all),
w as (select term, cast(floor(1000 * ln(cast(2 * any_value(nn) + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w
      from v, a group by term),
m as (select r, doc_id, 100 - 75 + ((75 * n * nn) // ll) as m from d, a),
s as (select q.item_id, m.doc_id, v.r,
             cast(sum(q.times * w.w * ((1000000000 * v.tf) // (1000 * v.tf + 8 * m.m))) as bigint) as score
      from v join q using (term) join w using (term) join m using (r) group by all),
k as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id, r) as int) as rank from s where score > 0)
select item_id, rank, doc_id, score from k where rank <= 10
"""


@query("op13_ranked", RANKED_SQL)
def op13_ranked(spark, sf_dir):
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
