"""The query of each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licences
from ._common import claimed, shared_dir, small, written
from .decontaminate import contamination
from .fingerprints import neighbour_fingerprints
from .hmm import hmm_scores
from .language_id import language_id
from .mixing import mix
from .near_dedup import near_duplicates
from .span_dedup import span_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import PATTERNS, TokenLedger, counted, deletes, inserts, revisions
from .trie import branched, sequences, trie
from .warc import archived
from .whitening import whitened_components

#: Signs of markup that the revision batch of op6 takes out of texts.
MARKUP = r"[#$%&*|]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op2_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = span_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "n_removed", F.length("text").cast("long").alias("n_kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(table(spark, sf_dir, "documents"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted under both tokenizers, those with markup signs revised without them, exact copies
    of a text under a lesser doc_id deleted; the second batch comes twice."""
    docs, versions = table(spark, sf_dir, "documents"), list(PATTERNS)
    ledger = TokenLedger(spark, claimed(spark, f"{shared_dir(spark)}/token-ledger-{uuid.uuid4().hex}"))
    marked = docs.where(F.col("text").rlike(MARKUP))
    clean = F.regexp_replace("text", MARKUP, " ")
    revised = revisions(counted(marked, versions), counted(marked.withColumn("text", clean), versions))
    digests = docs.withColumn("digest", F.md5("text")).withColumn("text", clean)
    firsts = digests.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = digests.join(small(written(firsts, "firsts")), "digest").where("doc_id > first")
    ledger.commit("1-insert", inserts(counted(docs, versions)))
    ledger.compact()
    ledger.commit("2-revise", revised)
    ledger.commit("2-revise", revised)
    ledger.commit("3-delete", deletes(counted(copies, versions)))
    return ledger.totals()


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"), revisit_from=0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trie(*branched(sequences(table(spark, sf_dir, "conversations"))))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_bytes").alias("saved_tokens"), "ends_sha256", "pos", "end")


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_span_dedup, op3_hmm, op4_licence_scan, op5_suffix_dedup,
        op6_token_counts, op7_near_dedup, op8_mixing, op9_language_id, op10_decontaminate,
        op11_whitening, op12_warc, op13_prefix_trie,
    )
}

#: Windows of 10 consecutive item words (all of a shorter item's), each at most once for an item, and where they occur.
_OP10 = r"""
with docs as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents),
items as (
  select cast(item_id as varchar) as item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark),
windows as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') as g
  from (select item_id, w, unnest(range(0, len(w) - least(10, len(w)) + 1)) as i from items where len(w) > 0)),
lengths as (select distinct n from windows),
grams as (
  select r, i, n, array_to_string(w[i + 1 : i + n], ' ') as g
  from (select r, w, n, unnest(range(0, len(w) - n + 1)) as i from docs, lengths where len(w) >= n)),
hits as (select r, i, n, item_id from grams join windows using (n, g)),
covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hits) group by r),
named as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from hits group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (r) left join named using (r)
"""

_OP6 = r"""
with docs as (select doc_id, source, lang, text, regexp_replace(text, '[#$%&*|]+', ' ', 'g') as clean, min(doc_id) over (partition by text) as first from documents),
kept as (select source, lang, coalesce(clean, '') as clean from docs where text is null or doc_id is null or doc_id <= first),
counts as (
  select source, lang, 'words-1' as tokenizer, len(regexp_extract_all(clean, '[^\x20\x09-\x0D]+')) as n from kept
  union all
  select source, lang, 'words-2', len(regexp_extract_all(clean, '[0-9A-Za-z\x{80}-\x{10FFFF}]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]')) from kept)
select source, lang, tokenizer, count(*) as n_docs, cast(sum(n) as bigint) as n_tokens from counts group by all
"""

ORACLE = {"op4_licence_scan": licences.oracle_sql(), "op6_token_counts": _OP6, "op10_decontaminate": _OP10}
