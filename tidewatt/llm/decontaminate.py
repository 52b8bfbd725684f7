"""Benchmark decontamination by winnowing, with DataFrame functions only.

On both sides the least hash of the 5-word grams is kept in every window of 6
consecutive grams, so any shared run of 10 words has a kept gram in common. Equal kept
grams are hits; each hit fixes how a document lies against an item, and along that
alignment the words are compared one by one: every run of 10 equal words (all words,
for an item of fewer) is an occurrence. Items shorter than 10 words keep every gram of
min(5, n) words, and documents are then searched with all their grams of that length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import small, text_of, written

GRAM = 5
SPAN = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII other than digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, only A-Z lower-cased (`lower` would change other letters too, so it is kept to ASCII texts)."""
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(folded, BREAK), lambda w: w != "")


def grams_of(words: str, k: int) -> Column:
    """Hashes of the runs of k words, in order; none where there are fewer words."""
    parts = ", ".join(f"get({words}, i + {j})" for j in range(k))
    return F.expr(f"case when size({words}) >= {k} then transform(sequence(0, size({words}) - {k}), i -> xxhash64({parts})) else array() end")


def kept_of(grams: str, window: int) -> Column:
    """The least hash of each window of that many consecutive grams; equal hashes are equal grams, so ties need no rule here."""
    slide = ", ".join(f"get({grams}, i + {j})" for j in range(window))
    return F.expr(
        f"case when size({grams}) >= {window} then array_distinct(transform(sequence(0, size({grams}) - {window}), i -> least({slide}))) "
        f"when size({grams}) > 0 then array(array_min({grams})) else array() end"
    )


def _hits(docs: DataFrame, items: DataFrame, k: int, winnowed: bool) -> DataFrame:
    """Alignments (doc_key, item_id, item, shift) of documents and items that share a gram of k words. A place of a gram is a row of
    bounded width, whatever the item's length."""
    fewest = SPAN if winnowed else 0
    items = items.withColumn("grams", grams_of("item_words", k))
    prints = items.select(F.explode(kept_of("grams", SPAN - k + 1) if winnowed else F.col("grams")).alias("gram")).distinct()
    places = items.where(F.size("item_words") >= fewest).select("item_id", "item", F.posexplode("grams").alias("q", "gram"))

    grams = docs.select("doc_key", grams_of("words", k).alias("grams"))
    kept = grams.select("doc_key", F.explode(kept_of("grams", SPAN - k + 1) if winnowed else F.array_distinct("grams")).alias("gram"))
    met = written(kept.join(small(written(prints, "prints")), "gram").select("doc_key", "gram").distinct(), "met")

    found = docs.join(small(written(met.select("doc_key").distinct(), "found")), "doc_key", "left_semi").dropDuplicates(["doc_key"])
    at = found.select("doc_key", F.posexplode(grams_of("words", k)).alias("p", "gram")).join(met, ["doc_key", "gram"])
    return at.join(small(written(places, "places")), "gram").select("doc_key", "item_id", "item", (F.col("p") - F.col("q")).alias("shift")).distinct()


def occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A written table (doc_key, item_id, shift, q, span): the item's windows of `span` words, from its word q, that
    occur in the text with that key (`key_of`) from its word shift + q. Equal texts share one search."""
    base = docs.select(key_of(text_of(docs)).alias("doc_key"), words_of(text_of(docs)).alias("words"))
    item_id = F.coalesce(benchmark["item_id"].cast("string"), F.lit(""))
    items = benchmark.select(item_id.alias("item_id"), words_of(text_of(benchmark)).alias("item_words")).where(F.size("item_words") > 0)
    items = written(items.withColumn("item", key_of(F.array_join("item_words", " "))).dropDuplicates(["item_id", "item"]), "items")

    long_items = items.where(F.size("item_words") >= SPAN)
    aligned = _hits(base, long_items, GRAM, True)
    short = items.where(F.size("item_words") < SPAN)
    for k in sorted(r.k for r in short.select(F.least(F.size("item_words"), F.lit(GRAM)).alias("k")).distinct().collect()):  # at most GRAM lengths
        aligned = aligned.union(_hits(base, short.where(F.least(F.size("item_words"), F.lit(GRAM)) == k), k, False))
    aligned = written(aligned, "aligned")

    found = base.join(small(written(aligned.select("doc_key").distinct(), "aligned-docs")), "doc_key", "left_semi").dropDuplicates(["doc_key"])
    # An alignment carries the words it lies on, not the whole text; written, so that the slice is cut once.
    lead = F.greatest(F.lit(0), -F.col("shift"))
    cut = F.slice("words", F.greatest(F.col("shift"), F.lit(0)) + 1, F.size("item_words") - lead)
    facing = aligned.join(found, "doc_key").join(small(items), ["item_id", "item"])
    facing = written(facing.select("doc_key", "item_id", "shift", "item_words", lead.alias("lead"), cut.alias("facing")), "facing")
    equal = F.expr("transform(item_words, (w, q) -> q >= lead and coalesce(get(facing, q - lead) = w, false))")
    span = F.expr(f"least({SPAN}, size(item_words))")
    starts = F.expr("filter(sequence(0, size(item_words) - span), q -> forall(slice(equal, q + 1, span), e -> e))")
    hits = facing.select("doc_key", "item_id", "shift", equal.alias("equal"), span.alias("span"), "item_words")
    return written(hits.select("doc_key", "item_id", "shift", F.explode(starts).alias("q"), "span"), "hits")


def key_of(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts the words inside any occurrence of any item's window; n_items the items
    with occurring windows; items_sha256 digests their ids, sorted as strings and joined
    by commas (of the empty string where there are none). Null or wordless texts have no
    words and no hits, wordless items no windows. Repeated items count once per item_id;
    items without id count as one whose id is the empty string.
    Rows with equal texts share one search. Columns other than doc_id, text, item_id are ignored.
    """
    docs = docs.select(F.col("doc_id"), text_of(docs).alias("text"))
    counted = docs.select("doc_id", key_of(F.col("text")).alias("doc_key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    counted = written(counted, "counted")
    hits = occurrences(docs, benchmark)
    covered = hits.select("doc_key", F.explode(F.expr("sequence(shift + q, shift + q + span - 1)")).alias("p")).distinct().groupBy("doc_key").agg(F.count("*").alias("n_hit"))
    named = hits.select("doc_key", "item_id").distinct().groupBy("doc_key").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    digest = F.sha2(F.array_join("ids", ","), 256)
    found = covered.join(named, "doc_key").select("doc_key", "n_hit", F.size("ids").cast("long").alias("n_items"), digest.alias("items_sha256"))
    # Written and counted: broadcast, or else shuffled anew, so that a text with very many copies can be split.
    result = counted.join(small(written(found, "found-items")), "doc_key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return result.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
