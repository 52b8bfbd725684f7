"""Mixing sources to target weights by weighted sampling without replacement, in DataFrame functions only.

Efraimidis-Spirakis keys -ln(u) / weight, with u drawn from a hash of the document, order
the documents of each source; sizes are summed along that order up to the source's budget.
A source whose target holds its size several times gives that many complete epochs first.

No source is sorted in one task: a histogram of its keys deals them into buckets of about
BUCKET_ROWS rows, whose sizes are summed in two levels, and only inside a bucket are
documents ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import n_words, small, text_of, written

MOST_EPOCHS = 3
WEIGHTS = (1, 2, 3)
BUCKET_ROWS = 500
STEPS = 64
SEED = 8
LEAST_WEIGHT = 1e-9
DIGITS_AND_SIGNS = "0123456789#$%&*+<=>@[]^_`{|}~\\/"


def quality_weight(text: Column) -> Column:
    """Sampling weight from the text alone: the square of its share of characters other than digits and signs, at least 0.05."""
    plain = F.length(F.translate(text, DIGITS_AND_SIGNS, ""))
    return F.greatest(F.lit(0.05), F.pow(F.try_divide(plain.cast("double"), F.length(text)), F.lit(2.0)))


def _ranked(sizes: DataFrame) -> DataFrame:
    """Sources with `rank`, from 0 in the order of their code points, null last: ranked within ranges, to which the rows
    of the ranges before are added, so no task orders all sources."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = written(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    rows = ranged.groupBy("part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = small(written(rows.select("part", before.alias("before")), "starts"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return ranged.join(starts, "part").select("source", "source_size", (F.col("before") + inside).alias("rank"))


def targets(sizes: DataFrame) -> DataFrame:
    """Of rows (source, source_size): with `target`, shares of the whole by the weights 1, 2, 3 of the sources in order,
    none over MOST_EPOCHS times its size, the excess shared again.

    Sharing again until none is over ends at one level: a source gets weight * level, or its cap if that is less.
    The level rises with each sharing and ends, as it does, where no further source is over; a sharing is one
    aggregate over the sources, and brings one row to the driver.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod("rank", F.lit(len(WEIGHTS))).cast("int") + 1).cast("double")
    capped = written(_ranked(sizes).select("source", "source_size", weight.alias("w"), (MOST_EPOCHS * F.col("source_size")).cast("double").alias("cap")), "capped")
    level, n_over = 0.0, -1
    while True:
        over = F.col("cap") < F.col("w") * level
        r = capped.agg(
            F.sum("source_size").alias("words"), F.sum(F.when(over, F.col("cap"))).alias("capped"),
            F.sum(F.when(~over, F.col("w"))).alias("free"), F.count(F.when(over, F.lit(1))).alias("over"),
        ).first()
        if not r.free or r.over == n_over:
            break
        level, n_over = ((r.words or 0) - (r.capped or 0.0)) / r.free, r.over
    return capped.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken (words the mix takes), epochs.

    size is the number of words, 0 for a null or blank text. taken is size times the complete epochs, and in
    the last, fractional selection size again for documents before the budget's end; the document at the end
    gives the words that are left. A null source is a source. Equal rows have equal keys and are taken one after
    another; of ties any order gives the same totals, and rows are told apart by doc_id, then text. A source
    without words takes nothing. `weight` is a column of `docs`, by default `quality_weight`; null weighs 1, and what is below LEAST_WEIGHT (0,
    negative, not a number) as much as that: such documents come last, among themselves by chance.
    """
    text = text_of(docs)
    u = (F.pmod(F.xxhash64(docs["doc_id"], F.md5(text), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weight = F.coalesce((quality_weight(text) if weight is None else weight).cast("double"), F.lit(1.0))
    key = -F.log(u) / F.greatest(F.nanvl(weight, F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))
    sized = docs.select("doc_id", docs["source"].cast("string").alias("source"), n_words(text).alias("size"), key.alias("key"), F.xxhash64(text).alias("tie"))
    sized = written(sized, "sized")

    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    epochs = F.floor(F.try_divide("target", "source_size") + 1e-9)
    sources = sources.withColumn("epochs", F.coalesce(epochs, F.lit(0)).cast("long"))
    sources = sources.withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    of_source = small(written(sources.withColumnRenamed("source", "s"), "targets"))

    # A histogram of the keys of each source, in steps of a 64th of a power of two, tells where its keys lie, whatever
    # the weights; a step with more than BUCKET_ROWS rows is cut evenly into as many buckets as it needs.
    place = F.log2(F.greatest("key", F.lit(1e-300))) * STEPS
    ranked = sized.withColumn("step", F.floor(place).cast("int")).withColumn("within", place - F.floor(place))
    steps = ranked.groupBy("source", "step").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = steps.select("source", "step", before.alias("before_step"), F.ceil(F.col("rows") / BUCKET_ROWS).alias("buckets"))  # 64 rows a power of two
    steps = small(written(steps, "steps").withColumnRenamed("source", "s").withColumnRenamed("step", "t"))
    ranked = ranked.join(steps, F.col("source").eqNullSafe(F.col("s")) & (F.col("step") == F.col("t"))).drop("s", "t")
    ranked = ranked.withColumn("bucket", F.floor(F.col("within") * F.col("buckets")).cast("long"))

    in_bucket = ranked.groupBy("source", "step", "bucket").agg(F.sum("size").alias("words"), F.any_value("before_step").alias("before_step"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source", "step").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = in_bucket.select(F.col("source").alias("s"), F.col("step").alias("t"), F.col("bucket").alias("b"), (F.col("before_step") + before).alias("start"))
    starts = small(written(starts, "starts"))
    placed = ranked.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("step") == F.col("t")) & (F.col("bucket") == F.col("b"))).drop("s", "t", "b")
    placed = placed.join(of_source, F.col("source").eqNullSafe(F.col("s")))
    inside = Window.partitionBy("source", "step", "bucket").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - before))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), "epochs")
