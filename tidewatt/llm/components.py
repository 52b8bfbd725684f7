"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import counts, scope, written


def connected_components(links: DataFrame) -> DataFrame:
    """Of links (a, b): rows (node, component), component being the least node reachable.

    A round is one job: a minimum per node, summed up in the map tasks, and joins on the node that Spark splits where a node has
    very many links, or broadcasts where it has measured the other side as small. The links are written to the shared
    folder after each round, and rounds grow with the logarithm of the longest path. Rounds end when
    the number of links and a digest over all of them, taken as they are written, stay as they are. Null ends and loops are left out; an
    empty table gives no rows.
    """
    digest = F.bit_xor(F.xxhash64("u", "v")).alias("digest")
    with scope(links.sparkSession) as held:
        edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", digest)
        while True:
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            star = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
            before, edges = counts(edges), written(star.where("u <> v").distinct(), "star", digest)
            held.drop()
            after = counts(edges)
            if (before["rows"], before["digest"]) == (after["rows"], after["digest"]):
                break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
