"""MinHash near-duplicate detection with tensored banding and exact verification.

Two small collections of sketches, A and B, are computed per document; each sketch
joins two minhashes. Table (i, j) is keyed by sketch A_i together with sketch B_j, so
`SKETCHES` squared tables come from 4 * SKETCHES minhashes instead of 4 * SKETCHES**2.
A pair of similarity s meets in a table unless all sketches of one collection differ:
missed with probability 2 * (1 - s**2)**SKETCHES, about 1e-4 at s = 0.75.

Candidates are confirmed on the full shingle sets. Documents with equal sets are one
class, and a class is a node. A table key can only be shared if both its sketches are, so
sketches that one class alone has are dropped before keys are formed. In every table key,
members are compared with a leader, not with each other;
links join them to components, and only keys that still hold several components go on.
What remains after `LEADER_ROUNDS` is compared exactly, block against block, within the
groups that shared keys connect; a block comparison returns one link per document and
component, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import counts, released, scope, small, text_of, written
from ._hashing import mix, shingle_set
from .components import connected_components

SKETCHES = 12
WIDTH = 5
THRESHOLD = 75  # per cent
LEADER_ROUNDS = 3
BLOCK = 256
#: Shingles of a block, so that two blocks of long texts fit in a worker.
VOLUME = 1_000_000
SLICE = 8192

_rng = np.random.default_rng(20240131)
_MULTIPLY = _rng.integers(1, 2**63, size=4 * SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, size=4 * SKETCHES, dtype=np.uint64)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of 4 * SKETCHES hash functions over a set, in slices of bounded memory."""
    least = np.full(4 * SKETCHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 8192):
        np.minimum(least, (shingles[at : at + 8192, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return least


@released
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        n, sets = len(batch), [shingle_set(t) for t in batch.column("text").to_pylist()]
        mins = np.array([minhashes(s) for s in sets], dtype=np.uint64).reshape(n, 2 * SKETCHES, 2)
        both = mix(mins[:, :, 0] * np.uint64(0x9E3779B97F4A7C15) + mins[:, :, 1]).view(np.int64)
        digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        ends = pa.array(np.arange(0, 2 * SKETCHES * n + 1, 2 * SKETCHES, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(both.ravel()))],
            names=["doc_id", "text_key", "n_shingles", "set_digest", "sketches"],
        )


@released
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(sets, pa.list_(pa.int64()))], names=["text_key", "shingles"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    one = sets.select(F.col("c").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("c").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(one, "a").join(two, "b")
        .where(100 * common >= THRESHOLD * (F.size("sa") + F.size("sb") - common))
        .select("a", "b")
    )


def block_links(rows: pa.Table) -> pa.Table:
    """Links between the rows of side 0 and of side 1 (of side 0 among themselves if there are no others), which are columns
    c, component, side, shingles: for each class and each other component the least partner. Shared shingles are
    counted a slice at a time, so memory is bounded by the sets themselves."""
    c, component, side = (rows.column(n).to_numpy() for n in ("c", "component", "side"))
    sets = rows.column("shingles").combine_chunks()
    sizes = sets.value_lengths().to_numpy()
    ids, codes = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
    codes = codes[order]
    first = np.flatnonzero(side == 0)
    second = np.flatnonzero(side == 1) if (side == 1).any() else first
    common = np.zeros((len(first), len(second)))
    for lo in range(0, len(ids), SLICE):
        part = slice(*np.searchsorted(codes, (lo, lo + SLICE)))
        has = np.zeros((len(sizes), SLICE), np.float32)
        has[owner[part], codes[part] - lo] = 1
        common += has[first] @ has[second].T
    union = sizes[first][:, None] + sizes[second][None, :] - common
    i, j = np.nonzero((100 * common >= THRESHOLD * union) & (component[first][:, None] != component[second][None, :]))
    a, b, other = c[first][i], c[second][j], component[second][j]
    place = np.lexsort((b, other, a))
    a, b, other = a[place], b[place], other[place]
    least = np.ones(len(a), bool)
    least[1:] = (a[1:] != a[:-1]) | (other[1:] != other[:-1])
    return pa.table({"a": pa.array(a[least], pa.int64()), "b": pa.array(b[least], pa.int64())})


def _remaining_links(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """All links between different components within the groups that shared keys connect, block by block."""
    heads = small(written(keys.groupBy("key").agg(F.min("c").alias("b")), "heads"))
    edges = keys.join(heads, "key").select(F.col("c").alias("a"), "b")
    groups = connected_components(edges).select(F.col("node").alias("c"), F.col("component").alias("part"))
    members = written(keys.select("c", "component").distinct().join(groups, "c"), "members")
    volume = members.join(sets.select("c", "n"), "c").groupBy("part").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    size = volume.select("part", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("n") / VOLUME)).cast("int").alias("blocks"))
    placed = members.join(small(written(size, "size")), "part").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).join(sets.drop("n"), "c")
    meets = F.explode(
        F.expr("transform(sequence(0, blocks - 1), x -> struct(least(block, x) as lo, greatest(block, x) as hi, int(block > x) as side))")
    ).alias("m")
    cells = placed.select("part", "c", "component", "shingles", "block", meets).select("*", "m.*")
    return cells.groupBy("part", "lo", "hi").applyInArrow(block_links, "a long, b long")


def _shared_keys(classes: DataFrame) -> DataFrame:
    """Rows (key, c, leader): the table keys that several classes have, and the least of these."""
    each = classes.select("c", F.posexplode("sketches").alias("i", "x")).select("c", (F.col("i") < SKETCHES).alias("first"), F.xxhash64("i", "x").alias("s"))
    shared = written(each.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("s"), "shared")
    live = each.join(small(shared), "s").groupBy("c").agg(F.collect_list(F.expr("if(first, s, null)")).alias("a"), F.collect_list(F.expr("if(first, null, s)")).alias("b"))
    live = written(live.where("size(a) > 0 and size(b) > 0"), "live")
    rows = live.select("c", F.explode("a").alias("x"), "b").select("c", "x", F.explode("b").alias("y")).select(F.xxhash64("x", "y").alias("key"), "c")
    led = written(rows.groupBy("key").agg(F.min("c").alias("leader"), F.max("c").alias("hi")).where("leader < hi").drop("hi"), "led")
    return written(rows.join(small(led), "key"), "keys")


def _class_links(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of the classes that one doc_id belongs to, where an id has several texts."""
    code = F.xxhash64("set_digest")
    ids = full.where("doc_id is not null").groupBy("doc_id").agg(F.min(code).alias("lo"), F.max(code).alias("hi")).where("lo < hi").select("doc_id")
    ids = written(ids, "ids")
    if not counts(ids)["rows"]:
        return full.sparkSession.createDataFrame([], "a long, b long")
    owned = written(full.join(small(ids), "doc_id").join(classes.select("set_digest", "c"), "set_digest").select("doc_id", "c").distinct(), "owned")
    least = small(written(owned.groupBy("doc_id").agg(F.min("c").alias("a")), "least"))
    return written(owned.join(least, "doc_id").where("a < c").select("a", F.col("c").alias("b")), "links")


def _placed(docs: DataFrame, full: DataFrame) -> DataFrame:
    """A written table (set_digest, component_id, least_key): the component of each set, by its least doc_id and text_key."""
    classes = full.groupBy("set_digest").agg(F.min("doc_id").alias("first"), F.min("text_key").alias("text_key"), F.any_value("sketches").alias("sketches"))
    # Numbers are given as the table is written and read from it after.
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")

    keys = _shared_keys(classes)
    reps = written(keys.select("c").distinct().join(classes.select("c", "text_key"), "c"), "reps")
    texts = docs.join(small(reps.select("text_key")), "text_key", "left_semi").groupBy("text_key").agg(F.any_value("text").alias("text"))
    sets = written(texts.mapInArrow(_sets, "text_key binary, shingles array<long>").join(reps, "text_key").select("c", "shingles", F.size("shingles").alias("n")), "sets")

    links = _class_links(full, classes)
    pairs = keys.where("leader <> c").select(F.col("leader").alias("a"), F.col("c").alias("b")).distinct()
    keys = keys.select("key", "c")
    last = LEADER_ROUNDS
    for turn in range(LEADER_ROUNDS + 1):
        if turn >= last:
            found = _remaining_links(keys.withColumn("component", F.col("c")) if not turn else keys, sets)
        else:
            if turn:
                order = F.struct(F.xxhash64("c", F.lit(turn)).alias("o"), "c", "component")
                led = keys.join(keys.groupBy("key").agg(F.min(order).alias("leader")), "key").where("leader.component <> component")
                pairs = led.select(F.least("c", "leader.c").alias("a"), F.greatest("c", "leader.c").alias("b")).distinct()
            found = _verified(pairs, sets)
        found = written(found, "found")
        if turn and not counts(found)["rows"]:  # components stay; what leaders didn't find goes to the exact step
            if turn >= last:
                break
            last = turn + 1
            continue
        # What was linked before stands as stars, so only new links make components grow.
        parts = connected_components(links.union(found))
        links = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
        keys = keys.select("key", "c").join(parts.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
        keys = written(keys, "placed")
        mixed = keys.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        keys = written(keys.join(mixed, "key", "left_semi"), "keys")
        if turn >= last or not counts(keys)["rows"]:
            break

    placed = classes.join(parts.withColumnRenamed("node", "c"), "c", "left").select("set_digest", "first", "text_key", F.coalesce("component", "c").alias("component"))
    placed = written(placed, "placed")
    heads = written(placed.groupBy("component").agg(F.min("first").alias("component_id"), F.min("text_key").alias("least_key")), "heads")
    return written(placed.join(small(heads), "component").select("set_digest", "component_id", "least_key"), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable over links), kept, text_key (MD5 of the text).

    Words are runs without ASCII white space, A-Z lower-cased; a set has the distinct
    5-word shingles, or the whole sequence if there are fewer words. Null, empty or blank
    texts have an empty set and link to nothing. Rows with one doc_id and different texts count
    as one document: the links of each text are its links. A row without doc_id belongs to the
    component of its text and is not kept if that holds an id; of a component without any id the
    text of least text_key is kept, and component_id is null. Any other columns are ignored. doc_id is a whole number; ids that can't be read as one fail.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("text_key", F.unhex(F.md5("text")))
    sketches = written(docs.mapInArrow(_sketch, "doc_id long, text_key binary, n_shingles long, set_digest binary, sketches array<long>"), "sketches")
    full = sketches.where("n_shingles > 0")
    with scope(docs.sparkSession) as held:
        placed = _placed(docs, full)
        held.drop()
    member = full.select("doc_id", "n_shingles", "text_key", "set_digest").join(small(placed), "set_digest").drop("set_digest")
    lone = sketches.where("n_shingles = 0").select("doc_id", "n_shingles", "text_key", F.col("doc_id").alias("component_id"), F.col("text_key").alias("least_key"))
    kept = F.when(F.col("component_id").isNull(), F.col("text_key") == F.col("least_key")).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return member.unionByName(lone).select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_key")
