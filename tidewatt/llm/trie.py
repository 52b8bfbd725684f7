"""The prefix trie of conversations, as preorder intervals over distributed prefix sums.

A conversation is a sequence of turns, and a node of the trie a distinct sequence of first
turns. A node's key is the exclusive or of digests of its turns, each salted with its place: a running
fold, so keys of all prefixes come from one scan (`scans.running`), long conversations too.
Links are never walked level by level:

* distinct sequences that end in a leaf are ranked lexicographically. Only the digests of turns after
  a branching node are compared, as between these there is one way to go on;
* a node holds the leaves of ranks from `low` to `high`; sorted by (low, depth), nodes stand in
  preorder, and a subtree ends at the place of its last leaf;
* leaves and savings of a subtree are running sums at its end less those before its top.

A leaf's list of branching digests is the only thing collected. Each branch on a path belongs to another sequence,
so a list of b entries needs sequences of b * b / 2 turns in all: at most the root of twice the table's turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import released, small, written
from .scans import running

#: Characters of a piece of the list of conversations that end in a node.
PIECE_CHARS = 1 << 16
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> tuple[Column, Column]:
    """128 bits of a turn in two longs; a null role or text is empty."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    digits = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    return tuple(F.conv(F.substring(digits, at, 16), 16, -10).cast("long") for at in (1, 17))


def sequences(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, place, d1, d2, n_bytes) of a table (conv_id, turn, role, text): turns in order of turn, null first,
    then of digest. Rows with a null conv_id belong to no conversation. A conversation may hold any part of all rows."""
    d1, d2 = turn_digest(turns["role"], turns["text"])
    slim = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", d1.alias("d1"), d2.alias("d2"),
        F.coalesce(F.octet_length(turns["text"].cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
    )
    slim = written(slim, "turns").withColumn("copy", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), *(F.col(c).asc() for c in ("d1", "d2", "copy"))]
    return running(slim, order, group="conv_id").select("conv_id", "place", "d1", "d2", "n_bytes")


def branched(seqs: DataFrame, step: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations c that share their first h turns (all if it has fewer) with c - c % step, h being crc32 of c in
    decimal modulo `most`, and go on with their own turns after their first h: their ids, and their sequences.

    A first conversation has at most `most` - 1 turns shared with at most 2 * step - 1 others (ids below 0 too).
    """
    seqs = written(seqs, "sequences")
    base, h = F.col("conv_id") - F.col("conv_id") % step, F.crc32(F.col("conv_id").cast("string")) % most
    ids = written(seqs.groupBy("conv_id").agg(F.count("*").alias("length")).withColumns({"base": base, "h": h}), "conversations")
    heads = seqs.where((F.col("conv_id") % step == 0) & (F.col("place") < most - 1)).withColumnRenamed("conv_id", "base")
    shared = ids.select("conv_id", "base", "h").join(heads, "base").where("place < h").select(seqs.columns)
    lengths = ids.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    cuts = ids.join(lengths, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("base_length", F.lit(0))).alias("kept"))
    own = seqs.where(F.col("place") >= h).join(cuts, "conv_id").withColumn("place", F.col("kept") + F.col("place") - F.col("h")).select(seqs.columns)
    return ids.select("conv_id"), shared.unionByName(own)


def _ends(rows: DataFrame) -> DataFrame:
    """Of rows (at, conv_id): per `at` the SHA-256 of its ids in decimal, ascending, with commas.

    Ranges of (at, conv_id) are joined to pieces of bounded length, in parallel for one node too; the digest takes a node's pieces
    one after another, as it must."""

    @released
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece, at, held, size, out = TaskContext.get().partitionId(), 0, None, [], 0, []

        def flush() -> None:
            nonlocal piece, held, size
            if held:
                out.append((at, part, piece, ",".join(held)))
                piece, held, size = piece + 1, [], 0

        for batch in batches:
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != at or size >= PIECE_CHARS:
                    flush()
                    at = node
                held.append(str(conv))
                size += len(held[-1]) + 1
            if len(out) > 256:
                yield rows_of(out)
                out = []
        flush()
        if out:
            yield rows_of(out)

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["at", "part", "piece", "ids"])

    @released
    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []

        def close() -> None:
            if state:
                out.append((at, state.hexdigest()))

        for batch in batches:
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if node != at or not state:
                    close()
                    at, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out])], names=["at", "sha"])
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out])], names=["at", "sha"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "at", "conv_id").sortWithinPartitions("at", "conv_id")
    pieces = dealt.mapInArrow(joined, "at long, part long, piece long, ids string")
    return pieces.repartition(n, "at").sortWithinPartitions("at", "part", "piece").mapInArrow(digested, "at long, sha string")


def trie(ids: DataFrame, seqs: DataFrame) -> DataFrame:
    """Per node of conversations `ids` (conv_id, distinct) with turns `seqs` (conv_id, place from 0, d1, d2, n_bytes):
    pos and end (its preorder interval, end included), conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_bytes
    (over its subtree, (n_convs - 1) times the bytes of a node's last text) and ends_sha256.

    The root has depth 0 and holds conversations without turns too. No conversation, no node. Keys have 128 bits.
    """
    salted = {f"x{k}": F.xxhash64(F.lit(k), "place", "d1", "d2") for k in (1, 2)}
    rows = running(seqs.withColumns(salted), [F.col("conv_id").asc(), F.col("place").asc()], group="conv_id", xors=["x1", "x2"], nth="nth")
    rows = rows.select(
        "conv_id", (F.col("place") + 1).alias("depth"), F.col("x1_to").alias("k1"), F.col("x2_to").alias("k2"), "n_bytes",
        F.col("x1_to").bitwiseXOR(F.col("x1")).alias("p1"), F.col("x2_to").bitwiseXOR(F.col("x2")).alias("p2"), "d1", "d2",
    )
    rows = written(rows, "prefixes")

    node, parent = ["depth", "k1", "k2"], ["p_depth", "p1", "p2"]
    firsts = [F.any_value(c).alias(c) for c in ("p1", "p2", "n_bytes")]
    nodes = rows.groupBy(*node).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("least"), *firsts)
    root = ids.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("least")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "n_convs", "least", *(F.lit(None).cast("long").alias(c) for c in ("p1", "p2", "n_bytes")))
    nodes = written(nodes.unionByName(root), "nodes").withColumn("p_depth", F.col("depth") - 1)

    children = nodes.where("depth > 0").groupBy(*parent).agg(F.count("*").alias("n_children"))
    parents = children.select(*(F.col(p).alias(n) for p, n in zip(parent, node, strict=True)), "n_children")
    nodes = written(nodes.join(parents, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    # One conversation for each leaf; those of all leaves pass every node.
    leaves = nodes.where("n_children = 0").select(F.col("least").alias("conv_id"))
    paths = rows.select("conv_id", *node, F.col("depth").alias("r_depth"), "p1", "p2", "d1", "d2").join(leaves, "conv_id", "left_semi")
    paths = written(paths, "paths").withColumn("p_depth", F.col("depth") - 1)
    branching = small(written(nodes.where("n_children > 1").select(*(F.col(n).alias(p) for p, n in zip(parent, node, strict=True))), "branching"))
    letter = F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("d1", "d2")))
    letters = paths.join(branching, parent, "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", letter.alias("l")))).alias("ls"))
    keyed = leaves.join(letters, "conv_id", "left").select("conv_id", F.coalesce(F.array_join("ls.l", ""), F.lit("")).alias("path"))
    ranks = running(keyed, [F.col("path").asc()]).select("conv_id", F.col("place").alias("leaf"))

    spans = paths.select("conv_id", *node).union(leaves.select("conv_id", *(F.lit(0).cast("long") for _ in node)))
    spans = spans.join(written(ranks, "leaf-ranks"), "conv_id").groupBy(*node).agg(F.min("leaf").alias("low"), F.max("leaf").alias("high"))
    saved = F.coalesce((F.col("n_convs") - 1) * F.col("n_bytes"), F.lit(0))
    placed = nodes.join(spans, node).withColumns({"saved": saved, "is_leaf": (F.col("n_children") == 0).cast("long")})
    placed = written(running(placed, [F.col("low").asc(), F.col("depth").asc()], sums=["saved", "is_leaf"]), "preorder")

    ends = placed.where("is_leaf = 1").select(F.col("low").alias("high"), F.col("place").alias("end"), F.col("saved_to").alias("saved_end"), F.col("is_leaf_to").alias("leaves_end"))
    named = placed.select(*(F.col(n).alias(p) for p, n in zip(parent, node, strict=True)), F.col("least").alias("parent_conv_id"))
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct(*node), "depth").alias("at"))
    last = ids.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(F.col("at")[n], F.lit(0)).alias(n) for n in node))
    members = _ends(last.join(placed.select(*node, F.col("place").alias("at")), node).select("at", "conv_id"))
    out = placed.join(ends, "high").join(named, parent, "left").join(members.withColumnRenamed("at", "place"), "place", "left")
    return out.select(
        F.col("place").alias("pos"), "end", F.col("least").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves_end") - F.col("is_leaf_to") + F.col("is_leaf")).alias("n_leaves"),
        (F.col("saved_end") - F.col("saved_to") + F.col("saved")).alias("saved_bytes"),
        F.coalesce("sha", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )
