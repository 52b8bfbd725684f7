"""Exact removal of repeated byte strings by external suffix sorting.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Texts
are cut for sorting where their content says: the least hash of GRAM bytes among those of
a window of LENGTH bytes is the window's anchor, so equal windows have equal anchors, and
consecutive windows with one anchor form a context. Only contexts whose anchor also
occurs elsewhere can hold repeated windows. Equal contexts are one, with a count. The
others, with their bytes, are dealt by anchor into shards; each shard is read as a stream,
its suffixes are sorted by induction in chunks of bounded size (`induced.py`), and common
prefixes of neighbours tell which windows are the same. An anchor with very many contexts
is dealt over several shards; what these leave open is joined on digests of the windows.

Spark's own sorted, disk-backed shuffle carries the suffix material between chunks, so no
task keeps more than a chunk in memory and nothing lies in a folder of one machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import released, small, written
from ._hashing import BASE, mix
from .induced import common_prefix_at_least, suffix_array

LENGTH = 200
GRAM = 64
SEGMENT = 1 << 20
#: Bytes of contexts that are sorted at once, and contexts of one anchor in a shard.
CHUNK = 2 << 20
HOT_CONTEXTS = 4096


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def contexts(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, anchor position, first window, last window) of each context, in stretches of bounded size."""
    windows = LENGTH - GRAM + 1
    raw = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, len(raw) - LENGTH + 1, SEGMENT):
        part = raw[at : at + SEGMENT + LENGTH - 1]
        grams, length = mix(part.astype(np.uint64) + np.uint64(1)), 1
        while length < GRAM:
            grams = grams[:-length] * np.uint64(pow(BASE, length, 1 << 64)) + grams[length:]
            length *= 2
        grams = mix(grams)
        keys = (grams & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64))
        span = 1
        while span * 2 <= windows:
            keys = np.minimum(keys[:-span], keys[span:])
            span *= 2
        keys = np.minimum(keys[: len(keys) - (windows - span)], keys[windows - span :]) if span < windows else keys
        anchors = (np.uint64(0xFFFFFFFF) - (keys & np.uint64(0xFFFFFFFF))).astype(np.int64)
        first = np.flatnonzero(np.diff(anchors, prepend=-1))
        last = np.append(first[1:], len(anchors)) - 1
        yield grams[anchors[first]].view(np.int64), anchors[first] + at, first + at, last + at


@released
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of each text; those that occur again in the batch are one row, with the other places in `more`."""
    import xxhash

    place = pa.struct([("doc", pa.int64()), ("at", pa.int64())])
    for batch in batches:
        for start in range(0, len(batch), 2048):
            part = batch.slice(start, 2048)
            found: dict[tuple[int, int, int], list] = {}
            for doc, weight, text in zip(*(part.column(c).to_pylist() for c in ("doc", "weight", "text")), strict=True):
                data = _bytes(text)
                for anchor, where, first, last in contexts(data):
                    for h, a, i, j in zip(anchor.tolist(), where.tolist(), first.tolist(), last.tolist(), strict=True):
                        digest = xxhash.xxh3_64_intdigest(data[i : j + LENGTH], a - i) - (1 << 63)
                        known = found.get((h, digest, j - i))
                        if known is None:
                            found[h, digest, j - i] = [weight, doc, i, None]
                        else:
                            known[0] += weight
                            known[3] = [*(known[3] or ()), {"doc": doc, "at": i}]
            keys, rest = list(found), list(found.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int32()),
                 *(pa.array([r[i] for r in rest], pa.int64()) for i in range(3)), pa.array([r[3] for r in rest], pa.list_(place))],
                names=["anchor", "context", "last", "m", "doc", "at", "more"],
            )


@released
def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted contexts of each text."""
    for batch in batches:
        for start in range(0, len(batch), 256):
            rows = []
            part = batch.slice(start, 256)
            for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist(), strict=True):
                data = _bytes(text)
                rows += [(w["anchor"], w["context"], w["last"], w["salt"], w["m"], data[w["at"] : w["at"] + w["last"] + LENGTH]) for w in wanted]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["anchor", "context", "last", "salt", "m", "bytes"])


def repeated_windows(bytes_: list[bytes], m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts with counts m: for every window of theirs in suffix order, its context, its offset, how often it
    occurs, and whether it is the first of its like."""
    sizes = np.array([len(b) for b in bytes_])
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), dtype=np.int16)
    data = np.frombuffer(b"\0".join([*bytes_, b""]) or b"\0", dtype=np.uint8)
    text[:] = data
    text += 1
    text[starts + sizes] = 0  # an end is less than any byte
    order = suffix_array(text)
    owner = np.repeat(np.arange(len(bytes_)), sizes + 1)
    order = order[order - starts[owner[order]] <= (sizes - LENGTH)[owner[order]]]
    new = np.append(True, ~common_prefix_at_least(data, order[1:], order[:-1], LENGTH))
    group = np.cumsum(new) - 1
    of = owner[order]
    return of, order - starts[of], np.bincount(group, weights=m[of]).astype(np.int64)[group], new


def _ranges(offsets: np.ndarray) -> list[dict]:
    """Sorted distinct offsets as runs of consecutive ones."""
    cuts = np.flatnonzero(np.diff(offsets) > 1) + 1
    return [{"lo": int(p[0]), "hi": int(p[-1])} for p in np.split(offsets, cuts)] if len(offsets) else []


@released
def _sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts the suffixes of contexts that come ordered by anchor and salt, a chunk of whole groups at a time."""
    import xxhash

    span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    left = pa.list_(pa.struct([("off", pa.int32()), ("digest", pa.binary()), ("single", pa.bool_())]))

    def solved(held: list[tuple]) -> pa.RecordBatch:
        bytes_ = [r[4] for r in held]
        of, offset, times, new = repeated_windows(bytes_, np.array([r[3] for r in held]))
        order = np.lexsort((offset, of))
        of, offset, times, new = of[order], offset[order], times[order], new[order]
        cuts = np.searchsorted(of, np.arange(len(held) + 1))
        ranges, open_ = [], []
        for k, r in enumerate(held):
            own = slice(cuts[k], cuts[k + 1])
            o, n = offset[own], times[own]
            ranges.append(_ranges(o[n > 1]))
            # Of an anchor in several shards: a row for each different window, so that other shards learn of it.
            heads = zip(o[new[own]], n[new[own]], strict=True) if r[2] >= 0 else ()
            open_.append([{"off": int(x), "digest": xxhash.xxh3_128_digest(r[4][x : x + LENGTH]), "single": bool(y == 1)} for x, y in heads])
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.int64()), pa.array(ranges, span), pa.array(open_, left)], names=["anchor", "context", "spans", "open"])

    held, size, last = [], 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "salt", "m", "bytes")), strict=True):
            if size > CHUNK and (row[0], row[2]) != last:
                yield solved(held)
                held, size = [], 0
            last = (row[0], row[2])
            held.append(row)
            size += len(row[4])
    if held:
        yield solved(held)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Rows (doc, spans): for each text, by hash, the runs (lo, hi) of starts of repeated windows."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc"), "text").where(F.octet_length("text") >= LENGTH)
    copies = texts.groupBy("doc").agg(F.count("*").alias("weight"), F.min("doc_id").alias("first")).where("weight > 1")
    copies = small(written(copies, "copies")).withColumnRenamed("doc", "copied")
    # Of equal texts one is cut, with their count; rows that even share the doc_id are cut each.
    one = texts.join(copies, F.col("doc") == F.col("copied"), "left").where("copied is null or doc_id <=> first")
    cut = one.select("doc", F.coalesce("weight", F.lit(1)).alias("weight"), "text").mapInArrow(
        _cut, "anchor long, context long, last int, m long, doc long, at long, more array<struct<doc: long, at: long>>"
    )
    # Counts are summed before the shuffle, and joined to written tables, so an anchor that is everywhere can be split.
    cut = written(cut, "contexts")
    shared = written(cut.groupBy("anchor").agg(F.sum("m").alias("n")).where("n > 1").select("anchor"), "shared")
    met = written(cut.join(shared.hint("merge"), "anchor"), "met")

    kinds = written(met.groupBy("anchor", "context", "last").agg(F.sum("m").alias("m"), F.min(F.struct("doc", "at")).alias("place")), "kinds")
    per_anchor = small(written(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "per-anchor"))
    salt = F.when(F.col("kinds") <= HOT_CONTEXTS, F.lit(-1)).otherwise(F.pmod("context", F.ceil(F.col("kinds") / HOT_CONTEXTS)).cast("int"))
    wanted = kinds.join(per_anchor, "anchor").select("anchor", "context", "last", salt.alias("salt"), "m", "place.doc", "place.at")
    by_doc = written(wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "context", "last", "salt", "m", "at")).alias("wanted")), "wanted")
    sources = small(by_doc.select("doc"))
    fetched = one.join(sources, "doc", "left_semi").select("doc", "text").dropDuplicates(["doc"]).join(by_doc, "doc").select("text", "wanted")
    fetched = fetched.mapInArrow(_fetch, "anchor long, context long, last int, salt int, m long, bytes binary")
    shards = fetched.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "context")
    solved = shards.mapInArrow(
        _sort_shard, "anchor long, context long, spans array<struct<lo: int, hi: int>>, open array<struct<off: int, digest: binary, single: boolean>>"
    )
    solved = written(solved, "solved")

    # Windows of anchors dealt over several shards that were single in theirs: counted over all shards.
    open_ = solved.select("anchor", "context", F.explode("open").alias("o")).select("anchor", "context", "o.*")
    also = open_.groupBy("anchor", "digest").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "digest")
    own = solved.select("anchor", "context", F.explode("spans").alias("s")).select("anchor", "context", "s.lo", "s.hi")
    late = open_.where("single").join(also, ["anchor", "digest"]).select("anchor", "context", F.col("off").alias("lo"), F.col("off").alias("hi"))
    found = own.union(late).groupBy("anchor", "context").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    whole = kinds.where("m > 1").select("anchor", "context", F.array(F.struct(F.lit(0).alias("lo"), F.col("last").alias("hi"))).alias("spans"))
    spans = found.join(whole, ["anchor", "context"], "left_anti").union(whole)

    places = met.select("anchor", "context", F.explode(F.concat(F.array(F.struct("doc", "at")), F.coalesce("more", F.array().cast("array<struct<doc: bigint, at: bigint>>")))).alias("p"))
    hit = places.join(written(spans, "spans"), ["anchor", "context"]).select("p.doc", "p.at", F.explode("spans").alias("s"))
    return hit.groupBy("doc").agg(F.collect_list(F.struct((F.col("at") + F.col("s.lo")).alias("lo"), (F.col("at") + F.col("s.hi")).alias("hi"))).alias("spans"))


@released
def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, counts = [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data = _bytes(text)
            edge = np.zeros(len(data) + 1, dtype=np.int32)
            for s in spans or ():
                edge[s["lo"]] += 1
                edge[s["hi"] + LENGTH] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            kept.append(np.frombuffer(data, dtype=np.uint8)[~gone].tobytes() if spans else data)
            counts.append((len(data), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())))
        columns = list(zip(*counts, strict=True)) or [(), (), ()]
        keep = [c for c in batch.schema.names if c not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in columns), pa.array(kept, pa.binary())], names=[*keep, "n_bytes", "n_removed", "n_spans", "kept"]
        )


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes that stay).

    Texts are their UTF-8 bytes, null the empty text; matches never cross documents. Every row is a document of
    its own, so equal rows remove each other's strings. Texts shorter than LENGTH lose nothing. Texts are told
    apart by a 64-bit hash. Other columns are ignored.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    spans = repeated_spans(texts)
    joined = texts.withColumn("doc", F.xxhash64("text")).join(spans, "doc", "left").select("doc_id", "text", "spans")
    kind = texts.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
