"""Document fingerprints by winnowing, and how alike neighbours in a table are.

Hashes of all runs of K bytes roll over the UTF-8 text; of each WINDOW consecutive ones
the least is kept, the rightmost where several are least, with its position. Two texts
that share WINDOW + K - 1 bytes share a kept hash there, at matching positions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hashing import BASE, mix

K = 16
WINDOW = 16
SEGMENT = 1 << 20
#: Bytes of text that a task takes at most, about; beyond the shuffle partitions there are as many tasks as that needs.
TASK_BYTES = 64 << 20


def _gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all runs of k bytes, by doubling."""
    done, out, length = 0, None, 1
    power = mix(raw.astype(np.uint64) + np.uint64(1))
    n = len(raw) - k + 1
    while True:
        if k & length:
            part = power[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(BASE, length, 1 << 64)) + part
            done += length
        if length * 2 > k:
            break
        power = power[:-length] * np.uint64(pow(BASE, length, 1 << 64)) + power[length:]
        length *= 2
    return mix(out) >> np.uint64(32)


def winnow(data: bytes, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and their byte positions, in order of position.

    A text of fewer than k bytes has one gram, the whole; of fewer than `window` grams, one window. An empty
    text keeps nothing. Long texts are taken in overlapping segments, so memory is bounded; the result is the same.
    """
    if not data:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    k = min(k, len(raw))
    w = min(window, len(raw) - k + 1)
    hashes, places = [], []
    for at in range(0, len(raw) - k - w + 2, SEGMENT):
        grams = _gram_hashes(raw[at : at + SEGMENT + k + w - 2], k)
        # The greater position makes the lesser key, so the rightmost of equal hashes is kept.
        keys = (grams << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64))
        span = 1
        while span * 2 <= w:
            keys = np.minimum(keys[:-span], keys[span:])
            span *= 2
        if span < w:
            keys = np.minimum(keys[: len(keys) - (w - span)], keys[w - span :])
        keys = keys[np.flatnonzero(np.diff(keys, prepend=~keys[:1]))]
        hashes.append((keys >> np.uint64(32)).astype(np.uint32))
        places.append(np.int64(0xFFFFFFFF + at) - (keys & np.uint64(0xFFFFFFFF)).astype(np.int64))
    h, p = np.concatenate(hashes), np.concatenate(places)
    first = np.diff(p, prepend=-1) > 0
    return h[first], p[first]


def encode(hashes: np.ndarray, places: np.ndarray) -> str:
    """Hexadecimal text of a fingerprint: for each kept gram its hash (8 digits) and the distance
    from the kept gram before it (2 digits; WINDOW is the most, as kept grams are never farther apart)."""
    out = np.empty((len(hashes), 5), dtype=np.uint8)
    out[:, :4] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    out[:, 4] = np.diff(places, prepend=0)
    return out.tobytes().hex()


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Shared kept hashes over all kept hashes (distinct); 1 for two empty fingerprints."""
    x, y = np.unique(x), np.unique(y)
    if not len(x) and not len(y):
        return 1.0
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_kept"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    before = None  # bucket, doc_id, text, kept hashes and places of the row before
    for batch in batches:
        rows = []
        for bucket, extra, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "extra", "doc_id", "text")), strict=True):
            text = text or ""
            kept = winnow(text.encode("utf-8", "surrogatepass"))
            if before and before[0] == bucket:
                rows.append(_row(before, text, kept))
            before = None if extra else (bucket, doc_id, text, kept)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)


def _row(row: tuple, following: str, kept_next: tuple) -> tuple:
    _, doc_id, text, (hashes, places) = row
    cut = len(text) // 4
    edited = (text[: len(text) - cut] + following[:cut]).encode("utf-8", "surrogatepass")
    own, now = (hashes, places), winnow(edited)
    return doc_id, len(text), hashlib.sha256(edited).hexdigest(), encode(*own), encode(*now), likeness(hashes, now[0]), likeness(hashes, kept_next[0]), len(hashes)


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with likeness to the edited and the next text.

    The next document is that of the next doc_id (rows of one doc_id by text, null last; doc_id null last),
    after the last the first. The last quarter of the characters, rounded down, gives way to as many from
    the start of the next text, or all if it has fewer. Null texts are empty; an empty text has an empty
    fingerprint. A table of one row follows itself. Other columns are ignored. doc_id is a
    whole number; ids that can't be read as one fail.

    Rows are dealt by ranges of doc_id; the first row of each range goes to the range before as well, so the
    texts move once and no range needs another.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("o", F.coalesce("doc_id", F.lit(2**63 - 1)).cast("double"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    ranges = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))
    cuts = sorted(set(docs.approxQuantile("o", [i / ranges for i in range(1, ranges)], 0.1 / ranges)))
    placed = Bucketizer(splits=[-math.inf, *(cuts or [0.0]), math.inf], inputCol="o", outputCol="bucket").transform(docs)
    least = placed.select("bucket", "o").groupBy("bucket").agg(F.min("o").alias("first"))
    firsts = [(r.bucket, r.first) for r in least.orderBy("bucket").collect()]  # a row for each range
    dealt = placed.withColumn("extra", F.lit(False))
    if firsts:
        follow = [(firsts[i - 1][0], first) for i, (_, first) in enumerate(firsts)]
        heads = F.broadcast(spark.createDataFrame(follow, "bucket double, o double"))  # a row for each range
        dealt = dealt.unionByName(docs.join(heads, "o").withColumn("extra", F.lit(True)))
    dealt = dealt.repartition(ranges // 4, "bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last())
    return dealt.mapInArrow(
        _compared,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_kept long",
    )
