"""Substring dedup: repeated passages keep their first occurrence only.

Sentences end after a full stop, exclamation or question mark (with closing marks) before
white space, or at a line break. Every run of RUN consecutive sentences is hashed,
lengthened forwards or backwards to RUN_WORDS words where its sentences are short. Runs
are joined on their hash over the whole corpus; the first is that of the least
(doc_id, position). Sentences that any other occurrence covers are removed.

Passages of PASSAGE words are found wherever they stand in a sentence: of each PASSAGE
words one gram of GRAM words is an anchor (winnowing), so equal passages share an anchor
and all windows of PASSAGE words that hold it lie in its context, PASSAGE - GRAM words to
each side. Occurrences of one anchor with equal contexts are a class: all but those of the
class's first text go whole (and so do later copies of a whole text). Only the contexts in first texts are cut into windows, which
are hashed and joined in turn, so that contexts that differ lose what they share.

A run, and a window, is told by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import released, scope, small, text_of, written
from ._hashing import BASE, hashed_words, mix, run_hashes, word_spans

RUN = 3
RUN_WORDS = 10
PASSAGE = 51
GRAM = 20
#: Texts are worked together up to so many bytes; a longer one alone.
TOGETHER = 1 << 18
SECOND = 0x51
_CLOSES = np.zeros(256, dtype=bool)
_CLOSES[[*b"\"')]"]] = True
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[*b".!?"]] = True
_SPANS = "hash long, again long, doc_id long, row_key long, at int, n int"


def sentence_ends(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each word (starts, ends) of some bytes is the last of its sentence; the last word always is."""
    last = ends - 1
    open_ = np.flatnonzero(_CLOSES[raw[last]] & (last > starts))
    for _ in range(8):
        last[open_] -= 1
        open_ = open_[_CLOSES[raw[last[open_]]] & (last[open_] > starts[open_])]
    for i in open_:  # very many closing marks
        last[i] = starts[i] + max(1, len(raw[starts[i] : ends[i]].tobytes().rstrip(b"\"')]"))) - 1
    out = _STOPS[raw[last]]
    breaks = np.flatnonzero(raw == 10)
    if len(out):
        out[:-1] |= np.searchsorted(breaks, ends[:-1]) < np.searchsorted(breaks, starts[1:])
        out[-1] = True
    return out


def runs(sizes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First sentence, and the one after the last, of each run of sentences with `sizes` words that belong to the texts `of`."""
    n, words = len(sizes), np.append(0, np.cumsum(sizes))
    at = np.arange(n)
    to = np.maximum(at + RUN, np.searchsorted(words, words[:-1] + RUN_WORDS))
    ok = (to <= n) & (of[np.minimum(to, n) - 1] == of)
    from_ = np.minimum(at + 1 - RUN, np.searchsorted(words, words[1:] - RUN_WORDS, side="right") - 1)
    fits = (from_ >= 0) & (of[np.maximum(from_, 0)] == of)
    code = np.unique(np.concatenate([at[ok] << 32 | to[ok], from_[fits] << 32 | at[fits] + 1]))
    return code >> 32, code & 0xFFFFFFFF


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes, by doubling."""
    done, out, length, n = 0, None, 1, len(words) - k + 1
    power = words
    while True:
        if k & length:
            part = power[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(BASE, length, 1 << 64)) + part
            done += length
        if length * 2 > k:
            return mix(out)
        power = power[:-length] * np.uint64(pow(BASE, length, 1 << 64)) + power[length:]
        length *= 2


def anchors(words: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the anchors of texts' word hashes: of each PASSAGE consecutive words of one text the
    gram of least hash, the rightmost where several are least."""
    if len(words) < PASSAGE:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams, w = _grams(words, GRAM), PASSAGE - GRAM + 1
    keys = (grams >> np.uint64(32) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64))
    span = 1
    while span * 2 <= w:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    if span < w:
        keys = np.minimum(keys[: len(keys) - (w - span)], keys[w - span :])
    keys = keys[of[: len(keys)] == of[PASSAGE - 1 :]]  # no window of two texts
    at = np.unique(np.int64(0xFFFFFFFF) - (keys & np.uint64(0xFFFFFFFF)).astype(np.int64))
    return at, grams[at]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about TOGETHER bytes of text, with the texts as bytes (null empty)."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            most = TOGETHER + (sizes[at - 1] if at else 0)
            to = max(at + 1, int(np.searchsorted(sizes, most, side="right")))
            part = batch.slice(at, to - at)
            yield part, [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            at = to


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The texts, a line break after each, and where each starts."""
    sizes = np.array([len(t) + 1 for t in texts])
    return b"\n".join([*texts, b""]), np.cumsum(sizes) - sizes


def _rows(part: pa.RecordBatch, of: np.ndarray, hash_: np.ndarray, again: np.ndarray, at: np.ndarray, n: np.ndarray | None = None) -> pa.RecordBatch:
    own = pa.array(of)
    columns = [pa.array(hash_.view(np.int64)), pa.array(again.view(np.int64)), part.column("doc_id").take(own), part.column("row_key").take(own), pa.array(at, pa.int32())]
    names = ["hash", "again", "doc_id", "row_key", "at", "n"]
    return pa.RecordBatch.from_arrays(columns if n is None else [*columns, pa.array(n, pa.int32())], names=names[: len(columns) + (n is not None)])


@released
def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each text (first word, words) and the contexts of its anchors (first word, minus the words)."""
    for part, texts in _groups(batches):
        data, text_at = _joined(texts)
        words, raw, starts, ends = hashed_words(data, lower=False)
        if not len(words):
            continue
        of = np.searchsorted(text_at, starts, side="right") - 1
        first = np.searchsorted(of, np.arange(len(texts) + 1))  # first word of each text
        stops = np.flatnonzero(sentence_ends(raw, starts, ends)) + 1
        edges = np.append(0, stops)
        lo, hi = runs(np.diff(edges), of[stops - 1])
        lo, hi = edges[lo], edges[hi]
        yield _rows(part, of[lo], run_hashes(words, lo, hi), run_hashes(words, lo, hi, SECOND), lo - first[of[lo]], hi - lo)
        at, hashes = anchors(words, of)
        own = of[at]
        lo, hi = np.maximum(at + GRAM - PASSAGE, first[own]), np.minimum(at + PASSAGE, first[own + 1])
        context = mix(run_hashes(words, lo, hi, SECOND) + (at - lo).astype(np.uint64))
        yield _rows(part, own, hashes, context, lo - first[own], lo - hi)


@released
def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of PASSAGE words in the given contexts of each text: two hashes and the first word."""
    for batch in batches:
        for row, (text, held) in enumerate(zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("held").to_pylist(), strict=True)):
            words = hashed_words(text, lower=False)[0]
            edge, held = np.zeros(len(words) + 2, np.int64), np.array(held, np.int64)
            np.add.at(edge, held >> 8, 1)
            np.add.at(edge, (held >> 8) + (held & 255) - PASSAGE + 1, -1)
            at = np.flatnonzero(np.cumsum(edge))
            yield _rows(batch, np.full(len(at), row), run_hashes(words, at, at + PASSAGE), run_hashes(words, at, at + PASSAGE, SECOND), at)


@released
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words that ranges (first word * 2**32 + word after the last) cover."""
    for part, texts in _groups(batches):
        data, text_at = _joined(texts)
        raw = np.frombuffer(data, dtype=np.uint8)
        starts, ends = word_spans(raw)
        of = np.searchsorted(text_at, starts, side="right") - 1
        first = np.searchsorted(of, np.arange(len(texts) + 1))
        last = sentence_ends(raw, starts, ends)
        total, lost = np.bincount(of[last], minlength=len(texts)), np.zeros(len(texts), np.int64)
        out = part.column("text").cast(pa.binary()).to_pylist()
        for i, ranges in enumerate(part.column("gone").to_pylist()):
            if not ranges:
                continue
            a, b = first[i], first[i + 1]
            if ranges[0] < 0:  # a later copy of a text: all of it, if it has a run or a passage
                ranges = [b - a] if b - a >= PASSAGE or (total[i] >= RUN and b - a >= RUN_WORDS) else []
            ranges = np.array(ranges, np.int64)
            edge = np.bincount(ranges >> 32, minlength=b - a + 1) - np.bincount(ranges & 0xFFFFFFFF, minlength=b - a + 1)
            gone = np.cumsum(edge)[: b - a] > 0
            cuts = np.append(starts[a:b] - text_at[i], len(texts[i]))
            cuts[0] = 0
            out[i] = np.frombuffer(texts[i], np.uint8)[~np.repeat(gone, np.diff(cuts))].tobytes()
            lost[i] = len(np.unique(np.cumsum(last[a:b])[gone] - last[a:b][gone]))
        keep = [i for i, name in enumerate(part.schema.names) if name not in ("text", "gone")]
        yield pa.RecordBatch.from_arrays(
            [*(part.column(i) for i in keep), pa.array(out, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(lost)],
            names=[*(part.schema.names[i] for i in keep), "text", "n_sentences", "n_removed"],
        )


def row_key(docs: DataFrame):
    """Tells rows of one doc_id apart by their text; equal rows share it."""
    return F.xxhash64(docs["text"])


def removed_parts(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, row_key, gone) for rows of which something goes: ranges of words, 2**32 times the first plus the
    one after the last, or -1 for a later copy of a text. A row's ranges are bounded by its words."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row_key"), text_of(docs).alias("text"))
    row = ["doc_id", "row_key"]
    of_row = F.struct(F.col("doc_id").isNull().alias("none"), *row)
    same_row = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_key") == F.col("first.row_key"))

    # Of equal texts the first alone is cut up: all that the others hold comes later.
    keyed = keyed.where("text <> ''").withColumn("text_key", F.unhex(F.md5("text")))
    firsts = keyed.groupBy("text_key").agg(F.min(of_row).alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    told = keyed.join(small(written(firsts, "copied")), "text_key", "left")
    copies = told.where("first is not null").where(~same_row).select(*row, F.lit(-1).cast("long").alias("c"))
    keyed = told.where(F.col("first").isNull() | same_row).select(*row, "text")

    # Cut up twice rather than kept: most spans occur once. Shuffled at every size.
    spans = keyed.mapInArrow(_spans, _SPANS)
    place = F.struct(F.col("doc_id").isNull().alias("none"), *row, "at")
    repeated = written(spans.groupBy("hash").agg(F.count("*").alias("m")).where("m > 1").select("hash"), "repeated")
    met = written(spans.join(repeated.hint("merge"), "hash"), "met")
    classes = written(met.groupBy("hash", "again").agg(F.min(place).alias("first"), F.count("*").alias("m")), "classes")
    of_class = met.join(classes.hint("merge"), ["hash", "again"]).where((F.col("n") < 0) | (place != F.col("first")))
    of_class = written(of_class.select("hash", *row, "at", "n", ((F.col("n") < 0) & same_row).alias("first")), "of-class")
    gone = of_class.where("not first").select(*row, F.col("at").alias("lo"), (F.col("at") + F.abs("n")).alias("hi"))

    held = of_class.where("first").select("hash", *row, "at", "n")
    several = written(held.groupBy("hash").agg(F.count("*").alias("m")).where("m > 1").select("hash"), "several")
    held = held.join(small(several), "hash", "left_semi").groupBy(*row).agg(F.collect_set(F.col("at").cast("long") * 256 - F.col("n")).alias("held"))
    held = written(held.withColumnRenamed("doc_id", "of").withColumnRenamed("row_key", "own"), "held")
    mine = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("row_key") == F.col("own"))
    texts = keyed.join(small(held.select("of", "own")), mine, "left_semi").dropDuplicates(row).join(held, mine).drop("of", "own")
    windows = written(texts.mapInArrow(_windows, "hash long, again long, doc_id long, row_key long, at int"), "windows")
    heads = written(windows.groupBy("hash", "again").agg(F.min(place).alias("first"), F.count("*").alias("m")).where("m > 1").drop("m"), "passages")
    later = windows.join(heads.hint("merge"), ["hash", "again"]).where(place != F.col("first"))
    # The first occurrence stays whole where a later one in the same text overlaps it.
    lo = F.when(same_row, F.greatest("at", F.col("first.at") + PASSAGE)).otherwise(F.col("at"))
    gone = gone.unionByName(later.select(*row, lo.alias("lo"), (F.col("at") + PASSAGE).alias("hi")))
    ranges = gone.select(*row, (F.shiftleft(F.col("lo").cast("long"), 32) + F.col("hi")).alias("c")).unionByName(copies)
    parts = written(ranges.groupBy(*row).agg(F.collect_set("c").alias("gone")), "gone")
    return parts


def span_dedup(docs: DataFrame) -> DataFrame:
    """`docs` with `text` without repeated runs and passages, n_sentences, and n_removed (sentences that lose words).

    Words are runs without ASCII white space, compared byte for byte; white space doesn't matter, and goes with the
    word before it. Null and empty texts stay as they are; so do texts with fewer than RUN sentences or RUN_WORDS
    words, if they have fewer than PASSAGE words. Where rows share a doc_id, those of lesser text hash come first;
    equal rows count as one occurrence and keep the same words, and rows without doc_id come last, told apart by
    a 64-bit hash of their text. All other columns pass through, but n_sentences, n_removed, row_key and gone,
    which are replaced. doc_id is a whole number; ids that can't be read as one fail.
    """
    docs = docs.drop("n_sentences", "n_removed", "row_key", "gone")
    with scope(docs.sparkSession) as held:
        gone = removed_parts(docs)
        held.drop()
    # The columns of the table stand in a struct, so that none of any name meets those that are joined to it.
    mine = docs.select(F.struct(*docs.columns).alias("mine"), F.col("doc_id").cast("long").alias("of"), row_key(docs).alias("own"))
    joined = mine.join(gone, F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("row_key")), "left")
    joined = joined.select(*[F.col("mine")[c].alias(c) for c in docs.columns if c != "text"], F.col("mine.text").cast("string").alias("text"), "gone")
    fields = [f"`{n}` {t}" for n, t in joined.dtypes if n not in ("text", "gone")]
    return joined.mapInArrow(_cut, ", ".join([*fields, "text string", "n_sentences long", "n_removed long"]))
