"""A hidden Markov language model over words.

Latent states emit word classes and a class emits its words by their smoothed training
frequency: b(word | state) = b(class | state) * p(word | class). The CLASS_WORDS most
frequent words are classes of their own; other words share HASH_CLASSES classes by the
last three bytes, known or not, and the end of a text is a class too. So the parameters
that are trained and sent to tasks have a fixed size, while word counts stay in a table.

Baum-Welch: each partition adds up the expected counts of its texts by scaled forward and
backward recursions; Spark adds the partitions, and the sums give the next parameters.
Scoring is the scaled forward recursion over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import released, written

STATES = 4
CLASS_WORDS = 1024
HASH_CLASSES = 1024
CLASSES = CLASS_WORDS + HASH_CLASSES + 1
END = CLASSES - 1
ROUNDS = 4
#: Counts of the most frequent words go to all tasks, those of the others are joined.
HOT_WORDS = 50_000
SMOOTH = 0.1
#: Texts are worked in stretches of so many tokens; what is carried from one to the next is exact.
CUT = 1024
#: Work in step is done for so many tokens of training sequences, and so many scored texts, at once.
BATCH_TOKENS = 400_000
BATCH_TEXTS = 4096
#: Bytes of text whose words are counted, and told into classes, at once.
COUNT_BYTES = 16 << 20
ENCODE_BYTES = 8 << 20
#: Probabilities are scaled at every so many tokens: a class has one of at least about 1e-20 in a state.
RESCALE = 4


def encoded(text: str | None) -> bytes:
    """The bytes whose words are the tokens of one text; `words_of` takes them from many."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z lower-cased, as bytes, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, pa.scalar("", texts.type))))
    words, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty word
    if pc.min(full).as_py() is False:
        owner = np.repeat(np.arange(len(texts)), sizes)
        sizes = np.bincount(owner[full.to_numpy(zero_copy_only=False)], minlength=len(texts))
        words = words.filter(full)
    return words.cast(pa.binary()), sizes


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """Where each slice of about `most` bytes of a column begins, and the slice; a longer text is one alone."""
    to = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(to, (to[at - 1] if at else 0) + most, side="right")))
        yield at, texts.slice(at, end - at)
        at = end


def tail_classes(words: pa.Array) -> np.ndarray:
    """The classes of words that have none of their own, by their last three bytes."""
    offsets, data = words.buffers()[1:]
    edges = np.frombuffer(offsets, dtype=np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    starts, ends, raw = edges[:-1], edges[1:], np.frombuffer(data or b"", dtype=np.uint8)
    tail = raw[ends - 1].astype(np.uint32)
    for back in (2, 3):
        tail = tail * np.uint32(257) + np.where(ends - back >= starts, raw[np.maximum(ends - back, 0)], 0).astype(np.uint32)
    return ((tail * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(HASH_CLASSES) + np.uint32(CLASS_WORDS)).astype(np.int16)


def places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """The place of each word among distinct words, -1 where it isn't one of them."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy(zero_copy_only=False)


def classes_of(words: pa.Array, top: pa.Array) -> np.ndarray:
    """Class of each word: its own for the most frequent words, else one by its last three bytes."""
    place = places(words, top)
    return np.where(place >= 0, place, tail_classes(words)).astype(np.int16)


class Model:
    """start (S), move (S, S) and emit (CLASSES, S): probabilities of the first state, the next state, a class."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, class_counts: np.ndarray) -> Model:
        """States that tend to stay, each with the frequencies of the classes disturbed by a fixed random factor."""
        share = (class_counts + 1) / (class_counts + 1).sum()
        emit = share[:, None] * np.exp(np.random.default_rng(3).normal(0, 0.5, (CLASSES, STATES)))
        move = np.full((STATES, STATES), 0.05 / max(1, STATES - 1))
        np.fill_diagonal(move, 0.95)
        return cls(np.full(STATES, 1 / STATES), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, class_counts: np.ndarray) -> Model:
        """Expected counts to probabilities; each state's class counts are smoothed towards the classes' own shares."""
        share = (class_counts + 1) / (class_counts + 1).sum()
        start, move, emit = start + 0.1, move + 0.1, emit + 50 * share[:, None]
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def expected(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts of the class sequences of texts, exact at any length.

        Texts are worked in step, in stretches of CUT tokens. What a stretch makes of any state before it is a small
        matrix; these give the states in which each stretch begins and the likelihood of all that follows it.
        """
        sequences = [s[at : at + CUT] for s in texts for at in range(0, len(s), CUT)]
        first = np.array([at == 0 for s in texts for at in range(0, len(s), CUT)])
        n = len(sequences)
        begin, end = np.tile(self.start, (n, 1)), np.ones((n, STATES))
        after = np.flatnonzero(~first)  # stretches that go on a text
        if len(after):
            part = np.unique(np.append(after - 1, after))
            through = dict(zip(part.tolist(), self._through([sequences[i] for i in part]), strict=True))
            for i in after:
                a = begin[i - 1] @ through[i - 1]
                begin[i] = a / a.sum() @ self.move
            for i in after[::-1]:
                b = self.move @ (through[i] @ end[i])
                end[i - 1] = b / b.sum()

        order, live, at, classes = _in_step(sequences)
        rank, width = np.argsort(order), len(order)
        last = (at[[len(s) - 1 for s in sequences]] + rank).astype(np.int64)  # where each stretch's last token is
        seen = np.ascontiguousarray(self.emit.T).take(classes, axis=1)
        alpha, beta, ahead = np.empty_like(seen), np.empty_like(seen), np.zeros_like(seen)
        alpha[:, :width] = begin[order].T * seen[:, :width]
        forth, back = np.ascontiguousarray(self.move.T), np.ascontiguousarray(self.move)
        for t in range(1, len(live)):
            before, now = slice(at[t - 1], at[t - 1] + live[t]), slice(at[t], at[t + 1])
            a = np.matmul(forth, alpha[:, before], out=alpha[:, now])
            a *= seen[:, now]
            if t % RESCALE == 0:
                a /= a.sum(axis=0)
        beta[:, last] = end.T
        for t in range(len(live) - 2, -1, -1):
            now, after_it = slice(at[t], at[t] + live[t + 1]), slice(at[t + 1], at[t + 2])
            h = np.multiply(seen[:, after_it], beta[:, after_it], out=ahead[:, now])
            if t % RESCALE == 0:
                h /= h.sum(axis=0)
            np.matmul(back, h, out=beta[:, now])
        move = np.zeros_like(back)
        if len(after):  # moves from stretch to stretch
            a, h = alpha[:, last[after - 1]], beta[:, rank[after]] * seen[:, rank[after]]
            move += (a / (a * (back @ h)).sum(axis=0)) @ h.T
        gamma = np.multiply(alpha, beta, out=beta)  # in place, as a long text makes these the most memory of a task
        total = gamma.sum(axis=0)
        gamma /= total
        alpha /= total
        move += alpha @ ahead.T
        emit = np.stack([np.bincount(classes, weights=g, minlength=CLASSES) for g in gamma], axis=1)
        return gamma[:, :width][:, first[order]].sum(axis=1), move * self.move, emit

    def _through(self, sequences: list[np.ndarray]) -> np.ndarray:
        """For each sequence the matrix from the state at its first token to that at its last, emissions included, scaled."""
        order, live, at, classes = _in_step(sequences)
        forth, emit = np.ascontiguousarray(self.move.T), np.ascontiguousarray(self.emit.T)
        out = np.eye(STATES)[:, :, None] * emit[:, classes[: live[0]]]  # (from, to, sequence)
        for t in range(1, len(live)):
            now = out[:, :, : live[t]]
            np.multiply(np.matmul(forth, now), emit.take(classes[at[t] : at[t + 1]], axis=1), out=now)
            if t % RESCALE == 0:
                now /= now.sum(axis=(0, 1))
        out /= out.sum(axis=(0, 1))
        return out.transpose(2, 0, 1)[np.argsort(order)]

    def log10_likelihood(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Log probability of each class sequence by the scaled forward recursion, all in step."""
        order, live, joined, starts = _longest_first(sequences)
        forth, emit = np.ascontiguousarray(self.move.T), np.ascontiguousarray(self.emit.T)
        alpha = self.start[:, None] * emit[:, joined[starts]]
        total = np.zeros(len(order))
        for t in range(1, len(live)):  # what has ended stays as it was
            now = alpha[:, : live[t]]
            np.multiply(np.matmul(forth, now), emit.take(joined.take(starts[: live[t]] + t), axis=1), out=now)
            if t % RESCALE == 0:
                scale = now.sum(axis=0)
                now /= scale
                total[: live[t]] += np.log10(scale)
        out = np.empty(len(order))
        out[order] = total + np.log10(alpha.sum(axis=0))
        return out


def _longest_first(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of sequences, longest first; how many have a token at each step; all joined in that order; their starts."""
    sizes = np.array([len(s) for s in sequences])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    return order, live, np.concatenate([sequences[i] for i in order]), np.cumsum(sizes) - sizes


def _in_step(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences longest first: their order, how many have a token at each step, where each step begins, tokens by step."""
    order, live, joined, starts = _longest_first(sequences)
    return order, live, np.append(0, np.cumsum(live)), joined[np.concatenate([starts[:n] + t for t, n in enumerate(live)])]


def _batches(found: Iterator[np.ndarray], most: int = BATCH_TOKENS) -> Iterator[list]:
    held, size = [], 0
    for x in found:
        held.append(x)
        size += len(x)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def in_training(doc_id: Column) -> Column:
    """Whether a document is learned from: crc32 of its id as text, modulo 10, is not 0. A null id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) != 0, F.lit(False))


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, n): counts over a column `text`; the number of texts, that is of ends, rides on the empty word."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for batch in batches:
            ends += len(batch)
            for _, part in slices(batch.column("text"), COUNT_BYTES):
                found = pc.value_counts(words_of(part)[0])
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([ends], pa.int64())], names=["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def train(sequences: DataFrame, class_counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all texts; each round brings one row of counts per partition together, of fixed size."""
    model = Model.initial(class_counts)
    for _ in range(rounds):

        @released
        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            sums = None
            for held in _batches(np.frombuffer(v.as_py(), dtype=np.int16) for batch in batches for v in batch.column("sequence")):
                got = model.expected(held)
                sums = got if sums is None else tuple(a + b for a, b in zip(sums, got, strict=True))
            if sums is not None:
                flat = np.concatenate([x.ravel() for x in sums])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "x"])

        rows = sequences.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
        flat = np.zeros(STATES + STATES**2 + CLASSES * STATES)
        flat[rows.i] = rows.x
        start, move, emit = np.split(flat, [STATES, STATES + STATES**2])
        model = Model.from_counts(start, move.reshape(STATES, STATES), emit.reshape(CLASSES, STATES), class_counts)
    return model


def hmm_scores(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words, A-Z lower-cased, then one end. base_score is the log10 probability by the smoothed
    word frequencies, score that by the model, ends included. A null or blank text is the end alone. Where no
    text is learned from, all counts are 0 and both scores come from smoothing. Null ids are neither held out
    nor learned from; rows of one doc_id and text are scored each, equally. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    texts = docs.where(in_training(F.col("doc_id"))).select("text")
    counts = written(count_words(texts), "words")
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = totals.n or 0, totals.v
    ordered = counts.where("word <> x''").orderBy(F.desc("n"), "word")
    hot = ordered.limit(HOT_WORDS).toArrow().combine_chunks()  # HOT_WORDS rows at most
    words, logs = hot["word"].combine_chunks(), np.log10(hot["n"].to_numpy() + SMOOTH)
    top = words[:CLASS_WORDS]
    ends = next((r.n for r in counts.where("word = x''").collect()), 0)

    def class_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
        for batch in batches:
            c = classes_of(batch.column("word"), top)
            np.add.at(n, c, batch.column("n").to_numpy())
            v += np.bincount(c, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(n), pa.array(v)], names=["c", "n", "v"])

    per_class = counts.where("word <> x''").mapInArrow(class_of, "c int, n long, v long").groupBy("c")
    per_class = per_class.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toPandas()  # CLASSES rows at most
    class_counts, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    class_counts[per_class.c], class_words[per_class.c] = per_class.n, per_class.v
    class_counts[END], class_words[END] = ends, min(1, ends)

    # p(word | class) = (c + SMOOTH) / (sum of the class + SMOOTH * (its words + 1)), the last part for words not seen;
    # a class of one word, and the end, are always that word.
    single = np.arange(CLASSES) < len(top)
    single[END] = True
    log_class = np.where(single, 0.0, np.log10(class_counts + SMOOTH * (class_words + 1)))
    norm = np.log10(n + SMOOTH * (v + 1))
    end_score = np.log10(ends + SMOOTH)
    shared = spark.sparkContext.broadcast((words, logs, classes_of(words, top), log_class))

    @released
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, logs, hot_classes, log_class = shared.value
        # by place, and last for all other words
        hot_classes, base_of = np.append(hot_classes, np.int16(0)), np.append(logs, 0.0)
        inside_of = np.append(np.where(hot_classes[:-1] < CLASS_WORDS, 0.0, logs - log_class[hot_classes[:-1]]), 0.0)
        for batch in batches:
            for at, part in slices(batch.column("text"), ENCODE_BYTES):
                words, sizes = words_of(part)
                owner, found = np.repeat(np.arange(len(part)), sizes), places(words, hot)
                odd = found < 0
                rare = words.filter(pa.array(odd)).dictionary_encode()
                codes, others = rare.indices.to_numpy(), tail_classes(rare.dictionary)
                classes, inside = hot_classes[found], inside_of[found]
                classes[odd], inside[odd] = others[codes], -log_class[others][codes]
                # the classes of a text, then one end
                sequence = np.full(len(words) + len(part), END, dtype=np.int16)
                sequence[np.arange(len(words)) + owner] = classes
                edges = np.append(0, np.cumsum(sizes + 1)) * sequence.itemsize
                sequence = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(sequence)])
                pairs, times = np.unique(owner[odd] * max(1, len(rare.dictionary)) + codes, return_counts=True)
                of, code = np.divmod(pairs, max(1, len(rare.dictionary)))
                pairs = pa.StructArray.from_arrays([rare.dictionary.take(pa.array(code)), pa.array(times)], names=["w", "m"])
                pairs = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(part) + 1)).astype(np.int32)), pairs)
                n_hot = sizes - np.bincount(owner[odd], minlength=len(part)) + (ends > 0)
                base = np.bincount(owner, weights=base_of[found], minlength=len(part)) + end_score
                inside = np.bincount(owner, weights=inside, minlength=len(part)).astype(float)  # integers where no text has words
                columns = [pa.array(sizes + 1), pa.array(n_hot), pa.array(base), pa.array(inside), pairs, sequence]
                yield pa.RecordBatch.from_arrays([batch.column(name).slice(at, len(part)) for name in ("doc_id", "training")] + columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "training", "n_tokens", "n_hot", "base_hot", "inside", "rare", "sequence"]
    fields = f"doc_id {kind}, training boolean, n_tokens long, n_hot long, base_hot double, inside double, rare array<struct<w: binary, m: long>>, sequence binary"
    texts = docs.select("doc_id", in_training(F.col("doc_id")).alias("training"), "text")
    # Classes take two bytes a token, so rounds of training and the scoring read these alone.
    told = written(texts.mapInArrow(encode, fields).withColumn("row", F.monotonically_increasing_id()), "sequences")
    model = train(told.where("training").select("sequence"), class_counts)

    @released
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BATCH_TEXTS):
                rows = batch.slice(at, BATCH_TEXTS)
                forward = model.log10_likelihood([np.frombuffer(v.as_py(), dtype=np.int16) for v in rows.column("sequence")])
                yield pa.RecordBatch.from_arrays([*(rows.column(name) for name in kept), pa.array(rows.column("inside").to_numpy() + forward)], names=[*kept, "score_hot"])

    kept = ["row", "doc_id", "training", "n_tokens", "n_hot", "base_hot"]
    scored = told.drop("rare").mapInArrow(score, f"row long, doc_id {kind}, training boolean, n_tokens long, n_hot long, base_hot double, score_hot double")
    scored = written(scored, "scored")
    rare = told.select("row", F.explode("rare").alias("r")).select("row", F.col("r.w").alias("word"), F.col("r.m").alias("m"))
    seen = F.coalesce("n", F.lit(0))
    rare = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(seen > 0, F.col("m")).otherwise(0)).alias("n_rare"), F.sum(F.col("m") * F.log10(seen + F.lit(SMOOTH))).alias("log_rare")
    )
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        "doc_id",
        (~F.col("training") & F.col("doc_id").isNotNull()).alias("held_out"),
        "n_tokens",
        (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_hot") + log_rare - F.col("n_tokens") * F.lit(float(norm))).alias("base_score"),
        (F.col("score_hot") + log_rare).alias("score"),
    )
