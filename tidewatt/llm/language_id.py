"""Language identification by a byte convolutional network, trained in numpy.

A window of WINDOW bytes is embedded byte by byte, filters of several widths slide over
it, each filter's greatest response is kept, and a softmax over the languages follows.
Training takes a bounded sample of labelled rows; prediction covers the whole of every
text in windows of the same fixed length and averages their log probabilities, weighted
by the letters in each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import released

WINDOW = 256
EMBED = 6
WIDTHS = (2, 3, 5)
FILTERS = 16
#: Bound of the training sample: rows of each language, and windows taken from each row.
SAMPLE_ROWS = 600
SAMPLE_WINDOWS = 3
STEPS = 500
BATCH = 64
UNDETERMINED = "und"
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


@dataclass
class Network:
    """Weights of the network; `languages` are its classes."""

    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    shifts: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def features(self, windows: np.ndarray, keep: bool = False):
        """The greatest response of each filter in each window; with `keep`, also what the gradient needs."""
        x = self.embed[windows]
        pooled, kept = [], []
        for w, b in zip(self.filters, self.shifts, strict=True):
            width = len(w) // x.shape[2]
            unrolled = np.lib.stride_tricks.sliding_window_view(x, width, axis=1).transpose(0, 1, 3, 2).reshape(len(x), x.shape[1] - width + 1, -1)
            response = unrolled @ w
            at = response.argmax(axis=1) if keep else None
            pooled.append(np.maximum(response.max(axis=1) + b, 0))
            kept.append((unrolled, at) if keep else None)
        return np.concatenate(pooled, axis=1), kept

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.features(windows)[0] @ self.out + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text (the last one ends with it, a short one is filled with zeros), and the letters in each.

    Only letters and spaces matter: other characters become spaces, runs of which become one.
    """
    clean = " ".join("".join(c if c.isalpha() else " " for c in text).split()) if not text.isascii() else " ".join(_NOT_LETTERS.sub(" ", text).split())
    raw = np.frombuffer(clean.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros((n, WINDOW), dtype=np.uint8)
    out.ravel()[: len(raw)] = raw
    if n > 1:
        out[-1] = raw[-WINDOW:]
    return out, ((out != 0) & (out != 32)).sum(axis=1)


_NOT_LETTERS = re.compile(r"[^A-Za-z]+")


def train(texts: list[str], labels: list[str], seed: int = 7) -> Network:
    """A network fitted to labelled texts by Adam on mini-batches; languages are drawn equally often."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    xs, ys = [], []
    for text, label in zip(texts, labels, strict=True):
        w = windows_of(text)[0]
        w = w[np.unique(np.linspace(0, len(w) - 1, SAMPLE_WINDOWS).astype(int))]
        xs.append(w)
        ys += [languages.index(label)] * len(w)
    n = len(languages)
    net = Network(
        languages,
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        [rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, (FILTERS * len(WIDTHS), n)).astype(np.float32),
        np.zeros(n, np.float32),
    )
    if n < 2:
        return net
    net.embed[0] = 0
    x, y = np.concatenate(xs), np.array(ys)
    rows = [np.flatnonzero(y == k) for k in range(n)]
    weights = [net.embed, *net.filters, *net.shifts, net.out, net.bias]
    first, second = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights]
    for step in range(1, STEPS + 1):
        pick = np.array([rng.choice(rows[k]) for k in rng.integers(0, n, BATCH)])
        grads = _gradients(net, x[pick], y[pick])
        rate = 0.01 * (1 - 0.9 * step / STEPS)
        for p, g, m, v in zip(weights, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        net.embed[0] = 0
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    pooled, kept = net.features(x, keep=True)
    z = pooled @ net.out + net.bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    back = (p @ net.out.T) * (pooled > 0)
    d_embed, d_filters, d_shifts = np.zeros_like(net.embed), [], []
    for k, (unrolled, at) in enumerate(kept):
        d = back[:, k * FILTERS : (k + 1) * FILTERS]
        i = np.arange(len(x))[:, None]
        seen = unrolled[i, at]  # row, filter, width * EMBED
        d_filters.append(np.einsum("nf,nfw->wf", d, seen))
        d_shifts.append(d.sum(axis=0))
        width = WIDTHS[k]
        spread = (d[:, :, None] * net.filters[k].T[None]).reshape(len(x), FILTERS, width, EMBED)
        at_bytes = x[i[:, :, None], at[:, :, None] + np.arange(width)]
        np.add.at(d_embed, at_bytes, spread)
    return [d_embed, *d_filters, *d_shifts, pooled.T @ p, p.sum(axis=0)]


def predict(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language of each text and its probability; `und` and 0 where a text has no letter."""
    found, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    total = np.zeros((len(texts), len(net.languages)))
    letters = np.zeros(len(texts))

    def flush() -> None:
        logs = net.log_probabilities(np.concatenate([w for _, w, _ in held]))
        at = 0
        for i, w, n in held:
            total[i] += n @ logs[at : at + len(w)]
            letters[i] += n.sum()
            at += len(w)
        held.clear()

    waiting = 0
    for i, text in enumerate(texts):
        if not net.languages or not text or not has_letter(text):
            continue
        windows, n = windows_of(text)
        for at in range(0, len(windows), 64):
            held.append((i, windows[at : at + 64], n[at : at + 64]))
            waiting += len(held[-1][1])
            if waiting >= 64:
                flush()
                waiting = 0
    if held:
        flush()
    for i in np.flatnonzero(letters):
        mean = total[i] / letters[i]
        p = np.exp(mean - mean.max())
        k = int(p.argmax())
        found[i], scores[i] = net.languages[k], float(p[k] / p.sum())
    return found, scores


def fold(doc_id: Column) -> Column:
    """The fold of a document: crc32 of its id as text, modulo 4; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def fit(docs: DataFrame) -> Network:
    """A network learned from rows with text and lang, at most about SAMPLE_ROWS of each language, of folds other than 2.

    The sample is every row whose hashed id falls below SAMPLE_ROWS over the language's rows, so it is
    spread over the whole table and bounded. Rows with a null id are not learned from.
    """
    usable = docs.where("text is not null and lang is not null").where(fold(docs["doc_id"]) != 2)
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return train([], [])
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, SAMPLE_ROWS / n)])
    drawn = (F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)) < F.element_at(share, F.col("lang"))
    span = 4 * WINDOW  # of a long text, three stretches from all over it
    n = F.length("text")
    stretches = F.when(n <= 3 * span, F.col("text")).otherwise(F.concat_ws(" ", *[F.substring(F.col("text"), (F.lit(1) + ((n - span) * part / 2)).cast("int"), F.lit(span)) for part in range(3)]))
    rows = usable.where(drawn).select("doc_id", stretches.alias("text"), "lang").limit(2 * SAMPLE_ROWS * len(counts)).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.lang, r.text))
    rows = [r for r in rows if has_letter(r.text)]
    return train([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """`docs` with lang_pred and score (of columns of these names, the old ones go)."""
    docs = docs.drop("lang_pred", "score")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [], []
            for at in range(0, len(batch), 256):
                a, b = predict(net, batch.column("text").slice(at, 256).to_pylist())
                lang += a
                score += b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), "lang_pred string", "score double"]))


def language_id(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out (fold 2), lang_pred, score (0 to 1).

    lang, source and doc_id are never inputs of a prediction. Null texts and texts without a letter get
    `und` and score 0, as all texts do where nothing could be learned; with one language learned, texts get that.
    A null doc_id is in no fold: not held out and not learned from. Other columns are ignored.
    """
    net = fit(docs)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = identify(slim.select("doc_id", "text"), net)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
