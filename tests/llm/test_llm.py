"""The training-data operators against brute force, on small tables of awkward rows."""

import collections
import hashlib
import math
import random
import re
import textwrap
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatt.llm import fingerprints, hmm, language_id, licences, mixing, near_dedup, queries, suffix_dedup
from tidewatt.llm.components import connected_components
from tidewatt.llm.decontaminate import contamination
from tidewatt.llm.induced import suffix_array
from tidewatt.llm.span_dedup import span_dedup
from tidewatt.llm.token_counts import TokenLedger, count_by_bpe, counted, deletes, inserts, revisions

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, taken int, component string, m int"


def prose(rng, n):
    return " ".join(rng.choice(["den", "tal", "rim", "os", "quer", "vast", "lo", "mi"]) + rng.choice(["ar", "en", "ix", "or"]) + rng.choice([".", ",", "", ""]) for _ in range(n))


def awkward():
    """Nulls, empty, blank, short, long, equal and near-equal texts, repeated rows and columns with clashing names."""
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 60)
    near = base.split()
    near[50] = "changed"
    texts = [base, base, " ".join(near), None, "", " \n\t ", "one", "one two", "Éé ÀB x", "12 34 $$$", prose(rng, 6000), passage + "\n" + prose(rng, 40), prose(rng, 40) + "\n" + passage, "x" * 700, "ab" * 400]
    texts += [prose(rng, n) for n in (3, 10, 60, 200)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], rows[-1], (None, base, None, None, 3)]
    return [(*r, "k", 1, 2, "c", 3) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs_of(rows):
    return collections.Counter(map(tuple, rows))


# 1
def slow_winnow(data, k=fingerprints.K, window=fingerprints.WINDOW):
    if not data:
        return [], []
    k = min(k, len(data))
    grams = fingerprints._gram_hashes(np.frombuffer(data, np.uint8), k)
    w, out = min(window, len(grams)), []
    for i in range(len(grams) - w + 1):
        j = i + max(x for x in range(w) if grams[i + x] == grams[i : i + w].min())
        if not out or out[-1] != j:
            out.append(j)
    return [int(grams[j]) for j in out], out


def test_fingerprints(docs, none):
    rows = sorted(((r[0], r[1]) for r in awkward()), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    want = []
    for i, (doc_id, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        edited = (t[: len(t) - cut] + nxt[:cut]).encode()
        h, p = slow_winnow(t.encode())
        want.append((doc_id, len(t), hashlib.sha256(edited).hexdigest(), fingerprints.encode(np.array(h, np.uint32), np.array(p, np.int64))))
    got = fingerprints.neighbour_fingerprints(docs)
    assert pairs_of(got.select("doc_id", "n_chars", "edited_sha256", "fingerprint").collect()) == pairs_of(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.collect())
    assert fingerprints.neighbour_fingerprints(none).count() == 0


def test_short_texts_match_their_edited_text(spark):
    """Where 31 bytes or more stay as they were, some kept hash is shared."""
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(n))) for i, n in enumerate(range(42, 302, 4))]
    got = fingerprints.neighbour_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.near_edited > 0 for r in got)


def test_winnowing_guarantee_and_segments(monkeypatch):
    rng = np.random.default_rng(0)
    shared = rng.integers(97, 101, fingerprints.K + fingerprints.WINDOW - 1, dtype=np.uint8).tobytes()
    a, b = (rng.integers(97, 123, 500, dtype=np.uint8).tobytes() for _ in range(2))
    assert set(fingerprints.winnow(a + shared)[0]) & set(fingerprints.winnow(shared + b)[0])
    data = rng.integers(97, 100, 5000, dtype=np.uint8).tobytes()
    whole = fingerprints.winnow(data)
    monkeypatch.setattr(fingerprints, "SEGMENT", 700)
    assert all((x == y).all() for x, y in zip(whole, fingerprints.winnow(data), strict=True))


# 2
WORD = re.compile(r"[^ \t\n\r\f\v]+")


def slow_span_dedup(rows):
    """Text that stays of each (doc_id, text), by plain loops: what later runs of sentences and later passages cover goes."""
    seen, out = {}, {}
    for doc_id, text in sorted(set(rows)):
        found = list(WORD.finditer(text))
        words, cuts, gone = [m[0] for m in found], [0], set()
        for i, m in enumerate(found):
            gap = text[m.end() : found[i + 1].start()] if i + 1 < len(found) else "\n"
            if "\n" in gap or re.search(r"[.!?][\"')\]]*$", m[0]):
                cuts.append(i + 1)
        spans = set()
        for k in range(len(cuts) - 1):
            for to in range(k + 3, len(cuts)):
                if cuts[to] - cuts[k] >= 10:
                    spans.add((cuts[k], cuts[to]))
                    break
            for at in range(k - 2, -1, -1):
                if cuts[k + 1] - cuts[at] >= 10:
                    spans.add((cuts[at], cuts[k + 1]))
                    break
        for a, b in sorted(spans):
            if seen.setdefault(("run", *words[a:b]), (doc_id, a)) != (doc_id, a):
                gone |= set(range(a, b))
        for a in range(len(words) - 50):
            first = seen.setdefault(tuple(words[a : a + 51]), (doc_id, a))
            if first != (doc_id, a):
                gone |= set(range(max(a, first[1] + 51) if first[0] == doc_id else a, a + 51))
        starts = [0, *(m.start() for m in found[1:]), len(text)] if found else [0, len(text)]
        out[doc_id] = "".join(text[starts[i] : starts[i + 1]] for i in range(len(starts) - 1) if i not in gone)
    return out


def test_span_dedup(docs, none):
    rows = [(r[0], r[1]) for r in awkward() if r[0] is not None and r[1]]
    want = slow_span_dedup(rows)
    got = span_dedup(docs)
    assert len(got.columns) == len(docs.columns) + 2 and got.count() == docs.count()
    for r in got.where("doc_id is not null and text is not null").collect():
        assert r.text == want.get(r.doc_id, "") and (r.n_removed > 0) == (r.text != dict(rows).get(r.doc_id, ""))
    assert {r.text for r in got.where("doc_id = 3").collect()} == {None}
    passage = awkward()[11][1].split("\n")[0]
    assert passage in want[11] and passage[:100] not in want[12]
    assert span_dedup(none).count() == 0


@pytest.mark.parametrize("ends", [0.0, 0.07])
def test_passages_amid_sentences_lose_their_words(spark, ends):
    """Passages of 51 to 80 words planted mid-sentence, many times, with ends that differ; against brute force."""
    rng = random.Random(8)

    def words(n):
        return [f"w{rng.randrange(10**6)}" + ("." if rng.random() < ends else "") for _ in range(n)]

    texts = {}
    for i, size in enumerate(range(51, 81)):
        passage = words(size)
        for copy in (0, 100, 300):
            texts[i + copy] = words(rng.randrange(1, 60)) + passage + words(rng.randrange(1, 60))
        texts[i + 500] = words(5) + passage[: size - 1] + words(9)  # one word less is none for the first
    texts[200], texts[201] = words(30) * 5, (words(60) + words(2)) * 2  # overlaps its own repeats
    texts[202] = texts[200][:100] + words(3)
    rows = [(i, " ".join(w)) for i, w in texts.items()]
    got = {r.doc_id: r.text for r in span_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == slow_span_dedup(rows)


def test_long_runs_of_signs_take_little_time(spark):
    rows = [(1, "." * 1_000_000), (2, "?" * 500_000 + ") " + "!" * 500_000), (3, '."' * 300_000 + " x"), (4, ")" * 600_000 + "\n" + "a" * 1_500_000)]
    began = time.time()
    got = span_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (len(r.text), r.n_removed) for r in got.collect()} == {i: (len(t), 0) for i, t in rows}
    assert time.time() - began < 60  # a run over sentence patterns took minutes


# 3
def test_hmm_counts_and_forward(spark, docs, none):
    got = hmm.hmm_scores(docs)
    counts = collections.Counter()
    for r in awkward():
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10:
            counts.update([*hmm.encoded(r[1]).split(), b""])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for r in awkward():
        tokens = [*hmm.encoded(r[1]).split(), b""]
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        want[r[0], r[0] is not None and not zlib.crc32(str(r[0]).encode()) % 10, len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 6)] += 1
    assert pairs_of(got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6)).collect()) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got.collect())
    assert hmm.hmm_scores(none).count() == 0
    only = hmm.hmm_scores(docs.where("doc_id is null")).first()
    assert (only.train_tokens, only.n_known) == (0, 0) and math.isfinite(only.score)


def test_forward_and_counts_are_those_of_all_paths():
    rng = np.random.default_rng(1)
    m = hmm.Model.initial(rng.integers(1, 50, hmm.CLASSES).astype(float))
    seqs = [rng.integers(0, hmm.CLASSES, n).astype(np.int16) for n in (1, 4, 3)]
    for s, got in zip(seqs, m.log10_likelihood(seqs), strict=True):
        paths = np.array(np.meshgrid(*[range(hmm.STATES)] * len(s))).reshape(len(s), -1)
        p = m.start[paths[0]] * np.prod([m.emit[s[i], paths[i]] for i in range(len(s))], axis=0) * np.prod([m.move[paths[i], paths[i + 1]] for i in range(len(s) - 1)], axis=0)
        assert got == pytest.approx(np.log10(p.sum()))
        start, move, emit = m.expected([s])
        p /= p.sum()
        assert start == pytest.approx([p[paths[0] == k].sum() for k in range(hmm.STATES)])
        assert move.sum() == pytest.approx(len(s) - 1) and emit.sum() == pytest.approx(len(s))
        if len(s) > 1:
            assert move[0, 1] == pytest.approx(sum(p[(paths[i] == 0) & (paths[i + 1] == 1)].sum() for i in range(len(s) - 1)))
    before = m.log10_likelihood(seqs).sum()
    start, move, emit = m.expected(seqs)
    after = hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    assert after.log10_likelihood(seqs).sum() > before


def test_training_is_exact_over_stretches(monkeypatch):
    rng = np.random.default_rng(5)
    m = hmm.Model.initial(rng.integers(1, 50, hmm.CLASSES).astype(float))
    texts = [rng.integers(0, hmm.CLASSES, n).astype(np.int16) for n in (70, 1, 12, 33, 12, 13)]
    whole = m.expected(texts)
    for cut in (1, 5, 12):
        monkeypatch.setattr(hmm, "CUT", cut)
        assert all(np.allclose(a, b) for a, b in zip(whole, m.expected(texts), strict=True))


def test_hmm_takes_each_text_into_words_twice_at_most(spark):
    """Once to count, once for its classes; rounds and the scoring read classes, as words cost most of a text's seconds."""
    taken = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def watched(text):
        taken.add(1)
        return text

    rows = [(i, f"w{i % 7} and w{i % 5}") for i in range(100)]
    got = hmm.hmm_scores(spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", watched("text")))
    assert len(got.collect()) == 100
    assert 100 < taken.value <= 200


def test_words_in_slices_are_those_of_single_texts(spark, docs, monkeypatch):
    texts = [r[1] for r in awkward()] + ["  a\tb ", "\x00 \x1c\x85\u00a0x", "A\r\nb\vÄ\fC", " ", "É" * 3]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(texts, kind)[1:]
        words, sizes = hmm.words_of(column)
        assert words.to_pylist() == [w for t in texts[1:] for w in hmm.encoded(t).split()]
        assert sizes.tolist() == [len(hmm.encoded(t).split()) for t in texts[1:]]
        for most in (1, 500, 1 << 30):
            parts = list(hmm.slices(column, most))
            assert [at for at, _ in parts] == [0, *np.cumsum([len(p) for _, p in parts])[:-1]] and sum((p.to_pylist() for _, p in parts), []) == texts[1:]
    fields = ["doc_id", "held_out", "n_tokens", "n_known", F.round("base_score", 6), F.round("score", 6)]
    whole = pairs_of(hmm.hmm_scores(docs).select(*fields).collect())
    for name, most in (("COUNT_BYTES", 1), ("ENCODE_BYTES", 1), ("BATCH_TEXTS", 2), ("HOT_WORDS", 7)):
        monkeypatch.setattr(hmm, name, most)
    assert pairs_of(hmm.hmm_scores(docs).select(*fields[:5]).collect()) == collections.Counter(r[:5] for r in whole.elements())
    monkeypatch.setattr(hmm, "HOT_WORDS", 50_000)
    assert pairs_of(hmm.hmm_scores(docs).select(*fields).collect()) == whole


def test_the_least_probabilities_do_not_vanish():
    rng = np.random.default_rng(8)
    m = hmm.Model.initial(rng.integers(1, 50, hmm.CLASSES).astype(float))
    m.emit[:1000] *= 1e-18
    texts = [rng.integers(0, 1000, n).astype(np.int16) for n in (40, 3, 41, 1, 2500)]
    likely = m.log10_likelihood(texts)
    for s, got in zip(texts, likely, strict=True):
        alpha, want = m.start, 0.0
        for t, c in enumerate(s):
            alpha = (alpha if t == 0 else alpha @ m.move) * m.emit[c]
            want, alpha = want + np.log10(alpha.sum()), alpha / alpha.sum()
        assert got == pytest.approx(want)
    start, move, emit = m.expected(texts)
    assert (start.sum(), move.sum(), emit.sum()) == pytest.approx((5, sum(map(len, texts)) - 5, sum(map(len, texts))))


def test_the_model_beats_word_counts_on_held_out_texts(spark):
    rows = hmm.hmm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert rows[0] / rows[2] > rows[1] / rows[2] + 0.2


# 4
def test_licences(spark, none):
    mit = licences.KNOWN["MIT"]
    spelled = mit.replace("<year> <copyright holders>", "1999 A. N. Other").replace("sublicense", "sub-licence").upper().replace("\n\n", "\n")
    rows = [(1, mit), (2, spelled), (3, mit.split("\n", 1)[1]), (4, mit + " More."), (5, None), (6, ""), (7, "text.\nReleased under the MIT licence"), (7, "text.\nReleased under the MIT licence")]
    got = collections.Counter((r.doc_id, r.licence_id, r.notices) for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == collections.Counter({(1, "MIT", ""): 1, (2, "MIT", ""): 1, (3, "MIT", ""): 1, (4, None, ""): 1, (5, None, ""): 1, (6, None, ""): 1, (7, None, "MIT-notice"): 2})
    assert licences.licence_scan(none).count() == 0


def test_licences_are_known_however_they_are_wrapped(spark):
    """Every known text, wrapped at three widths, as a comment, with a holder's line; and the SQL agrees, on odd texts too."""
    import duckdb

    rows = []
    for name, text in licences.KNOWN.items():
        for width in (56, 66, 78):
            for sign in ("", "# ", " * "):
                body = [line for part in text.split("\n") for line in ([part] if "copyright" in part.strip().lower()[:12] else textwrap.wrap(part, width, break_long_words=False)) or [""]] if width != 56 or sign else text.split("\n")
                rows.append((len(rows), name, "\n".join(sign + x for x in ["Copyright (c) 2001 A. N. Other", "All rights reserved.", *body])))
    docs = spark.createDataFrame(rows, "doc_id long, name string, text string")
    got = {r.doc_id: r.licence_id for r in licences.licence_scan(docs).collect()}
    odd = [n for i, n, t in rows if got[i] != n and "\n" in licences.KNOWN[n].strip()]
    assert not odd
    texts = [r[1] for r in awkward()] + [t for _, _, t in rows[::5]] + ["Copyright notice and\n copyright 1999\n(C) x\nword", "copyright\n\n\nLICENCE sub-licence"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    documents = docs.toPandas()
    want = duckdb.sql(licences.oracle_sql()).fetchall() if len(documents) else []
    assert pairs_of(licences.licence_scan(docs).collect()) == pairs_of(want)


# 5
def test_suffix_array():
    rng = np.random.default_rng(2)
    for trial in range(150):
        t = rng.integers(0, rng.integers(1, 6), rng.integers(1, 50))
        t = np.tile(t, 3) if trial % 3 == 0 else t
        assert list(suffix_array(t)) == sorted(range(len(t)), key=lambda i: list(t[i:]))


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_CONTEXTS, 1])
def test_suffix_dedup(docs, none, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    length, rows = suffix_dedup.LENGTH, [(r[0], (r[1] or "").encode()) for r in awkward()]
    seen = collections.Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    want = collections.Counter()
    for doc_id, b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want[doc_id, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept] += 1
    got = suffix_dedup.suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert collections.Counter((*r[:4], bytes(r[4])) for r in got) == want
    assert suffix_dedup.suffix_dedup(none).count() == 0


# 6
def test_ledger(spark, docs, none, tmp_path):
    ledger = TokenLedger(spark, f"file://{tmp_path}/ledger")
    rows = counted(docs, ["words-1", "words-2"])
    assert ledger.commit("a", inserts(rows)) and not ledger.commit("a", inserts(rows))
    assert ledger.commit("empty", inserts(counted(none, ["words-1"])))
    total = {tuple(r)[:3]: tuple(r)[3:] for r in ledger.totals(["a", "a", "empty", "never"]).collect()}
    want = collections.defaultdict(lambda: [0, 0])
    for r in awkward():
        cell = want[r[3], r[2], "words-1"]
        cell[0] += 1
        cell[1] += len((r[1] or "").split())
    assert {k: tuple(v) for k, v in want.items()} == {k: v for k, v in total.items() if k[2] == "words-1"}
    ledger.commit("b", revisions(rows, counted(docs.withColumn("source", F.lit("z")), ["words-1", "words-2"])))
    assert {r.source for r in ledger.totals(["a", "b"]).collect()} == {"z"}
    ledger.commit("c", deletes(counted(docs.withColumn("source", F.lit("z")), ["words-1", "words-2"])))
    assert ledger.totals(["a", "b", "c"]).count() == 0
    assert ledger.totals([]).count() == 0
    assert ledger.totals().count() == 0 and ledger.batches() == ["a", "b", "c", "empty"]
    assert ledger.compact() == "00000000" and ledger.compact() is None and not ledger.commit("a", inserts(rows))
    ledger.commit("d", inserts(rows))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in ledger.totals().collect()} == total
    assert ledger.compact() == "00000001" and {tuple(r)[:3]: tuple(r)[3:] for r in ledger.totals().collect()} == total


def test_ledger_query_against_its_sql_on_awkward_rows(spark, docs, tmp_path):
    import duckdb

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter(tuple(r[c] for c in ("source", "lang", "tokenizer", "n_docs", "n_tokens")) for r in queries.op6_token_counts(spark, str(tmp_path)).collect())
    duckdb.sql(f"create or replace view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == collections.Counter(duckdb.sql("select source, lang, tokenizer, n_docs, n_tokens from (" + queries.ORACLE["op6_token_counts"] + ")").fetchall())


def test_bpe_counts(docs):
    got = {r.doc_id: r.n_tokens for r in count_by_bpe(docs.select("doc_id", "text"), "/opt/tokenizers/byte_bpe_50k.tiktoken").collect()}
    assert got[3] == got[4] == 0 and got[0] == got[1] > 100


# 7
def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def test_near_duplicates(docs, none):
    sets = {}
    for r in awkward():
        w = (r[1] or "").encode().lower().split()
        if r[0] is not None:
            sets[r[0]] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    part = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    part[a] = min(part[a], part[b])
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), part[r.doc_id], r.doc_id == part[r.doc_id])
        else:
            assert (r.component_id, r.kept) == (0, False)
    assert near_dedup.near_duplicates(none).count() == 0


def test_an_id_with_several_texts_has_the_links_of_each(spark):
    rng = random.Random(6)
    one, two, three = (prose(rng, n) for n in (60, 90, 70))
    rows = [(1, one), (3, two), (5, one), (5, two + " more"), (5, three), (9, three), (None, three), (None, prose(rng, 30)), (7, prose(rng, 40))]
    got = collections.Counter(tuple(r)[:4] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "kept").collect())
    assert got == collections.Counter([(1, 1, True), (3, 1, False), (5, 1, False), (5, 1, False), (5, 1, False), (9, 1, False), (None, 1, False), (None, None, True), (7, 7, True)])


def test_near_duplicates_equal_an_exact_join(spark):
    """On generated documents and on many pairs near the threshold: components by comparing all sets that share a shingle."""
    rng, rows = random.Random(12), []
    for i in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 120))]
        rows.append((i, " ".join(words)))
        for k in range(rng.randrange(1, 8)):  # each change costs about 5 of the shingles on both sides
            words[rng.randrange(len(words))] = f"n{k}"
        rows.append((1000 + i, " ".join(words)))
    real = [(r.doc_id + 10_000, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text]
    rows += real
    sets, holders = {}, collections.defaultdict(list)
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for g in sets[i]:
            holders[g].append(i)
    common = collections.Counter((a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    links = [p for p, n in common.items() if 100 * n >= 75 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        part[b] = a
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(links) > 150 and {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}


@pytest.mark.parametrize("rounds", [0, near_dedup.LEADER_ROUNDS])
def test_a_chain_of_near_copies_is_one_component(spark, monkeypatch, rounds):
    """Neighbours link, ends don't: without leader rounds the block comparison finds the links."""
    monkeypatch.setattr(near_dedup, "LEADER_ROUNDS", rounds)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng, words, rows = random.Random(3), [f"w{i}" for i in range(200)], []
    for i in range(25):
        rows.append((i, " ".join(words)))
        for k in rng.sample(range(200), 3):
            words[k] = f"n{i}-{k}"
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


# 8
def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    sizes, rows = collections.Counter(), awkward()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, free, left = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}, {}, set(names), sum(sizes.values())
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s]]:
        for s in over:
            target[s] = 3 * sizes[s]
        free -= set(over)
        left = sum(sizes.values()) - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    assert {round(r.target, 6) for r in got} == {round(t, 6) for t in target.values()}
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[round(r.target, 6)] += r.taken
    assert all(abs(v - k) <= 1 for k, v in taken.items())
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs).collect()))
    assert mixing.mix(none).count() == 0


def test_mixing_orders_by_key_over_all_buckets(spark):
    """A source of least weight beside a plain one: the same choice as sorting each source whole, from small buckets."""
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(1, 9)), "low" if i % 3 else "plain", 0.05 if i % 3 else 1.0) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, w double")
    got = {r.doc_id: r for r in mixing.mix(docs, F.col("w")).collect()}
    u = (F.pmod(F.xxhash64("doc_id", F.md5("text"), F.lit(mixing.SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keys = {r.doc_id: (r.source, r.key) for r in docs.select("doc_id", "source", (-F.log(u) / F.col("w")).alias("key")).collect()}
    for source in ("low", "plain"):
        order = sorted((k for k, v in keys.items() if v[0] == source), key=lambda k: keys[k][1])
        size, target = got[order[0]].source_size, got[order[0]].target
        left = round(target - target // size * size)
        for k in order:
            part = min(got[k]["size"], max(0, left))
            left -= part
            assert got[k].taken == target // size * got[k]["size"] + part
    step = F.floor(F.log2(-F.log(u) / F.col("w")) * mixing.STEPS)
    assert docs.where("source = 'low'").groupBy(step).count().agg(F.max("count")).first()[0] < 0.05 * 4000


def test_many_sources_share_as_by_repeated_sharing(spark):
    rng = random.Random(9)
    sizes = {f"s{i:03d}": rng.choice([1, 5, 50, 4000]) for i in range(300)} | {None: 7}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, want, free = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, set(names)
    while True:
        left = sum(sizes.values()) - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            break
        want |= {s: 3 * sizes[s] for s in over}
        free -= set(over)
    assert got == pytest.approx(want | share)


# 9
def test_language_id(spark, none):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.fit(real)
    rows = real.where(language_id.fold(F.col("doc_id")) == 2).select("text", "lang").collect()
    found = language_id.predict(net, [r.text for r in rows])[0]
    assert np.mean([a == r.lang for a, r in zip(found, rows, strict=True)]) > 0.97
    assert language_id.predict(net, [None, "", "123 $$", "\n"]) == (["und"] * 4, [0.0] * 4)
    assert language_id.predict(net, ["ß" * 5000])[0][0] in net.languages
    assert language_id.language_id(none).count() == 0


def test_language_gradients():
    rng = np.random.default_rng(0)
    net = language_id.train(["aaa bbb", "ccc ddd"], ["x", "y"])
    x, y = rng.integers(97, 120, (4, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1])
    grads = language_id._gradients(net, x, y)

    def loss():
        return -net.log_probabilities(x)[np.arange(4), y].mean()

    for weight, grad in ((net.out, grads[-2]), (net.filters[1], grads[2])):
        i, step = np.unravel_index(np.abs(grad).argmax(), grad.shape), 1e-3
        weight[i] += step
        up = loss()
        weight[i] -= 2 * step
        down = loss()
        weight[i] += step
        assert (up - down) / (2 * step) == pytest.approx(grad[i], rel=0.1, abs=1e-3)


# 10
def test_contamination(spark, docs, none):
    texts = [r[1] for r in awkward()]
    items = [(1, " ".join(texts[0].split()[20:60]).upper()), (10, texts[10][300:420]), (2, "one two"), (3, "changed"), (4, None), (5, "!?"), (6, "quer xyzzy"), (2, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if w]

    windows = {(str(i), tuple(w[k : k + min(10, len(w))])) for i, w in ((i, words(t)) for i, t in items) if w for k in range(len(w) - min(10, len(w)) + 1)}
    want = collections.Counter()
    for r in awkward():
        w, hit, ids = words(r[1]), set(), set()
        for item, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    ids.add(item)
        want[r[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)] += 1
    assert pairs_of(contamination(docs, bench).collect()) == want
    unnamed = contamination(docs, bench.selectExpr("cast(null as long) as item_id", "text")).where("contaminated").select("n_items", "items_sha256").distinct().collect()
    assert [tuple(r) for r in unnamed] == [(1, hashlib.sha256(b"").hexdigest())]
    assert sum(n for k, n in want.items() if k[-1]) > 4
    assert contamination(none, bench).count() == 0
    assert contamination(docs, bench.limit(0)).where("contaminated").count() == 0


# The pipeline
def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, kept, sf), "test")
        assert kept.columns == docs.columns, name
    parts = near_dedup.near_duplicates(docs)
    assert kept.join(parts.where("not kept"), "doc_id").count() == 0
    assert contamination(kept, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert mixed.count() == kept.count() > 0.7 * docs.count()
    assert corpus_pipeline.run(spark, sf).select("doc_id").exceptAll(mixed.select("doc_id")).count() == 0


def test_pipeline_on_awkward_rows(spark, docs, none):
    """Each stage keeps rows of its input only, with their ids; no two that it keeps are near-duplicates, and the mix takes words of all."""
    sf, columns = "/root/testdata/sf0.001", ["doc_id", "text", "lang", "source", "n_chars"]
    for first in (docs, none):
        table, before = first.select(columns), None
        for name, stage in corpus_pipeline.STAGES:
            before, table = table, corpus_pipeline.written(stage(spark, table, sf), "test")
            ids = {r.doc_id for r in table.collect()}
            assert ids <= {r.doc_id for r in before.collect()} and table.count() <= before.count()
            if name == "language ID":
                assert not {r.doc_id for r in table.collect()} & {3, 4, 5, 9}  # null, empty, blank, without a letter
            elif name == "near-dedup":
                again = near_dedup.near_duplicates(table)
                assert again.count() == again.where("kept or n_shingles = 0").count()
        mixed = table.collect()
        assert len(mixed) == before.count() and (first is none or sum(r.taken for r in mixed) > 0)


def test_pipeline_decisions_hold_without_ids_and_for_repeated_ids(spark):
    """Benchmark items under null and repeated ids all go; of copies without ids one row stays."""
    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 60").first().text
    rng = random.Random(4)
    clean, copy = prose(rng, 80), prose(rng, 90)
    rows = [(None, item), (1, item), (1, clean), (1, "before " + item + " after"), (None, copy), (None, copy), (None, copy + " end"), (4, prose(rng, 50)), (4, prose(rng, 50))]
    rows += [rows[-1]]
    docs = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.decontamination_stage(spark, docs, sf).collect()
    assert pairs_of((r.doc_id, r.text) for r in left) == pairs_of(r for r in rows if item not in r[1])
    once = corpus_pipeline.near_dedup_stage(spark, docs, sf).collect()
    assert len([r for r in once if r.doc_id is None]) == 1 and len([r for r in once if r.doc_id == 4]) == 2
    assert [r.text for r in once if r.doc_id is None][0].startswith(copy)
