"""Whitening, archives and the prefix trie against brute force and round trips, on small awkward tables."""

import base64
import collections
import hashlib
import math
import random
import threading
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatt.llm import mixing, trie, warc, whitening
from tidewatt.llm.decontaminate import contamination
from tidewatt.llm.near_dedup import near_duplicates
from tidewatt.llm.scans import running
from tidewatt.llm.span_dedup import span_dedup
from tidewatt.llm.token_counts import TokenLedger


# 11
def test_symmetric_eigen_equals_lapack():
    rng = np.random.default_rng(3)
    cases = [np.zeros((3, 3)), np.eye(4), np.ones((5, 5)), np.diag([3.0, -1.0, 3.0]), np.array([[7.0]])]
    for d in (2, 9, 60):
        a = rng.normal(size=(d, d)) * np.logspace(0, -6, d)[:, None]
        cases.append(a @ a.T)
    for c in cases:
        values, rows = whitening.symmetric_eigen(c)
        scale = max(1e-300, np.abs(c).max())
        assert np.abs(values - np.linalg.eigvalsh(c)[::-1]).max() < 1e-12 * scale
        assert np.abs(rows @ rows.T - np.eye(len(c))).max() < 1e-12
        assert np.abs(rows.T @ np.diag(values) @ rows - c).max() < 1e-11 * scale


def slow_whitening(vectors):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n = len(x)
    sums = [sum(c) for c in zip(*x)]
    apart = [[n * c - s for c, s in zip(v, sums)] for v in x]
    y = np.array(apart, np.float64) / n
    values, columns = np.linalg.eigh(y.T @ y / n)
    return [sum(c * c for c in v) for v in apart], y, values[::-1], columns[:, ::-1]


def test_whitening_equals_plain_covariance(spark, monkeypatch):
    """Vectors that aren't usable are left out; partial states merge over two rounds."""
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    rng = np.random.default_rng(7)
    vectors = (rng.normal(size=(400, 40)) @ rng.normal(size=(40, 40)) + rng.normal(size=40) * 1000).astype(np.float32).tolist()
    vectors[5] = vectors[6]
    rows = [(i if i else None, v, "x", 1) for i, v in enumerate(vectors)]
    bad = [None, [], [1.0] * 39 + [None], [1.0] * 39 + [float("nan")], [float("-inf")] + [0.0] * 39, [1.0, 2.0], [3e38] + [0.0] * 39]
    table = spark.createDataFrame(rows + [(10_000 + i, v, "y", 2) for i, v in enumerate(bad)], "vec_id long, embedding array<float>, deviation string, n int").repartition(11)
    got = collections.defaultdict(dict)
    for r in whitening.whitened_components(table).collect():
        assert r.component not in got[r.vec_id] and r.n == 400 and r.identity_error < 1e-9
        got[r.vec_id][r.component] = r
    deviations, y, values, columns = slow_whitening(vectors)
    assert set(got) == {r[0] for r in rows}
    want = y @ columns[:, :32] / np.sqrt(values[:32])
    ids = [r[0] for r in rows]
    found = np.array([[got[i][k].whitened for k in range(1, 33)] for i in ids])
    assert np.abs(found * np.sign((found * want).sum(axis=0)) - want).max() < 1e-7
    assert [got[i][1].deviation for i in ids] == deviations
    assert all(abs(got[1][k].explained / (values[k - 1] / values.sum()) - 1) < 1e-9 for k in range(1, 33))


def test_whitening_of_few_equal_and_no_rows(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, [])]):
        assert whitening.whitened_components(spark.createDataFrame(rows, kind)).collect() == []
    flat = whitening.whitened_components(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(6)], kind)).collect()
    assert {r.component for r in flat} == {1} and len(flat) == 6  # one direction only
    far = whitening.whitened_components(spark.createDataFrame([(i, [i * 1e15, float(i % 2)]) for i in range(4)], kind)).collect()
    assert {r.deviation for r in far} == {None} and len(far) == 4  # past a long; the other direction is below rounding


def test_whitening_of_real_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)) * [1, 2, 3, 4, 5]
    df = whitening.usable(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "i int, vector array<double>").repartition(4))
    model = whitening.fit(df)
    assert np.allclose(model.covariance, np.cov(x.T, bias=True)) and np.allclose(model.mean, x.mean(axis=0)) and model.sums is None
    out = whitening.whiten(df, model, ["i"], most=2)
    assert whitening.identity_error(out) < 1e-12 and {r.deviation for r in out.collect()} == {None}


# 12
def pages_rows():
    big = "".join(random.Random(0).choices("abc dé<>/", k=300_000))
    end = warc.END_FRAME.decode()
    rows = [(7, "http://a/1", "same"), (3, "http://a/2?q=ü", "same"), (None, "x y\r\nWARC-Type: z", "same"), (4, None, "same"), (3, "http://a/2", "same")]
    rows += [(5, "u", None), (6, "u", ""), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (9, "u", end * 5), (10, "u", big), (11, "v", big), (None, None, "alone"), (-2, "w", "é\u0000\U0001f600")]
    return [(*r, "rev", 1, "d") for r in rows]


PAGES = "page_id long, url string, html string, record_type string, _first int, digest string"


def slow_archive(rows, least=0):
    out = []
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        ids = [r[0] for r in rows if (r[2] or "").encode() == data]
        first = min((i for i in ids if i is not None), default=None)
        again = len(data) >= least and first is not None and page_id != first
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    return collections.Counter(out)


@pytest.mark.parametrize("least", [0, 10])
def test_archives_give_the_pages_back(spark, least):
    pages = spark.createDataFrame(pages_rows(), PAGES).repartition(3)
    got = warc.archived(pages, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert collections.Counter(map(tuple, got.collect())) == slow_archive(pages_rows(), least)
    assert warc.archived(pages.limit(0)).count() == 0


def test_archives_are_standard_files(spark, tmp_path, monkeypatch):
    """Each starts with the dictionary, is cut at a bounded size, and a plain decoder that passes over skippable frames reads it."""
    import zstandard

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rng = random.Random(4)
    words = ["<p>", "</p>", "div", "class", "lorem", "ipsum", "été", "href=http://"]
    rows = [(i, f"http://h/{i}", " ".join(rng.choices(words, k=rng.randrange(5, 900)))) for i in range(300)]
    pages = spark.createDataFrame(rows, "record_id long, uri string, html string").repartition(2)
    records = pages.select("record_id", "uri", F.lit("2024-05-01T00:00:00Z").alias("date"), F.col("html").cast("binary").alias("payload"))
    records = warc.with_revisits(records)
    dictionary = warc.train_dictionary(records)
    assert 1000 < len(dictionary) <= warc.DICTIONARY_BYTES
    warc.write_archives(records, f"file://{tmp_path}/a", dictionary)
    files = sorted((tmp_path / "a").rglob("part-*"))
    assert len(files) > 4 and all(f.stat().st_size < 3 * 20_000 + len(dictionary) for f in files)
    found, compressed = {}, 0
    for f in files:
        data = f.read_bytes()
        assert data[:8] == warc.DICTIONARY_FRAME.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") and data[8 : 8 + len(dictionary)] == dictionary
        rest, compressed = data[8 + len(dictionary) :], compressed + len(data) - 8 - len(dictionary)
        coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        frames = 0
        while rest:
            if rest[:4] == b"P*M\x18":
                rest = rest[8:]
                continue
            one = coder.decompressobj()
            text, frames = one.decompress(rest), frames + 1  # a record is a frame of its own
            rest = one.unused_data
            assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
            if b"WARC-Type: response" in text:
                head, _, block = text.partition(b"\r\n\r\n")
                body = block.partition(b"\r\n\r\n")[2][:-4]
                found[int(head.split(b"urn:page:")[1].split(b">")[0])] = body.decode()
                assert f"Content-Length: {len(block) - 4}".encode() in head and b"WARC-Date: 2024-05-01T00:00:00Z" in head
        assert frames > 1
    assert found == {r[0]: r[2] for r in rows}
    alone = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r[2].encode())) for r in rows)
    assert compressed < alone  # headers and all
    back = warc.read_archives(spark, f"file://{tmp_path}/a")
    assert {(r.uri, bytes(r.payload).decode(), r.date) for r in back.collect()} == {(r[1], r[2], "2024-05-01T00:00:00Z") for r in rows}


def test_damaged_archives_are_told(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", bytearray(b"payload"), None, "response", None, "A" * 32)], "record_id long, uri string, payload binary, date string, record_type string, refers_to long, digest string")
    warc.write_archives(pages, f"file://{tmp_path}/a", None)
    with pytest.raises(Exception, match="doesn't fit its digest"):
        warc.read_archives(spark, f"file://{tmp_path}/a").collect()
    (cut,) = (tmp_path / "a").rglob("part-*")
    with pytest.raises(ValueError, match="ends within|no WARC"):
        list(warc.records_of(warc._info()[:0] + __import__("zstandard").compress(warc._info()[:-20])))
    assert len(list(warc.records_of(cut.read_bytes()))) == 2  # without a dictionary, with the information record


# 13
def slow_trie(rows):
    def digest(role, text):
        d = hashlib.md5(f"{len(role.encode())}:".encode() + role.encode() + text.encode()).digest()
        return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)

    turns = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns[c].append((t, role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(v, key=lambda v: (v[0] is not None, v[0] or 0, digest(v[1], v[2])))] for c, v in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
    members, children = collections.defaultdict(list), collections.defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(rebuilt[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), parent, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return collections.Counter(out)


def awkward_turns():
    """Ids below 0 and far apart, absent first conversations, null and equal turns, repeated rows, null ids, one very long conversation, copies."""
    rng, rows = random.Random(1), []
    for c in [*range(-12, 45), *(10**12 + i for i in range(7))]:
        if rng.random() > 0.1:
            rows += [(c, rng.choice([t, t, t, None]), rng.choice(["user", None, "a"]), rng.choice(["x", "y", "éé", None, ""])) for t in range(rng.choice([1, 2, 3, 9, 14]))]
    rows += [*rows[:5], (None, 1, "u", "x"), (None, None, None, None)]
    rows += [(777, i // 3, "u", str(i % 7)) for i in range(900)] + [(5 * i, t, "u", "copy") for i in range(200, 230) for t in range(4)]
    return [(*r, 0, "k", 1) for r in rows]


TURNS = "conv_id long, turn long, role string, text string, place int, d1 string, depth int"


def of_trie(df):
    return trie.trie(*trie.branched(trie.sequences(df)))


def test_trie_equals_plain_sets(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_CHARS", 40)
    got = of_trie(spark.createDataFrame(awkward_turns(), TURNS).repartition(5)).collect()
    assert collections.Counter(tuple(r)[2:] for r in got) == slow_trie(awkward_turns())
    assert sorted(r.pos for r in got) == list(range(len(got)))
    by_pos, root = {r.pos: r for r in got}, got[0]
    for r in got:  # a subtree is the interval of its preorder places
        inside = [by_pos[p] for p in range(r.pos, r.end + 1)]
        assert all(x.depth > r.depth for x in inside[1:]) and r.n_leaves == sum(x.n_children == 0 for x in inside)
        assert r.end + 1 == len(got) or by_pos[r.end + 1].depth <= r.depth
        root = r if r.depth == 0 else root
    assert root.pos == 0 and root.end == len(got) - 1


def test_trie_of_small_tables(spark):
    empty = spark.createDataFrame([], TURNS)
    assert of_trie(empty).count() == 0
    assert of_trie(spark.createDataFrame([(None, 1, "a", "b", 0, "", 0)], TURNS)).count() == 0
    for rows in ([(5, None, None, None)], [(7, 1, "a", "b")], [(7, 1, "a", "b")] * 12, [(1, 1, "a", "b"), (2, 1, "a", "b")]):
        rows = [(*r, 0, "", 0) for r in rows]
        assert collections.Counter(tuple(r)[2:] for r in of_trie(spark.createDataFrame(rows, TURNS)).collect()) == slow_trie(rows)


def test_running_totals_over_ranges(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, 2, 9]), i, rng.randrange(-(2**62), 2**62), rng.randrange(100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, i long, x long, s long").repartition(6)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {r.i: r for r in running(df, [F.col("g").asc(), F.col("i").asc()], sums=["s"], group="g", xors=["x"]).collect()}
        flat = {r.i: r for r in running(df, [F.col("g").desc(), F.col("i").asc()], sums=["s"], nth="n").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    state = collections.defaultdict(lambda: [0, 0, 0])
    for g, i, x, s in sorted(rows):
        n = state[g]
        n[1], n[2] = n[1] ^ x, n[2] + s
        assert (got[i].place, got[i].x_to, got[i].s_to) == tuple(n)
        n[0] += 1
    total = 0
    for n, (g, i, x, s) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1]))):
        total += s
        assert (flat[i].n, flat[i].s_to) == (n, total)


# Calls at the same time, commits, clashing columns, weights
def test_calls_at_the_same_time_keep_their_tables(spark):
    """Two span dedups and a near dedup in threads give what they give alone."""
    rng = random.Random(8)
    words = ["den", "tal", "rim", "os", "quer", "vast", "lo", "mi", "ar", "en"]
    texts = [" ".join(rng.choices(words, k=80)) + ". " + " ".join(rng.choices(words, k=40)) + "." for _ in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:4])], "doc_id long, text string")
    jobs = {"span": lambda: span_dedup(docs), "again": lambda: span_dedup(docs), "near": lambda: near_duplicates(docs).drop("text_key")}
    alone = {k: collections.Counter(map(tuple, f().collect())) for k, f in jobs.items()}
    found, errors = {}, []

    def run(name):
        try:
            found[name] = collections.Counter(map(tuple, jobs[name]().collect()))
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=run, args=(k,)) for k in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and found == alone


def test_of_two_writers_of_a_batch_one_commits(spark, tmp_path):
    root, gate = f"file://{tmp_path}/ledger", threading.Barrier(2)
    changes = spark.createDataFrame([("s", "l", "t", 1, 5)], "source string, lang string, tokenizer string, docs int, tokens int")

    class Slow(TokenLedger):
        def _write(self, rows):
            folder = super()._write(rows)
            gate.wait(60)  # both are past their look at what is committed
            return folder

    out = []
    threads = [threading.Thread(target=lambda: out.append(Slow(spark, root).commit("b/1", changes))) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    ledger = TokenLedger(spark, root)
    assert sorted(out) == [False, True] and ledger.batches() == ["b/1"]
    assert [tuple(r) for r in ledger.totals().collect()] == [("s", "l", "t", 1, 5)]


def test_columns_of_any_name_pass_through(spark):
    text = "One two three four five six. " * 3 + "Seven eight nine ten eleven twelve thirteen."
    rows = [(i, text if i < 3 else f"Words of {i} alone stand here for once.", "en", "s", 9, "a", "b", "c", "d", "e", "f") for i in range(6)]
    names = ["gone_id", "_key", "_id", "_of", "key", "row"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for stage in (corpus_pipeline.near_dedup_stage, corpus_pipeline.span_dedup_stage, corpus_pipeline.decontamination_stage):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and {tuple(r[n] for n in names) for r in out.collect()} == {("a", "b", "c", "d", "e", "f")}
    assert set(span_dedup(docs).columns) >= set(docs.columns)


def test_weights_of_zero_and_below_come_last(spark):
    rows = [(i, "w " * 10, "s", [0.0, -1.0, float("nan"), None, 2.0][i % 5]) for i in range(50)] + [(99, "w " * 1000, "t", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    got = {r.doc_id: r for r in mixing.mix(docs, docs["weight"]).collect()}
    assert len(got) == 51 and all(r.taken >= 0 for r in got.values())
    for r in got.values():
        if r.source_size == 500 and r.taken > r.epochs * r.size:  # in the fractional epoch
            assert r.doc_id % 5 in (3, 4) or all(got[i].taken > got[i].epochs * 10 for i in range(50) if i % 5 in (3, 4))


def test_a_long_benchmark_item_is_not_sent_with_each_gram(spark):
    rng = random.Random(2)
    item = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(3000)]
    docs = [(0, " ".join(item[500:900])), (1, " ".join(item[:9])), (2, "nothing of it " * 5), (3, " ".join(item))]
    benchmark = spark.createDataFrame([("x", " ".join(item)), ("x", " ".join(item)), ("x", "short one here"), (None, " ".join(item[:20]))], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in contamination(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert got == {0: (400, 1), 1: (0, 0), 2: (0, 0), 3: (3000, 2)}
