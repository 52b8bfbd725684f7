"""WARC archives of records compressed one by one with a shared Zstandard dictionary.

A dictionary is trained on pieces of the records that are archived, and every archive starts
with a skippable frame that holds it, so an archive can be read alone. Each record is a frame of its own;
an empty skippable frame ends it, which is what Spark's text writer puts after a row: archives
are written by Spark's own writer, to any file system that it knows, and a task that is run again
leaves no half archive. Readers of the format pass over skippable frames.

Records with a payload that was archived before are written as revisits without it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import claimed, released, shared_dir, small, written

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D  # a skippable frame with a dictionary, at the start
END_FRAME = b"P*M\x18\x00\x00\x00\x00"  # an empty skippable frame
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of a dictionary, and of the pieces of records it is trained on, all together.
DICTIONARY_BYTES = 1 << 16
SAMPLE_BYTES = 100 * DICTIONARY_BYTES
PIECE = 1 << 14
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 32 << 20
LEVEL = 3
#: The date of a record that has none.
NO_DATE = "1970-01-01T00:00:00Z"

_BASE32, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
RECORD = ["record_id", "uri", "date", "record_type", "refers_to", "digest"]


def payload_digest(payload: Column) -> Column:
    """The SHA-1 of some bytes in upper-case base32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def with_revisits(records: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Records (record_id, uri, date, payload binary) with digest, record_type and refers_to.

    Of records whose equal payloads have at least `revisit_from` bytes, the one of least id is the response, and the
    others are revisits that refer to it. Rows that repeat that id and payload are the same record and responses too;
    null ids come after all others, and are all responses where a payload has no other. The table of payloads is a row a
    digest (SHA-1 and a second hash), and hot payloads are counted in the map tasks.
    """
    marked = records.withColumns({"digest": payload_digest(F.col("payload")), "_second": F.xxhash64("payload")})
    firsts = marked.groupBy("digest", "_second").agg(F.min("record_id").alias("_first"), F.count("*").alias("n"), F.max(F.octet_length("payload")).alias("bytes"))
    copied = small(written(firsts.where((F.col("n") > 1) & (F.col("bytes") >= revisit_from)).select("digest", "_second", "_first"), "copied"))
    again = F.col("_first").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("_first"))
    return marked.join(copied, ["digest", "_second"], "left").select(
        *[c for c in marked.columns if c not in ("digest", "_second")], "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"),
    )


def head(record: dict, length: int) -> bytes:
    """The lines before a record's payload; `length` is the payload's."""

    def urn(name: object) -> str:
        return f"<urn:page:{quote(str(name), safe='')}>"

    inner = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    revisit = record["record_type"] == "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {record['record_type']}"]
    lines += [f"WARC-Record-ID: {urn(record['record_id'])}"] if record["record_id"] is not None else []
    lines += [f"WARC-Target-URI: {quote(record['uri'], safe=_URI)}"] if record["uri"] is not None else []
    lines += [f"WARC-Date: {record['date'] or NO_DATE}", f"WARC-Payload-Digest: sha1:{record['digest']}"]
    lines += [f"WARC-Profile: {PROFILE}"] if revisit else []
    lines += [f"WARC-Refers-To: {urn(record['refers_to'])}"] if revisit and record["refers_to"] is not None else []
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(inner) + (0 if revisit else length)}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + inner).encode()


_URI = "%:/?#[]@!$&'()*+,;=-._~"


def train_dictionary(records: DataFrame) -> bytes | None:
    """A dictionary from pieces of the responses, chosen by hash in proportion to their bytes over the whole table; None
    where there is too little to train on. About SAMPLE_BYTES go to one task, whatever the table's size."""
    responses = records.where("record_type = 'response'")
    total = responses.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    share = min(1.0, SAMPLE_BYTES / max(1, total))
    pieces = responses.withColumn("at", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("payload") / PIECE).cast("int"))))
    chosen = F.pmod(F.xxhash64("digest", "record_id", "at"), F.lit(1 << 30)) < int(share * (1 << 30))
    pieces = pieces.where(chosen).withColumn("piece", F.substring("payload", F.col("at") * PIECE + 1, F.lit(PIECE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        samples = []
        for batch in batches:
            for r in batch.to_pylist():
                samples.append((head(r, len(r["piece"])) if r["at"] == 0 else b"") + r["piece"])
        for cut in (PIECE, 256, 32):  # few records are cut smaller
            try:
                parts = [s[i : i + cut] for s in samples for i in range(0, len(s), cut)]
                found = zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
            except zstandard.ZstdError:
                continue
            yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], names=["dictionary"])
            return

    rows = pieces.select(*RECORD, "at", "piece").repartition(1).sortWithinPartitions("digest", "record_id", "at")
    found = rows.mapInArrow(run, "dictionary binary").first()
    return bytes(found.dictionary) if found else None


def write_archives(records: DataFrame, path: str, dictionary: bytes | None) -> None:
    """Writes records (RECORD and payload binary) to archives of about ARCHIVE_BYTES under `path`, a folder each.

    Null uris and ids leave their lines out. A table without records leaves a folder without archives.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        start = [coder.compress(_info())]
        if dictionary:
            start.insert(0, DICTIONARY_FRAME.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary)
        archive, place, size, frames = TaskContext.get().partitionId() << 24, 0, 0, []

        def batch_of(frames: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            ids, places, data = zip(*frames, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(data, pa.binary())], names=["archive", "place", "frame"])

        held = 0
        for batch in batches:
            columns = [batch.column(c) for c in range(batch.num_columns)]
            for i in range(batch.num_rows):
                r = {name: columns[j][i].as_py() for j, name in enumerate([*RECORD, "payload"])}
                body = head(r, len(r["payload"])) + (b"" if r["record_type"] == "revisit" else r["payload"]) + b"\r\n\r\n"
                for frame in [*(start if not size else []), coder.compress(body)]:
                    frames.append((archive, place, frame))
                    place, size, held = place + 1, size + len(frame) + len(END_FRAME), held + len(frame)
                if size >= ARCHIVE_BYTES:
                    archive, place, size = archive + 1, 0, 0
                if held >= 1 << 22:
                    yield batch_of(frames)
                    frames, held = [], 0
        if frames:
            yield batch_of(frames)

    frames = records.select(*[F.col(c).cast("string").alias(c) for c in RECORD], "payload").mapInArrow(run, "archive long, place long, frame binary")
    rows = frames.sortWithinPartitions("archive", "place").select("archive", F.col("frame").cast("string").alias("frame"))
    rows.write.partitionBy("archive").option("lineSep", END_FRAME.decode()).text(path)


def _info() -> bytes:
    text = b"format: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{uuid.uuid5(uuid.NAMESPACE_URL, 'warcinfo').urn}>", f"WARC-Date: {NO_DATE}"]
    return ("\r\n".join([*lines, "Content-Type: application/warc-fields", f"Content-Length: {len(text)}"]) + "\r\n\r\n").encode() + text + b"\r\n\r\n"


def records_of(data: bytes) -> Iterator[dict]:
    """The records of one archive, in order: headers by lower-case name, and block."""
    import zstandard

    known = None
    if data[:4] == DICTIONARY_FRAME.to_bytes(4, "little"):
        raw = data[8 : 8 + int.from_bytes(data[4:8], "little")]
        known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == b"\x28\xb5\x2f\xfd" else raw)
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=known).stream_reader(data, read_across_frames=True), 1 << 17)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("the archive ends within a record")
        yield {"headers": headers, "block": block}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits of the archives under a folder: record_id, uri, date, record_type, refers_to, digest (as the
    headers have them) and payload, null for revisits. A payload that its digest doesn't fit is an error.

    A task reads whole archives, one after another, a record at a time.
    """

    def name_of(urn: str | None) -> str | None:
        return unquote(urn.strip("<>").removeprefix("urn:page:")) if urn else None

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = [*RECORD, "payload"], [*[pa.string()] * len(RECORD), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for record in records_of(batch.column(0)[i].as_py()):
                    h, payload = record["headers"], None
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response":
                        payload = record["block"].partition(b"\r\n\r\n")[2]
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"payload of {h.get('warc-record-id')} doesn't fit its digest")
                    rows.append((name_of(h.get("warc-record-id")), h.get("warc-target-uri"), h["warc-date"], h["warc-type"], name_of(h.get("warc-refers-to")), digest, payload))
                    held += len(payload or b"")
                    if held >= 1 << 22:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, ", ".join([*(f"{c} string" for c in RECORD), "payload binary"]))


def resolved(records: DataFrame) -> DataFrame:
    """Records with payload_bytes and payload_digest of the full payload: a response's from its bytes, a revisit's from
    the response with its digest, null where the archives hold none. A digest's responses are one row, and Spark
    splits a hot digest of the revisits."""
    sized = records.select(*RECORD, F.octet_length("payload").cast("long").alias("own"), payload_digest(F.col("payload")).alias("found"))
    full = sized.where("record_type = 'response'").groupBy(F.col("found").alias("digest")).agg(F.max("own").alias("payload_bytes"))
    revisits = sized.where("record_type = 'revisit'").join(full, "digest", "left").withColumn("payload_digest", F.when(F.col("payload_bytes").isNotNull(), F.col("digest")))
    responses = sized.where("record_type = 'response'").withColumns({"payload_bytes": F.col("own"), "payload_digest": F.col("found")})
    columns = ["record_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    return responses.select(columns).unionByName(revisits.select(columns))


def archived(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Writes `pages` (page_id, url, html) to archives in the shared folder, reads them back, and returns per page:
    page_id, payload_bytes, payload_digest, record_type, refers_to, uri.

    A null html is an empty payload, null urls have no line. Ids are kept as text in archives and returned as the
    table's type. Pages with repeated ids are records of their own, see `with_revisits` for ties.
    """
    spark, kind = pages.sparkSession, dict(pages.dtypes)["page_id"]
    html = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    records = pages.select(F.col("page_id").alias("record_id"), F.col("url").cast("string").alias("uri"), F.lit(None).cast("string").alias("date"), html.alias("payload"))
    records = with_revisits(records, revisit_from)
    path = claimed(spark, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    write_archives(records, path, train_dictionary(records))
    out = resolved(read_archives(spark, path))
    return out.select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "uri")
