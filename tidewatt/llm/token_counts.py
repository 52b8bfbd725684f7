"""Token totals by source, language and tokenizer version, kept up to date by signed batches.

A batch of changes becomes signed additions: an insert adds a document's count, a delete
takes it away, a revision does both. What a batch adds up to is written once under its
id, in a folder all executors share; a batch committed before is left alone, so a replay
changes nothing. Totals are sums over committed batches; snapshots keep them short.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import names, published, text_at
from ._common import SPACE, text_of

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "batch_id string, source string, lang string, tokenizer string, n_docs long, n_tokens long"

#: Tokenizers that DataFrame functions express, by version: the pattern of a token.
PATTERNS = {
    "words-1": f"[^{SPACE}]+",
    "words-2": r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]",
}


def count_by_pattern(text: Column, version: str) -> Column:
    """Tokens of a text under one of PATTERNS; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(PATTERNS[version])), F.lit(0)).cast("long")


def count_by_bpe(docs: DataFrame, vocabulary: str) -> DataFrame:
    """`docs` with n_tokens, 0 for null, under a byte-pair vocabulary in a `.tiktoken` file (a path every executor reads, or one added with addFile)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from tiktoken.load import load_tiktoken_bpe

        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
        coder = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(vocabulary), special_tokens={})
        for batch in batches:
            n = [len(coder.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n_tokens"])

    docs = docs.drop("n_tokens")
    return docs.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), "n_tokens long"]))


def counted(docs: DataFrame, versions: list[str]) -> DataFrame:
    """Rows (doc_id, source, lang, tokenizer, n_tokens), one for each document and version."""
    text = text_of(docs)
    each = F.array(*[F.struct(F.lit(v).alias("tokenizer"), count_by_pattern(text, v).alias("n_tokens")) for v in versions])
    return docs.select("doc_id", docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"), F.explode(each).alias("t")).select("doc_id", "source", "lang", "t.*")


def inserts(rows: DataFrame) -> DataFrame:
    """Changes that add rows of `counted`: a document and its tokens each; null counts add no tokens."""
    return rows.select(*KEYS, F.lit(1).alias("docs"), F.col("n_tokens").alias("tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    """Changes that take rows of `counted` away again."""
    return rows.select(*KEYS, F.lit(-1).alias("docs"), (-F.col("n_tokens")).alias("tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents as they were counted, and as they count now; source and language may have changed too."""
    return deletes(before).union(inserts(after))


class TokenLedger:
    """Totals under a root folder: a marker for each committed batch, and for each snapshot that sums earlier ones.

    Sums are written to a folder of their own first; the exclusive creation of the marker that names it commits them, so
    of two writers of a batch one gets True, and readers see all of a batch or nothing. Folders that no marker names are what was
    broken off. Null sources, languages and counts are keys and zeros of their own. Changes carry their own counts, so a
    delete of what was never inserted shows as a negative total: the ledger keeps sums, not documents. Groups
    whose documents and tokens are both 0 are left out of totals. An empty batch commits and adds nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _marker(self, kind: str, name: str) -> str:
        return f"{self.root}/{kind}={quote(name, safe='')}.json"

    def _names(self, kind: str) -> list[str]:
        found = names(self.spark, self.root)
        return sorted(unquote(n[len(kind) + 1 : -5]) for n in found if n.startswith(f"{kind}=") and n.endswith(".json"))

    def _said(self, kind: str, name: str) -> dict:
        return json.loads(text_at(self.spark, self._marker(kind, name)))

    def _latest(self) -> tuple[str | None, dict]:
        snapshots = self._names("snapshot")
        return (snapshots[-1], self._said("snapshot", snapshots[-1])) if snapshots else (None, {"folder": None, "batches": []})

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        return self._names("batch")

    def _write(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        return folder

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch of changes (source, lang, tokenizer, docs, tokens); False if it was committed before.

        A batch that broke off is written anew; of several writers of one batch the first to finish counts. Hot groups
        are summed in the map tasks before the shuffle, so a source with a third of all rows sends a row for each task.
        """
        if batch_id in self.batches():
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum(F.coalesce("docs", F.lit(0))).alias("n_docs"), F.sum(F.coalesce("tokens", F.lit(0))).alias("n_tokens"))
        folder = self._write(sums.select(F.lit(batch_id).alias("batch_id"), *KEYS, F.col("n_docs").cast("long"), F.col("n_tokens").cast("long")))
        return published(self.spark, self._marker("batch", batch_id), json.dumps({"folder": folder}))

    def _rows(self, folders: list[str]) -> DataFrame:
        paths = [f"{self.root}/{f}" for f in folders]
        return self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)

    def _folders(self, batches: list[str]) -> list[str]:
        return [self._said("batch", b)["folder"] for b in batches]

    def compact(self) -> str | None:
        """Sums the latest snapshot and all batches since into a new snapshot, which totals read instead of these; its
        name, or None if there is nothing new or another one came first."""
        last, said = self._latest()
        new = [b for b in self.batches() if b not in set(said["batches"])]
        if not new:
            return None
        rows = self._rows([*self._folders(new), *([said["folder"]] if last else [])])
        name = f"{int(last) + 1 if last else 0:08d}"
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        folder = self._write(sums.select(F.lit(name).alias("batch_id"), *KEYS, "n_docs", "n_tokens"))
        done = json.dumps({"folder": folder, "batches": sorted({*said["batches"], *new})})
        return name if published(self.spark, self._marker("snapshot", name), done) else None

    def totals(self, batches: list[str] | None = None) -> DataFrame:
        """Totals over the committed batches, each once: all of them, from the latest snapshot and what came after, or
        those that are named."""
        known = self.batches()
        if batches is not None:
            folders = self._folders([b for b in dict.fromkeys(batches) if b in known])
        else:
            last, said = self._latest()
            folders = self._folders([b for b in known if b not in set(said["batches"])]) + ([said["folder"]] if last else [])
        sums = self._rows(folders).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")
