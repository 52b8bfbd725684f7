"""Licence scans: canonical digests of whole texts and of whole lines, joined to known ones.

The canonical form drops copyright lines, case, punctuation and white space differences,
and takes one spelling of words that licences spell in several ways.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import small, text_of, written

# Spellings that count as equal in licence texts.
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sub license": "sublicense",
    "sub licence": "sublicense",
    "sublicence": "sublicense",
    "favour": "favor",
    "honour": "honor",
    "organisation": "organization",
    "authorised": "authorized",
    "recognised": "recognized",
    "modernised": "modernized",
    "non commercial": "noncommercial",
    "https": "http",
}

# One-line notices. The full texts lie in licence_texts, a file a licence.
NOTICES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}
KNOWN = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))} | NOTICES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that only says who holds the rights, after comment signs: `(c)` or the sign with a year or a
#: placeholder behind it, `copyright` with one of these or a mark, or `all rights reserved`. "Copyright notice and
#: this permission", and a paragraph (c), are text of the licence.
COPYRIGHT_LINE = r"(^|\n)[ \t#*/;%-]*(?:all rights reserved|(?:\(c\)|©)[^\n]*?(?:[0-9]{4}|[<{\[])|copyright[^\n]*?(?:\(c\)|©|[0-9]{4}|[<{\[]))[^\n]*"
#: Everything but digits, letters and what is not ASCII.
SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: What a copyright line has in it; texts without any are not searched for such lines.
COPYRIGHT_MARKS = ("copyright", "(c)", "©", "all rights reserved")


def canonical(text: Column) -> Column:
    """The canonical form of a text in lower case without copyright lines: words single-spaced."""
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(text, SIGNS, " ")), F.lit(" "))
    for spelling, standard in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {spelling} "), F.lit(f" {standard} "))
    return F.trim(out)


def with_digest(df: DataFrame, column: str) -> DataFrame:
    """`df` with `digest`, of the canonical form of a column; null where that has no words. A step a column, so that
    none is worked out twice."""
    text = F.col(column)
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    marked = F.lit(False)
    for mark in COPYRIGHT_MARKS:
        marked = marked | F.contains(F.col("_folded"), F.lit(mark))
    plain = F.when(marked, F.regexp_replace("_folded", COPYRIGHT_LINE, "\n")).otherwise(F.col("_folded"))
    df = df.withColumn("_folded", folded).withColumn("_plain", plain)
    return df.withColumn("digest", F.sha2(F.nullif(canonical(F.col("_plain")), F.lit("")), 256)).drop("_folded", "_plain")


def variants(known: dict[str, str]) -> list[tuple[str, str]]:
    """(licence, text) of the known texts, also of each without its first line (its title)."""
    rows = [(k, v.strip()) for k, v in known.items()]
    return rows + [(k, v.split("\n", 1)[1]) for k, v in rows if "\n" in v]


def known_digests(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """(digest, licence_id) of the known texts with their variants."""
    frame = spark.createDataFrame(variants(known or KNOWN), "licence_id string, text string")
    return with_digest(frame, "text").where("digest is not null").groupBy("digest").agg(F.min("licence_id").alias("licence_id"))


def licence_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, digest, licence_id (of the whole text, or null), notices (ids of whole lines that are
    known texts, sorted, distinct and comma-joined; empty where there are none).

    Null, empty and wordless texts have a null digest, no licence and no notices. Equal texts get equal results and
    repeated rows are kept. A holder named without year, mark or placeholder is not taken for a copyright line. `known` has (digest, licence_id), a digest once; other columns are ignored.
    """
    known = small(written(known_digests(docs.sparkSession) if known is None else known.select("digest", "licence_id"), "known"))
    texts = docs.select("doc_id", text_of(docs).alias("text")).withColumn("row", F.unhex(F.md5("text")))
    lines = texts.select("row", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 0)
    found = with_digest(lines, "line").select("row", "digest").join(known, "digest")
    notices = found.groupBy("row").agg(F.array_join(F.sort_array(F.collect_set("licence_id")), ",").alias("notices"))
    notices = small(written(notices, "notices"))
    whole = with_digest(texts, "text").select("doc_id", "row", "digest").join(known, "digest", "left")
    return whole.join(notices, "row", "left").select("doc_id", "digest", "licence_id", F.coalesce("notices", F.lit("")).alias("notices"))


def oracle_sql() -> str:
    """The same in SQL for DuckDB, told in its own way: lines are dropped one by one from a list."""

    def form(text: str) -> str:
        line = "ltrim(l, ' ' || chr(9) || '#*/;%-')"
        dated = "(contains(l, '<') or contains(l, '[') or contains(l, '{') or regexp_matches(l, '[0-9][0-9][0-9][0-9]'))"
        holder = f"({line} like 'all rights reserved%' or (({line} like '(c)%' or {line} like '©%') and {dated}) or ({line} like 'copyright%' and (contains(l, '(c)') or contains(l, '©') or {dated})))"
        out = f"list_filter(string_split(translate({text}, '{UPPER}', '{LOWER}'), chr(10)), lambda l: not {holder})"
        out = f"list_filter(regexp_split_to_array(array_to_string({out}, ' '), '[^0-9a-zA-Z\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: w <> '')"
        out = f"' ' || array_to_string({out}, ' ') || ' '"
        for spelling, standard in SPELLINGS.items():
            out = f"replace({out}, ' {spelling} ', ' {standard} ')"
        return f"trim({out}, ' ')"

    def digest_sql(text: str) -> str:
        return f"(select case when f <> '' then sha256(f) end from (select {form(text)} as f))"

    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in variants(KNOWN))
    return f"""
    with known as (
      select digest, min(licence_id) as licence_id from (select licence_id, {digest_sql("text")} as digest from (values {values}) v(licence_id, text)) where digest is not null group by digest),
    docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
    lines as (select r, unnest(string_split(text, chr(10))) as line from docs),
    named as (select r, string_agg(distinct licence_id, ',' order by licence_id) as notices
      from (select r, {digest_sql("line")} as digest from lines where line <> '') join known using (digest) group by r)
    select doc_id, d.digest, licence_id, coalesce(notices, '') as notices
    from (select r, doc_id, {digest_sql("text")} as digest from docs) d
    left join known on known.digest = d.digest left join named using (r)"""
