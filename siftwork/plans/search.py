"""The search: candidates, filters, results, each a DataFrame over the one before.

Filters stand in the order of their cost: names, one word in the raw text, two words, all words, then
places in the clean text, which alone need an exchange, of the rows that are left. The clean text is
an expression of the raw one; it is computed where it is used, on those rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.cleaning import clean, header, highlight
from siftwork.operators.excerpts import bounded, excerpt_column
from siftwork.operators.paths import in_scope, in_skipped_folder, is_binary, of_excluded_types, of_types
from siftwork.operators.presence import excluded, first_word_candidate, keep_undecided, longest_two, present, read_cap
from siftwork.operators.proximity import possible, within
from siftwork.plans.query import SearchQuery
from siftwork.sources import doctree
from siftwork.sources.extract import early_verdict, text_of
from siftwork.sources.filetypes import HEAVY

#: Bytes of a file of a costly type that its early test reads: mails, others.
MAIL_CAP, OTHER_CAP = 256 << 10, 1 << 20
_MAILS = (".eml", ".msg", ".mbox")


def candidates(files: DataFrame, query: SearchQuery) -> DataFrame:
    """Rows of files (path, relative, ext, size, content) that a search must look into.

    Names are tested first. Of plain types those with the first term in their bytes are candidates, of
    costly ones all that their early test does not rule out.
    """
    named = files.where(of_types(F.col("ext"), list(query.types) if query.types else None) & in_scope(F.col("relative"), list(query.scope)) & ~in_skipped_folder(F.col("relative")))
    heavy = F.lower("ext").isin(["." + t for t in sorted(HEAVY)])
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    return named.where(heavy | first_word_candidate(raw, list(query.terms)))


def filtered(files: DataFrame, query: SearchQuery) -> DataFrame:
    """Candidates that match, with their text (extracted where the type needs it) and clean text.

    Raw bytes decide presence and exclusion for plain types; extracted and cleaned text does for others. A
    type whose text cannot be extracted matches nothing.
    """
    terms = list(query.terms)
    binary = is_binary(F.col("ext"))
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    rows = files.where(~of_excluded_types(F.col("ext"), query.excluded_types))
    early = F.lit(True)
    for cap, of in ((MAIL_CAP, F.lower("ext").isin(*_MAILS)), (OTHER_CAP, ~F.lower("ext").isin(*_MAILS))):
        early = early & (~(binary & of) | keep_undecided(early_verdict(F.when(binary & of, F.col("ext")), F.col("content"), F.col("size"), terms, cap, query.smart)))
    rows = rows.where(binary | (present(raw, longest_two(terms)) & present(raw, terms))).where(early)
    rows = rows.withColumn("text", text_of(F.col("ext"), F.col("content"))).where("text is not null")
    rows = rows.where(possible(F.col("text"), terms, query.smart, query.distance))
    rows = rows.withColumn("clean", clean(F.col("text")))
    rows = within(rows, "path", "clean", terms, query.distance, query.smart)
    if query.excluded_words:
        rows = rows.where(~excluded(F.when(binary, F.col("clean")).otherwise(raw), query.excluded_words))
    return rows


def results(rows: DataFrame, query: SearchQuery, key: str = "path") -> DataFrame:
    """Per matching row (key, size, content, ext, clean): the result columns, excerpts raw and highlighted."""
    mail = F.lower("ext").isin(".eml", ".msg")
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    found = rows.select(key, "size", "clean", *(F.when(mail, header(raw, name)).alias(f"email_{name.lower()}") for name in ("Date", "Subject")))
    found = found.withColumn("raw_excerpts", excerpt_column(F.col("clean"), list(query.terms), query.budget))
    return found.select(key, "size", F.transform("raw_excerpts", lambda x: highlight(x, list(query.terms))).alias("excerpts"), "raw_excerpts", bounded(F.col("clean")).alias("clean_content"), "email_date", "email_subject")


def counts(files: DataFrame) -> list[Column]:
    """What a search may count of the files that it reads: all, bytes, those cut short, mails, portable documents."""
    size, kind = F.col("size"), F.lower("ext")
    cut = F.count_if(read_cap(size) < size).alias("truncated")
    return [F.count("*").alias("files"), F.sum("size").alias("bytes"), cut, F.count_if(kind.isin(*_MAILS)).alias("mails"), F.count_if(kind == ".pdf").alias("portable")]


def search(spark: SparkSession, query: SearchQuery, metrics: Observation | None = None) -> DataFrame:
    """The files below query.start that match, with excerpts; sorted by path when they are shown.

    metrics gets counts() once the result has been computed.
    """
    files = doctree.files(spark, query.start, list(query.types) if query.types else None, list(query.scope) or None)
    if metrics is not None:
        files = files.observe(metrics, *counts(files))
    if not query.terms:
        raise ValueError("a search needs a term")
    return results(filtered(candidates(files, query), query), query)


def matching(docs: DataFrame, query: SearchQuery, key: str, text: str) -> DataFrame:
    """The rows of a table of texts that match, with their clean text as `clean`; key tells rows apart."""
    terms = list(query.terms)
    rows = docs.where(present(F.col(text), longest_two(terms)) & present(F.col(text), terms))
    if query.excluded_words:
        rows = rows.where(~excluded(F.col(text), query.excluded_words))
    rows = rows.where(possible(F.col(text), terms, query.smart, query.distance))
    return within(rows.withColumn("clean", clean(F.col(text))), key, "clean", terms, query.distance, query.smart)


def search_table(docs: DataFrame, query: SearchQuery, key: str, text: str) -> DataFrame:
    """(key, size, excerpts, raw_excerpts) of the rows of a table of texts that match."""
    found = matching(docs, query, key, text).select(key, F.octet_length(text).cast("long").alias("size"), excerpt_column(F.col("clean"), list(query.terms), query.budget).alias("raw_excerpts"))
    return found.select(key, "size", F.transform("raw_excerpts", lambda x: highlight(x, list(query.terms))).alias("excerpts"), "raw_excerpts")
