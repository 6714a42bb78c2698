"""Tests of whole words in texts, and of what a capped read may leave undecided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.patterns import any_case_word, ascii_word, has_all, has_any

MIB = 1 << 20


def read_cap(size: Column) -> Column:
    """Bytes that are read of a file: all up to 10 MiB, 5 MiB beyond, 10 MiB beyond 50 MiB."""
    return F.when(size > 50 * MIB, F.lit(10 * MIB)).when(size > 10 * MIB, F.lit(5 * MIB)).otherwise(size)


def longest_two(terms: list[str]) -> list[str]:
    """The terms that a cheap test looks for first: of three or more the two longest, as likely the rarest."""
    return sorted(terms, key=lambda t: len(t.encode()), reverse=True)[:2] if len(terms) > 2 else list(terms)


def first_word_candidate(text: Column, terms: list[str]) -> Column:
    """Whether text has the first term between characters that are no ASCII word characters."""
    return text.rlike(ascii_word(terms[0])) if terms else F.lit(True)


def present(text: Column, terms: list[str], size: Column | None = None, cap: int | None = None, smart: bool = False) -> Column:
    """Whether all terms are there: true, false, or null where the cap kept the rest from being read.

    size is the whole file's length in bytes, of which text holds as much as the cap allows. Without a cap,
    or where the file ends before it, a miss is decided. No term at all is found everywhere.
    """
    found = has_all(text, terms, smart)
    if cap is None or size is None:
        return found
    return F.when(found, True).when(F.lit(cap) < read_cap(size), F.lit(None).cast("boolean")).otherwise(False)


def keep_undecided(verdict: Column) -> Column:
    """A filter that only decided misses fail."""
    return F.coalesce(verdict, F.lit(True))


def excluded(text: Column, words: list[str]) -> Column:
    """Whether one of the words is there; they are looked for in the lower-cased text."""
    return has_any(F.lower(text), [w.lower() for w in words])


def without_listed(docs: DataFrame, listed: DataFrame, text: str = "text", word: str = "word") -> DataFrame:
    """docs whose text has none of the words of a table, for exclusions that come as data.

    The words make one alternation, so no row meets another. The table is a query's list: it is read to
    the driver and may have at most 10,000 words.
    """
    words = [r[0] for r in listed.where(F.col(word).isNotNull()).select(word).distinct().limit(10_001).collect()]
    if len(words) > 10_000:
        raise ValueError("more than 10,000 words to exclude")
    return docs.where(~excluded(F.col(text), sorted(words))) if words else docs


def count_words(text: Column, term: str) -> Column:
    """How often a term stands in text as a whole word."""
    return F.regexp_count(text, F.lit(any_case_word(term)))
