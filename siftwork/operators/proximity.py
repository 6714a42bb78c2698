"""Terms within a distance of each other.

Places are byte offsets of whole words in the lower-cased text. For terms that are single ASCII words a
fold over a text's words does it all: it keeps the last place of each term, whose least is where the
narrowest span that ends here begins. That is one expression, so a search is one scan without an
exchange.

Other terms may overlap (`new york`, `york times`) or begin inside a word of another alphabet. For them the
same fold goes over the places where any term begins, and looks at each for every term.

Places across the pages of a document are rows, which are sorted and spilled like any others, and running
maxima by term take the fold's part: one exchange by document.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork.functions.patterns import any_case_word, any_lower_word, begins, forms, lower_word, quote, sql_word


def occurrences(docs: DataFrame, key: str, text: str, terms: list[str], smart: bool = False) -> DataFrame:
    """(key, term, pos): each place of each term (its number from 0) in a row's text, in bytes.

    The text is lower-cased. Null texts have no places. key must tell rows apart.
    """
    lower = F.lower(F.col(text))
    patterns = F.array(*(F.struct(F.lit(i).alias("term"), F.lit(lower_word(t, smart)).alias("pattern")) for i, t in enumerate(terms)))
    rows = docs.select(F.col(key).alias(key), lower.alias("_text"), F.explode(patterns).alias("_p")).select(key, "_text", "_p.*").where(F.rlike("_text", F.col("pattern")))
    gaps = F.transform(F.split("_text", F.col("pattern"), -1), F.octet_length)
    hits = F.transform(F.regexp_extract_all("_text", F.col("pattern"), F.lit(0)), F.octet_length)
    rows = rows.select(key, "term", F.posexplode(F.arrays_zip(hits.alias("hit"), gaps.alias("gap"))).alias("i", "x")).where("x.hit is not null")
    before = W.partitionBy(key, "term").orderBy("i")
    return rows.select(key, "term", (F.sum("x.gap").over(before) + F.coalesce(F.sum("x.hit").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).cast("long").alias("pos"))


def spans(places: DataFrame, key: str, k: int) -> DataFrame:
    """(key, left, right): for each place the narrowest span that ends there and has all of k terms."""
    upto = W.partitionBy(key).orderBy("pos").rangeBetween(W.unboundedPreceding, W.currentRow)
    last = [F.max(F.when(F.col("term") == i, F.col("pos"))).over(upto) for i in range(k)]
    rows = places.select(key, F.col("pos").alias("right"), *(x.alias(f"_t{i}") for i, x in enumerate(last)))
    rows = rows.where(reduce(lambda a, b: a & b, (F.col(f"_t{i}").isNotNull() for i in range(k))))
    return rows.select(key, (F.least(*(f"_t{i}" for i in range(k))) if k > 1 else F.col("_t0")).alias("left"), "right")


def simple(terms: list[str]) -> bool:
    """Whether all terms are single words of ASCII word characters, of which no two can overlap."""
    return bool(terms) and all(re.fullmatch("[0-9A-Za-z_]+", t.strip()) for t in terms)


def _fold(steps: Column, terms: int, at: int, keeps: list[str], step: Callable[[Column, Column, Column], tuple[Column, Column, list[Column], dict[str, Column]]]) -> Column:
    """(span, left, right) of the narrowest span over an array of places in order, or null.

    step gives, of the state, a place and where it is: whether it is one at all, where the next gap begins, the
    last place of each term and what else the state keeps.
    """
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(at).cast("long").alias("at"), *(none.alias(f"t{i}") for i in range(terms)), *(none.alias(name) for name in (*keeps, "span", "left", "right")))

    def one(a: Column, x: Column) -> Column:
        here = a["at"] + x["gap"]
        known, after, last, kept = step(a, x, here)
        whole = reduce(lambda p, q: p & q, (t.isNotNull() for t in last))
        left = F.least(*last) if len(last) > 1 else last[0]
        better = whole & (a["span"].isNull() | (here - left < a["span"]))
        best = [F.when(better, new).otherwise(a[name]).alias(name) for name, new in (("span", here - left), ("left", left), ("right", here))]
        return F.when(known, F.struct(after.alias("at"), *(t.alias(f"t{i}") for i, t in enumerate(last)), *(kept[name].alias(name) for name in keeps), *best)).otherwise(a)

    return F.aggregate(steps, start, one, lambda a: F.when(a["span"].isNotNull(), F.struct(a["span"].alias("span"), a["left"].alias("left"), a["right"].alias("right"))))


def _over_words(t: Column, terms: list[str], smart: bool) -> Column:
    """The fold over the words of a lower-cased text that are a form of any of simple() terms."""
    base = [x.strip().lower() for x in terms]
    endings = ["", *forms(smart)[3:-2].split("|")]
    pattern = F.lit(any_lower_word(list(dict.fromkeys(base)), smart))
    words = F.regexp_extract_all(t, pattern, F.lit(0))
    steps = F.arrays_zip(words.alias("word"), F.transform(F.split(t, pattern, -1), F.octet_length).alias("gap"))

    def step(a: Column, x: Column, here: Column):
        last = [F.when(x["word"].isin([b + e for e in endings]), here).otherwise(a[f"t{i}"]) for i, b in enumerate(base)]
        return x["word"].isNotNull(), here + F.octet_length(x["word"]), last, {}

    return _fold(steps, len(base), 0, [], step)


def _over_places(t: Column, terms: list[str], smart: bool) -> Column:
    """The fold over the places of a lower-cased text where any term begins, for terms that may overlap.

    The text is cut where one begins; at each cut each term is tried. A term does not begin before its own
    last one has ended. The text has a line feed before it, so that a term at its very start makes a cut too.
    """
    patterns = [lower_word(x, smart) for x in terms]
    place = f"(?={'|'.join(patterns)})"
    hits = [F.transform(F.regexp_extract_all(t, F.lit(f"{place}(?=({p})?)"), F.lit(1)), F.octet_length).alias(f"n{i}") for i, p in enumerate(patterns)]
    steps = F.arrays_zip(F.transform(F.split(t, place, -1), F.octet_length).alias("gap"), *hits)

    def step(a: Column, x: Column, here: Column):
        begins = [(x[f"n{i}"] > 0) & (a[f"e{i}"].isNull() | (a[f"e{i}"] <= here)) for i in range(len(terms))]
        last = [F.when(new, here).otherwise(a[f"t{i}"]) for i, new in enumerate(begins)]
        return x["n0"].isNotNull(), here, last, {f"e{i}": F.when(new, here + x[f"n{i}"]).otherwise(a[f"e{i}"]) for i, new in enumerate(begins)}

    every = reduce(lambda p, q: p & q, (t.rlike(p) for p in sorted(patterns, key=len, reverse=True)))
    return F.when(every, _fold(steps, len(terms), -1, [f"e{i}" for i in range(len(terms))], step))


def span_column(text: Column, terms: list[str], smart: bool = False) -> Column:
    """(span, left, right) of the narrowest span with all terms, the leftmost of equal ones; null without one."""
    lower = F.lower(text)
    one, fold = (lower, _over_words) if simple(terms) else (F.concat(F.lit("\n"), lower), _over_places)
    return F.get(F.transform(F.array(one), lambda t: fold(t, terms, smart)), F.lit(0))  # a variable, so that the text is computed once


def min_span(docs: DataFrame, key: str, text: str, terms: list[str], smart: bool = False) -> DataFrame:
    """(key, left, right, span) of the narrowest span with all terms, the leftmost of equal ones; only rows that have all."""
    found = (docs.where(_has_all(text, terms, smart)) if simple(terms) else docs).select(key, span_column(F.col(text), terms, smart).alias("_b"))
    return found.where("_b is not null").select(key, "_b.left", "_b.right", "_b.span")


def _has_all(text: str, terms: list[str], smart: bool) -> Column:
    """Whether the lower-cased text has all terms; longer ones, which are likely rarer, are looked for first."""
    lower = F.lower(F.col(text))
    return reduce(lambda a, b: a & b, (lower.rlike(lower_word(t, smart)) for t in sorted(terms, key=len, reverse=True)))


#: Up to this distance a raw text is tested for terms near each other. A place costs that test as many steps at most.
NEAR = 300
#: What cleaning makes one space of: control characters, spaces and marks of quotation.
_RUN = r"[\x00-\x20\x7f-\x9f>][\x00-\x20\x7f-\x9f>]+"


def possible(raw: Column, terms: list[str], smart: bool = False, distance: int | None = None) -> Column:
    """Whether the clean text of raw may have all terms: a filter before within(), so that few texts are cleaned.

    It drops no row that matches. Cleaning joins what stood apart only where it takes out styles and scripts;
    else a term's parts stand in the raw text as they are, between the same boundaries but for those between a
    letter and a digit, which cleaning may part.

    With a distance of up to NEAR the terms' first words must be near each other too. Without tags and
    entities cleaning shortens runs of spaces alone, and a character has a byte at least; so, with such runs as
    one, no more characters lie between two words than bytes in the clean text.
    """
    tests, starts = [], []
    for words in (t.strip().lower().split() for t in terms):
        for i, w in enumerate(words):
            if re.fullmatch("[0-9A-Za-z_]+", w):
                before, after = ("[0-9_]" if c.isdigit() else "[a-z_]" for c in (w[0], w[-1]))
                endings = forms(smart) if i == len(words) - 1 and not w[-1].isdigit() else ""  # a letter may follow a digit anyway
                tests.append((w, f"{w}(?<!{before}{w}){endings}(?!{after})"))
            elif not set(w) & set("σς"):  # how a capital sigma is lowered depends on what follows
                tests.append((w, quote(w)))
            else:
                continue
            if i == 0:
                starts.append(tests[-1])
    ordered = list(dict.fromkeys(p for _, p in sorted(tests, key=lambda x: len(x[0]), reverse=True)))
    every = lambda t: reduce(lambda a, b: a & b, (t.rlike(p) for p in ordered), F.lit(True))
    starts = list(dict.fromkeys(starts))
    if distance is None or distance > NEAR or len(starts) < 2:
        near = lambda t: F.lit(True)
    else:
        pattern = f"(?s){begins([w for w, _ in starts])}(?={'|'.join(p for _, p in starts)})" + "".join(f"(?=.{{0,{max(distance, 0)}}}?{p})" for _, p in starts)
        near = lambda t: t.rlike(pattern) | t.contains("<") | t.rlike("&[a-z0-9#]*;") | (t.rlike(_RUN) & F.regexp_replace(t, _RUN, " ").rlike(pattern))
    return F.get(F.transform(F.array(F.lower(raw)), lambda t: (every(t) & near(t)) | t.contains("<style") | t.contains("<script")), F.lit(0))


def within(docs: DataFrame, key: str, text: str, terms: list[str], distance: int, smart: bool = False) -> DataFrame:
    """The rows of docs whose text has all terms within distance bytes, from start to start, in any order.

    No terms match all rows; of one term presence is enough. Rows without all terms are best dropped
    before, by the raw text if text is one cleaned.
    """
    if not terms:
        return docs
    if len(terms) > 1:
        return docs.where(span_column(F.col(text), terms, smart)["span"] <= distance)
    return docs.where(_has_all(text, terms, smart))


def page_places(pages: DataFrame, key: str, page: str, text: str, terms: list[str]) -> DataFrame:
    """occurrences() of documents that come in pages: places go on from page to page, one byte between two."""
    order = W.partitionBy(key).orderBy(page).rowsBetween(W.unboundedPreceding, -1)
    starts = pages.select(F.struct(key, page).alias("_page"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_t"), key, page)
    starts = starts.withColumn("_start", F.coalesce(F.sum(F.octet_length("_t") + 1).over(order), F.lit(0)))
    found = occurrences(starts, "_page", "_t", terms)
    return found.join(starts.select("_page", "_start"), "_page").select(F.col(f"_page.{key}").alias(key), "term", (F.col("pos") + F.col("_start")).alias("pos"))


def page_presence(pages: DataFrame, key: str, page: str, text: str, terms: list[str], max_pages: int = 200, page_bytes: int = 128 << 10) -> DataFrame:
    """(key, found) of documents in pages: whether all terms are there, on whatever pages.

    Of the first max_pages pages page_bytes each are looked at. found is null where a term is missing and
    something was not looked at. Each page's verdicts are combined before they are exchanged.
    """
    number = F.row_number().over(W.partitionBy(key).orderBy(page)) if max_pages else F.lit(0)
    looked = F.when(F.octet_length(text) <= page_bytes, F.col(text)).otherwise(F.make_valid_utf8(F.substring(F.col(text).cast("binary"), 1, page_bytes).cast("string")))
    rows = pages.select(key, number.alias("_n"), looked.alias("_t"), (F.octet_length(text) > page_bytes).alias("_cut"))
    seen = F.col("_n") <= max_pages if max_pages else F.lit(True)
    hits = [F.bool_or(F.coalesce(seen & F.col("_t").rlike(any_case_word(t)), F.lit(False))).alias(f"_h{i}") for i, t in enumerate(terms) if t.strip()]
    found = rows.groupBy(key).agg(*hits, F.bool_or(~seen | F.coalesce("_cut", F.lit(False))).alias("_more"))
    every = reduce(lambda a, b: a & b, (F.col(c) for c in found.columns if c.startswith("_h")), F.lit(True))
    return found.select(key, F.when(every, True).when(~F.col("_more"), False).alias("found"))


def page_within(pages: DataFrame, key: str, page: str, text: str, terms: list[str], distance: int) -> DataFrame:
    """(key, span) of documents in pages that have all terms within distance, across pages too."""
    each = spans(page_places(pages, key, page, text, terms), key, len(terms))
    return each.groupBy(key).agg(F.min(F.col("right") - F.col("left")).alias("span")).where(F.col("span") <= distance)


def sql_occurrences(table: str, key: str, text: str, terms: list[str], smart: bool = False) -> str:
    """occurrences() as a query for DuckDB."""
    one = "UNION ALL ".join(
        f"SELECT {key}, {i} AS term, unnest(string_split_regex(t, {p})) AS gap, unnest(regexp_extract_all(t, {p})) AS hit, generate_subscripts(string_split_regex(t, {p}), 1) AS i FROM src "
        for i, p in ((i, sql_word(t, smart, any_case=False)) for i, t in enumerate(terms))
    )
    return f"""WITH src AS (SELECT {key}, lower({text}) AS t FROM {table}), parts AS ({one})
SELECT {key}, term, (sum(strlen(gap)) OVER (PARTITION BY {key}, term ORDER BY i) + coalesce(sum(strlen(hit)) OVER (PARTITION BY {key}, term ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS pos
FROM parts QUALIFY hit IS NOT NULL"""


def sql_spans(places: str, key: str, k: int) -> str:
    """spans() of a query for DuckDB."""
    last = ", ".join(f"max(CASE WHEN term = {i} THEN pos END) OVER (PARTITION BY {key} ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t{i}" for i in range(k))
    least = f"least({', '.join(f't{i}' for i in range(k))})" if k > 1 else "t0"
    return f"SELECT {key}, {least} AS \"left\", pos AS \"right\" FROM (SELECT {key}, pos, {last} FROM ({places})) WHERE {' AND '.join(f't{i} IS NOT NULL' for i in range(k))}"


def sql_min_span(places: str, key: str, k: int) -> str:
    """min_span() of a query for DuckDB."""
    return f"""SELECT {key}, b."left", b."right", b.span FROM (
  SELECT {key}, min({{'span': "right" - "left", 'left': "left", 'right': "right"}}) AS b FROM ({sql_spans(places, key, k)}) GROUP BY {key})"""
