"""Excerpts of matching texts.

An excerpt is a function of a clean text, the terms and a budget of bytes. Places and lengths are
bytes, and a cut may fall inside a character, whose remains become U+FFFD. It runs in Arrow batches
on the rows that a search has left, after all filters. Sentences of a whole table are an expression.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions.cleaning import CLEAN, PREPARE, UNICODE_SPACE, clean, python_chain, trim
from siftwork.functions.patterns import any_case_word

BUDGET = 400
SHORT, GROWN = 160, 600
_SPACES = re.compile(rb"[\t\n\f\r ]+")
_RULES = re.compile(rb"[-_=#]{5,}")
_STOPS = b".!?"
_HEADER = re.compile(rb"(?i)(?:Content-Type|Content-Transfer-Encoding|MIME-Version|Date|From|To|Subject|Message-ID|Return-Path|Received|X-[^:]*|Authentication-Results):")
_TITLES = frozenset("mr mrs ms dr prof sr jr st vs no inc ltd co".split())


def _trim(b: bytes) -> bytes:
    return b.decode("utf-8", "surrogateescape").strip(UNICODE_SPACE).encode("utf-8", "surrogateescape")


def _one_line(b: bytes, rules: bool) -> bytes:
    b = _trim(b).replace(b"\n", b" ").replace(b"\t", b" ")
    return _SPACES.sub(b" ", _RULES.sub(b" ", b) if rules else b)


class Places:
    """Whole words of terms in a text, as byte ranges."""

    def __init__(self, text: str, terms: list[str]):
        self.patterns = [re.compile(any_case_word(t)) for t in terms if t.strip()]
        self.text, self.bytes = text, text.encode("utf-8", "surrogateescape")
        self.plain = len(self.text) == len(self.bytes)

    def _at(self, i: int) -> int:
        return i if self.plain else len(self.text[:i].encode("utf-8", "surrogateescape"))

    def of(self, term: int, most: int | None = None) -> list[tuple[int, int]]:
        found, done, at = [], 0, 0
        for m in self.patterns[term].finditer(self.text):
            if self.plain:
                found.append(m.span())
            else:  # bytes up to here, counted on from the last match
                at += len(self.text[done : m.start()].encode("utf-8", "surrogateescape"))
                size = len(m[0].encode("utf-8", "surrogateescape"))
                found.append((at, at + size))
                done, at = m.end(), at + size
            if len(found) == most:
                break
        return found


def narrowest(places: list[list[tuple[int, int]]]) -> tuple[int, int] | None:
    """Starts of the first and last word of the narrowest span with a word of each list; the leftmost of equal ones."""
    last: list[int | None] = [None] * len(places)
    best = None
    for pos, term in sorted((p, i) for i, own in enumerate(places) for p, _ in own):
        last[term] = pos
        if None not in last and (best is None or pos - min(last) < best[1] - best[0]):
            best = (min(last), pos)
    return best


def _header_after(text: bytes, at: int) -> bool:
    """Whether the line after the line feed at a place is a mail header."""
    return at + 1 < len(text) and _HEADER.match(text[at + 1 : at + 129].split(b"\n")[0]) is not None


def sentence_around(text: bytes, start: int, end: int, reach: int) -> bytes:
    """The sentence around [start, end), or what paragraphs, lines or the reach leave of it, on one line."""
    low, high = max(0, start - reach), min(len(text), end + reach)
    left = start
    while left > low and text[left] not in _STOPS and not (text[left] == 10 and _header_after(text, left)):
        left -= 1
    if left > 0 and text[left] in _STOPS:
        left += 1
    elif left <= low:
        before = text[low:start]
        blank, line = before.rfind(b"\n\n"), before.rfind(b"\n")
        left = low + (blank + 2 if blank >= 0 else line + 1 if line >= 0 else 0)
    right = end
    while right < high and not (text[right] == 10 and _header_after(text, right)):
        right += 1
        if text[right - 1] in _STOPS:
            break
    if right >= high:
        after = text[end:high]
        stop = after.find(b"\n\n")
        stop = after.find(b"\n") if stop < 0 else stop
        right = end + stop if stop >= 0 else high
    return _one_line(text[left:right], False)


def _around_span(text: bytes, left: int, right: int, budget: int) -> bytes:
    """The budget's worth of text with the span in its middle, from space to space."""
    pad = (budget - (right - left)) // 2
    left, right = max(0, left - pad), min(len(text), right + pad)
    while left > 0 and text[left] != 32:
        left -= 1
    while 0 < right < len(text) and text[right - 1] != 32:
        right += 1
    return _one_line(text[left:right], True)[:budget]


def _by_term(text: bytes, firsts: list[tuple[int, int]], budget: int) -> bytes:
    """A piece around the first word of each term, joined; they share the budget."""
    each = max(60, budget // max(1, len(firsts))) // 2
    parts: list[bytes] = []
    used = 0
    for start, end in firsts:
        left = budget - used - (5 if parts else 0)
        if left <= 0:
            break
        piece = _one_line(text[max(0, start - each) : min(len(text), end + each)], True)[:left]
        if piece:
            parts.append(piece)
            used += len(piece)
    return b" ... ".join(parts)


def excerpts(clean: str, terms: list[str], most: int = 1, budget: int = BUDGET, context: int | None = None) -> list[str]:
    """Up to most excerpts of a clean text.

    With several terms the narrowest span with all of them makes the only excerpt: as one window if the
    budget allows, or as a piece for each term. Otherwise sentences around each term's first words are
    taken. context is half the window that a sentence may fill (200 to 4000 bytes).
    """
    prepared = python_chain(clean, PREPARE)
    places = Places(prepared, terms)
    k, text = len(places.patterns), places.bytes
    if not text or not k:
        return []
    reach = min(4000, max(200, 2 * (context or 800))) // 2
    out: list[bytes] = []
    if k > 1:
        found = [places.of(i) for i in range(k)]
        best = narrowest(found)
        if best:
            room = max(200, budget)
            one = _around_span(text, *best, room) if best[1] - best[0] <= room else _by_term(text, [f[0] for f in found], room)
            return [one.decode("utf-8", "replace")] if one else []
    for i in range(k):
        for start, end in places.of(i, 3):
            if len(out) >= most:
                break
            one = sentence_around(text, start, end, reach)
            if one and one not in out:
                out.append(one)
    cut, total = [], 0
    for one in out:
        one = one[: min(budget, budget - total)]
        cut.append(one)
        total += len(one)
        if total >= budget:
            break
    return [x.decode("utf-8", "replace") for x in cut]


def sentences(text: str) -> list[str]:
    """The clean text's sentences.

    One ends at `.`, `!` or `?` before white space, a capital or the end; not within a decimal number, nor
    after a title or other short form.
    """
    text = python_chain(text, CLEAN)
    out, begin, i, n = [], 0, 0, len(text)

    def close(to: int) -> None:
        if s := text[begin:to].strip(UNICODE_SPACE):
            out.append(s)

    while i < n:
        c = text[i]
        if c == "\n" and text[i + 1 : i + 2] == "\n":
            close(i)
            i += 2
            begin = i
            continue
        if c in ".!?":
            inside = 0 < i < n - 1 and text[i - 1] in "0123456789" and text[i + 1] in "0123456789"
            word = re.search(r"([^\W\d_]*)[\s]*$", text[max(0, i - 64) : i])
            if not inside and (not word or word[1].lower() not in _TITLES):
                after = text[i + 1 : i + 2]
                if not after or after in UNICODE_SPACE or after.isupper():
                    close(i + 1)
                    i += 1 if after and after in UNICODE_SPACE else 0
                    begin = i + 1
        i += 1
    close(n)
    return out


def _after_a_sentence() -> str:
    """Java pattern of the places between the sentences of a clean text, which has no line feeds.

    A digit after a stop ends nothing, so decimal numbers need no word here. A title may have white space
    between itself and the stop; as in sentences(), no more is looked at than 64 characters.
    """
    # one letter beyond U+FFFF is spelled out: only then does Java look back by whole characters
    letter, space = "[\U0001d400\\p{L}\\p{N}&&[^\\p{Nd}]]", f"[{UNICODE_SPACE}]"
    by_size = {k: "|".join(sorted(t for t in _TITLES if len(t) == k)) for k in sorted({len(t) for t in _TITLES})}
    title = "|".join(f"(?:(?<!{letter})(?:{t}){space}{{0,{64 - k}}}|(?:{t}){space}{{{64 - k}}})" for k, t in by_size.items())
    return rf"(?<=[.!?])(?={space}|\p{{IsUppercase}})(?<!(?i:{title})[.!?])"


def chunked(text: str, size: int) -> list[str]:
    """The text's words packed into pieces of at most size bytes where words allow."""
    out: list[str] = []
    for word in text.split():
        if out and len(out[-1].encode()) + len(word.encode()) + 1 <= size:
            out[-1] += " " + word
        else:
            out.append(word)
    return out or [text]


def grown(clean: str, excerpt: str, terms: list[str], target: int = GROWN) -> str:
    """A short excerpt with neighbouring sentences, left and right in turn, until it has target bytes."""
    each = sentences(clean)
    patterns = [re.compile(any_case_word(t)) for t in terms if t.strip()]
    at = next((i for i, s in enumerate(each) if excerpt in s), None)
    if at is None:
        at = next((i for i, s in enumerate(each) if any(p.search(s) for p in patterns)), None)
    if at is None:
        return excerpt
    left, right = at, at + 1
    size = lambda: len(" ".join(each[left:right]).encode())
    while (left > 0 or right < len(each)) and size() < target:
        if left > 0:
            left -= 1
        if right < len(each) and size() < target:
            right += 1
    return " ".join(" ".join(each[left:right]).split())


def excerpt_of(clean: str, terms: list[str], budget: int = BUDGET) -> list[str]:
    """The excerpt that a search shows: one, grown if it is short."""
    budget = min(600, max(240, budget))
    found = excerpts(clean, terms, 1, budget, budget // 2)
    if len(found) == 1 and len(found[0].encode()) < SHORT:
        more = grown(clean, found[0], terms)
        if len(more.encode()) > len(found[0].encode()):
            return [more]
    return found


def with_missing_terms(excerpt: str, clean: str, terms: list[str], budget: int = BUDGET, around: int = 120) -> str:
    """An excerpt and, for each term that it lacks, a piece of the clean text around the term's first word."""
    parts = [excerpt] if excerpt else []
    have = Places(excerpt, terms)
    places = Places(clean, terms)
    for i in range(len(places.patterns)):
        if not have.of(i, 1) and (found := places.of(i, 1)):
            start, end = found[0]
            parts.append(_one_line(places.bytes[max(0, start - around) : end + around], True).decode("utf-8", "replace"))
    return " ... ".join(parts).encode()[:budget].decode("utf-8", "replace")


def excerpt_column(clean: Column, terms: list[str], budget: int = BUDGET) -> Column:
    """excerpt_of() of a column; null texts have none."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else excerpt_of(t, terms, budget))

    return run(clean)


_ENDS_HERE = _after_a_sentence()


def sentence_column(text: Column) -> Column:
    """sentences() of a column, as an expression: no batch of texts goes through Python. Null texts have none."""
    parts = F.transform(F.split(clean(text), _ENDS_HERE, -1), trim)
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.filter(parts, lambda s: s != ""))


def first_bytes(text: Column, size: int = 1 << 16) -> Column:
    """The first size bytes of a text, as bytes: they may end inside a character."""
    return F.substring(text.cast("binary"), 1, size)


def bounded(clean: Column, size: int = 1 << 16) -> Column:
    """The first size bytes of a text, as text: what is left of a cut character becomes U+FFFD."""
    return F.when(F.octet_length(clean) <= size, clean).otherwise(F.make_valid_utf8(first_bytes(clean, size).cast("string")))
