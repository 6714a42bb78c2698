"""Whole-word patterns with one meaning in Spark (Java), DuckDB (RE2) and Python.

Java's word boundary and white space know more characters than those of the search's dialect, so
patterns for Spark and Python spell both out: a boundary lies between an ASCII word character and
anything else. Case is folded as Unicode's simple folding does, but for the candidate test, which
folds ASCII letters only.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "0-9A-Za-z_"
#: A word boundary that looks at ASCII only.
B = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
#: White space, without the vertical tab.
S = r"[\t\n\f\r ]"
FORMS = "(?:es|s)?"
SMART_FORMS = "(?:es|s|ed|ing|al|tion|ation)?"
#: Matches nothing.
NEVER = r"a\A"


def quote(term: str) -> str:
    """term as a pattern for itself, in all three dialects."""
    return re.sub(r"([\\.+*?()|\[\]{}^$])", r"\\\1", term)


def forms(smart: bool) -> str:
    return SMART_FORMS if smart else FORMS


def _spelled(text: str) -> str:
    """A pattern for text in any case: classes for ASCII letters, with what folds to them, flags for others."""
    more = {"k": "\u212a", "s": "\u017f"}
    return "".join(f"[{c.lower()}{c.upper()}{more.get(c.lower(), '')}]" if c.isascii() and c.isalpha() else quote(c) if c.isascii() else f"(?iu:{c})" for c in text)


def _is_word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def _bounded(base: str, first: str, last: str, endings: str) -> str:
    """A base with its endings between word boundaries.

    The base comes first and is then looked back over, so that a place is left as soon as a letter differs.
    """
    start = f"{base}(?<![{WORD}]{base})" if _is_word(first) else f"{base}(?<=[{WORD}]{base})"
    return f"{start}{endings}" + (f"(?![{WORD}])" if _is_word(last) else B)


def lower_word(term: str, smart: bool = False) -> str:
    """Java pattern of a term, with its forms, in a text that is lower-cased already; blank terms match nothing."""
    base = term.strip().lower()
    return _bounded(quote(base), base[0], base[-1], forms(smart)) if base else NEVER


def begins(terms: list[str]) -> str:
    """Java pattern that looks ahead for the first character of any of terms, so that most places are left at once."""
    return "(?=[" + "".join(dict.fromkeys(c if c.isalnum() else f"\\{c}" for c in (t[0] for t in terms))) + "])"


def any_lower_word(terms: list[str], smart: bool = False) -> str:
    """Java pattern of any of some terms of ASCII word characters, with its forms, in a lower-cased text."""
    return begins(terms) + "(?:" + "|".join(f"{t}(?<![{WORD}]{t})" for t in terms) + f"){forms(smart)}(?![{WORD}])"


def any_case_word(term: str, smart: bool = False) -> str:
    """Java (and Python) pattern of a term, with its forms, in any case."""
    base = term.strip()
    endings = "(?:" + "|".join(map(_spelled, forms(smart)[3:-2].split("|"))) + ")?"
    return _bounded(_spelled(base), base[0], base[-1], endings) if base else NEVER


def ascii_word(term: str) -> str:
    """Java pattern of the candidate test: ASCII letters in any case, no word character on either side."""
    base = term.lower()
    return f"(?i)(?<![{WORD}])(?:{quote(base)}{FORMS})(?![{WORD}])" if base else NEVER


def has_all(text: Column, terms: list[str], smart: bool = False) -> Column:
    """Whether text has every term as a whole word; blank terms are skipped. Rarer (longer) terms are tried first."""
    given = sorted((t for t in terms if t.strip()), key=len, reverse=True)
    return reduce(lambda a, b: a & b, (text.rlike(any_case_word(t, smart)) for t in given), F.lit(True))


def has_any(text: Column, terms: list[str]) -> Column:
    """Whether text has one of the terms as a whole word, without smart forms."""
    return reduce(lambda a, b: a | b, (text.rlike(any_case_word(t)) for t in terms if t.strip()), F.lit(False))


def glob(pattern: str) -> str:
    """Java pattern of a path pattern; its `*` and `?` do not cross a slash."""
    return "^" + "".join({"*": "[^/]*", "?": "[^/]"}.get(c, quote(c)) for c in pattern) + "$"


def sql_text(s: str) -> str:
    """s as an SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_word(term: str, smart: bool = False, any_case: bool = True) -> str:
    """The RE2 pattern of a term as an SQL literal, for DuckDB."""
    base = term.strip() if any_case else term.strip().lower()
    return sql_text(("(?i)" if any_case else "") + rf"\b(?:{quote(base)}{forms(smart)})\b")
