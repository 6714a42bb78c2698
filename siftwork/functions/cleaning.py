"""Cleaning of marked-up text, as chained expressions, in an order that is part of the result.

Control characters become spaces before lines are looked at, so the rules for lines see one line: a
text of dividers alone is emptied, and so is a text that begins with a quotation mark of mails.
Each chain has a counterpart in DuckDB's SQL, made from the same table of steps.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions.patterns import S, sql_text

#: What Unicode counts as white space.
UNICODE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_EDGE = "[" + "".join(f"\\x{{{ord(c):04x}}}" for c in UNICODE_SPACE) + "]+"
TRIM = (f"^{_EDGE}|{_EDGE}$", "")

STYLE = (r"(?s)<style[^>]*>.*?</style>", "")
SCRIPT = (r"(?s)<script[^>]*>.*?</script>", "")
TAG = (r"<[^>]*>", " ")
ENTITY = (r"&[a-zA-Z0-9#]*;", " ")
CONTROL = (r"[\x00-\x1f\x7f-\x9f]", " ")
#: (?m) with line feeds as the only line ends; RE2 has no other, Java needs (?d).
DIVIDER_LINE = (f"(?md)^{S}*[-_=#]{{5,}}{S}*$", "")
QUOTED_LINE = (r"(?md)^>+.*$", "")
QUOTE_START = (f"(?md)^{S}*>+{S}*", "")
QUOTE_INSIDE = (f"{S}*>+{S}*", " ")
SPACES = (f"{S}+", " ")
LETTER_DIGIT = (r"([A-Z])([0-9])", "$1 $2")
DIGIT_LETTER = (r"([0-9])([A-Z])", "$1 $2")
COMMA = (r",([^\t\n\f\r ])", ", $1")

CLEAN = (STYLE, SCRIPT, TAG, ENTITY, CONTROL, DIVIDER_LINE, QUOTED_LINE, QUOTE_START, QUOTE_INSIDE, SPACES, LETTER_DIGIT, DIGIT_LETTER, COMMA, TRIM)
#: Of the clean text once more, for excerpts: control characters go, words and commas stay as they are.
PREPARE = (STYLE, SCRIPT, TAG, ENTITY, (CONTROL[0], ""), DIVIDER_LINE, QUOTED_LINE, QUOTE_START, QUOTE_INSIDE)
#: Steps that change no text without this mark, which few texts have.
_QUOTED = (QUOTED_LINE, QUOTE_START, QUOTE_INSIDE)
XML_TEXT = (TAG, TRIM)
RTF_TEXT = ((r"\\[a-z]+[0-9]*", ""), (r"[{}]", ""), SPACES, TRIM)
NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}


def trim(text: Column) -> Column:
    """TRIM without a pattern, which would be tried at every place of a text."""
    return F.btrim(text, F.lit(UNICODE_SPACE))


def _replaced(text: Column, steps: tuple) -> Column:
    return reduce(lambda c, step: trim(c) if step is TRIM else F.regexp_replace(c, step[0], step[1]), steps, text)


def _if_quoted(text: Column, steps: tuple) -> Column:
    """Steps of _QUOTED, for texts with their mark; a variable, so that the text is computed once."""
    return F.get(F.transform(F.array(text), lambda t: F.when(t.contains(">"), _replaced(t, steps)).otherwise(t)), F.lit(0))


def chain(text: Column, steps: tuple) -> Column:
    for quoted, group in groupby(steps, lambda step: step in _QUOTED):
        text = (_if_quoted if quoted else _replaced)(text, tuple(group))
    return text


def sql_chain(text: str, steps: tuple) -> str:
    """chain() for DuckDB."""
    for pattern, to in steps:
        text = f"regexp_replace({text}, {sql_text(pattern.replace('(?md)', '(?m)'))}, {sql_text(to.replace('$', chr(92)))}, 'g')"
    return text


def python_chain(text: str, steps: tuple) -> str:
    """chain() for Python, for operators that work row by row."""
    for pattern, to in steps:
        pattern = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{m[1]}", pattern.replace("(?md)", "(?m)"))
        text = re.sub(pattern, to.replace("$", "\\"), text)
    return text


def clean(text: Column) -> Column:
    """The text that proximity and excerpts work on."""
    return chain(text, CLEAN)


def html_text(text: Column) -> Column:
    """Tags as spaces; five entities decoded one after the other, others left; trimmed."""
    for name, char in NAMED.items():
        text = F.replace(text if name != "&amp;" else F.regexp_replace(text, *TAG), F.lit(name), F.lit(char))
    return trim(text)


def sql_html_text(text: str) -> str:
    text = sql_chain(text, (TAG,))
    for name, char in NAMED.items():
        text = f"replace({text}, {sql_text(name)}, {sql_text(char)})"
    return sql_chain(text, (TRIM,))


def strip_html(text: Column) -> Column:
    """Tags as spaces; five entities decoded, all others as spaces; each place is looked at once."""
    kept = F.regexp_replace(F.regexp_replace(text, *TAG), "&(?!(?:amp|lt|gt|quot|apos);)[a-zA-Z0-9#]*;", " ")
    parts = F.split(kept, "&(?=(?:amp|lt|gt|quot|apos);)")
    known = F.create_map(*(F.lit(x) for name, char in NAMED.items() for x in (name[1:-1], char)))
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.element_at(known, F.substring_index(p, ";", 1)), F.regexp_replace(p, "^[a-z]+;", "")))
    return F.when(text.isNotNull(), F.concat(F.get(parts, 0), F.array_join(rest, "")))


def sql_strip_html(text: str) -> str:
    """strip_html() for DuckDB, for texts without the characters 1 to 5."""
    text = sql_chain(text, (TAG,))
    for k, name in enumerate(NAMED, 1):
        text = f"replace({text}, {sql_text(name)}, chr({k}))"
    text = sql_chain(text, (ENTITY,))
    for k, char in enumerate(NAMED.values(), 1):
        text = f"replace({text}, chr({k}), {sql_text(char)})"
    return text


def strip_html_python(text: str) -> str:
    """strip_html() of one text."""
    return re.sub(ENTITY[0], lambda m: NAMED.get(m[0], " "), re.sub(TAG[0], " ", text))


def xml_text(text: Column) -> Column:
    return chain(text, XML_TEXT)


def rtf_text(text: Column) -> Column:
    """Control words and braces removed, white space collapsed."""
    return chain(text, RTF_TEXT)


def salvage_ascii(data: Column) -> Column:
    """Printable ASCII of a binary column, everything else as space, collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.decode(data, "ISO-8859-1"), r"[^\t\n\r\x20-\x7e]", " "), r"[\t\n\f\r ]+", " "))


def header(text: Column, name: str) -> Column:
    """The first `name:` line's value in a raw mail, trimmed; null where there is none."""
    found = F.regexp_extract(text, f"(?mdi)^{name}:{S}*(.+)$", 1)
    return F.when(found != "", trim(found))


def sql_header(text: str, name: str) -> str:
    found = f"regexp_extract({text}, {sql_text(rf'(?mi)^{name}:[\t\n\f\r ]*(.+)$')}, 1)"
    return f"CASE WHEN {found} <> '' THEN {sql_chain(found, (TRIM,))} END"


def highlight(text: Column, terms: list[str]) -> Column:
    """Each term's whole words in bold red, term after term; a term may hit what an earlier one wrote."""
    from siftwork.functions.patterns import any_case_word

    for t in terms:
        text = F.regexp_replace(text, any_case_word(t), "\x1b[1;31m$0\x1b[0m")
    return text


def sql_highlight(text: str, terms: list[str]) -> str:
    from siftwork.functions.patterns import sql_word

    for t in terms:
        text = f"regexp_replace({text}, {sql_word(t)}, chr(27) || '[1;31m\\0' || chr(27) || '[0m', 'g')"
    return text


_MAIL_HEADER = "(?i)^(?:Content-Type|Content-Transfer-Encoding|MIME-Version|Date|From|To|Subject|Message-ID|Return-Path|Received|X-[^:]*|Authentication-Results):"
_SYMBOLS_ONLY = r"^[^a-zA-Z]*$|^[{}\[\]();:=<>|\\]{3,}"


def has_letters(line: Column) -> Column:
    return line.rlike(r"\p{L}")


def is_obvious_junk(line: Column) -> Column:
    """Mail headers, lines of symbols, lines without a letter."""
    return line.rlike(_MAIL_HEADER) | line.rlike(_SYMBOLS_ONLY) | ~has_letters(line)


def is_junk(line: Column) -> Column:
    """Mail headers, lines of symbols, lines with over 0.6 marks or symbols a letter."""
    letters, marks = (F.regexp_count(line, F.lit(p)) for p in (r"\p{L}", r"[\p{P}\p{S}]"))
    return line.rlike(_MAIL_HEADER) | line.rlike(_SYMBOLS_ONLY) | ((letters > 0) & (marks / letters > 0.6))


def format_size(n: Column) -> Column:
    """Bytes as text: `512 B`, `1.5 KB`, in steps of 1024."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate("KMGTPE", 1):
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.1f", F.bround(n / F.lit(float(1024**k)), 1)), F.lit(f" {unit}B"))).otherwise(out)
    return out


def sql_format_size(n: str) -> str:
    out = f"{n}::VARCHAR || ' B'"
    for k, unit in enumerate("KMGTPE", 1):
        out = f"CASE WHEN {n} >= {1024**k} THEN printf('%.1f', {n} / {1024**k}.0::DOUBLE) || ' {unit}B' ELSE {out} END"
    return out


def format_count(n: Column) -> Column:
    """A number with commas between thousands."""
    return F.format_number(n, 0)
