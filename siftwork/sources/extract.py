"""Text of files by type.

Rich text, web pages and plain text are expressions. Mails, mail boxes, older and newer word-processor
documents need parsers of the standard library and run in Arrow batches, on rows of those types only.
Pages of portable documents need a program that is not part of this library: a function from bytes
to text may be registered for the type, and without one the text is null.
"""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions.cleaning import TAG, UNICODE_SPACE, html_text, rtf_text, strip_html_python, xml_text
from siftwork.functions.patterns import any_case_word
from siftwork.sources.compound import Broken, streams

_SPACES = re.compile(r"[\t\n\f\r ]+")
_NOT_PRINTED = re.compile(rb"[^\t\n\r\x20-\x7e]")
#: Bytes read of a document's streams in all.
STREAMS = 2 << 20
DOC_STREAMS = ("WordDocument", "1Table", "0Table")
ZIP_ENTRY = {"docx": "word/document.xml", "odt": "content.xml"}


def _decoded(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _collapsed(text: str) -> str:
    return _SPACES.sub(" ", text).strip(UNICODE_SPACE)


def salvaged(data: bytes) -> str:
    """Printable ASCII, everything else as spaces, collapsed."""
    return _collapsed(_NOT_PRINTED.sub(b" ", data).decode("ascii"))


def wide_text(data: bytes) -> str | None:
    """Two-byte text by its mark, as little-endian without one; None where nothing is left.

    Nearly any bytes decode, as the mark is no condition; what decides is that something remains.
    """
    for codec in ("utf-16-be",) if data[:2] == b"\xfe\xff" else ("utf-16-le",):
        body = data[2:] if data[:2] in (b"\xfe\xff", b"\xff\xfe") else data
        text = body.decode(codec, "replace").strip(UNICODE_SPACE)
        if text:
            return text
    return None


def looks_wide(data: bytes, little: bool) -> bool:
    """Whether three tenths of the bytes in the higher places are zero."""
    high = data[1 if little else 0 :: 2]
    return len(data) >= 4 and high.count(0) >= 0.3 * len(high)


def mail_text(data: bytes) -> str:
    """The plain parts of a mail, or its web page without tags; white space collapsed. Headers are no text."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    plain, web = [], []
    for part in message.walk():
        if part.is_multipart() or part.get_content_disposition() == "attachment":
            continue
        kind = part.get_content_type()
        if kind in ("text/plain", "text/html"):
            try:
                text = part.get_content()
            except (LookupError, ValueError, KeyError):
                text = _decoded(part.get_payload(decode=True) or b"")
            (plain if kind == "text/plain" else web).append(text)
    text = "\n".join(plain)
    return _collapsed(text if text.strip() else strip_html_python("\n".join(web)))


def mailbox_messages(data: bytes) -> list[bytes]:
    """The mails of a mail box; each begins after a line that starts with `From `."""
    parts = re.split(rb"(?m)^From [^\n]*\n", data)
    return [re.sub(rb"(?m)^>(>*From )", rb"\1", p) for p in parts[1:]] if re.match(rb"From ", data) else []


def mailbox_text(data: bytes) -> str:
    """The texts of all mails, a line of dashes after each; the data itself where there is no mail."""
    texts = [mail_text(m) for m in mailbox_messages(data)]
    return "".join(t + "\n---\n" for t in texts) if texts else _decoded(data)


def zipped_text(data: bytes, entry: str) -> str:
    """An entry's text without tags; the data itself where it is no archive or lacks the entry."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return re.sub(TAG[0], " ", _decoded(z.read(entry))).strip(UNICODE_SPACE)
    except (zipfile.BadZipFile, KeyError, OSError, EOFError, NotImplementedError, RuntimeError):
        return _decoded(data)


def document_text(data: bytes) -> str:
    """What can be read in the streams of an older word-processor document."""
    out, left = [], STREAMS
    try:
        for name, raw in streams(data):
            if name in DOC_STREAMS and left > 0:
                raw = raw[:left]
                left -= len(raw)
                text = _collapsed(wide_text(raw) or salvaged(raw)) if raw else ""
                if text:
                    out.append(text)
    except (Broken, ValueError, IndexError):
        pass
    return "\n".join(out) or salvaged(data)


def message_text(data: bytes) -> str:
    """Subject and body of a mail in a compound file; without either what can be read of the bytes."""
    try:
        found = dict(streams(data))
    except (Broken, ValueError, IndexError):
        found = {}

    def one(*names: str) -> str:
        raw = next((found[n] for n in names if found.get(n)), b"")
        return (wide_text(raw) or _collapsed(_decoded(raw))) if raw and names[0].endswith("F") else _decoded(raw)

    subject = one("__substg1.0_0037001F") or _collapsed(one("__substg1.0_0037001E"))
    body = one("__substg1.0_1000001F") or _collapsed(one("__substg1.0_1000001E"))
    if not body:
        body = strip_html_python(one("__substg1.0_1013001F") or one("__substg1.0_1013001E", "__substg1.0_10130102"))
    return _collapsed(f"{subject}\n\n{body}") or wide_text(data) or salvaged(data)


def _docx(data: bytes) -> str:
    return zipped_text(data, ZIP_ENTRY["docx"])


def _odt(data: bytes) -> str:
    return zipped_text(data, ZIP_ENTRY["odt"])


#: Functions from a file's bytes to its text, by type; more may be added.
PARSERS: dict[str, Callable[[bytes], str]] = {"eml": mail_text, "mbox": mailbox_text, "msg": message_text, "doc": document_text, "docx": _docx, "odt": _odt}


def parsed(ext: Column, content: Column, parsers: dict[str, Callable[[bytes], str]]) -> Column:
    """Texts of the types that parsers are given for; null for others and where a parser fails."""

    @F.pandas_udf("string")
    def run(exts: pd.Series, contents: pd.Series) -> pd.Series:
        def one(e: str, data: bytes) -> str | None:
            try:
                return parsers[e](bytes(data)).encode("utf-8", "replace").decode("utf-8")
            except Exception:  # noqa: BLE001 - any damage of a file is that file's alone
                return None

        return pd.Series([one(e, d) if d is not None and e in parsers else None for e, d in zip(exts, contents)], dtype=object)

    return run(ext, content)


def text_of(ext: Column, content: Column, parsers: dict[str, Callable[[bytes], str]] | None = None) -> Column:
    """A file's text by its type (ext: with or without a dot, any case); invalid bytes become U+FFFD."""
    parsers = PARSERS if parsers is None else parsers
    kind = F.regexp_replace(F.lower(ext), r"^\.", "")
    plain = F.make_valid_utf8(content.cast("string"))
    known = F.when(kind.isin(sorted(parsers)), parsed(F.when(kind.isin(sorted(parsers)), kind), F.when(kind.isin(sorted(parsers)), content), parsers))
    return known.when(kind == "rtf", rtf_text(plain)).when(kind == "pdf", F.lit(None).cast("string")).otherwise(plain)


def registered_text(ext: Column, content: Column) -> Column:
    """text_of(), with web pages and XML taken apart too, as a caller may ask for by type."""
    kind = F.regexp_replace(F.lower(ext), r"^\.", "")
    plain = F.make_valid_utf8(content.cast("string"))
    return F.when(kind == "html", html_text(plain)).when(kind == "xml", xml_text(plain)).otherwise(text_of(ext, content))


def early_verdict(ext: Column, content: Column, size: Column, terms: list[str], cap: int, smart: bool = False) -> Column:
    """Before extraction: true if all terms are there, false if that can be ruled out, else null.

    Mails and rich text are judged by their raw bytes up to the cap; packed documents by their entry up to
    the cap, which rules out nothing beyond it; streams of compound files, whose text may be two-byte, can
    only confirm.
    """
    from siftwork.operators.presence import longest_two, present

    some = longest_two(terms)
    raw = present(F.make_valid_utf8(F.substring(content, 1, cap).cast("string")), some, size, cap, smart)
    patterns = [re.compile(any_case_word(t, smart)) for t in some if t.strip()]

    @F.pandas_udf("boolean")
    def inside(exts: pd.Series, contents: pd.Series) -> pd.Series:
        def one(e: str, data: bytes) -> bool | None:
            try:
                if e in ZIP_ENTRY:
                    with zipfile.ZipFile(io.BytesIO(data)) as z, z.open(ZIP_ENTRY[e]) as f:
                        xml = f.read(cap + 1)
                    if all(p.search(_decoded(xml[:cap])) for p in patterns):
                        return True
                    return False if len(xml) <= cap else None
                text = "\n".join(wide_text(raw) or salvaged(raw) for name, raw in streams(data) if raw and (name in DOC_STREAMS or name.endswith("001F")))
                return True if all(p.search(text) for p in patterns) else None
            except Exception:  # noqa: BLE001 - undecided
                return None

        return pd.Series([None if d is None or e is None else one(e, bytes(d)) for e, d in zip(exts, contents)], dtype=object)

    kind = F.regexp_replace(F.lower(ext), r"^\.", "")
    packed = kind.isin("docx", "odt", "doc", "msg")
    return F.when(kind.isin("eml", "mbox", "rtf"), raw).when(packed, inside(F.when(packed, kind), F.when(packed, content)))
