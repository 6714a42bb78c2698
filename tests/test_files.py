import io
import struct
import zipfile
from email.message import EmailMessage

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from siftwork.plans.query import SearchQuery
from siftwork.plans.search import search
from siftwork.sources import compound, doctree, extract

TREE = {
    "backend/service/auth.go": "package service\nfunc Auth() {}\n", "backend/service/auth.md": "# auth\ntoken authentication service\n", "backend/Assembly/main.cs": "using System;\nclass Main { static void Main() {} }\n", "backend/Assembly/main.md": "# Assembly main\nassembly entry point\n",
    "frontend/app.ts": "export function app() {}\n", "frontend/app.md": "# frontend app\napp description\n", "tests/backend_test.go": "package tests\nfunc TestBackend() {}\n", "tests/frontend_test.go": "package tests\nfunc TestFrontend() {}\n", "tests/endpoint_test.md": "# endpoint test\nendpoint coverage\n",
}
TYPES = ["md", "go", "cs", "ts"]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


@pytest.mark.parametrize("below, scope, n", [("", None, 9), ("", [], 9), ("backend", None, 4), ("", ["*/Assembly/*"], 2), ("", ["tests/*"], 3), ("", ["*/Assembly/*", "tests/*"], 5), ("", ["tests/"], 3), ("", ["tests"], 3), ("", ["backend/service/auth.md"], 1), ("", ["*.md"], 0), ("", ["x"], 0)])
def test_counts(spark, tree, below, scope, n):
    assert doctree.count_files(spark, str(tree / below), TYPES, scope) == n


@pytest.mark.parametrize("term, below, scope, found", [("auth", "", (), {"backend/service/auth.md", "backend/service/auth.go"}), ("app", "frontend", (), {"app.md", "app.ts"}), ("assembly", "", ("*/Assembly/*",), {"backend/Assembly/main.md"}), ("assembly", "", ("tests/*",), set())])
def test_first_words(spark, tree, term, below, scope, found):
    rows = search(spark, SearchQuery((term,), types=tuple(TYPES), start=str(tree / below), scope=scope)).collect()
    assert {r["path"].removeprefix(f"{tree / below}/") for r in rows} == found


def test_counts_of_what_was_read(spark, tree):
    seen = Observation("files")
    assert len(search(spark, SearchQuery(("auth",), types=("md", "go"), start=str(tree)), seen).collect()) == 2
    assert seen.get == {"files": 7, "bytes": sum(len(t) for p, t in TREE.items() if p.endswith(("md", "go"))), "truncated": 0, "mails": 0, "portable": 0}


def test_folders_names_and_exclusions(spark, tmp_path):
    for path in ("a.txt", "build/b.txt", ".config/c.txt", "x/node_modules/d.txt", "E.TXT", "f.pdf", "noext", ".hidden.txt", "_u.txt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("alpha <b secret>beta</b>")
    q = SearchQuery(("alpha", "beta"), types=("txt", "pdf"), start=str(tmp_path))
    names = lambda q: {r["path"].removeprefix(f"{tmp_path}/") for r in search(spark, q).collect()}
    assert names(q) == {"a.txt", ".config/c.txt", "E.TXT", ".hidden.txt", "_u.txt"}
    assert names(SearchQuery(("alpha", "beta"), (".txt",), types=("txt",), start=str(tmp_path))) == {"E.TXT"}
    assert names(SearchQuery(("alpha", "beta"), ("SECRET",), types=("txt",), start=str(tmp_path))) == set()
    assert names(SearchQuery(("alpha", "secret"), types=("txt",), start=str(tmp_path))) == set()
    assert {r["path"] for r in doctree.files(spark, str(tmp_path), ["txt"], content=False).where("content is null").collect()}
    (row,) = doctree.files(spark, str(tmp_path), ["pdf"]).collect()
    assert (row["relative"], row["ext"], row["size"], bytes(row["content"])) == ("f.pdf", ".pdf", 24, b"alpha <b secret>beta</b>")


def mail(text: str | None = "plain alpha\n\nbody", html: str | None = None) -> bytes:
    m = EmailMessage()
    m["Subject"], m["Date"], m["From"] = "Hello there", "Mon, 1 Jan 2024 10:00:00 +0000", "a@example.com"
    if text is not None:
        m.set_content(text)
        if html:
            m.add_alternative(html, subtype="html")
    else:
        m.set_content(html, subtype="html")
    return bytes(m)


def zipped(entry: str, text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("other.xml", "<x/>")
        z.writestr(entry, text)
    return out.getvalue()


def compound_file(streams: dict[str, bytes]) -> bytes:
    """A compound file: short streams in the small store, others in sectors of 512 bytes."""
    pad = lambda b, n: b + bytes(-len(b) % n)
    small, mini, entries, sectors, fat = [], b"", [], [], []

    def put(data: bytes) -> int:
        first = len(sectors)
        parts = [pad(data, 512)[i : i + 512] for i in range(0, len(pad(data, 512)), 512)]
        sectors.extend(parts)
        fat.extend([*range(first + 1, first + len(parts)), 0xFFFFFFFE])
        return first

    for name, data in streams.items():
        if len(data) < 4096:
            first, n = len(small), len(pad(data, 64)) // 64
            small += [*range(first + 1, first + n), 0xFFFFFFFE]
            mini += pad(data, 64)
            entries.append((name, 2, first, len(data)))
        else:
            entries.append((name, 2, put(data), len(data)))
    root = put(mini) if mini else 0xFFFFFFFE
    mini_fat = put(struct.pack(f"<{len(small)}I", *small)) if small else 0xFFFFFFFE
    directory = b""
    for name, kind, start, size in [("Root Entry", 5, root, len(mini)), *entries]:
        raw = name.encode("utf-16-le") + b"\0\0"
        directory += pad(raw, 64)[:64].ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + bytes(48) + struct.pack("<IQ", start, size)
    first_dir = put(directory)
    fat_at = len(sectors)
    fat.append(0xFFFFFFFD)
    sectors.append(struct.pack("<128I", *(fat + [0xFFFFFFFF] * (128 - len(fat)))))
    head = compound.MAGIC + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<9I", 0, 1, first_dir, 0, 4096, mini_fat, 1 if small else 0, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", fat_at, *[0xFFFFFFFF] * 108)
    return head + b"".join(sectors)


def wide(s: str) -> bytes:
    return s.encode("utf-16-le")


FILES = {
    "a.eml": (mail(), "plain alpha body"), "b.eml": (mail(None, "<p>web &amp; alpha&nbsp;x</p>"), "web & alpha x"), "c.mbox": (b"From x\n" + mail("one") + b"\nFrom y\n" + mail("two\n\n>From z"), "one\n---\ntwo From z\n---\n"), "d.mbox": (b"no mail", "no mail"),
    "e.docx": (zipped("word/document.xml", "<w>alpha</w><w>beta é</w>"), "alpha  beta é"), "f.odt": (zipped("content.xml", "<t>alpha</t>"), "alpha"), "g.docx": (b"not zipped", "not zipped"), "h.docx": (zipped("x", "y"), None),
    "i.rtf": (rb"{\rtf1\ansi alpha\par beta}", "alpha beta"), "j.doc": (compound_file({"WordDocument": wide("alpha beta"), "Other": wide("gamma")}), "alpha beta"), "k.doc": (b"\x01salvage \xff me", "salvage me"), "l.doc": (compound_file({"WordDocument": wide("long " * 1000)}), "long " * 999 + "long"),
    "m.msg": (compound_file({"__substg1.0_0037001F": wide("Subject line"), "__substg1.0_1000001F": wide("body  alpha")}), "Subject line body alpha"), "n.msg": (compound_file({"__substg1.0_10130102": b"<p>web alpha</p>"}), "web alpha"), "o.pdf": (b"%PDF", None), "p.txt": (b"bad \xff utf", "bad � utf"),
}


def test_extraction(spark):
    rows = spark.createDataFrame([(n, "." + n.split(".")[1].upper(), d) for n, (d, _) in FILES.items()], "name string, ext string, content binary").select("name", extract.text_of(F.col("ext"), F.col("content")).alias("text")).collect()
    for r in rows:
        if FILES[r["name"]][1] is not None or r["name"].endswith("pdf"):
            assert r["text"] == FILES[r["name"]][1], r["name"]


def test_web_pages_and_other_parsers(spark):
    rows = spark.createDataFrame([("html", b"<p>a&amp;lt;b &copy;</p>"), ("xml", b"<a>x</a>&amp;"), ("pdf", b"pages")], "ext string, content binary")
    assert [r[0] for r in rows.select(extract.registered_text(F.col("ext"), F.col("content"))).collect()] == ["a<b &copy;", "x &amp;", None]
    assert rows.where("ext = 'pdf'").select(extract.text_of(F.col("ext"), F.col("content"), {"pdf": lambda d: d.decode().upper()}).alias("t")).first()["t"] == "PAGES"
    assert extract.looks_wide(wide("abcd"), True) and not extract.looks_wide(b"abcd", True) and extract.wide_text(b"\xfe\xff\0a") == "a" and extract.wide_text(b"") is None


def test_early_verdicts(spark):
    cases = [("eml", b"alpha", 5, ["alpha"], True), ("eml", b"beta", 4, ["alpha"], False), ("eml", b"beta" * 100, 400, ["alpha"], None), ("docx", FILES["e.docx"][0], 999, ["alpha", "beta"], True), ("docx", FILES["e.docx"][0], 999, ["gamma"], False), ("docx", b"no zip", 6, ["a"], None), ("doc", FILES["j.doc"][0], 999, ["alpha"], True), ("doc", FILES["j.doc"][0], 999, ["gamma"], None), ("pdf", b"alpha", 5, ["alpha"], None)]
    for ext, data, size, terms, want in cases:
        row = spark.createDataFrame([(ext, data, size)], "ext string, content binary, size long").select(extract.early_verdict(F.col("ext"), F.col("content"), F.col("size"), terms, 100).alias("v")).first()
        assert row["v"] is want, (ext, terms)


def test_broken_containers():
    good = FILES["m.msg"][0]
    for n in (0, 8, 100, 600, len(good) - 700):
        try:
            list(compound.streams(good[:n]))
        except (compound.Broken, ValueError, struct.error, IndexError):
            pass
        extract.message_text(good[:n])
        extract.document_text(good[:n])


def test_search_over_all_types(spark, tmp_path):
    for name, (data, _) in FILES.items():
        (tmp_path / name).write_bytes(data)
    rows = {r["path"].rpartition("/")[2]: r for r in search(spark, SearchQuery(("alpha",), start=str(tmp_path), types=tuple({n.split(".")[1] for n in FILES}))).collect()}
    assert set(rows) == {"a.eml", "b.eml", "e.docx", "f.odt", "i.rtf", "j.doc", "m.msg", "n.msg"}
    assert rows["a.eml"]["email_subject"] == "Hello there" and rows["a.eml"]["email_date"].startswith("Mon, 01 Jan") and rows["e.docx"]["email_date"] is None
    assert rows["a.eml"]["size"] == len(FILES["a.eml"][0]) and rows["i.rtf"]["clean_content"] == "alpha beta"
