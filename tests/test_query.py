import json

import pytest
from pyspark.sql import Row

from siftwork import cli
from siftwork.operators.paths import may_lead_to, path_scope, start_folder
from siftwork.plans.query import heavy_slots, parse
from siftwork.plans.sinks import json_envelope, plain_lines
from siftwork.sources import filetypes


@pytest.mark.parametrize("raw, clean", [("/home/user/projects/myrepo", "/home/user/projects/myrepo"), ("/home/user/repo/", "/home/user/repo"), ("C:\\Users\\me", "C:\\Users\\me"), ("C:/Users/me", "C:/Users/me"), ("/home/my repo", "/home/my repo"), ("../sibling/project", "../sibling/project"), ("a//b/./c/..", "a/b"), (".", ".")])
def test_start_folders(raw, clean):
    assert start_folder(raw) == clean


@pytest.mark.parametrize("raw", ["", *(f"/home/{c}x" for c in "*?;&|`$><\n\r[]{}")])
def test_start_folders_that_are_refused(raw):
    with pytest.raises(ValueError):
        start_folder(raw)


@pytest.mark.parametrize("raw, parts", [("", None), (" , ", None), ("*/backend/*", ["*/backend/*"]), ("*/a/*,tests/*", ["*/a/*", "tests/*"]), (" a , b ", ["a", "b"]), ("*.cs", ["*.cs"]), ("back.end", ["back.end"]), ("a?", ["a?"]), ("*/*test", ["*/*test"]), ("a,", ["a"])])
def test_scopes(raw, parts):
    assert path_scope(raw) == parts


@pytest.mark.parametrize("c", "[];()^+$|{}&`<>\\\n")
def test_scopes_that_are_refused(c):
    with pytest.raises(ValueError):
        path_scope(f"a{c}b")


def test_folders_that_may_lead_into_a_scope():
    assert may_lead_to("docs", ["docs/plans"]) and may_lead_to("docs/plans/x", ["docs/plans/"]) and may_lead_to("any", ["*/x"])
    assert may_lead_to("any", None) and not may_lead_to("src", ["docs/plans"]) and not may_lead_to("doc", ["docs"])


def test_flags():
    a = parse(["foo", "--startdir", "/home/user/project/", "bar", "--pathscope", "*/backend/*,tests/*", "--code", "--distance", "12"])
    assert (a.terms, a.start, a.scope, a.code, a.distance, a.errors) == (["foo", "bar"], "/home/user/project", ["*/backend/*", "tests/*"], True, 12, [])
    a = parse(["a", "--not", "b", "--json", ".pdf", "--only", ".MD"])
    assert (a.terms, a.excludes, a.json, a.only) == (["a"], ["b", ".pdf"], True, "md")
    assert a.query().excluded_types == [".pdf"] and a.query().excluded_words == ["b"] and a.query().types == ("md",)
    assert parse(["a", "--distance", "-3"]).query().distance == 5000 and parse(["a", "--distance", "x", "b"]).terms == ["a", "b"]
    assert parse(["--startdir=/x", "a"]).terms == ["--startdir=/x", "a"]
    assert parse(["a", "-distance", "7", "-workers", "9"]).distance == 7
    assert parse(["a", "--startdir"]).terms == ["a"]
    for bad in (["--startdir", "/home/user/proj*"], ["--startdir", "/home;bad"], ["--pathscope", "*/backend/[Aa]ssembly"]):
        assert parse(["foo", *bad]).errors
    assert parse(["x"]).workers == 4 and parse(["x", "--workers", "8"]).workers == 8
    assert heavy_slots(16, 64) == 8 and heavy_slots(4, 64) == 2 and heavy_slots(8, 3) == 1 and heavy_slots(1, 0) == 1


def test_types():
    assert "docx" in filetypes.searched() and "py" not in filetypes.searched() and "py" in filetypes.searched(True) and filetypes.searched(True, ".TXT") == ["txt"]
    assert filetypes.is_document("a/B.PDF") and not filetypes.is_document("a.go") and filetypes.is_code("x.hpp") and filetypes.is_hidden(".x")
    assert filetypes.known() < filetypes.known(True) and filetypes.suffix("noext") == "" and "code" in filetypes.described(True)


def test_sinks():
    rows = [Row(path="/a", size=3, raw_excerpts=["x <b> & é"]), Row(path="/b", size=0, raw_excerpts=[])]
    text = json_envelope(parse(["t", "--json"]), rows)
    assert json.loads(text) == {"query": {"terms": ["t"], "include_code": False}, "matches": 2, "results": [{"file": "/a", "size_bytes": 3, "excerpts": ["x <b> & é"]}, {"file": "/b", "size_bytes": 0, "excerpts": []}]}
    assert "\\u003cb\\u003e \\u0026 é" in text and text.startswith('{\n  "query"')
    full = json.loads(json_envelope(parse(["t", "--startdir", "/s", "--pathscope", "p", "--only", "md", "--not", "n"]), []))
    assert full["query"] == {"terms": ["t"], "excludes": ["n"], "start_dir": "/s", "path_scope": ["p"], "only_type": "md", "include_code": False} and full["results"] == []
    assert plain_lines(rows) == "MATCH 1/2\nFILE: /a\nSIZE: 3\nEXCERPT 1: x <b> & é\n---\nMATCH 2/2\nFILE: /b\nSIZE: 0\n---"
    assert plain_lines([]) == "NO RESULTS"


def test_exit_codes(spark, tmp_path):
    assert cli.run(parse(["--help"]))[0] == 0 and cli.run(parse(["--version"]))[1].startswith("siftwork ")
    assert cli.run(parse([]))[0] == 1 and cli.run(parse(["a", "--startdir", "x*"]))[0] == 1
    (tmp_path / "a.txt").write_text("the token is with the server")
    code, out, _ = cli.run(parse(["token", "server", "--startdir", str(tmp_path), "--json"]), spark)
    assert code == 0 and json.loads(out)["matches"] == 1
    assert cli.run(parse(["absent", "--startdir", str(tmp_path)]), spark) == (0, "NO RESULTS", "")
