import hashlib
import random

import pytest

import __spark_entry__
from siftwork.llm import merkle
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def text(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return "\n".join(cases.prose(rng.randrange(1, 14), rng.randrange(10**6)) for _ in range(n))


def test_op10_against_its_rule(spark):
    rows = {r["doc_id"]: r for r in __spark_entry__.queries()["op10_fingerprints"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(texts)
    assert sorted(rows) == ids
    prints: dict = {}
    for k, after in zip(ids, ids[1:] + ids[:1]):
        t, n = texts[k], texts[after]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        own, other, following = merkle.trees([t, edited, n]).text()
        r = rows[k]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), own, other)
        assert (r["near_edited"], r["near_next"]) == (merkle.compare(own, other), merkle.compare(own, following))
        assert prints.setdefault(t, own) == own
    assert len(set(prints.values())) == len(prints)
    assert sum(r["near_edited"] > r["near_next"] for r in rows.values()) > 0.9 * len(rows)


def test_fingerprints_are_bounded_and_tell_likeness():
    short, long = merkle.trees([text(3, 1), text(20_000, 2)]).text()
    assert len(long) <= 35 + 10 * sum(merkle.KEPT) and len(short) < len(long)
    base = text(300, 3).split("\n")
    near = []
    for share in (0, 0.05, 0.2, 0.5, 1):
        rng = random.Random(4)
        other = [cases.prose(8, rng.randrange(10**6)) + " z" if rng.random() < share else line for line in base]
        near.append(merkle.compare(*merkle.trees(["\n".join(base), "\n".join(other)]).text()))
    assert near[0] == 1 and near == sorted(near, reverse=True) and near[1] > 0.75 and near[4] < 0.2
    a, b, c = merkle.trees(["", "x", "x "]).text()
    assert merkle.compare(a, a) == 1 and merkle.compare(a, b) == 0 and merkle.compare(b, c) < 1
    assert merkle.trees(["same text"]).text() == merkle.trees(["other", "same text", ""]).text()[1:2]


def rebuilt(before: str, after: str) -> str:
    """after, from before and the edits alone."""
    out, at = [], 0
    for a, b, c, d in merkle.edits(before, after):
        out += [before[at:a], after[c:d]]
        at = b
    return "".join(out) + before[at:]


def test_edits_are_located():
    lines = text(200, 5).split("\n")
    base = "\n".join(lines)
    assert merkle.edits(base, base) == []
    changes = {
        "deleted": lines[:50] + lines[51:], "inserted": lines[:50] + ["quite new"] + lines[50:], "repeated": lines[:50] + [lines[49]] + lines[50:], "moved": lines[:10] + lines[12:90] + lines[10:12] + lines[90:],
        "changed": lines[:50] + [lines[50] + " tail"] + lines[51:], "first": ["new"] + lines, "last": lines + ["new"], "none": [],
    }
    for name, other in changes.items():
        found = merkle.edits(base, "\n".join(other))
        assert found and rebuilt(base, "\n".join(other)) == "\n".join(other), name
        if name not in ("none", "moved"):
            assert sum(b - a + d - c for a, b, c, d in found) < 400, name
    for seed in range(40):
        rng = random.Random(seed)
        a, b = ("".join(rng.choice(["w1 ", "w2 ", "é", "\n", "東 ", "x"]) for _ in range(rng.randrange(40))) for _ in range(2))
        assert rebuilt(a, b) == b


def test_edits_of_a_table(spark):
    rows = spark.createDataFrame([(1, "a b", "a b"), (2, None, "x"), (3, "one line", None), (None, "a\nb", "a\nc"), (2, None, "x")], "id long, before string, after string")
    got = sorted(((r["id"], *r[1:]) for r in merkle.locate_edits(rows).collect()), key=repr)
    assert got == sorted([(2, 0, 0, 0, 1), (2, 0, 0, 0, 1), (3, 0, 8, 0, 0), (None, 2, 3, 2, 3)], key=repr)
    assert merkle.locate_edits(rows.limit(0)).collect() == []


def test_odd_documents(spark):
    docs = cases.documents(spark)
    rows = merkle.edit_likeness(docs).collect()
    order = sorted((r for r in cases.ROWS if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    following = [r[1] or "" for r in order[1:] + order[:1]]
    want = []
    for (k, t, *_), n in zip(order, following):
        t = t or ""
        want.append((k, len(t), t[: len(t) - len(t) // 2] + n[: len(t) // 2]))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_text"]) for r in rows if r["doc_id"] is not None) == sorted(want)
    assert all(r["near_next"] == 1 for r in rows if r["doc_id"] is None) and len(rows) == len(cases.ROWS)
    assert len({r["fingerprint"] for r in rows if r["n_chars"] == len(cases.prose(120, 1))}) == 1
    assert merkle.edit_likeness(docs.limit(0)).collect() == [] and merkle.fingerprints(docs.limit(0)).collect() == []
    assert merkle.fingerprints(docs).count() == len(cases.ROWS)


@pytest.mark.parametrize("n", [1, 2])
def test_few_documents(spark, n):
    rows = merkle.edit_likeness(spark.createDataFrame([(i, f"text {i} of few") for i in range(n)], "doc_id long, text string")).collect()
    assert len(rows) == n and all((r["near_next"] == 1) == (n == 1) for r in rows)
