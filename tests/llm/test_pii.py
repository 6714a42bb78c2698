import hashlib
import random
import re

import __spark_entry__
from siftwork.llm import pii
from tests.llm import cases

SF = "/root/testdata/sf0.001"
#: The contract's patterns as it states them.
STATED = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base(text: str | None) -> list[tuple[int, int, int]]:
    out = []
    for kind, pattern in enumerate(STATED):
        if kind == 0 and "@" not in (text or ""):
            continue  # the pattern as stated takes the square of a long run's length to find nothing
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".") if kind == 1), 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15)[kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_op6_base_against_brute_force(spark):
    rows = {r["doc_id"]: r for r in __spark_entry__.queries()["op6_pii"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r, want = rows[d["doc_id"]], base(d["text"])
        assert r["base_sha256"] == hashlib.sha256(spelled(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in want) for i in range(4)]
        assert set(spelled(want).split(",")) <= set(r["spans"].split(","))


def test_base_on_random_texts(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["1", "23", "4", ".", "-", " ", "@", "a", "+1", "(", ")", "x.y", "é", "255", "\U0001f600"]) for _ in range(rng.randrange(40))) for _ in range(600)]
    rows = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == base(texts[r["doc_id"]])


def test_the_bootstrap_finds_what_no_fixed_pattern_matches(spark):
    rng = random.Random(2)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = []
    for i in range(30):  # seeds: phones after a cue, cards
        rows.append(f"zz call +1 ({number(3)}) 555-{number(4)} today or hotline +49 {number(3)} {number(7)} now")
        while not luhn(card := number(16)):
            pass
        rows.append(f"paid with {card} at once")
    hidden = {"phone": [], "card": []}
    for i in range(10):
        x = f"({number(3)}) 555-{number(4)}"
        hidden["phone"].append(x)
        rows.append(f"his number {x} is new")  # a known shape
        x = f"0{number(3)} {number(7)}"
        hidden["phone"].append(x)
        rows.append(f"our hotline {x} helps")  # a known cue and outline
        while luhn(x := number(16)):
            pass
        hidden["card"].append(x)
        rows.append(f"card {x} failed")
    plain = ["in 2019 12 of 30 people came", "version 10.2.3 and 1.2", f"token {number(8)}abcdef{number(8)}", "order 12345 of 2020-01-02", "see page 1234567"]
    docs = spark.createDataFrame(list(enumerate(rows + plain)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    found = {k: [(rows + plain)[d][s["start"] : s["end"]] for d, r in got.items() for s in r["spans"] if s["kind"] == pii.KINDS.index(k)] for k in pii.KINDS}
    for kind, every in hidden.items():
        assert set(every) <= set(found[kind]), kind
    assert all(not r["spans"] for d, r in got.items() if d >= len(rows))
    assert all([(s["start"], s["kind"], s["end"]) for s in r["base"]] == base((rows + plain)[d]) for d, r in got.items())


def test_sure_instances_teach_in_the_next_round(spark):
    rng = random.Random(5)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    seeds = [f"hotline +49 {n(3)} {n(7)} now" for _ in range(12)]
    second = [f"hotline {n(4)} {n(7)} desk" for _ in range(8)]  # known by the cue before it; brings the cue after it
    third = [f"the {n(4)} {n(7)} desk" for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(seeds + second + third)), "doc_id long, text string")
    found = pii.written(pii.matches(docs), "matches")
    for rounds, more in ((1, 8), (2, 12)):
        assert pii.discovered(found, rounds).count() == more


def test_odd_documents(spark):
    docs = cases.documents(spark)
    rows = pii.personal_data(docs).collect()
    assert len(rows) == len(cases.ROWS)
    want = sorted((r[0] if r[0] is not None else -1, spelled(base(r[1]))) for r in cases.ROWS)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, spelled([(s["start"], s["kind"], s["end"]) for s in r["base"]])) for r in rows) == want
    assert pii.personal_data(docs.limit(0)).collect() == []


def test_masks(spark):
    docs = cases.documents(spark)
    text = "a@b.cc, 1.2.3.4 and +1 (743) 555-3824; x"
    some = spark.createDataFrame([(1, text, len(text), "k", 3, "p"), (None, text, 1, None, None, None), (2, None, None, None, None, None), (3, "é nothing", 9, None, None, None), (1, text, len(text), "again", 3, "p")], "doc_id long, text string, n_chars int, pii_key string, pii_spans int, PII_doc string")
    rows = pii.masked(some).collect()
    want = "[EMAIL], [IP] and [PHONE]; x"
    assert sorted((r["text"] or "", r["n_chars"] or -1) for r in rows) == sorted([(want, len(want))] * 3 + [("", -1), ("é nothing", 9)])
    assert {r["pii_key"] for r in rows} == {"k", "again", None} and pii.masked(some).dtypes == some.dtypes
    out = pii.masked(docs)
    assert out.dtypes == docs.dtypes and out.count() == len(cases.ROWS) and pii.masked(docs.limit(0)).collect() == []
