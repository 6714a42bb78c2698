import random
import re

import pytest
from pyspark.sql import functions as F

from siftwork.functions import cleaning as C
from siftwork.functions import patterns as P
from siftwork.operators import excerpts as E
from siftwork.operators import presence, proximity

CLEANED = [
    ("<style a>x</style>y<script>z</script>w", "yw"), ("a < b and c > d", "a d"), ("a&nbsp;b&#38;c&;d", "a b c d"), ("> quoted\nrest", ""), ("-----", ""), ("  ____=  ", ""),
    ("x -----\ny", "x ----- y"), ("PDF32 float32 7NEXT np.int64", "PDF 32 float32 7 NEXT np.int64"), ("a,b, c,,d", "a, b, c, ,d"), ("a\u2028b", "a\u2028b"), ("\u00a0a\u00a0", "a"), ("a >> b", "a b"), ("<unclosed", "<unclosed"), ("\x00a\x7fb\x85c", "a b c"), ("", ""),
]


def test_cleaning(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CLEANED)], "i int, raw string").select("i", C.clean(F.col("raw")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in rows] == [b for _, b in CLEANED] == [C.python_chain(a, C.CLEAN) for a, _ in CLEANED]


def test_cleaning_is_the_same_in_spark_and_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b", "A", "1", ">", "<", ",", "&", ";", "\n", "\r", "\x0b", "-----", "é", "ſ", "\u2028", "\u00a0", " ", "<style>", "</style>"]) for _ in range(rng.randrange(24))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, raw string").select("i", C.clean(F.col("raw")).alias("c"), C.chain(F.col("raw"), C.PREPARE).alias("p"), C.strip_html(F.col("raw")).alias("s")).orderBy("i").collect()
    for r, t in zip(rows, texts, strict=True):
        assert (r["c"], r["p"], r["s"]) == (C.python_chain(t, C.CLEAN), C.python_chain(t, C.PREPARE), C.strip_html_python(t))


FORMS = [
    ("a token here", "token", False, True), ("Tokens!", "token", False, True), ("tokenes", "token", False, True), ("tokened", "token", False, False), ("tokened", "token", True, True), ("tokening", "token", True, True), ("optional", "option", True, True), ("presentation", "present", True, True),
    ("token_x", "token", False, False), ("token1", "token", False, False), ("naïve na", "na", False, True), ("naïve", "na", False, True), ("un été là", "été", False, False), ("use c++ now", "c++", False, False), ("use c++s now", "c++", False, True), ("K", "k", False, True), ("x", " ", False, False),
]


@pytest.mark.parametrize("smart", [False, True])
def test_word_forms(spark, smart):
    for text, term, s, hit in FORMS:
        if s == smart:
            row = spark.range(1).select(F.lit(text).rlike(P.any_case_word(term, smart)).alias("a"), F.lower(F.lit(text)).rlike(P.lower_word(term, smart)).alias("b")).first()
            assert row["a"] is hit, (text, term)
            assert row["b"] is hit or text == "K"


def test_tests_of_words(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(presence.first_word_candidate(F.lit("use c++ now"), ["c++"])) and not one(presence.first_word_candidate(F.lit("tokenx"), ["token"]))
    assert one(presence.present(F.lit("a b"), ["b", " ", "a"])) and one(presence.present(F.lit(""), []))
    assert one(presence.present(F.lit("a"), ["b"], F.lit(100), 10)) is None and one(presence.present(F.lit("a"), ["b"], F.lit(10), 10)) is False and one(presence.present(F.lit("b"), ["b"], F.lit(100), 10)) is True
    assert [one(presence.read_cap(F.lit(n))) for n in (10 << 20, (10 << 20) + 1, 50 << 20, (50 << 20) + 1)] == [10 << 20, 5 << 20, 5 << 20, 10 << 20]
    assert presence.longest_two(["a", "ccc", "bb"]) == ["ccc", "bb"] and presence.longest_two(["a", "b"]) == ["a", "b"]
    assert one(presence.excluded(F.lit("A THING"), ["Things", "thing"])) and not one(presence.excluded(F.lit("nothing"), ["thing"]))
    assert one(C.format_size(F.lit(1280))) == "1.2 KB" and one(C.format_size(F.lit(1023))) == "1023 B" and one(C.format_size(F.lit(1 << 20))) == "1.0 MB" and one(C.format_count(F.lit(1234567))) == "1,234,567"
    assert one(C.is_junk(F.lit("a!!!"))) and not one(C.is_junk(F.lit("a word, yes"))) and one(C.is_obvious_junk(F.lit("12 34"))) and one(C.is_junk(F.lit("Subject: x")))
    assert one(C.salvage_ascii(F.lit(b"\x00ab\xff\tc"))) == "ab c"


def near(text: str, terms: list[str], distance: int) -> bool:
    """The rule as it is said: some stretch of starts has every term and is no longer than the distance."""
    if not terms:
        return True
    low = text.lower()
    own = [[len(low[: m.start()].encode()) for m in re.finditer(P.lower_word(t), low)] for t in terms]
    if len(terms) == 1:
        return bool(own[0])
    starts = sorted({p for x in own for p in x})
    return any(all(any(a <= p <= b for p in x) for x in own) for a in starts for b in starts if a <= b <= a + distance)


def test_proximity_against_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "b a", "a é b", "a" + "x" * 0 + " b"] + ["".join(rng.choice(["a ", "b ", "c ", "as ", "é", " ", "x", "B,", "ab "]) for _ in range(rng.randrange(30))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for terms, distance in ((["a", "b"], 3), (["a", "b"], 4), (["a", "b", "c"], 9), (["a", "a"], 0), (["a b", "b"], 5), (["é", "a"], 6), (["c"], 0), ([], 0)):
        got = {r["id"] for r in proximity.within(docs, "id", "t", terms, distance).collect()}
        assert got == {i for i, t in enumerate(texts) if (not terms) or (t is not None and near(t, terms, distance))}


def test_proximity_of_terms_that_overlap_themselves(spark):
    rng = random.Random(7)
    texts = ["a a", "a a b", "a a a", "é é é", "b a a a"] + ["".join(rng.choice(["a ", "a a ", "b ", "as ", "é ", "é", "ÉÉ ", "€a ", ",", "x", "İ "]) for _ in range(rng.randrange(20))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for terms, distance in ((["a a", "a"], 2), (["a a", "a a"], 3), (["a a", "b"], 4), (["é é", "a"], 6), (["é,", "é"], 5), (["a a", "é", "b"], 12)):
        got = {r["id"] for r in proximity.within(docs, "id", "t", terms, distance).collect()}
        assert got == {i for i, t in enumerate(texts) if near(t, terms, distance)}, terms
        low, each = {}, proximity.spans(proximity.occurrences(docs, "id", "t", terms), "id", len(terms)).collect()
        for r in each:
            low[r["id"]] = min(low.get(r["id"], (1 << 30,)), (r["right"] - r["left"], r["left"], r["right"]))
        assert {r["id"]: (r["span"], r["left"], r["right"]) for r in proximity.min_span(docs, "id", "t", terms).collect()} == low


def test_what_cannot_match_is_dropped_before_it_is_cleaned(spark):
    rng = random.Random(13)
    parts = ["th", "TH", "er", "für", "FÜR", "of", "the", "a", "1", "_", " ", " ", "\n", ">", "<", "<b>", "&amp;", "&th;", ",", "\x00", "-----", "ed", "\u0130", "\u212a", "<style>x</style>", "<script>th</script>", "<STYLE>", "é", "Σ", "+"]
    texts = [None, "TH1 er", "t<style></style>h er", "th"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, raw string")
    for terms, smart in ((["th", "er"], True), (["th", "er"], False), (["of the", "the"], False), (["für", "th"], False), (["k", "th"], True), (["th1", "a"], False), (["aσ", "a"], False), (["th"], False), (["a+", "er"], False)):
        rows = docs.select("id", C.clean(F.col("raw")).alias("clean"), proximity.possible(F.col("raw"), terms, smart).alias("maybe"))
        hits = proximity.within(rows, "id", "clean", terms, 1000, smart)
        assert hits.count() > 0 or terms == ["aσ", "a"]
        assert hits.where("not coalesce(maybe, false)").count() == 0, terms
    assert [r[0] for r in docs.where("id < 4").orderBy("id").select(proximity.possible(F.col("raw"), ["th", "er"])).collect()] == [None, True, True, False]


def test_what_is_too_far_apart_is_dropped_before_it_is_cleaned(spark):
    rng = random.Random(17)
    parts = ["th", "TH", "er", "from", "für", "FÜR", "of", "the", "a", "1", "_", " ", " ", "\n", " \n  ", "\t" * 30, ">", " >> ", "> ", "<", "<b>", "&amp;", "&", ";", "&th;", ",", ",x", "\x00", "\x85", "\u00a0", "-----", "ed", "\u0130", "\u212a", "&\u212a#er;", "<style>x</style>", "Σ", "é", "😀", "PDF32", "+", "x" * 40]
    texts = [None, "th" + " " * 400 + "er", "th " + "é" * 4 + " er", "th " + "x" * 400 + " er", "th " + "x" * 400 + " er < a", "th " + "é " * 200 + "er", "th " + "x" * 400 + " er th"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, raw string")
    for terms, smart, distance in ((["th", "er"], False, 4), (["th", "er"], True, 9), (["th", "er", "from"], False, 30), (["of the", "the"], False, 12), (["für", "th"], False, 8), (["a+", "er"], False, 20), (["aσ", "er"], False, 20), (["th", "th"], False, 0), (["k", "er"], False, 300), (["1", "th"], False, 3)):
        rows = docs.select("id", C.clean(F.col("raw")).alias("clean"), proximity.possible(F.col("raw"), terms, smart, distance).alias("maybe"))
        hits = proximity.within(rows, "id", "clean", terms, distance, smart)
        assert hits.count() > 0 or terms == ["aσ", "er"]
        assert hits.where("not coalesce(maybe, false)").count() == 0, terms
    first = lambda *distance: [r[0] for r in docs.where("id < 7").orderBy("id").select(proximity.possible(F.col("raw"), ["th", "er"], False, *distance)).collect()]
    assert first(300) == [None, True, True, False, True, False, True]
    assert first(301) == first(-1)[:1] + first()[1:] == [None, True, True, True, True, True, True]


def test_places_go_on_from_page_to_page(spark):
    pages = spark.createDataFrame([(1, 1, "alpha é"), (1, 2, None), (1, 3, "beta"), (2, 1, "alpha"), (2, 2, "gamma")], "k int, p int, t string")
    assert [(r["k"], r["span"]) for r in proximity.page_within(pages, "k", "p", "t", ["alpha", "beta"], 10).collect()] == [(1, 10)]
    assert proximity.page_within(pages, "k", "p", "t", ["alpha", "beta"], 9).count() == 0


def test_presence_on_pages(spark):
    pages = spark.createDataFrame([(1, 1, "alpha"), (1, 2, "beta"), (2, 1, "alpha"), (2, 2, None), (3, 1, "alpha"), (3, 2, "x" * 50 + " beta"), (4, 1, "x"), (4, 2, "x"), (4, 3, "alpha beta")], "k int, p int, t string")
    found = {r["k"]: r["found"] for r in proximity.page_presence(pages, "k", "p", "t", ["alpha", "beta"], 2, 40).collect()}
    assert found == {1: True, 2: False, 3: None, 4: None}


def test_excerpts():
    far = "x " * 300
    assert E.excerpts("one alpha two beta three", ["alpha", "beta"]) == ["one alpha two beta three"]
    assert E.excerpts(f"alpha {far}beta", ["alpha", "beta"], budget=400)[0].count(" ... ") == 1
    long = "lead " + "w " * 500 + "alpha beta " + "z " * 500
    (one,) = E.excerpts(long, ["alpha", "beta"])
    assert "alpha beta" in one and 380 <= len(one) <= 400
    assert E.excerpts("First one. Here is alpha now! Last.", ["alpha"]) == ["Here is alpha now!"]
    assert E.excerpts("", ["a"]) == [] and E.excerpts("text", [" "]) == [] and E.excerpts("nothing", ["alpha"]) == []
    assert E.excerpts("alpha a. alpha b. alpha c.", ["alpha"], most=2) == ["alpha a.", "alpha b."]
    assert E.excerpt_of("Dr. Who came. Then alpha left. It rained.", ["alpha"]) == ["Dr. Who came. Then alpha left. It rained."]
    assert E.excerpts("é" * 300 + " alpha " + "é" * 300, ["alpha"], budget=60)[0]
    assert E.with_missing_terms("has alpha", "has alpha and, later, beta too", ["alpha", "beta"]).endswith("beta too")


def test_narrowest_span_against_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        own = [[(p, p + 1) for p in sorted(rng.sample(range(40), rng.randrange(4)))] for _ in range(3)]
        every = [(b - a, a, b) for a in range(41) for b in range(a, 41) if all(any(a <= p <= b for p, _ in x) for x in own)]
        assert E.narrowest(own) == (min(every)[1:] if every else None)


def test_sentences():
    assert E.sentences("It is 3.14 now. Dr. No left. A U.S. law! Is it?Yes") == ["It is 3.14 now.", "Dr. No left.", "A U.", "S.", "law!", "Is it?", "Yes"]
    assert E.sentences("no end") == ["no end"] and E.sentences("  ") == []
    assert E.chunked("aa bb cc", 5) == ["aa bb", "cc"]


def test_sentences_are_the_same_in_spark_and_python(spark):
    rng = random.Random(11)
    parts = ["a", "b", "A", "É", "é", "1", "3.14", ".", ".", "!", "?", " ", " ", "\n", "\n\n", "\u00a0", "\u2028", "\x85", "Dr", "mr", "PROF", "ltd", "inc", "xno", "\u00b2st", "1st", "_Jr", "\U0001d400", "\U0001d41a", "\u2160", "\u01c5", "<b>", ",", "\u00a0" * 58, "\u00a0" * 61]
    texts = ["", "  ", "a.", ". A", "xmr" + "\u00a0" * 62 + ". A", "mr" + "\u00a0" * 62 + ". A", "mr" + "\u00a0" * 63 + ". A", "\U0001d400mr. A", "\U0001d400 mr. A"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(24))) for _ in range(4000)]
    found = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, raw string").select("i", E.sentence_column(F.col("raw")).alias("s"))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["i"]: r["s"] for r in found.collect()}
    assert got.pop(-1) == []
    for i, t in enumerate(texts):
        assert got[i] == E.sentences(t), t


def test_highlight(spark):
    row = spark.range(1).select(C.highlight(F.lit("Alpha's alphas"), ["alpha"]).alias("x")).first()
    assert row["x"] == "\x1b[1;31mAlpha\x1b[0m's \x1b[1;31malphas\x1b[0m"
