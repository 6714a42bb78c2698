import random
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__
from siftwork.llm import common, decontaminate, merkle, near_dedup, substring_dedup
from tests.llm import cases

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text: str | None, n: int) -> set:
    w = spaced((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(texts: dict[int, str | None], n: int, percent: int) -> dict[int, int]:
    sets = {k: shingles(t, n) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in texts}


@pytest.mark.parametrize("name", ["op1_near_dedup", "op2_substring_dedup", "op7_decontaminate"])
def test_queries_give_what_their_sql_gives(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(found.columns)
    want = db.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())


def edited(rng: random.Random, words: list[str], share: float) -> str:
    return " ".join(f"new{rng.randrange(10**9)}" if rng.random() < share else w for w in words)


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_copies_are_found_as_by_brute_force(spark, words, percent):
    rng, texts = random.Random(2), {}
    for k in range(60):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.randrange(20, 200))]
        for _ in range(4):
            texts[len(texts)] = edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05, 0.1]))
    rows = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words, percent).collect()
    want = components(texts, words, percent)
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert len(set(want.values())) < 200


def test_crowded_buckets_are_matched_exactly_and_propose_few_pairs(spark, monkeypatch):
    """Documents that share a long form but are no copies, and some near copies among them."""
    rng = random.Random(3)
    form = [f"form{i}" for i in range(140)]
    texts = {i: " ".join(form + [f"own{rng.randrange(10**9)}" for _ in range(28)]) for i in range(300)}
    for i in range(0, 300, 30):
        w = texts[i].split()
        w[-1] = "changed"
        texts[1000 + i] = " ".join(w)
    monkeypatch.setattr(near_dedup, "CROWD", 20)
    confirm = near_dedup._confirm
    counted = spark.sparkContext.accumulator(0)

    def counting(batches, size, percent):
        for b in batches:
            counted.add(b.num_rows)
            yield from confirm(iter([b]), size, percent)

    monkeypatch.setattr(near_dedup, "_confirm", counting)
    rows = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == components(texts, 3, 85)
    assert counted.value < 20 * len(texts)


def test_a_repeated_id_has_the_links_of_all_its_texts(spark):
    a, b = cases.prose(80, 11), cases.prose(80, 12)
    rows = [(1, a), (5, a + " tail"), (5, b), (5, b), (7, b + " end"), (9, cases.prose(80, 13)), (3, b)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (3, 1), (5, 1), (5, 1), (5, 1), (7, 1), (9, 9)]


def test_odd_documents_near(spark):
    rows = near_dedup.near_duplicates(cases.documents(spark), 3, 85).collect()
    assert len(rows) == len(cases.ROWS)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        if r["doc_id"] in (1, 2, 3):
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (0, r["doc_id"], True)
    by = {r["doc_id"]: r for r in rows}
    assert by[6]["component_id"] == 5 and by[8]["component_id"] == 7 and by[4]["component_id"] == 4
    assert near_dedup.near_duplicates(cases.documents(spark).limit(0)).collect() == []


def test_linear_hashes_would_fail_here(spark):
    """Words, and sequences of words, that differ but have equal sums under any polynomial modulo 2 ** 64."""
    a, b = cases.thue_morse(1024), cases.thue_morse(1024, "b", "a")
    docs = spark.createDataFrame([(1, f"{a} x y"), (2, f"{b} x y")], "doc_id long, text string")
    assert [r["component_id"] for r in near_dedup.near_duplicates(docs, 3, 85).orderBy("doc_id").collect()] == [1, 2]
    words = spark.createDataFrame([(1, f"{a} " * 60), (2, f"{b} " * 60), (3, " ".join(a)), (4, " ".join(b))], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.remove_repeats(words.where("doc_id < 3"), 50).orderBy("doc_id").collect()] == [0, 0]
    long = [common.windows(np.array([ord(c) for c in s], np.uint64), 1024, 1)[0] for s in (a, b)]
    assert long[0] != long[1]
    items = spark.createDataFrame([("i", a)], "item_id string, text string")
    assert decontaminate.overlaps(spark.createDataFrame([(1, b)], "doc_id long, text string"), items).first()["n_hit"] == 0
    t = merkle.trees([a, b, " ".join(a), " ".join(b)])
    assert len(set(t.root)) == 4


def test_windows_of_all_widths():
    h = np.arange(200, dtype=np.uint64) % np.uint64(7)
    for width in (1, 2, 3, 5, 8, 50, 63, 200):
        w = common.windows(h, width, 5)
        assert len(w) == 200 - width + 1
        first: dict = {}
        for i, x in enumerate(w.tolist()):
            assert first.setdefault(tuple(h[i : i + width].tolist()), x) == x
        assert len(set(first.values())) == len(first)
    assert len(common.windows(h, 201, 5)) == 0


def removed(rows: list[tuple], n: int) -> list[tuple]:
    first: dict = {}
    for doc, text in rows:
        w = spaced(text)
        for i in range(len(w) - n + 1):
            if doc is not None:
                first[tuple(w[i : i + n])] = min(doc, first.get(tuple(w[i : i + n]), doc))
    out = []
    for doc, text in rows:
        w = spaced(text)
        gone = set()
        for i in range(len(w) - n + 1):
            if doc is not None and first[tuple(w[i : i + n])] < doc:
                gone |= set(range(i, i + n))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [3, 50])
def test_repeated_passages_against_brute_force(spark, window):
    rng = random.Random(6)
    shared = [[f"s{rng.randrange(10**6)}" for _ in range(rng.randrange(window - 1, window + 9))] for _ in range(6)]
    rows = [(rng.choice([i, i, 7]), " ".join(w for _ in range(4) for w in (rng.choice(shared) if rng.random() < 0.5 else [f"o{rng.randrange(500)}" for _ in range(rng.randrange(12))]))) for i in range(60)] + [(None, " ".join(shared[0])), (None, None), (99, None)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), window).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got), key=repr) == removed(rows, window)
    assert sum(r["n_removed"] for r in got) > 0


def test_covers_meet_every_shift():
    for v, residues in substring_dedup.COVERS.items():
        assert {(a - b) % v for a in residues for b in residues} == set(range(v))


def test_odd_documents_repeats(spark):
    got = substring_dedup.remove_repeats(cases.documents(spark), 50).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got), key=repr) == removed([(r[0], r[1]) for r in cases.ROWS], 50)
    assert substring_dedup.remove_repeats(cases.documents(spark).limit(0)).collect() == []


def overlap(text: str | None, items: dict[str, list[str | None]]) -> tuple[int, int, list[str]]:
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, met = words(text), set(), set()
    for name, texts in items.items():
        for t in texts:
            v = words(t)
            n = min(len(v), 10)
            for win in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else ():
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) == win:
                        met.add(name)
                        hit |= set(range(i, i + n))
    return len(w), len(hit), sorted(met)


@pytest.mark.parametrize("few", [10**6, 0])
def test_overlaps_against_brute_force_both_ways(spark, few):
    rng = random.Random(8)
    items = {f"i{k}": [" ".join(f"q{rng.randrange(40)}" for _ in range(n))] for k, n in enumerate([0, 1, 2, 5, 9, 10, 11, 30, 30])}
    items["i3"].append("another text of i3, WITH Capitals")
    texts = [(i, " ".join(rng.choice([f"q{rng.randrange(40)}", rng.choice(items[f"i{rng.randrange(1, 9)}"])]) for _ in range(rng.randrange(30)))) for i in range(50)] + [(None, "q1 q2"), (7, None), (8, "with-capitals"), (9, "another TEXT of i3 with capitals!")]
    bench = spark.createDataFrame([(k, t) for k, ts in items.items() for t in ts] + [(None, "q1"), ("null", None)], "item_id string, text string")
    got = decontaminate.overlaps(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), bench, few).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=repr) == sorted(((d, *overlap(t, items)) for d, t in texts), key=repr)
    assert any(r["n_hit"] for r in got)


def test_odd_documents_overlaps(spark):
    bench = spark.createDataFrame([("a", "one two"), ("b", cases.prose(40, 1)), ("c", " ")], "item_id string, text string")
    items = {"a": ["one two"], "b": [cases.prose(40, 1)], "c": [" "]}
    for few in (10**6, 0):
        got = decontaminate.overlaps(cases.documents(spark), bench, few).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=repr) == sorted(((r[0], *overlap(r[1], items)) for r in cases.ROWS), key=repr)
        assert decontaminate.overlaps(cases.documents(spark).limit(0), bench, few).collect() == []
        clean = decontaminate.uncontaminated(cases.documents(spark), bench, few)
        assert clean.columns == cases.documents(spark).columns
        assert sorted(repr((r["doc_id"], r["text"])) for r in clean.collect()) == sorted(repr(r[:2]) for r in cases.ROWS if not overlap(r[1], items)[1])
    assert all(r["n_hit"] == 0 for r in decontaminate.overlaps(cases.documents(spark), bench.limit(0)).collect())

