"""op3, op8 and op9: what is exact against brute force, what is learned by accuracy on documents held out."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from siftwork.llm import langid, quality, suffix_lm
from siftwork.llm.common import LOWER, SPACED, words
from tests.llm import cases
from tests.llm.test_dedup import LOWER as CAPITALS
from tests.llm.test_dedup import spaced

SF = "/root/testdata/sf0.01"


def remainder(doc_id: int, mod: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % mod


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op3_on_documents_held_out(spark, documents):
    rows = __spark_entry__.queries()["op3_langid"](spark, SF).collect()
    assert len(rows) == len(documents)
    right = []
    for r in rows:
        assert r["held_out"] == (remainder(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1
        d = documents[r["doc_id"]]
        if d["text"] is None or not any(c.isalpha() for c in d["text"]):
            assert r["lang_pred"] == "und"
        elif r["held_out"] and d["lang"] is not None:
            right.append(r["lang_pred"] == d["lang"])
    assert len(right) > 200 and sum(right) / len(right) > 0.98


def test_op3_takes_its_prediction_from_the_text_alone(spark):
    docs = cases.documents(spark)
    rows = langid.identify(docs, docs.where("doc_id is not null")).collect()
    assert len(rows) == len(cases.ROWS)
    by: dict = {}
    for r in rows:
        if r["doc_id"] in (7, 8, None):
            by.setdefault(r["doc_id"], set()).add((r["lang_pred"], r["score"]))
    assert by[7] <= by[8] and by[7] <= by[None]
    one = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert one[1] == one[2] == one[3] == one[13] == "und" and one[9] != "und"
    assert langid.identify(docs.limit(0), docs).collect() == []
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in langid.identify(docs, docs.limit(0)).collect())


def test_op3_has_no_limit_of_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "ROWS", 40)
    monkeypatch.setattr(langid, "MARKS", 16)
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 30 + f"z{i}", f"l{i % 60}") for i in range(300)] + [(1000 + i, f"common words {i}", "l0") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, docs).collect()
    assert len(got) == 350 and len({r["lang_pred"] for r in got}) > 1 and all(0 <= r["score"] <= 1 for r in got)


def counts_and_base(texts: dict[int, str | None], learn: set[int]) -> tuple[dict, int]:
    tokens = {k: [*spaced((t or "").translate(CAPITALS)), None] for k, t in texts.items()}
    c = Counter(w for k in learn for w in tokens[k])
    n, v = sum(c.values()), len(c)
    return {k: (len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for k, w in tokens.items()}, n


def test_op8_against_brute_force(spark, documents):
    rows = __spark_entry__.queries()["op8_suffix_lm"](spark, SF).collect()
    want, n = counts_and_base({k: d["text"] for k, d in documents.items()}, {k for k in documents if remainder(k, 5) != 1})
    assert len(rows) == len(documents)
    gain = 0.0
    for r in rows:
        assert r["held_out"] == (remainder(r["doc_id"], 5) == 1) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == want[r["doc_id"]][:2] and r["base_score"] == pytest.approx(want[r["doc_id"]][2], abs=1e-6)
        assert r["score"] < 0
    seen = [r["score"] / r["n_tokens"] for r in rows if not r["held_out"]]
    new = [r["score"] / r["n_tokens"] for r in rows if r["held_out"]]
    gain = np.mean(seen) - np.mean(new)
    assert gain > 0.1 and np.mean(new) > -4.5


def tree_by_hand(texts: list[bytes], learn: list[bool]) -> list[float]:
    """The model as it is described, context by context."""
    d = suffix_lm.DEPTH
    symbols = []
    for t in texts:
        data, (start, end, _) = LOWER[np.frombuffer(t, np.uint8)], words(LOWER[np.frombuffer(t, np.uint8)], np.array([0, len(t)]), SPACED)
        symbols.append([10] * d + [x for a, b in zip(start, end) for x in [*data[a:b].tolist(), 32]] + [10])
    seen = [Counter() for _ in range(d + 1)]
    for s, ok in zip(symbols, learn):
        for i in range(d, len(s) if ok else 0):
            for k in range(d + 1):
                seen[k][(tuple(s[i - k : i]), s[i])] += 1
    after: list[dict] = [{} for _ in range(d + 1)]
    for k in range(d + 1):
        for (c, x), n in seen[k].items():
            after[k].setdefault(c, {})[x] = n
    memo: dict = {}

    def p(context: tuple, x: int) -> float:
        if (context, x) in memo:
            return memo[context, x]
        k = len(context)
        q = p(context[1:], x) if k else 1 / suffix_lm.SYMBOLS
        own = after[k].get(context, {})
        total = sum(own.values())
        gain = 2 * sum(n * math.log(n / total / (p(context[1:], y) if k else 1 / suffix_lm.SYMBOLS)) for y, n in own.items())
        out = (own.get(x, 0) + len(own) * q) / (total + len(own)) if total >= suffix_lm.LEAST and gain >= suffix_lm.GAIN + 2 * (len(own) - 1) else q
        memo[context, x] = out
        return out

    return [sum(math.log10(p(tuple(s[i - d : i]), s[i])) for i in range(d, len(s))) for s in symbols]


def test_tree_scores_against_one_built_by_hand(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "then", "other", "é", "Abba", "x"]) for _ in range(rng.randrange(30))) for _ in range(40)] + ["", "unseen zz"]
    monkeypatch.setattr(suffix_lm, "_GROUP", 50)
    docs = spark.createDataFrame([(i, t, i % 5 > 0) for i, t in enumerate(texts)], "doc_id long, text string, l boolean").repartition(3)
    rows = suffix_lm.suffix_tree_scores(docs, F.col("l")).orderBy("doc_id").collect()
    want = tree_by_hand([t.encode() for t in texts], [i % 5 > 0 for i in range(len(texts))])
    assert [r["score"] for r in rows] == pytest.approx(want, rel=1e-5)


def test_predictions_add_up_to_one():
    rng = np.random.default_rng(1)
    n = rng.integers(0, 5, 257 * 4)
    context, symbol = np.repeat(np.arange(4), 257), np.tile(np.arange(257), 4)
    p = suffix_lm._sharper(context, symbol, n, np.full(len(n), 1 / 257))
    assert np.bincount(context, p) == pytest.approx(np.ones(4))


def test_odd_documents_scored(spark):
    docs = cases.documents(spark)
    rows = suffix_lm.suffix_tree_scores(docs, F.when(F.col("doc_id") % 2 == 0, True)).collect()
    assert len(rows) == len(cases.ROWS) and all(r["score"] < 0 and math.isfinite(r["base_score"]) for r in rows)
    assert len({(r["score"], r["base_score"]) for r in rows if r["n_tokens"] == 121}) == 1
    assert suffix_lm.suffix_tree_scores(docs.limit(0), F.lit(True)).collect() == []
    rows = suffix_lm.suffix_tree_scores(docs, F.lit(None)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in rows)
    assert next(r for r in rows if r["doc_id"] == 4)["score"] == pytest.approx(-5 * math.log10(257), rel=1e-5)


def area(scored: list[tuple[float, int]]) -> float:
    good, bad = [s for s, y in scored if y == 1], [s for s, y in scored if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_op9_on_documents_held_out(spark, documents):
    rows = __spark_entry__.queries()["op9_quality"](spark, SF).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] is not None}
    assert len(rows) == len(documents)
    by_text: dict = {}
    for r in rows:
        assert r["held_out"] == (remainder(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        by_text.setdefault(documents[r["doc_id"]]["text"] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values()) and len(by_text) < len(rows)
    assert area([(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]) > 0.95


def test_op9_is_a_function_of_the_text(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(300), spark.read.parquet(f"{SF}/labels.parquet")
    learn = spark.read.parquet(f"{SF}/documents.parquet")
    one, seven = ({r["doc_id"]: r["score"] for r in quality.scores(docs.repartition(n), learn, labels).collect()} for n in (1, 7))
    assert one == seven


def test_gradient_of_the_transitions_against_finite_differences():
    rng = np.random.default_rng(3)
    bounds = np.array([0, 1, 5, 12, 14])
    each = np.diff(bounds)
    score, y, step = rng.normal(size=14), np.array([1, 0, 1, 0]), rng.normal(size=(2, 2)) * 0.3
    share = np.array([0.3, 0.7, 1.1, 0.2]) / each
    chains = quality._chains(bounds)

    def likelihood(step: np.ndarray) -> float:
        _, _, z = quality.marginals(score, step, chains)
        z = z[np.argsort(np.argsort(-each, kind="stable"), kind="stable")]
        own = np.array([score[a:b].sum() * t + (b - a - 1) * step[t, t] for a, b, t in zip(bounds, bounds[1:], y)])
        return float(np.sum(share * (own - z)))

    _, expected, _ = quality.marginals(score, step, chains, np.repeat(share, each))
    moves = np.zeros((2, 2))
    for n, t, w in zip(each, y, share):
        moves[t, t] += w * (n - 1)
    for i in range(2):
        for j in range(2):
            d = np.zeros((2, 2))
            d[i, j] = 1e-5
            assert (likelihood(step + d) - likelihood(step - d)) / 2e-5 == pytest.approx((moves - expected)[i, j], abs=1e-6)


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(5)
    score, step = rng.normal(size=5), rng.normal(size=(2, 2))
    p, _, z = quality.marginals(score, step, quality._chains(np.array([0, 5])))
    weights = {}
    for code in range(32):
        y = [code >> i & 1 for i in range(5)]
        weights[tuple(y)] = math.exp(sum(s for s, t in zip(score, y) if t) + sum(step[a, b] for a, b in zip(y, y[1:])))
    total = sum(weights.values())
    assert z[0] == pytest.approx(math.log(total))
    assert p == pytest.approx([sum(w for y, w in weights.items() if y[i]) / total for i in range(5)])


def test_odd_documents_and_labels(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(7, 1, None), (9, 0, None), (10, 0, None), (11, 0, 1), (8, None, None), (None, 1, None), (7, 1, None), (12, 5, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.scores(docs, docs, labels).collect()
    assert len(rows) == len(cases.ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert quality.scores(docs.limit(0), docs, labels).collect() == []
    assert {r["score"] for r in quality.scores(docs, docs, labels.where("quality = 0")).collect()} == {0.0}
    assert {r["score"] for r in quality.scores(docs, docs, labels.where("quality = 1")).collect()} == {1.0}
    assert {r["score"] for r in quality.scores(docs, docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.good(docs, docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(cases.ROWS)
