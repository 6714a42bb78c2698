"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. What speaks for either are the binned features of the line and of the
lines before and after it, and the labels of neighbouring lines depend on each other. Forward and
backward passes give each line's probability of being good; their mean, weighted by the lines'
lengths, is turned into the document's score by a logistic curve.

The fit uses at most SAMPLE labelled documents of LINES lines together, each of at most LONGEST, picked by
a hash; their lines take the document's label. The curve is fitted on a fifth of them that the field does not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork.llm.common import SPACED, chunks, coded, crc32_mod, packed, small_batches, words

#: Labelled documents in the fit, and lines of them; documents that would go beyond either are left out, and so
#: are those of more than LONGEST lines, as the fit walks along the longest chain in every round.
SAMPLE, LINES, LONGEST = 5000, 300_000, 1000
THRESHOLD = 0.3
N_FEATURES, N_BINS = 14, 6
_UPPER, _LETTER, _DIGIT, _SYMBOL, _STOP, _WIDE = (np.zeros(256, np.float32) for _ in range(6))
_UPPER[65:91] = 1
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
_DIGIT[48:58] = 1
for _c in b"!\"#$%&'()*+/:;<=>?@[\\]^_`{|}~":
    _SYMBOL[_c] = 1
for _c in b".,":
    _STOP[_c] = 1
_WIDE[128:192] = 1


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and the bounds of each text's lines.

    A text without a byte has one empty line.
    """
    n_docs = len(offsets) - 1
    size = np.diff(offsets)
    begins = np.zeros(len(data) + 1, bool)
    begins[np.flatnonzero(data == 10) + 1] = True
    begins[offsets[:-1]] = True
    start = np.flatnonzero(begins[: len(data)]) if len(data) else np.empty(0, np.int64)
    n_lines = len(start)
    length = np.diff(np.append(start, len(data)))
    doc = np.searchsorted(offsets, start, "right") - 1
    f = np.zeros((n_lines, N_FEATURES), np.float32)
    if n_lines:
        w_start, w_end, w_bounds = words(data, np.append(start, len(data)), SPACED)
        line = np.repeat(np.arange(n_lines), np.diff(w_bounds))
        n_words = np.maximum(np.diff(w_bounds), 1)

        def per_byte(table: np.ndarray) -> np.ndarray:
            return np.add.reduceat(table[data], start)

        def per_word(x: np.ndarray) -> np.ndarray:
            return np.bincount(line, x, minlength=n_lines)

        chars = np.maximum(length - per_byte(_WIDE), 1)
        letters = per_byte(_LETTER)
        h, _ = coded(*packed(data, w_start, w_end, SPACED))
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        order = np.lexsort((h, line))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
        distinct = np.bincount(line[order][fresh], minlength=n_lines)
        w_len = w_end - w_start
        last = data[w_end - 1]
        f[:, 0] = np.log1p(np.diff(w_bounds))
        f[:, 1] = np.log1p(length)
        f[:, 2] = per_byte(_UPPER) / np.maximum(letters, 1)
        f[:, 3] = per_byte(_DIGIT) / chars
        f[:, 4] = per_byte(_SYMBOL) / chars
        f[:, 5] = per_byte(_STOP) / n_words
        f[:, 6] = per_word(again) / n_words
        f[:, 7] = distinct / n_words
        f[:, 8] = per_word(w_len) / n_words
        f[:, 9] = per_word(w_len == 1) / n_words
        f[:, 10] = per_word(_SYMBOL[last] > 0) / n_words
        f[:, 11] = letters / np.maximum(length, 1)
        f[:, 12] = per_word(w_len <= 4) / n_words
        key, _ = coded(data, np.append(start, len(data)))
        order = np.lexsort((np.arange(n_lines), key, doc))  # a line repeats an earlier one of its own text
        f[order[1:], 13] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    # texts without a byte get a line of zeros
    bounds = np.zeros(n_docs + 1, np.int64)
    count = np.bincount(doc, minlength=n_docs)
    if (size == 0).any():
        out = np.zeros((n_lines + int((size == 0).sum()), N_FEATURES), np.float32)
        lengths = np.ones(len(out), np.int64)
        count = np.where(size == 0, 1, count)
        np.cumsum(count, out=bounds[1:])
        at = bounds[:-1][doc] + np.arange(n_lines) - np.searchsorted(doc, doc)
        out[at], lengths[at] = f, length
        return out, lengths, bounds
    np.cumsum(count, out=bounds[1:])
    return f, length, bounds


@dataclass
class Field:
    """Bin edges by feature, weights by place (before, here, after), feature and bin, transitions, curve."""

    edges: np.ndarray
    weight: np.ndarray
    bias: float
    step: np.ndarray
    curve: tuple[float, float]

    def binned(self, f: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[k], f[:, k], "right") + k * N_BINS for k in range(N_FEATURES)], axis=1)


def _places(bins: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Indices into the weights for each line: its own bins, those before and after (or the edge)."""
    width = N_FEATURES * N_BINS
    before, after = np.full_like(bins, -1), np.full_like(bins, -1)
    before[1:], after[:-1] = bins[:-1], bins[1:]
    before[bounds[:-1]] = after[bounds[1:] - 1] = -1
    return np.concatenate((np.where(before < 0, 3 * width, before), bins + width, np.where(after < 0, 3 * width, after + 2 * width)), axis=1)


def _chains(bounds: np.ndarray) -> list[np.ndarray]:
    """The lines at place t of all texts that are longer than t, longest texts first."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    first, n = bounds[:-1][order], n[order]
    live = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), "left")
    return [first[:k] + t for t, k in enumerate(live)]


def marginals(score: np.ndarray, step: np.ndarray, chains: list[np.ndarray], cost: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward passes over all texts at once.

    score is each line's log weight of good against bad; step[a, b] that of label b after a. Returns
    (probability of good by line, expected transitions, each counted by its line's cost, log normaliser by
    text, longest first). Without cost no transitions are counted.
    """
    n = len(score)
    unary = np.stack((np.zeros(n), score), axis=1)
    alpha, beta, total = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros(len(chains[0]) if chains else 0)
    for t, at in enumerate(chains):
        if t == 0:
            alpha[at] = unary[at]
        else:
            alpha[at] = unary[at] + np.logaddexp(alpha[at - 1][:, :1] + step[0], alpha[at - 1][:, 1:] + step[1])
    expected = np.zeros((2, 2))
    for t in range(len(chains) - 1, 0, -1):
        at = chains[t]
        ahead = beta[at] + unary[at]
        beta[at - 1] = np.logaddexp(step[:, 0] + ahead[:, :1], step[:, 1] + ahead[:, 1:])
    z = np.logaddexp(alpha[:, 0] + beta[:, 0], alpha[:, 1] + beta[:, 1])
    for at in chains[1:] if cost is not None else ():
        pair = alpha[at - 1][:, :, None] + step[None] + (unary[at] + beta[at])[:, None, :] - z[at][:, None, None]
        expected += (np.exp(pair) * cost[at][:, None, None]).sum(0)
    if chains:
        total = z[chains[0]]
    return np.exp(alpha[:, 1] + beta[:, 1] - z), expected, total


def _documents(p: np.ndarray, length: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean probability of each text's lines, weighted by length, as a logit."""
    w = np.maximum(length, 1).astype(np.float64)
    mean = np.add.reduceat(p * w, bounds[:-1]) / np.add.reduceat(w, bounds[:-1])
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def fit(features: list[np.ndarray], lengths: list[np.ndarray], label: np.ndarray, rounds: int = 120, decay: float = 1e-3) -> Field:
    """A field from each text's lines and its label, by gradient steps on the labels' likelihood."""
    hold = np.arange(len(label)) % 5 == 4
    if not hold.any() or len(set(label[~hold])) < 2 or len(set(label[hold])) < 2:
        hold = np.zeros(len(label), bool)
    own = [f for f, h in zip(features, hold) if not h]
    stacked = np.concatenate(own)
    edges = np.zeros((N_FEATURES, N_BINS - 1), np.float32)
    for k in range(N_FEATURES):
        edges[k] = np.quantile(stacked[:, k], [0.03, 0.15, 0.5, 0.85, 0.97])
    field = Field(edges, np.zeros(3 * N_FEATURES * N_BINS + 1), 0.0, np.zeros((2, 2)), (1.0, 0.0))
    bounds = np.concatenate(([0], np.cumsum([len(f) for f in own])))
    place, chains = _places(field.binned(stacked), bounds), _chains(bounds)
    y = label[~hold].astype(np.float64)
    each = np.diff(bounds)
    truth = np.repeat(y, each)
    share = 0.5 / np.maximum(np.array([np.sum(y == 0), np.sum(y == 1)]), 1)
    cost = np.repeat(np.where(y == 1, share[1], share[0]) / each, each)  # labels, and texts of a label, count alike
    moves = np.array([[np.sum((each - 1)[y == 0] / each[y == 0]) * share[0], 0], [0, np.sum((each - 1)[y == 1] / each[y == 1]) * share[1]]])
    theta = np.zeros(len(field.weight) + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        weight, bias, step = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
        score = weight[place].sum(1) + bias
        p, expected, _ = marginals(score, step, chains, cost)
        slope = (truth - p) * cost
        g = np.zeros_like(theta)
        g[:-5] = np.bincount(place.ravel(), np.repeat(slope, place.shape[1]), minlength=len(weight))
        g[-5] = slope.sum()
        g[-4:] = (moves - expected).ravel()
        g -= decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.08 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        theta[-4:] = np.clip(theta[-4:], -2, 2)
    field.weight, field.bias, field.step = theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2)
    check = hold if hold.any() else np.ones(len(label), bool)
    x = _logits(field, np.concatenate([f for f, h in zip(features, check) if h]), np.concatenate([n for n, h in zip(lengths, check) if h]), np.concatenate(([0], np.cumsum([len(f) for f, h in zip(features, check) if h]))))
    field.curve = _curve(x, label[check])
    return field


def _logits(field: Field, f: np.ndarray, length: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    p, _, _ = marginals(field.weight[_places(field.binned(f), bounds)].sum(1) + field.bias, field.step, _chains(bounds))
    return _documents(p, length, bounds)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps; the slope is never negative."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([np.sum((y - p) * x) - 1e-2 * (a - 1), np.sum(y - p)])
        h = np.array([[np.sum(w * x * x) + 1e-2, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-9]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(h, g), -1, 1)
    return max(float(a), 1e-3), float(b)


def sampled(docs: DataFrame, labels: DataFrame, limit: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Line features, line lengths and labels of at most limit labelled documents, as a hash picks them."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.where("text is not null").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.max("text").alias("text"))
    lines = rows.select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).alias("n"))
    lines = lines.where(F.col("n") <= LONGEST)
    so_far = F.sum("n").over(W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0))  # over at most limit numbers
    rows = rows.join(F.broadcast(lines.withColumn("n", so_far).where(F.col("n") <= LINES).select("doc_id")), "doc_id")

    def features(batches):
        for part, data, offsets in chunks(batches):
            f, length, bounds = line_features(data, offsets)
            cut = [(f[a:b].tobytes(), length[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c[0] for c in cut], pa.binary()), pa.array([c[1] for c in cut], pa.binary())], ["doc_id", "quality", "f", "n"])

    found = sorted(rows.select("doc_id", "quality", "text").mapInArrow(features, "doc_id long, quality int, f binary, n binary").collect(), key=lambda r: r["doc_id"])  # at most limit rows, LINES lines
    return [np.frombuffer(r["f"], np.float32).reshape(-1, N_FEATURES) for r in found], [np.frombuffer(r["n"], np.int64) for r in found], np.array([r["quality"] for r in found])


def _scorer(learn_from: DataFrame, labels: DataFrame, limit: int):
    """A function from a batch of texts (bytes, offsets) to their scores."""
    learned = sampled(small_batches(learn_from).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, limit)
    field = fit(*learned) if len(set(learned[2].tolist())) == 2 else None
    share = float(learned[2].mean()) if len(learned[2]) else 0.5

    def score(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if field is None:
            return np.full(len(offsets) - 1, share)
        x = _logits(field, *line_features(data, offsets))
        return 1 / (1 + np.exp(-np.clip(field.curve[0] * x + field.curve[1], -30, 30)))

    return score


def scores(docs: DataFrame, learn_from: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """Per row of docs: doc_id and score, the probability from its text alone that its quality is 1.

    learn_from has the documents that may teach, labels their quality (0 or 1; other values and nulls
    teach nothing; of several labels, or texts of an id, the larger counts). Null and empty texts are one
    empty line. With labels of one kind only every score is that kind, without labels 0.5. Equal texts get
    equal scores, wherever they stand; an empty table gives an empty result. Other columns play no part.
    """
    score = _scorer(learn_from, labels, limit)

    def run(batches: Iterator[pa.RecordBatch]):
        for part, data, offsets in chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score(data, offsets))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def good(docs: DataFrame, learn_from: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, that scores() would give THRESHOLD or more.

    Nulls, repeated rows and empty tables are as in scores().
    """
    score = _scorer(learn_from, labels, limit)

    def run(batches: Iterator[pa.RecordBatch]):
        for part, data, offsets in chunks(batches):
            yield part.filter(pa.array(score(data, offsets) >= THRESHOLD))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from labels of four fifths of them."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.coalesce(crc32_mod(F.col("doc_id"), 5) == 0, F.lit(True))
    return scores(docs, docs, labels.where(~held)).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
