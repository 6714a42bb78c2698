"""Language identification by a string kernel.

The kernel of two texts is the number of byte n-grams (1 to 3, hashed into fixed bins) that both
have, over the root of the product of their numbers: a normalised blended-spectrum presence kernel.
Landmark texts give a Nyström map, and kernel ridge regression fits one output per language, one
against the rest. The kernel is linear in the normalised presence vector, so the landmarks, the
map and the weights fold into one matrix, and a batch is scored by one matrix product.

The fit uses a bounded sample: at most SAMPLE documents of each language and ROWS in all, picked by a
hash of the text. With more than ROWS languages those with the most documents are learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork.llm.common import LOWER, chunks, crc32_mod, small_batches

#: Labelled documents of each language in the fit, and how many of them are landmarks.
SAMPLE, LANDMARKS = 500, 64
#: Documents in the fit, and landmarks, of all languages together.
ROWS, MARKS = 16_000, 1024
RIDGE, SHARPNESS = 1e-4, 8.0
BINS = (256, 4096, 8192)
DIM = sum(BINS)
_ROWS = 256
_LETTER = regex.compile(r"\p{L}")


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of DIM flags a text: which hashed n-grams it has."""
    n = len(offsets) - 1
    out = np.zeros(n * DIM, np.uint8)
    if not len(data):
        return out.reshape(n, DIM)
    b = LOWER[data].astype(np.uint32)
    base = np.repeat(np.arange(n, dtype=np.int64) * DIM, np.diff(offsets))
    out[base + b] = 1
    code, at = b, BINS[0]
    for k, bins in zip((2, 3), BINS[1:]):
        code = code[:-1] * np.uint32(257) + b[k - 1 :]
        ok = base[: len(code)] == base[k - 1 :]
        place = (code * np.uint32(2654435769)) >> np.uint32(32 - int(bins).bit_length() + 1)
        out[(base[: len(code)] + at + place)[ok]] = 1
        at += bins
    return out.reshape(n, DIM)


def _small(batches: Iterator[pa.RecordBatch]):
    for part, data, offsets in chunks(batches):
        for at in range(0, part.num_rows, _ROWS):
            to = min(at + _ROWS, part.num_rows)
            yield part.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]


def _normed(bits: np.ndarray) -> np.ndarray:
    """Presence rows from packed ones, divided by the roots of their sums."""
    x = np.unpackbits(bits, axis=1)[:, :DIM].astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def fit(bits: np.ndarray, lang: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, weights by bin and language, offsets) from packed presence rows and their languages."""
    names = sorted(set(lang))
    rank = {name: k for k, name in enumerate(names)}
    y = np.array([rank[v] for v in lang])
    each = max(1, min(landmarks, MARKS // len(names)))
    mark = np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(names))])
    marks = _normed(bits[mark[:: -(-len(mark) // MARKS)]])
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = np.concatenate([(_normed(bits[i : i + _ROWS]) @ marks.T).astype(np.float64) @ root for i in range(0, len(bits), _ROWS)])
    weight = 1.0 / np.bincount(y)[y]  # languages count alike
    mean, offset = weight @ phi / weight.sum(), np.bincount(y, 2 * weight, len(names)) / weight.sum() - 1
    a = (phi - mean) * weight[:, None]
    right = np.stack([2 * a[y == k].sum(0) - a.sum(0) - offset[k] * a.sum(0) for k in range(len(names))], axis=1)
    w = np.linalg.solve(a.T @ (phi - mean) + ridge * weight.sum() * np.eye(phi.shape[1]), right)
    return names, (marks.T.astype(np.float64) @ (root @ w)).astype(np.float32), (offset - mean @ w).astype(np.float32)


def sample(docs: DataFrame, per_language: int) -> tuple[np.ndarray, list[str]]:
    """Packed presence rows and languages of at most per_language rows of each lang, as a hash picks them.

    Rows are counted by language first, so the hash lets through about twice as many as are kept.
    """
    known = docs.where("text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(ROWS).collect()}
    if not counts:
        return np.empty((0, -(-DIM // 8)), np.uint8), []
    each = max(1, min(per_language, ROWS // len(counts)))
    share = docs.sparkSession.createDataFrame([(k, min(1.0, 2 * each / n + 20 / n)) for k, n in counts.items()], "lang string, share double")
    some = known.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    some = some.dropDuplicates(["lang", "text"]).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).where(F.col("rank") <= each).select("lang", "rank", "text")

    def packed(batches):
        for part, data, offsets in _small(batches):
            rows = np.packbits(presence(data, offsets), axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], ["lang", "rank", "bits"])

    rows = sorted(some.mapInArrow(packed, "lang string, rank int, bits binary").collect())  # at most ROWS rows of DIM / 8 bytes
    return np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1), [r["lang"] for r in rows]


def identify(docs: DataFrame, learn_from: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score (0 to 1), from its text alone.

    learn_from has doc_id, text and lang; rows with a null text or lang teach nothing. lang_pred is a
    learned value of lang, or `und` (score 0) where text is null or has no letter, or nothing could be
    learned. Ties go to the language that sorts first. Equal texts get equal results; an empty table gives
    an empty result. Other columns play no part.
    """
    bits, lang = sample(learn_from.select(*(F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("lang", "string")))), per_language)
    names, weights, offset = fit(bits, lang) if lang else ([], np.zeros((DIM, 1), np.float32), np.zeros(1, np.float32))

    def run(batches):
        for part, data, offsets in _small(batches):
            text = part.column(1).to_pylist()
            m = presence(data, offsets).astype(np.float32)
            s = (m @ weights) / np.sqrt(np.maximum(m.sum(1, keepdims=True), 1)) + offset
            best = s.argmax(1)
            e = np.exp(SHARPNESS * (s - s.max(1, keepdims=True)).astype(np.float64))
            p = 1 / e.sum(1)
            ok = [bool(names) and t is not None and _LETTER.search(t) is not None for t in text]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([names[k] if o else "und" for k, o in zip(best, ok)], pa.string()), pa.array(np.where(ok, p, 0.0))], ["doc_id", "lang_pred", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op3_langid(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from two thirds of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(crc32_mod(F.col("doc_id"), 3) == 1, F.lit(True))
    return identify(docs, docs.where(~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
