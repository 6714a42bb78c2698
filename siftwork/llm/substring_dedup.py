"""Substring deduplication by difference-cover anchors.

A difference cover D modulo v has, for every pair of positions, a shift below v that puts both into
D. So two equal runs of `window` words share an anchor of window - v + 1 words that starts at a
cover position in both texts. Only anchors (|D| / v of all positions) go through the first exchange;
the words around anchors that more than one document has are then extended to whole windows, whose
96-bit hashes go through the second. What comes back by block is, for each window, the smallest
document that holds it, and the words that later documents repeat are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork.llm.blocks import Blocks, ByBlock, blocked, count_blocks, one_block, write_by_block
from siftwork.llm.common import SPACED, chunks, forget, owners, small_batches, tidy, windows, word_hashes, words

#: Perfect difference sets: modulus and residues.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52), 73: (0, 1, 3, 7, 15, 31, 36, 54, 63)}
_ANCHOR, _SEED1, _SEED2 = 23, 24, 25
I64 = np.int64
#: Distinct keys that a task holds before it sends them on.
HELD = 4_000_000


def cover(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest modulus that leaves anchors at least 0.4 of the window."""
    v = max(v for v in COVERS if window - v + 1 >= max(1, 0.4 * window))
    return v, COVERS[v]


def _anchored(data, offsets, window):
    """Word bounds, owners, places, both hashes of the words, anchors' hashes (hash i is of the anchor at word i) and flags."""
    v, residues = cover(window)
    size = window - v + 1
    start, end, bounds = words(data, offsets, SPACED)
    own = owners(bounds)
    place = np.arange(len(start)) - bounds[:-1][own]
    h, g = word_hashes(data, start, end)
    runs = windows(h, size, _ANCHOR).view(I64)
    flag = np.isin(np.arange(v), residues)[place % v] & (place + size <= np.diff(bounds)[own])
    return bounds, own, place, h, g, runs, flag


def _half(h: np.ndarray) -> np.ndarray:
    """The upper 32 bits."""
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _ids(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    col = part.column(part.schema.get_field_index("doc_id"))
    return col.fill_null(0).to_numpy(), col.is_valid().to_numpy(zero_copy_only=False)


def _anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Per block the distinct anchors: (key, tag) with tag = 2 * block + (more than one document has it here)."""
    held, n, block = [], 0, None

    def flush():
        if not held:
            return
        key, doc = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key)
        key, doc = key[order], doc[order]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, I64)
        if len(at):
            several = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at)
            yield from pa.Table.from_arrays([pa.array(key[at]), pa.array(2 * block + several.astype(I64))], ["key", "tag"]).to_batches(max_chunksize=100_000)
        held.clear()

    for b, batch in one_block(batches):
        if b != block or n > HELD:
            yield from flush()
            n = 0
        block = b
        for part, data, offsets in chunks([batch]):
            _, own, _, _, _, runs, flag = _anchored(data, offsets, window)
            ids, valid = _ids(part)
            at = np.flatnonzero(flag)
            at = at[valid[own[at]]]
            held.append((runs[at], ids[own[at]]))
            n += len(at)
    yield from flush()


def _candidates(batches: Iterator[pa.RecordBatch], window: int, table: ByBlock) -> Iterator[pa.RecordBatch]:
    """Per block the distinct windows that start near a shared anchor: (h1, h2, block, lo, hi doc_id)."""
    shared = Blocks(table, ["key"], [I64])
    v, _ = cover(window)
    for block, batch in one_block(batches):
        (keys,) = shared(block)
        if not len(keys):
            continue
        for part, data, offsets in chunks([batch]):
            bounds, own, place, h, g, runs, flag = _anchored(data, offsets, window)
            ids, valid = _ids(part)
            at = np.flatnonzero(flag)
            at = at[valid[own[at]]]
            near = np.zeros(len(h) + v + 1, I64)
            near[at + 1] = keys[np.minimum(np.searchsorted(keys, runs[at]), len(keys) - 1)] == runs[at]
            np.cumsum(near, out=near)
            pick = np.flatnonzero((near[v : v + len(h)] > near[: len(h)]) & (place + window <= np.diff(bounds)[own]) & valid[own])
            if not len(pick):
                continue
            h1, h2 = windows(h, window, _SEED1).view(I64)[pick], _half(windows(g, window, _SEED2)[pick])
            doc = ids[own[pick]]
            order = np.lexsort((h2, h1))
            h1, h2, doc = h1[order], h2[order], doc[order]
            at = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))
            lo, hi = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
            back = np.argsort(lo, kind="stable")  # in an exchange only the hashes are then without order
            at, lo, hi = at[back], lo[back], hi[back]
            yield pa.RecordBatch.from_arrays([pa.array(h1[at]), pa.array(h2[at]), pa.array(np.full(len(at), block, np.int32)), pa.array(lo), pa.array(hi)], ["h1", "h2", "block", "lo", "hi"])


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after the other, a space after each, and where each begins (and the end)."""
    size = end - start + 1
    to = np.zeros(len(start) + 1, I64)
    np.cumsum(size, out=to[1:])
    source = np.arange(to[-1]) + np.repeat(start - to[:-1], size)
    out = data[np.minimum(source, max(len(data) - 1, 0))]
    out[to[1:] - 1] = 0x20
    return out, to


def _removed(batches: Iterator[pa.RecordBatch], window: int, table: ByBlock) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, n_removed, kept_text) per document."""
    firsts = Blocks(table, ["h1", "h2", "least"], [I64, np.int32, I64])
    for block, batch in one_block(batches):
        k1, k2, least = firsts(block)
        for part, data, offsets in chunks([batch]):
            start, end, bounds = words(data, offsets, SPACED)
            own = owners(bounds)
            count = np.diff(bounds)
            gone = np.zeros(len(start) + 1, I64)
            if len(k1) and len(start) >= window:
                ids, valid = _ids(part)
                h, g = word_hashes(data, start, end)
                h1 = windows(h, window, _SEED1).view(I64)
                at = np.minimum(np.searchsorted(k1, h1), len(k1) - 1)
                place = np.arange(len(h1)) - bounds[:-1][own[: len(h1)]]
                hit = np.flatnonzero((k1[at] == h1) & (place + window <= count[own[: len(h1)]]) & valid[own[: len(h1)]])
                if len(hit):
                    h2 = _half(windows(g, window, _SEED2)[hit])
                    at = at[hit]
                    seen = np.zeros(len(hit), bool)
                    while True:  # rows of equal h1 stand together; nearly always there is one
                        here = np.minimum(at, len(k1) - 1)
                        same = (at < len(k1)) & (k1[here] == h1[hit])
                        if not same.any():
                            break
                        seen |= same & (k2[here] == h2) & (least[here] < ids[own[hit]])
                        at = at + 1
                    gone[hit[seen]] += 1
                    np.add.at(gone, hit[seen] + window, -1)
            keep = np.cumsum(gone[:-1]) == 0
            buf, to = joined(data, start[keep], end[keep])
            left = np.bincount(own[keep], minlength=part.num_rows)
            ends = np.concatenate(([0], np.cumsum(left)))
            raw = buf.tobytes()
            texts = [raw[to[a] : to[b] - 1] if b > a else b"" for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(count), pa.array(count - left), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_text (the words left, joined by one space).

    A word goes if a window of `window` consecutive words covers it whose words also start somewhere
    in a document with a smaller doc_id; windows are judged on the input. Null and empty texts have no
    words. Rows that repeat a doc_id are not smaller than each other, so neither loses to the other;
    a row without doc_id neither removes nor loses words. Other columns of docs play no part. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    texts = blocked(small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "texts")
    blocks = count_blocks(texts)
    anchors = texts.mapInArrow(lambda it: _anchors(it, window), "key long, tag long")
    same = W.partitionBy("key")
    shared = anchors.withColumn("n", F.count("*").over(same)).withColumn("several", F.max(F.col("tag") % 2).over(same)).where("n > 1 or several = 1")
    met = write_by_block(shared.select(F.expr("cast(tag div 2 as int)").alias("block"), "key").distinct(), "anchors", blocks, "key")
    tidy(spark)
    found = texts.mapInArrow(lambda it: _candidates(it, window, met), "h1 long, h2 int, block int, lo long, hi long")
    least = found.withColumn("least", F.min("lo").over(W.partitionBy("h1", "h2"))).where("least < hi")
    first = write_by_block(least.select("block", "h1", "h2", "least").distinct(), "windows", blocks, "h1")
    forget(met.path)
    tidy(spark)
    return texts.mapInArrow(lambda it: _removed(it, window, first), "doc_id long, n_words long, n_removed long, kept_text string")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words left when runs of 50 that an earlier document has are cut."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, 50).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS m FROM x GROUP BY h),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM x JOIN f USING (h) WHERE m < doc_id),
k AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY 1),
e AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN k USING (doc_id)),
p AS (SELECT doc_id, i, w[i] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
q AS (SELECT p.doc_id, string_agg(p.t, ' ' ORDER BY p.i) AS t FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.i = p.i WHERE r.i IS NULL GROUP BY 1)
SELECT e.doc_id, len(e.w)::BIGINT AS n_words, len(e.gone)::BIGINT AS n_removed, sha256(coalesce(q.t, '')) AS kept_sha256 FROM e LEFT JOIN q USING (doc_id)
"""
