"""Benchmark decontamination by winnowing.

A window of n item words is represented by the least of its hashes of 5 consecutive words. Equal
windows have equal least hashes, so a text that holds an item's window always meets it at one of
the selected fingerprints; only there are whole windows compared, by 128-bit hashes.

Item windows go to all tasks only while their counted number stays within a bound. Beyond it,
fingerprints of text blocks and items meet in one exchange, and each block opens the windows whose
fingerprint it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.blocks import blocked, count_blocks, one_block, write_by_block
from siftwork.llm.common import ALNUM, LOWER, chunks, owners, small_batches, tidy, unused, windows, word_hashes, words

WINDOW = 10
GRAM = 5
#: Item windows that may be sent to every task (about 40 bytes each).
BROADCAST_WINDOWS = 500_000
_GRAM_SEED, _SEED1, _SEED2 = 33, 34, 35
I64 = np.int64


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """For each run of n words the least hash of its grams of min(GRAM, n) words (as signed numbers)."""
    g = windows(h, min(GRAM, n), _GRAM_SEED).view(I64)
    out = g[: max(len(h) - n + 1, 0)].copy()
    for i in range(1, n - min(GRAM, n) + 1):
        np.minimum(out, g[i : i + len(out)], out=out)
    return out


def _spelled(data, offsets):
    """Bounds of each text's words, each word's text, and both hashes of the words."""
    data = LOWER[data]
    start, end, bounds = words(data, offsets, ALNUM)
    return bounds, owners(bounds), *word_hashes(data, start, end)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each item (item_id, n, key, h1, h2) per window."""
    for part, data, offsets in chunks(batches):
        bounds, own, h, g = _spelled(data, offsets)
        count = np.diff(bounds)
        place = np.arange(len(h)) - bounds[:-1][own]
        for n in range(1, WINDOW + 1):
            room = count[own] - place
            at = np.flatnonzero((count[own] == n) & (place == 0) if n < WINDOW else room >= n)
            if len(at):
                ids = part.column(0).take(pa.array(own[at]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(at), n, np.int32)), pa.array(_least(h, n)[at]), pa.array(windows(h, n, _SEED1)[at].view(I64)), pa.array(windows(g, n, _SEED2)[at].view(I64))], ["item_id", "n", "key", "h1", "h2"])


class _Items:
    """Item windows by length, ready to be looked up."""

    def __init__(self, table: pa.Table):
        n = table.column("n").to_numpy()
        self.by_n = {}
        names = table.column("item_id").to_pylist() if table.num_rows else []
        self.names = sorted(set(names))
        rank = {x: i for i, x in enumerate(self.names)}
        item = np.array([rank[x] for x in names], I64)
        key, h1, h2 = (table.column(c).to_numpy() for c in ("key", "h1", "h2"))
        for k in np.unique(n):
            rows = np.flatnonzero(n == k)
            rows = rows[np.lexsort((item[rows], h2[rows], h1[rows]))]
            self.by_n[int(k)] = (np.unique(key[rows]), h1[rows], h2[rows], item[rows])


def _scan(part: pa.RecordBatch, data, offsets, items: _Items) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each text its words, those that are hit, and the names of the items met."""
    bounds, own, h, g = _spelled(data, offsets)
    n_words = np.diff(bounds)
    cover = np.zeros(len(h) + 1, I64)
    place = np.arange(len(h)) - bounds[:-1][own]
    met: list[np.ndarray] = []
    for n, (keys, k1, k2, item) in items.by_n.items():
        least = _least(h, n)
        if not len(least):
            continue
        new = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        run = least[new]
        known = keys[np.minimum(np.searchsorted(keys, run), len(keys) - 1)] == run
        pick = np.flatnonzero(np.repeat(known, np.diff(np.append(new, len(least)))))
        pick = pick[place[pick] + n <= n_words[own[pick]]]
        if not len(pick):
            continue
        h1, h2 = windows(h, n, _SEED1).view(I64)[pick], windows(g, n, _SEED2).view(I64)[pick]
        at = np.searchsorted(k1, h1)
        hit = np.zeros(len(pick), bool)
        while True:  # rows of equal windows stand together, one for each item that has it
            here = np.minimum(at, len(k1) - 1)
            same = (at < len(k1)) & (k1[here] == h1)
            if not same.any():
                break
            ok = same & (k2[here] == h2)
            hit |= ok
            met.append(np.stack((own[pick[ok]], item[here[ok]])))
            at = np.where(same, at + 1, len(k1))
        cover[pick[hit]] += 1
        np.add.at(cover, pick[hit] + n, -1)
    inside = np.cumsum(cover[:-1]) > 0
    n_hit = np.bincount(own[inside], minlength=part.num_rows)
    pairs = np.unique(np.concatenate(met, axis=1), axis=1) if met else np.empty((2, 0), I64)
    to = np.zeros(part.num_rows + 1, np.int32)
    np.cumsum(np.bincount(pairs[0], minlength=part.num_rows), out=to[1:])
    names = pa.array(items.names, pa.string()).take(pa.array(pairs[1]))
    return n_words, n_hit, pa.ListArray.from_arrays(pa.array(to), names)


def _scanned(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int, emit, schema) -> DataFrame:
    """What emit makes of each batch of docs (its text a string) and the result of _scan()."""
    docs = small_batches(docs)
    windows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_item_windows, "item_id string, n int, key long, h1 long, h2 long").distinct()
    if windows.limit(broadcast_windows + 1).count() <= broadcast_windows:
        table = windows.toArrow()

        def small(batches):
            items = _Items(table)
            for part, data, offsets in chunks(batches):
                yield emit(part, *_scan(part, data, offsets, items))

        return docs.mapInArrow(small, schema)

    name = unused("block", docs)
    texts = blocked(docs, "texts", name)
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect())  # at most WINDOW numbers

    def fingerprints(batches):
        for block, batch in one_block(batches):
            for _, data, offsets in chunks([batch]):
                *_, h, _ = _spelled(data, offsets)
                for n in lengths:
                    key = np.unique(_least(h, n))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block, np.int32)), pa.array(np.full(len(key), n, np.int32)), pa.array(key)], ["block", "n", "key"])

    near = texts.select(F.col(name).alias("block"), "text").mapInArrow(fingerprints, "block int, n int, key long").distinct()
    met = write_by_block(near.join(windows, ["n", "key"]).select("block", "item_id", "n", "key", "h1", "h2"), "windows", count_blocks(texts, name), "h1")
    tidy(docs.sparkSession)
    empty = pa.schema([("item_id", pa.string()), ("n", pa.int32()), ("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())]).empty_table()

    def large(batches):
        now, items = None, None
        for block, batch in one_block(batches, name):
            if block != now:
                now, items = block, _Items(met.read(block) or empty)
            for part, data, offsets in chunks([batch]):
                yield emit(part.select(part.schema.names[:-1]), *_scan(part, data, offsets, items))

    return texts.mapInArrow(large, schema)


def overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, items (item_ids with a window in it, sorted as strings).

    A window is 10 consecutive item words; an item of fewer is one window, one of none has none. Words
    are runs of [0-9a-z] and non-ASCII characters of the lower-cased (A-Z) text. Null and empty texts
    have no words. Items with a null item_id or text are left out; items that repeat an id count as one.
    Each row of docs gets its result, repeated ids too; other columns of docs play no part. Empty tables
    give no rows, or no hits.
    """

    def emit(part, n_words, n_hit, items):
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words), pa.array(n_hit), items], ["doc_id", "n_words", "n_hit", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _scanned(texts, benchmark, broadcast_windows, emit, "doc_id long, n_words long, n_hit long, items array<string>")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, in which overlaps() hits no word.

    Rows without doc_id are judged like others; null texts stay. Repeated rows stay or go alike; an empty
    table gives an empty result, an empty benchmark all rows.
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    return _scanned(docs, benchmark, broadcast_windows, lambda part, _, n_hit, __: part.filter(pa.array(n_hit == 0)), docs.schema)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Documents held against the benchmark's items."""
    found = overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH lower_case AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lower_case CROSS JOIN (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item_id FROM x JOIN v USING (n, s)),
h AS (SELECT doc_id, count(*) AS c FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS c, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.c, 0)::BIGINT AS n_hit, coalesce(t.c, 0)::BIGINT AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, h.c IS NOT NULL AS contaminated
FROM lower_case d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
