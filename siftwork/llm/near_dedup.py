"""Near-duplicate documents: MinHash bands propose, odd sketches check, full shingle sets confirm.

One Arrow pass turns each text into the digest of its shingle set, band keys of a MinHash signature
and an odd sketch: every MinHash sample flips one bit of a 512-bit map, so the population count of
two maps' XOR estimates how many samples differ. Texts with one and the same shingle set form a
class at once and only its smallest doc_id goes on. In each band bucket every class is first held
against the bucket's smallest id; after joining what that links, only pairs of a bucket that still
lie in different components are looked at, by their sketches inside the join, so copies are never
expanded into all pairs and yet no pair that shares a bucket is left undecided.

Texts with much in common that are no copies (a form, a long notice) may fill buckets with very many
components, whose pairs would grow as their square. Classes of such buckets are matched exactly
instead: two sets that reach the similarity share one of their rarest shingles, counted among these
classes (as many as the sets may differ by, and one more), and what all of them have is not rare.

The bands miss a pair at the threshold with a probability below 1e-6, the sketch test below 1e-7.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork.llm.common import LOWER, SPACED, chunks, forget, mix, small_batches, text_bytes, tidy, windows, word_hashes, words, written
from siftwork.llm.components import components

SAMPLES = 256
SKETCH_BITS = 512
LONGS = SKETCH_BITS // 64
#: Components of a bucket beyond which its classes are matched by their rarest shingles.
CROWD = 200
_SEED = 12
_RNG = np.random.default_rng(7)
_XOR = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_MUL = _RNG.integers(0, 1 << 31, SAMPLES, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def banding(similarity: float) -> tuple[int, int]:
    """(bands, rows): fewest candidates for a miss below 1e-6 at the threshold with SAMPLES samples."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(1e-6) / math.log(1 - similarity**rows))
        if bands * rows <= SAMPLES:
            return bands, rows
    raise ValueError(f"similarity {similarity} is too low for {SAMPLES} samples")


def sketch_limit(similarity: float, miss: float = 1e-7) -> int:
    """The XOR population count that a pair at the threshold exceeds with a probability below miss."""
    differ = np.array([math.comb(SAMPLES, x) * (1 - similarity) ** x * similarity ** (SAMPLES - x) for x in range(SAMPLES + 1)])
    odd = np.zeros(SKETCH_BITS + 1)
    odd[0] = 1.0
    total = differ[0] * odd
    up = 1 - np.arange(SKETCH_BITS + 1) / SKETCH_BITS
    for x in range(1, SAMPLES + 1):
        for _ in range(2):
            step = np.zeros_like(odd)
            step[1:] += (odd * up)[:-1]
            step[:-1] += (odd * (1 - up))[1:]
            odd = step
        total += differ[x] * odd
    tail = np.cumsum(total[::-1])[::-1]
    return int(np.flatnonzero(tail > miss)[-1])


def _shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, repeats included, and the bounds of each text's part."""
    data = LOWER[data]
    start, end, bounds = words(data, offsets, SPACED)
    h, _ = word_hashes(data, start, end)
    count = np.diff(bounds)
    runs = windows(h, size, _SEED)
    n = np.where((count > 0) & (count < size), 1, np.maximum(count - size + 1, 0))
    to = np.zeros(len(count) + 1, np.int64)
    np.cumsum(n, out=to[1:])
    own = np.repeat(np.arange(len(count)), n)
    at = bounds[:-1][own] + np.arange(to[-1]) - to[:-1][own]
    out = np.empty(to[-1], np.uint64)
    full = count[own] >= size
    out[full] = runs[at[full]]
    for k in range(1, size):
        short = np.flatnonzero(count == k)
        out[to[:-1][short]] = windows(h, k, _SEED)[bounds[:-1][short]]
    return out, to


_SKETCH = [f"s{i}" for i in range(LONGS)]


def _signatures(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in chunks(batches):
        h, to = _shingles(data, offsets, size)
        n_docs = part.num_rows
        some = np.flatnonzero(np.diff(to))
        sig = np.zeros((SAMPLES, n_docs), np.uint32)
        if len(some):
            low = (h >> np.uint64(32)).astype(np.uint32)
            for i in range(SAMPLES):
                sig[i, some] = np.minimum.reduceat((low ^ _XOR[i]) * _MUL[i], to[:-1][some])
        wide = sig.T.astype(np.uint64)
        place = np.arange(SAMPLES, dtype=np.uint64)
        bit = (mix(wide + (place << np.uint64(32)) * np.uint64(0x9E3779B1)) % np.uint64(SKETCH_BITS)).astype(np.int64)
        odd = np.bincount((np.arange(n_docs)[:, None] * SKETCH_BITS + bit).ravel(), minlength=n_docs * SKETCH_BITS) & 1
        sketch = np.packbits(odd.astype(np.uint8).reshape(n_docs, SKETCH_BITS), axis=1).view(np.int64)
        key = np.zeros((n_docs, bands), np.uint64)
        for r in range(rows):
            key = mix(key + wide[:, r : bands * rows : rows] + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        n, d1, d2 = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
        for i in some:
            own = np.unique(h[to[i] : to[i + 1]])
            n[i] = len(own)
            d1[i], d2[i] = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.where(np.arange(n_docs + 1) > 0, np.arange(n_docs + 1) * bands, 0).astype(np.int32)), pa.array(key.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n), pa.array(d1), pa.array(d2), lists, *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(LONGS))], ["doc_id", "n_shingles", "d1", "d2", "bands", *_SKETCH])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(id, shingle) for each distinct shingle of each text."""
    for part, data, offsets in chunks(batches):
        h, to = _shingles(data, offsets, size)
        own = np.repeat(np.arange(part.num_rows), np.diff(to))
        order = np.lexsort((h, own))
        own, h = own[order], h[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        at = np.flatnonzero(fresh)
        for k in range(0, len(at), 100_000):
            some = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own[some])), pa.array(h[some].view(np.int64))], ["id", "shingle"])


def _confirm(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (u, v, text_u, text_v) those whose shingle sets reach percent of their union."""
    kept: dict[bytes, np.ndarray] = {}

    def sets(part: pa.RecordBatch, name: str) -> list[np.ndarray]:
        texts = part.column(part.schema.get_field_index(name)).dictionary_encode()
        keys = [xxhash.xxh3_128_digest(t) for t in texts.dictionary.cast(pa.binary()).to_pylist()]
        new = [i for i, k in enumerate(keys) if k not in kept]
        if new:
            h, to = _shingles(*text_bytes(texts.dictionary.take(pa.array(new))), size)
            for k, i in enumerate(new):
                kept[keys[i]] = np.unique(h[to[k] : to[k + 1]])
        return [kept[keys[i]] for i in texts.indices.to_pylist()]

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            if sum(map(len, kept.values())) > 2_000_000:
                kept.clear()
            ok = np.zeros(part.num_rows, bool)
            for i, (a, b) in enumerate(zip(sets(part, "text_u"), sets(part, "text_v"), strict=True)):
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(a) + len(b) - both) and both > 0
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["u", "v"]).filter(pa.array(ok))


def _alike(a: str, b: str, limit: int, percent: int) -> Column:
    """Sizes that allow the similarity, and sketches within limit."""
    differ = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(1, LONGS)), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (differ <= limit)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept, n_copies (rows with an equal shingle set).

    docs has doc_id and text; other columns are left alone. Texts are linked when their sets of
    distinct shingles of lower-cased (A-Z) words share at least percent % of their union. A text of
    fewer words is one shingle; null, empty and blank texts have none and are linked with nothing.
    component_id is the smallest doc_id reachable, kept is doc_id = component_id. Rows that repeat a
    doc_id count as one document, which has the links of all its texts; a row without doc_id is linked with nothing, its component_id is
    null and it is kept. An empty table gives an empty result. Columns of docs besides these two play
    no part, whatever their names.
    """
    spark = docs.sparkSession
    bands, rows = banding(percent / 100)
    limit = sketch_limit(percent / 100)
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    longs = ", ".join(f"{x} long" for x in _SKETCH)
    sig = written(texts.mapInArrow(lambda it: _signatures(it, shingle_words, bands, rows), f"doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, {longs}"), "signatures")
    classes = written(sig.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")), "classes")
    reps = sig.where("n_shingles > 0").join(classes.select(F.col("rep").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"], "left_semi")
    sketches = reps.select(F.col("doc_id").alias("id"), "n_shingles", *_SKETCH)
    keyed = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket"))
    hubs = keyed.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("bucket", "hub")
    shared = written(keyed.join(hubs, "bucket"), "buckets")
    tidy(spark)

    def confirmed(pairs: DataFrame) -> DataFrame:
        t = texts.where("doc_id is not null")
        full = pairs.join(t.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v").join(t.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")
        return written(full.select("u", "v", "text_u", "text_v").mapInArrow(lambda it: _confirm(it, shingle_words, percent), "u long, v long"), "links")

    tested = written(
        shared.where("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct()
        .join(sketches.alias("a"), F.col("u") == F.col("a.id")).join(sketches.alias("b"), F.col("v") == F.col("b.id"))
        .where(_alike("a", "b", limit, percent)).select("u", "v").distinct(),
        "pairs",
    )
    digest = F.struct("d1", "d2")
    several = sig.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a <> b").select("doc_id")
    own_texts = sig.join(several, "doc_id", "left_semi").join(classes, ["d1", "d2"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    first = confirmed(tested)
    to_hubs = written(first.union(own_texts), "links")
    forget(first)
    found = components(to_hubs)
    tidy(spark)

    placed = written(shared.select("bucket", "id").join(found, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component")), "placed")
    split = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count_distinct("component").alias("n")).where("lo < hi").select("bucket", "n")
    split = written(split, "split")
    apart = placed.join(split.where(F.col("n") <= CROWD).select("bucket"), "bucket")
    if not split.where(F.col("n") > CROWD).isEmpty():
        crowd = placed.join(split.where(F.col("n") > CROWD).select("bucket"), "bucket", "left_semi").select("id", "component").distinct()
        apart = apart.union(_rarest(texts, crowd, shingle_words, percent))
    apart = written(apart.join(sketches, "id"), "apart")
    more = (
        apart.alias("a").join(apart.alias("b"), (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.component") != F.col("b.component")) & _alike("a", "b", limit, percent))
        .select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()
        .join(tested, ["u", "v"], "left_anti")
    )
    others = confirmed(more)
    found = components(to_hubs.union(others))
    forget(shared, placed, split, apart, tested, to_hubs, others)
    tidy(spark)
    member = classes.join(found, classes["rep"] == found["id"], "left").select("d1", "d2", "n_copies", F.coalesce("component", "rep").alias("component_id"))
    own = sig.select("doc_id", "n_shingles", *(F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("d1", "d2")))
    return own.join(member, ["d1", "d2"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"), F.coalesce("n_copies", F.lit(1)).alias("n_copies")
    )


def _rarest(texts: DataFrame, crowd: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """(bucket, id, component): for each id of crowd the rarest of its shingles that others of crowd have.

    Of n shingles it takes the n - ceil(n * percent / 100) + 1 rarest; sets that share percent % of their
    union have one of these in common. A shingle that one id alone has links nothing.
    """
    sets = texts.select(F.col("doc_id").alias("id"), "text").where("id is not null").join(crowd.select("id"), "id", "left_semi")
    sets = written(sets.mapInArrow(lambda it: _sets(it, shingle_words), "id long, shingle long"), "sets")  # rows of a repeated id change nothing but its counts
    counts = sets.groupBy("shingle").agg(F.count("*").alias("n"))
    own = W.partitionBy("id")
    placed = sets.join(counts, "shingle").withColumn("place", F.row_number().over(own.orderBy("n", "shingle"))).withColumn("size", F.count("*").over(own))
    few = placed.where((F.col("place") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1) & (F.col("n") > 1))
    out = written(few.join(crowd, "id").select(F.col("shingle").alias("bucket"), "id", "component"), "rarest")
    forget(sets)
    return out


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets share 85 % of their union."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, shingle_words=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n n1 ON n1.doc_id = p.a JOIN n n2 ON n2.doc_id = p.b WHERE 100 * p.c >= 85 * (n1.n + n2.n - p.c)),
r(doc_id, o) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.o)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(o) AS m FROM r GROUP BY 1) c USING (doc_id)
"""
