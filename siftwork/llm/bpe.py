"""Byte-level BPE of texts by recursive DuckDB queries.

Spark's regular expressions split each text into pieces. A recursive query holds every distinct
piece of a batch as a list of tokens, bytes at first, and joins the leftmost adjacent pair of the
least rank of each piece per step until no pair of it has a rank; the result is that of a greedy
encoder, one merge at a time. Pieces met before are not asked for again. A piece of over LONG bytes,
for which as many steps would each go over all of it, is merged with a heap by the same rule.

Decoding joins token-position rows with the vocabulary and gathers each text by an aggregation in the
order of the positions. DuckDB aggregates strings, so a byte is spelled as the character of that number.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.llm.common import small_batches, text_bytes, unused

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: (?U) has \s mean Unicode's white space, as the rank files' own splitter does.
PATTERN = "(?U)" + public_tokenizers.PATTERN
#: Bytes of a piece beyond which the heap merges it; pieces kept between batches; pieces handled and asked for at once.
LONG, KNOWN, AT_ONCE, ASKED = 512, 700_000, 1 << 20, 1 << 16

_ENCODE = """
WITH RECURSIVE s(w, toks) USING KEY (w) AS (
  SELECT w, toks FROM pieces
  UNION
  SELECT s.w, list_concat(list_append(s.toks[:(m.best & 4294967295) - 1], (m.best >> 32)::INT), s.toks[(m.best & 4294967295) + 2:])
  FROM s JOIN (
    SELECT w, min((rank::BIGINT << 32) | k) AS best
    FROM (SELECT w, (unnest(toks[:-2])::BIGINT << 16) | unnest(toks[2:]) AS pair, generate_subscripts(toks[2:], 1) AS k FROM s WHERE len(toks) > 1) JOIN pairs USING (pair)
    GROUP BY w) m USING (w))
SELECT toks FROM s ORDER BY w
"""
_DECODE = """
SELECT string_agg(spelled, '' ORDER BY place) AS text FROM given JOIN vocabulary USING (tok) GROUP BY row ORDER BY row
"""


class Encoder:
    """Tokens of pieces and bytes of tokens, by the ranks of a file of public_tokenizers."""

    def __init__(self, vocabulary: str = VOCABULARY):
        with open(public_tokenizers.path(vocabulary), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ids = {r: t for t, r in self.ranks.items()}
        if sorted(ids) != list(range(len(ids))) or len(ids) > 1 << 16:
            raise ValueError("ranks must be 0, 1, 2 ... below 65536")
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        split = [(self.ranks[t[:k]], self.ranks[t[k:]], r, k) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.pairs = {(a, b): r for a, b, r, _ in split}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        a, b, r, _ = map(np.array, zip(*split))
        self._table("pairs", pair=(a << 16) | b, rank=r.astype(np.int32))
        self._table("vocabulary", tok=np.arange(len(ids), dtype=np.int32), spelled=[ids[i].decode("latin-1") for i in range(len(ids))])
        self._forget()

    def _table(self, name: str, **columns) -> None:
        given = pa.table(columns)
        self.db.register("given", given)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _forget(self) -> None:
        self.known, self.tokens = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))

    def _short(self, pieces: pa.Array) -> pa.Array:
        data, offsets = text_bytes(pieces)
        given = pa.table({"w": np.arange(len(pieces), dtype=np.int32), "toks": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(self.byte[data]))})
        self.db.register("pieces", given)
        out = self.db.sql(_ENCODE).to_arrow_table().column("toks").combine_chunks()
        self.db.unregister("pieces")
        return out.cast(pa.list_(pa.int32()))

    def _long(self, piece: bytes) -> list[int]:
        tok, n = [int(self.byte[b]) for b in piece], len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(tok, tok[1:])) if (r := self.pairs.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tok[i] != a or j >= n or tok[j] != b:
                continue
            tok[i], tok[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (s := self.pairs.get((tok[x], tok[y]))) is not None:
                    heapq.heappush(heap, (s, x, tok[x], tok[y]))
        return [t for t in tok if t >= 0]

    def encode(self, pieces: pa.Array) -> pa.Array:
        """Token lists of distinct pieces."""
        new = pieces.filter(pc.is_null(pc.index_in(pieces, value_set=self.known)))
        if len(new):
            if len(self.known) + len(new) > KNOWN:
                self._forget()
                new = pieces
            long = pc.greater(pc.binary_length(new), LONG)
            few, many = new.filter(long), new.filter(pc.invert(long))
            parts = [(x := many.slice(i, ASKED), self._short(x)) for i in range(0, len(many), ASKED)]
            parts += [(few, pa.array([self._long(x.encode()) for x in few.to_pylist()], pa.list_(pa.int32())))] if len(few) else []
            self.known = pa.concat_arrays([self.known, *(p for p, _ in parts)])
            self.tokens = pa.concat_arrays([self.tokens, *(t for _, t in parts)])
        return self.tokens.take(pc.index_in(pieces, value_set=self.known))

    def decode(self, tokens: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Bytes of each text, whose tokens are those between two bounds."""
        n = np.diff(bounds)
        out = [b""] * len(n)
        given = pa.table({"row": np.repeat(np.arange(len(n), dtype=np.int32), n), "place": np.arange(len(tokens)), "tok": tokens})
        self.db.register("given", given)
        for i, x in zip(np.flatnonzero(n), self.db.sql(_DECODE).to_arrow_table().column("text")):
            out[i] = x.as_py().encode("latin-1")
        self.db.unregister("given")
        return out


_encoder: Encoder | None = None


def _encode(batches: Iterator[pa.RecordBatch], pieces: str) -> Iterator[pa.RecordBatch]:
    """The batches, with tokens, their number and what they decode to in place of the column pieces, the last one."""
    global _encoder
    if _encoder is None:
        _encoder = Encoder()
    for batch in batches:
        at, bounds = 0, np.concatenate(([0], np.cumsum(pc.list_value_length(batch.column(pieces)).to_numpy(zero_copy_only=False)))).astype(np.int64)
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + AT_ONCE, "right")) - 1)
            yield _rows(_encoder, batch.slice(at, to - at), bounds[at : to + 1] - bounds[at])
            at = to


def _rows(encoder: Encoder, part: pa.RecordBatch, bounds: np.ndarray) -> pa.RecordBatch:
    pieces = part.column(part.num_columns - 1).flatten().dictionary_encode()
    lists = encoder.encode(pieces.dictionary).take(pieces.indices)
    place = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)[bounds]
    tokens = lists.flatten()
    lists = pa.ListArray.from_arrays(pa.array(place.astype(np.int32)), tokens)
    decoded = encoder.decode(tokens.to_numpy(), place)
    return pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(np.diff(place)), pa.array(decoded, pa.binary())], [*part.schema.names[:-1], "tokens", "n_tokens", "decoded"])


def encoded(docs: DataFrame) -> DataFrame:
    """docs with tokens (ids of VOCABULARY), n_tokens and decoded (the bytes that the ids stand for).

    Null and empty texts have no tokens and decode to no bytes. Repeated rows get equal results; an empty
    table gives an empty result. Other columns are kept as they are, but for those named tokens, n_tokens
    or decoded, which are replaced.
    """
    docs = small_batches(docs).drop("tokens", "n_tokens", "decoded").withColumn("text", F.col("text").cast("string"))
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(PATTERN), F.lit(0))
    schema = T.StructType([*docs.schema.fields, T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.BinaryType())])
    name = unused("pieces", docs)
    return docs.withColumn(name, pieces).mapInArrow(lambda it: _encode(it, name), schema)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents as tokens, and decoded again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = F.array_join(F.col("tokens").cast("array<string>"), ",")
    return encoded(docs).select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
