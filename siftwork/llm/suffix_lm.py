"""Language-model scoring with a probabilistic suffix tree, beside a word-count baseline.

The model reads a text as its tokens spelled out: the bytes of each lower-cased word and a space,
and an end mark after the last. It predicts each symbol from the longest retained context of up to
DEPTH symbols before it, over word borders. A context is retained if it was seen LEAST times and its
next symbols diverge from what the longest retained shorter context predicts: twice the gain in log
likelihood must exceed GAIN and two for each kind of symbol after the first. Distributions are
smoothed with that of the shorter context (Witten-Bell), down to a uniform one.

All training documents count, and neither test depends on the size of the corpus, so the tree grows
with it. No task or driver holds the tree: each block's grams of DEPTH + 1 symbols are summed in one
exchange; the part of the tree below three symbols lies in one partition, which predicts every gram
there; and the predictions return to the blocks that have the gram. Only contexts of up to two
symbols (at most 2 ** 24 rows) are read by every task that predicts. The baseline's vocabulary
comes back block by block in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork.llm.blocks import Blocks, blocked, count_blocks, one_block, write_by_block
from siftwork.llm.common import LOWER, SPACED, chunks, crc32_mod, forget, owners, small_batches, tidy, word_hashes, words, written

DEPTH = 5
LEAST, GAIN = 2, 6.0
SYMBOLS = 257
I64, U64 = np.int64, np.uint64
#: Key of the end token (no word's digest is looked up under it but by chance of 2**-64).
END_KEY = I64(0x0E0D)
_HELD = 3_000_000
_GROUP = 400_000
_SLOT_BITS = 22


def spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams of DEPTH + 1 symbols that end at each symbol of all texts, and where each text's begin.

    The symbol is the lowest byte; of those before it the nearest is the highest byte, so grams that
    share a context stand together when sorted.
    """
    n_docs = len(bounds) - 1
    size = end - start
    to = np.zeros(len(start) + 1, I64)
    np.cumsum(size + 1, out=to[1:])
    pad = DEPTH * (owners(bounds) + 1) + owners(bounds)
    begin = to[:-1] + pad
    length = to[-1] + n_docs * (DEPTH + 1)
    out = np.full(length + 7 - DEPTH, 10, np.uint8)
    symbols = out[7 - DEPTH :]
    shift = (begin - (to[:-1] - np.arange(len(start)))).astype(np.int32)
    symbols[np.arange(size.sum(), dtype=np.int32) + np.repeat(shift, size)] = data[SPACED[data]]
    symbols[begin + size] = 0x20
    # eight bytes up to each symbol as one number, the symbol highest and the farthest byte lowest
    wide = np.ndarray(length - DEPTH, "<u8", out, 0, (1,)).copy()
    code = (((wide << U64(8)) >> U64(8 * (8 - DEPTH))) << U64(8)) | (wide >> U64(56))
    n_symbols = to[bounds[1:]] - to[bounds[:-1]] + 1
    first = np.concatenate(([0], np.cumsum(n_symbols)))
    real = np.ones(length - DEPTH, bool)
    real[((first[1:-1] + DEPTH * np.arange(n_docs - 1))[:, None] + np.arange(DEPTH)).ravel()] = False
    return code[real], first


def _read(data, offsets):
    data = LOWER[data]
    return data, *words(data, offsets, SPACED)


def _keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return word_hashes(data, start, end)[0].view(I64)


def _grouped(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, I64)
    return key[at], np.add.reduceat(n, at) if len(at) else n


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, key, n): each word of a block and how often training documents in it have it."""
    held, size, now = [], 0, None

    def flush():
        if held:
            key, n = _grouped(*(np.concatenate(x) for x in zip(*held)))
            yield from pa.Table.from_arrays([pa.array(np.full(len(key), now, np.int32)), pa.array(key), pa.array(n)], ["block", "key", "n"]).to_batches(max_chunksize=100_000)
        held.clear()

    for block, batch in one_block(batches):
        if block != now or size > _HELD:
            yield from flush()
            now, size = block, 0
        for part, data, offsets in chunks([batch]):
            data, start, end, bounds = _read(data, offsets)
            learn = part.column(2).to_numpy(zero_copy_only=False).astype(I64)
            key = np.concatenate((_keys(data, start, end), np.full(part.num_rows, END_KEY)))
            held.append(_grouped(key, np.concatenate((learn[owners(bounds)], learn))))
            size += len(held[-1][0])
    yield from flush()


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, gram, n): the grams of a block and how often training documents in it have each."""
    held, size, now = [], 0, None

    def merged() -> list:
        return [_grouped(*(np.concatenate(x) for x in zip(*held)))] if held else held

    def flush():
        for key, n in merged():
            yield from pa.Table.from_arrays([pa.array(np.full(len(key), now, np.int32)), pa.array(key), pa.array(n)], ["block", "gram", "n"]).to_batches(max_chunksize=100_000)
        held.clear()

    for block, batch in one_block(batches):
        if block != now:
            yield from flush()
            now, size = block, 0
        for part, data, offsets in chunks([batch]):
            data, start, end, bounds = _read(data, offsets)
            code, first = spelled(data, start, end, bounds)
            learn = np.repeat(part.column(2).to_numpy(zero_copy_only=False), np.diff(first))
            taught, n = np.unique(code[learn].view(I64), return_counts=True)
            others = np.unique(code[~learn].view(I64))
            held.append((np.concatenate((taught, others)), np.concatenate((n, np.zeros(len(others), I64)))))
            size += len(held[-1][0])
            if size > _HELD:
                held[:] = merged()
                size = len(held[0][0])
                if size > _HELD:
                    yield from flush()
                    size = 0
    yield from flush()


def _sharper(context: np.ndarray, symbol: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probabilities of symbols after contexts that are one symbol longer than those which gave p.

    Rows of a context stand together, all of them; rows of an equal context and symbol have equal p.
    """
    order = np.lexsort((symbol, context))
    context, symbol, n, q = context[order], symbol[order], n[order], p[order]
    new = np.ones(len(n), bool)
    new[1:] = (context[1:] != context[:-1]) | (symbol[1:] != symbol[:-1])
    pair = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    count, q, context = np.add.reduceat(n, at).astype(np.float64), q[at], context[at]
    first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    size = np.diff(np.append(first, len(context)))
    total, kinds = np.add.reduceat(count, first), np.add.reduceat((count > 0).astype(np.float64), first)
    share = count / np.repeat(np.maximum(total, 1), size)
    gain = 2 * np.add.reduceat(np.where(count > 0, count * np.log(np.maximum(share, 1e-300) / q), 0.0), first)
    kept = np.repeat((total >= LEAST) & (gain >= GAIN + 2 * (kinds - 1)), size)
    total, kinds = np.repeat(total, size), np.repeat(kinds, size)
    q = np.where(kept, (count + kinds * q) / np.maximum(total + kinds, 1), q)
    out = np.empty(len(p))
    out[order] = q[pair]
    return out


class Shallow:
    """Probabilities after contexts of up to two symbols, from all (context, symbol, n) of two."""

    def __init__(self, table: pa.Table):
        context, symbol, n = (table.column(c).to_numpy().astype(I64) for c in ("context", "symbol", "n"))
        order = np.lexsort((symbol, context))
        context, symbol, n = context[order], symbol[order], n[order]
        self.key = (context << 8) | symbol
        p = np.full(len(n), 1 / SYMBOLS)
        for k in range(3):
            p = _sharper(context >> (8 * (2 - k)), symbol, n, p)
        self.p = p

    def __call__(self, gram: np.ndarray) -> np.ndarray:
        key = ((gram >> U64(8 * (DEPTH - 2))) & ~U64(255)) | (gram & U64(255))
        return self.p[np.searchsorted(self.key, key.astype(I64))]


def predicted(gram: np.ndarray, n: np.ndarray, shallow: Shallow) -> np.ndarray:
    """log10 of each gram's symbol after those before it; all grams that share three symbols are here, sorted."""
    p = shallow(gram)
    for k in range(3, DEPTH + 1):
        p = _sharper(gram >> U64(8 * (DEPTH + 1 - k)), gram & U64(255), n, p)
    return np.log10(p)


def predictions(grams: DataFrame) -> DataFrame:
    """(gram, p), written: log10 of the last symbol of each gram of grams (gram, n; each gram once, n may be 0)."""
    three = F.shiftrightunsigned("gram", 8 * (DEPTH - 2))
    low = written(grams.groupBy(F.shiftright(three, 8).alias("context"), F.col("gram").bitwiseAND(F.lit(255).cast("long")).alias("symbol")).agg(F.sum("n").alias("n")), "shallow")
    path = low._siftwork_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        fs, root = pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)
        shallow, held, size = None, [], 0

        def flush(some: list):
            nonlocal shallow
            if some:
                if shallow is None:
                    shallow = Shallow(ds.dataset(root, filesystem=fs, format="parquet").to_table())  # at most 2 ** 24 rows
                gram, n = (np.concatenate(x) for x in zip(*some))
                p = predicted(gram, n, shallow).astype(np.float32)
                yield from pa.Table.from_arrays([pa.array(gram.view(I64)), pa.array(p)], ["gram", "p"]).to_batches(max_chunksize=100_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            gram, n = batch.column(0).to_numpy().view(U64), batch.column(1).to_numpy()
            group = gram >> U64(8 * (DEPTH - 2))
            last = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if size + last >= _GROUP and (last or held and held[-1][0][-1] >> U64(8 * (DEPTH - 2)) != group[-1]):
                yield from flush([*held, (gram[:last], n[:last])] if last else held)
                held, size, gram, n = [], 0, gram[last:], n[last:]
            held.append((gram, n))
            size += len(gram)
        yield from flush(held)

    out = written(grams.select("gram", "n").repartition(three).sortWithinPartitions("gram").mapInArrow(run, "gram long, p float"), "predictions")
    forget(low)
    return out


class Slots:
    """Looks grams up in a block's table."""

    def __init__(self, gram: np.ndarray, p: np.ndarray):
        self.gram, self.p = gram, p
        self.place = np.zeros(1 << _SLOT_BITS, np.int32)
        self.place[self._slot(gram)] = np.arange(len(gram))

    @staticmethod
    def _slot(gram: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((gram.view(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - _SLOT_BITS)).astype(I64)

    def __call__(self, gram: np.ndarray) -> np.ndarray:
        at = self.place[self._slot(gram)]
        miss = np.flatnonzero(self.gram[at] != gram)
        at[miss] = np.searchsorted(self.gram, gram[miss])
        return self.p[at]


_OUT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def suffix_tree_scores(docs: DataFrame, learns) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    learns is a column over docs: whether a row teaches. Tokens are lower-cased (A-Z) words, then one end.
    base_score sums log10((c + 0.5) / (N + 0.5 * (V + 1))) with the counts of the rows that teach;
    score is the tree's log10 probability of the tokens. Null and empty texts are the end alone. A null in
    learns does not teach; with no row that teaches, counts are 0 and the tree is uniform. Repeated rows
    count, and are scored, each; an empty table gives an empty result. Other columns play no part.
    """
    spark = docs.sparkSession
    texts = blocked(small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learns.cast("boolean"), F.lit(False)).alias("learns")), "texts")
    blocks = count_blocks(texts)
    by_key = W.partitionBy("key")
    found = texts.mapInArrow(_word_counts, "block int, key long, n long").withColumn("total", F.sum("n").over(by_key)).withColumn("first", F.min("block").over(by_key) == F.col("block"))
    vocabulary = write_by_block(found.select("block", "key", "total", "first").distinct(), "vocabulary", blocks, "key")
    counted = spark.read.schema("key long, total long, first boolean").parquet(vocabulary.path).where("first").agg(F.sum("total").alias("n"), F.count_if(F.col("total") > 0).alias("v")).first()
    n_all, n_kinds = counted["n"] or 0, counted["v"] or 0
    tidy(spark)
    own = written(texts.mapInArrow(_gram_counts, "block int, gram long, n long"), "grams")
    counts = written(own.groupBy("gram").agg(F.sum("n").alias("n")), "counts")
    known = predictions(counts)
    forget(counts)
    tidy(spark)
    tree = write_by_block(own.select("block", "gram").distinct().join(known, "gram").select("block", "gram", "p"), "tree", blocks, "gram")
    forget(own, known)
    tidy(spark)
    under = np.log10(n_all + 0.5 * (n_kinds + 1))

    def run(batches):
        counts, grams, slots, now = Blocks(vocabulary, ["key", "total"], [I64, I64]), Blocks(tree, ["gram", "p"], [I64, np.float32]), None, None
        for block, batch in one_block(batches):
            keys, total = counts(block)
            if block != now:
                now, slots = block, Slots(*grams(block))
            for part, data, offsets in chunks([batch]):
                data, start, end, bounds = _read(data, offsets)
                code, first = spelled(data, start, end, bounds)
                score = np.add.reduceat(slots(code.view(I64)).astype(np.float64), first[:-1])
                key = np.append(_keys(data, start, end), END_KEY)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                c = np.where(keys[at] == key, total[at], 0)
                own = owners(bounds)
                n = np.diff(bounds) + 1
                seen = np.bincount(own, c[:-1] > 0, minlength=part.num_rows).astype(I64) + int(c[-1] > 0)
                base = np.bincount(own, np.log10(c[:-1] + 0.5), minlength=part.num_rows) + np.log10(c[-1] + 0.5) - n * under
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(seen), pa.array(base), pa.array(score)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return texts.select("doc_id", "text", "block").mapInArrow(run, _OUT).withColumn("train_tokens", F.lit(int(n_all)).cast("long"))


def op8_suffix_lm(spark, sf_dir: str) -> DataFrame:
    """All documents under a model of four fifths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(crc32_mod(F.col("doc_id"), 5) == 1, F.lit(True))
    return suffix_tree_scores(docs, ~held).select("doc_id", F.coalesce(crc32_mod(F.col("doc_id"), 5) == 1, F.lit(True)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
