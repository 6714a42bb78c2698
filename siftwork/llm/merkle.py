"""Document fingerprints: Merkle trees over phrases, paragraphs and sections.

Leaves are phrases: runs of words that end after a word whose digest is a multiple of 3, or with the
line. Phrases make paragraphs (lines), paragraphs make sections (a section ends after a paragraph
whose digest is a multiple of 4), sections make the root. All cuts follow from the content near them,
so an edit changes the branches above it and leaves the others as they were. A node's hash is a
128-bit BLAKE2b digest of its text (leaves) or of its children's digests in order.

A fingerprint is text: the root, then for each level below it the least node hashes (40 bits each, in
hex), at most KEPT of a level, so its length has a bound however long the text is. Equal roots are
equal texts. Otherwise the likeness is that of the levels' node sets, which the kept hashes tell
exactly for small trees and as a sample for others. Whole trees, needed to find where two texts
differ, are made from the texts: edits() goes down from both roots into differing branches only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import CHUNK, SPACED, digests, owners, small_batches, text_bytes, word_hashes, words

#: Node hashes that a fingerprint keeps of sections, paragraphs and phrases.
KEPT = (8, 16, 64)
_HEX = 10


@dataclass
class Trees:
    """The trees of many texts.

    levels has, for sections, paragraphs and phrases, all nodes' digests (two halves) and where each
    text's begin; within has where each section's paragraphs and each paragraph's phrases begin; starts
    has the first byte of each phrase.
    """

    root: list[str]
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    within: list[np.ndarray]
    starts: np.ndarray

    def text(self) -> list[str]:
        """The fingerprints."""
        kept = [_least(*level, n) for level, n in zip(self.levels, KEPT)]
        return [":".join((r, *(k[i] for k in kept))) for i, r in enumerate(self.root)]


def _least(h: np.ndarray, _: np.ndarray, at: np.ndarray, n: int) -> list[str]:
    """Of each text the n least distinct hashes of a level, ascending, in hex."""
    key = h >> np.uint64(24)
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own = key[fresh], own[fresh]
    first = np.searchsorted(own, np.arange(len(at)))
    few = np.arange(len(key)) - first[own] < n
    key, own = key[few], own[few]
    raw = key.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()
    to = np.searchsorted(own, np.arange(len(at))) * _HEX
    return [raw[a:b] for a, b in zip(to, to[1:])]


def trees(texts: list[str]) -> Trees:
    data, offsets = text_bytes(pa.array(texts, pa.large_string()))
    start, end, bounds = words(data, offsets, SPACED)
    own = owners(bounds)
    cut = np.zeros(len(data) + 1, bool)
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    begins[np.flatnonzero(data == 10) + 1] = True
    h, _ = word_hashes(data, start, end)
    after = np.flatnonzero((h[:-1] % np.uint64(3) == 0) & (own[1:] == own[:-1])) + 1
    cut[start[after]] = True
    cut |= begins
    first = np.flatnonzero(cut[: len(data)])
    leaf = digests(data, np.append(first, len(data)), b"phrase")
    leaf_at = np.searchsorted(first, offsets)

    def above(nodes: tuple[np.ndarray, np.ndarray], at: np.ndarray, name: bytes) -> tuple[np.ndarray, np.ndarray]:
        return digests(np.stack(nodes, axis=1).view(np.uint8).ravel(), 16 * at, name)

    p_at = np.append(np.flatnonzero(begins[first]), len(first))
    para = above(leaf, p_at, b"paragraph")
    para_at = np.searchsorted(p_at[:-1], leaf_at)
    s_begins = np.zeros(len(p_at), bool)
    s_begins[para_at] = True
    s_begins[1:] |= para[0] % np.uint64(4) == 0
    s_at = np.append(np.flatnonzero(s_begins[:-1]), len(p_at) - 1)
    sect = above(para, s_at, b"section")
    sect_at = np.searchsorted(s_at[:-1], para_at)
    root = np.stack(above(sect, sect_at, b"root"), axis=1).tobytes().hex()
    levels = [(*sect, sect_at), (*para, para_at), (*leaf, leaf_at)]
    return Trees([root[32 * i : 32 * i + 32] for i in range(len(texts))], levels, [s_at, p_at], np.append(first, len(data)))


def _shared(a: str, b: str, n: int) -> float:
    """The share of two sets that is in both (Dice), from the n least members of each."""
    x, y = ({s[k : k + _HEX] for k in range(0, len(s), _HEX)} for s in (a, b))
    union = x | y
    if len(x) >= n or len(y) >= n:  # what lies beyond a full list's end is not known
        union = set(sorted(union)[:n])
    j = len(union & x & y) / max(len(union), 1)
    return 2 * j / (1 + j)


def compare(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1; 1 exactly where the roots are equal.

    The mean of the levels' likeness. A level at which neither text has a second node says no more than
    the roots and does not count; the phrases always do.
    """
    x, y = a.split(":"), b.split(":")
    if x[0] == y[0]:
        return 1.0
    each = [_shared(p, q, n) for p, q, n in zip(x[1:], y[1:], KEPT) if n == KEPT[-1] or max(len(p), len(q)) > _HEX]
    return min(sum(each) / len(each), 0.999)


def edits(before: str, after: str) -> list[tuple[int, int, int, int]]:
    """Where two texts differ: (start, end) in before, (start, end) in after, code points, in order.

    Phrases are the finest unit. An insertion has start = end in before, a deletion in after; a moved
    paragraph is one of each. Equal texts give nothing.
    """
    t = trees([before, after])
    if t.root[0] == t.root[1]:
        return []
    names = [list(zip(a.tolist(), b.tolist())) for a, b, _ in t.levels]
    out: list[tuple[int, int, int, int]] = []

    def descend(level: int, a: int, b: int, c: int, d: int) -> None:
        """Nodes [a, b) of before and [c, d) of after, at a level."""
        while a < b and c < d and names[level][a] == names[level][c]:
            a, c = a + 1, c + 1
        while a < b and c < d and names[level][b - 1] == names[level][d - 1]:
            b, d = b - 1, d - 1
        if a == b and c == d:
            return
        if a == b or c == d:
            down = [a, b, c, d]
            for k in range(level, 2):
                down = [int(t.within[k][x]) for x in down]
            out.append(tuple(int(t.starts[x]) for x in down))
            return
        for tag, i, j, k, m in SequenceMatcher(None, names[level][a:b], names[level][c:d], autojunk=False).get_opcodes():
            if tag == "equal":
                continue
            if level == 2:
                out.append(tuple(int(t.starts[x]) for x in (a + i, a + j, c + k, c + m)))
            else:
                descend(level + 1, *(int(t.within[level][x]) for x in (a + i, a + j, c + k, c + m)))

    at = t.levels[0][2]
    descend(0, int(at[0]), int(at[1]), int(at[1]), int(at[2]))
    data, offsets = text_bytes(pa.array([before, after], pa.large_string()))
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    shift = int(points[offsets[1]])
    return [(*(int(points[x]) for x in span[:2]), *(int(points[x]) - shift for x in span[2:])) for span in out]


def locate_edits(pairs: DataFrame) -> DataFrame:
    """Per row of pairs (id, before, after) and differing place: id, start, end, new_start, new_end.

    Places are those of edits(). Null texts are empty. Rows with equal texts give no row, repeated rows
    give theirs each; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = edits(a or "", b or "")
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*found))], ["id", "start", "end", "new_start", "new_end"])

    return pairs.select(F.col("id").cast("long").alias("id"), F.col("before").cast("string").alias("before"), F.col("after").cast("string").alias("after")).mapInArrow(run, "id long, start long, end long, new_start long, new_end long")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs' doc_id and the fingerprint of its text (null: as the empty text), row by row.

    Equal texts, repeated rows among them, have equal fingerprints. Other columns of docs play no part. An
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(trees([x or "" for x in part.column(1).to_pylist()]).text())], ["doc_id", "fingerprint"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


_OUT = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Results for all but the last text; each one's next is the text after it."""
    n = len(ids)
    edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for t, nxt in zip(texts, texts[1:])]
    own, other = trees(texts).text(), trees(edited).text()
    near = [[compare(a, b) for a, b in zip(own, x)] for x in (other, own[1:])]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array(edited, pa.string()), pa.array(own[:n], pa.string()), pa.array(other, pa.string()), *(pa.array(x, pa.float64()) for x in near)],
        ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (guest, doc_id, text) of one range, sorted so; the first guest is the text after the range's last row."""
    ids: list = []
    texts: list[str] = []
    size, closed = 0, False
    for batch in batches:
        for guest, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            text = text or ""
            if doc is None:
                yield _pairs([None], [text, text])
            elif not guest:
                ids.append(doc)
                texts.append(text)
                size += len(text)
                if size > CHUNK and len(ids) > 1:
                    yield _pairs(ids[:-1], texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
            elif not closed:
                closed = True
                yield _pairs(ids, [*texts, text])
                ids, texts, size = [], [], 0


def _range(value: Column, cuts: list[int], first: int = 0) -> Column:
    """The number of cuts below value, found by halving."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(value <= cuts[mid], _range(value, cuts[:mid], first)).otherwise(_range(value, cuts[mid + 1 :], first + mid + 1))


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Per row of docs: its fingerprint, that of an edited text, and two likenesses.

    The edit replaces the last floor(n_chars / 2) code points by the first as many, or all, of the next
    document's in the order of doc_id, then text (after the last comes the first). Null texts are
    empty. A row without doc_id has no place in the order and is its own next. Other columns of docs play
    no part. An empty table gives an empty result.

    The order is made by ranges of doc_id with about equally many rows, one task each; each range also
    gets the first row of the next one, so no task sees more than its range and no window spans the table.
    """
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0] or []))
    anywhere = F.pmod(F.xxhash64("text"), F.lit(len(cuts) + 1)).cast("int")
    placed = rows.withColumn("part", F.when(F.col("doc_id").isNull(), anywhere).otherwise(_range(F.col("doc_id"), cuts)))
    firsts = sorted((r["part"], r["first"]) for r in placed.where("doc_id is not null").groupBy("part").agg(F.min("doc_id").alias("first")).collect())  # one row a range
    before = spark.createDataFrame([(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)], "doc_id long, to int")
    guests = F.broadcast(before)  # at most spark.sql.shuffle.partitions rows
    own = F.struct(F.col("part"), F.lit(False).alias("guest"))
    both = placed.join(guests, "doc_id", "left").select(F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to").alias("part"), F.lit(True).alias("guest"))))).alias("x"), "doc_id", "text")
    return both.select("x.part", "x.guest", "doc_id", "text").repartitionById(len(cuts) + 1, "part").sortWithinPartitions("guest", "doc_id", "text").select("guest", "doc_id", "text").mapInArrow(_in_order, _OUT)


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of their edited texts."""
    found = edit_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited_text"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
