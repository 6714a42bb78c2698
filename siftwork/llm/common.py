"""What the corpus operators share: written stages, and hashing of words in whole Arrow batches.

Text is handled as UTF-8 bytes in numpy arrays: all separators of the word rules are ASCII, so a
byte-wise scan finds the same words as one by code points, and one batch costs a few passes over
its bytes however many rows it has.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Bytes of text handled at once by the batch operators; a longer text makes a chunk of its own.
CHUNK = 1 << 20
#: Limits of an Arrow batch.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; only a local master may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "siftwork-shared")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/siftwork-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: computed once, lineage cut, safe when executors are lost."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siftwork_path = path
    return out


def forget(*tables: DataFrame | str) -> None:
    """Deletes tables of written(), or folders of the shared folder, that nothing reads any more."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "_siftwork_path", None)
        if path:
            fs, name = pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)
            fs.delete_dir(name)


def sweep(spark: SparkSession) -> None:
    """Deletes all tables of these operators in the shared folder; for when no result of theirs is read any more."""
    path = shared_dir(spark)
    fs, root = pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)
    for found in fs.get_file_info(pa.fs.FileSelector(root, allow_not_found=True)):
        if found.base_name.startswith("siftwork-") and not found.is_file:
            fs.delete_dir(found.path)


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of finished stages now, not when the driver next collects garbage."""
    import gc

    gc.collect()
    jvm = getattr(spark, "_jvm", None)  # there is none in a remote session
    if jvm is not None:
        jvm.System.gc()


def small_batches(df: DataFrame) -> DataFrame:
    """df, after lowering its session's limits on Arrow batches: ten thousand texts at once, in the JVM's and
    Python's buffers of every task, are more than small executors have room for."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_AT_ONCE)):
        now = conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df


def unused(name: str, *frames: DataFrame) -> str:
    """name, or a longer one that no column of the frames has (upper and lower case count as equal)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, element by element."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Of spans of data that follow each other: a number by content, and the contents by number."""
    spans = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    found = spans.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def digests(data: np.ndarray, offsets: np.ndarray, kind: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of spans of data that follow each other, in two halves; other kinds give other digests.

    Contents are told apart exactly first, so each is digested once however often it occurs.
    """
    code, contents = coded(data, offsets)
    each = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16, person=kind).digest() for x in contents.to_pylist()), U64).reshape(-1, 2)
    return each[code, 0], each[code, 1]


def packed(data: np.ndarray, start: np.ndarray, end: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that words() found by the same flags, one right after the other, and their offsets."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    return (data[kept[data]] if len(data) else data), offsets


_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word [start, end) of data.

    A word of up to 16 bytes is two numbers and a length, which are mixed as they are; longer ones are
    digested (XXH3). No sum or product runs along a word.
    """
    size = end - start
    lanes = np.ndarray(len(data) + 16, "<u8", np.concatenate((data, np.zeros(24, np.uint8))), 0, (1,))
    low = lanes[start] & _LOW_BYTES[np.minimum(size, 8)]
    high = lanes[start + 8 * (size > 8)] & _LOW_BYTES[np.clip(size - 8, 0, 8)]
    out = []
    with np.errstate(over="ignore"):
        for a, b in ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
            out.append(mix(mix(low ^ U64(a)) * U64(b) + mix(high + U64(b)) + size.astype(U64)))
    long = np.flatnonzero(size > 16)
    if len(long):
        each = b"".join(xxhash.xxh3_128_digest(data[i:j].tobytes()) for i, j in zip(start[long], end[long]))
        out[0][long], out[1][long] = np.frombuffer(each, U64).reshape(-1, 2).T
    return out[0], out[1]


def joined_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of what a stands for followed by what b stands for."""
    with np.errstate(over="ignore"):
        return mix(a * U64(0xD6E8FEB86659FD93) + b)


def windows(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of each run of width values, one for each start that has room.

    Runs of 1, 2, 4 ... values are joined pairwise, so a run costs a number of steps that grows as the
    logarithm of its width; no step is linear, so no sequence of words is known to collide.
    """
    n = len(h)
    if n < width:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        part = mix(h + U64(seed) * U64(0x9E3779B97F4A7C15))
    size, out, done = 1, None, 0
    while True:
        if width & size:
            out = part if out is None else joined_hash(out[: n - done - size + 1], part[done:])
            done += size
        if done == width:
            return out
        part = joined_hash(part[:-size], part[size:])
        size *= 2


def keeps(*gaps: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, false at the separator bytes in the given closed ranges."""
    out = np.ones(256, bool)
    for lo, hi in gaps:
        out[lo : hi + 1] = False
    return out


#: Bytes of words `[^\\x20\\x09-\\x0D]+`.
SPACED = keeps((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a lower-cased text.
ALNUM = keeps((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32, len(col) + 1, col.offset * (8 if wide else 4)).astype(np.int64)
    data = col.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about size bytes of text: (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def words(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of kept bytes within each text: (start, end, first word of each text and the number of all)."""
    inside = kept[data] if len(data) else np.empty(0, bool)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1] - 1
    cut = cut[cut >= 0]
    last[cut] = inside[cut]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def owners(bounds: np.ndarray) -> np.ndarray:
    """Of each word the number of its text, from the third result of words()."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def crc32_mod(column, mod: int):
    """crc32(the column as text) mod `mod`, as a Spark column; null counts as remainder null."""
    from pyspark.sql import functions as F

    return F.crc32(column.cast("string").cast("binary")) % F.lit(mod)
