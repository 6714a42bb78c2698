"""WARC archives: writing pages with revisit records, and reading archives that may be damaged.

Archives are written one per task into the shared folder, each record its own gzip member; a
manifest table lists the files of the attempts that counted. The reader checks each record (gzip
checksum, version line, length, end mark, block and payload digest). Where a check fails it looks
for the next gzip member, or the next version line, from which a record can be read again, goes on
from there, and reports the bytes between as a quarantined gap with the reason. A gzip member is
inflated once to see if it is whole and once more for its records, so no more than a record of it is
held. Of a damaged member those records are kept that can still be inflated and that their own block
digest proves; gaps inside a member have the places in its inflated bytes too.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork.llm.common import new_path, small_batches, written

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Revisits that may be sent to every task (about 60 bytes each).
BROADCAST_REVISITS = 100_000
_READ = 1 << 18
_SLICE = 1 << 14
#: Bytes in which a record's headers must end.
HEADERS = 1 << 24
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_MAGIC = b"\x1f\x8b\x08"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_MARK = 8


def digest(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, html: str | None, refers_to: int | None, date: str) -> bytes:
    """One WARC record, not compressed; a revisit has the HTTP head alone."""
    payload = (html or "").encode()
    name = digest(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{name}", f"WARC-Block-Digest: sha1:{name if not head else digest(block)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """data as one gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Item:
    """A record (gap is empty) or a quarantined gap, at bytes [start, end) of the archive.

    Of what a gzip member holds, inner is the range in the member's inflated bytes.
    """

    start: int
    end: int
    gap: str = ""
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    inner: tuple[int, int] | None = None


class _Bad(Exception):
    pass


class _File:
    """Reads at places of a seekable file, a piece at a time."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.piece = f, size, 0, b""

    def piece_at(self, at: int, least: int = 1) -> memoryview:
        """Bytes from at on, at least so many; fewer only at the end of the file."""
        if not self.at <= at <= self.at + len(self.piece) - min(least, self.size - at):
            self.f.seek(at)
            self.at, self.piece = at, self.f.read(_READ)
        return memoryview(self.piece)[at - self.at :]

    def next_start(self, at: int) -> int:
        """The first place from at on where a member or a version line may begin, or the size of the file."""
        while at < self.size:
            piece = self.piece_at(at, _MARK)
            if m := _START.search(piece):
                return at + m.start()
            if at + len(piece) >= self.size:
                break
            at += max(1, len(piece) - _MARK + 1)
        return self.size


def _deflated(f: _File, at: int) -> int:
    """Where the compressed bytes of the gzip member at a place begin."""
    head = bytes(f.piece_at(at, 1 << 16)[: 1 << 16])
    if len(head) < 10 or head[3] & 0xE0:
        raise _Bad("gzip header is wrong")
    n = 10
    if head[3] & 4:
        n += 2 + int.from_bytes(head[n : n + 2], "little")
    for flag in (8, 16):
        if head[3] & flag:
            n = head.find(b"\0", n) + 1 or len(head) + 1
    n += 2 * bool(head[3] & 2)
    if n > len(head):
        raise _Bad("gzip header is wrong")
    return at + n


def inflated(f: _File, at: int, step: int = _READ) -> Iterator[tuple[bytes, int]]:
    """Pieces of the gzip member at a place, and where in the file the reading is; _Bad where it is damaged.

    No piece is longer than step; of damaged data all is given but the last step's worth.
    """
    at, z, crc, size = _deflated(f, at), zlib.decompressobj(-15), 0, 0
    while not z.eof:
        piece = f.piece_at(at)[:_SLICE]
        if not piece:
            raise _Bad("gzip member is cut off")
        at += len(piece)
        while not z.eof and (piece or out):
            try:
                out = z.decompress(piece, step)
            except zlib.error as e:
                raise _Bad("gzip: " + str(e).split(":")[0]) from None
            piece, crc, size = z.unconsumed_tail, zlib.crc32(out, crc), size + len(out)
            yield out, at - len(piece) - len(z.unused_data)
    at -= len(z.unused_data)
    tail = bytes(f.piece_at(at, 8)[:8])
    if tail != crc.to_bytes(4, "little") + (size & 0xFFFFFFFF).to_bytes(4, "little"):
        raise _Bad("gzip member is cut off" if len(tail) < 8 else "gzip checksum is wrong")
    yield b"", at + 8


class _Buffer:
    """Bytes of pieces from a place on, as far as they were asked for. The pieces may break off."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.data, self.at, self.ended = pieces, b"", 0, ""

    def more(self) -> bool:
        if self.ended:
            return False
        try:
            self.data += next(self.pieces)
            return True
        except StopIteration:
            self.ended = "it ends here"
        except _Bad as e:
            self.ended = str(e)
        return False

    def need(self, n: int) -> bool:
        if len(self.data) < n and not self.ended:
            held = [self.data]
            size = len(self.data)
            while size < n and not self.ended:
                self.data = b""
                self.more()
                held.append(self.data)
                size += len(self.data)
            self.data = b"".join(held)
        return len(self.data) >= n

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _headers(buffer: _Buffer) -> tuple[dict[str, str], int]:
    """Headers of the record at the buffer's place, and their length with the empty line."""
    buffer.need(10)
    m = _VERSION.match(buffer.data)
    if not m:
        raise _Bad("no version line")
    seen = m.end() - 2
    while (end := buffer.data.find(b"\r\n\r\n", seen)) < 0:
        seen = max(seen, len(buffer.data) - 3)
        if len(buffer.data) > HEADERS or not buffer.more():
            raise _Bad("headers do not end")
    headers = {}
    for line in buffer.data[m.end() : end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            headers[name.strip().lower()] = value.strip()
    if not re.fullmatch(r"\d{1,15}", headers.get("content-length", "")):
        raise _Bad("no content length")
    return headers, end + 4


def _record(buffer: _Buffer, limit: int, proved: bool) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and length of the record at the buffer's place; _Bad if a check fails.

    limit is what the source can still have, if that is known. proved: only what its block digest proves.
    """
    headers, start = _headers(buffer)
    stop = start + int(headers["content-length"])
    if stop + 4 > limit or not buffer.need(stop + 4):
        raise _Bad("block is cut off")
    if buffer.data[stop : stop + 4] != b"\r\n\r\n":
        raise _Bad("block length is wrong")
    block = buffer.data[start:stop]
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha1:"):
        if want[5:] != digest(block):
            raise _Bad("block digest is wrong")
    elif proved:
        raise _Bad("no digest proves it")
    if headers.get("warc-type") == "response" and headers.get("content-type", "").startswith("application/http"):
        want = headers.get("warc-payload-digest", "")
        if want.startswith("sha1:") and want[5:] != digest(block.partition(b"\r\n\r\n")[2]):
            raise _Bad("payload digest is wrong")
    return headers, block, stop + 4


def _member(f: _File, at: int) -> tuple[int, str]:
    """Where the gzip member at a place ends, or where it breaks off and why."""
    to = at
    try:
        for _, to in inflated(f, at):
            pass
        return to, ""
    except _Bad as e:
        return to, str(e)


def _within(f: _File, at: int, end: int, proved: bool) -> Iterator[Item]:
    """Records of the gzip member at [at, end), and gaps between them."""
    buffer, bad = _Buffer(x for x, _ in inflated(f, at, 256 if proved else _READ)), None
    while buffer.need(1):
        try:
            headers, block, size = _record(buffer, 1 << 62, proved)
        except _Bad as e:
            bad = bad or (buffer.at, str(e))
            buffer.drop(1)
            while not (m := _VERSION.search(buffer.data)):
                buffer.drop(max(0, len(buffer.data) - 9))
                if not buffer.more():
                    buffer.drop(len(buffer.data))
                    break
            else:
                buffer.drop(m.start())
            continue
        if bad:
            yield Item(at, end, bad[1], inner=(bad[0], buffer.at))
            bad = None
        yield Item(at, end, headers=headers, block=block, inner=(buffer.at, buffer.at + size))
        buffer.drop(size)
    if bad:
        yield Item(at, end, bad[1], inner=(bad[0], buffer.at))


def salvage(handle, size: int) -> Iterator[Item]:
    """All records of an archive that can be read, in order, and the gaps between them.

    What a damaged member lost after its last record has an inner range that ends at -1: how long it was is
    not known. Gaps that follow each other are one.
    """
    f, at, bad = _File(handle, size), 0, None

    def plain(start: int) -> Iterator[bytes]:
        while piece := f.piece_at(start)[:_SLICE]:
            yield bytes(piece)
            start += len(piece)

    def gap(to: int) -> Iterator[Item]:
        nonlocal bad
        if bad is not None and to > bad[0]:
            yield Item(bad[0], to, bad[1], inner=bad[2])
        bad = None

    while at < size:
        if f.piece_at(at, len(_MAGIC))[:3] == _MAGIC:
            end, why = _member(f, at)
            if not why:
                yield from gap(at)
                yield from _within(f, at, end, False)
                at = end
                continue
            past = 0
            for x in _within(f, at, end, True):
                if x.gap:
                    continue
                if not past:
                    yield from gap(at)
                if x.inner[0] > past:
                    yield Item(at, end, why, inner=(past, x.inner[0]))
                yield x
                past = x.inner[1]
            bad = (at, why, (past, -1)) if past else bad or (at, why, None)
        else:
            try:
                headers, block, n = _record(_Buffer(plain(at)), size - at, False)
            except _Bad as e:
                bad = bad or (at, str(e), None)
            else:
                yield from gap(at)
                yield Item(at, at + n, headers=headers, block=block)
                at += n
                continue
        at = f.next_start(at + 1)
    yield from gap(size)


def write_archives(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes pages (page_id, url, html, refers_to) as archives; the manifest (path, bytes, records).

    Rows with refers_to become revisit records of that page, others responses. A null html is empty. Repeated
    rows get a record each; an empty table gives no archive. Other columns of pages play no part.
    """
    spark = pages.sparkSession
    base = new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, size = None, 0, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None:
                    fs, root = pa.fs.FileSystem.from_uri(base)
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                data = member(record("response" if refers_to is None else "revisit", page_id, url, html, refers_to, date))
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{base}/{name}"], "bytes": [size], "records": [n]})

    return written(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, bytes long, records long"), "manifest")


_OUT = "path string, start long, stop long, inner_start long, inner_stop long, gap string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives in manifest (path), each path once; gap is null for a record.

    start and stop are places in the archive, inner_start and inner_stop those in a gzip member's inflated
    bytes (null outside one; -1 where the end is not known). An empty manifest gives no rows.

    payload is null unless payloads is set; for a revisit it is always null, its digest is the
    record's own statement and its length that of the HTTP head. A file that cannot be opened is a gap.
    """

    def number(x: str | None) -> int | None:
        m = re.fullmatch(r"<urn:x-page:(-?\d+)>", x or "")
        return int(m[1]) if m else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in _OUT.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

        def table(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                try:
                    fs, name = pa.fs.FileSystem.from_uri(path)
                    handle = fs.open_input_file(name)
                except (OSError, pa.ArrowInvalid) as e:
                    yield table([(path, 0, 0, None, None, f"cannot be opened: {type(e).__name__}", *[None] * 7)])
                    continue
                with handle:
                    for x in salvage(handle, handle.size()):
                        if x.gap:
                            rows.append((path, x.start, x.end, *(x.inner or (None, None)), x.gap, *[None] * 7))
                        else:
                            h = x.headers
                            head, _, payload = x.block.partition(b"\r\n\r\n")
                            kind = h.get("warc-type")
                            stated = re.search(rb"(?i)\r\ncontent-length:\s*(\d{1,15})", head)
                            revisit = kind == "revisit"
                            n = int(stated[1]) if revisit and stated else len(payload)
                            of = h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest(payload)
                            keep = payload if payloads and not revisit else None
                            rows.append((path, x.start, x.end, *(x.inner or (None, None)), None, kind, number(h.get("warc-record-id")), h.get("warc-target-uri"), of, n, number(h.get("warc-refers-to")), keep))
                            held += len(keep or b"")
                        if len(rows) >= 2000 or held > 1 << 24:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    files = manifest.select("path").distinct()
    n = files.count()
    numbered = files.withColumn("n", (F.row_number().over(W.orderBy("path")) - 1).cast("int"))  # a row a file, no contents
    return numbered.repartitionById(max(1, n), "n").select("path").mapInArrow(run, _OUT)


def archive(pages: DataFrame, least_bytes: int = 0, broadcast_revisits: int = BROADCAST_REVISITS) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC archives with one response per payload; the manifest.

    Of records with equal payloads of at least least_bytes bytes the one with the largest page_id is the
    response, others revisit it; rows that repeat that page_id are responses too, and so is a row
    without page_id. A null html is an empty payload, a null url is left out. Other columns of pages play
    no part; an empty table gives an empty manifest.
    """
    rows = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    named = rows.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= least_bytes)).select("page_id", F.sha1(F.col("html").cast("binary")).alias("name"))
    first = named.groupBy("name").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("lo")).where("lo < refers_to").select("name", "refers_to")
    revisits = written(named.join(first, "name").where("page_id < refers_to").select("page_id", "name", "refers_to"), "revisits")
    few = revisits.limit(broadcast_revisits + 1).count() <= broadcast_revisits
    joined = rows.withColumn("name", F.sha1(F.col("html").cast("binary"))).join(F.broadcast(revisits.distinct()) if few else revisits.distinct(), ["page_id", "name"], "left")
    return write_archives(joined)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Pages through WARC archives and back."""
    manifest = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(manifest, payloads=False).where("gap is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, max(page_id) AS m FROM p GROUP BY 1)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM p JOIN f USING (h)
"""
