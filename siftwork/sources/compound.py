"""Streams of compound files (the container of older mail and word-processor documents)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
_END = 0xFFFFFFFC


class Broken(ValueError):
    """The container cannot be read."""


def streams(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, contents) of each stream, in the order of the directory. Broken if this is no such container."""
    if data[:8] != MAGIC or len(data) < 512:
        raise Broken("no compound file")
    shift, small_shift = struct.unpack_from("<HH", data, 30)
    n_fat, first_dir, _, cutoff, first_small, n_small, first_difat, n_difat = struct.unpack_from("<8I", data, 44)
    if shift not in (9, 12) or small_shift > shift:
        raise Broken("sector sizes are wrong")
    size = 1 << shift
    limit = len(data) // size + 1

    def sector(i: int) -> bytes:
        return data[(i + 1) * size : (i + 2) * size]

    def numbers(raw: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))

    places = list(struct.unpack_from("<109I", data, 76))
    at = first_difat
    for _ in range(min(n_difat, limit)):
        if at >= _END:
            break
        more = numbers(sector(at))
        if not more:
            break
        places, at = places + more[:-1], more[-1]
    fat: list[int] = []
    for p in [p for p in places if p < _END][:n_fat]:
        fat += numbers(sector(p))

    def chain(start: int, table: list[int]) -> Iterator[int]:
        for _ in range(len(table) + 1):
            if start >= len(table):
                return
            yield start
            start = table[start]
        raise Broken("a chain has no end")

    def contents(start: int) -> bytes:
        return b"".join(sector(i) for i in chain(start, fat))

    directory = contents(first_dir)
    small_fat = numbers(contents(first_small)) if n_small and first_small < _END else []
    entries = []
    for k in range(0, len(directory) - 127, 128):
        length, kind = struct.unpack_from("<HB", directory, k + 64)
        start, low = struct.unpack_from("<II", directory, k + 116)
        entries.append((directory[k : k + max(0, min(length, 64) - 2)].decode("utf-16-le", "replace"), kind, start, low))
    root = next((e for e in entries if e[1] == 5), None)
    mini = contents(root[2]) if root and root[2] < _END else b""
    tiny = 1 << small_shift
    for name, kind, start, n in entries:
        if kind != 2:
            continue
        if n < cutoff:
            yield name, b"".join(mini[i * tiny : (i + 1) * tiny] for i in chain(start, small_fat))[:n]
        else:
            yield name, contents(start)[:n]
