"""Predicates on paths: types, scopes, and the checks of a query's own paths."""

from __future__ import annotations

import posixpath
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions.patterns import glob
from siftwork.sources.filetypes import BINARY, SKIPPED_FOLDERS

_NOT_IN_FOLDERS = "*?[]{}|;&$`><\n\r"
_NOT_IN_SCOPES = "[]{}|;&$`><\n\r()^+\\"


def start_folder(raw: str) -> str:
    """A start folder in its shortest form; ValueError for an empty one or one with wild cards or shell characters."""
    if not raw:
        raise ValueError("--startdir: the path is empty")
    for c in _NOT_IN_FOLDERS:
        if c in raw:
            raise ValueError(f"--startdir: {c!r} is not allowed in a path")
    clean = posixpath.normpath(raw)
    return "/" + clean.lstrip("/") if clean.startswith("//") else clean


def path_scope(raw: str) -> list[str] | None:
    """Comma-separated path patterns; None where there are none; ValueError for anything but `*` and `?` as wild cards."""
    parts = [p.strip() for p in raw.split(",") if p.strip()]
    for p in parts:
        for c in _NOT_IN_SCOPES:
            if c in p:
                raise ValueError(f"--pathscope: {c!r} is not allowed in {p!r}; wild cards are * and ?")
    return parts or None


def extension(path: Column) -> Column:
    """The last name's part after its last dot, with the dot, as written; empty without one."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def in_scope(relative: Column, scope: list[str] | None) -> Column:
    """Whether a path below the start folder matches one of the patterns; no patterns match all.

    A pattern is for the whole path. One without wild cards also stands for all below it.
    """
    if not scope:
        return F.lit(True)
    tests = [relative.rlike(glob(p)) for p in scope]
    for p in scope:
        stem = p.rstrip("/")
        if stem and not set("*?") & set(p):
            tests.append((relative == stem) | relative.startswith(stem + "/"))
    return reduce(lambda a, b: a | b, tests)


def may_lead_to(folder: str, scope: list[str] | None) -> bool:
    """Whether a folder below the start folder can hold paths in scope; any wild card may lead anywhere."""
    if not scope or folder in ("", "."):
        return True
    for p in scope:
        stem = p.rstrip("/")
        if set("*?") & set(p) or stem and (folder == stem or folder.startswith(stem + "/") or stem.startswith(folder + "/")):
            return True
    return False


def in_skipped_folder(path: Column) -> Column:
    """Whether one of the folders of a path is never searched."""
    names = F.split(path, "/")
    return F.arrays_overlap(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), F.array(*map(F.lit, sorted(SKIPPED_FOLDERS))))


def of_types(ext: Column, types: list[str] | None) -> Column:
    """Whether an extension, in any case, is one of types (without dots); no types mean all."""
    return F.lower(ext).isin(["." + t for t in types]) if types else F.lit(True)


def of_excluded_types(ext: Column, excluded: list[str]) -> Column:
    """Whether an extension is one of those excluded (with dots), in exactly the case given."""
    return ext.isin(excluded) if excluded else F.lit(False)


def is_binary(ext: Column) -> Column:
    """Whether a text must be extracted before it can be read."""
    return F.lower(ext).isin(["." + t for t in sorted(BINARY)])
