"""A folder of documents as a table.

The driver walks the tree once, leaving out folders that no search enters or that the scope rules
out, and hands files on in groups of about equal bytes; tasks read them, up to the cap of their size.
Spark's own file source hides names with a leading dot or underscore and cannot leave out folders by
name. The folder must be one that all executors see.
"""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from siftwork.functions.patterns import glob
from siftwork.operators.paths import may_lead_to
from siftwork.sources.filetypes import SKIPPED_FOLDERS, searched

SCHEMA = "path string, relative string, ext string, size bigint, content binary"
GROUP_BYTES, GROUP_FILES = 64 << 20, 2000
_MIB = 1 << 20


def capped(size: int) -> int:
    """Bytes that are read of a file of a size."""
    return 10 * _MIB if size > 50 * _MIB else 5 * _MIB if size > 10 * _MIB else size


def listed(root: str, types: list[str] | None, scope: list[str] | None) -> Iterator[tuple[str, str, int]]:
    """(path, path below root, size) of the files of a search; folders that cannot be read are passed over."""
    root = os.path.abspath(root or ".")
    wanted = {"." + t.lower() for t in types or ()}
    patterns = [re.compile(glob(p)) for p in scope or ()]
    stems = [p.rstrip("/") for p in scope or () if p.rstrip("/") and not set("*?") & set(p)]
    for folder, folders, names in os.walk(root):
        below = os.path.relpath(folder, root).replace(os.sep, "/")
        at = "" if below == "." else below + "/"
        folders[:] = sorted(d for d in folders if d not in SKIPPED_FOLDERS and may_lead_to(at + d, scope))
        for name in sorted(names):
            path = at + name
            if wanted and posixpath.splitext("x" + name)[1].lower() not in wanted:
                continue
            if scope and not any(p.match(path) for p in patterns) and not any(path == s or path.startswith(s + "/") for s in stems):
                continue
            try:
                yield os.path.join(folder, name), path, os.path.getsize(os.path.join(folder, name))
            except OSError:
                continue


@dataclass
class Files(InputPartition):
    files: list[tuple[str, str, int]]


class DocTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path", ".")
        self.types = [t for t in options.get("types", "").split(",") if t] or None
        self.scope = [p for p in options.get("scope", "").split("\x1f") if p] or None
        self.content = options.get("content", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        out, group, held = [], [], 0
        for item in listed(self.root, self.types, self.scope):
            group.append(item)
            held += capped(item[2])
            if held >= GROUP_BYTES or len(group) >= GROUP_FILES:
                out.append(Files(group))
                group, held = [], 0
        return [*out, Files(group)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, below, size in partition.files:
            content = None
            if self.content:
                try:
                    with open(path, "rb") as f:
                        content = f.read(capped(size))
                except OSError:
                    continue
            name = below.rpartition("/")[2]
            yield path, below, name[name.rfind(".") :] if "." in name else "", size, content


class DocTree(DataSource):
    """Options: path, types (comma-separated), scope (patterns, separated by the character 31), content (false: no bytes)."""

    @classmethod
    def name(cls) -> str:
        return "doctree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return DocTreeReader(self.options)


def files(spark: SparkSession, root: str = "", types: list[str] | None = None, scope: list[str] | None = None, content: bool = True) -> DataFrame:
    """The files of a search: path, relative, ext (as written, with its dot), size, content (as far as it is read)."""
    spark.dataSource.register(DocTree)
    return spark.read.format("doctree").options(types=",".join(types or ()), scope="\x1f".join(scope or ()), content=str(content).lower()).load(root or ".")


def count_files(spark: SparkSession, root: str = "", types: list[str] | None = None, scope: list[str] | None = None) -> int:
    """How many files a search would look at; their bytes are not read."""
    return files(spark, root, types or searched(), scope, content=False).count()
