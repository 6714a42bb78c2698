"""Corpus blocks: a written copy of the texts in numbered blocks, and tables that are read by block.

Statistics over all documents come back to the text that needs them without shuffling text and
without broadcasting: each block's distinct keys go through one exchange by key, what they get
there returns in one file per block, and the task that scans a block opens that file by its name. A key held
by a third of all documents sends one row per block, not one per document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import new_path, written


def blocked(docs: DataFrame, what: str, name: str = "block") -> DataFrame:
    """docs with a last column block (the number of the partition that held the row), written."""
    return written(docs.withColumn(name, F.spark_partition_id()), what)


def count_blocks(texts: DataFrame, name: str = "block") -> int:
    return (texts.agg(F.max(name)).first()[0] or 0) + 1


@dataclass
class ByBlock:
    """A folder of one file a block; what Spark puts after the file's number is the same for all."""

    path: str
    ending: str

    def read(self, block: int) -> pa.Table | None:
        """The rows of one block, in the order they were written; None if there are none."""
        fs, root = pa.fs.FileSystem.from_uri(self.path) if "://" in self.path else (pa.fs.LocalFileSystem(), self.path)
        name = f"{root}/part-{block:05d}{self.ending}"
        if not self.ending or fs.get_file_info(name).type != pa.fs.FileType.File:
            return None
        return pq.ParquetFile(fs.open_input_file(name)).read()


def write_by_block(df: DataFrame, what: str, blocks: int, *order: str) -> ByBlock:
    """Writes df (with a column block below blocks), one task and one file a block, sorted by order."""
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    df.repartitionById(blocks, F.col("block").cast("int")).sortWithinPartitions(*order).write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(path)
    fs, root = pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)
    names = [f.base_name for f in fs.get_file_info(pa.fs.FileSelector(root)) if f.base_name.startswith("part-")]
    return ByBlock(path, "-" + names[0].split("-", 2)[2] if names else "")


class Blocks:
    """Keeps the arrays of the block read last."""

    def __init__(self, table: ByBlock, columns: list[str], types: list):
        self.table, self.columns, self.types, self.block, self.arrays = table, columns, types, None, []

    def __call__(self, block: int) -> list[np.ndarray]:
        if block != self.block:
            t = self.table.read(block)
            self.arrays = [np.empty(0, k) if t is None else t.column(c).to_numpy().astype(k, copy=False) for c, k in zip(self.columns, self.types, strict=True)]
            order = np.argsort(self.arrays[0], kind="stable")
            self.arrays = [x[order] for x in self.arrays]
            self.block = block
        return self.arrays


def one_block(batches, name: str = "block"):
    """Batches cut where the column block changes: (block, batch)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(batch.schema.get_field_index(name)).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield int(ids[a]), batch.slice(a, b - a)
