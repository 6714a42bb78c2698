"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import forget, tidy, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over rows (u, v): each v moves to the least of u's neighbours and u itself."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        moved = pairs.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id with a link in links (u, v); component is the least id reachable.

    The links stay in tables: each round writes its edges to the shared folder, and only a count and
    a checksum come to the driver. Groups are met by partial aggregates and joins that adaptive
    execution may split, so a hub with very many links is no single task's work. Rows with a null
    or with u = v link nothing. An empty table gives an empty one.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True)
        after = written(_star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False), "edges")
        now = _state(after)
        forget(edges)
        tidy(links.sparkSession)
        edges, before, state = after, state, now
        if now == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
