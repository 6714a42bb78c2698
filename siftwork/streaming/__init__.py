"""Searches over documents that keep arriving.

Matching one document needs no other, but proximity's places are rows that are brought together by
document, which a stream without watermarks cannot do. So each micro-batch is searched as a table of its own:
the filter before places are looked for runs in the stream, the rest on what it leaves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from siftwork.operators.presence import present
from siftwork.plans.query import SearchQuery
from siftwork.plans.search import search_table


def watch(docs: DataFrame, query: SearchQuery, out: str, checkpoint: str, key: str = "doc_id", text: str = "text", once: bool = False) -> StreamingQuery:
    """Writes the matches of each micro-batch of a stream of texts to the folder out, as Parquet.

    A batch is written under its number, so one that is run again after a failure replaces itself. once: what
    is there now, then end.
    """
    some = docs.where(present(F.col(text), list(query.terms)))

    def write(batch: DataFrame, number: int) -> None:
        search_table(batch, query, key, text).write.mode("overwrite").parquet(f"{out}/batch={number}")

    start = some.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (start.trigger(availableNow=True) if once else start).start()
