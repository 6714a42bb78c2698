"""Results as text: one JSON envelope, or plain lines. Both list results by path."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from siftwork.plans.query import Arguments

#: Characters that the envelope spells as escapes.
_ESCAPED = {ord("<"): "\\u003c", ord(">"): "\\u003e", ord("&"): "\\u0026", 0x2028: "\\u2028", 0x2029: "\\u2029"}


def json_envelope(args: Arguments, rows: Iterable[Row]) -> str:
    """The query and its results, indented by two; empty parts of the query are left out."""
    query: dict = {"terms": args.terms}
    for name, value in (("excludes", args.excludes), ("start_dir", args.start), ("path_scope", args.scope), ("only_type", args.only)):
        if value:
            query[name] = value
    query["include_code"] = args.code
    found = [{"file": r["path"], "size_bytes": r["size"], "excerpts": list(r["raw_excerpts"])} for r in rows]
    return json.dumps({"query": query, "matches": len(found), "results": found}, indent=2, ensure_ascii=False).translate(_ESCAPED)


def plain_lines(rows: Iterable[Row]) -> str:
    rows = list(rows)
    if not rows:
        return "NO RESULTS"
    out = []
    for i, r in enumerate(rows, 1):
        out += [f"MATCH {i}/{len(rows)}", f"FILE: {r['path']}", f"SIZE: {r['size']}"]
        out += [f"EXCERPT {j}: {x}" for j, x in enumerate(r["raw_excerpts"], 1)] + ["---"]
    return "\n".join(out)


def json_column(file: Column, size: Column, excerpts: Column) -> Column:
    """One result as JSON, for results that stay a table."""
    return F.to_json(F.struct(file.alias("file"), size.alias("size_bytes"), excerpts.alias("excerpts")))


def plain_column(file: Column, size: Column, excerpts: Column) -> Column:
    """One result as lines, without its number among all."""
    numbered = F.transform(excerpts, lambda x, i: F.concat(F.lit("EXCERPT "), (i + 1).cast("string"), F.lit(": "), x))
    return F.concat_ws("\n", F.concat(F.lit("FILE: "), file.cast("string")), F.concat(F.lit("SIZE: "), size.cast("string")), F.array_join(numbered, "\n"), F.lit("---"))


def shown(found: DataFrame) -> list[Row]:
    """Results in the order that they are shown in; what a person reads is what comes to the driver."""
    return found.select("path", "size", "raw_excerpts").orderBy("path").collect()
