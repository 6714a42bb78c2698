"""Personal data: fixed patterns, and patterns learned from what they find.

Everything is DataFrame expressions. Fixed patterns give base spans (email, ip, card, phone). Those
are the seeds of a bootstrap. What stands around a seed, and how it is written, are lexical patterns:
the word before or after it, or the two before it, each with its outline (runs of digits and letters),
and its exact shape if that is long. Identifier-like strings that no fixed pattern matched are
candidates, each for the kinds whose number of digits it has. Patterns and instances form a graph.
A pattern is as sure as the share of its kind among the known instances that it has (and one more, of no
kind), strings of which nothing is known yet counting for neither side; an instance as sure as that one
of its patterns is right. Each round takes the sure instances in among the known ones, so they bring
patterns of their own. In the end sure candidates become spans of the kind that they were taken for.

Identifiers without a digit are no candidates, and secrets that no kind has a place for (keys of
letters and digits) become no spans: there is no seed that could teach them.

Patterns use possessive groups, so neither very long texts nor long runs make Java's matcher recurse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork.llm.common import forget, tidy, unused, written

KINDS = ("email", "ip", "card", "phone")
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Identifier-like strings: groups of digits that single spaces, brackets, hyphens or dots join, or ASCII tokens with a digit.
CANDIDATE = r"(?<![0-9A-Za-z@._%+-])(?:\(?[0-9]++(?:[\x20().-]{1,2}+[0-9]++)*+(?![0-9A-Za-z@_])|(?=[A-Za-z@._%+-]*+[0-9])[0-9A-Za-z@._%+-]*[0-9A-Za-z])"
#: What a candidate must look like to be taken for a kind.
FITS = (r"^[^@]+@[^@]+$", r"^[0-9]{1,3}([-_ ][0-9]{1,3}){3}$", r"^[0-9]([ -]?[0-9]){11,18}$", r"^\(?[0-9]([ ().-]{0,2}[0-9]){8,14}$")
#: Known instances that a pattern needs, rounds, what makes an instance sure, and the length from which a shape is a pattern.
MIN_SEEDS, ROUNDS, SURE, LONG_SHAPE = 3, 3, 0.8, 10
#: Characters before and after a match in which its neighbours are looked for.
CONTEXT = 80
_GAP = r"[\s\p{Punct}]"
_WORD = r"[^\s\p{Punct}]"
_CAND = len(KINDS)


def _valid(kind: Column, m: Column) -> Column:
    """Whether a match of a fixed pattern counts."""
    bare = lambda p: F.regexp_replace(p, "^0+", "")
    ip = F.forall(F.split(m, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(m, "[^0-9]", "")
    back = F.reverse(digits)
    luhn = F.aggregate(
        F.sequence(F.lit(0), F.length(digits) - 1),
        F.lit(0),
        lambda s, i: s + F.when(i % 2 == 0, back.substr(i + 1, F.lit(1)).try_cast("int")).otherwise(F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), back.substr(i + 1, F.lit(1)).try_cast("int"))),
    )
    return F.when(kind == 0, True).when(kind == 1, ip).when(kind == 2, F.when(F.length(digits).between(12, 19), luhn % 10 == 0).otherwise(False)).when(kind == 3, F.length(digits).between(9, 15)).otherwise(F.exists(F.array(*(F.lit(p) for p in FITS)), lambda p: F.rlike(m, p)))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def matches(docs: DataFrame) -> DataFrame:
    """Matches that count: doc_id, h (of the text), kind, start, end (code points), match, left (two words), right.

    kind is an index into KINDS, or len(KINDS) for identifier-like strings. Rows with equal doc_id and
    text give their matches once.
    """
    t = _keyed(docs)
    digit = F.col("text").rlike("[0-9]")
    none = F.array().cast("array<string>")
    guards = (F.col("text").contains("@"), digit, digit, F.col("text").contains("+"), digit)
    every = F.array(
        *(
            F.struct(F.lit(k).alias("kind"), F.lit(p).alias("pattern"), F.when(g, F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias("m"))
            for k, (p, g) in enumerate(zip((*PATTERNS, CANDIDATE), guards))
        )
    )
    rows = t.where(digit | F.col("text").contains("@")).withColumn("x", F.explode(every)).where(F.size("x.m") > 0).select("doc_id", "h", "text", "x.*")
    gaps = F.transform(
        F.split("text", F.col("pattern"), -1),
        lambda g: F.struct(F.length(g).alias("n"), F.lower(F.regexp_extract(F.right(g, F.lit(CONTEXT)), f"((?:{_WORD}++{_GAP}++)?{_WORD}++){_GAP}*+$", 1)).alias("last"), F.lower(F.regexp_extract(F.left(g, F.lit(CONTEXT)), f"^{_GAP}*+({_WORD}++)", 1)).alias("first")),
    )
    # a variable holds the gaps, so that they are computed once and not for every match
    n = F.size("m")
    zipped = F.get(F.transform(F.array(gaps), lambda g: F.arrays_zip(F.col("m").alias("match"), F.slice(g, 1, n).alias("before"), F.slice(g, 2, n).alias("after"))), F.lit(0))
    rows = rows.select("doc_id", "h", "kind", F.posexplode(zipped).alias("i", "x"))
    rows = rows.select("doc_id", "h", "kind", "i", "x.match", F.col("x.before.n").alias("n"), F.col("x.before.last").alias("left"), F.col("x.after.first").alias("right")).distinct()
    own = W.partitionBy("doc_id", "h", "kind").orderBy("i")
    start = F.sum("n").over(own.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce(F.sum(F.length("match")).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("start", start).where(_valid(F.col("kind"), F.col("match"))).select("doc_id", "h", "kind", "start", (F.col("start") + F.length("match")).alias("end"), "match", "left", "right")


def _apart(found: DataFrame) -> DataFrame:
    """found without the candidates that overlap a match of a fixed pattern."""
    base = F.col("kind") < _CAND
    own = W.partitionBy("doc_id", "h").orderBy("start", "end")
    before = F.max(F.when(base, F.col("end"))).over(own.rowsBetween(W.unboundedPreceding, -1))
    back = W.partitionBy("doc_id", "h").orderBy(F.desc("start"), F.desc("end"))
    after = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(W.unboundedPreceding, -1))
    rows = found.withColumn("before", before).withColumn("after", after)
    return rows.where(base | ((F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end")))).drop("before", "after")


def _patterns(match: Column, left: Column, right: Column) -> Column:
    """The lexical patterns of an occurrence."""
    bare = F.regexp_replace(match, r"^\+[0-9]{1,3}[ .-]?", "")
    shape = F.regexp_replace(F.regexp_replace(bare, "[0-9]", "9"), "[A-Za-z]", "a")
    outline = F.regexp_replace(F.regexp_replace(shape, "9+", "9"), "a+", "a")
    last = F.regexp_extract(left, f"({_WORD}++)$", 1)
    words = ((F.lit("l"), last), (F.lit("ll"), F.when(last != left, left)), (F.lit("r"), right))
    return F.array_compact(F.array(F.when(F.length(shape) >= LONG_SHAPE, F.concat(F.lit("s\t"), shape)), *(F.when(w != "", F.concat_ws("\t", side, w, outline)) for side, w in words)))


def _fits(match: Column) -> Column:
    """The kinds that a candidate may be of."""
    return F.array_compact(F.array(*(F.when(match.rlike(p), F.lit(k)) for k, p in enumerate(FITS))))


def discovered(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, h, kind, start, end) of candidates in found, the result of matches(), that the bootstrap is sure of."""
    own = _apart(found)
    edges = own.select("kind", F.lower("match").alias("instance"), F.explode(_patterns(F.col("match"), F.col("left"), F.col("right"))).alias("pattern"), _fits(F.col("match")).alias("fits")).distinct()
    edges = written(edges, "patterns")
    seeds = edges.where(F.col("kind") < _CAND).select("pattern", "kind", "instance")
    graph = edges.where(F.col("kind") == _CAND).select("pattern", "instance", "fits")
    known, sure = seeds, None
    for _ in range(rounds):
        counts = known.groupBy("pattern", "kind").agg(F.count("*").alias("n"))
        every = counts.groupBy("pattern").agg(F.sum("n").alias("of"), F.max(F.struct("n", "kind")).alias("best")).where(F.col("best.n") >= MIN_SEEDS)
        confidence = every.select("pattern", F.col("best.kind").alias("kind"), (F.col("best.n") / (F.col("of") + 1)).alias("confidence"))
        scored = graph.join(confidence, "pattern").where(F.array_contains("fits", F.col("kind"))).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        best = scored.groupBy("instance").agg(F.max(F.struct("score", -F.col("kind"))).alias("b")).where(F.col("b.score") >= SURE)
        before, sure = sure, written(best.select("instance", (-F.col("b.col2")).alias("kind")), "instances")
        known = seeds.union(graph.join(sure, "instance").select("pattern", "kind", "instance"))
        forget(before)
    forget(edges)
    return own.where(F.col("kind") == _CAND).withColumn("instance", F.lower("match")).drop("kind").join(sure, "instance").select("doc_id", "h", "kind", "start", "end")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, h, base and spans (arrays of start, kind, end, before; kind an index into KINDS).

    Positions are code points, end exclusive, in the whole text (null: empty); both arrays are sorted by
    start, then kind, and empty where there is nothing. base has the matches of the fixed patterns that
    count, spans those and what the bootstrap adds; before is the furthest end of the spans before it.
    Repeated rows get equal results; with no seeds, or an empty table, the bootstrap adds nothing. Other
    columns of docs play no part.
    """
    found = written(matches(docs), "matches")
    tidy(docs.sparkSession)
    added = discovered(found)
    both = found.where(F.col("kind") < _CAND).select("doc_id", "h", "kind", "start", "end", F.lit(True).alias("base")).union(added.select("doc_id", "h", "kind", "start", "end", F.lit(False)))
    order = W.partitionBy("doc_id", "h").orderBy("start", "kind", "end").rowsBetween(W.unboundedPreceding, -1)
    both = both.withColumn("before", F.coalesce(F.max("end").over(order), F.lit(0)))
    one = F.struct(*(F.col(c).cast(t).alias(c) for c, t in (("start", "long"), ("kind", "int"), ("end", "long"), ("before", "long"))))
    by = both.groupBy(F.col("doc_id").alias("d2"), F.col("h").alias("h2")).agg(F.array_sort(F.collect_list(F.when(F.col("base"), one))).alias("base"), F.array_sort(F.collect_list(one)).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,before:bigint>>")
    return _keyed(docs).select("doc_id", "h").join(by, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left").select("doc_id", "h", F.coalesce("base", empty).alias("base"), F.coalesce("spans", empty).alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame) -> DataFrame:
    """docs with each span of its text replaced by [KIND]; spans that overlap an earlier one go with it.

    Null texts stay null; n_chars, where docs has it, is the new text's. Other columns are kept as they
    are, whatever their names. Repeated rows get equal texts; an empty table gives an empty result.
    """
    key, of, h, spans = (unused(f"pii_{x}", docs) for x in ("key", "doc", "h", "spans"))
    data = personal_data(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias(of), F.col("h").alias(h), F.col("spans").alias(spans)).distinct()
    t = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    t = t.join(data, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.col(key) == F.col(h)), "left")
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    parts = F.transform(spans, lambda s: F.when(s["start"] >= s["before"], F.concat(F.col("text").substr((s["before"] + 1).cast("int"), (s["start"] - s["before"]).cast("int")), F.get(names, s["kind"]))).otherwise(F.lit("")))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.concat(F.array_join(parts, ""), F.col("text").substr((last + 1).cast("int"), F.length("text"))))
    out = t.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
