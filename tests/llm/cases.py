"""Documents that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

_RNG = random.Random(1)
WORDS = [f"w{i}" for i in range(400)] + ["the", "and", "über", "été", "東京", "Ünï"]


def prose(n: int, seed: int = 0) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def thue_morse(n: int, a: str = "a", b: str = "b") -> str:
    """A word of n letters whose complement has the same sum under any polynomial hash modulo a power of two."""
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


ROWS = [
    (1, None, None, None), (2, "", "en", "s"), (3, " \t\n ", "en", None), (4, "one", None, "s"), (5, "one two", "en", "s"), (6, "ONE two", "de", "s"), (7, prose(120, 1), "en", "s"), (8, prose(120, 1), "en", "s"), (8, prose(120, 1), "en", "s"), (8, "other text of a repeated id", "en", "s"),
    (None, prose(120, 1), "en", "s"), (None, None, None, None), (9, prose(60_000, 2), "fr", "s"), (10, "x" * 300_000, "fr", "s"), (11, "line\n" * 20_000, "fr", "s"), (12, "\u0000\u0085  \U0001f600 ſK", "fr", "s"), (13, "1" * 5000 + "@" * 5000 + "+1" * 2000, "fr", "s"), (-5, prose(50, 3), "en", "s"), (2**62, prose(50, 3) + " more", "en", "s"),
]
#: Names that operators use inside.
CLASHES = ["block", "h", "part", "key", "spans", "kind", "pieces", "pii_key", "pii_spans", "pii_h", "pii_doc", "dropped_id", "id", "n", "score", "n_chars2", "component", "bucket", "rank", "learns", "guest", "to", "d1", "start", "end", "tokens2", "Text2"]


def documents(spark):
    """ROWS as a table, with columns that clash and one of another type."""
    rows = [(*r, None if r[1] is None else len(r[1]), *[None] * len(CLASHES)) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} {'int' if i % 2 else 'string'}" for i, c in enumerate(CLASHES)))
