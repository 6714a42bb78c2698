"""Command line: `python -m siftwork.cli TERM... [--not WORD...] [--json | --plain] ...`."""

from __future__ import annotations

import sys

from siftwork import __version__
from siftwork.plans.query import Arguments, parse

USAGE = """Usage: siftwork TERM... [flags] [--not WORD|.ext ...]

Finds the files in which all terms occur near each other, and shows an excerpt of each.

  --distance N        bytes within which all terms must begin (5000)
  --not WORD|.ext...  all following words, and types, rule a file out
  --only TYPE         this type only
  --code              program texts too
  --startdir PATH     where to search (here)
  --pathscope A,B     only paths that match a pattern; wild cards * and ?, or a folder's name
  --smart-forms       more word forms: -ed, -ing, -al, -tion, -ation
  --json              results as JSON
  --plain             results as lines (the default)
  --workers N, --heavy-concurrency N, --file-timeout-binary MS
                      accepted; Spark's own settings decide
  --help, --version"""


def run(args: Arguments, spark=None) -> tuple[int, str, str]:
    """(exit code, standard output, standard error): 0 with or without results, 1 for anything wrong."""
    if args.help:
        return 0, USAGE, ""
    if args.version:
        return 0, f"siftwork {__version__}", ""
    if args.errors:
        return 1, "", "\n".join(f"Error: {e}" for e in args.errors)
    if not args.terms:
        return 1, "", "Error: no term given\n\n" + USAGE
    from siftwork.plans.search import search
    from siftwork.plans.sinks import json_envelope, plain_lines, shown

    try:
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("siftwork").getOrCreate()
        rows = shown(search(spark, args.query()))
    except Exception as e:  # noqa: BLE001 - reported to whoever called
        return 1, "", f"Error: {e}"
    return 0, json_envelope(args, rows) if args.json else plain_lines(rows), ""


def main(argv: list[str] | None = None) -> int:
    code, out, err = run(parse(sys.argv[1:] if argv is None else argv))
    if out:
        print(out)
    if err:
        print(err, file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
