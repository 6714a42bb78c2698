"""What a search asks for, and the command line that says it."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from siftwork.operators.paths import path_scope, start_folder
from siftwork.sources.filetypes import searched

DISTANCE = 5000


@dataclass(frozen=True)
class SearchQuery:
    """Terms that must all occur within distance bytes, and what rules a document out.

    excludes holds words, and extensions with their dot. types are those searched; None stands for all of
    a table that has no files' types.
    """

    terms: tuple[str, ...]
    excludes: tuple[str, ...] = ()
    distance: int = DISTANCE
    types: tuple[str, ...] | None = None
    start: str = ""
    scope: tuple[str, ...] = ()
    smart: bool = False
    budget: int = 400

    @property
    def excluded_types(self) -> list[str]:
        return [x for x in self.excludes if x.startswith(".")]

    @property
    def excluded_words(self) -> list[str]:
        return [x for x in self.excludes if not x.startswith(".")]


@dataclass
class Arguments:
    """A command line. Workers, concurrency and timeout are taken and kept, but Spark schedules tasks."""

    terms: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    code: bool = False
    distance: int = 0
    heavy: int = 0
    workers: int = 4
    timeout_ms: int = 1000
    only: str = ""
    start: str = ""
    scope: list[str] = field(default_factory=list)
    smart: bool = False
    plain: bool = False
    json: bool = False
    help: bool = False
    version: bool = False
    errors: list[str] = field(default_factory=list)

    def query(self) -> SearchQuery:
        return SearchQuery(tuple(self.terms), tuple(self.excludes), self.distance or DISTANCE, tuple(searched(self.code, self.only or None)), self.start, tuple(self.scope), self.smart)


_FLAGS = {"--code": "code", "--smart-forms": "smart", "--plain": "plain", "--json": "json", "--help": "help", "-h": "help", "--version": "version", "-v": "version"}
_NUMBERS = {"--distance": "distance", "-distance": "distance", "--heavy-concurrency": "heavy", "--file-timeout-binary": "timeout_ms", "--workers": "workers", "-workers": "workers"}
_TEXTS = ("--only", "--startdir", "--pathscope")


def heavy_slots(workers: int, free_gib: int | None = None) -> int:
    """Slots for costly types when none are asked for: half the workers, one for each 4 GiB free, 1 to 8."""
    if free_gib is None:
        free_gib = 0
        if os.path.exists("/proc/meminfo"):
            with open("/proc/meminfo") as f:
                sizes = dict(line.split()[:2] for line in f)
            free_gib = int(sizes.get("MemAvailable:", sizes.get("MemFree:", 0))) >> 20
    return max(1, min(workers // 2, max(1, free_gib // 4), 8))


def parse(argv: list[str]) -> Arguments:
    """The command line's meaning.

    Bare words are terms, and after --not excludes, to the end. A flag's value is the next word, whatever
    it looks like; `--flag=value` is a bare word. Numbers that are no positive integers are passed over.
    Bad paths are kept in errors.
    """
    out, waiting, excluding = Arguments(), "", False
    for a in argv:
        if waiting in _NUMBERS:
            digits = a[1:] if a[:1] == "+" else a
            if digits.isascii() and digits.isdigit() and int(digits) > 0:
                setattr(out, _NUMBERS[waiting], int(digits))
        elif waiting == "--only":
            out.only = a.lower().removeprefix(".")
        elif waiting:
            try:
                if waiting == "--startdir":
                    out.start = start_folder(a)
                else:
                    out.scope = path_scope(a) or []
            except ValueError as e:
                out.errors.append(str(e))
        elif a in _FLAGS:
            setattr(out, _FLAGS[a], True)
        elif a == "--not":
            excluding = True
        elif a in _NUMBERS or a in _TEXTS:
            waiting = a
            continue
        else:
            (out.excludes if excluding else out.terms).append(a)
        waiting = ""
    out.heavy = out.heavy or heavy_slots(out.workers)
    return out
