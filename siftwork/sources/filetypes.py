"""Names of file types and of folders that are never searched."""

DOCUMENTS = tuple("txt md log rtf html htm xhtml shtml xml csv yaml yml cfg conf ini eml mbox msg pdf doc docx odt sh bat cmd tex rst asciidoc".split())
CODE = tuple("js ts sql py php java cpp c json go rs rb cs swift kt scala".split())
#: Types whose text is extracted first.
BINARY = frozenset("msg doc docx odt rtf pdf eml mbox".split())
#: Types whose raw bytes need not show a word that their text has, so the first test passes them over.
HEAVY = frozenset("pdf doc docx odt msg eml mbox".split())
#: Wider lists, for asking what a name is; searches go by those above.
KNOWN_DOCUMENTS = frozenset("txt md html xml csv yaml yml eml mbox msg pdf doc docx xls xlsx ppt pptx odt ods odp rtf log cfg conf ini sh bat".split())
KNOWN_CODE = frozenset("js ts sql py php java cpp c json go rs rb cs swift kt scala clj h hpp cc cxx pl r m mm".split())
SKIPPED_FOLDERS = frozenset(
    ".git .svn .hg .cache .cargo .rustup .npm .yarn .gradle .m2 .tox .terraform .terraform.d .pytest_cache .mypy_cache __pycache__ .mozilla .chromium "
    ".vscode .idea node_modules vendor target build dist .next .nuxt coverage tmp temp .DS_Store".split()
)


def suffix(name: str) -> str:
    """The extension of a name in lower case, without the dot."""
    stem, dot, ext = name.rpartition("/")[2].rpartition(".")
    return ext.lower() if dot else ""


def searched(code: bool = False, only: str | None = None) -> list[str]:
    """The types that a search looks at."""
    return [only.lower().lstrip(".")] if only else [*DOCUMENTS, *(CODE if code else ())]


def is_document(name: str) -> bool:
    return suffix(name) in KNOWN_DOCUMENTS


def is_code(name: str) -> bool:
    return suffix(name) in KNOWN_CODE


def is_hidden(name: str) -> bool:
    return name.startswith(".")


def known(code: bool = False) -> frozenset[str]:
    return KNOWN_DOCUMENTS | KNOWN_CODE if code else KNOWN_DOCUMENTS


def described(code: bool = False) -> str:
    """The searched types in words."""
    return f"documents ({', '.join(DOCUMENTS)})" + (f" and code ({', '.join(CODE)})" if code else "")
