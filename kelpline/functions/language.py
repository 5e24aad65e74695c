"""Languages by file extension, ignore rules and charset decoding."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension to language: fixed values.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "md": "markdown", "py": "python", "go": "go",
    "rs": "rust", "java": "java", "kt": "kotlin", "swift": "swift", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "h": "cpp", "c": "c", "sh": "shell", "bash": "shell", "zsh": "shell", "fish": "shell",
    "ps1": "powershell", "sql": "sql", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "xml": "xml", "html": "html", "css": "css", "scss": "scss", "sass": "sass", "less": "less", "vue": "vue",
    "svelte": "svelte", "rb": "ruby", "php": "php", "dart": "dart", "lua": "lua", "r": "r",
}
IGNORED = ("node_modules", ".git", "dist", "build", "target", "vendor", "__pycache__", ".venv", "coverage")


def language(path: Column) -> Column:
    """Language of a path's extension, or unknown."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(LANGUAGES.items())])
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    return F.coalesce(F.try_element_at(table, ext), F.lit("unknown"))


def glob_regex(pattern: Column) -> Column:
    """`**` crosses folders, `*` doesn't; anything else is literal."""
    quoted = F.regexp_replace(pattern, r"([.+^${}()|\[\]\\?])", r"\\$1")
    starred = F.regexp_replace(F.regexp_replace(quoted, r"\*\*", "\u0001"), r"\*", "[^/]*")
    return F.concat(F.lit("^"), F.regexp_replace(starred, "\u0001", ".*"), F.lit("$"))


def ignored(path: Column, folders: tuple[str, ...] = IGNORED) -> Column:
    """Whether a path lies in one of the folders that are never indexed."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(f) for f in folders]))


def allowed(path: Column, folders: tuple[str, ...] = IGNORED) -> Column:
    return ~ignored(path, folders) & (language(path) != "unknown")


def decode_text(content: Column) -> Column:
    """Bytes to text by byte-order mark, else UTF-8 where valid, else ISO-8859-1."""
    start = F.hex(F.substring(content, 1, 3))
    utf8 = F.when(start == "EFBBBF", F.decode(F.expr(f"substring({_name(content)}, 4)"), "UTF-8"))
    utf16 = F.when(start.startswith("FFFE"), F.decode(F.expr(f"substring({_name(content)}, 3)"), "UTF-16LE")).when(start.startswith("FEFF"), F.decode(F.expr(f"substring({_name(content)}, 3)"), "UTF-16BE"))
    return F.coalesce(utf8, utf16, F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def _name(column: Column) -> str:
    return column._jc.toString()
