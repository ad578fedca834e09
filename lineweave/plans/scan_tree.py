"""Scan a tree of files: each extension's reader, built in or given by the user, then one table of findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines
from ..operators import detect
from ..operators.classify import string_class
from ..operators.treediff import is_generated
from ..sources import files, markup

# The extensions of each language.
EXTENSIONS = {
    "python": (".py",), "php": (".php",), "javascript": (".js", ".jsx", ".ts", ".tsx"), "html": (".html", ".htm"), "css": (".css",), "sql": (".sql",), "java": (".java",), "csharp": (".cs",), "ruby": (".rb",),
    "go": (".go",), "graph": (".dot", ".graphml"), "rust": (".rs",), "text": (".txt",), "office XML": (".docx", ".xlsx", ".pptx", ".odt", ".ods", ".odp"),
}


@dataclass(frozen=True)
class Reader:
    """``scan`` makes (path, line, text) of files (path, content, text)."""

    name: str
    extensions: tuple[str, ...]
    scan: Callable[[DataFrame], DataFrame]
    user: bool = False


def _html(tree: DataFrame) -> DataFrame:
    return markup.extract_html(tree, "path", "text").select("path", "line", "text")


def _office(tree: DataFrame) -> DataFrame:
    return markup.extract_office(tree).select("path", (F.col("paragraph") + 1).alias("line"), "text")


BUILT_IN = (Reader("html", (".html", ".htm"), _html), Reader("office", (".docx", ".odt"), _office))


def resolve(readers: tuple[Reader, ...], prefer_built_in: bool = False) -> dict[str, Reader]:
    """The reader of each extension: the user's before a built-in one, unless those are preferred; two of the user's fail."""
    found: dict[str, Reader] = {}
    for extension in sorted({e for r in readers for e in r.extensions}):
        own = [r for r in readers if r.user and extension in r.extensions]
        built = [r for r in readers if not r.user and extension in r.extensions]
        if len(own) > 1:
            raise ValueError(f"{extension} is claimed by {', '.join(sorted(r.name for r in own))}")
        found[extension] = (built + own if prefer_built_in else own + built)[0]
    return found


def _extension():
    return F.lower(F.regexp_extract("path", r"(\.[^./]+)\z", 1))


def scan(tree: DataFrame, readers: tuple[Reader, ...] = BUILT_IN, exclude: tuple[str, ...] = (), only: tuple[str, ...] | None = None, tool: str = "tool", prefer_built_in: bool = False) -> DataFrame:
    """(path, line, text, type) of every string found in files (path, content).

    Markup goes to its reader alone, other text files to the detector too. JSON, the tool's own output, binary files
    and excluded languages are left out; ``only`` keeps some extensions.
    """
    winners = resolve(readers, prefer_built_in)
    dropped = {".json"} | {e for lang in exclude for e in EXTENSIONS[lang]}
    rows = tree.withColumn("extension", _extension()).where(~F.col("extension").isin(*dropped) & ~is_generated("path", tool))
    if only is not None:
        rows = rows.where(F.col("extension").isin(*only))
    admitted = files.admit(rows.where(~files.is_binary_for_scan("content"))).where("admitted").select("path", "text", _extension().alias("extension"))
    plain = admitted.where(~F.col("extension").isin(*(e for r in BUILT_IN for e in r.extensions)))
    out = detect.findings(lines(plain, "path"), "path").select("path", F.col("line_no").alias("line"), "text", "type")
    for reader in dict.fromkeys(winners.values()):
        mine = tuple(e for e, r in winners.items() if r is reader)
        source = rows if reader.name == "office" else admitted
        found = reader.scan(source.where(F.col("extension").isin(*mine))).select("path", "line", "text")
        out = out.unionByName(found.withColumn("type", F.upper(string_class("text"))))
    return out
