"""Transform plug-ins over the lines of files: a table function over a partitioned table, a plug-in for each extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: A line and the mapping (text to token) of the literals in it; gives the new line, and the token that it was changed for.
Plugin = Callable[[str, dict[str, str]], tuple[str, str | None]]
_LITERAL = "\"([^\"]*)\"|'([^']*)'"


def substitute_literals(line: str, mapping: dict[str, str]) -> tuple[str, str | None]:
    """The built-in plug-in: quoted texts of the dictionary become look-ups, from left to right; the token is the first one's."""
    import re

    first = None
    for found in list(re.finditer(_LITERAL, line)):
        token = mapping.get(found.group()[1:-1])
        if token is not None:
            line = line.replace(found.group(), f'messages["{token}"]')
            first = first or token
    return line, first


#: Built-in plug-ins by extension.
PLUGINS: dict[str, Plugin] = {".py": substitute_literals}


def resolve(extension: str, external: dict[str, Plugin] | None = None) -> Plugin | None:
    """The plug-in for an extension, whatever its case: a built-in one before others."""
    lowered = extension.lower()
    others = {k.lower(): v for k, v in (external or {}).items()}
    return PLUGINS.get(lowered) or others.get(lowered)


def transform(text_lines: DataFrame, dictionary: DataFrame, external: dict[str, Plugin] | None = None) -> DataFrame:
    """(file, line_no, original, replacement, token, error): the lines that their file's plug-in changes, or fails on.

    The dictionary (token, text), texts distinct, is joined by the literals of the lines, so a plug-in sees no more of it
    than its line needs. Lines of one file come to one task, in order. A fault is a row with the error, and the lines after
    it go on; files without a plug-in, and null lines, are left alone.
    """
    chosen = {k.lower(): resolve(k, external) for k in (*PLUGINS, *(external or {}))}

    @udtf(returnType="file string, line_no int, original string, replacement string, token string, error string")
    class Transform:
        def eval(self, row):
            plugin = chosen[row["extension"]]
            try:
                new, token = plugin(row["line"], dict(row["mapping"] or {}))
            except Exception as error:  # a plug-in's fault is its own
                yield row["file"], row["line_no"], row["line"], None, None, f"{type(error).__name__}: {error}"
            else:
                if new != row["line"]:
                    yield row["file"], row["line_no"], row["line"], new, token, None

    extension = F.lower(F.regexp_extract("file", r"[^/.](\.[^./]*)\z", 1))
    rows = text_lines.where("line is not null").select("file", F.col("line_no").cast("int").alias("line_no"), "line", extension.alias("extension")).where(F.col("extension").isin(*chosen))
    literal = F.array_distinct(F.transform(F.regexp_extract_all("line", F.lit(_LITERAL), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2)))
    texts = rows.select("file", "line_no", F.explode(literal).alias("text"))
    known = texts.join(dictionary.select("text", "token"), "text").groupBy("file", "line_no").agg(F.map_from_entries(F.collect_list(F.struct("text", "token"))).alias("mapping"))
    return Transform(rows.join(known, ["file", "line_no"], "left").asTable().partitionBy("file").orderBy("line_no"))
