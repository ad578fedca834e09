"""Hard-coded strings: lines to findings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, bound, lines
from .classify import is_binary_like, is_candidate, is_code_like, is_html_like, has_constant, is_skipped, string_class

# Literals with a known carrier, first match wins; then any quoted literal.
SPECIFIC = {"print(": r"""print\((["'])(.+?)\1\)""", "raise": r"""raise\s+\w+\((["'])(.+?)\1\)""", "logging.": r"""logging\.(?:info|warning|error|debug)\((["'])(.+?)\1\)"""}
GENERIC = r"""(["'])(.*?)(?<!\\)\1"""
COMMENT_STARTS = ("#", "//", "/*", "*", "'")


def is_comment(line: Column) -> Column:
    return line.rlike(rf"\A{SPACE}*+(?:{'|'.join(map(re.escape, COMMENT_STARTS))})")


def literals(line: Column) -> Column:
    """The strings of a line that count: the first specific match alone, else every literal that may be for people."""
    # a match is never empty, and a carrier's plain name decides before its expression is tried
    tried = lambda carrier, p: F.when(F.contains(line, F.lit(carrier)), F.nullif(F.regexp_extract(line, p, 2), F.lit("")))
    single = F.coalesce(*(tried(carrier, p) for carrier, p in SPECIFIC.items()))
    good = lambda t: is_candidate(t) & ~is_skipped(t) & ~is_binary_like(t) & ~is_html_like(t) & ~has_constant(t) & ~is_code_like(t)
    every = F.filter(F.regexp_extract_all(line, F.lit(GENERIC), F.lit(2)), good)
    return bound(single, lambda s: F.when(s.isNotNull(), F.array(s)).otherwise(every))


def findings(text_lines: DataFrame, file: str = "file") -> DataFrame:
    """(file, line_no, n, text, type) from (file, line_no, line); comments give none. ``type`` is the class in capitals."""
    kept = text_lines.where(F.col("line").rlike("[\"']") & ~is_comment(F.col("line")))
    found = kept.select(file, "line_no", F.posexplode(literals(F.col("line"))).alias("n", "text"))
    return found.withColumn("type", F.upper(string_class("text")))


def scan(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Findings of whole texts."""
    return findings(lines(files, file, text), file)
