"""Two trees of files, or two versions of lines, compared by position."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a tree comparison leaves out.
IGNORED_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".key", ".pem", ".pub", ".svg", ".pdf", ".zip", ".tar", ".gz", ".dex", ".exe", ".dll", ".so")
IGNORED_PREFIXES = (".git/", "dictionary-", "payload/")
IGNORED_JSON_PARTS = ("plan", "manifest")


def is_ignored(path: Column | str, tool: str) -> Column:
    """Whether a path isn't compared; ``tool`` names the tool's own folder and files."""
    p = F.col(path) if isinstance(path, str) else path
    prefixes = reduce(or_, (F.startswith(p, F.lit(x)) for x in (*IGNORED_PREFIXES, f".{tool}/")))
    suffixes = reduce(or_, (F.endswith(p, F.lit(x)) for x in IGNORED_SUFFIXES))
    own = F.endswith(p, F.lit(".json")) & reduce(or_, (F.contains(p, F.lit(x)) for x in (*IGNORED_JSON_PARTS, tool)))
    return prefixes | suffixes | F.contains(p, F.lit(f"{tool}-plan")) | own


def is_generated(path: Column | str, tool: str) -> Column:
    """Whether a path is the tool's own output and isn't scanned."""
    p = F.col(path) if isinstance(path, str) else path
    return p.rlike(rf"(?:\A|/)\.{tool}(?:/|\z)") | p.rlike(rf"(?:\A|/)(?:scan-result-[^/]*\.obad|dictionary-[^/]*|{tool}-[^/]*)\.json\z")


def compare_trees(before: DataFrame, after: DataFrame, path: str = "path", content: str = "content", target_scope: bool = False) -> DataFrame:
    """(path, status) of files that were added, removed or modified; contents are compared by hash.

    ``target_scope`` leaves out removals: only files of the later tree are looked at.
    """
    hashed = lambda df, name: df.select(path, F.sha2(F.col(content).cast("binary"), 256).alias(name), F.lit(True).alias(f"in_{name}"))
    both = hashed(before, "a").join(hashed(after, "b"), path, "full_outer")
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    out = both.select(path, status.alias("status")).where("status is not null")
    return out.where("status != 'removed'") if target_scope else out


def all_keys(*tables: DataFrame, key: str = "path") -> DataFrame:
    """The keys that any of the tables has, each once, in order; null is none."""
    return reduce(DataFrame.union, (t.select(key) for t in tables)).where(F.col(key).isNotNull()).distinct().orderBy(key)


def compare_lines(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """(key, line_no, type, before, after) line by line at the same position: insert, delete or replace."""
    a = before.select(key, "line_no", F.col("line").alias("before"), F.lit(True).alias("in_a"))
    b = after.select(key, "line_no", F.col("line").alias("after"), F.lit(True).alias("in_b"))
    kind = F.when(F.col("in_a").isNull(), "insert").when(F.col("in_b").isNull(), "delete").when(~F.col("before").eqNullSafe(F.col("after")), "replace")
    return a.join(b, [key, "line_no"], "full_outer").select(key, "line_no", kind.alias("type"), "before", "after").where("type is not null")


def file_status(changes: DataFrame, path: str = "path") -> DataFrame:
    """(path, status): added if all changes insert, removed if all delete, else modified."""
    every = lambda t: F.every(F.col("type") == t)
    return changes.groupBy(path).agg(F.when(every("insert"), "added").when(every("delete"), "removed").otherwise("modified").alias("status"))
