"""The observed diff of a working tree: a version control's patch for text, its listings and the files for what is binary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfc
from ..operators.seqdiff import CHANGES
from ..sources import patches

METADATA = "struct<size:bigint,sha256:string>"


def observed(lines: DataFrame, numstat: DataFrame, name_status: DataFrame, tree: DataFrame, patch: str = "patch") -> DataFrame:
    """(path, status, kind, metadata, changes): the normalised diff, a row for each file that changed.

    ``lines`` (patch, n, line) is the patch, or many of different files; ``numstat`` and ``name_status`` are the listings'
    lines (line), ``tree`` (path, content) the files as they are. A text file has its blocks in order of their lines, lines in
    NFC, without empty blocks; one without any is left out. A binary file has no blocks, but its size and SHA-256, null where
    it is removed. Nothing changed gives no rows.
    """
    blocks = patches.parse_patch(lines, patch).where("type is not null")
    body = lambda c: F.split(nfc(F.array_join(c, "\n")), "\n")
    kept = lambda c: F.when(F.size(c) > 0, body(c)).otherwise(F.array().cast("array<string>"))
    one = F.struct("type", "start_line", "end_line", kept("before").alias("before"), kept("after").alias("after"))
    text = blocks.select("path", "status", one.alias("c")).where((F.size("c.before") > 0) | (F.size("c.after") > 0)).groupBy("path", "status")
    files = text.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("c.start_line").alias("l"), "c"))), lambda x: x["c"]).alias("changes"))
    none = F.lit(None)
    rows = files.select("path", "status", none.cast("string").alias("kind"), none.cast(METADATA).alias("metadata"), F.col("changes").cast(CHANGES).alias("changes"))
    listed = patches.changed_files(numstat, name_status).where("binary").withColumn("status", F.coalesce("status", F.lit("modified")))
    seen = patches.binary_entries(tree).select("path", "size", "sha256")
    there = lambda c: F.when(F.col("status") != "removed", F.col(c)).alias(c)
    binary = listed.join(seen, "path", "left").select("path", "status", F.lit("binary").alias("kind"), F.struct(there("size"), there("sha256")).cast(METADATA).alias("metadata"), F.array().cast(CHANGES).alias("changes"))
    return rows.unionByName(binary)
