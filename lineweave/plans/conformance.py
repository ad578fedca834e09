"""Conformance cases: folders with two trees and the diff that they should make, all run at once.

A case is a folder with ``input_a``, ``input_b``, ``expected.json`` (an object with the list ``files``) and ``expected.hash``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical_hash
from ..operators import compare, seqdiff
from ..sources.files import decode, read_tree


def observed(tree: DataFrame) -> DataFrame:
    """(case, files, hash): the normalised diffs of all cases in a tree (path, content) of case/input_a/... and case/input_b/...

    ``files`` is JSON text, files by path. Files that aren't text count as empty ones; those that are equal are left out.
    """
    rows = tree.select(*(F.regexp_extract("path", r"(?s)\A([^/]+)/input_([ab])/(.+)\z", n).alias(name) for n, name in ((1, "case"), (2, "side"), (3, "file"))), F.coalesce(decode("content"), F.lit("")).alias("text")).where("case != ''")
    of = lambda side, name: rows.where(F.col("side") == side).select(F.struct("case", "file").alias("path"), F.col("text").alias(name))
    pairs = of("a", "before").join(of("b", "after"), "path", "full")
    found = seqdiff.normalized(seqdiff.diff_pairs(pairs))
    one = found.select("path.case", F.struct(F.col("path.file").alias("path"), "status", "changes").alias("f"), file_hash(F.col("path.file")).alias("h"))
    # a case is a small thing that somebody wrote
    made = one.groupBy("case").agg(F.to_json(F.array_sort(F.collect_list("f"), lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))).alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ",").cast("binary"), 256).alias("hash"))
    every = rows.select("case").distinct()
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return every.join(made, "case", "left").select("case", F.coalesce("files", F.lit("[]")).alias("files"), F.coalesce("hash", nothing).alias("hash"))


def file_hash(path: Column) -> Column:
    return canonical_hash(path=path, status=F.col("status"), changes=F.col("changes"))


def run_cases(spark: SparkSession, root: str) -> DataFrame:
    """(case, path, status, expected, actual): where cases below a folder aren't what they should be; no rows if all conform.

    Diffs are compared by their structure, path by path; another hash is a row of the path ``hash``. A case without expectations
    differs at all its paths.
    """
    tree = read_tree(spark, root)
    got = observed(tree)
    said = tree.select(F.regexp_extract("path", r"\A([^/]+)/expected\.(?:json|hash)\z", 1).alias("case"), F.endswith("path", F.lit(".hash")).alias("is_hash"), decode("content").alias("text")).where("case != ''")
    wanted = said.where("not is_hash").select("case", F.col("text").alias("document"))
    made = got.select("case", F.concat(F.lit('{"files":'), "files", F.lit("}")).alias("document"))
    differ = compare.differences(wanted, made, "case")
    hashes = got.join(said.where("is_hash").select("case", F.trim(F.regexp_replace("text", r"\s", "")).alias("stated")), "case", "left")
    wrong = hashes.where(~F.col("hash").eqNullSafe(F.col("stated"))).select("case", F.lit("hash").alias("path"), F.when(F.col("stated").isNull(), "unexpected").otherwise("changed").alias("status"), F.col("stated").alias("expected"), F.col("hash").alias("actual"))
    return differ.unionByName(wrong)
