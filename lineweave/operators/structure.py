"""Duplicate structures: grouping by signature, classification, evidence and index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Method names that storage backends share.
INTERFACE_METHODS = ("connect", "execute", "fetchone", "fetchall", "commit", "rollback", "close")


def duplicate_groups(functions: DataFrame, signature: str = "signature") -> DataFrame:
    """(normalized_hash, count, total_lines, names, files, in_storage, in_base) of signatures that occur twice or more."""
    path = F.replace("file", F.lit("\\"), F.lit("/"))
    grouped = functions.groupBy(F.sha2(F.col(signature).cast("binary"), 256).alias("normalized_hash")).agg(
        F.count("*").alias("count"), F.sum("line_count").alias("total_lines"), F.count_distinct("name").alias("names"), F.count_distinct("file").alias("files"),
        F.min("name").alias("one_name"), F.every(F.contains(path, F.lit("/storage/"))).alias("in_storage"), F.every(F.contains(path, F.lit("/storage/base.py"))).alias("in_base"),
    )
    return grouped.where(F.col("count") >= 2)


def members(functions: DataFrame, signature: str = "signature") -> DataFrame:
    """The functions of duplicate groups, one row each: groups of any size stay rows."""
    rows = functions.withColumn("normalized_hash", F.sha2(F.col(signature).cast("binary"), 256))
    many = rows.groupBy("normalized_hash").agg(F.count("*").alias("n")).where("n >= 2").select("normalized_hash")
    return rows.join(many, "normalized_hash", "left_semi")


def classify(groups: DataFrame, interface: tuple[str, ...] = INTERFACE_METHODS) -> DataFrame:
    """Groups with ``classification`` and ``confidence``: the first rule that holds."""
    backend = (F.col("names") == 1) & F.col("one_name").isin(*interface) & F.col("in_storage")
    contract = (F.col("names") >= 3) & (F.col("files") == 1) & F.col("in_base")
    shared = (F.col("count") >= 3) & (F.col("files") >= 3)
    label = F.when(backend, "INTERFACE_IMPLEMENTATION").when(contract, "ABSTRACT_CONTRACT").when(shared, "SHARED_UTILITY_CANDIDATE").otherwise("UNKNOWN_DUPLICATION")
    trust = F.when(backend, 0.90).when(contract, 0.99).when(shared, 0.95).otherwise(0.50)
    return groups.withColumns({"classification": label, "confidence": trust})


def index(classified: DataFrame) -> DataFrame:
    """(classification, confidence, evidence_hash)."""
    return classified.select("classification", "confidence", F.col("normalized_hash").alias("evidence_hash"))


def catalog(classified: DataFrame) -> DataFrame:
    """(classification, groups, functions, total_lines)."""
    return classified.groupBy("classification").agg(F.count("*").alias("groups"), F.sum("count").alias("functions"), F.sum("total_lines").alias("total_lines"))


def collisions(modules: DataFrame, packages: DataFrame, name: str = "name") -> DataFrame:
    """Dotted names that are both a module and a package."""
    return modules.select(name).intersect(packages.select(name))
