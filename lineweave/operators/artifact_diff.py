"""Keyed comparison of two artifacts: added, removed and modified changes with field deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields that don't count as a difference.
IGNORED = ("confidence", "notes")


def change_id(explicit: str = "id", file: str = "file", line: str = "line", identity: str = "original") -> Column:
    """The explicit id, or file, line and identity joined by colons."""
    return F.coalesce(F.col(explicit), F.concat_ws(":", F.coalesce(file, F.lit("")), F.coalesce(F.col(line).cast("string"), F.lit("")), F.coalesce(identity, F.lit(""))))


def parse_change_id(c: Column) -> Column:
    """file, line and content of an id; the content may hold colons."""
    parts = F.split(c, ":", 3)
    return F.struct(F.get(parts, F.lit(0)).alias("file"), F.get(parts, F.lit(1)).try_cast("int").alias("line"), F.get(parts, F.lit(2)).alias("content"))


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: of repeated keys the last stays."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def diff(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, status, change_type, differences) of keys that differ.

    ``differences`` maps a field to its two values as text. A modified row's change type is schema_drift if every
    difference has a null side, else semantic.
    """
    fields = [f for f in fields if f not in IGNORED]
    x, y = a.select(key, F.lit(1).alias("in_a"), *fields).alias("x"), b.select(key, F.lit(1).alias("in_b"), *fields).alias("y")
    both = x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "full_outer")
    side = lambda s, f: F.col(f"{s}.{f}").cast("string")
    changed = F.array_compact(F.array(*(F.when(~side("x", f).eqNullSafe(side("y", f)), F.struct(F.lit(f).alias("field"), side("x", f).alias("A"), side("y", f).alias("B"))) for f in fields)))
    status = F.when(F.col("in_b").isNull(), "removed").when(F.col("in_a").isNull(), "added").when(F.size(changed) > 0, "modified").otherwise("same")
    drift = F.forall(changed, lambda d: d.A.isNull() | d.B.isNull())
    rows = both.select(F.coalesce(f"x.{key}", f"y.{key}").alias(key), status.alias("status"), changed.alias("deltas"), drift.alias("drift"))
    kind = F.when(F.col("status") == "modified", F.when(F.col("drift"), "schema_drift").otherwise("semantic"))
    return rows.where("status != 'same'").select(key, "status", kind.alias("change_type"), F.map_from_entries(F.transform("deltas", lambda d: F.struct(d.field, F.struct(d.A, d.B)))).alias("differences"))


def summary(differences: DataFrame, *by: str) -> DataFrame:
    """Counts of added, removed and modified, per ``by`` or in total."""
    return differences.groupBy(*by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "modified")))


def node_type(added: Column, removed: Column, modified: Column, has_parent: Column) -> Column:
    """root without a parent, noop without a difference, else derived."""
    return F.when(~has_parent, "root").when(added + removed + modified == 0, "noop").otherwise("derived")


def ordered(differences: DataFrame, line: str = "line") -> DataFrame:
    """By line, null lines first, then removed before added before modified."""
    rank = F.when(F.col("status") == "removed", 0).when(F.col("status") == "added", 1).otherwise(2)
    return differences.orderBy(F.col(line).asc_nulls_first(), rank)


def helper_lifecycle(a: DataFrame, b: DataFrame, key: str = "helper_ref") -> DataFrame:
    """(key, status): helpers that only b refers to are added, those that only a refers to are removed."""
    x, y = (df.select(key).where(F.col(key).isNotNull()).distinct() for df in (a, b))
    return reduce(DataFrame.unionByName, (y.join(x, key, "left_anti").withColumn("status", F.lit("added")), x.join(y, key, "left_anti").withColumn("status", F.lit("removed"))))
