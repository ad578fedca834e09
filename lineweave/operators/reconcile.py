"""Planned against observed changes: multiset matching, counts, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIGH, MODERATE = 0.95, 0.80


def reconcile(planned: DataFrame, observed: DataFrame, path: str = "path", signature: tuple[str, ...] = ("before", "after"), order: str = "ord") -> DataFrame:
    """(path, signature, n, status): the n-th planned change matches the n-th observed one of the same path and signature.

    ``status`` is matched, missing (only planned) or unexpected (only observed). Nulls in a signature are equal. A
    signature may add the change's type, which the documented rule leaves out.
    """
    keys = [path, *signature]

    def numbered(df: DataFrame, flag: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
        return df.select(*keys, n.alias("n"), F.lit(True).alias(flag))

    a, b = numbered(planned, "p").alias("a"), numbered(observed, "o").alias("b")
    same = F.col("a.n") == F.col("b.n")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    status = F.when(F.col("p") & F.col("o"), "matched").when(F.col("p"), "missing").otherwise("unexpected")
    return a.join(b, same, "full_outer").select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), F.coalesce("a.n", "b.n").alias("n"), status.alias("status"))


def summary(matched: DataFrame, *by: str) -> DataFrame:
    """Counts of each status, per ``by`` or in total."""
    return matched.groupBy(*by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("matched", "missing", "unexpected")))


def confidence(matched: Column, missing: Column) -> Column:
    """High, Moderate or Low by the share of planned changes that were observed; nothing planned is High."""
    rate = F.when(matched + missing == 0, 1.0).otherwise(matched / (matched + missing))
    return F.when(rate >= HIGH, "High").when(rate >= MODERATE, "Moderate").otherwise("Low")


def scope_mismatch(expected: DataFrame, observed: DataFrame, path: str = "path") -> DataFrame:
    """(path, side) of files that only one side has."""
    a, b = expected.select(path).distinct(), observed.select(path).distinct()
    return a.join(b, path, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, path, "left_anti").withColumn("side", F.lit("unexpected")))


def verify(planned: DataFrame, observed: DataFrame, strict: bool = False, path: str = "path", signature: tuple[str, ...] = ("before", "after"), order: str = "ord") -> DataFrame:
    """One row: counts, files out of scope, confidence and ``verified``; strict mode fails on any file out of scope."""
    counts = summary(reconcile(planned, observed, path, signature, order))
    out = scope_mismatch(planned, observed, path).agg(F.count("*").alias("out_of_scope"))
    both = counts.withColumn("one", F.lit(1)).join(out.withColumn("one", F.lit(1)), "one").drop("one")
    equal = (F.col("missing") == 0) & (F.col("unexpected") == 0)
    ok = equal & (F.col("out_of_scope") == 0) if strict else equal
    return both.withColumns({"confidence": confidence(F.col("matched"), F.col("missing")), "verified": ok})
