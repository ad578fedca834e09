"""Comparing JSON documents by their structure: a row for each path at which two forms differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import written


def _shape(v: str) -> Column:
    """object, array or value; a container without anything in it counts as a value."""
    text = F.schema_of_variant(v)
    return F.when(F.startswith(text, F.lit("OBJECT<")) & (text != "OBJECT<>"), "object").when(F.startswith(text, F.lit("ARRAY<")) & (F.to_json(v) != "[]"), "array").otherwise("value")


def leaves(rows: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, value): the values of JSON texts, as JSON, by where they stand: ``$["a"][0]``.

    Documents are parsed once, as variants, and opened level by level, all of them at once; there are as many rounds as the
    deepest has levels. Empty objects and arrays are values. Null documents have none; text that isn't JSON is the one
    value of the path ``?``, as text, so that only equal faults are equal.
    """
    parsed = rows.where(F.col(document).isNotNull()).select(F.col(key).alias("_key"), F.col(document).alias("_text"), F.try_parse_json(document).alias("v"))
    broken = parsed.where("v is null").select("_key", F.lit("?").alias("path"), F.col("_text").alias("value"))
    spark, found = rows.sparkSession, [broken]
    # between rounds the rest is kept as JSON text: a variant has no place in every format
    level = parsed.where("v is not null").select("_key", F.lit("$").alias("path"), "v")
    while True:
        now = written(level.withColumn("shape", _shape("v")).select("_key", "path", "shape", F.to_json("v").alias("value")), "levels")
        found.append(now.where("shape = 'value'").select("_key", "path", "value"))
        inner = now.where("shape != 'value'")
        if not inner.limit(1).count():
            return reduce(DataFrame.unionByName, found).withColumnRenamed("_key", key)
        opened = inner.select("_key", "path", "shape", F.parse_json("value").alias("doc")).lateralJoin(spark.tvf.variant_explode(F.col("doc").outer()))
        step = F.when(F.col("shape") == "object", F.concat(F.lit("["), F.to_json(F.array("key")), F.lit("]"))).otherwise(F.concat(F.lit("[["), F.col("pos").cast("string"), F.lit("]]")))
        level = opened.select("_key", F.concat("path", F.substring(step, F.lit(2), F.length(step) - 2)).alias("path"), F.col("value").alias("v"))


def differences(expected: DataFrame, actual: DataFrame, key: str, document: str = "document") -> DataFrame:
    """(key, path, status, expected, actual): where documents of a key differ: changed, missing or unexpected.

    Keys are distinct and not null. Documents with the same values at the same paths are equal, whatever the order of their
    keys and their white space; a document that one side lacks is missing or unexpected at each of its paths.
    """
    a, b = (leaves(df, key, document).withColumnRenamed("value", name) for df, name in ((expected, "expected"), (actual, "actual")))
    both = a.join(b, [key, "path"], "full")
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").otherwise("changed")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual"))).select(key, "path", status.alias("status"), "expected", "actual")
