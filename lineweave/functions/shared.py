"""Tables in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A text is common if it is more than one in so many rows; there are fewer common texts than that.
COMMON = 10_000
#: Characters of a text that may be common.
SHORT = 256


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; below a temporary one where ``spark.checkpoint.dir`` is unset and Spark is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    shared = shared or tempfile.mkdtemp(prefix="lineweave-")
    return f"{shared.rstrip('/')}/lineweave/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from the shared folder, where its lineage ends."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """:func:`written` with the path, for :func:`drop`."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def compact(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """``df``, added to a table at ``path`` in a form that takes little disk; its shuffle files go when it is written."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        # version 2 stores numbers by their differences
        df.write.mode(mode).option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove tables of :func:`written_at` that nothing reads any more, on whatever file system they are."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def each_once(rows: DataFrame, judge: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
    """``judge(rows)``, where ``judge`` adds columns that follow from the text alone: common short texts are judged once, not in every row.

    Their rows get what was found by a broadcast join, so that no row is shuffled for it; all other rows are judged one by one.
    """
    total = rows.count()
    counts = rows.where(F.length(text) <= SHORT).groupBy(text).agg(F.count("*").alias("_n"))
    common = written(counts.where(F.col("_n") * COMMON > total).select(text), "common")
    if common.isEmpty():
        return judge(rows)
    often = rows.join(F.broadcast(written(judge(common), "judged")), text)
    seldom = judge(rows.join(F.broadcast(common), text, "left_anti").select(*rows.columns))
    return seldom.unionByName(often.select(*seldom.columns))
