"""A keyed table that grows by batches, the last write of a key being what counts.

Each batch is a run, a folder of its own with one row for each of its keys. A reader joins the runs by key and takes the
youngest. Compaction writes what the runs say together as one run that replaces them, and drops them; a run counts from
when it is written whole, so a writer that fails, or is run again, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import drop


class KeyedLog:
    """Runs below ``path``: ``run-N``, and ``base-N`` for all up to N. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def _folders(self) -> list[tuple[int, str]]:
        """(number, name) of what counts: the last base, and later runs."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        files = top.getFileSystem(conf)
        if not files.exists(top):
            return []
        names = [str(s.getPath().getName()) for s in files.listStatus(top)]
        whole = [n for n in names if n.startswith(("run-", "base-")) and files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        numbered = sorted((int(n.split("-")[1]), n.startswith("base-"), n) for n in whole)
        base = max((number for number, is_base, _ in numbered if is_base), default=-1)
        return [(number, name) for number, is_base, name in numbered if number > base or is_base and number == base]

    def put(self, batch: DataFrame, order: str) -> int:
        """Add a batch; of a key's rows the one with the greatest ``order`` is taken. Null keys are left out. Returns the run's number."""
        rest = F.struct(*(c for c in batch.columns if c not in (self.key, order)))
        # of equal orders the greatest row, so that a task run again takes the same
        last = batch.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(rest, F.struct(F.col(order), rest.alias("r"))).alias("r")).select(self.key, "r.*")
        number = max((n for n, _ in self._folders()), default=0) + 1
        self._write(last, f"run-{number:08d}")
        return number

    def _write(self, rows: DataFrame, name: str) -> None:
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], self.schema).schema]
        rows.select(*columns).repartition(self.key).sortWithinPartitions(self.key).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def read(self) -> DataFrame:
        """One row for each key: that of its youngest run."""
        found = self._folders()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        runs = [self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}") for _, name in found]
        if len(runs) == 1:
            return runs[0]
        both = None
        for (number, _), run in zip(found, runs, strict=True):
            marked = run.withColumn("_run", F.lit(number))
            both = marked if both is None else both.unionByName(marked)
        rest = F.struct(*(c for c in runs[0].columns if c != self.key))
        return both.groupBy(self.key).agg(F.max_by(rest, "_run").alias("r")).select(self.key, "r.*").select(*runs[0].columns)

    def compact(self) -> None:
        """One run out of all. Readers that began before may fail, and are to be run again."""
        found = self._folders()
        if len(found) < 2:
            return
        self._write(self.read(), f"base-{found[-1][0]:08d}")
        drop(self.spark, *(f"{self.path}/{name}" for _, name in found))
