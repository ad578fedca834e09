"""Incremental versions of the feed, the hash chain and the goal counts: an extension, streams aren't in the reference."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType, LongType

from ..functions.canonical import canonical_hash
from ..operators.classify import string_class


def new_files(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def first_seen(artifacts: DataFrame, ts: str = "ts", digest: str = "hash", late: str = "1 hour") -> DataFrame:
    """Each artifact once, although it is sent again within the watermark."""
    return artifacts.withWatermark(ts, late).dropDuplicatesWithinWatermark([digest])


def class_counts(texts: DataFrame, ts: str = "ts", text: str = "text", every: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, class, count) of strings per tumbling window; rows later than the watermark are dropped."""
    return texts.withWatermark(ts, late).groupBy(F.window(ts, every), string_class(text).alias("class")).agg(F.count("*").alias("count"))


class _Chain(StatefulProcessor):
    """Keeps a scope's last sequence number and state hash."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("sequence", LongType()), StructField("state_hash", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = self.last.get() if self.last.exists() else None
        sequence, previous = (got[0], got[1]) if got else (-1, None)
        batch = pd.concat(list(rows)).sort_values("ord", kind="stable")
        out = []
        for r in batch.itertuples():
            good = r.ord == sequence + 1  # a gap or a late entry is reported, not linked
            out.append((key[0], r.ord, r.state_hash, previous if good else None, good))
            if good:
                sequence, previous = sequence + 1, r.state_hash
        if previous is not None:
            self.last.update(Row(sequence=sequence, state_hash=previous))
        yield pd.DataFrame(out, columns=["scope", "sequence", "state_hash", "previous_hash", "linked"])

    def close(self) -> None:
        pass


def chained(entries: DataFrame, scope: str, order: str, payload: list[str]) -> DataFrame:
    """(scope, sequence, state_hash, previous_hash, linked): entries of a stream linked to the one before, across batches.

    ``order`` numbers a scope's entries from 0. Needs the RocksDB state store.
    """
    hashed = entries.select(F.col(scope).cast("string").alias("scope"), F.col(order).cast("long").alias("ord"), canonical_hash(**{c: F.col(c) for c in payload}).alias("state_hash"))
    return hashed.groupBy("scope").transformWithStateInPandas(_Chain(), "scope string, sequence long, state_hash string, previous_hash string, linked boolean", "append", "none")
