"""Shared helpers: tables in the cluster's shared folder, connected components, packed columns."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and Spark is local (tests), a temporary one, which is then set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        path = tempfile.mkdtemp(prefix="lineweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/lineweave/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table written by :func:`cut`, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, each action's shuffle files go when the action ends, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back, with its path: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with released_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str) -> DataFrame:
    """:func:`written` without the path."""
    return written(df, name)[0]


def crc_remainder(column: str, modulus: int):
    """crc32 of the column's text modulo ``modulus``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python in batches of 1,000 rows, unless the session has another size than Spark's own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def give_back() -> None:
    """Return freed memory to the system: Python workers stay for later tasks, beside an executor that needs its own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: its own where it is printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in printable)
    letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [letters[b] for b in range(256)]


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions start[0], start[0] + 1, ... of each span in turn."""
    length = length.astype(np.int64)
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes: high bytes are mostly alike and nearly vanish."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd").compress(planes, asbytes=True)


def unpack(data: bytes, dtype) -> np.ndarray:
    """Inverse of :func:`pack`."""
    n, width = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    planes = pa.Codec("zstd").decompress(data[8:], decompressed_size=n * width, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(dtype).reshape(n)


def whole_keys(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroup a key-sorted stream of batches so that no key is split between two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1]))
        if last or held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of one task reduced to stars with the same connected components: (node, smallest node)."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], low)
        np.minimum.at(after, label[y], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def forest_of_partitions(edges: DataFrame) -> DataFrame:
    """(src, dst) edges, with each partition's reduced to stars; components stay what they were."""

    def reduce(batches):
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            a, b = local_forest(np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])

    return edges.select("src", "dst").mapInArrow(reduce, "src long, dst long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (src, dst) long edges as (node, component), component being the smallest node.

    Alternates large-star and small-star steps, whose joins Spark can split when a node is hot, until nothing
    changes; each round is written to the shared folder. Nodes without an edge to another node aren't returned.
    """
    spark = edges.sparkSession
    now = edges.where("src is not null and dst is not null and src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    now, path = written(forest_of_partitions(now).distinct(), "components")
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first()
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        least = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(least, "src").where("dst != low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        before, (now, path) = path, written(small.unionByName(least.withColumnRenamed("low", "dst")).distinct(), "components")
        drop_path(spark, before)
        last, seen = seen, mark(now)
        if last == seen:
            break
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
