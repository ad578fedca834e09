"""Substring dedup with a log-structured fingerprint index.

The index holds the fingerprints of all windows of words seen so far. Documents enter it in order of ids, so that a
window that it holds has started in a document with a smaller id. It consists of sorted immutable runs: each new batch of documents is merge-joined with the runs bucket by bucket, its own windows
become a new run, and runs of one level are compacted into a run of the next. A window is keyed by a 64-bit
fingerprint, and a match is verified by a second, independent fingerprint of 16 bits of the same word sequence.

Within a batch, documents are dealt into blocks. A block sends its distinct windows to the buckets as packed
columns and gets back one bit for each, so that neither texts nor positions travel.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, give_back, pack, released_shuffles, scratch, small_batches, text_bytes, unpack

WINDOW = 13
#: Text bytes of a block, and for each bucket of the index.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20
#: Batches that one call of ``remove_repeats`` adds to the index, in order of ids.
BATCHES = 3
#: Runs of a level that are compacted into one of the next level.
FANOUT = 2
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _windows(texts: list[bytes], size: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Words by text; fingerprint, check and text number of every window in order."""
    number: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    flat = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) for words in split]
    digest = xxhash.xxh64_intdigest
    values = [np.fromiter((digest(w, seed) for w in number), np.uint64, len(number)) for seed in (1, 2)]
    keys, checks, owner = [], [], []
    for i, ids in enumerate(flat):
        n = len(ids) - size + 1
        if n > 0:
            a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            x, y = values[0][ids], values[1][ids]
            for j in range(size):
                a = a * _MULTIPLIERS[0] + x[j : j + n]
                b = b * _MULTIPLIERS[1] + y[j : j + n]
            keys.append(a)
            checks.append((b >> np.uint64(48)).astype(np.uint16))
            owner.append(np.full(n, i, np.int64))
    none = lambda dtype: [np.empty(0, dtype)]
    return split, np.concatenate(keys or none(np.uint64)), np.concatenate(checks or none(np.uint16)), np.concatenate(owner or none(np.int64))


def _distinct(keys: np.ndarray, checks: np.ndarray, ids: np.ndarray):
    """Sorted distinct (key, check) with the smallest id of each, and each entry's place among them."""
    order = np.lexsort((ids, checks, keys))
    k, c, i = keys[order], checks[order], ids[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(first) - 1
    return k[first], c[first], i[first], place


def _bucket_starts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts in sorted keys: buckets are ranges of keys."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))


def _block(docs: pa.Table, size: int):
    """A block's documents, windows and distinct windows; documents without an id own no windows."""
    docs = docs.sort_by("id")
    ids = docs.column("id").to_numpy(zero_copy_only=False)
    real = ~docs.column("id").is_null().to_numpy(zero_copy_only=False)
    texts = text_bytes(docs.column("text"))
    split, keys, checks, owner = _windows(texts, size)
    own = real[owner] if len(owner) else np.empty(0, bool)
    doc = np.where(real, ids, 0).astype(np.int64)
    window_ids = doc[owner] if len(owner) else np.empty(0, np.int64)
    return docs, split, owner, own, window_ids, _distinct(keys[own], checks[own], window_ids[own])


_RUN = "keys binary, checks binary"
_PACKED = f"{_RUN}, firsts binary"


def _emit(size: int, buckets: int):
    def emit(key, docs):
        k, c, i, _ = _block(docs, size)[-1]
        start = _bucket_starts(k, buckets)
        full = [b for b in range(buckets) if start[b] < start[b + 1]]
        cols = [[pack(np.diff(x[start[b] : start[b + 1]], prepend=x.dtype.type(0)) if x is k else x[start[b] : start[b + 1]]) for b in full] for x in (k, c, i)]
        give_back()
        return pa.table({"block": pa.array([key[0].as_py()] * len(full), pa.int64()), "bucket": pa.array(full, pa.int32())} | {n: pa.array(x, pa.binary()) for n, x in zip(("keys", "checks", "firsts"), cols, strict=True)})

    return emit


def _open(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    rows = zip(*(table.column(c).to_pylist() for c in ("keys", "checks")), strict=True)
    return [(np.cumsum(unpack(k, np.uint64), dtype=np.uint64), unpack(c, np.uint16)) for k, c in rows]


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([p[n] for p in parts] or [np.empty(0, d)]) for n, d in enumerate((np.uint64, np.uint16)))


def _run_row(bucket: int, keys: np.ndarray, checks: np.ndarray) -> dict:
    return {"bucket": pa.array([bucket], pa.int32()), "keys": pa.array([pack(np.diff(keys, prepend=np.uint64(0)))], pa.binary()), "checks": pa.array([pack(checks)], pa.binary())}


def _merge(key, history, batch):
    """One bucket: a flag for each of the batch's windows that has an earlier owner, and the batch's new run."""
    new = _open(batch)
    was, now = _joined(_open(history)), _joined(new)
    own = np.concatenate([unpack(x, np.int64) for x in batch.column("firsts").to_pylist()] or [np.empty(0, np.int64)])
    # what the index holds comes before any id of the batch
    ids = np.concatenate([np.full(len(was[0]), np.iinfo(np.int64).min), own])
    k, c, i, place = _distinct(np.concatenate([was[0], now[0]]), np.concatenate([was[1], now[1]]), ids)
    late = own > i[place[len(was[0]) :]]
    fresh = np.ones(len(k), bool)
    fresh[place[: len(was[0])]] = False
    ends = np.cumsum([len(x[0]) for x in new], dtype=np.int64)
    flags = [np.packbits(late[e - len(x[0]) : e]).tobytes() for e, x in zip(ends, new, strict=True)]
    n = len(flags)
    flag_rows = pa.table({"kind": pa.array(["flag"] * n, pa.string()), "block": batch.column("block"), "bucket": batch.column("bucket"), "keys": pa.nulls(n, pa.binary()), "checks": pa.nulls(n, pa.binary()), "flags": pa.array(flags, pa.binary())})
    if not fresh.any():
        return flag_rows
    run = pa.table({"kind": pa.array(["run"]), "block": pa.nulls(1, pa.int64())} | _run_row(key[0].as_py(), k[fresh], c[fresh]) | {"flags": pa.nulls(1, pa.binary())})
    return pa.concat_tables([flag_rows, run])


def _compact(key, runs):
    keys, checks = _joined(_open(runs))
    k, c, _, _ = _distinct(keys, checks, np.zeros(len(keys), np.int8))
    return pa.table(_run_row(key[0].as_py(), k, c))


class FingerprintIndex:
    """Runs of window fingerprints in the shared folder. ``buckets`` is fixed when the index is made."""

    def __init__(self, spark: SparkSession, buckets: int, size: int = WINDOW, fanout: int = FANOUT):
        self.spark, self.buckets, self.size, self.fanout = spark, buckets, size, fanout
        self.runs: list[tuple[int, str]] = []

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(f"bucket int, {_RUN}").parquet(path)

    def history(self) -> DataFrame:
        """Every run's rows (bucket, packed sorted columns)."""
        out = self.spark.createDataFrame([], f"bucket int, {_RUN}")
        for _, path in self.runs:
            out = out.unionByName(self._read(path))
        return out

    def add(self, blocks: DataFrame, keep: bool = True) -> DataFrame:
        """Add a batch of (id, text, block); returns its flags (block, bucket, flags) and appends a run.

        Without ``keep`` the batch is only looked up: for the last batch before an index is dropped.
        """
        emitted = blocks.groupBy("block").applyInArrow(_emit(self.size, self.buckets), f"block long, bucket int, {_PACKED}")
        merged = self.history().groupBy("bucket").cogroup(emitted.groupBy("bucket")).applyInArrow(_merge, f"kind string, block long, bucket int, {_RUN}, flags binary")
        merged = merged if keep else merged.where("kind = 'flag'")
        path = scratch(self.spark, "windows")
        with released_shuffles(self.spark):
            merged.write.partitionBy("kind").parquet(path)
        both = self.spark.read.schema(f"kind string, block long, bucket int, {_RUN}, flags binary").parquet(path)
        if keep and both.where("kind = 'run'").limit(1).count():
            self.runs.append((0, f"{path}/kind=run"))
            self._compact()
        return both.where("kind = 'flag'").select("block", "bucket", "flags")

    def _compact(self) -> None:
        level = 0
        while sum(x == level for x, _ in self.runs) >= self.fanout:
            old = [r for r in self.runs if r[0] == level]
            rows = self._read(old[0][1])
            for _, path in old[1:]:
                rows = rows.unionByName(self._read(path))
            path = scratch(self.spark, "run")
            with released_shuffles(self.spark):
                rows.groupBy("bucket").applyInArrow(_compact, f"bucket int, {_RUN}").write.parquet(path)
            self.runs = [r for r in self.runs if r[0] != level] + [(level + 1, path)]
            for _, gone in old:
                drop_path(self.spark, gone)
            level += 1

    def drop(self) -> None:
        """Remove the runs."""
        for _, path in self.runs:
            drop_path(self.spark, path)
        self.runs = []


def _apply(size: int, buckets: int, keep: bool):
    def apply(key, docs, flags):
        docs, split, owner, own, window_ids, (k, _, i, place) = _block(docs, size)
        start = _bucket_starts(k, buckets)
        late = np.zeros(len(k), bool)
        for bucket, bits in zip(flags.column("bucket").to_pylist(), flags.column("flags").to_pylist(), strict=True):
            a, b = start[bucket], start[bucket + 1]
            late[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
        repeated = np.zeros(len(owner), bool)
        repeated[own] = late[place] | (window_ids[own] > i[place])
        counts = np.bincount(owner, minlength=len(split)) if len(owner) else np.zeros(len(split), np.int64)
        ends = np.cumsum(counts)
        n_words, n_removed, kept = [], [], []
        for words, end, n in zip(split, ends.tolist(), counts.tolist(), strict=True):
            change = np.zeros(len(words) + 1, np.int64)
            if n:
                at = np.flatnonzero(repeated[end - n : end])
                np.add.at(change, at, 1)
                np.add.at(change, at + size, -1)
            gone = np.cumsum(change)[:-1] > 0
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            text = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if n_removed[-1] else words)
            kept.append(text if keep else hashlib.sha256(text).hexdigest())
        del split
        give_back()
        out = {"id": docs.column("id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
        return pa.table(out | ({"kept": pa.array(kept, pa.binary()).cast(pa.string())} if keep else {"kept_sha256": pa.array(kept, pa.string())}))

    return apply


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WINDOW, batches: int = BATCHES, keep: bool = False, index: FingerprintIndex | None = None) -> DataFrame:
    """Remove words covered by a window whose word sequence also starts in a document with a smaller id.

    Returns a row for each row of ``df``: id, ``n_words``, ``n_removed`` and ``kept_sha256``, or the ``kept`` text.
    Null and empty texts have no words. A row with a null id keeps its words and makes no other lose any; rows that
    share an id don't count against each other. Documents are added to the index in order of ids, in ``batches``.
    An ``index`` from earlier calls, whose documents have smaller ids, is looked up and extended; without one, an
    index is made for the call and dropped.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marks = [b / batches for b in range(1, batches)]
    found = rows.agg(F.sum(F.octet_length("text")), F.percentile_approx("id", marks, 10_000) if marks else F.lit(None)).first()
    total, bounds = found[0] or 0, sorted(set(found[1] or []))
    blocks = max(1, -(-total // (BLOCK_BYTES * (len(bounds) + 1))))
    own_index = index is None
    index = index or FingerprintIndex(spark, max(1, -(-total // BUCKET_BYTES)), size)
    batch = F.lit(0)
    for b in bounds:
        batch = batch + (F.col("id") >= b).cast("int")
    rows = rows.select("id", "text", F.coalesce(batch, F.lit(0)).cast("int").alias("batch"), F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).alias("block"))
    flags = None
    for n, (low, high) in enumerate(zip([None, *bounds], [*bounds, None], strict=True)):
        part = rows
        if low is not None:
            part = part.where(F.col("id") >= low)
        if high is not None:
            part = part.where((F.col("id") < high) | F.col("id").isNull()) if n == 0 else part.where(F.col("id") < high)
        own = index.add(part.select("id", "text", "block"), keep=not own_index or n < len(bounds)).withColumn("batch", F.lit(n))
        flags = own if flags is None else flags.unionByName(own)
    if own_index:
        index.drop()
    schema = "id long, n_words long, n_removed long, " + ("kept string" if keep else "kept_sha256 string")
    return rows.groupBy("batch", "block").cogroup(flags.groupBy("batch", "block")).applyInArrow(_apply(size, index.buckets, keep), schema).withColumnRenamed("id", id_col)
