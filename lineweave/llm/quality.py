"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Random indexing: every bucket of a hashed vocabulary has a fixed sparse random index vector; a word's vector is
the sum, over all documents, of the index vectors of the words that it occurs with. The hashed vocabulary has a
fixed number of buckets, so that the table of word vectors has the same few MB for any corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, drop_path, small_batches, text_bytes, written

#: Buckets of the hashed vocabulary, and the length of a word vector: a table of 4 MB.
BUCKETS, WIDTH = 1 << 15, 32
#: Non-zero entries of an index vector.
NONZERO = 4
#: Bound of the labelled sample.
SAMPLE = 20_000
HIDDEN = 32
#: Scores from here on are predicted as label 1.
CUT = 0.3
_ROWS = 1024
#: Tasks whose sums are added at once.
FAN = 32


def index_vectors(seed: int = 5) -> np.ndarray:
    """The fixed random index vectors: a few entries of +1 or -1 for each bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    for _ in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, WIDTH, BUCKETS)] += rng.choice(np.array([-1, 1], np.float32), BUCKETS)
    return out


class _Buckets(dict):
    """Word to bucket; forgets what it holds when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = found = zlib.crc32(word) % BUCKETS
        return found


def _bucketed(text: bytes, of: _Buckets) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(of.__getitem__, words), np.int64, len(words))


def word_vectors(df: DataFrame, text: str = "text") -> np.ndarray:
    """Word vectors from all documents, scaled to length 1: a table of fixed size.

    A word gathers the mean index vector of each document that it occurs in, once for each time. Tasks sum their
    own documents; blocks of the table are then summed in a tree, ``FAN`` tasks at a time.
    """

    def gather(batches):
        index, of, total = index_vectors(), _Buckets(), np.zeros((BUCKETS, WIDTH), np.float32)
        for batch in batches:
            for raw in text_bytes(batch.column(0)):
                ids = _bucketed(raw, of)
                if len(ids):
                    found, times = np.unique(ids, return_counts=True)
                    total[found] += np.outer(times, times.astype(np.float32) @ index[found] / len(ids))
        task = TaskContext.get().partitionId()
        for at in range(0, BUCKETS, _ROWS):
            part = total[at : at + _ROWS]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([at]), pa.array([part.tobytes()], pa.binary())], ["task", "at", "part"])

    def add(key, table):
        parts = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table.column("part").to_pylist())
        return pa.table({"task": pa.array([key[0].as_py()], pa.int64()), "at": pa.array([key[1].as_py()], pa.int64()), "part": pa.array([parts.astype(np.float32).tobytes()], pa.binary())})

    schema = "task long, at long, part binary"
    sums, path = df.select(F.col(text)).mapInArrow(gather, schema), None
    while True:
        before, (sums, path) = path, written(sums.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("task", "at").applyInArrow(add, schema), "sums")
        if before:
            drop_path(df.sparkSession, before)
        if not sums.agg(F.max("task")).first()[0]:
            break
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    for _, at, part in sums.collect():  # a table of fixed size
        out[at : at + _ROWS] = np.frombuffer(part, np.float32).reshape(-1, WIDTH)
    drop_path(df.sparkSession, path)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(text: bytes, vectors: np.ndarray, of: _Buckets) -> np.ndarray:
    """Mean and spread of the word vectors of one whole document, and its logarithmic length; no words: zeros."""
    ids = _bucketed(text, of)
    if not len(ids):
        return np.zeros(2 * WIDTH + 2, np.float32)
    found, times = np.unique(ids, return_counts=True)
    share = (times / len(ids)).astype(np.float32)
    mean = share @ vectors[found]
    return np.concatenate([mean, np.sqrt(np.maximum(share @ vectors[found] ** 2 - mean**2, 0)), [np.log1p(len(ids)), len(found) / len(ids)]]).astype(np.float32)


class QualityNet:
    """A tanh layer and a logistic output, trained with Adam; probabilities are calibrated by a temperature."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        n = 2 * WIDTH + 2
        self.params = [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.mean, self.scale, self.temperature = np.zeros(n), np.ones(n), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.params
        return np.tanh((x - self.mean) / self.scale @ w + b) @ v + c

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3, seed: int = 9) -> QualityNet:
        """Train on four fifths of the rows, fit the temperature on the rest. One class only: a constant score."""
        if not len(y) or y.min() == y.max():
            self.params[2][:] = 0
            self.params[3][:] = 0 if not len(y) else 8.0 * (2 * y[0] - 1)
            return self
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        rest, own = np.split(order, [len(y) // 5])
        self.mean, self.scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
        m, s, step = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(own), max(1, len(own) // 256)):
                z = (x[rows] - self.mean) / self.scale
                w, b, v, c = self.params
                h = np.tanh(z @ w + b)
                e = (1 / (1 + np.exp(-np.clip(h @ v + c, -60, 60))) - y[rows]) / len(rows)
                back = np.outer(e, v) * (1 - h * h)
                step += 1
                for i, g in enumerate((z.T @ back + 1e-4 * w, back.sum(axis=0), h.T @ e, e.sum(keepdims=True))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    s[i] = 0.999 * s[i] + 0.001 * g * g
                    self.params[i] = self.params[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
        if len(rest):
            z = self.logits(x[rest])
            loss = lambda t: np.mean(np.logaddexp(0, -(2 * y[rest] - 1) * z / t))
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
        return self


def _features(vectors):
    of = _Buckets()

    def of_texts(column: pa.Array) -> np.ndarray:
        rows = [pooled(x, vectors.value, of) for x in text_bytes(column)]
        return np.array(rows, np.float32).reshape(len(rows), -1)

    return of_texts


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """(id, ``held_out``, ``score``, ``predicted``) for every row of ``df``.

    Labels are learnt from rows whose crc32(id) modulo ``folds`` isn't 0, at most ``sample`` of them, chosen by a
    hash of the id; word vectors use all texts. Null and empty texts have no words and get the score of that. A
    null id has no label and isn't held out. Without labels every score is 0.5. Repeated labels count once.
    """
    spark = df.sparkSession
    small_batches(spark)
    vectors = spark.sparkContext.broadcast(word_vectors(df, text))
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & (crc_remainder("id", folds) != 0))
    chosen = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)

    @F.arrow_udf("array<float>")
    def features(column: pa.Array) -> pa.Array:
        x = _features(vectors)(column)
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))

    # the sample's size is bounded by the parameter, so it can be broadcast
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "y", features("text").alias("x"))
    learnt = rows.toPandas().sort_values("id", kind="stable").drop_duplicates("id")
    net = QualityNet().fit(np.stack(learnt["x"]).astype(np.float64) if len(learnt) else np.empty((0, 2 * WIDTH + 2)), learnt["y"].to_numpy(np.float64))
    shipped = spark.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def rate(column: pa.Array) -> pa.Array:
        return pa.array(shipped.value.scores(_features(vectors)(column).astype(np.float64)))

    out = df.select(F.col(id_col), F.coalesce(crc_remainder(id_col, folds) == 0, F.lit(False)).alias("held_out"), rate(F.col(text)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))
