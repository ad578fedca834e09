"""Language identification with a byte convolutional network, trained in numpy.

The network reads fixed-length windows of UTF-8 bytes: filters two, three and four bytes wide, the largest value of
each filter over the window, and a softmax over the languages. A filter over one-hot bytes is a sum of table
entries, so a width-2 filter is applied by looking up byte pairs.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, give_back, small_batches, text_bytes

#: Bytes of a window; every byte of a text is in one.
WINDOW = 256
#: Filters of each width.
FILTERS = 8
#: Bounds of the labelled sample: documents of a language, windows of a document.
SAMPLE_DOCS = 400
SAMPLE_WINDOWS = 4
EPOCHS = 12
#: A softmax over more languages than this is refused.
MOST_LANGUAGES = 10_000


def windows(text: bytes, size: int = WINDOW) -> np.ndarray:
    """All of ``text`` as rows of ``size`` bytes, the last one filled with zero bytes; no text: no row."""
    data = np.frombuffer(text + bytes(-len(text) % size), np.uint8)
    return data.reshape(-1, size)


class ByteNet:
    """Multi-width byte filters, max pooling, softmax."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = {w: [rng.normal(0, 0.3, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in (2, 3, 4)}
        self.out = rng.normal(0, 0.3, (3 * FILTERS, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def _folded(self):
        """Tables for pairs of bytes, and the single-byte table of width 3."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        t2, t3, t4 = (self.tables[w] for w in (2, 3, 4))
        return pair(*t2), pair(*t3[:2]), t3[2], pair(*t4[:2]), pair(*t4[2:])

    def pooled(self, x: np.ndarray, folded=None, where: bool = False):
        """Largest filter values of each window, and where they are if asked."""
        w2, w3, last3, first4, last4 = folded or self._folded()
        pairs = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        maps = (w2[pairs], w3[pairs[:, :-1]] + last3[x[:, 2:]], first4[pairs[:, :-2]] + last4[pairs[:, 2:]])
        best = np.concatenate([m.max(axis=1) for m in maps], axis=1)
        return (best, [m.argmax(axis=1) for m in maps]) if where else best

    def probabilities(self, x: np.ndarray, folded=None) -> np.ndarray:
        z = np.maximum(self.pooled(x, folded), 0) @ self.out + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05, seed: int = 11) -> ByteNet:
        """Adagrad on batches of 64 windows; classes weigh alike however many windows they have."""
        rng = np.random.default_rng(seed)
        weight = (len(y) / np.maximum(np.bincount(y, minlength=len(self.languages)), 1) / len(self.languages)).astype(np.float32)
        params = [self.out, self.bias, *(t for w in (2, 3, 4) for t in self.tables[w])]
        memory = [np.full_like(p, 1e-6) for p in params]
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
                xb, yb = x[rows], y[rows]
                best, where = self.pooled_small(xb)
                act = np.maximum(best, 0)
                z = act @ self.out + self.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p *= (weight[yb] / len(yb))[:, None]
                back = (p @ self.out.T) * (best > 0)
                grads = [act.T @ p, p.sum(axis=0)]
                for k, w in enumerate((2, 3, 4)):
                    part = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(w):
                        g = np.zeros((256, FILTERS), np.float32)
                        np.add.at(g, (np.take_along_axis(xb, where[k] + j, axis=1), np.arange(FILTERS)[None, :]), part)
                        grads.append(g)
                for p_, m, g in zip(params, memory, grads, strict=True):
                    m += g * g
                    p_ -= rate * g / np.sqrt(m)
        return self

    def pooled_small(self, x: np.ndarray):
        """As ``pooled`` with places, without building the pair tables: for training."""
        maps = []
        for w in (2, 3, 4):
            n = x.shape[1] - w + 1
            maps.append(sum(self.tables[w][j][x[:, j : j + n]] for j in range(w)))
        return np.concatenate([m.max(axis=1) for m in maps], axis=1), [m.argmax(axis=1) for m in maps]


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs: int = SAMPLE_DOCS, per_doc: int = SAMPLE_WINDOWS) -> ByteNet:
    """Fit the network on a bounded sample: about ``docs`` documents of a language, ``per_doc`` windows of each.

    Documents are chosen by a hash of ``key``, windows evenly over the whole document. Rows with a null language,
    null or empty text or a null key aren't learnt from. Without any row the network knows no language.
    """
    small_batches(df.sparkSession)
    known = df.where(F.col(lang).isNotNull() & (F.octet_length(text) > 0) & F.col(key).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang).agg(F.count("*")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"{lang} has over {MOST_LANGUAGES} values")
    share = F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, docs / n)))) if counts else None
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / (1 << 30)
    chosen = known.where(draw < share[F.col(lang)]) if counts else known

    def pick(batches):
        for batch in batches:
            langs, data = [], []
            for name, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                every = windows(raw)
                for i in sorted({int(k * len(every) / per_doc) for k in range(per_doc)}):
                    langs.append(name)
                    data.append(every[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(data, pa.binary())], ["lang", "data"])

    sample = chosen.select(F.col(lang).cast("string"), F.col(text)).mapInArrow(pick, "lang string, data binary").toArrow().sort_by([("lang", "ascending"), ("data", "ascending")])
    names = sample.column("lang").to_pylist()
    net = ByteNet(sorted(set(names)))
    if names:
        x = np.frombuffer(b"".join(sample.column("data").to_pylist()), np.uint8).reshape(-1, WINDOW)
        net.fit(x, np.searchsorted(np.array(net.languages), np.array(names)))
    return net


@functools.lru_cache(maxsize=2)
def _loaded(data: bytes):
    net = pickle.loads(data)
    return net, net._folded()


def _has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def identify(df: DataFrame, net: ByteNet, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``, from all windows of the whole text.

    Probabilities are averaged over windows by their bytes. A text that is null or has no letter, or any text if
    the network knows no language, is ``und`` with score 0.
    """
    small_batches(df.sparkSession)
    data = pickle.dumps(net)

    @F.arrow_udf("lang_pred string, score double")
    def predict(column: pa.Array) -> pa.Array:
        net, folded = _loaded(data)
        texts = text_bytes(column)
        known = [bool(net.languages) and bool(t) and _has_letter(t) for t in texts]
        sums = np.zeros((len(texts), max(1, len(net.languages))))
        queue, owner, held = [], [], 0

        def flush():
            x, who = np.concatenate(queue), np.concatenate(owner)
            for at in range(0, len(x), 256):
                part = x[at : at + 256]
                np.add.at(sums, who[at : at + 256], net.probabilities(part, folded) * (part != 0).sum(axis=1, keepdims=True))

        for i, raw in enumerate(texts):
            if known[i]:
                queue.append(windows(raw))
                owner.append(np.full(len(queue[-1]), i))
                held += len(queue[-1])
                if held > 4096:
                    flush()
                    queue, owner, held = [], [], 0
        if queue:
            flush()
        best = sums.argmax(axis=1)
        score = sums.max(axis=1) / np.maximum(sums.sum(axis=1), 1e-9)
        give_back()
        names = [net.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
        scores = [float(s) if k else 0.0 for s, k in zip(score, known, strict=True)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    # else a filter on the result would be pushed below and have every text read twice
    predict = predict.asNondeterministic()
    return df.withColumn("_lang", predict(F.col(text))).withColumn("lang_pred", F.col("_lang.lang_pred")).withColumn("score", F.col("_lang.score")).drop("_lang")


def held_out(column: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of the id's text modulo 4 is 2. Null ids aren't held out."""
    return F.coalesce(crc_remainder(column, 4) == 2, F.lit(False))
