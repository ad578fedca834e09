"""Plain versions of the numeric cores, and pipeline stages on odd rows."""

import math
import zlib

import numpy as np
import pytest

import corpus_pipeline
from lineweave.llm import langid, quality

TEXTS = ["one two two three", "two four", "", None, "é ü one one one", "x " * 300, "four\nfive\tsix two"]


def plain_vectors(texts):
    index, total = quality.index_vectors().astype(float), {}
    for text in texts:
        ids = [zlib.crc32(w) % quality.BUCKETS for w in (text or "").encode().split()]
        for i in ids:
            gathered = sum(index[j] for j in ids) / len(ids)
            total[i] = total.get(i, 0) + gathered
    return {i: v / max(math.sqrt(float(v @ v)), 1e-9) for i, v in total.items()}


def test_word_vectors_against_a_plain_sum(spark, monkeypatch):
    monkeypatch.setattr(quality, "FAN", 2)  # so that sums go through several levels
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(5))
    want = plain_vectors(TEXTS)
    assert {int(i) for i in np.flatnonzero(np.abs(got).sum(axis=1))} <= want.keys()
    for i, v in want.items():
        assert got[i] == pytest.approx(v, abs=1e-5)


def test_pooled_features_against_plain_loops():
    vectors = np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.WIDTH)).astype(np.float32)
    for text in TEXTS:
        got = quality.pooled((text or "").encode(), vectors, quality._Buckets())
        words = [vectors[zlib.crc32(w) % quality.BUCKETS].astype(float) for w in (text or "").encode().split()]
        if not words:
            assert not got.any()
            continue
        mean = sum(words) / len(words)
        spread = np.sqrt(np.maximum(sum((w - mean) ** 2 for w in words) / len(words), 0))
        distinct = len({zlib.crc32(w) % quality.BUCKETS for w in text.encode().split()})
        assert got == pytest.approx(np.concatenate([mean, spread, [math.log1p(len(words)), distinct / len(words)]]), abs=2e-3)


def test_calibration_picks_the_temperature_of_least_loss():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 2 * quality.WIDTH + 2))
    y = (x[:, 0] + rng.normal(0, 2, 600) > 0).astype(float)
    net = quality.QualityNet().fit(x, y)
    rest = np.random.default_rng(9).permutation(600)[:120]
    loss = lambda t: sum(-math.log(p if k else 1 - p) for p, k in zip(1 / (1 + np.exp(-net.logits(x[rest]) / t)), y[rest], strict=True))
    assert loss(net.temperature) <= min(loss(t) for t in (0.25, 0.5, 1, 2, 4, 8)) + 1e-6


def slow_convolution(net, window):
    """Every filter at every place of one window, one byte at a time."""
    best = []
    for width in (2, 3, 4):
        for f in range(langid.FILTERS):
            best.append(max(sum(float(net.tables[width][j][window[at + j], f]) for j in range(width)) for at in range(len(window) - width + 1)))
    z = [sum(max(b, 0.0) * float(net.out[i, k]) for i, b in enumerate(best)) + float(net.bias[k]) for k in range(len(net.languages))]
    e = [math.exp(v - max(z)) for v in z]
    return best, [v / sum(e) for v in e]


def test_convolution_against_plain_loops():
    net = langid.ByteNet(["a", "b", "c"])
    x = langid.windows("Grüße, naïve façade — 12 テスト".encode() * 9)
    for pooled in (net.pooled(x), net.pooled(x, net._folded()), net.pooled_small(x)[0]):
        for row, window in zip(pooled, x, strict=True):
            assert row == pytest.approx(slow_convolution(net, window)[0], abs=1e-4)
    for row, window in zip(net.probabilities(x), x, strict=True):
        assert row == pytest.approx(slow_convolution(net, window)[1], abs=1e-4)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, stage):
    """Null ids, repeated rows, columns with names that the operators use, a very long text, nulls in every column."""
    words = [f"der w{i} und ein" for i in range(40)]
    rows = [(i, f"{words[i % 40]} {i * 7919} {words[(i * 3) % 40]} " * 6, "de" if i % 2 else "en", "s", 9) for i in range(30)]
    rows += [rows[3], rows[3], (None, "ganz allein hier " * 9, "de", None, None), (None, None, None, None, None), (77, "", "de", "s", 0), (78, "lang " * 40000 + "mail a.b@c.org", "de", "s", 5)]
    extra = ("k", 1, 0.5, "d", 2)
    docs = spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, row int, score double, doc string, fp long")
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, None)
    got = out.collect()
    if stage == "tokens":
        assert len(got) == len(rows) and {r.doc_id for r in got} == {r[0] for r in rows}
        assert next(r.n_tokens for r in got if r.doc_id == 77) == 0 and next(r.n_tokens for r in got if r.doc_id == 78) > 40000
        return
    assert out.columns == docs.columns
    kept = [r.doc_id for r in got]
    assert {r.key for r in got} == {"k"}
    if stage == "personal_data":
        assert len(got) == len(rows) and next(r.text for r in got if r.doc_id == 78).endswith("mail <email>")
    elif stage == "near_duplicates":
        assert kept.count(3) == 1 and 78 in kept  # of repeated rows one stays
    elif stage == "language":
        assert 77 not in kept and all(r.text and r.lang for r in got) and kept.count(3) in (0, 3)
    else:
        assert set(kept) <= {r[0] for r in rows}
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs.where("false"), None).count() == 0
