"""Token alignment, periodic runs and token counts against brute force, on texts with nulls, repeats, odd characters and clashing columns."""

import collections
import hashlib
import json
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lineweave.llm import alignment, bpe, periodic, queries, tokencount

# names that the operators use inside: extra columns must not get in their way
SCHEMA = "doc_id long, text string, key string, units string, words string, block long, number int, times long, kind string, counts string, segment long, a int, b int, id string, docs string"
REST = ("k", "u", "w", 3, 4, 5, "d", "c", 6, 7, 8, "i", "ds")


def make(spark, rows):
    return spark.createDataFrame([(i, t, *REST) for i, t in rows], SCHEMA)


ODD = [
    None, "", " ", "  ", "\n", "x", " x", "x ", "a  b", "a \n b\t\tc ", "The  cat's <|endoftext|> sat <s></s> <0x41> <unk>", "a▁b ▁ c", "plain text again", "naïve ﬁ Ⅳ İstanbul ΣΑΣ Straße", "日本語 と 한국어 각 हिन्दी 😀👍🏽 éa",
    "don't 'RE 'rest 'r ’s \xa0nb　sp​zw᠎mv\x85nel\x1cfs", "\x00nul \x7f﻿bom ­", "r " * 40, "a b " * 9 + "c", "a b a b a b a b", "x" * 300, "</w> a</w>b <|startoftext|><|endoftext|>! !<|endoftext|>", "'ré 'rëb 'é L'ĺ",
]


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(("tion", "ea", "st", "wh", "é", "Le", "'s", ".")) for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(50)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(200 + i, rows[4][1]) for i in range(20)] + [rows[7], rows[7], (None, rows[8][1]), (None, None)]
    return rows + [(300, "".join(rng.choice(("to ", "be", " ", "\n", "or, ", "12")) for _ in range(20000)))]


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, corpus())


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


def spelling(piece):
    byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes.fromhex(byte[1]) if byte else piece.replace("▁", " ").encode()


def slow_alignment(rows, rule):
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    path_a, path_b = alignment.default_vocabularies()
    a_model, b_model = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a_model.encode_special_tokens = True
    with open(path_a, encoding="utf-8") as file:
        names = {i: t for t, i in json.load(file)["model"]["vocab"].items()}
    letter = {chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    letter |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in letter)}
    assert ByteLevel().decode([names[262]]) == bytes(letter[c] for c in names[262]).decode()
    found, links = [], collections.Counter()
    for i, text in rows:
        a, b, ends = [], [], ([], [])
        if text:
            a = [(t, bytes(letter[c] for c in names[t])) for t in a_model.encode(" " + text, add_special_tokens=False).ids]
            b = [(t, spelling(b_model.id_to_piece(t))) for t in b_model.encode(text)]
            if any(b"".join(s for _, s in side) != (" " + text).encode() for side in (a, b)):
                a, b = [], []
        for side, out in zip((a, b), ends):
            at = 0
            for _, s in side:
                at += len(s)
                out.append(at)
        groups, x, y = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(([t for t, _ in a[x:p]], [t for t, _ in b[y:q]]))
            x, y = p, q
        mine = [p for g, h in groups for p in {"ends": [(g[-1], h[-1])], "starts": [(g[0], h[0])], "all": [(s, t) for s in g for t in h]}[rule]]
        links.update(mine)
        text_form = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        found.append((i, len(a), len(b), len(groups), mine, hashlib.sha256(text_form.encode()).hexdigest() if groups else ""))
    most = collections.Counter()
    for (_, t), n in links.items():
        most[t] = max(most[t], n)
    return sorted((str(i), na, nb, ng, len(m), sum(links[p] == most[p[1]] for p in m), sum(links[p] for p in m), sha) for i, na, nb, ng, m, sha in found)


@pytest.mark.parametrize("rule", alignment.RULES)
def test_alignment_matches_brute_force(docs, monkeypatch, rule):
    monkeypatch.setattr(alignment, "BLOCK", 500)  # so that there are many blocks, and a document larger than one
    got = alignment.align(docs, rule=rule).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == slow_alignment(corpus(), rule)


def test_alignment_of_nothing(spark, empty):
    assert alignment.align(empty).count() == 0
    only = alignment.align(make(spark, [(1, None), (1, "a▁")])).collect()
    assert [tuple(r) for r in only] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2
    with pytest.raises(ValueError):
        alignment.align(empty, rule="overlap")


def test_alignment_rows_grow_with_the_input(spark, monkeypatch, tmp_path):
    """Rows of the blocks' lists: no row for each pair of block and bucket."""
    monkeypatch.setattr(alignment, "BLOCK", 200)
    rng = random.Random(5)
    counted = []
    for size in (100, 400, 1600):
        rows = [(i, " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(20))) for i in range(size)]
        monkeypatch.setattr(alignment, "scratch", lambda spark, name, at=str(tmp_path / str(size)): at)
        alignment.align(make(spark, rows).coalesce(1)).count()
        counted.append(spark.read.parquet(str(tmp_path / str(size))).count())
    assert all(b / a < 4 * 1.1 for a, b in zip(counted, counted[1:]))


def slow_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        start = 0
        while start + q < len(w):
            end = start
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            if end + q - start >= max(6, 4 * q):
                found.setdefault((start, end + q - start), q)
            start = max(end, start + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def slow_report(i, w):
    found = slow_runs(w)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    s, n, q = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    return (str(i), len(found), s, n, q, 1000 * n // q if n else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()), found, kept


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def repeating():
    rng = random.Random(6)
    rows = []
    for i in range(150):
        w = [rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.choice((0, 3, 6, 20, 70)))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            w += (unit * 9)[: rng.randint(1, 9 * len(unit))]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("batch", ["1000", "7"])
def test_runs_match_brute_force(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rows = corpus() + repeating()
    out = periodic.periodic_runs(make(spark, rows), bpe.words("text"), keep=("runs", "collapsed")).collect()
    want = sorted(((slow_report(i, split(t))) for i, t in rows), key=str)
    got = sorted((((str(r[0]), *r[1:8]), [tuple(x) for x in r.runs], r.collapsed) for r in out), key=str)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and sum(len(x[1]) > 1 for x in want) > 20


def test_long_periods_and_nothing(spark, empty):
    rng = random.Random(7)
    unit = [str(rng.randint(0, 50)) for _ in range(3001)]
    rows = [(1, " ".join(["start", *unit * 5, "end"])), (2, "la " * 50000), (3, " ".join(map(str, range(20000))))]
    out = periodic.periodic_runs(make(spark, rows), bpe.words("text"), keep=("runs",)).collect()
    assert [(1, 15005, 3001) in [tuple(x) for x in r.runs] for r in out] == [True, False, False]
    assert [tuple(x) for x in out[1].runs] == [(0, 50000, 1)] and out[2].n_runs == 0 and out[1].collapsed_sha256 == hashlib.sha256(b"la").hexdigest()
    assert periodic.periodic_runs(empty, bpe.words("text")).count() == 0


def test_planted_words(spark):
    docs = spark.createDataFrame([*corpus(), *((5000 + i, f"one two {i} three four five six seven") for i in range(300))], "doc_id long, text string")
    out = docs.select("doc_id", bpe.words("text").alias("words")).select("doc_id", "words", queries.planted(F.col("words")).alias("planted")).collect()
    changed = 0
    for r in out:
        w, n, h = r.words, len(r.words), zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            changed += w != r.words
        assert r.planted == w
    assert changed > 10


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(bpe.default_tokenizer())
    return lambda text: len(model.encode(text, add_special_tokens=False).ids)


def test_counts_match_the_library(spark, docs, empty, library):
    got = tokencount.count(docs, limit=60).collect()
    want = [(str(i), len((t or "").encode()), n := library(t or ""), n > 60) for i, t in corpus()]
    assert sorted((str(r[0]), *r[1:4]) for r in got) == sorted(want)
    short = {i: t for i, t in corpus() if i is not None and i < 300}
    for r in got:
        if r.doc_id in short:
            text = short[r.doc_id] or ""
            assert r.fitting_chars == max(k for k in range(len(text) + 1) if library(text[:k]) <= 60)
    assert tokencount.count(empty).count() == 0


def test_every_prefix_of_a_word(library):
    counter = tokencount.Counter(bpe.default_tokenizer())
    rng = random.Random(9)
    letters = [*"aebtion'!1.<>|/éÉßİıΣσςहि日本😀srvmdlTL", "̧", "́", "̈", "\xa0", "\x85", "\xad", "ᄀ", "ᅡ", "ᆨ", "<|endoftext|>", "'re", "ing", "</w>"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(1500)] + [w for t in ODD if t for w in split(t)]
    for word in words:
        assert counter.counts(word) == [library(word[:k]) for k in range(len(word) + 1)], word
    with pytest.raises(ValueError):
        tokencount.Counter(alignment.default_vocabularies()[0])


def test_the_stored_table_answers(spark, docs, library, monkeypatch):
    monkeypatch.setattr(tokencount, "SEGMENT", 50)
    texts = {i: t for i, t in corpus() if i is not None and i < 300}
    table = tokencount.prefix_table(docs.where("doc_id < 300").dropDuplicates(["doc_id"]))
    rows = {(r.doc_id, r.segment): r.counts for r in table.collect()}
    for i, t in texts.items():
        counts = [n for k in range(1 + len(t or "") // 50) for n in rows.get((i, k), [])]
        assert counts == [library(t[: k + 1]) for k in range(len(t or ""))]
    asks = [(i, n, "own") for i, t in texts.items() for n in (None, -1, 0, 1, len(t or "") // 2, len(t or ""), len(t or "") + 1)] + [(9999, 1, "own"), (None, 1, "own")]
    got = tokencount.tokens_within(table, spark.createDataFrame(asks, "doc_id long, chars long, text string")).collect()
    within = lambda i, n: None if i not in texts or n is None or n > len(texts[i] or "") else library((texts[i] or "")[: max(0, n)])
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((*a, within(*a[:2]))) for a in asks)
    budgets = [(i, n) for i in texts for n in (None, -1, 0, 1, 7, 30, 10**9)] + [(9999, 3), (3, 7)]
    best = lambda i, n: None if i not in texts or n is None or n < 0 else max(k for k in range(len(texts[i] or "") + 1) if library((texts[i] or "")[:k]) <= n)
    got = tokencount.fitting(table, spark.createDataFrame(budgets, "doc_id long, budget long")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((*b, best(*b))) for b in budgets)
