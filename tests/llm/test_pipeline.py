"""Each pipeline stage, on what the stage before it kept, against a plain Python version of it."""

import hashlib
import random
import re

import numpy as np
from test_documents import groups, slow_print, slow_spans

import corpus_pipeline
from lineweave.llm import bpe, langid, mixing

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents():
    rng = random.Random(8)
    stems = {"en": ("the", "and", "wh", "tion"), "fr": ("eau", "é", "oi", "que"), "de": ("sch", "ü", "pf", "ver")}
    word = lambda k: "".join(rng.choice(stems[k]) for _ in range(rng.randint(2, 3)))
    rows = []
    for i in range(240):
        k = rng.choice(list(stems))
        text = " ".join(word(k) for _ in range(rng.randint(30, 120)))
        if i % 6 == 0:
            text += rng.choice((" mail x.y@mail.org now", " at 10.2.3.4 and 10.2.3.400", " card 4539 1488 0343 6467.", " call +1 (234) 555-6695 ok"))
        rows.append((i, text, k if i % 9 else None, rng.choice(("a", "a", "b", "c", None))))
    rows += [(300 + i, rows[i][1], rows[i][2], "a") for i in range(30)] + [(400, "12 34", "en", "a"), (401, None, "en", "a"), (402, "", None, None)]
    return [(i, t, k, s, len(t) if t else 0) for i, t, k, s in rows]


def language(rows, net):
    out = []
    for i, text, lang, source, n in rows:
        if text and any(map(str.isalpha, text)):
            x = langid.windows(text.encode())
            p = (net.probabilities(x) * (x != 0).sum(axis=1, keepdims=True)).sum(axis=0)
            if p.max() / p.sum() >= corpus_pipeline.SURE:
                out.append((i, text, lang or net.languages[p.argmax()], source, n))
    return out


def near_duplicates(rows):
    prints = {r[0]: slow_print(r[1]) for r in rows}
    every = sorted(set(prints.values()))
    root = groups(every, [(a, b) for k, a in enumerate(every) for b in every[k:] if (a ^ b).bit_count() <= 4])
    first = {}
    for i, p in sorted(prints.items()):
        first.setdefault(root[p], i)
    return [r for r in rows if r[0] in first.values()]


def personal_data(rows):
    out = []
    for i, text, lang, source, _ in rows:
        for kind, a, b in sorted(slow_spans(text), key=lambda s: -s[1]):
            text = f"{text[:a]}<{kind}>{text[b:]}"
        out.append((i, text, lang, source, len(text)))
    return out


def mixture(rows):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    topic = lambda t: "shout" if "!!" in t else "table" if " | " in t else "facts" if re.search("[0-9]", t) else "essay" if "\n" in t else "note"
    cells = {}
    for _, text, lang, source, _ in rows:
        cell = (source, lang, topic(text))
        cells[cell] = cells.get(cell, 0) + words(text)
    weight = dict(cells)
    for _ in range(mixing.ROUNDS):
        for at in range(3):
            goal, now = {}, {}
            for cell in cells:
                goal[cell[at]] = goal.get(cell[at], 0) + cells[cell]
                now[cell[at]] = now.get(cell[at], 0) + weight[cell]
            total = sum(g**mixing.POWER for g in goal.values())
            weight = {c: w * goal[c[at]] ** mixing.POWER / total / now[c[at]] for c, w in weight.items()}
    over = {c: weight[c] / cells[c] for c in cells}
    draw = lambda i: int(hashlib.md5(f"mix{i}".encode()).hexdigest()[:8], 16) / 2**32
    return [r for r in rows if draw(r[0]) < over[r[3], r[2], topic(r[1])] / max(over.values())]


def tokens(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_tokenizer())
    return [(r[0], tokenizer.encode(r[1], add_special_tokens=False).ids) for r in rows]


def test_stages_match_plain_versions(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long")
    net = langid.train(docs.where(~langid.held_out()))
    plain = {"language": lambda rows: language(rows, net), "near_duplicates": near_duplicates, "personal_data": personal_data, "mixture": mixture}
    rows = documents()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").checkpoint()
        assert docs.columns == list(COLUMNS)
        wanted = plain[name](rows)
        assert len(wanted) < len(rows) or name == "personal_data"
        rows = wanted
        assert sorted(map(str, map(tuple, docs.collect()))) == sorted(map(str, rows)), name
    got = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted(tokens(rows))
    assert {np.dtype(type(r.n_tokens)) for r in got} == {np.dtype(int)}
