"""Document operators against brute force, on texts with nulls, ties, repeats, clashing columns and odd characters."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lineweave.llm import bpe, common, langid, mixing, pii, quality, simhash, substring

# names that the operators use inside: extra columns must not get in their way
SCHEMA = "doc_id long, text string, lang string, source string, fp long, row string, key string, topic string, rate double, block long, score double, doc string, tokens long, weight double"


def make(spark, rows):
    rest = (7, "r", "k", "t", 0.5, 3, 0.1, "d", 4, 0.2)
    return spark.createDataFrame([(i, t, lang, source, *rest) for i, t, lang, source in rows], SCHEMA)


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(("tion", "ea", "st", "wh", "é", "Le")) for _ in range(rng.randint(1, 3)))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 90))), rng.choice(("en", "fr")), rng.choice(("a", "b", None))) for i in range(60)]
    rows += [(100 + i, f"{rows[i][1]} {passage} {word()}", "en", "hot") for i in range(20)]
    rows += [(200 + i, rows[3][1], "fr", "hot") for i in range(25)]  # copies
    rows += [(300, None, None, None), (301, "", "en", None), (302, " \n\t ", "en", "a"), (None, passage, None, "a"), (303, "12 34 !!", "en", "a")]
    rows += [(304, passage.replace(" ", " ", 3), "en", "a"), (305, "naïve <|endoftext|> 's\x1cx\x85y don't İ ß 😀 é", "fr", "a"), rows[5], rows[5]]
    rows += [(306, "x" * 5000 + " " + "1" * 3000 + " " + "a@b" + ".c" * 3000 + " +1" + "2" * 3000, "en", "a"), (307, passage * 60, "fr", "a")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, corpus())


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


def fold(text):
    return (text or "").encode().lower().split()


def slow_print(text):
    words = fold(text)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in linked:
        parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_simhash_matches_brute_force(docs):
    rows = corpus()
    prints = [slow_print(t) for _, t, _, _ in rows]
    every = sorted(set(prints))
    root = groups(every, [(a, b) for i, a in enumerate(every) for b in every[i:] if (a ^ b).bit_count() <= 4])
    least = {}
    for (i, *_), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(least.get(root[p], i), i)
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    want = [(i, p, least.get(root[p])) for (i, *_), p in zip(rows, prints)]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(root[p] for p in prints))


def test_anchors_find_every_near_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 50)  # so that hot anchors are split
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(150)]
    prints = set(base)
    for x in base[:80]:
        for _ in range(6):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << b
            prints.add(y)
    prints |= {base[0] ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)}  # a dense group
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(prints)]
    found = {r.node: r.component for r in simhash.fingerprint_components(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    values = sorted(prints)
    root = groups(values, [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 4])
    to = {}
    for x, s in zip(values, signed):
        assert to.setdefault(root[x], found.get(s, s)) == found.get(s, s)
    assert len(set(to.values())) == len(to)


def test_simhash_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.deduplicate(empty).count() == 0


@pytest.mark.parametrize("size", [2000, 1 << 20])
def test_bpe_matches_the_library(docs, monkeypatch, size):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "LEAST_BYTES", size)
    monkeypatch.setattr(bpe, "MOST_BYTES", size)
    tokenizer = Tokenizer.from_file(bpe.default_tokenizer())
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.decoded, r.ids) for r in bpe.encode_decode(docs, keep=("ids", "decoded")).collect())
    want = []
    for i, text, _, _ in corpus():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded, ids))
    assert got == sorted(want)


def test_bpe_decode_joins_pieces(spark, docs, empty):
    rows = bpe.encode_decode(docs.where("doc_id < 20"), keep=("ids", "decoded"))
    back = {r.doc_id: r.decoded for r in bpe.decode(rows).collect()}
    assert back == {r.doc_id: r.decoded for r in rows.collect()}
    assert bpe.encode_decode(empty).count() == 0


def test_bpe_rows_grow_with_the_input():
    rows = [-(-total // (bpe.sizes(total)[0] * bpe.WORD_BYTES)) * bpe.sizes(total)[1] for total in (1 << 27, 1 << 29, 1 << 31)]
    assert all(3 < b / a < 5 for a, b in zip(rows, rows[1:]))


def slow_repeats(rows, size):
    first = {}
    for i, text in rows:
        if i is not None:
            w = (text or "").encode().split()
            for a in range(len(w) - size + 1):
                key = tuple(w[a : a + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - size + 1):
            if i is not None and first[tuple(w[a : a + size])] < i:
                gone[a : a + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_repeats_match_brute_force(docs, monkeypatch, batches):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 5000)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs, batches=batches).collect())
    assert got == slow_repeats([(i, t) for i, t, _, _ in corpus()], 13)


def test_repeats_of_nothing(empty, docs):
    assert substring.remove_repeats(empty).count() == 0
    kept = {r.doc_id: r.kept for r in substring.remove_repeats(docs.where("doc_id in (3, 200)"), keep=True).collect()}
    assert kept[3] == " ".join(corpus()[3][1].split()) and (kept[200] == "" or len(corpus()[3][1].split()) < 13)


# the contract's expressions as they stand
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(map(int, str(int(d) * (1 + k % 2)))) for k, d in enumerate(reversed(digits))) % 10 == 0


def slow_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".") if kind == "ip"), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


PII = [
    "é mail a@b.c%d@e.fg_h@i.jk and x.@y..z or q@r-s.t-u.", "ip 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3", "card 4539 1488 0343 6467, 4539-1488-0343-6467 4539  148803436467 45391488034364670000",
    "call +1 (234) 555-6695 or +1-800 +12 +1234567890123456 x+44 20 7946 0958.", "+1.2.3.4.5.6.7.8@x.y 4539148803436467@mail.com", "no data here", "9" * 40 + "@" * 5 + "+" * 9, "a@b" + ".c" * 4000, "1 " * 9000,
]


def test_base_spans_match_the_contract(spark, docs):
    texts = PII + [t for _, t, _, _ in corpus()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.report(rows).collect():
        spans = slow_spans(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), texts[r.doc_id][:80]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, *_ in spans) for k in BASE]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_reliable_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"He wrote. Phone number: +1 (234) 555-6{i:03d} thanks") for i in range(30)]
    rows += [(100, "Again. Phone number: 020-7946-0958, thanks"), (101, "It cost 020-7946-0958 there"), (102, "Phone number: none")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "phone:21:34" and got[101] == "" and got[102] == ""
    masked = {r.doc_id: r.text for r in pii.mask(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert masked[100] == "Again. Phone number: <phone>, thanks" and masked[0] == "He wrote. Phone number: <phone> thanks" and masked[102] == rows[-1][1]


def test_secrets_need_a_reliable_pattern(spark):
    digest = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'word{i} set token = "{digest(i)}" end') for i in range(20)]
    rows += [(100, "Token = Zx9-uuQ_77abcdefg!!"), (101, f"the commit {digest(101)} was good"), (102, "token = yes"), (103, f"two token = {digest(7)} token = {digest(8)}, so"), (104, "call +1 (234) 555-6695 or token = 020 7946 0958")]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[:20]:
        at = text.index('"') + 1
        assert got[i].spans == f"secret:{at}:{at + 40}" and got[i].n_added == 1
        assert got[i].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert [got[i].spans for i in (100, 101, 102)] == ["secret:8:25", "", ""]
    assert got[103].spans == "secret:12:52,secret:61:101"
    assert got[104].spans == "phone:5:22"


def test_added_spans_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    planted = {i: [m.span(1) for m in re.finditer('[Tt](?:oken|OKEN) = "([0-9a-fA-F]{40})"', t)] for i, t in texts.items()}
    assert sum(map(len, planted.values())) > 0
    for r in pii.report(docs).collect():
        added = [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("secret")]
        assert added == [s for s in planted[r.doc_id] if not any(k in r.spans and int(a) < s[1] and int(b) > s[0] for k, a, b in (x.split(":") for x in r.spans.split(",") if x and not x.startswith("secret")))]


def test_masking_keeps_rows_and_columns(docs, empty):
    out = pii.mask(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    plain = {(r.doc_id, r.text) for r in docs.collect() if not slow_spans(r.text)}
    assert plain <= {(r.doc_id, r.text) for r in out.collect()}
    assert pii.report(empty).count() == 0 and pii.mask(empty).count() == 0


def test_language_is_learnt_and_und_is_kept_apart(spark, empty):
    rng = random.Random(2)
    stems = {"en": ("the", "and", "wh", "tion"), "fr": ("eau", "é", "oi", "que"), "de": ("sch", "ü", "pf", "ver")}
    text = lambda k: " ".join("".join(rng.choice(stems[k]) for _ in range(3)) for _ in range(rng.randint(20, 200)))
    rows = [(i, text(k := rng.choice(list(stems))), k, "s") for i in range(300)]
    rows += [(400, None, "en", "s"), (401, "", "en", "s"), (402, "12 !? 34", "en", "s"), (403, text("de") * 30, None, None), (None, text("fr"), "fr", None)]
    df = make(spark, rows)
    net = langid.train(df.where(~langid.held_out()))
    got = langid.identify(df, net).withColumn("held", langid.held_out()).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held and r.doc_id < 300]
    assert all(r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len(held) > 40 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    by = {r.doc_id: r.lang_pred for r in got}
    assert [by[i] for i in (400, 401, 402, 403, None)] == ["und", "und", "und", "de", "fr"]
    none = langid.identify(df, langid.train(empty))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_quality_on_held_out_rows(spark, docs, empty):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(("the", "and", "of")) + rng.choice(("ing", "ed", "")) for _ in range(rng.randint(5, 80)))
    rows = [(i, good() if i % 4 else " ".join([rng.choice(("BUY!!", "$$$"))] * rng.randint(5, 80)), "en", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), "x") for i in range(400)] + [(5, 1, "x"), (None, 1, "x"), (7, None, "x")], "doc_id long, quality int, text string")
    got = quality.score(make(spark, rows + [(900, None, None, None), (901, "", None, None), (None, "x", None, None)]), labels).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in held if r.doc_id < 400) / len([r for r in held if r.doc_id < 400]) > 0.95
    assert {r.score for r in quality.score(docs, labels.where("false")).collect()} == {0.5}
    assert quality.score(empty, labels).count() == 0


def test_mixture_fits_the_margins(spark, docs, empty):
    out = mixing.mix(docs)
    rows = out.collect()
    assert len(rows) == docs.count() and {type(r.row.topic) for r in rows} == {str}
    cells = {(r.source, r.lang, r.topic): r.weight for r in rows}
    for at, name in enumerate(("source", "lang")):
        tokens, weights = {}, {}
        for r in rows:
            tokens[r[name]] = tokens.get(r[name], 0) + r.tokens
        for cell, weight in cells.items():
            weights[cell[at]] = weights.get(cell[at], 0) + weight
        goal = {k: n**mixing.POWER if n else 0 for k, n in tokens.items()}
        for k, n in goal.items():
            assert weights[k] == pytest.approx(n / sum(goal.values()), abs=0.02)
    assert all(0 <= r.rate <= 1 + 1e-9 and r.chosen == (r.draw < r.rate) for r in rows)
    assert mixing.mix(empty).count() == 0


def test_a_tiny_source_does_not_thin_out_the_rest(spark):
    schema = "doc_id long, text string, lang string, source string"
    usual = [(i, "a few plain words " * 50, "en" if i % 4 else "de", "web" if i % 3 else "books") for i in range(600)]
    rates = lambda rows: {r.row.doc_id: r.rate for r in mixing.mix(spark.createDataFrame(rows, schema)).collect()}
    before, after = rates(usual), rates([*usual, (1000, "one stray note here", "la", "stray")])
    assert max(after.values()) == 1.0 and after[1000] == 1.0
    assert all(after[i] == pytest.approx(before[i], rel=0.05) for i in before)
    few = [(i, f"word {i}", "en", f"s{i}") for i in range(2000)]  # every source is tiny: all set the scale
    assert all(0 < r <= 1 for r in rates(few).values())


def test_components_and_packing(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5, 5), (None, 3)] + [(2000, 2000 + i) for i in range(1, 300)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "src long, dst long").repartition(7)).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[1001] == 1000 and all(got[2000 + i] == 2000 for i in range(1, 300))
    assert common.components(spark.createDataFrame([], "src long, dst long")).count() == 0
    for values in (np.array([], np.int64), np.array([3, -1, 1 << 60], np.int64), np.arange(100, dtype=np.uint16)):
        assert (common.unpack(common.pack(values), values.dtype) == values).all()


def test_topic_and_tokens(spark):
    rows = spark.createDataFrame([("a\x0bb  c",), (None,), ("",), (" x!! ",), ("a | b",), ("a\nb",)], "text string")
    assert [r[0] for r in rows.select(mixing.tokens()).collect()] == [3, 0, 0, 1, 3, 2]
    assert [r[0] for r in rows.select(mixing.topic()).collect()] == ["note", "note", "note", "shout", "table", "essay"]
    assert rows.where(F.lit(False)).select(mixing.draw("text")).count() == 0


def test_an_index_serves_later_calls(spark, docs):
    rows = [(i, t) for i, t, _, _ in corpus() if i is not None]
    index = substring.FingerprintIndex(spark, 3)
    got = []
    for low, high in ((0, 50), (50, 150), (150, 400)):
        found = substring.remove_repeats(docs.where(f"doc_id >= {low} and doc_id < {high}"), batches=1, index=index)
        got += [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()]
    assert sorted(got) == slow_repeats(rows, 13)
    assert len(index.runs) == 2  # two of the three runs were compacted
    index.drop()
