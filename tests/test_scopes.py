"""Ingestion from bytes, ignore rules, word lists and the alignment of long files."""

import bisect
import gzip
import io
import json
import random
import re
import resource
import tarfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lineweave.functions.shared import written
from lineweave.operators import align, classify, seqdiff, wordlists
from lineweave.plans import ingest
from lineweave.sources import archives, ignore

# ingestion


def manifest(payload, **changes):
    import hashlib

    canonical = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    whole = {"meta": {"format": "pack", "version": 1, "created_at": "2024-01-01T00:00:00Z"}, "payload": {"type": "plan", "hash": {"algorithm": "sha256", "value": hashlib.sha256(canonical.encode()).hexdigest()}}, "lineage": {"lineage_id": "l", "type": "root"}}
    return json.dumps(whole | changes).encode()


def archive(*members, entries=()):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for name, content in members:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
        for info in entries:
            tar.addfile(info)
    return gzip.compress(raw.getvalue(), mtime=0)


def link(name, kind=tarfile.SYMTYPE):
    info = tarfile.TarInfo(name)
    info.type, info.linkname = kind, "/etc/passwd"
    return info


PLAN = {"b": [1, 2.5, None], "a": "é"}
GOOD = [("manifest.json", manifest(PLAN)), ("payload/plan.json", json.dumps(PLAN, indent=2).encode())]
TABLES = "artifact string, content binary"
NONE = {"known": "payload_hash string", "keys": "key_id string", "verdicts": "signature string, valid boolean"}


def delivered(spark, files, limits=None, strict=True, **tables):
    given = {name: spark.createDataFrame(tables.get(name, []), schema) for name, schema in NONE.items()}
    return ingest.ingest(spark.createDataFrame(files, TABLES), **given, formats=("pack",), limits=limits, strict=strict)


def test_each_stage_refuses_its_own(spark):
    import hashlib

    good = archive(*GOOD)
    signature = lambda key, algorithm="ed25519": ("signatures/a.json", json.dumps({"key_id": key, "algorithm": algorithm}).encode())
    digest = lambda member: hashlib.sha256(member[1]).hexdigest()
    faulty = {
        "null": (None, "header", "no content"), "empty": (b"", "header", "no gzip header"), "zip": (b"PK\x03\x04" + good, "header", "no gzip header"), "fat": (b"\x1f\x8b\x08" + b"0" * 9000, "header", "too large"),
        "cut": (good[:-20], "decompression", "truncated"), "garbled": (good[:12] + bytes(30) + good[42:], "decompression", "unreadable"), "two": (good + good, "structure", "more than one archive"), "tail": (good + b"x", "decompression", "truncated"), "noisy": (good + b"hello", "decompression", "unreadable"),
        "bomb": (archive(*GOOD, ("payload/z", bytes(1 << 22))), "decompression", "too large"), "no tar": (gzip.compress(b"hello" * 300), "structure", "unreadable"),
        "up": (archive(*GOOD, ("payload/../../x", b"")), "structure", "unsafe path"), "root": (archive(*GOOD, ("/x", b"")), "structure", "unsafe path"), "link": (archive(*GOOD, entries=[link("payload/l")]), "structure", "not a regular file"),
        "hard": (archive(*GOOD, entries=[link("payload/l", tarfile.LNKTYPE)]), "structure", "not a regular file"), "device": (archive(*GOOD, entries=[link("payload/l", tarfile.CHRTYPE)]), "structure", "not a regular file"),
        "odd": (archive(*GOOD, ("readme", b"")), "structure", "unknown entry"), "again": (archive(*GOOD, GOOD[0]), "structure", "repeated entry"), "many": (archive(*GOOD, *((f"payload/{i}", b"") for i in range(9))), "structure", "too many entries"),
        "bare": (archive(GOOD[1]), "manifest", "no manifest"), "void": (archive(), "manifest", "no manifest"), "text": (archive(("manifest.json", b"hello"), GOOD[1]), "manifest", "not a manifest"), "list": (archive(("manifest.json", b"[]"), GOOD[1]), "manifest", "not a manifest"),
        "latin": (archive(("manifest.json", b"\xff{}"), GOOD[1]), "manifest", "not a manifest"), "wide": (archive(("manifest.json", manifest(PLAN) + b" " * 5000), GOOD[1]), "manifest", "manifest too large"),
        "orphan": (archive(("manifest.json", manifest(PLAN, lineage={"type": "derived", "lineage_id": "l"})), GOOD[1]), "manifest", "derived without parent"),
        "hollow": (archive(GOOD[0]), "payload", "no payload"), "other": (archive(GOOD[0], ("payload/plan.json", b"{}")), "payload", "payload hash"), "broken": (archive(GOOD[0], ("payload/plan.json", b"{")), "payload", "not JSON"),
        "stranger": (archive(*GOOD, signature("x")), "signature", "unknown key"), "rot": (archive(*GOOD, signature("k", "rot13")), "signature", "unsupported algorithm"), "unseen": (archive(*GOOD, signature("l")), "signature", "invalid signature"), "noise": (archive(*GOOD, ("signatures/a", b"\xff")), "signature", "unsupported algorithm"),
    }
    fine = {"b": good, "a": good, "signed": archive(*GOOD, signature("k")), "known": archive(("manifest.json", manifest([1])), ("payload/plan.json", b"[1]"))}
    files = [(n, c) for n, (c, *_) in faulty.items()] + list(fine.items()) + [("twice", good), ("twice", good), (None, good)]
    tables = {"known": [(hashlib.sha256(b"[1]").hexdigest(),), (None,)], "keys": [("k",), ("l",), ("k",)], "verdicts": [(digest(signature("k")), True), (digest(signature("l")), False), (digest(signature("l")), True)]}
    limits = {"packed": 9000, "bytes": 1 << 20, "ratio_floor": 1 << 30, "entries": 8, "manifest": 3000}
    done = delivered(spark, files, limits, **tables)
    got = {r.artifact: (r.stage, r.reason) for r in done.quarantine.collect()}
    assert got == {n: tuple(rest) for n, (_, *rest) in faulty.items()} | {"twice": ("header", "repeated artifact"), None: ("header", "no name")}
    kept = {r.artifact: r for r in done.admitted.collect()}
    assert set(kept) == set(fine) and done.admitted.count() == len(fine)
    assert [n for n, r in kept.items() if r.stores_payload] == ["a"] and kept["signed"].valid_signatures == 1 and kept["a"].signature_set_hash is None
    assert all(r.artifact_hash == hashlib.sha256(fine[n]).hexdigest() and r.path == f"{r.artifact_hash[:2]}/{r.artifact_hash[2:4]}/{r.artifact_hash}" for n, r in kept.items())
    stored = done.payloads.collect()
    assert [(r.hash, bytes(r.content).decode()) for r in stored] == [(kept["a"].payload_hash, '{"a":"é","b":[1,2.5,null]}')]
    lax = delivered(spark, files, limits, strict=False, **tables)
    assert {r.artifact: r.signature_fault for r in lax.admitted.collect() if r.signature_fault} == {"stranger": "unknown key", "rot": "unsupported algorithm", "unseen": "invalid signature", "noise": "unsupported algorithm"}


def test_nothing_delivered(spark):
    done = delivered(spark, [])
    assert done.admitted.count() == done.quarantine.count() == done.payloads.count() == 0


def test_a_bomb_is_stopped_at_its_limit():
    """A gigabyte of zeros in a megabyte: unpacked to the limit and no further, in bounded memory."""
    packer = io.BytesIO()
    with gzip.GzipFile(fileobj=packer, mode="wb", compresslevel=1, mtime=0) as out:
        info = tarfile.TarInfo("payload/z")
        info.size = 1 << 30
        out.write(info.tobuf())
        for _ in range(1 << 10):
            out.write(bytes(1 << 20))
    raw, seen = packer.getvalue(), 0
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    limits = ingest.LIMITS | {"ratio": 10**9, "bytes": 50 << 20}
    with pytest.raises(ingest.Refused) as error:
        for _, _, part in ingest.pieces(raw, limits):
            seen += len(part)
            assert len(part) <= ingest.PIECE
    assert error.value.args == ("decompression", "too large") and seen <= 50 << 20
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 40 << 10
    with pytest.raises(ingest.Refused) as error:
        list(ingest.pieces(raw, ingest.LIMITS | {"ratio": 10}))
    assert error.value.args == ("decompression", "suspicious ratio")


# ignore rules

TREE = ["keep.py", "a.py", "src/a.py", "src/deep/er/a.py", "build/x", "src/build/x", "build", "doc/build.txt", "a/b/c.txt", "a/c.txt", "a/b/d/c.txt", "x/a/c.txt", "#note", "!bang", "sp ace", "t[1].md", "t1.md", "tx.md", "é/ü.py", "a", "logs/1.log", "logs/keep/1.log", "back\\slash"]
CASES = {
    ("*.py", "!keep.py", "# note"): {"a.py", "src/a.py", "src/deep/er/a.py", "é/ü.py"}, ("build/",): {"build/x", "src/build/x"}, ("/build",): {"build", "build/x"}, ("build",): {"build", "build/x", "src/build/x"}, ("a/**/c.txt",): {"a/b/c.txt", "a/c.txt", "a/b/d/c.txt"},
    ("a/*/c.txt",): {"a/b/c.txt"}, ("**/c.txt", "!/a/b"): {"a/c.txt", "x/a/c.txt"}, ("\\#note", "\\!bang"): {"#note", "!bang"}, ("sp ace  ", "", "   "): {"sp ace"}, ("t[0-9].md",): {"t1.md"}, ("t[!0-9].md",): {"tx.md"}, ("t\\[1].md",): {"t[1].md"},
    ("logs/**", "!logs/keep/**"): {"logs/1.log"}, ("logs/", "!logs/keep/1.log"): {"logs/1.log"}, ("*", "!src/", "!*.md"): set(TREE) - {"src/a.py", "src/deep/er/a.py", "src/build/x", "t[1].md", "t1.md", "tx.md"}, ("!a.py",): set(), ("/", "!", "//"): set(), ("a",): {"a", "a/b/c.txt", "a/c.txt", "a/b/d/c.txt", "x/a/c.txt"},
    ("/**",): set(TREE), ("**/",): {p for p in TREE if "/" in p}, ("src/**/er",): {"src/deep/er/a.py"}, ("???.py",): set(), ("?????.??",): set(), ("????.py",): {"keep.py"}, tuple(f"none{i}/**/x{i}/*.q" for i in range(60)) + ("a.py",): {"a.py", "src/a.py", "src/deep/er/a.py"},
    ("a.py", *(f"none{i}/**/x{i}/*.q" for i in range(60)), "!src/deep"): {"a.py", "src/a.py"}, (): set(), ("back\\\\slash",): {"back\\slash"},
}


def test_the_last_matching_rule_decides(spark):
    tree = spark.createDataFrame([(p,) for p in TREE], "path string")
    for lines, want in CASES.items():
        got = {r.path for r in tree.where(ignore.decides("path", list(lines))).collect()}
        assert got == want, lines
        assert {r.path for r in ignore.filesystem_scope(tree, list(lines)).collect()} == set(TREE) - want
    verdicts = {r.path: r.d for r in tree.select("path", ignore.decides("path", ["*.py", "!keep.py"]).alias("d")).collect()}
    assert verdicts["keep.py"] is False and verdicts["a.py"] is True and verdicts["build"] is None
    assert spark.createDataFrame([(None,)], "path string").select(ignore.decides("path", ["*"])).first()[0] is None
    with pytest.raises(ValueError):
        ignore.parse("/".join("abcdefgh" * 9))


def test_rules_agree_with_plain_matching(spark):
    """Random rules and paths against one regular expression a rule, the last one that matches."""
    rng = random.Random(11)
    names = ["a", "b", "ab", "c.x", "d.y"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 5))) for _ in range(300)})
    tree = spark.createDataFrame([(p,) for p in paths], "path string")

    def plain(rule):
        neg, text = rule.startswith("!"), rule.lstrip("!")
        folder, parts = text.endswith("/"), [p for p in text.strip("/").split("/")]
        pattern = "" if text.startswith("/") or len(parts) > 1 else "(?:.*/)?"
        for i, p in enumerate(parts):
            last = i == len(parts) - 1
            if p == "**":
                pattern += ".+" if last else "(?:.*/)?"
            else:
                pattern += re.escape(p).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + ("" if last else "/")
        return re.compile(pattern + ("/.*" if folder else "(?:/.*)?")), not neg

    for _ in range(25):
        rules = []
        for _ in range(rng.randint(1, 12)):
            parts = [rng.choice([*names, "*", "a*", "?", "**"]) for _ in range(rng.randint(1, 4))]
            parts = [p for i, p in enumerate(parts) if not (p == "**" and i and parts[i - 1] == "**")]
            if parts[-1] == "**" and len(parts) == 1:
                continue
            rules.append(rng.choice(["", "!"]) + rng.choice(["", "/"]) + "/".join(parts) + ("/" if parts[-1] != "**" and rng.random() < 0.3 else ""))
        want = {}
        for path in paths:
            want[path] = next((v for r, v in reversed([plain(x) for x in rules]) if r.fullmatch(path)), None)
        assert {r.path: r.d for r in tree.select("path", ignore.decides("path", rules).alias("d")).collect()} == want, rules


def test_project_files(spark, tmp_path):
    tree = spark.createDataFrame([(p,) for p in (".ctx/a.py", ".ctx/old.pack", "a.py", "b.so", "c/d.txt", "old.pack", "keep.so")], "path string")
    (tmp_path / "rules").write_text("*.py\n!keep.so\r\n# note\n")
    lines = ignore.read_rules(spark, str(tmp_path / "rules"))
    assert lines == ["*.py", "!keep.so", "# note"]
    got = [r.path for r in ignore.project_files(tree, lines, ["*.so"], ".ctx/", ".pack").collect()]
    assert got == [".ctx/a.py", ".ctx/old.pack", "c/d.txt"]  # the defaults stand, the context comes whole
    assert ignore.has_context(tree, ".ctx").first().there and not ignore.has_context(tree.where("false"), ".ctx").first().there


# word lists


def test_word_lists_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(wordlists, "HOT", 10)  # so that there are hot tokens
    monkeypatch.setattr(wordlists, "RUN", 4)  # and runs of several windows
    rng = random.Random(12)
    listed = ["select", "FROM", "order by", "abc", "_x", "1=1", " ", "", "bc a", "é"]
    pool = ["select", "from", "abc", "zabcz", "ORDER", "BY", "1=1", "a_x", "the", "(", ")", "=", "É", "bc", "a"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(150)] + [None, "", "order  by", "ORDER BY", "x" * 3000 + "abc", "abc", "abc"]
    rows = spark.createDataFrame([(i % 100, t, "w", 1) for i, t in enumerate(texts)], "id int, text string, word string, row int")
    words = spark.createDataFrame([(w,) for w in [*listed, "abc", None]], "word string")
    tokens = lambda t: re.findall("[a-z_]+", t.lower())
    lower = {w.lower() for w in listed}
    real = {w.upper() for w in listed if w.strip()}

    def sql(t):
        known = [w for w in tokens(t) if w in lower]
        strong, structural = (sum(w in kind for w in known) for kind in (classify.STRONG_SQL, classify.STRUCTURAL_SQL))
        return bool(strong and structural or len(known) > 1 and re.search("[=?()*,]", t) or strong and "(" in t and ")" in t or any(p in t.upper() for p in classify.SQL_PHRASES))

    found = rows.select("id", "text", classify.sql_score("text").alias("s"), classify.cleaner_score("text").alias("c"))
    alone = {r.text or "": (r.s or 0, r.c) for r in found.collect()}
    hits = lambda t: sum(w in t.upper() for w in real)
    flagged = wordlists.with_sql_flag(rows, words)
    assert flagged.columns == [*rows.columns, "is_sql"]
    assert sorted((r.id, r.text or "", r.is_sql) for r in flagged.collect()) == sorted((i % 100, t or "", sql(t or "")) for i, t in enumerate(texts))
    assert sorted((r.id, r.text or "", r.sql_score) for r in wordlists.with_sql_score(rows, words).collect()) == sorted((i % 100, t or "", 3 * hits(t or "") + alone[t or ""][0]) for i, t in enumerate(texts))
    want = lambda t: 999 if hits(t) >= 2 else 2 * hits(t) + alone[t][1]
    assert sorted((r.id, r.text, r.score) for r in wordlists.with_cleaner_score(rows.where("text != ''"), words).collect()) == sorted((i % 100, t, want(t)) for i, t in enumerate(texts) if t)
    assert {r.text: r.has_word for r in wordlists.with_constant_flag(rows.where("text is not null"), words).collect()} == {t: "_X" in t.upper() for t in texts if t is not None}
    scored = wordlists.with_scores(rows.where("text != ''"), words)
    assert sorted((r.id, r.text, r.is_sql, r.sql_score, r.score) for r in scored.collect()) == sorted((i % 100, t, sql(t), 3 * hits(t) + alone[t][0], want(t)) for i, t in enumerate(texts) if t)
    nothing = words.where("false")
    assert {r.sql_score for r in wordlists.with_scores(rows.where("text = 'abc'"), nothing).collect()} == {0}
    assert {r.is_sql for r in wordlists.with_sql_flag(rows.where("id = 0"), nothing).collect()} <= {True, False} and wordlists.with_sql_flag(rows.where("false"), words).count() == 0


def test_cleaning_by_word_lists(spark):
    rows = spark.createDataFrame([("A", "Please save the file"), ("B", "Please pick the value!"), ("C", "Please pick a value off the list!"), ("D", None), ("E", "")], "token string, text string")
    words = spark.createDataFrame([("value",), ("list",), ("a_b",)], "word string")
    assert {r.token for r in wordlists.clean_mapping(rows, words).collect()} == {"A", "B"}
    texts = spark.createDataFrame([("A", "Plain words here"), ("B", "value one"), ("C", "with a_b in it"), ("D", "value list")], "token string, text string")
    assert {r.token for r in wordlists.clean_dictionary(texts, words).collect()} == {"A", "B"}


# alignment


def test_ascending_runs():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(0, 12))
        a, b = rng.permutation(50)[:n], rng.permutation(50)[:n]
        got = align.ascending(a, b)
        assert (np.diff(a[got]) > 0).all() and (np.diff(b[got]) > 0).all()
        order = np.argsort(a)
        best = [1] * n
        for i in range(n):
            best[i] = 1 + max((best[j] for j in range(i) if b[order][j] < b[order][i]), default=0)
        assert len(got) == max(best, default=0)


def lines_of(spark, versions):
    return spark.createDataFrame([(k, i + 1, x) for k, v in versions.items() for i, x in enumerate(v)], "path string, n int, line string")


def test_edits_rebuild_the_later_version(spark, monkeypatch):
    monkeypatch.setattr(align, "SHORT", 3)
    rng = random.Random(13)
    before, after = {}, {}
    for k in range(25):
        v = [str(rng.randint(0, rng.choice((2, 10, 1000)))) for _ in range(rng.randint(0, 60))]
        w = [x for x in v if rng.random() < 0.8]
        for _ in range(rng.randint(0, 6)):
            w.insert(rng.randint(0, len(w)), str(rng.randint(0, 1000)))
        if k % 5 == 0 and len(w) > 10:
            w = w[5:] + w[:5]
        before[f"f{k}"], after[f"f{k}"] = v, w
    before |= {"gone": ["a", "b"], "same": ["x"] * 50, "odd": [None, "", None, "q"], "back": [str(i) for i in range(40)]}
    after |= {"new": ["a"], "same": ["x"] * 49, "odd": ["", None, "q", None], "back": [str(i) for i in range(40)][::-1]}
    a, b = lines_of(spark, before), lines_of(spark, after)
    changed = align.edits(a, b)
    got = {}
    for r in align.rebuild(a, changed).collect():
        got.setdefault(r.path, {})[r.n] = r.line
    assert {k: [v[n] for n in range(1, len(v) + 1)] for k, v in got.items()} == {k: v for k, v in after.items() if v}
    pairs = {}
    for r in align.matches(a, b).collect():
        pairs.setdefault(r.path, []).append((r.a, r.b))
    for k, found in pairs.items():
        found.sort()
        assert all(x < y and p < q for (x, p), (y, q) in zip(found, found[1:])) and all(before[k][x - 1] == after[k][p - 1] for x, p in found)
        # no line in common is left between two matches
        for (x, p), (y, q) in zip([(0, 0), *found], [*found, (len(before[k]) + 1, len(after[k]) + 1)]):
            assert not {*before[k][x : y - 1]} & {*after[k][p : q - 1]} or max(y - x, q - p) <= align.SHORT + 1
    assert sum(map(len, pairs.values())) > 0.8 * sum(min(len(before[k]), len(after[k])) for k in before if k in after and k != "back") * 0.7
    assert align.edits(a.where("false"), b.where("false")).count() == 0


def test_long_pairs_have_the_blocks_of_short_ones(spark, monkeypatch):
    """Where every line is another, the alignment has no choice: blocks are the same by both ways."""
    rng = random.Random(14)
    rows = []
    for k in range(12):
        v = [f"{k} {i}" for i in range(80)]
        w = [f"{x}!" if rng.random() < 0.1 else x for x in v if rng.random() < 0.9]
        w.insert(rng.randint(0, len(w)), "new")
        rows.append((k, "\n".join(v), "\n".join(w)))
    rows += [(None, "a\nb\nc\nd\ne", "a\nc\nd\ne"), (3, "a\nb\nc\nd\ne", "b\nc\nd\ne"), (50, None, "x\ny\nz\nu\nv"), (51, "x\ny\nz\nu\nv", None), (52, "q", "q")]
    pairs = spark.createDataFrame(rows, "path int, before string, after string")
    plain = lambda df: sorted(json.dumps([r.path, r.status, [c.asDict() for c in r.changes]]) for r in df.collect())
    for touching in (False, True):
        want = plain(seqdiff.diff_pairs(pairs, touching=touching))
        monkeypatch.setattr(align, "SHORT", 4)
        assert plain(seqdiff.diff_pairs(pairs, touching=touching)) == want
        monkeypatch.undo()


def test_versions_are_looked_through_in_ranges(spark, monkeypatch):
    """Neither matched lines nor numbers need a task that sorts a version, and gaps share a task, batches cutting some of them."""
    monkeypatch.setattr(align, "RANGE", 7)
    v = [f"l{i % 40 if i % 3 else i}" for i in range(300)]
    w = [x for i, x in enumerate(v) if i % 11][20:] + ["end"] * 9
    a, b = lines_of(spark, {"f": v, "g": w}), lines_of(spark, {"f": w, "g": v})
    for short in (2, 50, 400):
        monkeypatch.setattr(align, "SHORT", short)
        got = {(r.path, r.n): r.line for r in align.rebuild(a, align.edits(a, b)).collect()}
        assert got == {(k, i + 1): x for k, y in (("f", w), ("g", v)) for i, x in enumerate(y)}
    gaps = [(k, g, s, i, h) for k in "ab" for g in range(30) for s, side in enumerate(("xyz", "yzx"[: g % 4])) for i, h in enumerate(side)]
    whole = pa.Table.from_pylist([dict(zip(("path", "gap", "side", "n", "h"), r)) for r in gaps])
    one, many = ([r for t in align._local("path")(iter(whole.to_batches(max_chunksize=size))) for r in t.to_pylist()] for size in (1000, 4))
    assert one == many and len(one) > 50


def test_longest_runs_in_steps(monkeypatch):
    """Neighbours that stay neighbours are one step; runs are as long as a search over single numbers finds."""
    monkeypatch.setattr(align, "STEP", 7)
    rng = np.random.default_rng(4)
    for n in (1, 2, 40, 400):
        for size in (1, 3, 15):
            parts = np.split(rng.permutation(2 * n)[:n] if size == 1 else np.arange(n) * 3, range(size, n, size))
            b = np.concatenate([parts[i] for i in rng.permutation(len(parts))])
            tops = []
            for x in b.tolist():
                at = bisect.bisect_left(tops, x)
                tops[at : at + 1] = [x]
            got = align.longest(b)
            assert len(got) == len(tops) and (np.diff(got) > 0).all() and (np.diff(b[got]) > 0).all()
    rows = [(k, g, int(i), int(x)) for k in "ab" for g in range(3) for i, x in enumerate(rng.permutation(20))]
    whole = pa.Table.from_pylist([dict(zip(("path", "gap", "a", "b"), r)) for r in rows])
    one, many = ([r for t in align._anchors("path")(iter(whole.to_batches(max_chunksize=size))) for r in t.to_pylist()] for size in (1000, 7))
    assert one == many and {r["path"] for r in one} == {"a", "b"} and len(one) >= 18


def test_passes_leave_nothing_but_the_edits(spark, monkeypatch):
    """In passes versions are edited as at once, and of what is written in between nothing is left."""
    v = [f"a long line that is compared by its digest {i % 40 if i % 3 else i}" for i in range(300)]
    w = [x for i, x in enumerate(v) if i % 11][20:] + ["end", None] * 9
    a, b = lines_of(spark, {"f": v, "g": w, "h": v[:9]}), lines_of(spark, {"f": w, "g": v, "h": v[1:9]})
    monkeypatch.setattr(align, "SHORT", 20)
    monkeypatch.setattr(align, "RANGE", 7)
    shared = Path(spark.conf.get("spark.checkpoint.dir"), "lineweave")
    tables = lambda: sorted(p.name for p in shared.glob("*"))
    before = tables()
    plain = sorted(align.edits(a, b).collect(), key=str)
    monkeypatch.setattr(align, "AT_ONCE", 10)
    changed = align.edits(a, b)
    assert len(plain) > 50 and sorted(changed.collect(), key=str) == plain
    assert [x.split("-")[0] for x in tables() if x not in before] == ["edits"] * 2
    got = {(r.path, r.n): r.line for r in align.rebuild(a, changed, n=3).collect()}
    assert got == {(k, i + 1): x for k, y in (("f", w), ("g", v), ("h", v[1:9])) for i, x in enumerate(y)}
    assert [x.split("-")[0] for x in tables() if x not in before] == ["edits"] * 2 + ["numbered"]


def test_a_pair_of_a_million_lines(spark):
    n = 1_000_000
    before = spark.range(1, n + 1).select(F.lit("f").alias("path"), F.col("id").alias("n"), F.expr("if(id % 3 = 0, concat('r', id % 100), concat('l', id))").alias("line"))
    after = before.where("n % 1000 != 0").select("path", (F.col("n") - F.floor(F.col("n") / 1000)).alias("n"), F.expr("if(n % 777 = 1, concat(line, '!'), line)").alias("line"))
    changed = written(align.edits(before, after), "edits")  # read three times
    counts = {r.side: r.n for r in changed.groupBy("side").agg(F.count("*").alias("n")).collect()}
    assert counts[0] - counts[1] == 1000 and counts[1] < 2 * n / 777
    again = align.rebuild(before, changed)
    wrong = again.join(after.select("path", "n", F.col("line").alias("want")), ["path", "n"], "full").where("not line <=> want")
    assert wrong.count() == 0


def test_archives_of_many_chunks(spark, tmp_path):
    """Small chunks, members over several of them, long and odd names: the tar is the one that is packed whole."""
    rng = random.Random(15)
    own = {"a": [(f"m/{'long' * 30}{i}é.txt", rng.randbytes(rng.choice((0, 1, 511, 512, 513, 9000)))) for i in range(12)], "b": [("x", b"")], "c": [("p", b"1"), ("p", b"0"), ("q", None)]}
    rows = [(k, n, c) for k, members in own.items() for n, c in members]
    rng.shuffle(rows)
    members = spark.createDataFrame([*rows, (None, "x", b""), ("d", None, b"")], "artifact string, path string, content binary")
    plain = {k: [(n, c or b"") for n, c in v] for k, v in own.items()}
    whole = {r.artifact: bytes(r.archive) for r in archives.pack_groups(members).collect()}
    assert whole == {k: archives.pack(v) for k, v in plain.items()}
    parts = archives.pack_parts(members, chunk=3000)
    cut = {r.artifact: bytes(r.archive) for r in archives.pack_groups(members, chunk=3000).collect()}
    assert {k: gzip.decompress(v) for k, v in cut.items()} == {k: gzip.decompress(v) for k, v in whole.items()} and parts.where("artifact = 'a'").count() > 10
    archives.write_archive(parts.where("artifact = 'a'"), str(tmp_path / "a.tgz"))
    assert (tmp_path / "a.tgz").read_bytes() == cut["a"]
    back = archives.read_archives(spark.createDataFrame(list(cut.items()), "path string, content binary")).collect()
    assert sorted((r.path, r.member, bytes(r.content)) for r in back) == sorted((k, n, c) for k, v in plain.items() for n, c in v)
    seen = [(n, c) for n, _, c in ingest.pieces(gzip.compress(b"") + archive(*GOOD), ingest.LIMITS)]
    assert seen == GOOD  # a stream of several parts is read through


def test_prefix_sums(spark):
    rng = random.Random(16)
    rows = [(rng.randint(0, 2), i, rng.randint(0, 9)) for i in range(500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {(r.k, r.n): r.offset for r in archives.prefix_sums(spark.createDataFrame(rows, "k int, n int, size long"), "k", ["n"], "size").collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(k, n): sum(s for j, m, s in rows if j == k and m < n) for k, n, _ in rows}


def test_packed_archives_pass(spark):
    members = spark.createDataFrame([("x", *m) for m in GOOD], "artifact string, path string, content binary")
    packed = archives.pack_groups(members).select("artifact", F.col("archive").alias("content"))
    given = {name: spark.createDataFrame([], schema) for name, schema in NONE.items()}
    assert ingest.ingest(packed, **given, formats=("pack",)).admitted.count() == 1


def test_lineages_while_packing(spark):
    from lineweave.plans import pack

    kind = {k: json.dumps({"lineage": v, "payload": {"hash": {"value": f"h-{k}"}}}) for k, v in {"root": {"type": "root", "lineage_id": "L"}, "off": {"type": "detached"}, "bad": {"type": "root"}}.items()} | {"none": "{}"}
    rows = [
        ("first", '{"b": 1, "a": "é"}', "plan", None, None, None), ("after", "[1]", "plan", None, kind["root"], False), ("child", "[2]", "plan", kind["root"], kind["off"], None), ("loose", "[3]", "plan", None, kind["root"], True), ("both", "[4]", "plan", kind["root"], None, True),
        ("of off", "[5]", "plan", kind["off"], None, None), ("of bad", "[6]", "plan", kind["bad"], None, None), ("of none", "[7]", "plan", kind["none"], None, None), ("odd", "{", "plan", None, None, None), ("void", None, "plan", None, None, None),
    ]
    given = spark.createDataFrame(rows, "artifact string, payload string, type string, parent string, context string, detached boolean")
    files = spark.createDataFrame([("first", "d/x", b"X"), ("both", "y", b"")], "artifact string, path string, content binary")
    packed = pack.pack(given, "pack", "test", "2024-01-01T00:00:00Z", files)
    got = {r.artifact: r for r in packed.collect()}
    assert {k: r.error for k, r in got.items() if r.error} == {"both": "both a parent and detached", "of off": "parent is detached", "of bad": "parent without lineage id", "of none": "parent without lineage", "odd": "not JSON", "void": "not JSON"}
    lineages = {k: json.loads(r.manifest)["lineage"] for k, r in got.items() if not r.error}
    first = got["first"].payload_hash
    assert lineages == {"first": {"type": "root", "lineage_id": first, "parent": None}, "after": {"type": "derived", "lineage_id": "L", "parent": "h-root"}, "child": {"type": "derived", "lineage_id": "L", "parent": "h-root"}, "loose": {"type": "detached", "lineage_id": None, "parent": None}}
    assert all(r.archive is None and r.payload_hash is None for r in got.values() if r.error)
    assert got["first"].manifest == json.dumps(json.loads(got["first"].manifest), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert bytes(got["first"].archive) == archives.pack([("manifest.json", got["first"].manifest.encode()), ("payload/plan.json", rows[0][1].encode()), ("payload/files/d/x", b"X")])
    # what is packed is taken in again
    given = {name: spark.createDataFrame([], schema) for name, schema in NONE.items()}
    done = ingest.ingest(packed.where("error is null").select("artifact", F.col("archive").alias("content")), **given, formats=("pack",))
    assert done.quarantine.count() == 0 and {r.artifact: r.payload_hash for r in done.admitted.collect()} == {k: r.payload_hash for k, r in got.items() if not r.error}
    left = {r.last_artifact: r.active_lineage_id for r in pack.next_context(packed).collect()}
    assert left == {"first": first, "after": "L", "child": "L", "loose": None}


def test_common_texts_are_looked_up_once(spark, monkeypatch):
    keyed, seen = wordlists.keyed, []

    def counted(rows, text="text"):
        seen.append(rows.count())
        return keyed(rows, text)

    monkeypatch.setattr(wordlists, "keyed", counted)
    long = "alpha " * 100
    texts = ["x alpha"] * 500 + ["select beta from"] * 400 + ["plain"] + [long] * 3 + [None, None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    words = spark.createDataFrame([("alpha",), ("select",), ("from",)], "word string")
    got = {r.id: (r.text, r.is_sql, r.sql_score, r.score) for r in wordlists.with_scores(rows, words).collect()}
    want = {"x alpha": (False, 3, 4), "select beta from": (True, 6, 999), "plain": (False, 0, 3), long: (False, 3, 6), None: (False, 0, 1), "": (False, 0, 1)}
    assert got == {i: (t, *want[t]) for i, t in enumerate(texts)}
    assert sorted(seen) == [4, 5]  # the four short texts once, and the rows of no or long text


def test_small_archives_need_no_places(spark, monkeypatch):
    monkeypatch.setattr(archives, "prefix_sums", None)  # only members of archives over a chunk are placed
    own = {k: [(f"m/{'d' * (60 * k)}é{i}", bytes([i]) * i * 300) for i in range(k + 1)] for k in range(40)}
    members = spark.createDataFrame([(k, *m) for k, v in own.items() for m in v], "artifact long, path string, content binary")
    packed = archives.pack_groups(members)
    assert {r.artifact: bytes(r.archive) for r in packed.collect()} == {k: archives.pack(v) for k, v in own.items()}
    back = archives.read_archives(packed, "artifact", "archive").collect()
    assert sorted((r.artifact, r.member, bytes(r.content), r.error) for r in back) == sorted((k, *m, None) for k, v in own.items() for m in v)


def test_headers_are_those_of_tarfile():
    for name in ("", "x", "a" * 100, "a" * 101, "é", "a/../b", "/c", "d/"):
        for size in (0, 511, 8**11 - 1, 8**11):
            assert archives._header(name, size) == archives._entry(name, size).tobuf(tarfile.PAX_FORMAT, "utf-8", "surrogateescape")
    good = archives.pack([("b", b"2"), ("a", b"")])
    assert archives._plain(good) == [("a", b""), ("b", b"2")]
    for odd in (good[:-20], b"no", b"", archives.pack([("../x", b"1")]), archive(*GOOD, entries=[link("payload/l")]), archives.pack([("long" * 30, b"1")]), gzip.compress(gzip.decompress(good)[:600])):
        assert archives._plain(odd) is None  # left to the reader that knows faults
