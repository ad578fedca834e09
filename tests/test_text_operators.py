"""Rules of scanning, classifying and dictionaries on literal inputs."""

import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineweave import sinks
from lineweave.functions import canonical
from lineweave.functions import text as tx
from lineweave.operators import classify, detect, dictionary, goals, regions, seqdiff, treediff


def one(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "n int, t string").select("n", column.alias("x")).collect()
    return [r.x for r in sorted(rows)]


def test_lines_split_as_python_does(spark):
    texts = ["a\nb", "a\r\nb\r", "\n\n", "x\x0by\x0cz\x1cw\x85v u ", "", "one", "a\n\r\nb", None]
    got = one(spark, texts, tx.split_lines("t"))
    assert got == [t.splitlines() if t is not None else None for t in texts]


def test_classes(spark):
    want = {
        "": "empty", "https://x.y": "url", "select a from b": "sql", "SELECT 1": "sql", "x FROM (y)": "sql", "hello world": "css", "btn-primary": "css", "fooBar": "identifier", "snake_case": "identifier",
        "a{b}": "code", "Hello World": "human", "  Hello there ": "human", "42": "unknown", "OK": "unknown", "Été là": "human",
    }
    assert one(spark, list(want), classify.string_class("t")) == list(want.values())


def test_candidates_and_filters(spark):
    assert one(spark, ["Save the File", "ab", "A b", "save file"], classify.is_candidate("t")) == [True, False, True, False]
    assert one(spark, ["", "a/b c", "Word", "LONGCONSTANT X", "Please wait here"], classify.is_skipped("t")) == [True, True, True, True, False]
    assert one(spark, ["ééé", "plain", "a\0", "--------------------------"], classify.is_binary_like("t")) == [True, False, True, True]
    words = spark.createDataFrame([("A", "https://a"), ("B", "btn primary"), ("C", "Please save the file"), ("D", "fooBar"), ("E", "UPDATE x")], "token string, text string")
    assert {r.token for r in classify.apply_filters(words, ["SQL", "code", "url", "css", "css"]).collect()} == {"C"}
    with pytest.raises(ValueError):
        classify.apply_filters(words, ["nope"])


def test_findings(spark):
    lines = ['print("Hello World")', '# print("No")', "x = 'Save the File' + \"Another Text here\"", 'raise Error("Bad thing")', "y = 'lower words'", 'logging.info("Now Done")', "z = \"it\\\"s Fine now\""]
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    got = [(r.line_no, r.text) for r in detect.findings(rows).orderBy("line_no", "n").collect()]
    assert got == [(0, "Hello World"), (2, "Save the File"), (2, "Another Text here"), (3, "Bad thing"), (5, "Now Done")]  # a backslash makes a path of the last


def test_dictionary_suffixes_skip_natural_keys(spark):
    texts = ["Hello!", "Hello?", "Hello 2", "hello", "Hello!", "Hello."]
    rows = spark.createDataFrame(list(enumerate(texts)), "ord int, text string")
    got = {r.text: r.token for r in dictionary.build(rows).collect()}
    assert got == {"Hello!": "HELLO", "Hello 2": "HELLO_2", "Hello?": "HELLO_3", "hello": "HELLO_4", "Hello.": "HELLO_5"}


def test_substitution_joins_by_literal(spark):
    lines = spark.createDataFrame([("f", 1, "a = 'Yes' + \"No\" + 'Maybe'"), ("f", 2, "Yes")], "file string, line_no int, line string")
    words = spark.createDataFrame([("Y", "Yes"), ("N", "No")], "token string, text string")
    assert [(r.line_no, r.replacement, r.token) for r in dictionary.substitute(lines, words).collect()] == [(1, "a = messages[\"Y\"] + messages[\"N\"] + 'Maybe'", "Y")]


def test_goals_and_specs(spark):
    found = spark.createDataFrame([("HUMAN",)] * 3 + [("SQL",), ("CSS",)], "type string")
    made = goals.discover_goals(found)
    assert sorted((r.goal, r["count"]) for r in made.collect()) == [("EXTRACT_CONSTANTS", 1), ("INTERNATIONALIZE_STRINGS", 3)]
    assert {r.intent: len(r.requirements) for r in goals.discover_specs(made).collect()} == {"EXTRACT_CONSTANTS": 1, "INTERNATIONALIZE_STRINGS": 3}


def test_canonical_json(spark):
    import json

    values = ["plain", 'q"\\', "\x01\x0b\x1f\n", "é😀", None]
    df = spark.createDataFrame(list(enumerate(values)), "n int, t string")
    got = [r.x for r in df.select("n", canonical.canonical_json(z=F.col("n"), a=F.col("t")).alias("x")).orderBy("n").collect()]
    assert got == [json.dumps({"a": v, "z": n}, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for n, v in enumerate(values)]
    raw = spark.createDataFrame([('{"b":[1,null],"a":{"y":1,"x":"é\\r\\n"}}',), ("no json",), (None,)], "t string")
    assert [r.x for r in raw.select(canonical.canonical_text(F.col("t"), normal=True).alias("x")).collect()] == ['{"a":{"x":"é\\n","y":1},"b":[1,null]}', None, None]


def test_block_rules():
    assert [(b["type"], b["start_line"], b["end_line"]) for b in seqdiff.blocks(["line1", "line2", "line3", "line4"], ["line1", "changed2", "changed3", "line4"])] == [("replace", 2, 3)]
    apart = seqdiff.blocks(["x", "y"], ["n", "x", "z"])
    assert [(b["type"], b["before"], b["after"]) for b in apart] == [("insert", [], ["n"]), ("replace", ["y"], ["z"])]
    assert len(seqdiff.blocks(["x", "y"], ["n", "x", "z"], touching=True)) == 1
    assert seqdiff.blocks(["a"], ["a"]) == [] and seqdiff.blocks([], ["a"])[0]["type"] == "insert"


lists = st.lists(st.sampled_from("abcd"), max_size=12)


@given(lists, lists)
@settings(max_examples=200, deadline=None)
def test_blocks_rebuild_the_later_version(before, after):
    out, at = [], 0
    for b in seqdiff.blocks(before, after):
        start = b["start_line"] - 1 if b["before"] or b["type"] != "insert" else b["start_line"] - 1
        out += before[at:start] + b["after"]
        at = start + len(b["before"])
    assert out + before[at:] == after
    assert bool(seqdiff.blocks(before, after)) == (before != after)
    assert difflib.SequenceMatcher(None, before, after).ratio() <= 1


def test_diffs_are_normal_and_their_hash_ignores_order(spark):
    pairs = [("a.py", "hello\n", "hola\n"), ("b.py", None, "x\ny"), ("c.py", "same", "same"), ("d.py", "old", None)]
    make = lambda rows: seqdiff.diff_pairs(spark.createDataFrame(rows, "path string, before string, after string"))
    files = make(pairs)
    assert {r.path: (r.status, len(r.changes)) for r in files.collect()} == {"a.py": ("modified", 1), "b.py": ("added", 1), "d.py": ("removed", 1)}
    once = seqdiff.normalized(files)
    assert sorted(map(str, once.collect())) == sorted(map(str, seqdiff.normalized(once).collect()))
    digest = lambda rows: seqdiff.diff_hash(make(rows)).first()[0]
    assert digest(pairs) == digest(pairs[::-1]) != digest(pairs[:2])
    assert len(digest(pairs)) == 64
    plan = {(r.file, r.line): (r.original, r.replacement) for r in seqdiff.to_plan(files).collect()}
    assert plan[("a.py", 1)] == ("hello", "hola") and plan[("d.py", 1)] == ("old", None)
    assert [r.whole_file for r in seqdiff.to_plan(make([("e", "x", "\n".join(map(str, range(300))))])).collect()] == [True]


def test_ignored_paths(spark):
    paths = [".git/x", "a.png", "src/a.py", "dictionary-1.json", "my-plan.json", "x/tool-plan.txt", "payload/a", "data.json", ".tool/x", "b/tool.json"]
    assert one(spark, paths, treediff.is_ignored("t", "tool")) == [True, True, False, True, True, True, True, False, True, True]
    assert one(spark, ["a/.tool/b", "scan-result-1.obad.json", "x/dictionary-2.json", "tool-1.json", "other.json"], treediff.is_generated("t", "tool")) == [True, True, True, True, False]


def test_regions(spark):
    text = 'a\nxx {[#0_F6N:"Hello\nworld"#]} {[#REVISION_ABC:""#]} {[#99_XYZ:"z"#]}'
    rows = regions.extract(spark.createDataFrame([("f", text)], "file string, text string")).orderBy("n").collect()
    assert [(r.id, r.state, r.original) for r in rows] == [("F6N", 0, "Hello\nworld"), ("ABC", 2, ""), ("XYZ", None, "z")]
    assert (rows[0].start_line, rows[0].start_column, rows[0].end_line, rows[0].end_column) == (2, 4, 3, 10)
    bad = spark.createDataFrame([("f", '"#]} {[#0_ABC:""#]} {[#0_ABC:"x')], "file string, text string")
    assert [(r.line, r.column, r.message) for r in regions.errors(bad).collect()] == [(1, 1, "closing mark without an opening"), (1, 16, "empty region")]
    state = one(spark, ["5", "MODIFIED", "32", "-1", "x"], regions.state_value(F.col("t")))
    assert state == [5, 1, None, None, None]
    raw = ['a\\n"b"\n\\', "plain", '\\\\"']
    assert one(spark, raw, regions.unescape(regions.escape(F.col("t")))) == raw
    before = spark.createDataFrame([("f", "AAA", 0, "x", None, "h", 1), ("f", "BBB", 0, "y", None, "h", 2), ("f", "CCC", 0, "z", None, "h", 3)], "file string, id string, state int, original string, modified string, hash string, n int")
    after = spark.createDataFrame([("f", "BBB", 1, "y", "q", "h", 1), ("f", "AAA", 0, "x", None, "h", 9), ("f", "DDD", 0, "w", None, "h", 4)], before.schema)
    assert {r.id: r.status for r in regions.reconcile(before, after).collect()} == {"AAA": "same", "BBB": "changed", "CCC": "removed", "DDD": "added"}


def test_plan_files_round_trip(spark, tmp_path):
    rows = [("1", None, "b.py", 3, 'say "hi",\nthere', "é", "HI", None, None, None), ("2", "helper", "a.py", 1, None, None, None, "h", "r", "s")]
    plan = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c == 'line' else 'string'}" for c in sinks.PLAN))
    sinks.write_plan_csv(plan, str(tmp_path / "csv"))
    back = sinks.read_plan_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, plan.collect()))
    sinks.write_plan_json(plan, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    sinks.write_plan_xml(plan, str(tmp_path / "xml"))
    assert sorted((r.file, r.line) for r in sinks.read_plan_xml(spark, str(tmp_path / "xml")).collect()) == [("a.py", 1), ("b.py", 3)]
    (tmp_path / "bom.csv").write_text("﻿id,file,line,original\n1,f,2,x\n2,,3,y\n3,g,no,z\n", encoding="utf-8")
    assert [(r.id, r.file) for r in sinks.read_plan_csv(spark, str(tmp_path / "bom.csv")).collect()] == [("1", "f")]
    assert "&lt;" in sinks.plan_html(plan.withColumn("original", F.lit("<b>"))).first()[0]
    assert sinks.plan_text(plan).count() == 2


def test_content_store(spark, tmp_path):
    rows = spark.createDataFrame([(b"a",), (b"b",), (b"a",)], "content binary").withColumn("hash", F.sha2("content", 256))
    sinks.store_by_content(rows, str(tmp_path / "s"))
    sinks.store_by_content(rows, str(tmp_path / "s"), sinks.read_store(spark, str(tmp_path / "s")))
    assert [r.intact for r in sinks.read_store(spark, str(tmp_path / "s")).collect()] == [True, True]


def test_a_dictionary_is_scanned_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([("a b", 1), ("a, b", 2), ("c", 3)], "text string, ord int").mapInArrow(count, "text string, ord int")
    assert {(r.token, r.text) for r in dictionary.build(rows).collect()} == {("A_B", "a b"), ("A_B_2", "a, b"), ("C", "c")}
    assert seen.value == 3


def test_pairs_are_compared_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(seqdiff, "ROWS", 2)
    rows = [(i, f"a\nb{i}\nc", f"a\nc\nd{i}") for i in range(7)]
    found = seqdiff.diff_pairs(spark.createDataFrame(rows, "path int, before string, after string").coalesce(1)).collect()
    got = {r.path: [c.asDict() for c in r.changes] for r in found}
    assert got == {i: seqdiff.blocks(a.split("\n"), b.split("\n")) for i, a, b in rows}


def test_common_texts_are_judged_once(spark, monkeypatch):
    with_forms, seen = classify.with_forms, []

    def counted(rows, text="text"):
        seen.append(rows.count())
        return with_forms(rows, text)

    monkeypatch.setattr(classify, "with_forms", counted)
    texts = ["SELECT a FROM b"] * 500 + ["Please wait here"] * 400 + ["y " * 200] * 3 + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = classify.judged(rows, lambda t: {"class": classify.string_class(t), "sql": classify.is_sql(t)})
    assert got.columns == ["id", "text", "class", "sql"]
    want = {"SELECT a FROM b": ("sql", True), "Please wait here": ("human", False), "y " * 200: ("css", False), None: ("empty", None), "": ("empty", False)}
    assert {tuple(r) for r in got.collect()} == {(i, t, *want[t]) for i, t in enumerate(texts)}
    assert sorted(seen) == [3, 4]  # the three short texts once, and the rows of no or long text


def test_cleaner_scores_judges_common_texts_once(spark, monkeypatch):
    from lineweave import catalog_text

    with_forms, seen = classify.with_forms, []

    def counted(rows, text="text"):
        seen.append(rows.count())
        return with_forms(rows, text)

    monkeypatch.setattr(classify, "with_forms", counted)
    made = catalog_text.cleaner_scores(spark, "/root/testdata/sf0.001")
    assert made.columns == ["origin", "id", "score", "kept"]
    assert sum(seen) < catalog_text.texts(spark, "/root/testdata/sf0.001").count() / 4


def test_keys_are_sorted_by_hash(spark, monkeypatch):
    written, held = dictionary.written, []
    monkeypatch.setattr(dictionary, "written", lambda df, name: held.append(df) or written(df, name))
    rows = spark.createDataFrame([("a b", 1), ("a, b", 2), ("c", 3), ("c", 0), (None, 4)], "text string, ord int")
    assert {(r.token, r.text) for r in dictionary.build(rows).collect()} == {("A_B", "a b"), ("A_B_2", "a, b"), ("C", "c")}
    plan = held[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(key" in plan and "xxhash64(text" in plan


def test_literals_are_joined_by_hash_and_text(spark):
    lines = spark.createDataFrame([("f", 1, "a = 'Yes' + \"No\" + 'Yes'"), ("f", 2, "'Yes'"), ("g", 1, "x"), ("g", 2, None)], "file string, line_no int, line string")
    words = spark.createDataFrame([("Y", "Yes"), ("N", "No")], "token string, text string")
    made = dictionary.substitute(lines, words)
    want = {("f", 1, 'a = messages["Y"] + messages["N"] + messages["Y"]', "Y"), ("f", 2, 'messages["Y"]', "Y")}
    assert {(r.file, r.line_no, r.replacement, r.token) for r in made.collect()} == want
    assert "xxhash64(text" in made._jdf.queryExecution().optimizedPlan().toString()
