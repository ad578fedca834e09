"""Validation, marking and tree scans on literal inputs."""

import pytest
from pyspark.sql import functions as F

from lineweave import schemas
from lineweave.operators import regions, validation
from lineweave.plans import scan_plan, scan_tree


def test_document_checks(spark):
    block = [("replace", 1, 1, ["a"], ["b"])]
    rows = [("a", "modified", None, None, block), ("b", "renamed", None, None, block), (None, "added", None, None, []), ("c", "added", None, None, None), ("d", "added", None, None, [("swap", 1, 1, [], [])])]
    got = [r[0] for r in spark.createDataFrame(rows, schemas.DIFF).select(validation.diff_errors()).collect()]
    assert got == [[], ["unknown status"], ["missing path"], ["missing changes"], ["malformed change"]]
    good = (("dex", 1, "2024-01-01T00:00:00Z", "x"), ("plan", ("sha256", "a" * 64)), ("i", None, "root"), {}, [])
    bad = (("zip", None, "soon", "x"), (None, ("md5", "zz")), (None, "p", "root"), {}, [])
    got = [r[0] for r in spark.createDataFrame([good, bad], schemas.MANIFEST).select(validation.manifest_errors()).collect()]
    assert got[0] == [] and len(got[1]) == 8
    meta = spark.createDataFrame([(("t", "1", "2024-01-01T00:00:00Z", "", ""), []), (("t", "", "soon", "", ""), []), (None, [])], schemas.PLAN).select(validation.plan_meta_errors()).collect()
    assert [r[0] for r in meta] == [[], ["missing version", "generated_at is no time"], ["missing meta", "missing tool", "missing version", "generated_at is no time"]]
    scans = spark.createDataFrame([("obad", ["x"]), ("other", None)], "format string, items array<string>").select(validation.artifact_errors("scan").alias("errors"), F.lit("a").alias("artifact"))
    assert [r.errors for r in scans.collect()] == [[], ["unknown format", "missing list"]]
    assert tuple(validation.accepted(scans).first()) == ("a", False, 2)


def test_marked_text_gives_its_regions_back(spark):
    files = spark.createDataFrame([("f", "one two\nthree"), ("g", "plain")], "file string, text string")
    spans = spark.createDataFrame([("f", 4, 7), ("f", 8, 13)], "file string, start int, end int")
    marked = regions.mark(files, spans)
    found = regions.extract(marked).orderBy("n").collect()
    assert [r.original for r in found] == ["two", "three"] and all(r.state == 0 and len(r.id) == 3 for r in found)
    assert marked.where("file = 'g'").first().text == "plain"
    assert sorted(map(tuple, marked.collect())) == sorted(map(tuple, regions.mark(files, spans).collect()))
    with pytest.raises(Exception, match="overlapping"):
        regions.mark(files, spark.createDataFrame([("f", 4, 9), ("f", 8, 13)], spans.schema)).collect()
    assert all(r.ok for r in regions.intact(regions.extract(marked), regions.extract(marked)).collect())


def test_trees_are_scanned_by_extension(spark):
    rows = [("a.py", b'print("Hello World")'), ("b.html", b"<p>Good Morning</p>"), ("c.json", b'"Not Me Here"'), ("d.bin", b"\0"), (".tool/x.py", b'print("Own Output")'), ("e.js", b"say('Save the File')"), ("f.txt", b"")]
    tree = spark.createDataFrame(rows, "path string, content binary")
    assert sorted((r.path, r.text) for r in scan_tree.scan(tree).collect()) == [("a.py", "Hello World"), ("b.html", "Good Morning"), ("e.js", "Save the File")]
    assert [r.path for r in scan_tree.scan(tree, exclude=("javascript", "html")).collect()] == ["a.py"]
    own = scan_tree.Reader("mine", (".txt", ".html"), lambda t: t.select("path", F.lit(1).alias("line"), F.lit("From Mine").alias("text")), user=True)
    assert sorted((r.path, r.text) for r in scan_tree.scan(tree, (*scan_tree.BUILT_IN, own), only=(".html", ".txt")).collect()) == [("b.html", "From Mine"), ("f.txt", "From Mine")]
    assert scan_tree.resolve((*scan_tree.BUILT_IN, own), prefer_built_in=True)[".html"].name == "html"
    with pytest.raises(ValueError):
        scan_tree.resolve((own, scan_tree.Reader("other", (".txt",), own.scan, user=True)))


def test_a_plan_from_lines(spark):
    lines = spark.createDataFrame([("a.py", 1, 'print("Hello World")'), ("a.py", 2, 'x = "Hello World"'), ("b.py", 1, "y = 'nothing here'")], schemas.LINE)
    got = sorted((r.file, r.line, r.replacement, r.token) for r in scan_plan.generate(lines).collect())
    assert got == [("a.py", 1, 'print(messages["HELLO_WORLD"])', "HELLO_WORLD"), ("a.py", 2, 'x = messages["HELLO_WORLD"]', "HELLO_WORLD")]
    assert [r.severity for r in scan_plan.scan_artifact(lines).collect()] == ["warn", "warn"]


def test_small_readers_and_writers(spark, tmp_path):
    import hashlib
    import json

    from lineweave import sinks
    from lineweave.operators import plan_ops
    from lineweave.sources import archives, files

    (tmp_path / "w.dict").write_text("# words\nSELECT\n\n from \nselect\n")
    assert sorted(r.word for r in files.read_words(spark, str(tmp_path / "w.dict")).collect()) == ["from", "select"]
    (tmp_path / "feed.json").write_text(json.dumps({"artifacts": [{"hash": "a", "ts": "2024-01-01"}, {"hash": "b"}]}))
    assert [r.hash for r in files.read_feed(spark, str(tmp_path / "feed.json")).collect()] == ["a", "b"]
    head = b"XDEX1" + b"s" * 16
    rows = spark.createDataFrame([(head + hashlib.sha256(head).digest() + b"rest",), (head + b"x" * 32,), (b"",)], "content binary")
    assert [r[0] for r in rows.select(archives.sealed_header_ok()).collect()] == [True, False, False]
    plan = spark.createDataFrame([("1", None, "f", 2, "a", "b", None, None, None, None), ("2", "helper", "f", 1, None, None, None, "h", "r", "s"), ("3", "replace", "e", 1, "a", "b", "T", None, None, None)], schemas.CHANGE)
    assert [r.id for r in plan_ops.canonical(plan).collect()] == ["3", "1"]
    (tmp_path / "plan.xsd").write_text(sinks.plan_xsd())
    sinks.write_plan_xml(plan, str(tmp_path / "plan"))
    assert sinks.read_plan_xml(spark, str(tmp_path / "plan"), str(tmp_path / "plan.xsd")).count() == 3
    found = spark.createDataFrame([("HUMAN", "f", 1, "Hi You", "d", "warn"), ("HUMAN", "f", 2, "", "d", "warn")], schemas.FINDING)
    assert sinks.findings_text(found).first().value == "[WARN] f:1 Hi You"
    sinks.write_findings_json(found, str(tmp_path / "found"))
    assert sinks.read_findings_json(spark, str(tmp_path / "found")).count() == 1
