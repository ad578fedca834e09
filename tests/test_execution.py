"""Planned diffs, verification, checks before a plan, regions' history, bundles, on literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from lineweave import schemas, sinks
from lineweave.functions import canonical
from lineweave.operators import chains, execution, plan_ops, regions, registry

FILE = "path string, text string"
HELPER = "helper_ref string, text string"


def change(i, file, line, original=None, replacement=None, kind=None, hid=None, ref=None):
    return (i, kind, file, line, original, replacement, None, hid, ref, "s" if kind == "helper" else None)


def rows(diff):
    return {r.path: (r.status, [(c.type, c.start_line, c.end_line, c.before, c.after) for c in r.changes]) for r in diff.collect()}


def test_planned_diff(spark):
    files = spark.createDataFrame([("a.py", "one\n  two\nthree"), ("b.py", "x"), ("c.py", "same"), ("d.py", "")], FILE)
    helpers = spark.createDataFrame([("helpers/h.py", "def h():\n    return 1\n"), ("helpers/old.py", "gone"), ("helpers/none.py", None)], HELPER)
    plan = [
        change("1", "a.py", 3, "three", "THREE"), change("2", "a.py", 1, kind="helper", hid="h", ref="helpers/h.py"), change("3", "a.py", 9, "two", "2"), change("4", "a.py", 4, "", "four"), change("5", "a.py", 5, "", "five"),
        change("6", "new.py", 1, "", "first"), change("7", "c.py", 1, "same", "same"), change("8", "b.py", 1, "stale", "y"), change("9", "b.py", 3, "", "after a gap"), change("10", "a.py", 1, kind="helper", hid="n", ref="helpers/none.py"),
    ]
    got = rows(execution.planned_diff(files, spark.createDataFrame(plan, schemas.CHANGE), helpers))
    assert got == {
        "a.py": ("modified", [("insert", 1, 1, [], ["# >>> HELPER START: h", "def h():", "    return 1", "# <<< HELPER END: h"]), ("replace", 2, 3, ["  two", "three"], ["  2", "THREE", "four", "five"])]),
        "new.py": ("added", [("insert", 1, 1, [], ["first"])]),
        "helpers/h.py": ("added", [("insert", 1, 2, [], ["def h():", "    return 1"])]),
        "helpers/old.py": ("removed", [("delete", 1, 1, ["gone"], [])]),
    }
    assert rows(execution.planned_diff(files, spark.createDataFrame([], schemas.CHANGE))) == {}
    assert rows(execution.planned_diff(files.limit(0), spark.createDataFrame(plan[5:6], schemas.CHANGE)))["new.py"][0] == "added"


def test_verify_execution(spark):
    shape = "path string, status string, changes array<struct<type:string,start_line:int,end_line:int,before:array<string>,after:array<string>>>"
    a = ("a.txt", "modified", [("replace", 1, 1, ["old"], ["new"])])
    expected, observed = spark.createDataFrame([a], shape), spark.createDataFrame([a, ("b.txt", "added", [("insert", 1, 1, [], ["extra"])])], shape)
    row = execution.verify_execution(expected, observed, strict=True).first()
    assert (row.match, row.verified, row.unexpected_files, row.missing_files, row.matched, row.unexpected, row.missing) == (False, False, 1, 0, 1, 1, 0)
    same = execution.verify_execution(observed, observed.orderBy(F.desc("path")), strict=True).first()
    assert same.match and same.verified and same.expected_hash == same.observed_hash and same.observed_files == 2
    empty = execution.verify_execution(expected.limit(0), expected.limit(0)).first()
    assert empty.match and empty.matched == 0


def test_preflight(spark):
    lines = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "y")], schemas.LINE)
    plan = [change("1", "a", 1, "x", "z"), change("2", "a", 1, "x", "w"), change("3", "../b", 1, "x", "z"), change("4", "a", 2, "q", "z"), change("5", "a", 9, "y", "z"), change("6", "a", 9, kind="helper", hid="h", ref="r"), change("7", "a", 1, kind="helper_remove", hid="h", ref="s")]
    changes = spark.createDataFrame(plan, schemas.CHANGE)
    hashes = spark.createDataFrame([("a", "1", "1"), ("../b", "1", None)], "file string, expected string, actual string")
    found = execution.preflight(lines, changes, helpers=spark.createDataFrame([("r",)], "helper_ref string"), hashes=hashes, given="00000000", complete=False, errors=("no log",))
    assert sorted((r.id or "", r.condition, r.error) for r in found.collect()) == [
        ("", "completeness", "the scan is incomplete"), ("", "confirmation", "the plan's hash is another"), ("", "preflight", "no log"), ("2", "structure", "duplicate"), ("3", "integrity", "the file's hash differs"),
        ("3", "safety", "path outside its root"), ("3", "source", "missing file"), ("4", "source", "stale"), ("5", "source", "ambiguous"), ("6", "preflight", "line beyond the file"), ("7", "authorization", "removal is not authorized"), ("7", "semantics", "unknown helper"),
    ]
    assert execution.admitted(changes, found).count() == 0
    good = changes.where("id = '1'")
    digest = plan_ops.plan_hash(good).first()[0]
    none = execution.preflight(lines, good, given=digest[:8])
    assert none.count() == 0 and execution.admitted(good, none).count() == 1
    paths = spark.createDataFrame([("a/../b",), ("/a",), ("C:\\x",), ("a..b/c",), ("..",), ("a/b",)], "p string")
    assert [r[0] for r in paths.select(execution.unsafe(F.col("p"))).collect()] == [True, True, True, False, True, False]


def test_region_history(spark):
    states = [("s", 1, "f", "A", "x"), ("s", 1, "g", "B", "y"), ("s", 2, "f", "A", "x"), ("s", 2, "f", "A", "x"), ("s", 2, "g", "B", "y"), ("s", 3, "f", "A", "z"), ("s", 4, "f", "A", "z")]
    df = spark.createDataFrame(states, "scope string, n int, file string, id string, original string")
    got = sorted((r.n, r.file, r.status) for r in regions.file_changes(df, "scope", "n", semantic=("original",)).collect())
    assert got == [(1, "f", "added"), (1, "g", "added"), (3, "f", "changed"), (3, "g", "removed")]
    entries = regions.history(df, "scope", "n", semantic=("original",))
    assert [(r.n, r.files, r.sequence) for r in entries.orderBy("n").collect()] == [(1, 2, 0), (3, 2, 1)]
    assert chains.verify_chain(entries, "scope", ["n", "changes_hash"]).first().valid
    forged = entries.withColumn("changes_hash", F.when(F.col("n") == 3, "0").otherwise(F.col("changes_hash")))
    assert chains.verify_chain(forged, "scope", ["n", "changes_hash"]).first().first_bad == 1
    assert regions.history(df.limit(0), "scope", "n", semantic=("original",)).count() == 0


def test_json_forms(spark):
    texts = ["plain", "é ü", "\U0001f600 x \ud7ff", 'a"b\n\x1f', ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    got = [r[0] for r in df.orderBy("n").select(canonical.ascii_json(canonical.canonical_json(t=F.col("t")))).collect()]
    assert got == [json.dumps({"t": t}, separators=(",", ":")) for t in texts]
    got = [r[0] for r in df.orderBy("n").select(canonical.pretty_json(t=F.col("t"), n=F.col("n"), none=F.lit(None).cast("string"))).collect()]
    assert got == [json.dumps({"t": t, "n": i, "none": None}, indent=2, sort_keys=True, ensure_ascii=False) + "\n" for i, t in enumerate(texts)]
    time = spark.sql("SELECT timestamp '2026-03-01 14:22:31.5' AS t").select(canonical.iso_time(F.col("t")), canonical.file_time(F.col("t"))).first()
    assert tuple(time) == ("2026-03-01T14:22:31Z", "2026-03-01T14-22-31Z")


def test_set_digest_ignores_order_and_counts_repeats(spark):
    df = spark.range(5000).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("h"))
    one = canonical.set_digest(df, "d").first().d
    assert one == canonical.set_digest(df.repartition(7).orderBy("h"), "d").first().d
    assert one != canonical.set_digest(df.unionByName(df.limit(1)), "d").first().d and one != canonical.set_digest(df.limit(4999), "d").first().d
    assert len(canonical.set_digest(df.limit(0), "d").first().d) == 64


def test_signed_subset_and_bundle(spark):
    row = (("dex", 1, "t", "x"), ("plan", ("sha256", "ab")), ("i", None, "root"), {"k": "é"}, [])
    df = spark.createDataFrame([row], schemas.MANIFEST)
    want = {"execution": {"k": "é"}, "lineage": {"lineage_id": "i", "parent": None, "type": "root"}, "payload_hash_algorithm": "sha256", "payload_hash_value": "ab", "payload_type": "plan"}
    assert df.select(registry.signed_subset(df)).first()[0] == json.dumps(want, sort_keys=True, separators=(",", ":"))
    more = df.withColumn("regions", F.array(F.lit("r")))
    assert json.loads(more.select(registry.signed_subset(more)).first()[0])["regions"] == ["r"]
    made = json.loads(registry.bundle(spark.createDataFrame([('{"a":1}',)], "plan string")).first().bundle)
    assert made["plan"] == {"a": 1} and made["hash"].startswith("sha256:")
    files = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("p", "c", 2), ("q", "d", 0)], "project string, path string, modified int")
    assert {r.project: r.path for r in registry.latest(files, "project").collect()} == {"p": "c", "q": "d"}
    assert registry.key_count(files).first()["keys"] == 4


def test_helper_and_region_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text('helper_file,target_file,line\nh.py,"a,b.py",3\n')
    assert [tuple(r) for r in sinks.read_helper_csv(spark, str(tmp_path / "h.csv")).collect()] == [("h.py", "a,b.py", 3)]
    found = regions.extract(spark.createDataFrame([("f", '{[#0_ABC:"one"#]} {[#1_ABD:"two"#]}'), ("e", '{[#2_ABE:"é"#]}')], "file string, text string"))
    sinks.write_regions_json(found, str(tmp_path / "r"))
    values = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert [(v["file"], v["version"], [r["id"] for r in v["regions"]]) for v in values] == [("e", 1, ["ABE"]), ("f", 1, ["ABC", "ABD"])]
    back = sinks.read_regions_json(spark, str(tmp_path / "r"), "id string, state int, original string")
    assert sorted(map(tuple, back.collect())) == [("e", "ABE", 2, "é"), ("f", "ABC", 0, "one"), ("f", "ABD", 1, "two")]


def test_states_are_copied(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "file string, text string")
    assert plan_ops.copied(files, files.where("file = 'b'")).collect() == [("b", "2")]
    assert plan_ops.copied(files).count() == 2
    with pytest.raises(Exception, match="outside"):
        plan_ops.copied(files.withColumn("file", F.lit("../a"))).collect()
