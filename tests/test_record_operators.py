"""Reconciliation, plans, chains, the registry, sources and streams on literal inputs."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lineweave import schemas
from lineweave.operators import artifact_diff, chains, plan_ops, reconcile, registry, structure
from lineweave.sources import archives, files, markup, patches
from lineweave.streaming import feeds

PLAN = schemas.CHANGE


def test_schemas_parse(spark):
    for ddl in schemas.SCHEMAS.values():
        assert spark.createDataFrame([], ddl).columns


@pytest.mark.parametrize("planned, observed", [(3, 2), (2, 3), (0, 1)])
def test_multiset_matching(spark, planned, observed):
    make = lambda n: spark.createDataFrame([("f", None, "x", i) for i in range(n)], "path string, before string, after string, ord int")
    got = reconcile.summary(reconcile.reconcile(make(planned), make(observed))).first()
    both = min(planned, observed)
    assert tuple(got) == (both, planned - both, observed - both)


def test_verify(spark):
    schema = "path string, before string, after string, ord int"
    a = spark.createDataFrame([("a.txt", "old", "new", 1)], schema)
    b = a.unionByName(spark.createDataFrame([("b.txt", None, "extra", 1)], schema))
    row = reconcile.verify(a, b, strict=True).first()
    assert (row.matched, row.unexpected, row.out_of_scope, row.confidence, row.verified) == (1, 1, 1, "High", False)
    assert reconcile.verify(a, a, strict=True).first().verified


def change(i, file="f", line=1, original="a", replacement="b", kind=None, **helper):
    return (i, kind, file, line, original, replacement, None, helper.get("id"), helper.get("ref"), helper.get("source"))


def test_plan_rules(spark):
    rows = [
        change("1"), change("2"), change("3", line=0), change("4", file=None), change("5", original=None, line=5), change("6", kind="rename", line=6),
        change("7", kind="helper", original=None, replacement=None, id="h", ref="r", source="s"), change("8", kind="helper", line=9, id="h", ref="r"), change("9", kind="replace", line=7),
    ]
    got = {r.id: r.errors for r in plan_ops.validate(spark.createDataFrame(rows, PLAN)).collect()}
    assert got == {"1": [], "2": ["duplicate"], "3": ["line below 1"], "4": ["missing file"], "5": ["missing original"], "6": ["unknown type"], "7": [], "8": ["missing helper_source"], "9": []}


def test_inverting_twice_and_hash(spark):
    plan = spark.createDataFrame([change("1"), change("2", line=2, kind="helper", id="h", ref="r", source="s")], PLAN)
    twice = plan_ops.invert(plan_ops.invert(plan))
    strip = lambda df: sorted((tuple(r)[1:] for r in df.collect()), key=str)
    assert strip(twice) == strip(plan)
    digest = plan_ops.plan_hash(plan).first()[0]
    assert digest == plan_ops.plan_hash(plan.orderBy(F.desc("id"))).first()[0]
    assert plan_ops.confirmed(plan_ops.plan_hash(plan), digest[:8]).first().confirmed
    assert not plan_ops.confirmed(plan_ops.plan_hash(plan), digest[:4]).first().confirmed


def test_applying_and_eligibility(spark):
    lines = spark.createDataFrame([("f", 1, "  a"), ("f", 2, "b"), ("f", 3, "a")], "file string, line_no int, line string")
    plan = spark.createDataFrame([change("1", line=3, replacement="new"), change("2", line=9, original="zz"), change("3", line=1, kind="helper", original=None, replacement=None, id="h", ref="r", source="top"), change("4", line=8)], PLAN)
    got = [r.line for r in plan_ops.apply(lines, plan.where("id in ('1', '3')")).orderBy("line_no").collect()]
    assert got == ["top", "  a", "b", "new"]
    assert {r.id: r.errors for r in plan_ops.eligible(lines, plan).collect()} == {"2": ["stale"], "4": ["ambiguous"]}
    assert plan_ops.rehydrate(plan.where("id = '1'")).first().text == "\n\nnew"


def test_chain_breaks_are_found(spark):
    rows = spark.createDataFrame([("s", i, f"p{i}") for i in range(4)] + [("t", 0, "x")], "scope string, ord int, p string")
    good = chains.chain(rows, "scope", "ord", ["p"])
    check = lambda df: {r.scope: (r.valid, r.first_bad) for r in chains.verify_chain(df, "scope", ["p"]).collect()}
    assert check(good) == {"s": (True, None), "t": (True, None)}
    assert check(good.withColumn("p", F.when(F.col("ord") == 2, "other").otherwise(F.col("p"))))["s"] == (False, 2)
    assert check(good.where("ord != 1"))["s"] == (False, 2)
    assert check(good.withColumn("previous_hash", F.when(F.col("ord") == 3, "0").otherwise(F.col("previous_hash"))))["s"] == (False, 3)


def test_provenance_and_lineage(spark):
    step = lambda actor: F.struct(F.lit("pack").alias("step"), F.lit(actor).cast("string").alias("actor"), F.lit("create").alias("action"), F.lit("now").alias("generated_at"))
    start = spark.range(1).select(F.lit("1").alias("provenance_version"), F.array(step("a")).alias("history"), F.lit("").alias("provenance_hash"))
    more = chains.append_provenance(start, step("b")).withColumn("ok", chains.valid_provenance(F.col("history"))).first()
    assert len(more.history) == 2 and len(more.provenance_hash) == 64 and more.ok
    assert not chains.append_provenance(start, step(None)).select(chains.valid_provenance(F.col("history"))).first()[0]
    rows = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None), ("x", "gone"), ("p", "q"), ("q", "p")], "hash string, parent string")
    got = {}
    for r in chains.walk(rows, rows, depth=5).collect():
        got.setdefault(r.start, []).append(r.node)
    assert sorted(got["c"]) == ["a", "b", "c"] and got["x"] == ["x"] and len(got["p"]) == 6
    kinds = spark.createDataFrame([("root", "i", None), ("derived", "i", "p"), ("detached", None, None), ("root", None, "p"), ("other", None, None)], "t string, i string, p string")
    errors = [r[0] for r in kinds.select(chains.lineage_errors(F.col("t"), F.col("i"), F.col("p"))).collect()]
    assert errors == [[], [], [], ["root without id", "root with parent"], ["unknown lineage type"]]
    picked = spark.createDataFrame([("ph", "pl", False), (None, None, False), ("ph", "pl", True)], "p string, l string, d boolean").select(chains.choose_lineage(F.col("p"), F.col("l"), F.lit("own"), F.col("d")).alias("x"))
    assert [tuple(r.x) for r in picked.collect()] == [("derived", "pl", "ph"), ("root", "own", None), ("detached", None, None)]


def test_revisions_start_anew_after_absence(spark):
    rows = spark.createDataFrame([("r", 0, "a"), ("r", 1, "a"), ("r", 2, "b"), ("r", 4, "b"), ("r", 5, "c")], "id string, snap int, s string")
    assert [r.revision for r in chains.revisions(rows, "id", "snap", ["s"]).orderBy("snap").collect()] == [1, 1, 2, 1, 2]


def test_feed_doesnt_skip_ties(spark):
    rows = spark.createDataFrame([("h%02d" % i, i // 4) for i in range(20)], "hash string, ts int")
    seen, cursor = [], (None, "")
    while page := registry.feed(rows, *cursor, limit=3).collect():
        seen += [r.hash for r in page]
        cursor = (page[-1].ts, page[-1].hash)
    assert seen == ["h%02d" % i for i in range(20)]
    assert [r.hash for r in registry.search(rows, prefix="h1", limit=2, offset=1).collect()] == ["h17", "h18"]


def test_artifact_diff(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "x", 1), (3, None, 1), (4, "x", 1)], "key int, s string, n int")
    b = spark.createDataFrame([(2, "y", 1), (3, "z", 1), (4, "x", 1), (5, "x", 1)], a.schema)
    got = {r.key: (r.status, r.change_type) for r in artifact_diff.diff(a, b, "key", ["s", "n"]).collect()}
    assert got == {1: ("removed", None), 2: ("modified", "semantic"), 3: ("modified", "schema_drift"), 5: ("added", None)}


def test_structures(spark):
    code = 'def connect(self):\n    "Doc."\n    x = 1\n    return x\n\n\ndef other(a):\n    return a + 1\n\n\nasync def no():\n    pass\n'
    rows = spark.createDataFrame([("a/storage/one.py", code), ("a/storage/two.py", code.replace("x", "y").replace('    "Doc."\n', "")), ("bad.py", "def (")], "file string, text string")
    found = markup.extract_functions(rows)
    assert sorted((r.name, r.start_line, r.line_count) for r in found.where("file like '%one.py'").collect()) == [("connect", 1, 4), ("other", 7, 2)]
    groups = structure.classify(structure.duplicate_groups(found))
    assert sorted((r.classification, r["count"]) for r in groups.collect()) == [("INTERFACE_IMPLEMENTATION", 2), ("UNKNOWN_DUPLICATION", 2)]
    assert structure.members(found).count() == 4


def test_html_and_office(spark):
    page = '<p title="T &amp; U">Hello <b>you</b></p><!-- no --><script>var a = "x<y";</script><input type="submit" value="Go"><style>p{}</style>end'
    got = [(s["text"], s["kind"], s["tag"]) for s in markup.html_strings(page)]
    assert got == [("T & U", "attribute", "p"), ("Hello", "text", "p"), ("you", "text", "b"), ("Go", "attribute", "input"), ("end", "text", "")]
    assert all(page[s["start"] : s["end"]] for s in markup.html_strings(page))
    assert markup.html_strings("<p>open <!-- never closed <b>x</b>") == [{"text": "open", "line": 1, "column": 4, "start": 3, "end": 7, "kind": "text", "tag": "p", "attribute": None}]
    assert markup.i18n_strings('<a class="x" data-i18n="k">Text</a>') == [{"key": "k", "text": "Text"}]
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="u"><w:p><w:r><w:t>One</w:t><w:t> two</w:t></w:r></w:p><w:p/></w:document>')
    assert markup.extract_office(spark.createDataFrame([("d.docx", raw.getvalue())], "path string, content binary")).first().text == "One two"


def test_files(spark, tmp_path):
    for name, content in {"a.txt": b"plain", "sub/b.bin": b"\0\1", "sub/c.log": b"\xff\xfe", "keep/d.log": b"x", "e.dex": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    tree = files.read_tree(spark, str(tmp_path))
    assert {r.path for r in tree.collect()} == {"a.txt", "sub/b.bin", "sub/c.log", "keep/d.log", "e.dex"}
    assert [r.path for r in files.without_ignored(tree, ["*.log", "/sub/"], keep="keep/", never=".dex").collect()] == ["a.txt", "keep/d.log"]
    assert {r.path: (r.admitted, r.reason) for r in files.admit(tree).collect() if r.path[:3] != "kee"} == {"a.txt": (True, None), "sub/b.bin": (False, "binary"), "sub/c.log": (False, "not UTF-8"), "e.dex": (True, None)}
    flags = {r.path: (r.s, r.d) for r in tree.select("path", files.is_binary_for_scan("content").alias("s"), files.is_binary_for_diff("content").alias("d")).collect()}
    assert flags["a.txt"] == (False, False) and flags["sub/b.bin"] == (True, True) and flags["sub/c.log"] == (True, False)
    scope = spark.createDataFrame([(1, "a.txt"), (2, "# e.dex"), (3, "# words"), (4, "gone.txt")], "n int, line string")
    read = files.read_scope(scope, tree)
    assert [r.status for r in read.orderBy("n").collect()] == ["active", "inactive", "comment", "active"]
    assert [r.path for r in files.refresh_scope(read, tree).where("status = 'active'").collect()] == ["a.txt", "keep/d.log", "sub/b.bin", "sub/c.log"]
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "path string")
    assert {r.path for r in files.changed_or_all(tree, names(), names(), names("a.txt", "e.dex")).collect()} == {"a.txt", "e.dex"}
    assert {r.path for r in files.changed_or_all(tree, names("a.txt"), names("gone"), names("e.dex")).collect()} == {"a.txt"}
    texts = spark.createDataFrame([("é".encode("utf-16"),), (b"\xef\xbb\xbfx",), (b"a\0",), (b"\xff",)], "c binary").select(files.decode("c").alias("t")).collect()
    assert [r.t for r in texts] == ["é", "x", None, None]


def test_patches(spark):
    text = """diff --git a/x.py b/x.py
index 1..2
--- a/x.py
+++ b/x.py
@@ -1,4 +1,5 @@
 one
-two
+2
 three
+four
 five
@@ -10 +11,0 @@
-ten
diff --git a/n.py b/n.py
new file mode 100644
--- /dev/null
+++ b/n.py
@@ -0,0 +1 @@
+new
diff --git a/bin b/bin
deleted file mode 100644"""
    rows = spark.createDataFrame([("p", i, x) for i, x in enumerate(text.split("\n"))], "patch string, n int, line string")
    got = sorted((r.path, r.status, r.start_line, r.type, r.before, r.after) for r in patches.parse_patch(rows).where("start_line is not null").collect())
    assert got == [("n.py", "added", 0, "insert", [], ["new"]), ("x.py", "modified", 2, "replace", ["two"], ["2"]), ("x.py", "modified", 4, "insert", [], ["four"]), ("x.py", "modified", 10, "delete", ["ten"], [])]
    assert patches.parse_patch(rows).where("path = 'bin'").first().status == "removed"
    a, b = (spark.createDataFrame([(x,) for x in t], "line string") for t in (["1\t2\tf", "-\t-\tg"], ["M\tf", "R100\tg\th"]))
    assert sorted(map(tuple, patches.changed_files(a, b).collect())) == [("f", False, "modified"), ("g", True, None), ("h", False, "renamed")]
    links = spark.createDataFrame([("dfp://v1/forge/" + "a" * 64,), ("dfp://v2/forge/" + "a" * 64,)], "t string")
    assert [r[0] for r in links.select(patches.plan_hash_of_link("t")).collect()] == ["a" * 64, None]


def test_archives(spark):
    members = [("payload/b", b"2"), ("payload/a", b"1")]
    assert archives.pack(members) == archives.pack(members[::-1])
    rows = spark.createDataFrame([("ok", archives.pack(members)), ("up", archives.pack([("../x", b"1")])), ("bad", b"no")], "path string, content binary")
    got = archives.read_archives(rows)
    assert sorted((r.path, r.member, r.error) for r in got.collect() if r.error is None) == [("ok", "payload/a", None), ("ok", "payload/b", None)]
    assert {r.path: r.error.split(":")[0] for r in got.where("error is not null").collect()} == {"up": "unsafe path", "bad": "unreadable"}
    assert len(archives.payload_hashes(got).first().payload_hash) == 64
    packed = archives.pack_groups(spark.createDataFrame([("g", "x", b"1"), ("g", "y", b"2")], "artifact string, path string, content binary")).first()
    assert packed.archive == archives.pack([("x", b"1"), ("y", b"2")])


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("2024-01-01 00:00:01", "h1", "Hello World"), ("2024-01-01 00:05:00", "h1", "SELECT 1"), ("2024-01-01 00:20:00", "h2", "Good Day")]
    batch = spark.createDataFrame(rows, "ts string, hash string, text string").withColumn("ts", F.to_timestamp("ts"))
    batch.coalesce(1).write.parquet(source)
    stream = lambda: feeds.new_files(spark, source, "ts timestamp, hash string, text string")

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert sorted(r.hash for r in run(feeds.first_seen(stream()), "seen", "append")) == ["h1", "h2"]
    assert sorted((r["class"], r["count"]) for r in run(feeds.class_counts(stream()), "classes", "complete")) == [("human", 1), ("human", 1), ("sql", 1)]


def test_a_streamed_chain_reports_gaps(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, schema = str(tmp_path / "in"), "scope string, n long, p string"
    rows = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b"), ("t", 0, "x")], schema)
    rows.coalesce(1).write.parquet(source)
    found = feeds.chained(feeds.new_files(spark, source, schema), "scope", "n", ["p"])

    def go():
        q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()

    go()
    spark.createDataFrame([("s", 2, "c"), ("s", 4, "e"), ("t", 0, "y")], schema).coalesce(1).write.mode("append").parquet(source)
    go()
    got = {(r.scope, r.sequence, r.linked): (r.state_hash, r.previous_hash) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {("s", 0, True), ("s", 1, True), ("s", 2, True), ("s", 4, False), ("t", 0, True), ("t", 0, False)}
    whole = {r.n: r.state_hash for r in chains.chain(spark.createDataFrame([("s", 1, "b"), ("s", 2, "c")], schema), "scope", "n", ["p"]).collect()}
    assert got["s", 2, True] == (whole[2], whole[1]) and got["s", 0, True][1] is None
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_long_lineages_and_cycles(spark):
    rows = spark.createDataFrame([(i, i - 1 if i else None) for i in range(1200)] + [(2000, 2001), (2001, 2000)], "hash long, parent long")
    starts = rows.where("hash in (1199, 2000)")
    got = {(r.start, r.node): r.depth for r in chains.walk(rows, starts).collect()}
    assert got == {(1199, i): 1199 - i for i in range(1200)} | {(2000, 2000): 0, (2000, 2001): 1}


def test_keys_beyond_a_hundred_signers(spark):
    keys = spark.createDataFrame([(i, i) for i in range(105)] + [(900, 900)], "key_id long, ord long")
    approvals = spark.createDataFrame([(i + 1, i) for i in range(104)] + [(0, 104), (3, 1), (900, 900)], "key_id long, signer long")
    want = {0: 0, 1: 1, 2: 2, 3: 2} | {i: i - 1 for i in range(4, 105)}
    assert {r.key_id: r.depth for r in chains.approved_keys(keys, approvals).collect()} == want
