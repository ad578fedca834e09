"""Single documents, keyed logs, structural comparison, conformance cases and transform plug-ins."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lineweave import documents, sinks
from lineweave.operators import chains, compare, dictionary, plan_ops
from lineweave.plans import conformance, transform
from lineweave.sources.keyed import KeyedLog

PLAN = "id string, type string, file string, line int, original string, replacement string, token string, extra string"


def plan_rows():
    odd = 'a "q" \\ \n\t\x01\x1f\x7f é 😀 </x>'
    rows = [(f"c{i}", "replace" if i % 3 else None, f"f{i % 7}", i, odd if i % 5 == 0 else f"o{i}", f"r{i}", "T" if i % 2 else None, "x") for i in range(200)]
    return [*rows, ("h", "helper", "f1", 3, None, None, None, "x"), (None, None, None, None, None, "", None, None), ("c1", None, "f1", 1, "twin", "z", None, None)]


@pytest.mark.parametrize("parts", [1, 8])
def test_a_plan_is_one_document(spark, tmp_path, parts):
    path, meta = str(tmp_path / "plan.json"), {"generated_at": "t", "version": "1", "tool": 'we"ave', "project_root": "left out"}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    documents.write_plan_document(spark.createDataFrame(plan_rows(), PLAN).repartition(parts), meta, path)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    with open(path, encoding="utf-8", newline="") as file:
        text = file.read()
    order = lambda r: (r[2] is not None, r[2] or "", r[3] or 0, r[0] is not None, r[0] or "")
    read = json.loads(text)
    fields = lambda r: {k: v for k, v in zip(sinks.PLAN, [r[0], None if r[1] == "replace" else r[1], *r[2:7]]) if v is not None}
    want = sorted(plan_rows(), key=order)
    got = read["changes"]
    assert [order([c.get(k) for k in ("id", "type", "file", "line")]) for c in got] == list(map(order, want))
    assert sorted(map(json.dumps, got)) == sorted(json.dumps(fields(r)) for r in want)
    # the bytes are those of the usual writer, whatever the number of tasks
    assert text == json.dumps({"meta": {k: meta[k] for k in documents.META}, "changes": got}, indent=2, ensure_ascii=False) + "\n"
    assert hashlib.sha256(text.encode()).hexdigest() == KNOWN.setdefault("plan", hashlib.sha256(text.encode()).hexdigest())
    head, changes = documents.read_plan_document(spark, path)
    assert head.first().tool == 'we"ave' and changes.count() == len(want)
    documents.write_plan_document(changes.where("false"), {}, path)
    with open(path, encoding="utf-8") as file:
        assert file.read() == '{\n  "meta": {},\n  "changes": []\n}\n'


KNOWN: dict = {}


def test_evidence_and_index_documents(spark, tmp_path):
    evidence = spark.createDataFrame([("bb", 2, 9), ("aa", 3, 12)], "normalized_hash string, count long, total_lines long")
    index = spark.createDataFrame([("UNKNOWN", 0.5, "bb"), ("SHARED", 0.95, "aa")], "classification string, confidence double, evidence_hash string")
    documents.write_evidence_document(evidence, str(tmp_path / "e.json"))
    documents.write_index_document(index, str(tmp_path / "i.json"))
    plain = {r.normalized_hash: r.asDict() for r in evidence.collect()}
    assert (tmp_path / "e.json").read_text() == json.dumps(plain, indent=4, sort_keys=True)
    assert (tmp_path / "i.json").read_text() == json.dumps(sorted((r.asDict() for r in index.collect()), key=lambda r: r["evidence_hash"]), indent=4, sort_keys=True)
    assert sorted(documents.read_evidence_document(spark, str(tmp_path / "e.json")).select(*evidence.columns).collect()) == sorted(evidence.collect())
    assert sorted(documents.read_index_document(spark, str(tmp_path / "i.json")).collect()) == sorted(index.collect())


def test_the_last_write_of_a_key_counts(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "log"), "hash string, n long, text string", "hash")
    assert log.read().count() == 0
    rng, held = random.Random(5), {}
    for turn in range(5):
        batch = [(f"k{rng.randint(0, 30)}", turn, rng.choice(("a", "b", None)), i) for i in range(40)] + [(None, 1, "x", 0)]
        for key, n, text, _ in batch[:-1]:
            held[key] = (n, text)
        log.put(spark.createDataFrame(batch, "hash string, n long, text string, ord long").repartition(3), "ord")
        if turn in (1, 3):
            log.compact()
        assert {r.hash: (r.n, r.text) for r in log.read().collect()} == held
    assert [n for _, n in log._folders()] == ["base-00000004", "run-00000005"]
    (tmp_path / "log" / "run-00000006").mkdir()  # a run that was never finished
    assert log.read().count() == len(held)
    assert log.put(spark.createDataFrame([("new", 1, None, 0)], "hash string, n long, text string, ord long"), "ord") == 6 and log.read().count() == len(held) + 1


def flat(value, path="$"):
    if isinstance(value, dict) and value:
        return {k: v for key, x in value.items() for k, v in flat(x, f"{path}[{json.dumps(key, ensure_ascii=False)}]").items()}
    if isinstance(value, list) and value:
        return {k: v for i, x in enumerate(value) for k, v in flat(x, f"{path}[{i}]").items()}
    return {path: json.dumps(value, ensure_ascii=False, separators=(",", ":"))}


def test_differences_by_path(spark):
    rng = random.Random(6)

    def make(depth):
        kind = rng.random()
        if depth and kind < 0.4:
            return {rng.choice(["a", "b c", 'q"', "é", "0"]): make(depth - 1) for _ in range(rng.randint(0, 3))}
        if depth and kind < 0.7:
            return [make(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([1, -2, 1.5, True, None, "x", "", 'y"\n', [], {}])

    pairs = []
    for _ in range(60):
        a = make(4)
        pairs.append((a, json.loads(json.dumps(a)) if rng.random() < 0.3 else make(4)))
    rows = lambda side: spark.createDataFrame([(i, json.dumps(p[side], indent=rng.choice([None, 2]))) for i, p in enumerate(pairs)] + [(100 + side, "[1]"), (200, "{oops" + str(side)), (201, "{same"), (202, None)], "key long, document string")
    got = {(r[0], r.path): (r.status, r.expected, r.actual) for r in compare.differences(rows(0).withColumnRenamed("key", "k"), rows(1).withColumnRenamed("key", "k"), "k").collect()}
    want = {(100, "$[0]"): ("missing", "1", None), (101, "$[0]"): ("unexpected", None, "1"), (200, "?"): ("changed", "{oops0", "{oops1")}
    for i, (a, b) in enumerate(pairs):
        x, y = flat(a), flat(b)
        for path in {*x, *y}:
            if x.get(path) != y.get(path):
                want[i, path] = ("missing" if path not in y else "unexpected" if path not in x else "changed", x.get(path), y.get(path))
    assert got == want
    assert compare.differences(rows(0), rows(0), "key").count() == 0


def test_conformance_cases(spark, tmp_path):
    def case(name, a, b, files=None, digest=None):
        for side, content in (("a", a), ("b", b)):
            for path, text in content.items():
                file = tmp_path / name / f"input_{side}" / path
                file.parent.mkdir(parents=True, exist_ok=True)
                file.write_text(text)
        if files is not None:
            (tmp_path / name / "expected.json").write_text(json.dumps({"files": files}, indent=1))
        if digest is not None:
            (tmp_path / name / "expected.hash").write_text(f"{digest}\n")

    block = {"type": "replace", "start_line": 2, "end_line": 3, "before": ["line2", "line3"], "after": ["changed2", "changed3"]}
    before, after = "line1\nline2\nline3\nline4\n", "line1\nchanged2\nchanged3\nline4\n"
    entry = {"path": "d/x.txt", "status": "modified", "changes": [block]}
    canonical = json.dumps({"changes": [block], "path": "d/x.txt", "status": "modified"}, separators=(",", ":"))
    inner = hashlib.sha256(canonical.encode()).hexdigest()
    good = hashlib.sha256(inner.encode()).hexdigest()
    case("good", {"d/x.txt": before, "same": "q"}, {"d/x.txt": after, "same": "q"}, [entry], good)
    case("wrong", {"d/x.txt": before}, {"d/x.txt": after}, [entry | {"status": "added", "changes": [block | {"after": ["changed2", "other"]}]}], "0" * 64)
    case("equal", {"x": "a"}, {"x": "a"}, [], hashlib.sha256(b"").hexdigest())
    case("bare", {"x": "a"}, {"x": "b"})
    got = sorted((r.case, r.path, r.status, r.expected, r.actual) for r in conformance.run_cases(spark, str(tmp_path)).where("case != 'bare'").collect())
    assert got == [("wrong", '$["files"][0]["changes"][0]["after"][1]', "changed", '"other"', '"changed3"'), ("wrong", '$["files"][0]["status"]', "changed", '"added"', '"modified"'), ("wrong", "hash", "changed", "0" * 64, good)]
    assert {r.status for r in conformance.run_cases(spark, str(tmp_path)).where("case = 'bare'").collect()} == {"unexpected"}


def test_transform_plugins(spark):
    rng = random.Random(7)
    words = spark.createDataFrame([("YES", "Yes"), ("NO", "No way"), ("E", "")], "token string, text string")
    pool = ["x = 'Yes'", 'y = "No way" + \'Yes\'', "plain", "'other'", '""', "'Yes' 'Yes'"]
    lines = [(f"d/f{i % 5}.py", i // 5, rng.choice(pool)) for i in range(100)] + [("a.txt", 1, "'Yes'"), ("b.PY", 1, "'Yes'"), ("b.PY", 2, None), ("py", 1, "'Yes'")]
    rows = spark.createDataFrame(lines, "file string, line_no int, line string")
    got = transform.transform(rows, words)
    ours = rows.where("lower(file) like '%.py'")
    want = dictionary.substitute(ours, words.where("text != ''").unionByName(words.where("text = ''"))).collect()
    assert sorted((r.file, r.line_no, r.original, r.replacement, r.token) for r in got.collect()) == sorted((r.file, r.line_no, r.original, r.replacement, r.token) for r in want)
    assert got.where("error is not null").count() == 0

    def failing(line, mapping):
        if "Yes" in line:
            raise ValueError("no")
        return line.upper(), None

    more = transform.transform(rows.unionByName(spark.createDataFrame([("a.txt", 2, "low")], rows.schema)), words, {".TXT": failing}).where("file = 'a.txt'").orderBy("line_no").collect()
    assert [(r.line_no, r.replacement, r.error) for r in more] == [(1, None, "ValueError: no"), (2, "LOW", None)]
    assert transform.resolve(".PY") is transform.substitute_literals and transform.resolve(".md", {".py": failing}) is None


def test_sparse_files_and_far_lines(spark):
    rows = [("1", "a", 0, "zero"), ("2", "a", 3, "three"), ("3", "b", 0, "zero"), ("4", "b", -5, "less"), ("5", "c", 1, "one"), ("6", "c", 2147483647, "far"), ("7", "d", 2, None), ("8", "e", 2, "later"), ("80", "e", 2, "no"), ("9", "e", 5, "last")]
    plan = spark.createDataFrame(rows, "id string, file string, line int, replacement string").withColumn("type", F.lit(None).cast("string"))
    assert {r.file: r.text for r in plan_ops.rehydrate(plan).collect()} == {"a": "\n\nthree", "c": None, "d": "\n", "e": "\nlater\n\n\nlast"}
    assert {(r.file, r.line): r.text for r in plan_ops.rehydrated_lines(plan).where("file = 'c'").collect()} == {("c", 1): "one", ("c", 2147483647): "far"}


def test_a_key_chain_of_thousands(spark):
    keys = spark.createDataFrame([(0, 0)], "key_id long, ord long")
    chain = [(i + 1, i) for i in range(5000)]
    got = {r.key_id: r.depth for r in chains.approved_keys(keys, spark.createDataFrame(chain, "key_id long, signer long")).collect()}
    assert got == {i: i for i in range(5001)}


def test_approvals_against_a_plain_search(spark):
    rng = random.Random(8)
    for _ in range(4):
        edges = [(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(rng.randint(10, 70))] + [(50, 51), (51, 50), (52, 51), (5, 52), (None, 1), (1, None)]
        depth, frontier = {3: 0}, [3]
        while frontier:
            ahead = sorted({k for k, s in edges if s in frontier and k is not None} - depth.keys())
            depth |= {k: depth[frontier[0]] + 1 for k in ahead}
            frontier = ahead
        keys = spark.createDataFrame([(3, 1), (9, 2)], "key_id long, ord long")
        assert {r.key_id: r.depth for r in chains.approved_keys(keys, spark.createDataFrame(edges, "key_id long, signer long")).collect()} == depth
    assert chains.approved_keys(keys.where("false"), spark.createDataFrame(edges, "key_id long, signer long")).count() == 0


def test_plans_keep_their_order(spark, tmp_path):
    """Rows by file, line and id, also through CSV files read in the order of their names."""
    rng = random.Random(9)
    rows = [(f"c{i:02d}", None, rng.choice(("b", "a", "c/d")), rng.randint(1, 9), "o", "r", None, None) for i in range(40)]
    plan = spark.createDataFrame(rows, PLAN).repartition(4)
    want = [(r[2], r[3], r[0]) for r in sorted(rows, key=lambda r: (r[2], r[3], r[0]))]
    assert [(r.file, r.line, r.id) for r in plan_ops.ordered(plan).collect()] == want
    sinks.write_plan_csv(plan, str(tmp_path / "plan"))
    written = [line.split(",")[:3] for part in sorted((tmp_path / "plan").glob("part-*")) for line in part.read_text().splitlines()[1:]]
    assert [(f, int(n), i) for i, f, n in written] == want
    assert [(r.file, r.line, r.id) for r in plan_ops.minimal(sinks.read_plan_csv(spark, str(tmp_path / "plan"))).collect()] == want
    again = sinks.read_changes_csv(spark, str(tmp_path / "plan"))
    assert {r.type for r in again.collect()} == {"replace"} and again.count() == 40


def test_elements_of_a_list_are_found_from_any_split(spark, tmp_path):
    from lineweave.sources.elements import elements

    rng = random.Random(5)
    odd = ["}", "{", "]", '"', "\\", "\\\"}", "],", "é", "a{b}c", '\\"', ""]
    docs = []
    for d in range(4):
        item = lambda: {"k": "".join(rng.choices(odd, k=4)), "m": {"x": [{"y": rng.choice(odd)}, [1, [2]]]} if rng.random() < 0.3 else None}
        members = {"meta": {"a": {"z": "}"}, "b": [{"q": 1}]}, "one": [item() for _ in range(3)], "list": [item() for _ in range(rng.choice((0, 1, 40)))], "more": {"list": [{"no": 1}]}, "n": 1}
        names = list(members)
        rng.shuffle(names)
        docs.append({k: members[k] for k in names})
        text = json.dumps(docs[-1], indent=rng.choice((None, 2)), ensure_ascii=rng.random() < 0.5) + rng.choice(("", "\n"))
        (tmp_path / f"{d}.json").write_text(text)
    (tmp_path / "cut.json").write_text('{"list": [{"k": "gone"}, {"k"')
    (tmp_path / "cut2.json").write_text('{"list": [{"k": "gone"}')
    want = sorted(json.dumps(x, sort_keys=True) for d in docs for x in d["list"])
    for size in ("128m", "397b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = elements(spark, str(tmp_path), "list")
            assert sorted(json.dumps(json.loads(r.value), sort_keys=True) for r in found.collect()) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_xml_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "XML_ROWS", 30)
    rows = spark.createDataFrame(plan_rows(), PLAN).where("id like 'c%' and id != 'c1'").withColumn("original", F.lit("o")).coalesce(1)
    sinks.write_plan_xml(rows, str(tmp_path / "plan"))
    assert len(list((tmp_path / "plan").glob("part-*"))) > 3
    assert sinks.read_plan_xml(spark, str(tmp_path / "plan")).count() == rows.count()


def test_sources_are_parsed_by_all_cores(spark, monkeypatch):
    from lineweave import catalog_forms

    dealt, read = [], catalog_forms.markup.extract_functions
    monkeypatch.setattr(catalog_forms.markup, "extract_functions", lambda df: dealt.append(df.rdd.getNumPartitions()) or read(df))
    catalog_forms.python_functions(spark, "/root/testdata/sf0.001")
    assert dealt == [spark.sparkContext.defaultParallelism]
