"""Queries over the artifact store, keyed logs, structural comparison, transform plug-ins and single documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import documents, sinks
from .catalog_files import _FIELDS, _PLAN, _plan
from .catalog_records import _REGISTRY, _artifacts
from .catalog_text import table
from .functions.shared import folder, written
from .functions.text import spread
from .operators import compare, dictionary, registry, seqdiff, treediff
from .plans import observe, pack, scan_tree, transform
from .sources import archives, files, markup, patches, store
from .sources.keyed import KeyedLog

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as artifacts in a store that two writes made, opened for one scan."""
    store.register(spark)
    rows, path = _artifacts(spark, sf_dir), folder(spark, "artifacts")
    whole = rows.select("hash", F.col("ts").cast("timestamp").alias("ts"), "type", F.lit(None).cast("string").alias("parent"), F.col("ord").alias("size"))
    for part in ("size % 2 = 0", "size % 2 = 1"):
        whole.where(part).write.format("artifacts").option("path", path).mode("append").save()
    return store.opened(spark, path).withColumn("ts", F.col("ts").cast(rows.schema["ts"].dataType))


@query(f"WITH {_REGISTRY} SELECT hash, ts, type, ord AS size FROM r WHERE type = 'O' AND starts_with(hash, 'a') ORDER BY ts DESC, hash OFFSET 5 LIMIT 20")
def stored_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.search(_stored(spark, sf_dir), "O", "a", offset=5).drop("parent")


@query(f"WITH {_REGISTRY} SELECT type, substr(hash, 1, 2) AS prefix, count(*) AS artifacts, sum(ord)::BIGINT AS total, min(ts) AS first, max(ts) AS last FROM r WHERE starts_with(hash, '0') OR starts_with(hash, 'f') GROUP BY ALL")
def stored_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _stored(spark, sf_dir).where(F.startswith("hash", F.lit("0"))).unionByName(_stored(spark, sf_dir).where(F.startswith("hash", F.lit("f"))))
    return both.groupBy("type", F.substring("hash", 1, 2).alias("prefix")).agg(F.count("*").alias("artifacts"), F.sum("size").alias("total"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("""WITH e AS (SELECT sha256(coalesce(lang, '') || coalesce(source, '') || n_chars % 50) AS normalized_hash, n_chars AS count, doc_id AS total_lines FROM documents)
  SELECT normalized_hash, arg_max(count, total_lines % 3 * 1000000000 + total_lines) AS count, arg_max(total_lines, total_lines % 3 * 1000000000 + total_lines) AS total_lines FROM e GROUP BY 1""")
def last_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence in three batches with repeated keys, compacted between the second and the third."""
    key = F.concat(F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), F.col("n_chars") % 50)
    rows = table(spark, sf_dir, "documents").select(F.sha2(key.cast("binary"), 256).alias("normalized_hash"), F.col("n_chars").alias("count"), F.col("doc_id").alias("total_lines"), F.col("doc_id").alias("ord"))
    log = KeyedLog(spark, folder(spark, "evidence"), "normalized_hash string, count long, total_lines long", "normalized_hash")
    for turn in range(3):
        log.put(rows.where(F.col("total_lines") % 3 == turn), "ord")
        if turn == 1:
            log.compact()
    return log.read()


@query("""WITH e AS (SELECT event_id, event_type, regexp_extract(props, '\\d+') AS k FROM events)
  SELECT event_id, '$["k"]' AS path, 'changed' AS status, k AS expected, (k::BIGINT + 1)::VARCHAR AS actual FROM e WHERE event_id % 3 = 0
  UNION ALL SELECT event_id, '$["n"][0]["id"]', 'unexpected', NULL, event_id::VARCHAR FROM e WHERE event_id % 5 = 0 UNION ALL SELECT event_id, '$["n"][1]', 'unexpected', NULL, '"' || event_type || '"' FROM e WHERE event_id % 5 = 0
  UNION ALL SELECT event_id, '$["k"]', 'missing', k, NULL FROM e WHERE event_id % 3 <> 0 AND event_id % 7 = 0""")
def differing_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events against another form of them: other white space throughout, some values changed, added and gone."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"\d+", 0)
    own = F.when(F.expr("event_id % 3 = 0"), F.concat(F.lit('"k" :'), (k.cast("long") + 1).cast("string"))).when(F.expr("event_id % 7 != 0"), F.concat(F.lit('"k":'), k))
    more = F.when(F.expr("event_id % 5 = 0"), F.concat(F.lit('"n": [{"id":'), "event_id", F.lit('}, "'), "event_type", F.lit('"]')))
    form = F.concat(F.lit("{"), F.concat_ws(", ", more, own), F.lit("}"))
    # an object that has become empty is a value itself
    both = compare.differences(e.select("event_id", F.col("props").alias("document")), e.select("event_id", form.alias("document")), "event_id")
    return both.where("path != '$'")


@query(f"WITH {_PLAN} SELECT * FROM p")
def plan_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "plan") + ".json"
    documents.write_plan_document(sinks.plan_columns(_plan(spark, sf_dir)), {"tool": "weave", "version": "1", "generated_at": "2024-01-01T00:00:00Z"}, path)
    return documents.read_plan_document(spark, path)[1].select(*_FIELDS)


@query(r"""WITH d AS (SELECT p_name AS text, 'T' || min(p_partkey) AS token FROM part GROUP BY 1), l AS (SELECT 'd/f' || p_partkey % 50 || CASE WHEN p_partkey % 4 = 0 THEN '.bad' ELSE '.py' END AS file, p_partkey::INT AS line_no, 'show("' || p_name || '")' AS original, p_name AS text FROM part WHERE p_partkey % 5 <> 0)
  SELECT file, line_no, original, CASE WHEN suffix(file, '.py') THEN 'show(messages["' || token || '"])' END AS replacement, CASE WHEN suffix(file, '.py') THEN token END AS token, CASE WHEN suffix(file, '.bad') THEN 'ValueError: ' || token END AS error FROM l JOIN d USING (text)""")
def transformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines through the plug-ins of their files' extensions, one of which fails, and one isn't there."""
    part = table(spark, sf_dir, "part")
    words = part.groupBy(F.col("p_name").alias("text")).agg(F.concat(F.lit("T"), F.min("p_partkey")).alias("token"))
    ending = F.when(F.expr("p_partkey % 5 = 0"), ".none").when(F.expr("p_partkey % 4 = 0"), ".bad").otherwise(".py")
    lines = part.select(F.concat(F.lit("d/f"), F.col("p_partkey") % 50, ending).alias("file"), F.col("p_partkey").cast("int").alias("line_no"), F.concat(F.lit('show("'), "p_name", F.lit('")')).alias("line"))

    def failing(line: str, mapping: dict[str, str]) -> tuple[str, str | None]:
        raise ValueError(", ".join(mapping.values()))

    return transform.transform(lines, words, {".bad": failing})


@query("""WITH d AS (SELECT doc_id, 'd' || doc_id AS path, lang, source, coalesce(text, '') AS text FROM documents)
  SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'added' ELSE 'modified' END AS status, NULL AS kind, NULL::BIGINT AS size, NULL AS sha256, '3:' || lang || '>' || source || ';5:>end' AS blocks FROM d WHERE doc_id % 4 <> 0
  UNION ALL SELECT path, CASE doc_id % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'modified' END, 'binary', CASE WHEN doc_id % 3 <> 1 THEN strlen(text) END, CASE WHEN doc_id % 3 <> 1 THEN sha256(text) END, '' FROM d WHERE doc_id % 4 = 0""")
def observed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch for each text document, with a block in two hunks, and listings that name the others as binary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("path"), "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    mode = F.when(F.col("doc_id") % 5 == 0, "new file mode 100644").otherwise("index 1..2")
    parts = [F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path"), mode, F.lit("--- a"), F.lit("+++ b"), F.lit("@@ -2,2 +2,2 @@"), F.lit(" same"), F.concat(F.lit("-"), "lang"), F.concat(F.lit("+"), "source"), F.lit("@@ -4,1 +4,2 @@"), F.lit(" same"), F.lit("+end")]
    lines = docs.where("doc_id % 4 != 0").select(F.col("doc_id").alias("patch"), F.posexplode(F.array(*parts)).alias("n", "line"))
    letter = F.expr("CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'D' ELSE 'M' END")
    numstat = docs.select(F.concat(F.expr("if(doc_id % 4 = 0, '-\t-\t', '2\t1\t')"), "path").alias("line"))
    found = observe.observed(lines, numstat, docs.select(F.concat(letter, F.lit("\t"), "path").alias("line")), docs.select("path", F.col("text").cast("binary").alias("content")))
    block = lambda c: F.concat(c["start_line"], F.lit(":"), F.array_join(c["before"], ","), F.lit(">"), F.array_join(c["after"], ","))
    return found.select("path", "status", "kind", "metadata.size", "metadata.sha256", F.array_join(F.transform("changes", block), ";").alias("blocks"))


@query("""WITH s AS (SELECT s_suppkey AS artifact, '{"balance":' || round(s_acctbal)::BIGINT || ',"name":"' || s_name || '"}' AS canonical, '{"name": "' || s_name || '", "balance": ' || round(s_acctbal)::BIGINT || '}' AS payload, s_suppkey % 5 = 0 AS detached,
    CASE WHEN s_suppkey % 3 = 0 THEN md5(s_name) WHEN s_suppkey % 4 = 0 THEN 'context' END AS parent, CASE WHEN s_suppkey % 3 = 0 THEN 'L' || s_nationkey ELSE 'C' END AS lineage, s_suppkey % 3 = 0 AS given FROM supplier),
  e AS (SELECT *, detached AND given AS wrong, CASE WHEN detached THEN '{"lineage_id":null,"parent":null,"type":"detached"}' WHEN parent IS NOT NULL THEN '{"lineage_id":"' || lineage || '","parent":"' || parent || '","type":"derived"}' ELSE '{"lineage_id":"' || sha256(canonical) || '","parent":null,"type":"root"}' END AS own FROM s)
  SELECT artifact, 'manifest.json' AS member, '{"execution":{},"lineage":' || own || ',"meta":{"created_at":"2024-01-01T00:00:00Z","created_by":"weave","format":"pack","version":1},"payload":{"hash":{"algorithm":"sha256","value":"' || sha256(canonical) || '"},"type":"plan"},"signatures":[]}' AS content, NULL AS error FROM e WHERE NOT wrong
  UNION ALL SELECT artifact, 'payload/plan.json', payload, NULL FROM e WHERE NOT wrong UNION ALL SELECT artifact, NULL, NULL, 'both a parent and detached' FROM e WHERE wrong""")
def packed_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as payloads with a parent, the context or neither, packed and read back."""
    s = table(spark, sf_dir, "supplier")
    above = lambda lineage, parent: F.concat(F.lit('{"lineage":{"type":"root","lineage_id":"'), lineage, F.lit('"},"payload":{"hash":{"value":"'), parent, F.lit('"}}}'))
    key = F.col("s_suppkey")
    rows = s.select(
        key.alias("artifact"), F.concat(F.lit('{"name": "'), "s_name", F.lit('", "balance": '), F.round("s_acctbal").cast("long"), F.lit("}")).alias("payload"), F.lit("plan").alias("type"), (key % 5 == 0).alias("detached"),
        F.when(key % 3 == 0, above(F.concat(F.lit("L"), "s_nationkey"), F.md5(F.col("s_name").cast("binary")))).alias("parent"), F.when(key % 4 == 0, above(F.lit("C"), F.lit("context"))).alias("context"),
    )
    packed = pack.pack(rows, "pack", "weave", "2024-01-01T00:00:00Z")
    read = archives.read_archives(packed.where("error is null"), "artifact", "archive").withColumn("content", F.col("content").cast("string"))
    return read.unionByName(packed.where("error is not null").select("artifact", *(F.lit(None).cast("string").alias(c) for c in ("member", "content")), "error"))


@query("SELECT 'T' || p_size AS token, arg_max(p_name || ', \"' || p_brand || '\" ' || p_partkey, p_partkey) AS text FROM part GROUP BY 1")
def dictionary_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that come again and again, with white space around them, in files whose names are in order."""
    path = folder(spark, "edited")
    rows = table(spark, sf_dir, "part").orderBy("p_partkey").select(F.concat(F.lit(" T"), "p_size", F.lit(" ")).alias("token"), F.concat(F.lit("  "), "p_name", F.lit(', "'), "p_brand", F.lit('" '), "p_partkey").alias("text"))
    rows.write.option("header", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return dictionary.read_csv(spark, path)


@query(f"WITH {_PLAN} SELECT * REPLACE (coalesce(type, 'replace') AS type) FROM p")
def plan_changes_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "changes-csv")
    sinks.write_plan_csv(_plan(spark, sf_dir), path)
    return sinks.read_changes_csv(spark, path).select(*_FIELDS)


@query(f"""WITH {_PLAN}, m AS (SELECT token, arg_max(replacement, (file, line, id, replacement)) AS r FROM p WHERE token IS NOT NULL GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY token DESC) AS back FROM m)
  SELECT '  "' || token || '": "' || r || '"' || CASE WHEN back > 1 THEN ',' ELSE '' END AS value FROM n UNION ALL SELECT unnest(['// made', 'export default {{', '}};'])""")
def token_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "tokens") + ".js"
    documents.write_token_module(_plan(spark, sf_dir), path, "// made\n")
    return spark.read.text(path)


@query("""WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), l AS (SELECT *, doc_id % 4 AS form FROM d)
  SELECT doc_id, CASE WHEN form = 0 THEN h END AS strict, CASE WHEN form < 3 THEN 'x' ELSE 'https' END AS scheme, CASE WHEN form < 3 THEN 'v1' ELSE 'a.b:8' END AS host, CASE form WHEN 0 THEN '/forge/' || h WHEN 1 THEN '/forge/' || upper(h) WHEN 2 THEN '/forge/' || h || '/' ELSE '/p' END AS path,
    CASE WHEN form = 3 THEN h END AS hash, CASE WHEN form = 3 THEN '2 b' ELSE '1' END AS version FROM l""")
def link_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    form, head = F.expr("doc_id % 4"), patches.LINK.split("(")[0].removeprefix(r"\A")
    link = F.when(form == 0, patches.link_of_plan(digest)).when(form == 1, F.concat(F.lit(head), F.upper(digest))).when(form == 2, F.concat(F.lit(head), digest, F.lit("/"))).otherwise(F.concat(F.lit("https://a.b:8/p?v=2%20b&hash="), digest, F.lit("#x")))
    rows = table(spark, sf_dir, "documents").select("doc_id", link.alias("link")).select("doc_id", patches.strict_hash_of_link("link").alias("strict"), patches.link_parts("link").alias("p"), form.alias("form"))
    # the tool's own scheme is not spelt out in SQL
    return rows.select("doc_id", "strict", F.when(F.col("form") < 3, F.when(F.startswith(F.lit(head), F.concat("p.scheme", F.lit("://"))), "x")).otherwise(F.col("p.scheme")).alias("scheme"), "p.host", "p.path", "p.hash", "p.version")


@query("""SELECT p_partkey AS path, p_size AS start_line, '' || p_brand AS before, p_type AS after FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, p_size + 1, p_name, p_name || '.' FROM part WHERE p_partkey % 5 = 0""")
def viewed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of which some differ in their lines' ends only; files without another change go."""
    block = lambda start, before, after: F.struct(F.lit("replace").alias("type"), start.cast("int").alias("start_line"), start.cast("int").alias("end_line"), F.array(before).alias("before"), F.array(after).alias("after"))
    key = F.col("p_partkey")
    real = F.when(key % 3 == 0, block(F.col("p_size"), F.concat("p_brand", F.lit(" ")), F.concat("p_type", F.lit("\t "))))
    name = block(F.col("p_size") + 1, F.concat("p_name", F.lit("  ")), F.when(key % 5 == 0, F.concat("p_name", F.lit("."))).otherwise(F.col("p_name")))
    files = table(spark, sf_dir, "part").select(key.alias("path"), F.lit("modified").alias("status"), F.array_compact(F.array(name, real)).alias("changes"))
    shown = seqdiff.view(files, trim=True, zero_impact=False, empty_files=False).select("path", F.inline("changes"))
    return shown.select("path", "start_line", F.col("before")[0].alias("before"), F.col("after")[0].alias("after"))


@query("""WITH d AS (SELECT p_name AS text, 'T' || min(p_partkey) AS token FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1), l AS (SELECT p_partkey, p_name, ['print("', 'raise Odd(''', 'logging.info("', 'show("'][p_partkey % 4 + 1] AS a, ['")  # "' || p_name || '"', ''')', '")', '")'][p_partkey % 4 + 1] AS b FROM part)
  SELECT p_partkey::VARCHAR AS file, 1 AS line_no, a || p_name || b AS original, replace(replace(a || p_name || b, '"' || p_name || '"', 't("' || token || '")'), '''' || p_name || '''', 't("' || token || '")') AS replacement, token FROM l JOIN d ON text = p_name WHERE p_partkey % 4 <> 3""")
def called_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, form = table(spark, sf_dir, "part"), F.expr("p_partkey % 4")
    words = part.where("p_partkey % 3 != 0").groupBy(F.col("p_name").alias("text")).agg(F.concat(F.lit("T"), F.min("p_partkey")).alias("token"))
    quote = lambda a, b: F.concat(F.lit(a), "p_name", F.lit(b))
    line = F.when(form == 0, F.concat(quote('print("', '")  # "'), "p_name", F.lit('"'))).when(form == 1, quote("raise Odd('", "')")).when(form == 2, quote('logging.info("', '")')).otherwise(quote('show("', '")'))
    return dictionary.substitute_calls(part.select(F.col("p_partkey").cast("string").alias("file"), F.lit(1).alias("line_no"), line.alias("line")), words)


@query("SELECT c_name AS path FROM customer UNION SELECT s_name FROM supplier UNION SELECT 'c' || text FROM benchmark")
def all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [table(spark, sf_dir, t).select(F.concat(F.lit(p), c).alias("path")) for t, c, p in (("customer", "c_name", ""), ("supplier", "s_name", ""), ("benchmark", "text", "c"))]
    return treediff.all_keys(*names)


@query("SELECT 'h' || p_size AS helper, p_name || ', \"' || p_brand || '\"' AS target, p_size AS line FROM part")
def helpers_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "helpers-csv")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("h"), "p_size").alias("helper_file"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("target_file"), F.col("p_size").alias("line"))
    rows.write.option("header", "true").option("escape", '"').csv(path)
    return sinks.read_helper_csv(spark, path)


@query("""WITH s AS (SELECT p_partkey, p_size, p_partkey % 9 <> 0 AS ok FROM part), n AS (SELECT p_size, count(*) AS alike FROM s WHERE ok GROUP BY 1)
  SELECT p_partkey AS file, 'f' || p_partkey AS name, 3 AS start_line, 5 AS end_line, 3 AS line_count, alike FROM s JOIN n USING (p_size) WHERE ok UNION ALL SELECT p_partkey, 'inner', 8, 10, 3, (SELECT count(*) FROM s WHERE ok) FROM s WHERE ok""")
def python_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with two functions, one of a class; those whose bodies differ in names and documentation only are alike. Some don't parse."""
    name = F.concat(F.lit("f"), "p_partkey")
    text = F.concat(F.lit("# "), "p_name", F.lit("\n\ndef "), name, F.lit("(x"), "p_partkey", F.lit("):\n    y = x"), "p_partkey", F.lit(" + "), "p_size", F.lit("\n    return y\n\nclass A:\n    def inner(self):\n        '''"), "p_name", F.lit("'''\n        return self\n"))
    sources = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("file"), F.when(F.col("p_partkey") % 9 == 0, F.concat(text, F.lit("("))).otherwise(text).alias("text"))
    found = written(markup.extract_functions(sources), "functions")
    alike = found.groupBy("signature").agg(F.count("*").alias("alike"))
    return found.join(alike, "signature").select("file", "name", "start_line", "end_line", "line_count", "alike")


@query("""SELECT s_suppkey, '{"execution":{"by":"' || s_name || '"},"lineage":{"lineage_id":"l","parent":null,"type":"root"},"payload_hash_algorithm":"sha256","payload_hash_value":"' || sha256(s_name) || '","payload_type":"plan' || chr(92) || 'u00e9"}' AS signed FROM supplier""")
def signed_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    payload = F.struct(F.lit("plan\u00e9").alias("type"), F.struct(F.lit("sha256").alias("algorithm"), F.sha2(F.col("s_name").cast("binary"), 256).alias("value")).alias("hash"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", payload.alias("payload"), F.struct(F.lit("l").alias("lineage_id"), none.alias("parent"), F.lit("root").alias("type")).alias("lineage"), F.create_map(F.lit("by"), F.col("s_name")).alias("execution"))
    return rows.select("s_suppkey", registry.signed_subset(rows).alias("signed"))


@query("SELECT sha256(o_orderkey::VARCHAR) AS hash, CASE WHEN o_custkey % 3 = 0 THEN 'p' || o_custkey END AS parent, o_orderstatus AS type, o_orderkey % 5 <> 0 AS dated FROM orders")
def feed_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved feed of one document; a time that isn't one is null."""
    parent = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit('"parent":"p'), "o_custkey", F.lit('",'))).otherwise("")
    ts = F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit('{"hash":"'), F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256), F.lit('",'), parent, F.lit('"type":"'), "o_orderstatus", F.lit('","ts":"'), ts, F.lit('"}')).alias("element"))
    path = folder(spark, "feed") + ".json"
    documents.write_document(rows, path, '{"artifacts":[\n', "\n]}", '{"artifacts":[]}')
    return files.read_feed(spark, path).select("hash", "parent", "type", F.col("ts").isNotNull().alias("dated"))


@query("""WITH t AS (SELECT p_partkey, p_name, ['.py', '.HTML', '.json', '.css', '.js'][p_partkey % 5 + 1] AS e FROM part)
  SELECT 'd/f' || p_partkey || e AS path, CASE e WHEN '.HTML' THEN 1 ELSE 2 END AS line, CASE e WHEN '.HTML' THEN 'Buy ' ELSE 'Save ' END || p_name || ' Now' AS text FROM t WHERE e IN ('.py', '.HTML', '.js') AND p_partkey % 7 <> 0""")
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of five kinds, of which markup goes to its reader and source to the detector; JSON, a language and binary files are left out."""
    ending = F.element_at(F.array(*map(F.lit, (".py", ".HTML", ".json", ".css", ".js"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    body = F.when(ending == ".HTML", F.concat(F.lit("<p>Buy "), "p_name", F.lit(" Now</p>"))).otherwise(F.concat(F.lit('x = 1\ny = "Save '), "p_name", F.lit(' Now"\n')))
    raw = F.concat(body, F.when(F.col("p_partkey") % 7 == 0, F.lit("\u0000")).otherwise("")).cast("binary")
    tree = table(spark, sf_dir, "part").select(F.concat(F.lit("d/f"), "p_partkey", ending).alias("path"), raw.alias("content"))
    return scan_tree.scan(tree, exclude=("css",)).select("path", "line", "text")
