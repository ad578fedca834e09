"""Queries over files: rules for paths and contents, forms that are written and read back, checks of documents, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .catalog_text import _q, table
from .functions.shared import folder
from .operators import chains, plan_ops, regions, treediff, validation
from .sources import archives, files, markup, patches

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TOOL = "weave"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_HEADS = ("", "src/", ".git/", f".{TOOL}/", "payload/", "dictionary-", f"{TOOL}-", f"a/.{TOOL}/")
_TAILS = (".py", ".png", ".json", "-plan.json", ".tar", ".txt", f"{TOOL}-plan.txt", "-manifest.json", ".so")


@query(f"""WITH t AS (SELECT p_partkey, ([{", ".join(map(_q, _HEADS))}])[p_partkey % {len(_HEADS)} + 1] || replace(p_name, ' ', '-') || ([{", ".join(map(_q, _TAILS))}])[p_partkey % {len(_TAILS)} + 1] AS path FROM part)
  SELECT p_partkey, path, list_bool_or([{", ".join(f"starts_with(path, {_q(x)})" for x in (*treediff.IGNORED_PREFIXES, f".{TOOL}/"))}]) OR list_bool_or([{", ".join(f"suffix(path, {_q(x)})" for x in treediff.IGNORED_SUFFIXES)}])
    OR contains(path, '{TOOL}-plan') OR (suffix(path, '.json') AND (contains(path, 'plan') OR contains(path, 'manifest') OR contains(path, '{TOOL}'))) AS ignored,
  '.{TOOL}' IN (SELECT unnest(string_split(path, '/'))) OR (suffix(path, '.json') AND (starts_with(split_part(path, '/', -1), 'dictionary-') OR starts_with(split_part(path, '/', -1), '{TOOL}-'))) AS generated FROM t""")
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(pick(_HEADS), F.replace("p_name", F.lit(" "), F.lit("-")), pick(_TAILS)).alias("path"))
    return rows.select("p_partkey", "path", treediff.is_ignored("path", TOOL).alias("ignored"), treediff.is_generated("path", TOOL).alias("generated"))


# documents as files: plain, with a byte-order mark, with a NUL, with a byte that no UTF-8 text has
_BYTES = """SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN encode(text) WHEN 1 THEN '\\xEF\\xBB\\xBF'::BLOB || encode(text) WHEN 2 THEN '\\x00'::BLOB || encode(text) ELSE encode(text) || '\\xFF'::BLOB END AS content FROM documents"""
_PLAIN = "x IN ('07', '08', '09', '0A', '0C', '0D', '1B')"


@query(f"""WITH f AS ({_BYTES}), h AS (SELECT doc_id, text, regexp_extract_all(hex(content)[:2048], '..') AS b FROM f)
  SELECT doc_id, doc_id % 4 = 2 OR len(list_filter(b, lambda x: NOT ({_PLAIN} OR x BETWEEN '20' AND '7E'))) > 0.3 * len(b) AS for_scan, len(list_filter(b, lambda x: NOT ({_PLAIN} OR x >= '20'))) > 0 AS for_diff,
  doc_id % 4 < 2 AS admitted, CASE doc_id % 4 WHEN 2 THEN 'binary' WHEN 3 THEN 'not UTF-8' END AS reason, CASE WHEN doc_id % 4 < 2 THEN sha256(text) END AS text_hash, CASE WHEN doc_id % 4 < 2 THEN sha256(text) END AS decoded_hash
  FROM h WHERE text IS NOT NULL""")
def file_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    kind = F.pmod("doc_id", F.lit(4))
    content = F.when(kind == 0, raw).when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), raw)).when(kind == 2, F.concat(F.unhex(F.lit("00")), raw)).otherwise(F.concat(raw, F.unhex(F.lit("FF"))))
    tree = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("path"), content.alias("content"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    seen = tree.select("path", files.is_binary_for_scan("content").alias("for_scan"), files.is_binary_for_diff("content").alias("for_diff"), files.decode("content").alias("decoded"))
    both = seen.join(files.admit(tree), "path")
    return both.select(F.col("path").alias("doc_id"), "for_scan", "for_diff", "admitted", "reason", digest("text").alias("text_hash"), digest("decoded").alias("decoded_hash"))


@query("""SELECT 'o' || o_orderkey AS path, o_orderkey % 4 = 1 AND o_orderkey % 5 <> 0 AS binary, CASE WHEN o_orderkey % 6 <> 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'renamed' ELSE 'modified' END END AS status
  FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 6 <> 0""")
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("o"), "o_orderkey")
    counts = o.where("o_orderkey % 5 != 0").select(F.when(F.expr("o_orderkey % 4 = 1"), F.concat(F.lit("-\t-\t"), path)).otherwise(F.concat(F.lit("3\t1\t"), path)).alias("line"))
    letter = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'A\t' WHEN 1 THEN concat('R100\told', o_orderkey, '\t') ELSE 'X\t' END")
    return patches.changed_files(counts, o.where("o_orderkey % 6 != 0").select(F.concat(letter, path).alias("line")))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    quoted = F.concat(F.lit('say "'), "p_type", F.lit('", '), "p_brand")
    return p.select(F.concat(F.lit("c"), "p_partkey").alias("id"), F.expr("if(p_partkey % 6 = 0, 'delete', 'replace')").alias("type"), F.replace("p_name", F.lit(" "), F.lit("/")).alias("file"), F.col("p_size").alias("line"), quoted.alias("original"), F.col("p_brand").alias("replacement"), F.expr("if(p_partkey % 4 = 0, concat('T', p_size), null)").alias("token"))


_PLAN = """p AS (SELECT 'c' || p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 'delete' END AS type, replace(p_name, ' ', '/') AS file, p_size AS line, 'say "' || p_type || '", ' || p_brand AS original, p_brand AS replacement,
  CASE WHEN p_partkey % 4 = 0 THEN 'T' || p_size END AS token FROM part)"""
_FIELDS = ("id", "type", "file", "line", "original", "replacement", "token")


@query(f"WITH {_PLAN} SELECT * FROM p")
def plan_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "plan-csv")
    sinks.write_plan_csv(_plan(spark, sf_dir), path)
    return sinks.read_plan_csv(spark, path).select(*_FIELDS)


@query(f"WITH {_PLAN} SELECT * REPLACE (coalesce(type, 'replace') AS type) FROM p")
def plan_from_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "plan-xml")
    sinks.write_plan_xml(_plan(spark, sf_dir), path)
    return sinks.read_plan_xml(spark, path).select(*_FIELDS)


@query(rf"""WITH {_PLAN} SELECT '{{"id":"' || id || '"' || coalesce(',"type":"' || type || '"', '') || ',"file":"' || file || '","line":' || line || ',"original":"' || replace(original, '"', '\"') || '","replacement":"' || replacement || '"' || coalesce(',"token":"' || token || '"', '') || '}}' AS value FROM p""")
def plan_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "plan-json")
    sinks.write_plan_json(_plan(spark, sf_dir), path)
    return spark.read.text(path)


@query(f"""WITH {_PLAN} SELECT 'text' AS form, file || ':' || line || ': ' || original || ' -> ' || replacement AS value FROM p
  UNION ALL SELECT 'html', '<tr><td>' || file || '</td><td>' || line || '</td><td>' || original || '</td><td>' || replacement || '</td></tr>' FROM p""")
def plan_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plan(spark, sf_dir)
    return sinks.plan_text(p).select(F.lit("text").alias("form"), "value").unionByName(sinks.plan_html(p).select(F.lit("html").alias("form"), "value"))


@query("SELECT 'human' AS type, 'd' || doc_id AS file, n_chars::INT AS line, text, 'text' AS detector, CASE doc_id % 2 WHEN 0 THEN 'low' ELSE 'high' END AS severity FROM documents WHERE text <> ''")
def findings_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "findings")
    found = table(spark, sf_dir, "documents").select(F.lit("human").alias("type"), F.concat(F.lit("d"), "doc_id").alias("file"), F.col("n_chars").cast("int").alias("line"), "text", F.lit("text").alias("detector"), F.expr("if(doc_id % 2 = 0, 'low', 'high')").alias("severity"))
    sinks.write_findings_json(found, path)
    return sinks.read_findings_json(spark, path)


@query("""SELECT '[' || CASE user_id % 2 WHEN 0 THEN 'LOW' ELSE 'HIGH' END || '] u' || user_id || ':' || event_id || ' ' || event_type AS value FROM events""")
def findings_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return sinks.findings_text(e.select(F.concat(F.lit("u"), "user_id").alias("file"), F.col("event_id").alias("line"), F.col("event_type").alias("text"), F.expr("if(user_id % 2 = 0, 'low', 'high')").alias("severity")))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("S_"), "s_suppkey").alias("token"), F.concat(F.lit('a "'), "s_name", F.lit('" \\ b')).alias("text"))


_WORDS = """w AS (SELECT 'S_' || s_suppkey AS token, 'a "' || s_name || '" ' || chr(92) || ' b' AS text FROM supplier)"""


@query(f"""WITH {_WORDS} SELECT 'csv' AS form, token, text FROM w UNION ALL SELECT 'json', token, text FROM w
  UNION ALL SELECT 'script', NULL, 'messages["' || token || '"] = "' || replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '";' FROM w""")
def dictionary_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    csv, json = folder(spark, "words-csv"), folder(spark, "words-json")
    sinks.write_dictionary_csv(words, csv)
    sinks.write_dictionary_json(words, json)
    parts = [spark.read.option("header", "true").option("escape", '"').csv(csv), spark.read.schema("token string, text string").json(json), sinks.dictionary_module(words).select(F.lit(None).cast("string").alias("token"), F.col("value").alias("text"))]
    named = [p.select(F.lit(form).alias("form"), "token", "text") for form, p in zip(("csv", "json", "script"), parts, strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("SELECT DISTINCT sha256(text) AS hash, length(text) AS chars, true AS intact FROM documents WHERE text IS NOT NULL")
def stored_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "store")
    payloads = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.col("text").cast("binary").alias("content"))
    # a second delivery of all adds only what the first had not
    sinks.store_by_content(payloads.where("doc_id % 2 = 0").drop("doc_id"), path)
    sinks.store_by_content(payloads.drop("doc_id"), path, sinks.read_store(spark, path))
    return sinks.read_store(spark, path).select("hash", F.length(F.col("content").cast("string")).cast("long").alias("chars"), "intact")


def _regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions of two snapshots: orders as regions of their customer's file."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("id"), F.lit(1).alias("n"), F.col("o_orderkey"), F.col("o_orderpriority").alias("original"))
    changed = F.expr("if(o_orderkey % 3 = 0, concat(original, '!'), original)")
    shape = lambda df, text: df.select("file", "id", "n", F.lit(0).alias("state"), text.alias("original"), F.lit(None).cast("string").alias("modified"), F.sha2(text.cast("binary"), 256).alias("hash"))
    return shape(o.where("o_orderkey % 5 != 0"), F.col("original")), shape(o.where("o_orderkey % 7 != 0"), changed)


@query("""SELECT o_custkey AS file, o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'added' WHEN o_orderkey % 7 = 0 THEN 'removed' WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE 'same' END AS status FROM orders WHERE o_orderkey % 35 <> 0""")
def reconciled_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.reconcile(*_regions(spark, sf_dir))


@query("SELECT o_custkey AS file, o_orderkey AS id, o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 AS ok FROM orders WHERE o_orderkey % 5 <> 0")
def intact_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, now = _regions(spark, sf_dir)
    return regions.intact(now, manifest)


@query("SELECT o_custkey AS file, o_orderkey AS id, (o_orderkey % 9)::INT AS start_line, o_orderpriority AS original FROM orders")
def regions_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    path = folder(spark, "regions")
    found = o.select(F.col("o_custkey").cast("string").alias("file"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 9).cast("int").alias("start_line"), F.lit(1).alias("start_column"), F.col("o_orderpriority").alias("original"))
    sinks.write_regions_json(found, path)
    back = sinks.read_regions_json(spark, path, "id bigint, start_line int, original string")
    return back.withColumn("file", F.col("file").cast("long"))


@query("""SELECT o_orderkey, concat_ws(', ', CASE WHEN o_orderkey % 11 = 0 THEN 'missing path' END, CASE WHEN o_orderkey % 4 = 0 THEN 'unknown status' END, CASE WHEN o_orderkey % 7 = 0 THEN 'missing changes' END,
  CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 3 = 0 THEN 'malformed change' END) AS diff, concat_ws(', ', CASE WHEN o_orderkey % 5 = 0 THEN 'missing tool' END, CASE WHEN o_orderkey % 2 = 0 THEN 'generated_at is no time' END) AS meta,
  concat_ws(', ', CASE WHEN o_orderkey % 4 <> 0 THEN 'unknown format' END, CASE WHEN o_orderkey % 7 = 0 THEN 'missing list' END) AS goals FROM orders""")
def document_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = "named_struct('type', if(o_orderkey % 3 = 0, 'move', 'insert'), 'start_line', 1, 'end_line', 2, 'before', array('a'), 'after', array('b'))"
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr("if(o_orderkey % 11 = 0, null, 'p')").alias("path"), F.expr("if(o_orderkey % 4 = 0, 'odd', 'modified')").alias("status"), F.expr(f"if(o_orderkey % 7 = 0, null, array({one}))").alias("changes"),
        F.expr("named_struct('tool', if(o_orderkey % 5 = 0, null, 't'), 'version', '1', 'generated_at', if(o_orderkey % 2 = 0, 'soon', '2024-01-01T00:00:00Z'))").alias("meta"), F.expr("if(o_orderkey % 4 = 0, 'goal-discovery', 'obad')").alias("format"),
    )
    found = {"diff": validation.diff_errors(), "meta": validation.plan_meta_errors(), "goals": validation.artifact_errors("goals", items="changes")}
    return rows.select("o_orderkey", *(F.array_join(errors, ", ").alias(name) for name, errors in found.items()))


@query("""WITH s AS (SELECT c_custkey, '{"action":"scan","actor":"' || c_name || '","generated_at":"t0","step":1}' AS a, CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"apply"' END AS b FROM customer)
  SELECT c_custkey, 2 AS steps, c_custkey % 3 <> 0 AS valid, sha256('{"history":[' || a || ',{"action":' || b || ',"actor":"x","generated_at":"t1","step":2}],"provenance_version":"1.0"}') AS provenance_hash FROM s""")
def provenance_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.struct(F.lit(1).alias("step"), F.col("c_name").alias("actor"), F.lit("scan").alias("action"), F.lit("t0").alias("generated_at"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit("1.0").alias("provenance_version"), F.array(first).alias("history"))
    step = F.struct(F.lit(2).alias("step"), F.lit("x").alias("actor"), F.when(F.col("c_custkey") % 3 != 0, "apply").alias("action"), F.lit("t1").alias("generated_at"))
    return chains.append_provenance(rows, step).select("c_custkey", F.size("history").alias("steps"), chains.valid_provenance(F.col("history")).alias("valid"), "provenance_hash")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'detached' WHEN s_suppkey % 3 = 0 THEN 'derived' ELSE 'root' END AS type,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 6 = 0 THEN s_nationkey::VARCHAR ELSE s_suppkey::VARCHAR END AS lineage_id, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 3 = 0 THEN s_nationkey::VARCHAR END AS parent FROM supplier""")
def chosen_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    third, sixth = (F.when(F.col("s_suppkey") % n == 0, F.col("s_nationkey")) for n in (3, 6))
    chosen = chains.choose_lineage(third, sixth, F.col("s_suppkey"), F.col("s_suppkey") % 5 == 0)
    return table(spark, sf_dir, "supplier").select("s_suppkey", chosen.alias("l")).select("s_suppkey", "l.*")


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 2 THEN CASE doc_id % 3 WHEN 0 THEN sha256(coalesce(text, '')) ELSE upper(sha256(coalesce(text, ''))) END END AS plan_hash FROM documents")
def linked_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    head = patches.LINK.split("(")[0].removeprefix(r"\A")
    link = F.expr("doc_id % 3")
    url = F.when(link == 0, F.concat(F.lit(head), digest)).when(link == 1, F.concat(F.lit(head), F.upper(digest), F.lit("/"))).otherwise(F.concat(F.lit(head), digest, F.lit("0")))
    return table(spark, sf_dir, "documents").select("doc_id", url.alias("link")).select("doc_id", patches.plan_hash_of_link("link").alias("plan_hash"))


@query(f"WITH {_PLAN} SELECT id, file, line, original, replacement, token FROM p WHERE type IS NULL")
def canonical_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_ops.canonical(_plan(spark, sf_dir))


def _scope(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A scope file that names, leaves out and remarks on parts as files, and the tree where some are gone."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr("concat('d', p_partkey % 3, '/f', p_partkey, '.py')").alias("path"))
    line = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat(path, ' ') WHEN 1 THEN concat('# ', path) WHEN 2 THEN '# note' ELSE '' END")
    tree = p.where("p_partkey % 5 != 0").select("path")
    return files.read_scope(p.select(F.col("p_partkey").alias("n"), line.alias("line")), tree), tree


_SCOPE = """f AS (SELECT p_partkey AS n, 'd' || p_partkey % 3 || '/f' || p_partkey || '.py' AS name FROM part),
  s AS (SELECT n, CASE n % 4 WHEN 0 THEN name || ' ' WHEN 1 THEN '# ' || name ELSE '# note' END AS line, CASE WHEN n % 4 = 2 THEN 'note' ELSE name END AS path,
    CASE WHEN n % 4 = 0 THEN 'active' WHEN n % 4 = 1 AND n % 5 <> 0 THEN 'inactive' ELSE 'comment' END AS status FROM f WHERE n % 4 <> 3)"""


@query(f"WITH {_SCOPE} SELECT * FROM s")
def scope_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scope(spark, sf_dir)[0]


@query(f"""WITH {_SCOPE} SELECT * FROM s WHERE NOT (n % 4 = 0 AND n % 5 = 0)
  UNION ALL SELECT 0, name, name, 'active' FROM f WHERE n % 5 <> 0 AND n % 4 IN (2, 3)""")
def refreshed_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.refresh_scope(*_scope(spark, sf_dir)).select(F.col("n").cast("long").alias("n"), "line", "path", "status")


@query(rf"""WITH t AS (SELECT p_partkey, ([{", ".join(map(_q, _HEADS))}])[p_partkey % {len(_HEADS)} + 1] || replace(p_name, ' ', '-') || ([{", ".join(map(_q, _TAILS))}])[p_partkey % {len(_TAILS)} + 1] AS path FROM part)
  SELECT p_partkey, path FROM t WHERE NOT suffix(path, '.so') AND (starts_with(path, 'src/') OR NOT regexp_matches(path, '(^|/)\.git/|(^|/)[^/]*\.png(/|$)|(^|/)a/.*\.txt(/|$)|^payload/c[^/]*(/|$)'))""")
def unignored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = path_rules(spark, sf_dir).select("p_partkey", "path")
    return files.without_ignored(tree, [".git/", "*.png", "a/**.txt", "/payload/c*"], keep="src/", never=".so")


@query("SELECT 'some' AS changes, p_partkey AS path FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 3 = 0 UNION ALL SELECT 'none', p_partkey FROM part WHERE p_partkey % 5 <> 0")
def files_to_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"))
    unignored, none = tree.where("path % 5 != 0"), tree.where("false")
    some = files.changed_or_all(tree, tree.where("path % 4 = 0"), tree.where("path % 3 = 0"), unignored)
    every = files.changed_or_all(tree, none, none, unignored)
    return some.select(F.lit("some").alias("changes"), "path").unionByName(every.select(F.lit("none").alias("changes"), "path"))


@query("SELECT DISTINCT lower(s_name) AS word FROM supplier WHERE s_suppkey % 3 <> 0")
def listed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "words")
    table(spark, sf_dir, "supplier").select(F.expr("CASE s_suppkey % 6 WHEN 0 THEN concat('# ', s_name) WHEN 3 THEN ' ' ELSE concat(' ', s_name, ' ') END").alias("value")).write.text(path)
    return files.read_words(spark, path)


@query("SELECT o_custkey AS artifact, 'm/' || o_orderkey || '.txt' AS member, o_orderpriority AS content, NULL::VARCHAR AS error FROM orders")
def archived_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("artifact"), F.concat(F.lit("m/"), "o_orderkey", F.lit(".txt")).alias("path"), F.col("o_orderpriority").cast("binary").alias("content"))
    return archives.read_archives(archives.pack_groups(members), "artifact", "archive").withColumn("content", F.col("content").cast("string"))


@query("SELECT p_partkey, 'k' || p_partkey AS key, p_type || ' & ' || p_brand AS text FROM part")
def marked_up_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<html><body><p>"), "p_name", F.lit('</p><b class="x" data-i18n="k'), "p_partkey", F.lit('">'), "p_type", F.lit(" &amp; "), "p_brand", F.lit("</b></body></html>"))
    return markup.extract_i18n(table(spark, sf_dir, "part").select("p_partkey", html.alias("html")), "p_partkey", "html")


@query("""SELECT p_partkey::VARCHAR AS file, 1 AS line_no, '  new ' || p_brand AS line FROM part UNION ALL SELECT p_partkey::VARCHAR, 2, '# ' || p_type FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT p_partkey::VARCHAR, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END, 'end' FROM part""")
def applied_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two lines, a replacement of the first, and the same helper twice before the second in every other file."""
    p = table(spark, sf_dir, "part").withColumn("file", F.col("p_partkey").cast("string"))
    lines = p.select("file", F.posexplode(F.array(F.concat(F.lit("  "), "p_name"), F.lit("end"))).alias("n", "line")).select("file", (F.col("n") + 1).alias("line_no"), "line")
    shape = lambda df, **c: sinks.plan_columns(df.select("file", *(v.alias(k) for k, v in c.items())))
    replaced = shape(p, id=F.concat(F.lit("r"), "file"), line=F.lit(1), original=F.col("p_name"), replacement=F.concat(F.lit("new "), "p_brand"))
    helpers = [shape(p.where("p_partkey % 2 = 0"), id=F.concat(F.lit(i), "file"), type=F.lit("helper"), line=F.lit(2), helper_id=F.lit("h"), helper_source=F.concat(F.lit("# "), source)) for i, source in (("x", "p_type"), ("y", "p_name"))]
    return plan_ops.apply(lines, replaced.unionByName(helpers[0]).unionByName(helpers[1])).select("file", F.col("line_no").cast("int").alias("line_no"), "line")


@query("SELECT s_suppkey, s_suppkey % 3 = 0 AS ok FROM supplier")
def sealed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit(b"SEAL1"), F.unhex(F.md5(F.col("s_name").cast("binary"))))
    digest = F.unhex(F.sha2(head, 256))
    content = F.expr("s_suppkey % 3")
    rows = table(spark, sf_dir, "supplier").withColumn("content", F.when(content == 0, F.concat(head, digest, head)).when(content == 1, F.concat(head, head)).otherwise(F.substring(head, F.lit(1), F.lit(9))))
    return rows.select("s_suppkey", archives.sealed_header_ok("content", magic=b"SEAL1").alias("ok"))
