"""Queries over ingestion from bytes, ordered ignore rules, word lists of any size and versions of long files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_files import ORACLES as FILES
from .catalog_files import path_rules
from .catalog_text import _BOTH_LINES, _CLEANER, _EDIT, _SCORE, TEXTS, _pairs, _q, _trees, table, texts
from .functions.shared import drop, folder, written
from .functions.text import lines, normal_line
from .operators import align, seqdiff, wordlists
from .operators import classify as cl
from .plans import ingest
from .sources import archives, ignore

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# archives of the orders of a customer; what is wrong with one follows from the sum of its order keys
_FAULTS = 14
_UNPACKED = 400_000


def _archives(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(artifact, content), the members that were packed, and what a verifier says of the signatures among them."""
    item = F.concat(F.lit('{"priority": "'), "o_orderpriority", F.lit('", "key": '), "o_orderkey", F.lit("}"))
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("artifact")).agg(
        F.pmod(F.sum("o_orderkey"), F.lit(_FAULTS)).alias("fault"), F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("item")))), lambda x: x.item).alias("items"), F.min("o_orderstatus").alias("status")
    )
    is_ = lambda *n: F.col("fault").isin(*n)
    # written with spaces and keys out of order; what is hashed is the canonical form
    said = F.when(is_(13), F.concat(F.lit('[ "'), "status", F.lit('" ]'))).when(is_(10), F.lit("{broken")).otherwise(F.concat(F.lit("["), F.array_join("items", ", "), F.lit("]")))
    plain = F.transform("items", lambda x: F.concat(F.lit('{"key":'), F.regexp_extract(x, r'(\d+)}\z', 1), F.lit(',"priority":"'), F.regexp_extract(x, r'\A\{"priority": "([^"]*)"', 1), F.lit('"}')))
    canonical = F.when(is_(13), F.concat(F.lit('["'), "status", F.lit('"]'))).otherwise(F.concat(F.lit("["), F.array_join(plain, ","), F.lit("]")))
    stated = F.sha2(F.when(is_(9), F.lit("other")).otherwise(canonical).cast("binary"), 256)
    manifest = F.concat(F.lit('{"meta":{"format":"'), F.when(is_(8), "odd").otherwise("pack"), F.lit('","version":1,"created_at":"2024-01-01T00:00:00Z"},"payload":{"type":"plan","hash":{"algorithm":"sha256","value":"'), stated, F.lit('"}},"lineage":{"lineage_id":"l","type":"root"}}'))
    key = F.when(is_(11), "x").otherwise(F.concat(F.lit("k"), F.col("artifact") % 5))
    signature = F.concat(F.lit('{"algorithm":"ed25519","key_id":"'), key, F.lit('","signature":"'), "artifact", F.lit('"}'))
    member = lambda name, content, when=F.lit(True): F.when(when, F.struct(F.lit(name).alias("path"), content.cast("binary").alias("content")))
    members = F.array_compact(F.array(
        member("manifest.json", manifest, ~is_(7)), member("payload/plan.json", said), member("signatures/s.json", signature, is_(11, 12)),
        member("payload/zeros", F.repeat(F.lit("0"), _UNPACKED), is_(4)), member("../x", F.col("status"), is_(5)), member("other.txt", F.col("status"), is_(6)),
    ))
    each = own.select("artifact", "fault", F.explode(members).alias("m")).select("artifact", "fault", "m.*")
    packed = archives.pack_groups(each.select("artifact", "path", "content")).join(own.select("artifact", "fault"), "artifact")
    raw = F.col("archive")
    content = F.when(is_(2), F.concat(F.lit(b"PK"), raw)).when(is_(3), F.substring(raw, F.lit(1), (F.octet_length(raw) / 2).cast("int"))).otherwise(raw)
    verdicts = each.where(F.startswith("path", F.lit("signatures/"))).select(F.sha2("content", 256).alias("signature"), (F.col("artifact") % 3 != 0).alias("valid"))
    # a delivery is read three times
    return written(packed.select("artifact", content.alias("content")), "delivery"), each, verdicts


@query(f"""WITH g AS (SELECT o_custkey AS artifact, (sum(o_orderkey) % {_FAULTS})::INT AS fault, string_agg('{{"key":' || o_orderkey || ',"priority":"' || o_orderpriority || '"}}', ',' ORDER BY o_orderkey) AS items, min(o_orderstatus) AS status FROM orders GROUP BY o_custkey),
  p AS (SELECT *, sha256(CASE WHEN fault = 13 THEN '["' || status || '"]' ELSE '[' || items || ']' END) AS payload_hash,
    CASE WHEN fault = 12 THEN sha256(sha256('{{"algorithm":"ed25519","key_id":"k' || artifact % 5 || '","signature":"' || artifact || '"}}')) END AS signature_set_hash,
    CASE WHEN fault = 2 THEN 'header' WHEN fault IN (3, 4) THEN 'decompression' WHEN fault IN (5, 6) THEN 'structure' WHEN fault IN (7, 8) THEN 'manifest' WHEN fault IN (9, 10) THEN 'payload' WHEN fault = 11 OR (fault = 12 AND (artifact % 5 = 4 OR artifact % 3 = 0)) THEN 'signature' END AS stage,
    CASE fault WHEN 2 THEN 'no gzip header' WHEN 3 THEN 'truncated' WHEN 4 THEN 'too large' WHEN 5 THEN 'unsafe path' WHEN 6 THEN 'unknown entry' WHEN 7 THEN 'no manifest' WHEN 8 THEN 'unknown format' WHEN 9 THEN 'payload hash' WHEN 10 THEN 'not JSON'
      WHEN 11 THEN 'unknown key' WHEN 12 THEN CASE WHEN artifact % 5 = 4 THEN 'unknown key' WHEN artifact % 3 = 0 THEN 'invalid signature' END END AS reason FROM g)
  SELECT artifact, stage, reason, CASE WHEN stage IS NULL THEN payload_hash END AS payload_hash, CASE WHEN stage IS NULL THEN signature_set_hash END AS signature_set_hash, CASE WHEN stage IS NULL THEN (fault = 12)::BIGINT END AS signatures,
    CASE WHEN stage IS NULL THEN artifact = min(artifact) FILTER (stage IS NULL) OVER (PARTITION BY payload_hash) END AS stores_payload FROM p""")
def staged_ingestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _, verdicts = _archives(spark, sf_dir)
    keys = table(spark, sf_dir, "region").where("r_regionkey < 4").select(F.concat(F.lit("k"), "r_regionkey").alias("key_id"))
    known = table(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("payload_hash"))
    done = ingest.ingest(files, known, keys, verdicts, limits={"bytes": _UNPACKED // 2}, formats=("pack",))
    good = done.admitted.select("artifact", F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("reason"), "payload_hash", "signature_set_hash", "signatures", "stores_payload")
    bad = done.quarantine.select("artifact", "stage", "reason", *(F.lit(None).cast(good.schema[c].dataType).alias(c) for c in good.columns[3:]))
    return good.unionByName(bad)


_RULES = [
    "# what is made", "", "*.png", "!src/*.png", ".git/", "/payload/", "!payload/small*.json", "a/**/*.txt", "!hot-[bg]???.json", "*-manifest.json  ", "!/src/**", "src/red*", r"\#odd", "?ld-[!a-m]*.py", "!**/old-widget.py", "**/steel-*",
    *(f"none-{i}/x/*.so" for i in range(40)),
]
_RULE_PATTERNS = [
    (r"(^|/)[^/]*\.png(/|$)", True), (r"^src/[^/]*\.png(/|$)", False), (r"(^|/)\.git/", True), (r"^payload/", True), (r"^payload/small[^/]*\.json(/|$)", False), (r"^a/(.*/)?[^/]*\.txt(/|$)", True), (r"(^|/)hot-[bg][^/]{3}\.json(/|$)", False),
    (r"(^|/)[^/]*-manifest\.json(/|$)", True), (r"^src/.", False), (r"^src/red[^/]*(/|$)", True), (r"(^|/)#odd(/|$)", True), (r"(^|/)[^/]ld-[^a-m/][^/]*\.py(/|$)", True), (r"(^|/)old-widget\.py(/|$)", False), (r"(^|/)steel-[^/]*(/|$)", True),
]
_PATHS = f"SELECT p_partkey, path FROM ({FILES['path_rules']})"
_DEFAULTS = ["*.so", "dictionary-*/"]
_DECIDED = "CASE " + " ".join(f"WHEN regexp_matches(path, '{p}') THEN {str(v).lower()}" for p, v in reversed(_RULE_PATTERNS)) + " END"


@query(f"""WITH t AS ({_PATHS}), d AS (SELECT p_partkey, path, {_DECIDED} AS ignored FROM t)
  SELECT p_partkey, path, ignored, NOT coalesce(ignored, false) AS in_scope, starts_with(path, '.git/') OR NOT (coalesce(ignored, false) OR suffix(path, '.so') OR suffix(path, '.tar')) AS in_project FROM d""")
def ignored_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = path_rules(spark, sf_dir).select("p_partkey", "path")
    scope, project = ignore.filesystem_scope(tree, _RULES), ignore.project_files(tree, _RULES, _DEFAULTS, ".git", ".tar")
    there = lambda df, name: df.select("p_partkey", F.lit(True).alias(name))
    rows = tree.withColumn("ignored", ignore.decides("path", _RULES)).join(there(scope, "in_scope"), "p_partkey", "left").join(there(project, "in_project"), "p_partkey", "left")
    return rows.select("p_partkey", "path", "ignored", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("in_scope", "in_project")))


_LISTED = """w AS MATERIALIZED (SELECT DISTINCT upper(unnest([p_name, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)])) AS word FROM part UNION SELECT unnest(['SELECT', 'FROM', 'X', 'T WHERE X = ', 'A_B']))"""
_TOKENS = "list_filter(regexp_extract_all(lower(text), '[a-z_]+'), lambda x: list_contains(lowered, x))"
_HITS = "len(list_filter(listed, lambda x: contains(upper(text), x)))"


@query(rf"""WITH {TEXTS}, {_LISTED}, h AS MATERIALIZED (SELECT origin, id, text, {_HITS} AS hits, {_TOKENS} AS known FROM (SELECT origin, id, coalesce(text, '') AS text FROM texts), (SELECT list(word) AS listed, list(lower(word)) AS lowered FROM w)),
  k AS (SELECT *, len(list_filter(known, lambda x: x IN ({", ".join(map(_q, cl.STRONG_SQL))}))) AS strong, len(list_filter(known, lambda x: x IN ({", ".join(map(_q, cl.STRUCTURAL_SQL))}))) AS structural FROM h)
  SELECT origin, id, (strong > 0 AND structural > 0) OR (len(known) > 1 AND regexp_matches(text, '[=?()*,]')) OR (strong > 0 AND contains(text, '(') AND contains(text, ')')) OR list_bool_or([{", ".join(f"contains(upper(text), {_q(p)})" for p in cl.SQL_PHRASES)}]) AS is_sql,
    (hits * 3 + {_SCORE})::INT AS sql_score, CASE WHEN hits >= 2 THEN 999 ELSE (CASE hits WHEN 1 THEN 2 ELSE 0 END) + {_CLEANER} END::INT AS score FROM k""")
def dictionary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select(F.explode(F.array_append(F.split("p_name", " "), F.col("p_name"))).alias("word"))
    words = named.unionByName(spark.createDataFrame([(w,) for w in ("select", "from", "x", "t where x = ", "a_b")], "word string"))
    rows = wordlists.with_scores(texts(spark, sf_dir), words)
    return rows.select("origin", "id", "is_sql", F.col("sql_score").cast("int").alias("sql_score"), F.col("score").cast("int").alias("score"))


_VERSIONS = """l AS (SELECT l_returnflag AS path, l_orderkey AS o, l_linenumber AS i, l_linestatus || ' ' || CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber::VARCHAR ELSE l_partkey || '/' || l_suppkey END AS line FROM lineitem)"""


@query(f"""WITH {_VERSIONS}, a AS (SELECT path, o, i, 0 AS k, CASE WHEN o % 11 = 0 THEN line || '!' ELSE line END AS line FROM l WHERE o % 7 <> 0 UNION ALL SELECT path, o, i, 1, line FROM l WHERE o % 13 = 0)
  SELECT path, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN o % 500 < 20 THEN o + 1000 ELSE o END, o, i, k, line) AS n, line FROM a""")
def rebuilt_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long files, lines dropped, changed, doubled and moved: the later version out of the earlier one and the edits."""
    line = F.expr("concat(l_linestatus, ' ', if(l_orderkey % 3 = 0, cast(l_linenumber as string), concat(l_partkey, '/', l_suppkey)))")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("path"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("i"), line.alias("line"))
    changed = rows.where("o % 7 != 0").select("path", "o", "i", F.lit(0).alias("k"), F.expr("if(o % 11 = 0, concat(line, '!'), line)").alias("line"))
    later = changed.unionByName(rows.where("o % 13 = 0").select("path", "o", "i", F.lit(1).alias("k"), "line"))
    before = align.numbered(rows, "path", ["o", "i", "line"])
    path = folder(spark, "after")
    after = align.numbered(later.withColumn("place", F.expr("if(o % 500 < 20, o + 1000, o)")), "path", ["place", "o", "i", "k", "line"], path)
    changed = align.edits(before, after)
    drop(spark, path)
    return align.rebuild(before, changed, n=align.passes(before.count()))


@query(rf"""WITH {_BOTH_LINES} SELECT path, line_no::BIGINT AS n, nfc_normalize(line) AS line FROM lb WHERE path IN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 5 = 0 OR text IS DISTINCT FROM {_EDIT}))""")
def rebuilt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later version of every document that changed, or is new, out of the earlier one and the blocks of its diff."""
    before = _trees(spark, sf_dir)[0]
    files = written(seqdiff.diff_pairs(_pairs(spark, sf_dir)), "blocks")
    old = lines(before.join(files.select("path"), "path", "left_semi").withColumn("text", normal_line("text")), "path").withColumnRenamed("line_no", "n")
    return align.rebuild(old, align.edits_of_blocks(files))
