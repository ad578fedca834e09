"""Queries over records: reconciliation, artifact diffs, plans, chains, lineage, the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_text import table
from .functions.canonical import canonical_hash, shard_path, short_hash
from .functions.text import module_name
from .operators import artifact_diff, chains, plan_ops, reconcile, registry
from .plans.inspect import inspect
from .sources import patches

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as changes, planned on even days and observed on odd ones."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("before"), F.floor(F.col("value") / 50).cast("long").alias("after"), F.struct("ts", "event_id").alias("ord"), F.dayofmonth("ts").alias("day"))
    return e.where("day % 2 = 0"), e.where("day % 2 = 1")


_RECON = """e AS (SELECT user_id AS path, event_type AS before, floor(value / 50)::BIGINT AS after, ts, event_id, day(ts) % 2 AS odd FROM events),
  p AS (SELECT path, before, after, row_number() OVER (PARTITION BY path, before, after ORDER BY ts, event_id)::INT AS n FROM e WHERE odd = 0),
  o AS (SELECT path, before, after, row_number() OVER (PARTITION BY path, before, after ORDER BY ts, event_id)::INT AS n FROM e WHERE odd = 1),
  r AS (SELECT coalesce(p.path, o.path) AS path, coalesce(p.before, o.before) AS before, coalesce(p.after, o.after) AS after, coalesce(p.n, o.n) AS n,
    CASE WHEN p.n IS NULL THEN 'unexpected' WHEN o.n IS NULL THEN 'missing' ELSE 'matched' END AS status
    FROM p FULL JOIN o ON p.path = o.path AND p.before IS NOT DISTINCT FROM o.before AND p.after IS NOT DISTINCT FROM o.after AND p.n = o.n)"""
_COUNTS = "count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'unexpected') AS unexpected"


@query(f"WITH {_RECON} SELECT * FROM r")
def reconciled_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconcile(*_changes(spark, sf_dir))


@query(f"WITH {_RECON} SELECT path, {_COUNTS} FROM r GROUP BY path")
def reconciled_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.summary(reconcile.reconcile(*_changes(spark, sf_dir)), "path")


@query(f"""WITH {_RECON}, c AS (SELECT {_COUNTS} FROM r), s AS (SELECT count(*) AS out_of_scope FROM (SELECT path FROM p EXCEPT SELECT path FROM o UNION ALL (SELECT path FROM o EXCEPT SELECT path FROM p)))
  SELECT *, CASE WHEN matched + missing = 0 OR matched / (matched + missing) >= 0.95 THEN 'High' WHEN matched / (matched + missing) >= 0.8 THEN 'Moderate' ELSE 'Low' END AS confidence,
  missing = 0 AND unexpected = 0 AND out_of_scope = 0 AS verified FROM c, s""")
def verified_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.verify(*_changes(spark, sf_dir), strict=True)


@query("""WITH e AS (SELECT user_id AS path, day(ts) % 2 AS odd FROM events), p AS (SELECT DISTINCT path FROM e WHERE odd = 0), o AS (SELECT DISTINCT path FROM e WHERE odd = 1)
  SELECT path, 'missing' AS side FROM p WHERE path NOT IN (SELECT path FROM o) UNION ALL SELECT path, 'unexpected' FROM o WHERE path NOT IN (SELECT path FROM p)""")
def scope_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.scope_mismatch(*_changes(spark, sf_dir))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "key")
    a = o.where("key % 11 != 0").select("key", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.lit(0.5).alias("confidence"))
    b = o.where("key % 13 != 0").select("key", F.when(F.col("key") % 4 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.when(F.col("key") % 6 != 0, F.col("o_orderpriority")).alias("priority"), F.lit(0.9).alias("confidence"))
    return a, b


_ARTIFACT = """a AS (SELECT o_orderkey AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 11 <> 0),
  b AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS priority FROM orders WHERE o_orderkey % 13 <> 0),
  j AS (SELECT coalesce(a.key, b.key) AS key, a.key IS NULL AS no_a, b.key IS NULL AS no_b, a.status IS DISTINCT FROM b.status AS ds, a.priority IS DISTINCT FROM b.priority AS dp, a.status IS NULL OR b.status IS NULL AS ns, a.priority IS NULL OR b.priority IS NULL AS np FROM a FULL JOIN b ON a.key = b.key),
  d AS (SELECT key, CASE WHEN no_b THEN 'removed' WHEN no_a THEN 'added' ELSE 'modified' END AS status, CASE WHEN NOT no_a AND NOT no_b THEN CASE WHEN (NOT ds OR ns) AND (NOT dp OR np) THEN 'schema_drift' ELSE 'semantic' END END AS change_type, ds::INT + dp::INT AS fields FROM j WHERE no_a OR no_b OR ds OR dp)"""


@query(f"WITH {_ARTIFACT} SELECT key, status, change_type, fields FROM d")
def artifact_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = artifact_diff.diff(*_snapshots(spark, sf_dir), key="key", fields=["status", "priority", "confidence"])
    return found.select("key", "status", "change_type", F.size("differences").alias("fields"))


@query(f"""WITH {_ARTIFACT}, c AS (SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'modified') AS modified FROM d)
  SELECT *, CASE WHEN added + removed + modified = 0 THEN 'noop' ELSE 'derived' END AS node_type FROM c""")
def artifact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = artifact_diff.summary(artifact_diff.diff(*_snapshots(spark, sf_dir), key="key", fields=["status", "priority"]))
    return counts.withColumn("node_type", artifact_diff.node_type(F.col("added"), F.col("removed"), F.col("modified"), F.lit(True)))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS helper_ref FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS helper_ref FROM lineitem WHERE l_returnflag = 'R')
  SELECT helper_ref, 'added' AS status FROM b WHERE helper_ref NOT IN (SELECT helper_ref FROM a) UNION ALL SELECT helper_ref, 'removed' FROM a WHERE helper_ref NOT IN (SELECT helper_ref FROM b)""")
def helper_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "helper_ref")
    return artifact_diff.helper_lifecycle(part.where("l_returnflag = 'A'"), part.where("l_returnflag = 'R'"))


@query("""WITH c AS (SELECT l_orderkey % 1000 || ':' || l_linenumber || ':' || l_returnflag AS id, l_orderkey % 1000 AS k, row_number() OVER (PARTITION BY l_orderkey % 1000, l_linenumber, l_returnflag ORDER BY l_orderkey DESC, l_partkey DESC, l_suppkey DESC) AS n, l_orderkey AS last FROM lineitem)
  SELECT id, k::VARCHAR AS file, last FROM c WHERE n = 1""")
def last_change_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).cast("string").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("original"), F.lit(None).cast("string").alias("explicit"), F.col("l_orderkey").alias("last"), F.struct("l_orderkey", "l_partkey", "l_suppkey").alias("ord"))
    keyed = rows.withColumn("id", artifact_diff.change_id("explicit"))
    return artifact_diff.last_by_key(keyed, "id", "ord").select("id", artifact_diff.parse_change_id(F.col("id")).file.alias("file"), "last")


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as changes, some of them faulty."""
    li = table(spark, sf_dir, "lineitem")
    number = F.col("l_partkey") % 17
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.when(number == 3, "rename").when(number == 4, "helper").alias("type"), F.when(number != 5, F.concat(F.lit("f"), F.col("l_orderkey") % 500)).alias("file"),
        F.when(number == 6, 0).when(number != 7, F.col("l_linenumber")).cast("int").alias("line"), F.when(number != 8, F.col("l_returnflag")).alias("original"), F.when(number != 9, F.col("l_linestatus")).alias("replacement"),
        F.lit(None).cast("string").alias("token"), F.lit("h").alias("helper_id"), F.when(number != 4, "r").alias("helper_ref"), F.lit("s").alias("helper_source"),
    )


_PLAN = """c AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_partkey % 17 AS k, CASE WHEN l_partkey % 17 = 3 THEN 'rename' WHEN l_partkey % 17 = 4 THEN 'helper' END AS type, CASE WHEN l_partkey % 17 <> 5 THEN 'f' || l_orderkey % 500 END AS file,
    CASE WHEN l_partkey % 17 = 6 THEN 0 WHEN l_partkey % 17 <> 7 THEN l_linenumber END::INT AS line, CASE WHEN l_partkey % 17 <> 8 THEN l_returnflag END AS original, CASE WHEN l_partkey % 17 <> 9 THEN l_linestatus END AS replacement FROM lineitem),
  v AS (SELECT *, row_number() OVER (PARTITION BY file, line, coalesce(type, 'replace') ORDER BY id) > 1 AS dup FROM c),
  e AS (SELECT *, concat_ws(', ', CASE WHEN k = 3 THEN 'unknown type' END, CASE WHEN k = 5 THEN 'missing file' END, CASE WHEN k = 7 THEN 'missing line' END, CASE WHEN k = 6 THEN 'line below 1' END, CASE WHEN k = 8 THEN 'missing original' END, CASE WHEN k = 9 THEN 'missing replacement' END, CASE WHEN k = 4 THEN 'missing helper_ref' END, CASE WHEN dup THEN 'duplicate' END) AS errors FROM v)"""


@query(f"WITH {_PLAN} SELECT id, errors FROM e")
def validated_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_ops.validate(_plan(spark, sf_dir)).select("id", F.array_join("errors", ", ").alias("errors"))


@query(f"WITH {_PLAN} SELECT count(*) AS changes, count(DISTINCT file) AS files, count(*) FILTER (errors <> '') AS invalid FROM e")
def plan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_ops.stats(plan_ops.validate(_plan(spark, sf_dir)))


@query(f"WITH {_PLAN} SELECT id || '-inv' AS id, CASE type WHEN 'helper' THEN 'helper_remove' END AS type, file, line, replacement AS original, original AS replacement FROM c")
def inverted_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_ops.ordered(plan_ops.invert(_plan(spark, sf_dir))).select("id", "type", "file", "line", "original", "replacement")


@query(f"""WITH {_PLAN}, h6 AS (SELECT sha256(to_json({{file: file, line: line, original: original, replacement: replacement, token: NULL, type: coalesce(type, 'replace')}})::VARCHAR) AS h FROM c),
  h4 AS (SELECT substr(h, 1, 6) || sha256(string_agg(h, ',' ORDER BY h)) AS h FROM h6 GROUP BY substr(h, 1, 6)), h2 AS (SELECT substr(h, 1, 4) || sha256(string_agg(h, ',' ORDER BY h)) AS h FROM h4 GROUP BY substr(h, 1, 4)),
  h0 AS (SELECT substr(h, 1, 2) || sha256(string_agg(h, ',' ORDER BY h)) AS h FROM h2 GROUP BY substr(h, 1, 2)) SELECT sha256(string_agg(h, ',' ORDER BY h)) AS plan_hash FROM h0""")
def plan_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_ops.plan_hash(_plan(spark, sf_dir))


def _text_and_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns as lines of conversations, and a plan that changes some of them, some at a wrong line, some stale."""
    turn = table(spark, sf_dir, "conversations")
    lines = turn.select(F.col("conv_id").cast("string").alias("file"), (F.col("turn") + 1).cast("int").alias("line_no"), F.concat(F.lit("  "), F.trim("text")).alias("line"))
    base = {c: F.lit(None).cast("string") for c in ("type", "token", "helper_id", "helper_ref", "helper_source")}
    plan = turn.where("turn % 3 = 1").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("file"), (F.col("turn") + F.when(F.col("conv_id") % 4 == 0, 2).otherwise(1)).cast("int").alias("line"), F.when(F.col("conv_id") % 7 == 0, F.concat(F.trim("text"), F.lit("?"))).otherwise(F.trim("text")).alias("original"), F.concat(F.trim("text"), F.lit("!")).alias("replacement"))
    return lines, plan.withColumns(base)


_TEXT_PLAN = """l AS (SELECT conv_id::VARCHAR AS file, (turn + 1)::INT AS "at", trim(text, ' ') AS bare FROM conversations),
  p AS (SELECT conv_id || '-' || turn AS id, conv_id::VARCHAR AS file, (turn + CASE WHEN conv_id % 4 = 0 THEN 2 ELSE 1 END)::INT AS line, trim(text, ' ') || CASE WHEN conv_id % 7 = 0 THEN '?' ELSE '' END AS bare, trim(text, ' ') || '!' AS replacement FROM conversations WHERE turn % 3 = 1),
  j AS (SELECT p.*, l."at", row_number() OVER (PARTITION BY id ORDER BY coalesce(l."at" <> p.line, true), l."at") AS n FROM p LEFT JOIN l ON l.file = p.file AND l.bare = p.bare)"""


@query(f'WITH {_TEXT_PLAN} SELECT id, file, line, "at" FROM j WHERE n = 1')
def located_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_ops.locate(*_text_and_plan(spark, sf_dir)).select("id", "file", "line", "at")


@query(f"""WITH {_TEXT_PLAN}, c AS (SELECT id, count("at") AS n, coalesce(bool_or("at" = line), false) AS there FROM j GROUP BY id)
  SELECT id, CASE WHEN n = 0 THEN 'stale' ELSE 'ambiguous' END AS errors FROM c WHERE n = 0 OR (n > 1 AND NOT there)""")
def ineligible_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_ops.eligible(*_text_and_plan(spark, sf_dir)).select("id", F.array_join("errors", ", ").alias("errors"))


@query(f"""WITH {_TEXT_PLAN}, h AS (SELECT file, "at", replacement, row_number() OVER (PARTITION BY file, "at" ORDER BY line, id) AS m FROM j WHERE n = 1 AND "at" IS NOT NULL)
  SELECT l.file, l."at" AS line_no, '  ' || coalesce(h.replacement, l.bare) AS line FROM l LEFT JOIN h ON h.file = l.file AND h."at" = l."at" AND h.m = 1""")
def applied_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_ops.apply(*_text_and_plan(spark, sf_dir))


@query(f"""WITH {_TEXT_PLAN}, m AS (SELECT file, line, min_by(replacement, id) AS text FROM p GROUP BY ALL), n AS (SELECT file, unnest(range(1, max(line) + 1))::INT AS line FROM m GROUP BY file)
  SELECT file, string_agg(coalesce(m.text, ''), chr(10) ORDER BY n.line) AS text FROM n LEFT JOIN m USING (file, line) GROUP BY file""")
def rehydrated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_ops.rehydrate(_text_and_plan(spark, sf_dir)[1])


@query("""WITH need AS (SELECT DISTINCT 'h' || l_partkey % 50 AS helper_ref FROM lineitem), have AS (SELECT 'h' || p_partkey AS helper_ref FROM part WHERE p_partkey % 3 = 0)
  SELECT helper_ref FROM need WHERE helper_ref NOT IN (SELECT helper_ref FROM have)""")
def missing_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("h"), F.col("l_partkey") % 50).alias("helper_ref"))
    return plan_ops.missing_helpers(need, table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("h"), "p_partkey").alias("helper_ref")))


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256).alias("hash"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("type"), F.col("o_orderkey").alias("ord"), (F.col("o_custkey") % 40).alias("registry"))


_REGISTRY = "r AS (SELECT sha256(o_orderkey::VARCHAR) AS hash, o_orderdate AS ts, o_orderstatus AS type, o_orderkey AS ord, o_custkey % 40 AS registry FROM orders)"


@query(f"WITH {_REGISTRY} SELECT * FROM r WHERE type = 'O' AND starts_with(hash, 'a') ORDER BY ts DESC, hash OFFSET 5 LIMIT 20")
def registry_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.search(_artifacts(spark, sf_dir), "O", "a", offset=5)


@query(f"WITH {_REGISTRY}, c AS (SELECT ts, hash FROM r ORDER BY ts, hash OFFSET 50 LIMIT 1) SELECT r.* FROM r, c WHERE (r.ts, r.hash) > (c.ts, c.hash) ORDER BY r.ts, r.hash LIMIT 100")
def feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _artifacts(spark, sf_dir)
    return registry.feed_from(rows, registry.feed(rows).orderBy("ts", "hash").offset(50).limit(1))  # the last that a reader has seen


@query(f"WITH {_REGISTRY} SELECT hash, ord FROM r WHERE ord % 3 <> 0 AND ord % 2 <> 0")
def unknown_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _artifacts(spark, sf_dir).select("hash", "ord")
    return registry.not_yet_known(rows.where("ord % 3 != 0"), rows.where("ord % 2 = 0"))


@query(f"WITH {_REGISTRY} SELECT hash, ord FROM r WHERE ord % 2 = 0 UNION ALL SELECT hash, ord FROM r WHERE ord % 3 = 0 AND ord % 2 <> 0")
def inserted_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _artifacts(spark, sf_dir).select("hash", "ord")
    offered = rows.where("ord % 3 = 0").unionByName(rows.where("ord % 9 = 0"))
    return registry.insert_new(rows.where("ord % 2 = 0"), offered)


@query(f"WITH {_REGISTRY} SELECT hash, coalesce(n_name, 'local') AS origin FROM r LEFT JOIN nation ON n_nationkey = registry")
def artifact_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("registry"), F.col("n_name").alias("name"))
    return registry.with_origin(_artifacts(spark, sf_dir), names).select("hash", "origin")


def _signatures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf_dir, "lineitem")
    signed = li.select(F.col("l_orderkey").alias("artifact"), F.col("l_suppkey").alias("key_id"), (F.col("l_quantity") > 5).alias("valid"))
    return signed, table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("key_id"))


@query("""WITH s AS (SELECT l_orderkey AS artifact, l_quantity > 5 AS valid, l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AS t FROM lineitem)
  SELECT artifact, count(*) AS total, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid, count(*) FILTER (valid AND t) AS trusted, count(*) FILTER (NOT valid) = 0 AS verified, count(*) FILTER (valid AND t) > 0 AS accepted FROM s GROUP BY 1""")
def verified_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.verify_signatures(*_signatures(spark, sf_dir))


@query("SELECT l_suppkey AS key_id, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def trusted_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.only_trusted(*_signatures(spark, sf_dir)).groupBy("key_id").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS key_id, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM supplier")
def upserted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key_id"))
    return registry.upsert(keys.withColumn("state", F.lit("old")), keys.where("key_id % 3 = 0").withColumn("state", F.lit("new")))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'canonical' WHEN 1 THEN 'legacy' ELSE 'anonymous' END AS status, substr(sha256(s_name), 1, 16) AS key_id,
  substr(sha256(s_name), 1, 2) || '/' || substr(sha256(s_name), 3, 2) || '/' || sha256(s_name) AS shard FROM supplier""")
def key_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = short_hash(F.col("s_name"), 16)
    stated = F.when(F.col("s_suppkey") % 3 == 0, derived).when(F.col("s_suppkey") % 3 == 1, F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", registry.identity_status(stated, derived, F.col("s_name")).alias("status"), derived.alias("key_id"), shard_path(F.sha2(F.col("s_name").cast("binary"), 256)).alias("shard"))


@query("""SELECT c_custkey, sha256('{"balance":' || round(c_acctbal)::BIGINT || ',"name":"' || c_name || '","segment":' || CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}') AS hash FROM customer""")
def canonical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    segment = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    return c.select("c_custkey", canonical_hash(name=F.col("c_name"), segment=segment, balance=F.round("c_acctbal").cast("long")).alias("hash"))


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))
    return chains.chain(turn, "conv_id", "turn", ["role", "size"])


_CHAIN = """s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sequence, sha256('{"role":"' || role || '","size":' || length(text) || '}') AS state_hash FROM conversations),
  c AS (SELECT conv_id, turn, sequence::INT AS sequence, state_hash, lag(state_hash) OVER (PARTITION BY conv_id ORDER BY sequence) AS previous_hash FROM s)"""


@query(f"WITH {_CHAIN} SELECT * FROM c")
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir).select("conv_id", "turn", "sequence", "state_hash", "previous_hash")


@query(f"""WITH {_CHAIN}, kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY sequence) - 1 AS want, lag(state_hash) OVER (PARTITION BY conv_id ORDER BY sequence) AS prev FROM c WHERE NOT (conv_id % 5 = 0 AND sequence = 1)),
  g AS (SELECT conv_id, sequence, want = sequence AND previous_hash IS NOT DISTINCT FROM prev AS good FROM kept) SELECT conv_id, count(*) AS entries, bool_and(good) AS valid, min(CASE WHEN NOT good THEN sequence END) AS first_bad FROM g GROUP BY 1""")
def verified_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = _chain(spark, sf_dir).where("not (conv_id % 5 = 0 and sequence = 1)")
    return chains.verify_chain(broken, "conv_id", ["role", "size"])


@query("""WITH RECURSIVE a AS (SELECT s_suppkey AS hash, CASE WHEN s_suppkey > 8 THEN s_suppkey // 2 END AS parent FROM supplier), w AS (SELECT hash AS start, hash AS node, parent, 0 AS depth FROM a UNION ALL SELECT w.start, a.hash, a.parent, w.depth + 1 FROM w JOIN a ON a.hash = w.parent)
  SELECT start, node, depth FROM w""")
def lineage_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("hash"), F.when(F.col("s_suppkey") > 8, F.floor(F.col("s_suppkey") / 2)).alias("parent"))
    return chains.walk(a, a)


@query("""WITH RECURSIVE k AS (SELECT s_suppkey AS key_id, s_nationkey AS n FROM supplier), a AS (SELECT key_id, key_id // 2 AS signer FROM k WHERE key_id % 7 <> 0), r AS (SELECT min(key_id) AS key_id, 0 AS depth FROM k UNION SELECT a.key_id, r.depth + 1 FROM r JOIN a ON a.signer = r.key_id WHERE a.key_id <> a.signer AND r.depth < 100)
  SELECT key_id, min(depth) AS depth FROM r GROUP BY 1""")
def approved_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key_id"), F.col("s_suppkey").alias("ord"))
    return chains.approved_keys(keys, keys.where("key_id % 7 != 0").select("key_id", F.floor(F.col("key_id") / 2).alias("signer")))


@query("""WITH s AS (SELECT DISTINCT user_id AS region, date_diff('day', DATE '1970-01-01', ts::DATE) AS snap, min(event_type) OVER (PARTITION BY user_id, ts::DATE) AS state FROM events),
  a AS (SELECT *, sum(CASE WHEN prev = snap - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY region ORDER BY snap) AS run FROM (SELECT *, lag(snap) OVER (PARTITION BY region ORDER BY snap) AS prev FROM s)),
  b AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN lag(state) OVER w IS DISTINCT FROM state THEN 1 ELSE 0 END AS new FROM a WINDOW w AS (PARTITION BY region, run ORDER BY snap))
  SELECT region, snap, state, sum(new) OVER (PARTITION BY region, run ORDER BY snap) + 1 AS revision FROM b""")
def region_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("region"), F.unix_date(F.to_date("ts")).cast("long").alias("snap")).agg(F.min("event_type").alias("state"))
    return chains.revisions(e, "region", "snap", ["state"])


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'root with parent' WHEN 1 THEN 'derived without parent' WHEN 2 THEN 'detached with lineage' ELSE '' END AS errors FROM supplier""")
def lineage_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    kind = F.when(k == 0, "root").when(k == 1, "derived").when(k == 2, "detached").otherwise("derived")
    found = chains.lineage_errors(kind, F.col("s_name"), F.when(k.isin(0, 3), F.col("s_name")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(found, ", ").alias("errors"))


@query("""SELECT o_orderkey, concat_ws(', ', CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 10 = 3 THEN 'header' END, CASE WHEN o_orderkey % 20000 > 10000 THEN 'too many entries' END, CASE WHEN o_totalprice > 134217.728 THEN 'too large' END,
  CASE WHEN o_totalprice * 1000 / (o_orderkey % 500 + 1) > 1000 AND o_totalprice * 1000 > 1048576 THEN 'suspicious ratio' END, CASE WHEN o_orderkey % 9 = 0 THEN 'unsafe path' END) AS errors FROM orders""")
def ingestion_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select("o_orderkey", (~((k % 2 == 1) & (k % 10 == 3))).alias("header_ok"), (k % 20000).alias("entries"), (F.col("o_totalprice") * 1000).alias("bytes"), (k % 500 + 1).alias("packed_bytes"), (k % 9 == 0).cast("int").alias("unsafe_paths"), F.lit(True).alias("manifest_ok"), F.lit("h").alias("hash"), F.lit("h").alias("stated_hash"))
    return rows.select("o_orderkey", F.array_join(registry.ingestion_errors(registry.LIMITS | {"bytes": 134217728}), ", ").alias("errors"))


@query("SELECT page_id, replace(regexp_replace(regexp_replace(path, '^(\\./)?(src/)?', ''), '(/__init__)?\\.py$', ''), '/', '.') AS module FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'src/a/m' || page_id || '.py' ELSE './src/p' || page_id || '/__init__.py' END AS path FROM pages)")
def module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("src/a/m"), "page_id", F.lit(".py"))).otherwise(F.concat(F.lit("./src/p"), "page_id", F.lit("/__init__.py")))
    return table(spark, sf_dir, "pages").select("page_id", module_name(path).alias("module"))


@query("""WITH a AS (SELECT o_orderkey AS artifact, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS parent FROM orders),
  c AS (SELECT l_orderkey AS artifact, count(*) FILTER (l_returnflag = 'A') AS added, count(*) FILTER (l_returnflag = 'R') AS removed, count(*) FILTER (l_returnflag = 'N') AS modified, count(DISTINCT l_partkey) AS files FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY 1),
  s AS (SELECT l_orderkey AS artifact, count(*) AS signatures, count(*) FILTER (l_quantity > 5 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) AS trusted, bool_and(l_quantity > 5) AS verified FROM lineitem GROUP BY 1)
  SELECT artifact, parent, CASE WHEN parent IS NULL THEN 'root' WHEN c.artifact IS NULL THEN 'noop' ELSE 'derived' END AS node_type, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(modified, 0) AS modified, coalesce(files, 0) AS files,
    coalesce(signatures, 0) AS signatures, coalesce(trusted, 0) AS trusted, coalesce(verified, false) AS verified, coalesce(trusted, 0) > 0 AS accepted FROM a LEFT JOIN c USING (artifact) LEFT JOIN s USING (artifact)""")
def inspected_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("artifact"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("parent"))
    status = F.when(F.col("l_returnflag") == "A", "added").when(F.col("l_returnflag") == "R", "removed").otherwise("modified")
    ops = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 != 0").select(F.col("l_orderkey").alias("artifact"), F.col("l_partkey").alias("file"), status.alias("status"))
    return inspect(a, ops, *_signatures(spark, sf_dir))


@query("""SELECT doc_id AS patch, 'd' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'added' ELSE 'modified' END AS status, 3 AS start_line, CASE WHEN doc_id % 3 = 0 THEN 'insert' ELSE 'replace' END AS type, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS before, source AS after FROM documents""")
def patched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id").cast("string")
    mode = F.when(F.col("doc_id") % 5 == 0, "new file mode 100644").otherwise("index 1..2")
    old = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("-"), "lang"))
    parts = F.array(F.concat(F.lit("diff --git a/d"), d, F.lit(" b/d"), d), mode, F.lit("--- a/d"), F.lit("+++ b/d"), F.lit("@@ -2,3 +2,3 @@"), F.lit(" same"), old, F.concat(F.lit("+"), "source"), F.lit(" end"))
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("patch"), F.posexplode(F.array_compact(parts)).alias("n", "line"))
    found = patches.parse_patch(lines)
    return found.select("patch", "path", "status", "start_line", "type", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))
