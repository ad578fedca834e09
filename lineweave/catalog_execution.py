"""Queries over plans put into effect: planned diffs, verification, checks before, regions' history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog_text import table
from .functions.canonical import ascii_json, iso_time, pretty_json
from .functions.shared import written
from .operators import execution, plan_ops, regions, registry, seqdiff

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# the characters that end a line, so that a turn is one line
_BREAKS = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]+"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, turn, line): each turn as a numbered line of its conversation, so that no line of a file is there twice."""
    t = table(spark, sf_dir, "conversations").where("turn is not null")
    once = t.groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return once.select(F.col("conv_id").cast("string").alias("file"), "conv_id", "turn", F.concat_ws(" ", F.concat("turn", F.lit(":")), F.btrim(F.regexp_replace("text", _BREAKS, " "), F.lit(" "))).alias("line"))


_TURNS = r"""u AS (SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM conversations WHERE turn IS NOT NULL GROUP BY ALL),
  t AS (SELECT conv_id, turn, conv_id::VARCHAR AS path, nfc_normalize(turn || ': ' || trim(regexp_replace(text, '[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]+', ' ', 'g'), ' ')) AS line,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS line_no FROM u)"""


def _files_and_plan(spark: SparkSession, sf_dir: str, leave_out: str = "false") -> tuple[DataFrame, DataFrame]:
    """Conversations as files, and a plan that adds a mark to two turns in three; in some conversations at a wrong line."""
    turns = _turns(spark, sf_dir)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    files = turns.groupBy(F.col("file").alias("path")).agg(joined.alias("text"))
    none = {c: F.lit(None).cast("string") for c in ("type", "token", "helper_id", "helper_ref", "helper_source")}
    plan = turns.where(f"turn % 3 != 0 and not ({leave_out})").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "file", (F.col("turn") + F.when(F.col("conv_id") % 4 == 0, 2).otherwise(1)).cast("int").alias("line"), F.col("line").alias("original"), F.concat("line", F.lit("!")).alias("replacement"))
    return files, plan.withColumns(none)


def _planned(where: str) -> str:
    return f"""SELECT path, min(line_no) AS start_line, max(line_no) AS end_line, string_agg(line, chr(10) ORDER BY line_no) AS before, string_agg(line || '!', chr(10) ORDER BY line_no) AS after
    FROM (SELECT *, line_no - row_number() OVER (PARTITION BY path ORDER BY line_no) AS island FROM t WHERE turn % 3 <> 0 AND NOT ({where})) GROUP BY path, island"""


@query(f"WITH {_TURNS}, b AS ({_planned('false')}) SELECT path, 'modified' AS status, 'replace' AS type, start_line, end_line, before, after FROM b")
def planned_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = execution.planned_diff(*_files_and_plan(spark, sf_dir))
    return found.select("path", "status", F.inline("changes")).withColumns({c: F.array_join(c, "\n") for c in ("before", "after")})


_SKIPPED = "conv_id % 5 = 0 AND turn % 3 = 2 OR conv_id % 9 = 0"


@query(f"""WITH {_TURNS}, p AS ({_planned('conv_id % 7 = 0')}), o AS ({_planned(_SKIPPED)}),
  m AS (SELECT count(*) AS n FROM p JOIN o USING (path, before, after)), fp AS (SELECT DISTINCT path FROM p), fo AS (SELECT DISTINCT path FROM o)
  SELECT (SELECT n FROM m) AS matched, (SELECT count(*) FROM p) - (SELECT n FROM m) AS missing, (SELECT count(*) FROM o) - (SELECT n FROM m) AS unexpected,
    (SELECT count(*) FROM fp) AS expected_files, (SELECT count(*) FROM fo) AS observed_files, (SELECT count(*) FROM fp WHERE path NOT IN (SELECT path FROM fo)) AS missing_files,
    (SELECT count(*) FROM fo WHERE path NOT IN (SELECT path FROM fp)) AS unexpected_files, false AS match, false AS verified""")
def verified_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, plan = _files_and_plan(spark, sf_dir, "conv_id % 7 = 0")
    # a diff is read more than once: aligning files is done before
    observed = written(execution.planned_diff(files, _files_and_plan(spark, sf_dir, _SKIPPED)[1]), "observed")
    return execution.verify_execution(written(execution.planned_diff(files, plan), "expected"), observed, strict=True).drop("expected_hash", "observed_hash")


def _hashed(name: str, where: str) -> str:
    """The hash of a planned diff as SQL: files one by one, then the tree of their digests, as table ``name``."""
    level = lambda at, of, digits: f"{at} AS (SELECT substr(h, 1, {digits}) || sha256(string_agg(h, ',' ORDER BY h)) AS h FROM {of} GROUP BY substr(h, 1, {digits}))"
    block = """'{"type":"replace","start_line":' || start_line || ',"end_line":' || end_line || ',"before":' || to_json(before)::VARCHAR || ',"after":' || to_json(after)::VARCHAR || '}'"""
    blocks = f"""SELECT path, min(line_no) AS start_line, max(line_no) AS end_line, list(line ORDER BY line_no) AS before, list(line || '!' ORDER BY line_no) AS after
      FROM (SELECT *, line_no - row_number() OVER (PARTITION BY path ORDER BY line_no) AS island FROM t WHERE turn % 3 <> 0 AND NOT ({where})) GROUP BY path, island"""
    files = f"""{name}9 AS (SELECT sha256('{{"changes":[' || string_agg({block}, ',' ORDER BY start_line) || '],"path":"' || path || '","status":"modified"}}') AS h FROM ({blocks}) GROUP BY path)"""
    return ", ".join([files, level(f"{name}6", f"{name}9", 6), level(f"{name}4", f"{name}6", 4), level(f"{name}2", f"{name}4", 2), f"{name} AS (SELECT sha256(coalesce(string_agg(h, ',' ORDER BY h), '')) AS h FROM {name}2)"])


@query(f"""WITH {_TURNS}, {_hashed("p", "conv_id % 7 = 0")}, {_hashed("o", _SKIPPED)}, n AS (SELECT count(*) AS files FROM p9)
  SELECT 'turned' AS observed, p.h AS expected_hash, p.h AS observed_hash, true AS match, true AS verified, files AS expected_files, files AS observed_files FROM p, n
  UNION ALL SELECT 'other', p.h, o.h, p.h = o.h, p.h = o.h, files, (SELECT count(*) FROM o9) FROM p, o, n""")
def verified_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A planned diff against itself, its files and changes in another order, and against another diff, by their hashes."""
    files, plan = _files_and_plan(spark, sf_dir, "conv_id % 7 = 0")
    expected = written(execution.planned_diff(files, plan), "expected")
    turned = written(expected.withColumn("changes", F.reverse("changes")).orderBy(F.desc("path")), "turned")
    other = written(execution.planned_diff(files, _files_and_plan(spark, sf_dir, _SKIPPED)[1]), "observed")
    columns = ("expected_hash", "observed_hash", "match", "verified", "expected_files", "observed_files")
    found = [execution.verify_execution(expected, df, strict=True).select(F.lit(name).alias("observed"), *columns) for name, df in (("turned", turned), ("other", other))]
    return found[0].unionByName(found[1])


@query(f"""WITH {_TURNS}, c AS (SELECT *, turn + CASE WHEN conv_id % 4 = 0 THEN 2 ELSE 1 END AS at FROM t WHERE turn % 3 <> 0)
  SELECT conv_id || '-' || turn AS id, e.condition, e.error FROM c, (VALUES ('safety', 'path outside its root', 11), ('source', 'missing file', 11), ('source', 'stale', 13), ('structure', 'missing replacement', 17), ('authorization', 'removal is not authorized', 19), ('structure', 'missing helper_id', 19), ('structure', 'missing helper_ref', 19)) e(condition, error, k)
  WHERE conv_id % k = 0 AND NOT (error = 'stale' AND (conv_id % 11 = 0 OR conv_id % 19 = 0)) AND NOT (error = 'missing replacement' AND conv_id % 19 = 0)
  UNION ALL SELECT NULL, 'completeness', 'the scan is incomplete' UNION ALL SELECT NULL, 'confirmation', 'the plan''s hash is another'""")
def preflight_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, plan = _files_and_plan(spark, sf_dir)
    conv = F.split("id", "-")[0].cast("long")
    plan = plan.withColumns({
        "file": F.when(conv % 11 == 0, F.concat(F.lit("../"), "file")).otherwise(F.col("file")), "original": F.when(conv % 13 == 0, F.concat("original", F.lit("?"))).otherwise(F.col("original")),
        "replacement": F.when(conv % 17 != 0, F.col("replacement")), "type": F.when(conv % 19 == 0, "helper_remove"),
    })
    turns = _turns(spark, sf_dir)
    lines = turns.select("file", F.row_number().over(Window.partitionBy("file").orderBy("turn")).alias("line_no"), "line")
    return execution.preflight(lines, plan, complete=False, given="0000000")


_SNAPSHOTS = """s AS (SELECT o_custkey % 50 AS scope, month(o_orderdate)::INT AS snapshot, 'f' || o_orderkey % 4 AS file, 'r' || o_orderkey % 7 AS id, o_orderstatus AS original FROM orders)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as regions of four files of a customer group, a snapshot a month."""
    c = F.col
    return table(spark, sf_dir, "orders").select((c("o_custkey") % 50).alias("scope"), F.month("o_orderdate").alias("snapshot"), F.concat(F.lit("f"), c("o_orderkey") % 4).alias("file"), F.concat(F.lit("r"), c("o_orderkey") % 7).alias("id"), c("o_orderstatus").alias("original"))


_FILE_STATES = f"""{_SNAPSHOTS}, q AS (SELECT DISTINCT scope, snapshot, file, id, original FROM s),
  x AS (SELECT scope, snapshot, file, sha256(string_agg(h, ',' ORDER BY h)) AS after FROM (SELECT *, sha256('{{"id":"' || id || '","original":"' || original || '"}}') AS h FROM q) GROUP BY ALL),
  l AS (SELECT scope, max(snapshot) AS last FROM s GROUP BY scope), y AS (SELECT scope, snapshot + 1 AS snapshot, file, after AS before FROM x JOIN l USING (scope) WHERE snapshot < last),
  d AS (SELECT scope, snapshot, file, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'changed' END AS status, before, after FROM x FULL JOIN y USING (scope, snapshot, file) WHERE before IS DISTINCT FROM after)"""


@query(f"WITH {_FILE_STATES} SELECT * FROM d")
def region_file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.file_changes(_snapshots(spark, sf_dir), "scope", "snapshot", semantic=("original",))


@query(f"""WITH {_FILE_STATES}, h AS (SELECT scope, snapshot, sha256('{{"after":' || coalesce('"' || after || '"', 'null') || ',"before":' || coalesce('"' || before || '"', 'null') || ',"file":"' || file || '","status":"' || status || '"}}') AS h FROM d),
  e AS (SELECT scope, snapshot, count(*) AS files, sha256(string_agg(h, ',' ORDER BY h)) AS changes_hash FROM h GROUP BY ALL),
  c AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY snapshot)::INT - 1 AS sequence, sha256('{{"changes_hash":"' || changes_hash || '","snapshot":' || snapshot || '}}') AS state_hash FROM e)
  SELECT *, lag(state_hash) OVER (PARTITION BY scope ORDER BY sequence) AS previous_hash FROM c""")
def region_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.history(_snapshots(spark, sf_dir), "scope", "snapshot", semantic=("original",))


@query("""SELECT c_custkey, '{' || chr(10) || '  "balance": ' || round(c_acctbal)::BIGINT || ',' || chr(10) || '  "name": "' || c_name || '",' || chr(10) || '  "segment": ' || CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || chr(10) || '}' || chr(10) AS json FROM customer""")
def pretty_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", pretty_json(name=F.col("c_name"), segment=segment, balance=F.round("c_acctbal").cast("long")).alias("json"))


@query("""SELECT c_custkey, '{"hash":"sha256:' || sha256(p) || '","plan":' || p || ',"version":"1.0"}' AS bundle FROM (SELECT c_custkey, '{"name":"' || c_name || '"}' AS p FROM customer)""")
def plan_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"))).alias("plan"))
    return registry.bundle(plans).select("c_custkey", "bundle")


@query("""SELECT o_custkey, 'o' || max_by(o_orderkey, (o_orderdate, 'o' || o_orderkey)) AS path FROM orders GROUP BY 1""")
def latest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("o"), "o_orderkey").alias("path"), F.col("o_orderdate").alias("modified"))
    return registry.latest(rows, "o_custkey").select("o_custkey", "path")


@query("SELECT count(*) AS keys FROM supplier")
def key_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.key_count(table(spark, sf_dir, "supplier"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", iso_time(F.col("ts")).alias("iso"))


_UNIT = r"chr(92) || 'u' || lpad(lower(to_hex({})), 4, '0')"
_ESCAPED = f"""CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 65536 THEN {_UNIT.format("unicode(c)")}
  ELSE {_UNIT.format("(unicode(c) - 65536) // 1024 + 55296")} || {_UNIT.format("(unicode(c) - 65536) % 1024 + 56320")} END"""


@query(f"""SELECT conv_id, turn, CASE WHEN text IS NULL THEN '{{}}' ELSE array_to_string(list_transform(regexp_extract_all(to_json({{text: text}})::VARCHAR, '(?s).'), lambda c: {_ESCAPED}), '') END AS json FROM conversations""")
def escaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ascii_json(F.to_json(F.struct("text"))).alias("json"))


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files before and after every third line was changed, with their diff."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    edited = F.transform("lines", lambda x, i: F.when(i % 3 == 0, F.concat(x, F.lit(" !"))).otherwise(x))
    texts = _turns(spark, sf_dir).groupBy(F.col("file").alias("path")).agg(lines.alias("lines"))
    return seqdiff.normalized(seqdiff.diff_pairs(texts.select("path", F.array_join("lines", "\n").alias("before"), F.array_join(edited, "\n").alias("after"))))


@query(f"WITH {_TURNS} SELECT path, 'modified' AS status, 'replace' AS type, line_no AS start_line, line_no AS end_line, line AS before, line || ' !' AS after FROM t WHERE line_no % 3 = 1")
def edited_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _edited(spark, sf_dir).select("path", "status", F.inline("changes"))
    return each.select("path", "status", "type", "start_line", "end_line", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


@query(f"""WITH {_TURNS}, c AS (SELECT path, line_no, line, count(*) OVER (PARTITION BY path) AS n FROM t WHERE line_no % 3 = 1)
  SELECT path AS file, line_no AS line, line AS original, line || ' !' AS replacement, false AS whole_file FROM c WHERE n <= {seqdiff.WHOLE_FILE} UNION ALL SELECT DISTINCT path, 1, NULL, NULL, true FROM c WHERE n > {seqdiff.WHOLE_FILE}""")
def plan_of_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqdiff.to_plan(_edited(spark, sf_dir))
