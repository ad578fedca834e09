"""Queries that scan, classify and compare text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.canonical import canonical_text
from .operators import classify as cl
from .operators import detect, dictionary, goals, regions, seqdiff, structure, treediff
from .plans import scan_plan
from .sources import markup

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of long texts, on all cores."""
    return tx.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, id, text): strings of many kinds from six tables."""
    t = lambda name: table(spark, sf_dir, name)
    pick = lambda df, origin, key, text: tx.spread(df.select(F.lit(origin).alias("origin"), key.cast("string").alias("id"), text.alias("text")))
    c = F.col
    parts = [
        pick(t("pages"), "url", c("page_id"), c("url")), pick(t("part"), "part", c("p_partkey"), c("p_name")), pick(t("part"), "type", c("p_partkey"), c("p_type")),
        pick(t("events"), "props", c("event_id"), c("props")), pick(t("documents"), "doc", c("doc_id"), c("text")), pick(t("orders"), "priority", c("o_orderkey"), c("o_orderpriority")),
        pick(t("conversations"), "turn", F.concat_ws(":", "conv_id", "turn"), c("text")), pick(t("lineitem"), "sql", F.concat_ws(":", "l_orderkey", "l_linenumber"), F.concat(F.lit("SELECT "), c("l_returnflag"), F.lit(" FROM t WHERE x = "), c("l_linestatus"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


TEXTS = """texts AS (
  SELECT 'url' AS origin, page_id::VARCHAR AS id, url AS text FROM pages
  UNION ALL SELECT 'part', p_partkey::VARCHAR, p_name FROM part
  UNION ALL SELECT 'type', p_partkey::VARCHAR, p_type FROM part
  UNION ALL SELECT 'props', event_id::VARCHAR, props FROM events
  UNION ALL SELECT 'doc', doc_id::VARCHAR, text FROM documents
  UNION ALL SELECT 'priority', o_orderkey::VARCHAR, o_orderpriority FROM orders
  UNION ALL SELECT 'turn', conv_id || ':' || turn, text FROM conversations
  UNION ALL SELECT 'sql', l_orderkey || ':' || l_linenumber, 'SELECT ' || l_returnflag || ' FROM t WHERE x = ' || l_linestatus FROM lineitem
)"""
_S = r"[\t-\r\x1c-\x20\x85\pZ]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def _any(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(p)})" for p in parts) + ")"


def _starts(x: str, parts) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {_q(p)})" for p in parts) + ")"


def _hits(x: str, parts) -> str:
    return "(" + " + ".join(f"contains({x}, {_q(p)})::INT" for p in parts) + ")"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({_strip(x)}, '{_S}+'), lambda w: w <> '')"


def _all(x: str, pattern: str) -> str:
    return f"(len(list_filter({_words(x)}, lambda w: NOT regexp_full_match(w, '{pattern}'))) = 0)"


def _class(x: str) -> str:
    t = _strip(x)
    u = f"upper({t})"
    return rf"""CASE WHEN {x} IS NULL OR {x} = '' THEN 'empty' WHEN {_starts(t, cl.URL_PREFIXES)} THEN 'url'
      WHEN {_any(u, cl.SQL_PHRASES)} OR ({_any(u, (' FROM ', ' WHERE '))} AND contains({t}, '(')) THEN 'sql'
      WHEN regexp_full_match({t}, '[a-z]+(-[a-z0-9]+)+') OR (contains({t}, ' ') AND {_all(t, '[a-z]+(-[a-z0-9]+)*')}) THEN 'css'
      WHEN regexp_full_match({t}, '[a-z]+[A-Za-z0-9]+') OR (contains({t}, '_') AND lower({t}) = {t}) THEN 'identifier'
      WHEN {_any(t, cl.CODE_MARKS)} THEN 'code' WHEN contains({t}, ' ') AND regexp_matches({t}, '\pL') THEN 'human' ELSE 'unknown' END"""


_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
LINES = rf"""split AS (SELECT doc_id, regexp_split_to_array(text, '{_LINE_END}') AS a FROM documents),
  cut AS (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM split),
  lines AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1)::INT AS line_no FROM cut)"""


@query(f"WITH {LINES} SELECT doc_id, line_no, line FROM lines")
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.lines(documents(spark, sf_dir), "doc_id")


def _goal_case(x: str) -> str:
    return f"CASE upper({_class(x)}) " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in goals.GOAL_RULES.items()) + " END"


@query(f"""WITH {LINES}, found AS (SELECT upper({_class('line')}) AS source_type, {_goal_case('line')} AS goal FROM lines)
  SELECT goal, source_type, count(*) AS "count", 1.0::DOUBLE AS confidence FROM found WHERE goal IS NOT NULL GROUP BY ALL""")
def goals_from_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tx.lines(documents(spark, sf_dir), "doc_id").select(F.upper(cl.string_class("line")).alias("type"))
    return goals.discover_goals(found)


@query(f"""WITH {TEXTS}, found AS (SELECT upper({_class('text')}) AS source_type, {_goal_case('text')} AS goal FROM texts)
  SELECT goal AS intent, CASE goal {" ".join(f"WHEN '{k}' THEN {_q(' / '.join(v))}" for k, v in goals.SPEC_RULES.items())} END AS requirements, source_type, count(*) AS "count"
  FROM found WHERE goal IS NOT NULL GROUP BY ALL""")
def specs_from_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = texts(spark, sf_dir).select(F.upper(cl.string_class("text")).alias("type"))
    specs = goals.discover_specs(goals.discover_goals(found))
    return specs.withColumn("requirements", F.array_join("requirements", " / "))


@query(f"WITH {TEXTS} SELECT origin, id, {_class('text')} AS class FROM texts")
def string_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.judged(texts(spark, sf_dir), lambda t: {"class": cl.string_class(t)}).drop("text")


_BIN = r"(length(text) > 0 AND (length(regexp_replace(text, '[\x20-\x7e]', '', 'g')) > 0.3 * length(text) OR contains(text, chr(0)) OR (length(text) > 20 AND NOT contains(text, ' ') AND length(regexp_replace(text, '[\pL\pN]', '', 'g')) > 0.4 * length(text))))"
_CSS_LIKE = f"(contains(lower(text), 'style=') OR (contains(text, ':') AND contains(text, ';')) OR {_any('lower(text)', cl.CSS_UNITS)} OR {_hits('lower(text)', cl.CSS_KEYWORDS)} >= 2)"
_KEYWORD_HITS = "(" + " + ".join(rf"regexp_matches(upper(text), '\b{k}\b')::INT" for k in cl.SQL_KEYWORDS) + ")"
_SQL = f"({_any('upper(text)', cl.SQL_PHRASES)} OR {_KEYWORD_HITS} >= 2 OR ({_KEYWORD_HITS} >= 1 AND ((contains(text, '(') AND contains(text, ')')) OR {_any('text', ('?', ':', ' = ', ';'))})))"
_URL = f"regexp_matches({_strip('text')}, '^(?i:https?|ftp|mailto)://')"
_SKIP_NAMED = r"regexp_full_match(text, '[a-z]+[A-Za-z0-9]+') OR (contains(text, '_') AND lower(text) = text) OR (upper(text) = text AND length(text) > 8)"
_SKIP = f"""(text = '' OR {_class('text')} IN ('url', 'sql', 'css', 'identifier', 'code') OR ({_any('upper(text)', (' FROM ', ' WHERE ', ' VALUES '))} AND contains(text, '(') AND contains(text, ')'))
  OR {_any('text', ('/', chr(92)))} OR {" OR ".join(f"suffix(text, '{e}')" for e in (*cl.FILE_ENDINGS, '()'))} OR {_SKIP_NAMED} OR len({_words('text')}) <= 1)"""


@query(rf"""WITH {TEXTS} SELECT origin, id, {_class('text')} = 'human' AND length(text) >= 3 AND regexp_matches(text, '\pL') AND contains(text, ' ') AS candidate, {_SKIP} AS skipped,
  {_BIN} AS binary_like, ((contains(lower(text), '<') AND contains(lower(text), '>')) OR {_any('lower(text)', cl.HTML_SIGNS)}) AS html_like, {_any('text', cl.CODE_SIGNS)} AS code_like,
  len(list_filter({_words('text')}, lambda w: contains(w, '_') AND upper(w) = w AND lower(w) <> w)) > 0 AS has_constant FROM texts""")
def candidate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"candidate": cl.is_candidate, "skipped": cl.is_skipped, "binary_like": cl.is_binary_like, "html_like": cl.is_html_like, "code_like": cl.is_code_like, "has_constant": cl.has_constant}
    return cl.judged(texts(spark, sf_dir), lambda t: {name: rule(t) for name, rule in rules.items()}).drop("text")


_STRICT = f"({_any('upper(text)', cl.STRICT_SQL_PHRASES)} OR {_hits('upper(text)', cl.STRICT_SQL_WORDS)} >= 2)"
_STOP = ", ".join(map(_q, cl.STOPWORDS))
_SENTENCE = rf"(len({_words('text')}) >= 3 AND (len(list_filter({_words('text')}, lambda w: lower(w) IN ({_STOP}))) > 0 OR len(list_filter({_words('text')}, lambda w: regexp_matches(w, '^\p{{Lu}}'))) > 0))"
_T = _strip("text")
_CSS = f"({_T} <> '' AND (starts_with({_T}, '.') OR (len({_words('text')}) >= 2 AND {_all('lower(text)', '[a-z0-9-]+')}) OR regexp_full_match({_T}, '[a-z0-9]+(-[a-z0-9]+)+') OR {_starts(_T, cl.CSS_PREFIXES)}))"
_CODE = rf"""({_T} <> '' AND (lower({_T}) IN ({", ".join(map(_q, cl.CODE_WORDS))}) OR (regexp_full_match({_T}, '[A-Z0-9_]+') AND length({_T}) > 3) OR (regexp_full_match({_T}, '[a-z0-9_]+') AND contains({_T}, '_'))
  OR regexp_full_match({_T}, '[a-z]+[A-Za-z0-9]*') OR suffix({_T}, '()') OR (contains({_T}, '/') AND NOT contains({_T}, ' ')) OR (length({_T}) <= 4 AND regexp_full_match({_T}, '\pL+'))))"""
_SCORE = "((contains(text, '(') AND contains(text, ')'))::INT * 2 + contains(text, '=')::INT + contains(text, '?')::INT * 2 + (contains(text, ',') AND contains(upper(text), ' AS '))::INT * 2 + contains(text, '`')::INT * 2 + contains(text, '_')::INT)"


@query(f"WITH {TEXTS} SELECT origin, id, {_SQL} AS is_sql, {_STRICT} AS strict_sql, {_URL} AS is_url, {_CSS} AS is_css, {_CSS_LIKE} AS css_like, {_CODE} AS is_code, {_SENTENCE} AS sentence, {_SCORE} AS score FROM texts")
def classifier_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"is_sql": cl.is_sql, "strict_sql": cl.is_sql_strict, "is_url": cl.is_url, "is_css": cl.is_css, "css_like": cl.is_css_like, "is_code": cl.is_code, "sentence": cl.is_sentence, "score": cl.sql_score}
    return cl.judged(texts(spark, sf_dir), lambda t: {name: rule(t) for name, rule in rules.items()}).drop("text")


@query(f"WITH {TEXTS} SELECT origin, id FROM texts WHERE NOT ({_any('upper(text)', cl.SQL_PHRASES)}) AND (NOT {_CSS} OR {_SENTENCE}) AND NOT {_starts('text', cl.URL_PREFIXES)} AND NOT {_CODE}")
def filtered_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.apply_filters(texts(spark, sf_dir), ["url", "CSS", "code", "sql"]).select("origin", "id")


@query(f"WITH {TEXTS} SELECT origin, id FROM texts WHERE text IS NOT NULL AND NOT {_BIN} AND NOT {_URL} AND NOT {_CSS_LIKE} AND {_SCORE} < 4")
def cleaned_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.clean_dictionary(texts(spark, sf_dir)).select("origin", "id")


_L = f"lower({_T})"
_LOOKS_CSS = f"(starts_with({_L}, '.') OR regexp_full_match({_L}, '[a-z0-9]+(-[a-z0-9]+)+') OR (contains({_L}, ' ') AND {_all('lower(text)', '[a-z0-9-]+')}) OR {_starts(_L, cl.CLEANER_CSS_PREFIXES)})"
_LOOKS_CODE = r"(regexp_full_match(text, '[\pL_][\pL\pN_]*') OR (regexp_full_match(text, '[A-Z0-9_]+') AND length(text) > 4) OR (regexp_full_match(text, '[a-z0-9_]+') AND contains(text, '_')) OR suffix(text, '()'))"
_CLEANER = rf"({_SQL}::INT * 3 + {_URL}::INT * 3 + {_LOOKS_CSS}::INT * 2 + {_LOOKS_CODE}::INT * 2 + (NOT contains(text, ' '))::INT + (length(text) > 80)::INT * 2 + (length(regexp_replace(text, '[\pL\pN .,!?]', '', 'g')) > 5)::INT * 2 + (upper(text) = text AND length(text) > 10)::INT * 2)"


@query(rf"WITH {TEXTS} SELECT origin, id, {_CLEANER} AS score, {_CLEANER} < 3 AND regexp_matches(text, '\pL') AND (contains(text, ' ') OR regexp_matches(text, '\p{{Ll}}')) AS kept FROM texts")
def cleaner_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cl.judged(texts(spark, sf_dir), lambda t: {"score": cl.cleaner_score(t), "human": cl.is_human(t)})
    return rows.select("origin", "id", "score", ((F.col("score") < 3) & F.col("human")).alias("kept"))


def _carried(line: Column, n: Column) -> Column:
    return F.when(n % 3 == 0, F.concat(F.lit('print("'), line, F.lit('")'))).when(n % 3 == 1, F.concat(F.lit('raise Error("'), line, F.lit('")'))).otherwise(F.concat(F.lit('logging.info("'), line, F.lit('")')))


@query(rf"""WITH {LINES}, carried AS (SELECT doc_id, line_no, CASE line_no % 3 WHEN 0 THEN 'print("' || line || '")' WHEN 1 THEN 'raise Error("' || line || '")' ELSE 'logging.info("' || line || '")' END AS line FROM lines WHERE line <> ''),
  found AS (SELECT doc_id, line_no, regexp_extract(line, '^(?:print|raise Error|logging\.info)\("(.+?)"\)', 1) AS text FROM carried)
  SELECT doc_id, line_no, 0 AS n, text, upper({_class('text')}) AS type FROM found""")
def carried_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tx.lines(documents(spark, sf_dir), "doc_id").where("line != ''")
    return detect.findings(rows.withColumn("line", _carried(F.col("line"), F.col("line_no"))), "doc_id")


_CANDIDATE = rf"{_class('text')} = 'human' AND length(text) >= 3 AND regexp_matches(text, '\pL') AND contains(text, ' ')"
_HTML = f"((contains(lower(text), '<') AND contains(lower(text), '>')) OR {_any('lower(text)', cl.HTML_SIGNS)})"
_CONSTANT = f"(len(list_filter({_words('text')}, lambda w: contains(w, '_') AND upper(w) = w AND lower(w) <> w)) > 0)"


@query(f"""WITH {LINES}, t AS (SELECT doc_id, line_no, replace(line, chr(39), '') AS text FROM lines)
  SELECT doc_id, line_no, 0 AS n, text, upper({_class('text')}) AS type FROM t WHERE {_CANDIDATE} AND NOT {_SKIP} AND NOT {_BIN} AND NOT {_HTML} AND NOT {_CONSTANT} AND NOT {_any('text', cl.CODE_SIGNS)}""")
def quoted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tx.lines(documents(spark, sf_dir), "doc_id")
    return detect.findings(rows.withColumn("line", F.concat(F.lit("x = '"), F.replace("line", F.lit("'"), F.lit("")), F.lit("' + y"))), "doc_id")


# upper case of the sharp s is SS; DuckDB knows one character for it
_KEY = rf"upper(replace(regexp_replace({_strip(r'''regexp_replace(text, '[^\pL\pM\pN_\t-\r\x1c-\x20\x85\pZ]', '', 'g')''')}, '{_S}+', '_', 'g'), 'ß', 'SS'))"


@query(rf"""WITH {LINES}, t AS (SELECT line AS text, min(doc_id * 100000 + line_no) AS first FROM lines GROUP BY 1),
  k AS (SELECT text, first, {_KEY} AS key FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY first, text) AS n FROM k)
  SELECT CASE WHEN n = 1 THEN key ELSE key || '_' || n END AS token, text FROM r""")
def dictionary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tx.lines(documents(spark, sf_dir), "doc_id").select(F.col("line").alias("text"), (F.col("doc_id") * 100000 + F.col("line_no")).alias("ord"))
    return dictionary.build(rows)


@query("""WITH base AS (SELECT p_name AS token, p_brand AS text FROM part WHERE p_partkey % 3 <> 0), extra AS (SELECT p_name AS token, p_type AS text FROM part WHERE p_partkey % 2 = 0)
  SELECT token, text FROM base UNION ALL SELECT token, text FROM extra WHERE token NOT IN (SELECT token FROM base)""")
def merged_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    pick = lambda test, text: part.where(test).select(F.col("p_name").alias("token"), F.col(text).alias("text"))
    return dictionary.merge(pick("p_partkey % 3 != 0", "p_brand"), pick("p_partkey % 2 = 0", "p_type"))


@query(r"""WITH d AS (SELECT p_name AS text, 'T' || min(p_partkey) AS token FROM part GROUP BY 1), l AS (SELECT p_partkey::VARCHAR AS file, 1 AS line_no, 'show("' || p_name || '")' AS line, p_name AS text FROM part)
  SELECT file, line_no, line AS original, 'show(messages["' || token || '"])' AS replacement, token FROM l JOIN d USING (text)""")
def substituted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    tokens = part.groupBy(F.col("p_name").alias("text")).agg(F.concat(F.lit("T"), F.min("p_partkey")).alias("token"))
    rows = part.select(F.col("p_partkey").cast("string").alias("file"), F.lit(1).alias("line_no"), F.concat(F.lit('show("'), "p_name", F.lit('")')).alias("line"))
    return dictionary.substitute(rows, tokens)


@query()
def generated_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tx.lines(documents(spark, sf_dir).where(F.length("text") > 0), "doc_id").where("line != ''")
    rows = rows.select(F.col("doc_id").cast("string").alias("file"), "line_no", F.concat(F.lit('print("'), F.replace("line", F.lit('"'), F.lit("")), F.lit('")')).alias("line"))
    return scan_plan.generate(rows)


_EDIT = "CASE WHEN doc_id % 3 = 0 THEN replace(text, 'the ', 'that ') ELSE text END"


@query(f"""WITH a AS (SELECT doc_id AS path, text FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id AS path, {_EDIT} AS text FROM documents WHERE doc_id % 7 <> 0)
  SELECT path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS status FROM a FULL JOIN b USING (path) WHERE a.text IS DISTINCT FROM b.text""")
def tree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treediff.compare_trees(*_trees(spark, sf_dir), content="text")


def _trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    return docs.where("path % 5 != 0"), docs.where("path % 7 != 0").withColumn("text", F.expr("CASE WHEN path % 3 = 0 THEN replace(text, 'the ', 'that ') ELSE text END"))


_BOTH_LINES = rf"""s AS (SELECT doc_id AS path, doc_id % 5 <> 0 AS in_a, doc_id % 7 <> 0 AS in_b, regexp_split_to_array(text, '{_LINE_END}') AS x, regexp_split_to_array({_EDIT}, '{_LINE_END}') AS y FROM documents),
  la AS (SELECT path, unnest(CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END) AS line, generate_subscripts(CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END, 1)::INT AS line_no FROM s WHERE in_a),
  lb AS (SELECT path, unnest(CASE WHEN y[-1] = '' THEN y[:-2] ELSE y END) AS line, generate_subscripts(CASE WHEN y[-1] = '' THEN y[:-2] ELSE y END, 1)::INT AS line_no FROM s WHERE in_b),
  ch AS (SELECT path, line_no, CASE WHEN la.line IS NULL THEN 'insert' WHEN lb.line IS NULL THEN 'delete' ELSE 'replace' END AS type, la.line AS before, lb.line AS after FROM la FULL JOIN lb USING (path, line_no) WHERE la.line IS DISTINCT FROM lb.line)"""


@query(f"WITH {_BOTH_LINES} SELECT * FROM ch")
def line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treediff.compare_lines(*(tx.lines(x, "path") for x in _trees(spark, sf_dir)))


@query(f"WITH {_BOTH_LINES} SELECT path, CASE WHEN bool_and(type = 'insert') THEN 'added' WHEN bool_and(type = 'delete') THEN 'removed' ELSE 'modified' END AS status FROM ch GROUP BY path")
def line_change_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treediff.file_status(treediff.compare_lines(*(tx.lines(x, "path") for x in _trees(spark, sf_dir))))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _trees(spark, sf_dir)
    return a.withColumnRenamed("text", "before").join(b.withColumnRenamed("text", "after"), "path", "full_outer")


@query()
def change_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqdiff.normalized(seqdiff.diff_pairs(_pairs(spark, sf_dir))).select("path", "status", F.to_json("changes").alias("changes"))


@query()
def change_blocks_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqdiff.diff_hash(seqdiff.diff_pairs(_pairs(spark, sf_dir)))


@query()
def plan_from_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqdiff.to_plan(seqdiff.diff_pairs(_pairs(spark, sf_dir)))


@query("""WITH o AS (SELECT l_orderkey AS file, l_linenumber::INT AS start_line, (l_linenumber + (l_quantity > 40)::INT)::INT AS end_line, count(*) AS n FROM lineitem GROUP BY ALL),
  m AS (SELECT *, max(end_line) OVER (PARTITION BY file ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
  i AS (SELECT *, sum(CASE WHEN reach + 1 >= start_line THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM m)
  SELECT file, min(start_line) AS start_line, max(end_line) AS end_line, sum(n)::BIGINT AS merged FROM i GROUP BY file, island""")
def merged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.col("l_linenumber") + (F.col("l_quantity") > 40).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("int").alias("start_line"), end.cast("int").alias("end_line"))
    return seqdiff.merge_adjacent(rows, "file")


_DUP = """g AS (SELECT sha256(text) AS normalized_hash, count(*) AS "count", sum(n_chars)::BIGINT AS total_lines, count(DISTINCT source) AS names, count(DISTINCT lang || '/' || source) AS files FROM documents GROUP BY text HAVING count(*) >= 2),
  c AS (SELECT *, CASE WHEN "count" >= 3 AND files >= 3 THEN 'SHARED_UTILITY_CANDIDATE' ELSE 'UNKNOWN_DUPLICATION' END AS classification, CASE WHEN "count" >= 3 AND files >= 3 THEN 0.95 ELSE 0.5 END::DOUBLE AS confidence FROM g)"""


def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("text").alias("signature"), F.col("source").alias("name"), F.concat_ws("/", "lang", "source").alias("file"), F.col("n_chars").alias("line_count"))
    return structure.classify(structure.duplicate_groups(rows))


@query(f'WITH {_DUP} SELECT normalized_hash, "count", total_lines, names, files, classification, confidence FROM c')
def duplicate_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _duplicates(spark, sf_dir).select("normalized_hash", "count", "total_lines", "names", "files", "classification", "confidence")


@query(f'WITH {_DUP} SELECT classification, count(*) AS groups, sum("count")::BIGINT AS functions, sum(total_lines)::BIGINT AS total_lines FROM c GROUP BY 1')
def structure_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.catalog(_duplicates(spark, sf_dir))


@query("SELECT DISTINCT p_name AS name FROM part WHERE p_size > 25 INTERSECT SELECT p_name FROM part WHERE p_size <= 25")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumnRenamed("p_name", "name")
    return structure.collisions(part.where("p_size > 25"), part.where("p_size <= 25"))


@query()
def html_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.extract_html(table(spark, sf_dir, "pages"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as files with a marked region each, between lines of text."""
    turn = table(spark, sf_dir, "conversations")
    name = F.concat_ws(":", "conv_id", "turn")
    body = F.regexp_replace("text", '["#]', "")
    mark = regions.format_region(F.lpad(F.conv(F.col("turn"), 10, 36), 3, "0"), F.col("turn") % 40, body)
    return turn.select(name.alias("file"), F.concat(F.lit("first\nsecond "), mark, F.lit("\nlast")).alias("text"), "turn", body.alias("body"))


@query(r"""WITH t AS (SELECT conv_id || ':' || turn AS file, turn, regexp_replace(text, '["#]', '', 'g') AS body FROM conversations)
  SELECT file, 0 AS n, CASE WHEN turn % 40 <= 31 THEN (turn % 40)::INT END AS state, body AS original, sha256(body) AS hash, 2 AS start_line, 8 AS start_column,
  (2 + length(body) - length(replace(body, chr(10), '')))::INT AS end_line FROM t WHERE body <> ''""")
def marked_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.extract(_marked(spark, sf_dir).where("body != ''")).drop("id", "end_column")


@query(r"""WITH t AS (SELECT conv_id || ':' || turn AS file, turn, regexp_replace(text, '["#]', '', 'g') AS body FROM conversations WHERE text IS NOT NULL)
  SELECT file, 1 AS line, 1 AS "column", 'closing mark without an opening' AS message FROM t WHERE turn % 2 = 0
  UNION ALL SELECT file, 2, (17 + length((turn % 40)::VARCHAR))::INT, 'empty region' FROM t WHERE body = ''""")
def region_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = _marked(spark, sf_dir).withColumn("text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit('"#]} '), "text")).otherwise(F.col("text")))
    return regions.errors(broken)


@query(rf"""SELECT conv_id, turn, length(text) - length(replace(text, chr(10), '')) + 1 AS last_line, len(regexp_extract_all(lower(text), '[a-z_]+')) AS tokens, {_KEY} AS key, replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') AS escaped FROM conversations""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    at = tx.line_column("text", F.length("text"))
    return rows.select("conv_id", "turn", at[0].alias("last_line"), F.size(tx.tokens("text")).alias("tokens"), tx.normal_key("text").alias("key"), regions.escape(F.col("text")).alias("escaped"))


@query("SELECT doc_id, nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text FROM documents")
def normal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.normal_line("text").alias("text"))


@query("SELECT event_id, sha256(json(props)::VARCHAR) AS hash FROM events")
def canonical_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.sha2(canonical_text(F.col("props")).cast("binary"), 256).alias("hash"))
