"""Plans, dictionaries and findings as JSON, CSV, XML and text; content-addressed stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The fields of a plan and of its CSV form, in their order.
PLAN = ("id", "type", "file", "line", "original", "replacement", "token", "helper_id", "helper_ref", "helper_source")
CSV = ("id", "file", "line", "file_hash", "type", "original", "replacement", "token", "helper_id", "helper_path", "helper_source", "insertion_line", "confidence", "notes")
_TYPES = {"line": "int"}
#: Changes of an XML file, which one task reads whole.
XML_ROWS = 100_000


def plan_columns(changes: DataFrame) -> DataFrame:
    """A plan's fields in their order; missing ones are null, others are left out."""
    have = set(changes.columns)
    return changes.select(*((F.col(c) if c in have else F.lit(None)).cast(_TYPES.get(c, "string")).alias(c) for c in PLAN))


def write_plan_json(changes: DataFrame, path: str) -> None:
    """One JSON object a line, fields in the plan's order; the kind replace is left out, as are nulls."""
    kind = F.when(F.col("type") != "replace", F.col("type"))
    plan_columns(changes).withColumn("type", kind).write.option("ignoreNullFields", "true").json(path)


def plan_csv(changes: DataFrame) -> DataFrame:
    """A plan's CSV columns: helpers have an insertion line and a note instead of texts."""
    p = plan_columns(changes)
    helper = F.col("type") == "helper"
    text = lambda c: F.when(~F.coalesce(helper, F.lit(False)), F.col(c))
    values = {
        "id": F.col("id"), "file": F.col("file"), "line": F.col("line"), "file_hash": F.lit(None), "type": F.coalesce("type", F.lit("replace")), "original": text("original"), "replacement": text("replacement"),
        "token": text("token"), "helper_id": F.col("helper_id"), "helper_path": F.col("helper_ref"), "helper_source": F.col("helper_source"), "insertion_line": F.when(helper, F.col("line")), "confidence": F.lit(None),
        "notes": F.when(helper, "helper insertion point"),
    }
    return p.select(*(values[c].cast("string").alias(c) for c in CSV))


def write_plan_csv(changes: DataFrame, path: str) -> None:
    """CSV with a header, in order of file and line, quotes doubled, plain UTF-8 without a mark."""
    rows = plan_csv(changes).orderBy("file", F.coalesce(F.col("line").cast("int"), F.lit(0)), "id")
    rows.write.option("header", "true").option("escape", '"').option("lineSep", "\n").csv(path)


def read_plan_csv(spark, path: str) -> DataFrame:
    """A plan from CSV; rows without a file or with a line that is no number are dropped, a byte-order mark too."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    raw = raw.toDF(*(c.lstrip("\ufeff") for c in raw.columns))
    if "helper_path" in raw.columns:
        raw = raw.withColumnRenamed("helper_path", "helper_ref")
    rows = raw.withColumn("line", F.col("line").try_cast("int")).where("file is not null and file != '' and line is not null")
    return plan_columns(rows).withColumn("type", F.when(F.col("type") != "replace", F.col("type")))


def read_changes_csv(spark, path: str) -> DataFrame:
    """A plan from its CSV as it stands: no row is dropped, helpers keep their own fields only; a line that is no number fails the query."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    raw = raw.toDF(*(c.lstrip("\ufeff") for c in raw.columns))
    helper = F.coalesce("type", F.lit("replace")) == "helper"
    own = lambda c, of: F.when(of, F.col(c)).alias("helper_ref" if c == "helper_path" else c)
    return plan_columns(raw.select(
        own("id", ~helper), F.coalesce("type", F.lit("replace")).alias("type"), "file", F.col("line").cast("int").alias("line"), *(own(c, ~helper) for c in ("original", "replacement", "token")),
        *(own(c, helper) for c in ("helper_id", "helper_path", "helper_source")),
    ))


def write_plan_xml(changes: DataFrame, path: str) -> None:
    """XML files of a bounded number of changes each."""
    plan_columns(changes).write.format("xml").option("maxRecordsPerFile", XML_ROWS).option("rootTag", "plan").option("rowTag", "change").save(path)


def read_plan_xml(spark, path: str, xsd: str | None = None) -> DataFrame:
    """A plan from XML; with the path of a schema, rows that break it are dropped."""
    schema = ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in PLAN)
    reader = spark.read.format("xml").option("rowTag", "change").schema(schema)
    return (reader.option("rowValidationXSDPath", xsd).option("mode", "DROPMALFORMED") if xsd else reader).load(path)


def plan_xsd() -> str:
    """An XML schema of one change."""
    kinds = {"int": "xs:integer", "string": "xs:string"}
    fields = "".join(f'<xs:element name="{c}" type="{kinds[_TYPES.get(c, "string")]}" minOccurs="0"/>' for c in PLAN)
    return f'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="change"><xs:complexType><xs:sequence>{fields}</xs:sequence></xs:complexType></xs:element></xs:schema>'


def findings_text(found: DataFrame) -> DataFrame:
    """A line for people for each finding (file, line, text, severity)."""
    return found.select(F.format_string("[%s] %s:%s %s", F.upper("severity"), "file", F.col("line").cast("string"), "text").alias("value"))


def write_findings_json(found: DataFrame, path: str) -> None:
    """Findings as JSON lines, absent values left out."""
    found.write.json(path)


def read_findings_json(spark, path: str) -> DataFrame:
    """Findings from JSON lines or lists; those without a text are dropped."""
    return spark.read.schema("type string, file string, line int, text string, detector string, severity string").json(path).where("text is not null and text != ''")


def plan_text(changes: DataFrame) -> DataFrame:
    """One line of text for each change."""
    return plan_columns(changes).select(F.format_string("%s:%s: %s -> %s", F.coalesce("file", F.lit("")), F.coalesce(F.col("line").cast("string"), F.lit("")), F.coalesce("original", F.lit("")), F.coalesce("replacement", F.lit(""))).alias("value"))


def plan_html(changes: DataFrame) -> DataFrame:
    """A table row for each change, its values escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return plan_columns(changes).select(F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in ("file", "line", "original", "replacement")), F.lit("</tr>")).alias("value"))


def write_dictionary_json(words: DataFrame, path: str) -> None:
    """Token and text as one JSON object a line, sorted by token."""
    words.select("token", "text").orderBy("token").write.json(path)


def dictionary_module(words: DataFrame) -> DataFrame:
    """Lines of a script that assigns each token's text."""
    quoted = F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return words.orderBy("token").select(F.concat(F.lit('messages["'), "token", F.lit('"] = "'), quoted, F.lit('";')).alias("value"))


def write_dictionary_csv(words: DataFrame, path: str) -> None:
    words.select("token", "text").orderBy("token").write.option("header", "true").option("escape", '"').csv(path)


def store_by_content(payloads: DataFrame, path: str, have: DataFrame | None = None) -> None:
    """Append payloads (hash, content) that the store lacks, in 256 folders by the hash's first two digits.

    A second level would make a file for almost every payload; up to 16 tasks write a folder instead.
    """
    new = payloads.dropDuplicates(["hash"])
    if have is not None:
        new = new.join(have.select("hash"), "hash", "left_anti")
    shard = F.substring("hash", 1, 2)
    new.withColumn("shard", shard).repartition("shard", F.substring("hash", 3, 1)).write.mode("append").partitionBy("shard").parquet(path)


def read_store(spark, path: str) -> DataFrame:
    """Payloads with ``intact``: whether the content still has its hash."""
    return spark.read.parquet(path).withColumn("intact", F.col("hash") == F.sha2("content", 256)).drop("shard")


def read_helper_csv(spark, path: str) -> DataFrame:
    """(helper, target, line) from CSV with columns helper_file, target_file, line; a line that is no number fails the query."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return raw.select(F.col("helper_file").alias("helper"), F.col("target_file").alias("target"), F.col("line").cast("int").alias("line"))


def regions_by_file(found: DataFrame, version: int = 1) -> DataFrame:
    """(file, value): one JSON object a file, keys sorted, its regions in order of place, then id."""
    fields = sorted(c for c in found.columns if c != "file")
    lists = found.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "start_column", "id", F.struct(*fields).alias("r")))), lambda x: x["r"]).alias("regions"))
    return lists.select("file", F.to_json(F.struct("file", "regions", F.lit(version).alias("version")), {"ignoreNullFields": "false"}).alias("value"))


def write_regions_json(found: DataFrame, path: str, version: int = 1) -> None:
    """Regions as JSON lines, a file a line in order of paths."""
    regions_by_file(found, version).orderBy("file").select("value").write.text(path)


def read_regions_json(spark, path: str, region: str) -> DataFrame:
    """(file, region's fields) from :func:`write_regions_json`; ``region`` is the DDL of a region's fields without the file."""
    fields = ", ".join(c.strip().replace(" ", ":", 1) for c in region.split(","))
    rows = spark.read.schema(f"file string, regions array<struct<{fields}>>").json(path)
    return rows.select("file", F.inline("regions"))
