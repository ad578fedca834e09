"""One document out of many tasks: elements are written in order as parts, and joined between head and foot at the end.

The bytes are the same for any number of partitions. The parts are copied file to file by the file system's client, a buffer at
a time; the document appears under its name when it is whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas, sinks
from .functions.canonical import canonical_json
from .functions.shared import drop, folder
from .sources.elements import elements

#: Fields of a plan's head, in their order.
META = ("tool", "version", "generated_at")


def write_document(elements: DataFrame, path: str, head: str, foot: str, empty: str) -> None:
    """Write the texts of ``elements`` (element), in their order, between ``head`` and ``foot``, with a comma and a line end between two.

    Without elements the document is ``empty``. An older document of the name is replaced. Null elements are left out.
    """
    spark = elements.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parts = folder(spark, "document")
    elements.where("element is not null").select(F.concat("element", F.lit(",")).alias("value")).write.text(parts)
    path_of = jvm.org.apache.hadoop.fs.Path
    target, fresh = path_of(path), path_of(f"{path}.new")
    source_files, target_files = path_of(parts).getFileSystem(conf), target.getFileSystem(conf)
    found = sorted((str(s.getPath().getName()), s.getLen(), s.getPath()) for s in source_files.listStatus(path_of(parts)) if s.getLen() and s.getPath().getName().startswith("part-"))
    out = target_files.create(fresh, True)
    out.write(bytearray((head if found else empty).encode()))
    for n, (_, size, part) in enumerate(found):
        body = source_files.open(part)
        # the last element has no comma, and no line end of its own
        jvm.org.apache.commons.io.IOUtils.copyLarge(body, out, 0, size - 2 if n == len(found) - 1 else size)
        body.close()
    if found:
        out.write(bytearray(foot.encode()))
    out.close()
    target_files.delete(target, False)
    target_files.rename(fresh, target)
    drop(spark, parts)


def _value(name: str, c: Column) -> Column:
    """A column's JSON, without the object around it."""
    whole = canonical_json(**{name: c})
    mark = len(name) + 5  # {"name":
    return F.substring(whole, F.lit(mark), F.length(whole) - mark)


def pretty_object(fields: dict[str, Column], indent: int, step: int = 2) -> Column:
    """A flat object over several lines, fields in the order given, null ones left out; ``indent`` is that of its braces."""
    members = [F.when(c.isNotNull(), F.concat(F.lit(f'{" " * (indent + step)}"{name}": '), _value(name, c))) for name, c in fields.items()]
    body = F.array_join(F.array_compact(F.array(*members)), ",\n")
    return F.when(body == "", F.lit("{}")).otherwise(F.concat(F.lit("{\n"), body, F.lit(f"\n{' ' * indent}}}")))


def _meta(meta: dict[str, str]) -> str:
    import json

    return json.dumps({k: meta[k] for k in META if k in meta}, indent=2, ensure_ascii=False).replace("\n", "\n  ")


def write_plan_document(changes: DataFrame, meta: dict[str, str], path: str) -> None:
    """A plan as one JSON document: its meta data and its changes, by file, line and id, fields in their order.

    The kind replace is left out, as are nulls, fields that a plan hasn't, and meta data other than tool, version and time.
    """
    rows = sinks.plan_columns(changes).withColumn("type", F.when(F.col("type") != "replace", F.col("type")))
    ordered = rows.orderBy(F.col("file").asc_nulls_first(), F.coalesce("line", F.lit(0)), F.col("id").asc_nulls_first(), F.xxhash64(*rows.columns))
    element = F.concat(F.lit("    "), pretty_object({c: F.col(c) for c in sinks.PLAN}, 4))
    start = f'{{\n  "meta": {_meta(meta)},\n  "changes": ['
    write_document(ordered.select(element.alias("element")), path, f"{start}\n", "\n  ]\n}\n", f"{start}]\n}}\n")


def read_plan_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The meta data, one row for each document, and the changes of plan documents. Changes are read by many tasks, meta data by one a document."""
    read = spark.read.schema(schemas.PLAN).option("multiLine", "true").json(path)
    change = read.schema["changes"].dataType.elementType
    return read.select("meta.*"), elements(spark, path, "changes").select(F.from_json("value", change).alias("c")).select("c.*")


def write_token_module(changes: DataFrame, path: str, header: str = "") -> None:
    """A plan's tokens and replacements as a script that exports one object, sorted by token; of a token's replacements the plan's last."""
    order = F.struct(F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)), F.coalesce("id", F.lit("")), "replacement")
    last = sinks.plan_columns(changes).where("token is not null and token != ''").groupBy("token").agg(F.max_by("replacement", order).alias("replacement"))
    element = F.concat(F.lit("  "), _value("t", F.col("token")), F.lit(": "), _value("r", F.col("replacement")))
    write_document(last.orderBy("token").select(element.alias("element")), path, f"{header}export default {{\n", "\n};\n", f"{header}export default {{}};\n")


def write_evidence_document(evidence: DataFrame, path: str) -> None:
    """An evidence store (normalized_hash, count, total_lines) as one object by hash, keys sorted."""
    inside = pretty_object({c: F.col(c) for c in ("count", "normalized_hash", "total_lines")}, 4, 4)
    element = F.concat(F.lit('    "'), "normalized_hash", F.lit('": '), inside)
    write_document(evidence.orderBy("normalized_hash").select(element.alias("element")), path, "{\n", "\n}", "{}")


def write_index_document(index: DataFrame, path: str) -> None:
    """An index (classification, confidence, evidence_hash) as one list, by hash, keys sorted."""
    inside = pretty_object({c: F.col(c) for c in ("classification", "confidence", "evidence_hash")}, 4, 4)
    write_document(index.orderBy("evidence_hash", "classification").select(F.concat(F.lit("    "), inside).alias("element")), path, "[\n", "\n]", "[]")


def read_evidence_document(spark: SparkSession, path: str) -> DataFrame:
    """(normalized_hash, count, total_lines) of an evidence document, which is read whole by one task."""
    inner = "map<string,struct<normalized_hash:string,count:bigint,total_lines:bigint>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.map_values(F.from_json("value", inner))).alias("e"))
    return rows.select("e.*")


def read_index_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.INDEX).option("multiLine", "true").json(path)
