"""The objects of a list in a JSON document, however long it is, read by many tasks.

A document is cut at every closing brace, which a text reader can do from any place in a file. Whether a piece starts within
a string, and how deep it lies, follows from sums over the pieces before: taken within each split of a file first, then over
the splits. Pieces that belong to one object are put together again.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import written

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.S)


def _opened(text: str, depth: int) -> dict:
    """Of a text that reaches up to a document's own members: the list that is open at its end, and the object that ends there."""
    name, held, start = None, None, None
    for m in _TOKEN.finditer(text):
        token = m.group()
        if token[0] == '"':
            name = token if depth == 1 else name
        elif token in "{[":
            held = name if depth == 1 and token == "[" else None if depth == 1 else held
            start = m.start() if depth == 2 and token == "{" else start
            depth += 1
        else:
            depth -= 1
    name = json.loads(held, strict=False) if held and depth == 2 else None
    return {"name": name, "value": text[start:] if name is not None and start is not None else None}


def _count(c: Column, signs: str) -> Column:
    return F.length(c) - F.length(F.translate(c, signs, ""))


def elements(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(value): the text of each object of the list ``name``, a member of the object that is a whole document.

    Documents that end too early, or have another form, give nothing.
    """
    by = ["doc", "at"]
    ordered = Window.partitionBy(*by).orderBy("n")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    ahead = Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)

    meta = lambda c: F.col(f"_metadata.{c}")
    cut = spark.read.option("lineSep", "}").text(path).select(meta("file_path").alias("doc"), meta("file_block_start").alias("at"), meta("file_size").alias("size"), F.monotonically_increasing_id().alias("n"), "value")
    cut = cut.withColumn("bare", F.regexp_replace("value", r"(?s)\\.", "")).withColumn("quotes", _count(F.col("bare"), '"'))
    cut = cut.withColumn("odd", sums("quotes", before) % 2)
    for h in (0, 1):  # whether a split starts within a string isn't known yet
        inside = (F.col("odd") + h) % 2
        outside = F.regexp_replace(F.concat(F.when(inside == 1, '"').otherwise(""), "bare"), r'"[^"]*+(?:"|\z)', "")
        cut = cut.withColumn(f"signs{h}", F.regexp_replace(outside, r"[^{}\[\]]++", "")).withColumn(f"shut{h}", ((inside + F.col("quotes")) % 2 == 0).cast("int"))
        cut = cut.withColumn(f"step{h}", _count(F.col(f"signs{h}"), "[{") - _count(F.col(f"signs{h}"), "]") - F.col(f"shut{h}"))
    cut = written(cut.drop("bare"), "pieces")

    # one row for each split
    splits = cut.groupBy(*by).agg(F.sum("quotes").alias("quotes"), F.sum("step0").alias("s0"), F.sum("step1").alias("s1"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("size").alias("size"))
    splits = splits.withColumn("h", sums("quotes", ahead) % 2).withColumn("step", F.when(F.col("h") == 0, F.col("s0")).otherwise(F.col("s1"))).withColumn("base", sums("step", ahead))
    every = Window.partitionBy("doc")
    # where no brace ends a file its last piece counts one too many; a byte-order mark isn't read
    end = F.when((F.sum("bytes").over(every) - F.col("size")).isin(1, -2), -1).otherwise(0)
    state = splits.withColumn("whole", (F.sum("step").over(every) == end) & (F.sum("quotes").over(every) % 2 == 0)).where("whole").select(*by, "h", "base")
    of = lambda c: F.when(F.col("h") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1")).alias(c)
    here = cut.join(F.broadcast(state), by).select(*by, "n", "value", "base", of("signs"), of("shut"), of("step"))
    here = here.withColumn("depth", F.col("base") + sums("step", before))
    here = here.withColumn("stop", ((F.col("shut") == 1) & (F.col("depth") + F.col("step") <= 2)).cast("int"))
    # a piece that starts in the list may leave it
    lowest = F.aggregate(F.split("signs", ""), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda x, c: F.struct((x.d + F.when(c == "", 0).when(c == "]", -1).otherwise(1)).alias("d"), F.least(x.low, x.d + F.when(c == "", 0).when(c == "]", -1).otherwise(1)).alias("low"))).low
    leaves = F.when(F.contains("signs", F.lit("]")), F.col("depth") + lowest).otherwise(F.col("depth")) < 2
    leaves = leaves | ((F.col("stop") == 1) & (F.col("depth") + F.col("step") < 2))
    here = here.withColumn("part", sums("stop", before)).withColumn("first", F.coalesce(F.lag("stop").over(ordered) == 1, F.lit(False))).withColumn("leaves", leaves)
    parts = here.groupBy(*by).agg(F.sum("stop").alias("stops"))
    here = here.join(F.broadcast(parts.select(*by, sums("stops", ahead).alias("parts"))), by).withColumn("part", F.col("part") + F.col("parts"))
    alone = F.col("first") & (F.col("stop") == 1)
    joined = here.where(~alone).groupBy("doc", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "n", "value"))), lambda x: x.value), "}").alias("value"), F.max("leaves").alias("leaves"), F.min_by("depth", F.struct("at", "n")).alias("depth")
    )
    whole = here.where(alone).select("doc", "part", "value", "leaves", "depth").unionByName(joined.select("doc", "part", "value", "leaves", "depth"))
    whole = whole.withColumn("value", F.concat("value", F.lit("}")))

    opened = F.udf(_opened, "name string, value string")
    # as many as a document has members of its own
    heads = written(whole.where("leaves").select("doc", "part", opened("value", F.col("depth").cast("int")).alias("o")).select("doc", "part", "o.*"), "heads")
    until = F.lead("part").over(Window.partitionBy("doc").orderBy("part"))
    lists = heads.withColumn("until", until).where(F.col("name") == name)
    rest = whole.where("not leaves").select("doc", "part", F.regexp_replace("value", r"\A[^{]*+", "").alias("value"))
    found = rest.join(F.broadcast(lists.select("doc", F.col("part").alias("since"), "until")), "doc").where("part > since and (until is null or part < until)")
    return lists.where("value is not null").select("value").unionByName(found.select("value"))
