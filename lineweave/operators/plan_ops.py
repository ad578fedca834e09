"""Change plans: validation, order, inversion, application, reconstruction.

A plan is a table of changes: (id, type, file, line, original, replacement, token, helper_id, helper_ref,
helper_source). ``type`` is null or replace for replacements, helper or helper_remove for helpers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_hash, set_digest
from ..functions.text import strip

KINDS = ("replace", "helper", "helper_remove")
#: Digits of a plan's hash that confirm its application.
CONFIRM = 8
#: Lines of a file that is rebuilt as one text.
MOST_LINES = 10_000_000


def kind() -> Column:
    return F.coalesce("type", F.lit("replace"))


def violations() -> Column:
    """What is wrong with a change by itself, as an array."""
    k = kind()
    helper = k.isin("helper", "helper_remove")
    rules = [
        (~k.isin(*KINDS), "unknown type"),
        (F.coalesce("file", F.lit("")) == "", "missing file"),
        (F.col("line").isNull(), "missing line"),
        (F.col("line") < 1, "line below 1"),
        ((k == "replace") & F.col("original").isNull(), "missing original"),
        ((k == "replace") & F.col("replacement").isNull(), "missing replacement"),
        (helper & F.col("helper_id").isNull(), "missing helper_id"),
        (helper & F.col("helper_ref").isNull(), "missing helper_ref"),
        ((k == "helper") & F.col("helper_source").isNull(), "missing helper_source"),
    ]
    return F.array_compact(F.array(*(F.when(test, text) for test, text in rules)))


def validate(changes: DataFrame, order: str = "id") -> DataFrame:
    """``changes`` with ``errors``: each one's own, and duplicate for a second change of one file, line and type."""
    nth = F.row_number().over(Window.partitionBy("file", "line", kind()).orderBy(order))
    repeated = F.array_compact(F.array(F.when(nth > 1, "duplicate")))
    return changes.withColumn("errors", F.concat(violations(), repeated))


def stats(changes: DataFrame) -> DataFrame:
    """(changes, files, invalid) of a validated plan."""
    return changes.agg(F.count("*").alias("changes"), F.count_distinct("file").alias("files"), F.count_if(F.size("errors") > 0).alias("invalid"))


def plan_hash(changes: DataFrame) -> DataFrame:
    """One row: a hash that doesn't depend on the order of the changes."""
    one = canonical_hash(**{c: F.col(c) for c in ("file", "line", "original", "replacement", "token")}, type=kind())
    return set_digest(changes.select(one.alias("h")), "plan_hash")


def ordered(changes: DataFrame) -> DataFrame:
    """By file, line and id."""
    return changes.orderBy(F.col("file").asc_nulls_first(), F.coalesce("line", F.lit(0)), F.col("id").asc_nulls_first())


def invert(changes: DataFrame) -> DataFrame:
    """The plan that undoes this one: originals and replacements swapped, helpers removed, removed ones put back."""
    turned = F.when(F.col("type") == "helper", "helper_remove").when(F.col("type") == "helper_remove", "helper").otherwise(F.lit(None))
    swapped = {"original": F.col("replacement"), "replacement": F.col("original"), "type": turned, "id": F.concat("id", F.lit("-inv"))}
    return changes.withColumns(swapped)


def locate(text_lines: DataFrame, changes: DataFrame) -> DataFrame:
    """Each replacement with the line ``at`` that it applies to, null if its original is nowhere in the file.

    The original and the line are compared without outer white space; the stated line is preferred, else the first.
    """
    have = text_lines.select("file", F.col("line_no").alias("at"), F.col("line").alias("found"), strip("line").alias("bare"))
    want = changes.where(kind() == "replace").select("id", "file", "line", "original", "replacement", strip("original").alias("bare"))
    order = Window.partitionBy("id").orderBy(F.coalesce(F.col("at") != F.col("line"), F.lit(True)), "at")
    return want.join(have, ["file", "bare"], "left").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "bare")


def eligible(text_lines: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, errors) of the changes that stop a plan: invalid, stale (original not found) or ambiguous (off its line, twice)."""
    bad = validate(changes).where(F.size("errors") > 0).select("id", F.array_join("errors", ", ").alias("error"))
    have = text_lines.select("file", F.col("line_no").alias("at"), strip("line").alias("bare"))
    want = changes.where(kind() == "replace").select("id", "file", "line", strip("original").alias("bare"))
    seen = want.join(have, ["file", "bare"], "left").groupBy("id").agg(F.count("at").alias("n"), F.coalesce(F.bool_or(F.col("at") == F.col("line")), F.lit(False)).alias("there"))
    stale = seen.where("n = 0").select("id", F.lit("stale").alias("error"))
    vague = seen.where("n > 1 and not there").select("id", F.lit("ambiguous").alias("error"))
    return bad.unionByName(stale).unionByName(vague).groupBy("id").agg(F.sort_array(F.collect_list("error")).alias("errors"))


def apply(text_lines: DataFrame, changes: DataFrame) -> DataFrame:
    """New lines (file, line_no, line): the first change of a line takes effect, unmatched ones are left out.

    Inserted helper lines stand before the line that they name, in order of ids, once for each helper and file.
    """
    first = Window.partitionBy("file", "at").orderBy("line", "id")
    hits = locate(text_lines, changes).where("at is not null").withColumn("n", F.row_number().over(first)).where("n = 1")
    hits = hits.select("file", F.col("at").alias("line_no"), "replacement", "original")
    indent = F.regexp_extract("line", r"\A[\t ]*", 0)
    changed = text_lines.join(hits, ["file", "line_no"], "left")
    body = changed.select("file", F.col("line_no").cast("double").alias("place"), F.lit("").alias("id"), F.when(F.col("replacement").isNull(), F.col("line")).otherwise(F.concat(indent, strip("replacement"))).alias("line"))
    once = Window.partitionBy("file", "helper_id").orderBy("line", "id")
    helpers = changes.where("type = 'helper'").withColumn("n", F.row_number().over(once)).where("n = 1")
    added = helpers.select("file", (F.col("line") - 0.5).alias("place"), "id", F.col("helper_source").alias("line"))
    order = Window.partitionBy("file").orderBy("place", "id")
    return body.unionByName(added).select("file", F.row_number().over(order).alias("line_no"), "line")


def confirmed(hashes: DataFrame, given: str) -> DataFrame:
    """Whether the given prefix confirms a plan's hash; shorter prefixes than ``CONFIRM`` don't."""
    return hashes.withColumn("confirmed", F.lit(len(given) >= CONFIRM) & F.startswith("plan_hash", F.lit(given)))


def rehydrated_lines(changes: DataFrame) -> DataFrame:
    """(file, line, text): the lines that a plan's replacements give; of one line the smallest id's. Lines below 1 are none."""
    return changes.where((kind() == "replace") & (F.col("line") >= 1)).groupBy("file", "line").agg(F.min_by("replacement", "id").alias("text"))


def rehydrate(changes: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """(file, text): sparse files rebuilt from a plan's replacements, a line for each changed line, gaps empty.

    A file whose last line is beyond ``most`` has a null text: :func:`rehydrated_lines` has its lines. A file without a line
    from 1 on isn't rebuilt.
    """
    before = F.lag("line", 1, 1).over(Window.partitionBy("file").orderBy("line"))
    lines = rehydrated_lines(changes).withColumn("gap", (F.col("line") - before).cast("int"))
    piece = F.when(F.col("line") <= most, F.concat(F.repeat(F.lit("\n"), F.col("gap")), F.coalesce("text", F.lit(""))))
    whole = lines.withColumn("piece", piece).groupBy("file").agg(F.max("line").alias("last"), F.array_sort(F.collect_list(F.struct("line", "piece"))).alias("pieces"))
    return whole.select("file", F.when(F.col("last") <= most, F.array_join(F.transform("pieces", lambda x: x["piece"]), "")).alias("text"))


def copied(files: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(file, text): files rebuilt from a stored state (file, text), those in ``kept`` (file) alone if it is given.

    A path that leaves the target's root fails the query; of repeated paths, which a state shouldn't hold, all are copied.
    """
    from .execution import unsafe

    safe = F.when(unsafe(F.col("file")), F.raise_error(F.lit("path outside its root"))).otherwise(F.col("file"))
    chosen = files if kept is None else files.join(kept.select("file").distinct(), "file", "left_semi")
    return chosen.select(safe.alias("file"), "text")


def minimal(changes: DataFrame) -> DataFrame:
    """A plan as read from CSV in the plan's order; it has no times, so that equal tables give equal plans."""
    return ordered(changes)


def missing_helpers(changes: DataFrame, available: DataFrame) -> DataFrame:
    """Helpers that a plan refers to and nobody has."""
    return changes.where("helper_ref is not null").select("helper_ref").distinct().join(available.select("helper_ref"), "helper_ref", "left_anti")


def canonical(changes: DataFrame) -> DataFrame:
    """The replacements of a plan alone, without helper fields, in the plan's order; incomplete ones fail the query."""
    rows = changes.where(kind() == "replace")
    bad = F.col("original").isNull() | F.col("replacement").isNull()
    checked = F.when(bad, F.raise_error(F.lit("a replacement needs both texts"))).otherwise(F.col("original"))
    return ordered(rows.withColumn("original", checked)).select("id", "file", "line", "original", "replacement", "token")
