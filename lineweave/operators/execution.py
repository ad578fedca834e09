"""Executing a plan: checks before, the diff that it should make, and whether the observed diff is that one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import written
from ..functions.text import lines, normal_line, split_lines, strip
from . import plan_ops, reconcile, seqdiff

#: Lines around an inserted helper, before its id.
START, END = "# >>> HELPER START: ", "# <<< HELPER END: "


def _inserted(changes: DataFrame, helpers: DataFrame, start: str, end: str) -> DataFrame:
    """Helper changes with the marked text of their helper as ``helper_source``; helpers without a text go."""
    text = helpers.where("text is not null and text != ''").select("helper_ref", F.col("text").alias("_text"))
    name = F.coalesce("helper_id", "id")
    marked = F.concat(F.lit(start), name, F.lit("\n"), F.array_join(split_lines("_text"), "\n"), F.lit(f"\n{end}"), name)
    return changes.where("type = 'helper'").join(text, "helper_ref").withColumn("helper_source", marked).select(*changes.columns)


def _appended(text_lines: DataFrame, changes: DataFrame) -> DataFrame:
    """(file, line_no, line) of replacements that continue a file: no line is theirs, and theirs follow its last one without a gap."""
    last = text_lines.groupBy("file").agg(F.max("line_no").alias("last"))
    lost = plan_ops.locate(text_lines, changes).where("at is null").groupBy("file", "line").agg(F.min_by("replacement", "id").alias("replacement"))
    beyond = lost.join(last, "file", "left").withColumn("last", F.coalesce("last", F.lit(0))).where(F.col("line") > F.col("last"))
    n = F.row_number().over(Window.partitionBy("file").orderBy("line"))
    return beyond.withColumn("n", n).where(F.col("line") == F.col("last") + F.col("n")).select("file", F.col("line").alias("line_no"), F.col("replacement").alias("line"))


def _whole(path: str, text: Column, status: str) -> list[Column]:
    """A file's path, status and the one block of a file that comes or goes."""
    body, none = split_lines(normal_line(text)), F.array().cast("array<string>")
    added = status == "added"
    block = F.struct(F.lit("insert" if added else "delete").alias("type"), F.lit(1).alias("start_line"), F.size(body).alias("end_line"), (none if added else body).alias("before"), (body if added else none).alias("after"))
    return [F.col(path).alias("path"), F.lit(status).alias("status"), F.array(block).cast(seqdiff.CHANGES).alias("changes")]


def planned_diff(files: DataFrame, changes: DataFrame, helpers: DataFrame | None = None, start: str = START, end: str = END) -> DataFrame:
    """(path, status, changes): what applying a plan to a snapshot of files (path, text) changes, as a normalised diff.

    The plan's lines are those of the snapshot. ``helpers`` (helper_ref, text) are the helper files at hand: those that
    the plan inserts are added files, the others removed ones. A replacement of the line after the last is appended,
    also to a file that isn't there. A file that isn't in the plan doesn't change; files of an empty plan don't either.
    """
    touched = files.join(changes.select(F.col("file").alias("path")).distinct(), "path", "left_semi")
    before = lines(touched, "path").withColumnRenamed("path", "file")
    plan = changes.where(plan_ops.kind() == "replace")
    if helpers is not None:
        plan = plan.unionByName(_inserted(changes, helpers, start, end))
    after = plan_ops.apply(before, plan).unionByName(_appended(before, changes).withColumn("line_no", F.col("line_no") + F.lit(1 << 30)))
    # a file is put together in one row, as the files of the snapshot are
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    texts = after.groupBy(F.col("file").alias("path")).agg(joined.alias("after"))
    pairs = touched.select("path", F.col("text").alias("before")).join(texts, "path", "full_outer")
    old = pairs.where("before is not null").withColumn("after", F.coalesce("after", F.lit("")))
    out = seqdiff.diff_pairs(old).unionByName(pairs.where("before is null").select(*_whole("path", F.col("after"), "added")))
    if helpers is not None:
        ours = helpers.where("text is not null and text != ''")
        named = changes.where("type = 'helper'").select("helper_ref").distinct()
        for how, status in (("left_semi", "added"), ("left_anti", "removed")):
            out = out.unionByName(ours.join(named, "helper_ref", how).select(*_whole("helper_ref", F.col("text"), status)))
    return seqdiff.normalized(out)


def verify_execution(expected: DataFrame, observed: DataFrame, strict: bool = False) -> DataFrame:
    """One row on two diffs (path, status, changes): files, hashes, matched changes, ``verified``.

    Equal hashes decide; only where they differ do the counts of changes say by how much. Strict mode also fails on
    files that one side alone has, which differing hashes always show. Both diffs are read several times: give tables.
    """
    sides = {"expected": expected, "observed": observed}
    block = lambda df: df.select("path", F.posexplode("changes").alias("n", "c")).select("path", F.to_json("c.before").alias("before"), F.to_json("c.after").alias("after"), F.struct("c.start_line", "n").alias("ord"))
    parts = [reconcile.summary(reconcile.reconcile(block(expected), block(observed)))]
    for name, df in sides.items():
        parts += [seqdiff.diff_hash(df).withColumnRenamed("diff_hash", f"{name}_hash"), df.agg(F.count_distinct("path").alias(f"{name}_files"))]
    scope = reconcile.scope_mismatch(expected, observed).agg(F.count_if(F.col("side") == "missing").alias("missing_files"), F.count_if(F.col("side") == "unexpected").alias("unexpected_files"))
    # rows of one each, written one by one: together their plans would be more than a driver should hold
    out = reduce(_beside, [written(part, "verified") for part in (*parts, scope)]).withColumn("match", F.col("expected_hash") == F.col("observed_hash"))
    inside = (F.col("missing_files") == 0) & (F.col("unexpected_files") == 0)
    return out.withColumn("verified", F.col("match") & inside if strict else F.col("match"))


def _beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of one row each as one."""
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def unsafe(path: Column) -> Column:
    """Whether a path leaves its root: absolute, with a drive, or with a part .. or a NUL."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.startswith(p, F.lit("/")) | p.rlike(r"\A[A-Za-z]:") | p.rlike(r"(?:\A|/)\.\.(?:/|\z)") | F.contains(p, F.lit("\0"))


def preflight(
    text_lines: DataFrame, changes: DataFrame, helpers: DataFrame | None = None, hashes: DataFrame | None = None, given: str | None = None, complete: bool = True, removal: bool = False, errors: tuple[str, ...] = ()
) -> DataFrame:
    """(id, condition, error): everything that speaks against applying a plan; no rows if it may be applied.

    ``text_lines`` (file, line_no, line) is the snapshot. Conditions are structure (each change by itself, two changes
    of one line), integrity (``hashes``: file, expected, actual), completeness (``complete``: the scan was), semantics
    (helpers (helper_ref) that nobody has), safety (paths), source (the file is missing, the original is stale or
    ambiguous), preflight (a helper's line is beyond the file, and ``errors`` of the surroundings, such as the log),
    authorization (``removal``: helpers may be removed), and confirmation (``given``: the hash's first digits).
    What concerns the whole plan has a null id.
    """
    said = lambda df, condition, error: df.select("id", F.lit(condition).alias("condition"), error.alias("error"))
    whole = lambda condition, error: changes.sparkSession.range(1).select(F.lit(None).cast("string").alias("id"), F.lit(condition).alias("condition"), F.lit(error).alias("error"))
    found = [said(plan_ops.validate(changes).select("id", F.explode("errors").alias("e")), "structure", F.col("e"))]
    ends = text_lines.groupBy("file").agg(F.max("line_no").alias("last"))
    found.append(said(changes.where(unsafe(F.col("file"))), "safety", F.lit("path outside its root")))
    placed = changes.where(F.coalesce("file", F.lit("")) != "").join(ends, "file", "left")
    found.append(said(placed.where("last is null"), "source", F.lit("missing file")))
    have = text_lines.select("file", F.col("line_no").alias("at"), strip("line").alias("bare"))
    want = placed.where("last is not null").where(plan_ops.kind() == "replace").select("id", "file", "line", strip("original").alias("bare"))
    seen = want.join(have, ["file", "bare"], "left").groupBy("id").agg(F.count("at").alias("n"), F.coalesce(F.bool_or(F.col("at") == F.col("line")), F.lit(False)).alias("there"))
    found.append(said(seen.where("n = 0"), "source", F.lit("stale")))
    found.append(said(seen.where("n > 1 and not there"), "source", F.lit("ambiguous")))
    found.append(said(placed.where("type = 'helper' and line > last + 1"), "preflight", F.lit("line beyond the file")))
    if helpers is not None:
        found.append(said(changes.where("helper_ref is not null").join(helpers.select("helper_ref").distinct(), "helper_ref", "left_anti"), "semantics", F.lit("unknown helper")))
    if hashes is not None:
        off = hashes.where(~F.col("expected").eqNullSafe(F.col("actual"))).select("file").distinct()
        found.append(said(changes.join(off, "file", "left_semi"), "integrity", F.lit("the file's hash differs")))
    if not removal:
        found.append(said(changes.where("type = 'helper_remove'"), "authorization", F.lit("removal is not authorized")))
    if not complete:
        found.append(whole("completeness", "the scan is incomplete"))
    found.extend(whole("preflight", e) for e in errors)
    if given is not None:
        wrong = plan_ops.confirmed(plan_ops.plan_hash(changes), given).where("not confirmed")
        found.append(wrong.select(F.lit(None).cast("string").alias("id"), F.lit("confirmation").alias("condition"), F.lit("the plan's hash is another").alias("error")))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def admitted(changes: DataFrame, problems: DataFrame) -> DataFrame:
    """All changes if :func:`preflight` found nothing, else none."""
    stop = problems.limit(1).select(F.lit(1).alias("_stop"))  # one row at most
    return changes.withColumn("_stop", F.lit(1)).join(F.broadcast(stop), "_stop", "left_anti").drop("_stop")
