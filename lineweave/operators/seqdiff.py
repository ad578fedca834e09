"""Sequence diffs of file versions as canonical blocks, and what is made of them.

Equal pairs are dropped by hash. A pair of short files is one gap that goes through Python's difflib in an Arrow batch; longer
ones are aligned by joins (:mod:`align`).
"""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_hash, set_digest
from ..functions.shared import written
from ..functions.text import SPACE, normal_line, split_lines
from . import align

#: More changed lines than this make one whole-file change.
WHOLE_FILE = 200
#: Pairs of short files whose lines a task holds as Python objects at once.
ROWS = 50
_BLOCK = pa.struct([("type", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])
CHANGES = "array<struct<type:string,start_line:int,end_line:int,before:array<string>,after:array<string>>>"


def joined(found: list[dict], touching: bool) -> list[dict]:
    """Blocks in order, those that touch made one."""
    out: list[dict] = []
    last = None
    for one in found:
        begin = one["start_line"] - 1
        if out and (out[-1]["end_line"] + 1 == one["start_line"] if touching else last == begin):
            held = out[-1]
            held |= {"type": "replace", "end_line": one["end_line"], "before": held["before"] + one["before"], "after": held["after"] + one["after"]}
        else:
            out.append(one)
        last = begin + len(one["before"])
    return out


def blocks(before: list[str], after: list[str], touching: bool = False) -> list[dict]:
    """Change blocks with 1-based lines of the earlier version.

    An insertion takes the line that it stands before, blocks that touch are one. ``touching`` also merges blocks
    that only seem to touch because an insertion has no line of its own, across one unchanged line.
    """
    codes = difflib.SequenceMatcher(None, before, after).get_opcodes()
    return joined([{"type": tag, "start_line": a + 1, "end_line": max(b, a + 1), "before": before[a:b], "after": after[c:d]} for tag, a, b, c, d in codes if tag != "equal"], touching)


def diff_pairs(pairs: DataFrame, key: str = "path", touching: bool = False) -> DataFrame:
    """(key, status, changes) from (key, before, after) texts; null is a file that isn't there. Equal pairs are left out.

    Keys may be null or repeated. Files of more than :data:`align.SHORT` lines are aligned as joins of their lines.
    """
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("modified")
    rows = pairs.where(~F.col("before").eqNullSafe(F.col("after")))
    texts = (split_lines(F.coalesce(normal_line(c), F.lit(""))).alias(c) for c in ("before", "after"))
    rows = written(rows.select(key, status.alias("status"), F.monotonically_increasing_id().alias("_pair"), *texts), "pairs")
    is_long = F.greatest(F.size("before"), F.size("after")) > align.SHORT

    def few(batches):
        """Batches of few rows: lines as Python objects are many times as large as in Arrow."""
        for batch in batches:
            yield from (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS))

    def local(batches):
        for batch in few(batches):
            made = [blocks(x or [], y or [], touching) for x, y in zip(batch.column("before").to_pylist(), batch.column("after").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("status"), pa.array(made, pa.list_(_BLOCK))], [key, "status", "changes"])

    def touch(batches):
        for batch in few(batches):
            made = [joined(x, True) for x in batch.column("changes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("status"), pa.array(made, pa.list_(_BLOCK))], [key, "status", "changes"])

    shape = f"{key} {rows.schema[key].dataType.simpleString()}, status string, changes {CHANGES}"
    short = rows.where(~is_long).drop("_pair").mapInArrow(local, shape)
    long = rows.where(is_long)
    if not long.limit(1).count():
        return short
    lines = [long.select("_pair", F.posexplode(side).alias("n", "line")).select("_pair", (F.col("n") + 1).alias("n"), "line") for side in ("before", "after")]
    changed = align.change_blocks(align.edits(*lines, "_pair"), "_pair")
    # two versions whose lines differ in their ends only have no blocks
    aligned = long.select("_pair", key, "status").join(changed, "_pair", "left").select(key, "status", F.coalesce("changes", F.array().cast(CHANGES)).alias("changes"))
    return short.unionByName(aligned.mapInArrow(touch, shape) if touching else aligned)


def normalized(files: DataFrame, key: str = "path") -> DataFrame:
    """Files of a diff without empty changes, changes in order of their lines; files left without changes go.

    Doing it twice changes nothing.
    """
    real = F.filter("changes", lambda c: (F.size(c.before) > 0) | (F.size(c.after) > 0))
    by_line = F.transform(F.array_sort(F.transform(real, lambda c, i: F.struct(c.start_line.alias("l"), i.alias("i"), c.alias("c")))), lambda x: x.c)
    return files.withColumn("changes", by_line).where(F.size("changes") > 0)


def view(files: DataFrame, key: str = "path", trim: bool = False, zero_impact: bool = True, empty_files: bool = True) -> DataFrame:
    """A normalised diff for people to look at, not for its hash: on request lines without white space at their ends, and
    without changes that change nothing, and without files that have no change left.
    """
    shown = normalized(files, key)
    if trim:
        body = lambda lines: F.transform(lines, lambda x: F.regexp_replace(x, rf"{SPACE}++\z", ""))
        shown = shown.withColumn("changes", F.transform("changes", lambda c: c.withField("before", body(c.before)).withField("after", body(c.after))))
    if not zero_impact:
        shown = shown.withColumn("changes", F.filter("changes", lambda c: ~c.before.eqNullSafe(c.after)))
    return shown if empty_files else shown.where(F.size("changes") > 0)


def diff_hash(files: DataFrame, key: str = "path") -> DataFrame:
    """One row: the hash of a normalised diff, the same in whatever order files and changes come.

    Files are hashed one by one, and their hashes in a tree.
    """
    one = canonical_hash(path=F.col(key).cast("string"), status=F.col("status"), changes=F.col("changes"))
    return set_digest(normalized(files, key).select(one.alias("h")), "diff_hash")


def to_plan(files: DataFrame, key: str = "path", most: int = WHOLE_FILE) -> DataFrame:
    """(file, line, original, replacement): a row for each changed line; a file with more than ``most`` becomes one row.

    A replacement pairs lines in order; the longer side's rest is an insertion or deletion of its own, so that no
    line is lost.
    """
    each = files.select(F.col(key).alias("file"), F.explode("changes").alias("c"))
    pairs = F.transform(F.arrays_zip("c.before", "c.after"), lambda p, i: F.struct((F.col("c.start_line") + F.least(i, F.greatest(F.size("c.before") - 1, F.lit(0)))).alias("line"), p["before"].alias("original"), p["after"].alias("replacement")))
    rows = each.select("file", F.explode(pairs).alias("p")).select("file", "p.*")
    n = F.count("*").over(Window.partitionBy("file"))
    small = rows.withColumn("n", n).where(F.col("n") <= most).drop("n")
    large = rows.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") > most).select("file", F.lit(1).alias("line"), F.lit(None).cast("string").alias("original"), F.lit(None).cast("string").alias("replacement"))
    return small.withColumn("whole_file", F.lit(False)).unionByName(large.withColumn("whole_file", F.lit(True)))


def merge_adjacent(changes: DataFrame, *by: str) -> DataFrame:
    """Changes (start_line, end_line) of one ``by`` that touch become one: gaps and islands.

    Changes with the same lines are counted once before, so that the order within a ``by`` has no ties.
    """
    once = changes.groupBy(*by, "start_line", "end_line").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy("start_line", "end_line")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    once = once.withColumn("reach", reach)
    island = F.sum(F.when(F.col("reach") + 1 >= F.col("start_line"), 0).otherwise(1)).over(order)
    return once.withColumn("island", island).groupBy(*by, "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.sum("n").alias("merged")).drop("island")
