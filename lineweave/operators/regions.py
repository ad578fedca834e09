"""Marked regions of a text: extraction, errors, states, reconciliation."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_hash
from ..functions.text import line_column
from . import chains

# The states' bits, and what a region looks like.
STATES = {"ORIGINAL": 0, "MODIFIED": 1, "REVISION": 2, "REQUIRED": 4, "ELLIOT_NESS": 8, "IGNORE": 16}
MASK = 31
PATTERN = r'\{\[#(\d+|' + "|".join(sorted(STATES, key=len, reverse=True)) + r')_([A-Z0-9]{3}):"(.*?)"#\]\}'
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"))


def escape(c: Column) -> Column:
    for raw, escaped in _ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def unescape(c: Column) -> Column:
    """Inverse of :func:`escape`, read from left to right through a mark that no text holds."""
    mark = "\x00"
    c = F.replace(c, F.lit("\\\\"), F.lit(mark))
    c = F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    return F.replace(c, F.lit(mark), F.lit("\\"))


def state_value(c: Column) -> Column:
    """A state's bits from its number or name; null if it has bits outside the mask."""
    named = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))[c]
    value = F.coalesce(named, c.try_cast("int"))
    return F.when((value >= 0) & (value.bitwiseAND(F.lit(~MASK)) == 0), value)


def format_region(region_id: Column, state: Column, original: Column) -> Column:
    return F.concat(F.lit("{[#"), state.cast("string"), F.lit("_"), region_id, F.lit(':"'), original, F.lit('"#]}'))


def region_id(*parts: Column) -> Column:
    """Three characters from a hash of what identifies the region: the same on every run, where random ones aren't."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    number = F.pmod(F.xxhash64(*parts), F.lit(36**3))
    return F.concat(*(F.substring(alphabet, (F.pmod(F.floor(number / 36**i), F.lit(36)) + 1).cast("int"), F.lit(1)) for i in range(3)))


def extract(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, n, id, state, original, hash, start_line, start_column, end_line, end_column) of every region.

    Pieces between regions give the offsets; a state outside the mask is null.
    """
    pattern = f"(?s){PATTERN}"
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"))
    rows = files.where(F.contains(text, F.lit("{[#"))).select(file, F.col(text).alias("_text"), F.posexplode(parts).alias("n", "p")).where("p.whole is not null")
    from pyspark.sql import Window

    end = F.sum(F.length("p.gap") + F.length("p.whole")).over(Window.partitionBy(file).orderBy("n"))
    rows = rows.withColumn("_end", end.cast("int")).withColumn("_start", F.col("_end") - F.length("p.whole"))
    first, last = line_column("_text", "_start"), line_column("_text", "_end")
    get = lambda i: F.regexp_extract("p.whole", pattern, i)
    return rows.select(file, "n", get(2).alias("id"), state_value(get(1)).alias("state"), get(3).alias("original"), F.sha2(get(3).cast("binary"), 256).alias("hash"), first[0].alias("start_line"), first[1].alias("start_column"), last[0].alias("end_line"), last[1].alias("end_column"))


def errors(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, line, column, message): closing marks without an opening before them, and regions without a body.

    What is open depends on all marks before, so marks are read in order in Arrow. Unclosed openings are no errors.
    """

    def read(batches):
        marks = re.compile(r'\{\[#[^:]{1,16}:"|"#\]\}')
        for batch in batches:
            out = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                opened = None
                for m in marks.finditer(raw or ""):
                    at = (raw.count("\n", 0, m.start()) + 1, m.start() - raw.rfind("\n", 0, m.start()))
                    if m.group().startswith("{"):
                        opened = m.end()
                    elif opened is None:
                        out.append((name, *at, "closing mark without an opening"))
                    else:
                        if opened == m.start():
                            out.append((name, *at, "empty region"))
                        opened = None
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int32(), pa.int32(), pa.string()), strict=True))], [file, "line", "column", "message"])

    kind = files.schema[file].dataType.simpleString()
    return files.select(file, text).mapInArrow(read, f"{file} {kind}, line int, column int, message string")


def reconcile(before: DataFrame, after: DataFrame, file: str = "file", semantic: tuple[str, ...] = ("state", "original", "modified", "hash")) -> DataFrame:
    """(file, id, status) of regions: added, removed, changed or same by their meaning; a move is no change.

    Of repeated ids in a file the last one counts.
    """
    from .artifact_diff import last_by_key

    keyed = lambda df: last_by_key(df.withColumn("_key", F.concat_ws("\x01", file, "id")), "_key", "n").select(file, "id", F.struct(*semantic).alias("s"))
    a, b = keyed(before).withColumnRenamed("s", "a"), keyed(after).withColumnRenamed("s", "b")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return a.join(b, [file, "id"], "full_outer").select(file, "id", status.alias("status"))


def file_changes(snapshots: DataFrame, scope: str, order: str, file: str = "file", semantic: tuple[str, ...] = ("state", "original", "modified", "hash")) -> DataFrame:
    """(scope, order, file, status, before, after): files whose regions differ from the snapshot before.

    ``snapshots`` has a row for each region of a scope's snapshot, snapshots numbered without a gap; ``before`` and
    ``after`` are hashes of the set of a file's regions by id and meaning, null where the file has none. A move
    within a file, and a repeated region, is no change.
    """
    state = canonical_hash(**{c: F.col(c) for c in ("id", *semantic)})
    once = snapshots.select(scope, order, file, state.alias("h")).distinct()
    sets = once.groupBy(scope, order, file).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ",").cast("binary"), 256).alias("after"))
    # a state of the snapshot before is the one that this snapshot starts from
    last = snapshots.groupBy(scope).agg(F.max(order).alias("_last"))
    ahead = sets.select(scope, (F.col(order) + 1).alias(order), file, F.col("after").alias("before")).join(last, scope).where(F.col(order) <= F.col("_last")).drop("_last")
    both = sets.join(ahead, [scope, order, file], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return both.select(scope, order, file, status.alias("status"), "before", "after")


def history(snapshots: DataFrame, scope: str, order: str, file: str = "file", semantic: tuple[str, ...] = ("state", "original", "modified", "hash")) -> DataFrame:
    """(scope, order, files, changes_hash, sequence, previous_hash, state_hash): one entry for each snapshot that changes a file.

    Entries are numbered from 0 and name the entry before by hash; ``chains.verify_chain`` checks them.
    """
    one = canonical_hash(file=F.col(file).cast("string"), status=F.col("status"), before=F.col("before"), after=F.col("after"))
    changed = file_changes(snapshots, scope, order, file, semantic).select(scope, order, one.alias("h"))
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ",").cast("binary"), 256)
    entries = changed.groupBy(scope, order).agg(F.count("*").alias("files"), digest.alias("changes_hash"))
    return chains.chain(entries, scope, order, [order, "changes_hash"])


def intact(regions: DataFrame, manifest: DataFrame, file: str = "file") -> DataFrame:
    """(file, id, ok): every region of a manifest is there with the same hash."""
    now = regions.select(file, "id", F.col("hash").alias("now"))
    return manifest.select(file, "id", "hash").join(now, [file, "id"], "left").groupBy(file, "id").agg(F.coalesce(F.bool_or(F.col("hash") == F.col("now")), F.lit(False)).alias("ok"))


def mark(files: DataFrame, spans: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, text) with every span (file, start, end) marked as an original region; offsets are code points from 0.

    A span outside the text, or one that overlaps another, fails the query.
    """
    from pyspark.sql import Window

    ahead = F.max("end").over(Window.partitionBy(file).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    checked = spans.withColumn("ahead", F.coalesce(ahead, F.lit(0)))
    lists = checked.groupBy(file).agg(F.array_sort(F.collect_list(F.struct("start", "end", "ahead"))).alias("spans"))
    rows = files.select(file, F.col(text).alias("text")).join(lists, file, "left")
    t = F.col("text")
    bad = F.exists("spans", lambda s: (s.start < 0) | (s.end < s.start) | (s.end > F.length(t)) | (s.start < s.ahead))
    piece = lambda a, b: F.substring(t, a + 1, b - a)
    parts = F.transform("spans", lambda s: F.concat(piece(s.ahead, s.start), format_region(region_id(F.col(file), s.start, piece(s.start, s.end)), F.lit(0), piece(s.start, s.end))))
    rest = F.substring(t, F.element_at("spans", -1)["end"] + 1, F.lit(1 << 30))
    done = F.when(F.col("spans").isNull(), t).when(bad, F.raise_error(F.lit("invalid or overlapping region"))).otherwise(F.concat(F.array_join(parts, ""), rest))
    return rows.select(file, done.alias("text"))
