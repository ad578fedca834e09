"""Files as tables: listings, scopes, admission of text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .elements import elements

SNIFF = 1024


def read_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, content) of every file below ``root``, paths relative to it; the listing is Spark's."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    full = F.regexp_replace("path", r"\A[a-z]+:/*", "/")
    base = root.rstrip("/").removeprefix("file:")
    relative = F.regexp_replace(F.substring(full, F.instr(full, F.lit(base)) + len(base), F.lit(1 << 30)), r"\A/", "")
    return rows.select(relative.alias("path"), "content", F.col("length").alias("size"))


def listed(tree: DataFrame, names: DataFrame) -> DataFrame:
    """Only the files that a list (path) names, as a version-control listing does."""
    return tree.join(names.select("path").distinct(), "path", "left_semi")


def changed_or_all(tree: DataFrame, staged: DataFrame, unstaged: DataFrame, unignored: DataFrame) -> DataFrame:
    """Changed files, staged or not; without any change all unignored files."""
    changed = staged.select("path").union(unstaged.select("path")).distinct()
    some = changed.agg((F.count("*") > 0).alias("some"))
    fallback = unignored.select("path").distinct().join(F.broadcast(some), F.expr("not some")).select("path")  # one row
    return listed(tree, changed.union(fallback))


def glob_pattern(pattern: Column) -> Column:
    """A glob of an ignore file as a regular expression over relative paths."""
    p = F.regexp_replace(pattern, r"([.+()^$|\[\]{}])", r"\\$1")
    p = F.replace(F.replace(F.replace(p, F.lit("**"), F.lit("\x00")), F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    p = F.replace(p, F.lit("\x00"), F.lit(".*"))
    anchored = F.when(F.startswith(pattern, F.lit("/")), F.concat(F.lit(r"\A"), F.substring(p, 2, 1 << 20))).otherwise(F.concat(F.lit(r"(?:\A|/)"), p))
    return F.when(F.endswith(pattern, F.lit("/")), anchored).otherwise(F.concat(anchored, F.lit(r"(?:/|\z)")))


def without_ignored(tree: DataFrame, patterns: list[str], keep: str | None = None, never: str | None = None) -> DataFrame:
    """Files that no ignore pattern matches, in order of paths; comments don't count, and a negated pattern takes back those before.

    Files below ``keep`` stay in spite of patterns; files that end in ``never`` go in spite of ``keep``. Patterns are looked
    for anywhere in a path; :mod:`ignore` has the full rules of ignore files.
    """
    out = F.lit(False)
    for pattern in patterns:
        if pattern.strip() and not pattern.startswith("#"):
            out = F.when(F.regexp_like("path", glob_pattern(F.lit(pattern.removeprefix("!")))), F.lit(not pattern.startswith("!"))).otherwise(out)
    stay = ~out if keep is None else ~out | F.startswith("path", F.lit(keep))
    rows = tree.where(stay)
    return (rows.where(~F.endswith("path", F.lit(never))) if never else rows).orderBy("path")


def read_scope(lines: DataFrame, tree: DataFrame) -> DataFrame:
    """(n, line, status) of a scope file's lines (n, line): active, inactive or comment.

    A commented line that names a file that is there is inactive.
    """
    bare = F.trim("line")
    named = F.when(F.startswith(bare, F.lit("#")), F.trim(F.regexp_replace(bare, r"\A#+", ""))).otherwise(bare)
    paths = tree.select("path").distinct().withColumn("there", F.lit(True))
    rows = lines.where(bare != "").withColumn("path", named).join(paths, "path", "left")
    status = F.when(~F.startswith(bare, F.lit("#")), "active").when(F.col("there"), "inactive").otherwise("comment")
    return rows.select("n", "line", "path", status.alias("status"))


def refresh_scope(scope: DataFrame, tree: DataFrame) -> DataFrame:
    """Scope lines anew: their order stays, active lines whose file is gone are dropped, new files follow sorted."""
    paths = tree.select("path").distinct()
    gone = scope.where("status = 'active'").join(paths, "path", "left_anti").select("n")
    kept = scope.join(gone, "n", "left_anti").select(F.lit(0).alias("part"), F.col("n"), "line", "path", "status")
    new = paths.join(scope.where("status != 'comment'").select("path"), "path", "left_anti").select(F.lit(1).alias("part"), F.lit(0).alias("n"), F.col("path").alias("line"), "path", F.lit("active").alias("status"))
    return kept.unionByName(new).orderBy("part", "n", "path").drop("part")


def _sniffed(rule):
    @F.arrow_udf("boolean")
    def sniff(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else rule(x) for x in column.to_pylist()], pa.bool_())

    return sniff


# Bytes that count as text, for scanning and for comparing.
_CONTROLS = bytes({7, 8, 9, 10, 12, 13, 27})
_SCANNED = _CONTROLS + bytes(range(32, 127))
_COMPARED = _CONTROLS + bytes(range(32, 256))


def is_binary_for_scan(content: Column | str) -> Column:
    """A NUL or over 30 % other bytes than text in the first 1,024; empty files are text."""
    rule = lambda x: b"\0" in x or len(x.translate(None, _SCANNED)) > 0.3 * len(x)
    return _sniffed(rule)(F.substring(content, F.lit(1), F.lit(SNIFF)))


def is_binary_for_diff(content: Column | str) -> Column:
    """Any byte that isn't text in the first 1,024; bytes from 128 on are text here."""
    return _sniffed(lambda x: bool(x.translate(None, _COMPARED)))(F.substring(content, F.lit(1), F.lit(SNIFF)))


def has_nul(content: Column | str) -> Column:
    return F.contains(F.hex(content), F.lit("00")) & F.hex(content).rlike(r"\A(?:..)*?00")


def admit(tree: DataFrame, content: str = "content") -> DataFrame:
    """(path, admitted, reason, text): strict UTF-8 or a reason; a byte-order mark is dropped."""
    c = F.col(content)
    bare = F.when(F.hex(F.substring(c, 1, 3)) == "EFBBBF", F.substring(c, F.lit(4), F.lit(1 << 30))).otherwise(c)
    text = F.try_validate_utf8(bare.cast("string"))
    reason = F.when(has_nul(content), "binary").when(text.isNull(), "not UTF-8")
    return tree.select("path", reason.isNull().alias("admitted"), reason.alias("reason"), F.when(reason.isNull(), text).alias("text"))


def decode(content: Column | str) -> Column:
    """Text of UTF-8 or UTF-16 with their marks, or of plain UTF-8; null for anything else and for NULs."""
    c = F.col(content) if isinstance(content, str) else content
    head = F.hex(F.substring(c, 1, 3))
    utf16 = F.startswith(head, F.lit("FFFE")) | F.startswith(head, F.lit("FEFF"))
    utf8 = F.try_validate_utf8(F.when(head == "EFBBBF", F.substring(c, F.lit(4), F.lit(1 << 30))).otherwise(c).cast("string"))
    return F.when(utf16, F.decode(c, "UTF-16")).when(~F.contains(utf8, F.lit("\0")), utf8)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) of word lists: a word a line, lower case; blank lines and lines that start with # don't count."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~F.startswith(line, F.lit("#"))).select(F.lower(line).alias("word")).distinct()


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts of a remote feed saved as JSON: an object with a list ``artifacts``."""
    rows = elements(spark, path, "artifacts").select(F.from_json("value", "hash string, parent string, type string, ts string").alias("a"))
    return rows.select("a.hash", "a.parent", "a.type", F.col("a.ts").try_cast("timestamp").alias("ts"))
