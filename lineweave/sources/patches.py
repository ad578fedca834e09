"""Patches and version-control listings as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A listing's letters, and the link form of a stored plan.
LETTERS = {"A": "added", "M": "modified", "D": "removed", "R": "renamed"}
LINK = r"\Adfp://v1/forge/([0-9a-fA-F]{64})/?\z"


def parse_patch(lines: DataFrame, patch: str = "patch") -> DataFrame:
    """(patch, path, status, start_line, end_line, type, before, after): the change blocks of unified diffs.

    ``lines`` has (patch, n, line). A block is a run of removed and added lines between unchanged ones; an insertion
    takes the line that it stands before. Files without a block give one row without one.
    """
    by = Window.partitionBy(patch).orderBy("n")
    line = F.col("line")
    head, hunk = F.startswith(line, F.lit("diff --git ")), F.startswith(line, F.lit("@@ "))
    rows = lines.withColumns({"file_no": F.count_if(head).over(by), "hunk_no": F.count_if(hunk).over(by)}).where("file_no > 0")
    in_file = Window.partitionBy(patch, "file_no")
    # a file's hunks start after its header: lines such as --- and +++ come before the first
    seen = F.count_if(hunk).over(in_file.orderBy("n"))
    status = F.when(F.bool_or(F.startswith(line, F.lit("new file mode"))).over(in_file), "added").when(F.bool_or(F.startswith(line, F.lit("deleted file mode"))).over(in_file), "removed").otherwise("modified")
    path = F.max(F.when(head, F.regexp_extract(line, r"\Adiff --git a/(\S+)", 1))).over(in_file)
    rows = rows.withColumns({"seen": seen, "status": status, "path": path})
    sign = F.when(F.col("seen") == 0, None).when(hunk | head, None).when(F.substring(line, 1, 1).isin("-", "+", " "), F.substring(line, 1, 1))
    first = F.max(F.when(hunk, F.regexp_extract(line, r"\A@@ -([0-9]+)", 1).cast("int"))).over(Window.partitionBy(patch, "hunk_no"))
    body = rows.withColumns({"sign": sign, "first": first}).where("sign is not null")
    in_hunk = Window.partitionBy(patch, "hunk_no").orderBy("n")
    old = F.count_if(F.col("sign") != "+").over(in_hunk.rowsBetween(Window.unboundedPreceding, -1))
    island = F.count_if(F.col("sign") == " ").over(in_hunk)
    changed = body.withColumns({"old_line": F.col("first") + old, "island": island}).where("sign != ' '")
    text = F.expr("substring(line, 2)")
    listed = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("sign") == s, F.struct("n", text.alias("t"))))), lambda x: x.t)
    blocks = changed.groupBy(patch, "file_no", "hunk_no", "island").agg(F.min("old_line").cast("int").alias("start_line"), listed("-").alias("before"), listed("+").alias("after"))
    kind = F.when(F.size("before") == 0, "insert").when(F.size("after") == 0, "delete").otherwise("replace")
    blocks = blocks.withColumns({"type": kind, "end_line": F.col("start_line") + F.greatest(F.size("before") - 1, F.lit(0))})
    files = rows.where(head).select(patch, "file_no", "path", "status")
    return files.join(blocks, [patch, "file_no"], "left").select(patch, "path", "status", "start_line", "end_line", "type", "before", "after")


def changed_files(numstat: DataFrame, name_status: DataFrame) -> DataFrame:
    """(path, binary, status) from the lines (line) of two listings; a binary file has dashes for its counts."""
    parts = F.split("line", "\t")
    counts = numstat.where(F.size(parts) == 3).select(parts[2].alias("path"), ((parts[0] == "-") & (parts[1] == "-")).alias("binary"))
    letters = F.create_map(*(F.lit(x) for pair in LETTERS.items() for x in pair))
    named = name_status.where(F.size(parts) >= 2).select(F.element_at(parts, -1).alias("path"), F.coalesce(F.try_element_at(letters, F.substring(parts[0], 1, 1)), F.lit("modified")).alias("status"))
    return counts.join(named, "path", "full_outer").select("path", F.coalesce("binary", F.lit(False)).alias("binary"), "status")


def binary_entries(tree: DataFrame) -> DataFrame:
    """(path, kind, size, sha256) of binary files (path, content)."""
    return tree.select("path", F.lit("binary").alias("kind"), F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def plan_hash_of_link(link: Column | str) -> Column:
    """The plan's hash in a link; null if it isn't one."""
    return F.nullif(F.regexp_extract(link, LINK, 1), F.lit(""))


def link_of_plan(plan_hash: Column | str, link: str = LINK) -> Column:
    """The link of a plan's hash, which has 64 lower-case hex digits; null for anything else."""
    c = F.col(plan_hash) if isinstance(plan_hash, str) else plan_hash
    return F.when(c.rlike(r"\A[a-f0-9]{64}\z"), F.concat(F.lit(link.split("(")[0].removeprefix(r"\A")), c))


def strict_hash_of_link(link: Column | str, pattern: str = LINK) -> Column:
    """The plan's hash in a link exactly as :func:`link_of_plan` makes it; null if it isn't one."""
    c = F.col(link) if isinstance(link, str) else link
    found = plan_hash_of_link(c)
    return F.when(c == link_of_plan(found, pattern), found)


def link_parts(link: Column | str) -> Column:
    """A link's scheme, host and path, and the values of ``hash`` (null without one) and ``v`` (1 without one) in its query."""
    c = F.col(link) if isinstance(link, str) else link
    part = lambda pattern: F.coalesce(F.regexp_extract(c, pattern, 1), F.lit(""))
    query = lambda name: F.nullif(F.try_url_decode(F.regexp_extract(part(r"\A[^?#]*\?([^#]*)"), rf"(?:\A|&){name}=([^&]+)", 1)), F.lit(""))
    return F.struct(
        F.lower(part(r"\A([A-Za-z][A-Za-z0-9+.-]*):")).alias("scheme"), part(r"\A(?:[^:/?#]+:)?//([^/?#]*)").alias("host"), part(r"\A(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)").alias("path"),
        query("hash").alias("hash"), F.coalesce(query("v"), F.lit("1")).alias("version"),
    )
