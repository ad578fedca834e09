"""Line, white-space and key functions on text columns."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode text processing sees it; spelt out, because engines disagree on ``\s``.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
#: The same characters one by one, for trimming.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: One character that is no white space.
INK = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
#: Everything that ends a line.
LINE_END = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}](?:(?<=\r)\n)?+"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends, Unicode spaces included."""
    return F.btrim(_column(c), F.lit(SPACES))


def bound(c: Column, f) -> Column:
    """``f`` of a column that is evaluated once, however often ``f`` uses it: branches of a CASE share nothing else."""
    return F.get(F.transform(F.array(c), f), 0)


def every_word(c: Column | str, pattern: str, least: int = 1) -> Column:
    """Whether stripped text has ``least`` (1 or 2) words or more, each of the possessive ``pattern``: one pass, no list of words."""
    again = "++" if least > 1 else "*+"
    return _column(c).rlike(rf"\A{pattern}(?:{SPACE}++{pattern}){again}\z")


def words(c: Column | str) -> Column:
    """Parts between white space; none for blank text."""
    bare = strip(c)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, rf"{SPACE}+"))


def has_letter(c: Column | str) -> Column:
    return _column(c).rlike(r"\p{L}")


def split_lines(c: Column | str) -> Column:
    """Lines without their ends; a final line end starts no further line, empty text has no line."""
    return bound(F.split(_column(c), LINE_END, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ``line_no`` from 1, ``line``)."""
    return df.select(key, F.posexplode(split_lines(text)).alias("n", "line")).select(key, (F.col("n") + 1).alias("line_no"), "line")


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer parts than the cluster has cores, dealt to all of them; larger scans stay as they are.

    A file of one row group is read by one task, and rules on its texts would all run there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def nfc(c: Column | str) -> Column:
    """Unicode NFC; Spark has no such function, so this one goes through Arrow where the text isn't ASCII."""

    @F.arrow_udf("string")
    def normal(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in column.to_pylist()], pa.string())

    return normal(_column(c))


def normal_line(c: Column | str) -> Column:
    """NFC with every line end as a line feed."""
    return nfc(F.regexp_replace(_column(c), "\r\n|\r", "\n"))


def normal_key(c: Column | str) -> Column:
    """A dictionary key: no punctuation, white space runs as underscores, upper case."""
    bare = strip(F.regexp_replace(_column(c), r"[^\p{L}\p{M}\p{N}_\t-\r\x1c-\x20\x85\p{Z}]", ""))
    return F.upper(F.regexp_replace(bare, rf"{SPACE}+", "_"))


def line_column(text: Column | str, offset: Column | str) -> tuple[Column, Column]:
    """Line and column, from 1, of a code-point offset from 0."""
    before = F.substring(_column(text), F.lit(1), _column(offset))
    newline = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    last = F.regexp_extract(before, r"[^\n]*\z", 0)
    return newline + 1, F.length(last) + 1


def tokens(c: Column | str) -> Column:
    """Runs of ASCII letters and underscores, lower case."""
    return F.regexp_extract_all(F.lower(_column(c)), F.lit("[a-z_]+"), F.lit(0))


def module_name(path: Column | str) -> Column:
    """Dotted module name of a Python source path; a package's is its folder's."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(_column(path), r"\\", "/"), r"^(?:\./)?(?:src/)?", ""), r"\.py$", "")
    return F.replace(F.regexp_replace(bare, r"/__init__$", ""), F.lit("/"), F.lit("."))
