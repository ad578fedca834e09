"""Dictionaries of token and text: building, merging, substitution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import written
from ..functions.text import normal_key, strip


def build(texts: DataFrame, text: str = "text", order: str = "ord") -> DataFrame:
    """(token, text): one token for each distinct text, in order of first appearance.

    Texts that share a key get suffixes _2, _3, ... A suffixed key that is another text's own key is passed over:
    the next free number is taken.
    """
    # texts and keys are sorted by their hashes first: numbers are told apart faster than long strings that begin alike
    first = texts.where(F.col(text).isNotNull()).groupBy(F.xxhash64(text).alias("hash"), F.col(text).alias("text")).agg(F.min(order).alias("first"))
    keyed = first.withColumn("key", normal_key("text"))
    # read four times
    ranked = written(keyed.select("text", "key", F.row_number().over(Window.partitionBy(F.xxhash64("key"), "key").orderBy("first", "text")).alias("n")), "ranked")
    natural = ranked.where("n = 1").select(F.col("key").alias("token"))
    want = ranked.where("n > 1").withColumn("token", F.concat_ws("_", "key", "n"))
    # suffixes up to the number of texts of a key plus the natural keys that have its shape are enough
    taken = natural.withColumn("key", F.regexp_extract("token", r"\A(.*)_([0-9]+)\z", 1)).withColumn("k", F.regexp_extract("token", r"\A(.*)_([0-9]+)\z", 2).try_cast("int"))
    blocked = taken.where(F.col("k") > 1).groupBy("key").agg(F.sort_array(F.collect_set("k")).alias("ks"))
    moved = want.join(blocked, "key", "left")
    shift = F.aggregate(F.coalesce("ks", F.array().cast("array<int>")), F.col("n"), lambda n, k: F.when(k <= n, n + 1).otherwise(n))
    suffixed = moved.select(F.concat_ws("_", "key", shift).alias("token"), "text")
    return ranked.where("n = 1").select(F.col("key").alias("token"), "text").unionByName(suffixed)


def merge(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Both dictionaries; where they share a token, the base's text stays."""
    return base.unionByName(extra.join(base, "token", "left_anti"))


def last_wins(rows: DataFrame, order: str = "ord") -> DataFrame:
    """(token, text) from rows as imported: stripped, empty tokens dropped, the last text of a token."""
    bare = rows.select(F.trim("token").alias("token"), F.trim("text").alias("text"), order).where("token != ''")
    return bare.groupBy("token").agg(F.max_by("text", order).alias("text"))


def substitute(text_lines: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(file, line_no, original, replacement, token) of lines with a quoted dictionary text.

    Literals are cut out of the line and joined by equality, so that no line is tried against every text. Several
    literals of a line are replaced from left to right, and ``token`` is the first one's.
    """
    literal = F.regexp_extract_all("line", F.lit("\"([^\"]*)\"|'([^']*)'"), F.lit(0))
    spots = text_lines.select("file", "line_no", "line", F.posexplode(literal).alias("n", "quoted")).withColumn("text", F.expr("substring(quoted, 2, length(quoted) - 2)"))
    # sorted by hashes first, as in build
    hashed = lambda df: df.withColumn("_hash", F.xxhash64("text"))
    found = hashed(spots).join(hashed(dictionary), ["_hash", "text"])
    hits = found.groupBy(F.xxhash64("file", "line_no").alias("_line"), "file", "line_no", "line").agg(F.array_sort(F.collect_list(F.struct("n", "quoted", "token"))).alias("hits"))
    swap = F.aggregate("hits", F.col("line"), lambda line, h: F.replace(line, h["quoted"], F.concat(F.lit('messages["'), h["token"], F.lit('"]'))))
    return hits.select("file", "line_no", F.col("line").alias("original"), swap.alias("replacement"), F.col("hits")[0]["token"].alias("token"))


# Where a literal may be replaced by a call, in order, with the group of its text.
CALLS = ((r"""print\((["'])(.+?)\1\)""", 2), (r"""raise\s+(\w+)\((["'])(.+?)\2\)""", 3), (r"""logging\.(info|warning|error|debug)\((["'])(.+?)\2\)""", 3))


def substitute_calls(text_lines: DataFrame, dictionary: DataFrame, call: str = "t") -> DataFrame:
    """(file, line_no, original, replacement, token): lines that print, raise or log a text of the dictionary, which becomes a call.

    The first of the three forms whose first place in the line has such a text decides, and all its quoted places in the
    line are replaced. Texts of the dictionary (token, text) are distinct.
    """
    found = F.array(*(F.struct(F.lit(n).alias("n"), F.regexp_extract("line", pattern, group).alias("text")) for n, (pattern, group) in enumerate(CALLS)))
    spots = text_lines.select("file", "line_no", "line", F.explode(F.filter(found, lambda x: x["text"] != "")).alias("f")).select("file", "line_no", "line", "f.*")
    hits = spots.join(dictionary.select("text", "token"), "text").groupBy("file", "line_no", "line").agg(F.min_by(F.struct("text", "token"), "n").alias("h"))
    made = F.concat(F.lit(f'{call}("'), F.col("h.token"), F.lit('")'))
    quoted = lambda q: F.concat(F.lit(q), F.col("h.text"), F.lit(q))
    return hits.select("file", "line_no", F.col("line").alias("original"), F.replace(F.replace("line", quoted('"'), made), quoted("'"), made).alias("replacement"), "h.token")


def read_csv(spark, path: str) -> DataFrame:
    """(token, text) of an edited dictionary in CSV with columns token and text: stripped, the last text of a token.

    Rows count in the order of the files' names, and in a file from top to bottom; rows without a token are dropped.
    """
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    raw = raw.toDF(*(c.lstrip("\ufeff").strip() for c in raw.columns))
    text = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    # a file of several lines a row is read by one task, in order
    rows = raw.select(text("token").alias("token"), text("text").alias("text"), F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n")).alias("ord"))
    return last_wins(rows)
