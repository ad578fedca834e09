"""Rules that look texts up in word lists of any size.

Lists are joined, not held in a column or a task. Before a text's tokens are shuffled, those that can't be in the list are
dropped by a broadcast table of the list's hash buckets, which has a million rows at most whatever the list. Of the rest,
tokens that stand in over a thousandth of all rows, a thousand at most, are joined by broadcast, the others by a
shuffle in which no key is hot. What has to be searched for inside tokens is searched once for all texts that have the token.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import each_once, written
from ..functions.text import tokens
from . import classify

#: A key is hot if it is more than one in so many rows; there are fewer hot keys than that.
HOT = 1000
#: Hash buckets by which tokens that can't be in a list are told: a broadcast has no more rows.
BUCKETS = 1 << 20
#: Letters of a run without white space that are searched at once.
RUN = 1000
#: The score of a text with two words of a list, whatever else it has.
DROPPED = 999


def keyed(rows: DataFrame, text: str = "text") -> DataFrame:
    """(row, whole, text) of all rows, written once: a row's number must not change between its uses."""
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("whole")
    held = written(rows.select(F.monotonically_increasing_id().alias("row"), whole), "texts")
    return held.select("row", "whole", F.coalesce(F.col(f"whole.`{text}`"), F.lit("")).alias("text"))


def _possible(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """The rows of ``many`` whose key shares its hash bucket with one of ``few``."""
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("_bucket")
    buckets = few.select(bucket).distinct()  # no more than there are buckets
    return many.select("*", bucket).join(F.broadcast(buckets), "_bucket", "left_semi").drop("_bucket")


def join_hot(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``many`` joined with ``few``, whose keys are distinct: hot keys of ``many`` by broadcast, others by shuffle."""
    counts = many.groupBy(key).agg(F.count("*").alias("n"))
    total = many.agg(F.count("*").alias("total"))
    hot = written(counts.join(F.broadcast(total), F.col("n") * HOT > F.col("total")).select(key), "hot")
    often, seldom = many.join(F.broadcast(hot), key, "left_semi"), many.join(F.broadcast(hot), key, "left_anti")
    return often.join(F.broadcast(few.join(F.broadcast(hot), key, "left_semi")), key).unionByName(seldom.join(few, key))


def token_counts(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(row, total, strong, structural): how many word-like tokens of a text (row, text) are in the list (word), and of which kind."""
    listed = written(words.select(F.lower("word").alias("token")).where("token is not null").distinct(), "listed")
    said = _possible(texts.select("row", F.explode(tokens(F.col("text"))).alias("token")), listed, "token")
    found = join_hot(written(said.groupBy("row", "token").agg(F.count("*").alias("times")), "tokens"), listed, "token")
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("token").isin(*kind), F.col("times"))), F.lit(0))
    return found.groupBy("row").agg(F.sum("times").alias("total"), count(classify.STRONG_SQL).alias("strong"), count(classify.STRUCTURAL_SQL).alias("structural"))


def contained_words(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(row, word): which words of the list (word) stand anywhere in a text (row, text), in whatever case, each once.

    A word is looked for by its longest part without white space, within the distinct runs of the table, so that a run is
    searched once however many texts have it: its stretches of the lengths that parts have are joined with the parts. Words
    with white space are then looked for in the text itself. Empty words are in no text.
    """
    upper = words.select(F.upper("word").alias("word")).where("word is not null").distinct()
    parts = F.filter(F.split("word", r"\s+"), lambda p: p != "")
    longest = F.element_at(F.array_sort(F.transform(parts, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("part")))), 1)
    pieces = written(upper.where(F.size(parts) > 0).select("word", longest["part"].alias("part"), (F.size(F.split("word", r"\s")) > 1).alias("spaced")), "pieces")
    one = F.lit(1).alias("one")
    lengths = pieces.agg(F.array_sort(F.collect_set(F.length("part"))).alias("lengths")).where(F.size("lengths") > 0).select("lengths", one)  # one row, as many as a word has letters
    said = texts.select("row", F.explode(F.array_distinct(F.filter(F.split(F.translate(F.upper("text"), "\t\n\x0b\f\r", " " * 5), " "), lambda p: p != ""))).alias("run"), one)
    # a long run is searched in windows, each with so much of the next one that no word is cut
    begin = F.sequence(F.lit(0), F.floor((F.length("run") - 1) / RUN).cast("int"))
    window = lambda k: F.substring(F.col("run"), k * RUN + 1, F.lit(RUN - 1) + F.element_at("lengths", -1))
    runs = said.join(F.broadcast(lengths), "one").select("row", F.explode(F.array_distinct(F.transform(begin, window))).alias("run"))
    places = lambda n: F.when(F.length("run") >= n, F.transform(F.sequence(F.lit(1), F.length("run") - n + 1), lambda at: F.substring(F.col("run"), at, n))).otherwise(F.array().cast("array<string>"))
    cut = runs.select("run").distinct().select("run", one).join(F.broadcast(lengths), "one").select("run", F.explode(F.array_distinct(F.flatten(F.transform("lengths", places)))).alias("part"))
    inside = _possible(cut, pieces, "part").join(pieces, "part").select("run", "word", "spaced").distinct()
    # the words of a run: as many as it has stretches at most
    by_run = written(inside.groupBy("run").agg(F.collect_list(F.struct("word", "spaced")).alias("found")), "inside")
    hits = join_hot(written(_possible(runs, by_run, "run"), "runs"), by_run, "run").select("row", F.explode("found").alias("f")).select("row", "f.*")
    plain = hits.where("not spaced").select("row", "word")
    spaced = hits.where("spaced").select("row", "word").distinct().join(texts.select("row", F.upper("text").alias("text")), "row").where(F.contains("text", F.col("word")))
    return plain.unionByName(spaced.select("row", "word")).distinct()


def contained_counts(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(row, hits): how many words of the list stand in a text."""
    return contained_words(texts, words).groupBy("row").agg(F.count("*").alias("hits"))


_SQL_SIGNS = ("_both", "_signs", "_phrase")


def _with(texts: DataFrame, counts: DataFrame, needs: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """The rows of ``texts`` with columns made of counts and of what the texts say by themselves (``needs``), which is found before the join."""
    t = F.col("text")
    both, signs = F.contains(t, F.lit("(")) & F.contains(t, F.lit(")")), classify.contains_any(t, ("=", "?", "(", ")", "*", ","))
    own = {"_both": both, "_signs": signs, "_phrase": classify.contains_any(F.upper(t), classify.SQL_PHRASES), "_sql": classify.sql_score(t), "_clean": classify.cleaner_score(t)}
    alone = texts.select("row", "whole", *(own[n].alias(n) for n in needs))
    numbers = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts.columns if c != "row"]
    joined = alone.join(counts, "row", "left").select("whole", *needs, *numbers)
    return joined.select("whole.*", *(v.alias(k) for k, v in columns.items()))


def _is_sql() -> Column:
    c = F.col
    return ((c("strong") >= 1) & (c("structural") >= 1)) | ((c("total") >= 2) & c("_signs")) | ((c("strong") >= 1) & c("_both")) | c("_phrase")


def _sql_score() -> Column:
    return F.col("hits") * 3 + F.col("_sql")


def _cleaner_score() -> Column:
    return F.when(F.col("hits") >= 2, DROPPED).otherwise(F.when(F.col("hits") == 1, 2).otherwise(0) + F.col("_clean"))


def with_sql_flag(rows: DataFrame, words: DataFrame, text: str = "text", name: str = "is_sql") -> DataFrame:
    """``rows`` and whether a text is SQL by the list's tokens.

    A strong and a structural word; two words and a sign of SQL; a strong word and both parentheses; or a phrase. Null texts
    are not. ``rows`` keep their columns, null and repeated rows too; a column called ``name`` must not be there.
    """
    texts = keyed(rows, text)
    return _with(texts, token_counts(texts, words), _SQL_SIGNS, **{name: _is_sql()})


def with_sql_score(rows: DataFrame, words: DataFrame, text: str = "text", name: str = "sql_score") -> DataFrame:
    """``rows`` and the weighted signs of SQL: 3 for each word of the list in the text, and those of the text alone."""
    texts = keyed(rows, text)
    return _with(texts, contained_counts(texts, words), ("_sql",), **{name: _sql_score()})


def with_scores(rows: DataFrame, words: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``is_sql``, ``sql_score`` and ``score`` as the three functions beside give them, the texts written once for all."""

    def judge(some: DataFrame) -> DataFrame:
        texts = keyed(some, text)
        counts = token_counts(texts, words).join(contained_counts(texts, words), "row", "full")
        return _with(texts, counts, (*_SQL_SIGNS, "_sql", "_clean"), is_sql=_is_sql(), sql_score=_sql_score(), score=_cleaner_score())

    return each_once(rows, judge, text)


def with_constant_flag(rows: DataFrame, words: DataFrame, text: str = "text", name: str = "has_word") -> DataFrame:
    """``rows`` and whether a word of the list that has an underscore stands in the text."""
    texts = keyed(rows, text)
    return _with(texts, contained_counts(texts, words.where(F.contains("word", F.lit("_")))), **{name: F.col("hits") > 0})


def with_cleaner_score(rows: DataFrame, words: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
    """``rows`` and how little a text looks like one for people: two words of the list are 999, one is 2 more."""
    texts = keyed(rows, text)
    return _with(texts, contained_counts(texts, words), ("_clean",), **{name: _cleaner_score()})


def clean_mapping(dictionary: DataFrame, words: DataFrame, text: str = "text") -> DataFrame:
    """Rows of a dictionary with a score below 3 that are text for people; null and empty texts go."""
    return with_cleaner_score(dictionary, words, text, "_score").where((F.col("_score") < 3) & classify.is_human(text)).drop("_score")


def clean_dictionary(dictionary: DataFrame, words: DataFrame, text: str = "text") -> DataFrame:
    """What is left of a dictionary without binary-like, URL, CSS-like and SQL-scored texts."""
    t = F.col(text)
    kept = dictionary.where(t.isNotNull() & reduce(lambda a, b: a & b, (~rule(t) for rule in (classify.is_binary_like, classify.is_url, classify.is_css_like))))
    # a listed word with an underscore weighs 3 by its kind too, but is over the mark with its 3 and the underscore's 1
    return with_sql_score(kept, words, text, "_score").where(F.col("_score") < 4).drop("_score")
