"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base patterns find emails, IP addresses, cards and phone numbers; words that look like digests are possible secrets.
These are seeds: the words before them are lexical patterns, and patterns and the identifiers that they introduce
form a graph. A pattern is as reliable for a kind as the identifiers that it introduces, an identifier as its best
pattern; the two are scored in turns until neither the reliable patterns nor the reliable identifiers grow. Added are
identifiers that no base pattern covers, have the kind's shape and stand after a reliable pattern: a secret's seed
alone is not enough.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns. Possessive repeats and the look-behinds change no match: they stop the search from
# trying again inside a run that has failed, or from recursing once for each repeat.
_STARTS = r"(?:(?<![%s])|\G)"
PATTERNS = {
    "email": _STARTS % "A-Za-z0-9._%+-" + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _STARTS % "0-9" + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    #: Any word with a digit or an at sign, with groups of digits after it: what a pattern may introduce.
    "word": r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [0-9()-]++(?!\S))*+",
}
_NEEDS = {"email": "@", "phone": "+"}
#: What is added beside the base kinds, and in which order spans are listed.
SECRET = "secret"
LISTED = (*KINDS, SECRET)
#: Characters of the text before a match that its patterns are read from.
CONTEXT = 64
#: A pattern needs so many different reliable identifiers, and patterns and identifiers this reliability.
SUPPORT, RELIABLE = 5, 0.8
#: More rounds than this mean that something is wrong: scores only grow.
MOST_ROUNDS = 100
#: How identifiers of a kind may look, without the punctuation around them.
_SHAPES = {
    "email": r"\A[^@\s]+@[^@\s]+\z", "ip": r"\A[0-9]+(?:[.:][0-9]+){3,}\z", "card": r"\A[0-9][0-9 -]{11,}\z", "phone": r"\A[+(]?[0-9](?:[ ().-]{0,2}+[0-9]){6,}\z",
    SECRET: r"\A(?=[^A-Za-z]*[A-Za-z])(?=[^0-9]*[0-9])[A-Za-z0-9_.+/=-]{16,}\z",
}
#: A secret's seed: a digest of 32 hex digits or more.
_DIGEST = r"\A(?=[^A-Fa-f]*[A-Fa-f])(?=[^0-9]*[0-9])[0-9A-Fa-f]{32,}\z"
#: An identifier among the words of a pattern.
_OTHER = "<#>"


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        # a part without its leading zeros has at most three digits, so the cast can't fail
        parts = F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, F.concat(F.lit("0"), p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        # from the right, every second digit is doubled; two-digit products count their digits' sum
        figures = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
        luhn = F.aggregate(figures, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
        return F.when(F.length(digits).between(16, 19), luhn % 10 == 0).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def matches(df: DataFrame, text: str = "text") -> DataFrame:
    """(key, kind, start, end, match, before) of every pattern match in every distinct text; ``key`` is its md5.

    Offsets are code points. A text's pieces between matches give them as a running sum, so no text travels.
    """
    t = F.col("t")
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    cases = []
    for kind, pattern in PATTERNS.items():
        worth = F.contains(t, F.lit(_NEEDS[kind])) if kind in _NEEDS else t.rlike("[0-9@]")
        gaps = F.split(t, pattern, -1)
        pair = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("match"), F.concat(F.array(F.lit(None).cast("string")), gaps).alias("ahead"))
        cases.append(F.struct(F.lit(kind).alias("kind"), F.when(worth, pair).alias("pieces")))
    found = rows.where(t.rlike("[0-9@]")).select(F.md5("t").alias("key"), F.explode(F.array(*cases)).alias("c")).select("key", "c.kind", F.posexplode("c.pieces").alias("n", "piece"))
    short = found.where(F.col("piece.match").isNotNull()).select("key", "kind", "n", F.length("piece.gap").alias("gap"), F.col("piece.match").alias("match"), F.right(F.concat_ws(f" {_OTHER} ", "piece.ahead", "piece.gap"), F.lit(CONTEXT)).alias("before"))
    once = short.groupBy("key", "kind", "n").agg(F.first("gap").alias("gap"), F.first("match").alias("match"), F.first("before").alias("before"))
    order = Window.partitionBy("key", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(order)
    return once.withColumn("end", end).select("key", "kind", (F.col("end") - F.length("match")).alias("start"), "end", "match", "before")


def base_spans(found: DataFrame) -> DataFrame:
    """The matches that pass their kind's check."""
    tests = reduce(lambda c, k: c.when(F.col("kind") == k, _valid(k, F.col("match"))), KINDS[1:], F.when(F.col("kind") == KINDS[0], _valid(KINDS[0], F.col("match"))))
    return found.where(F.col("kind").isin(*KINDS)).where(F.coalesce(tests, F.lit(False)))


def _trimmed(words: DataFrame) -> DataFrame:
    """Words without the punctuation around them."""
    bare = F.regexp_replace("match", r"\A[^A-Za-z0-9+(]+|[^A-Za-z0-9]+\z", "")
    lead = F.length(F.regexp_extract("match", r"\A[^A-Za-z0-9+(]+", 0))
    out = words.withColumn("bare", bare).withColumn("start", F.col("start") + lead).where("bare != ''")
    return out.withColumn("end", F.col("start") + F.length("bare")).withColumn("match", F.col("bare")).drop("bare")


def _patterns(rows: DataFrame) -> DataFrame:
    """A row for each lexical pattern before a match: the last word, and the last two. Identifiers among them are all alike."""
    same = F.transform(F.split(F.lower("before"), r"\s+"), lambda w: F.when(w.rlike("[0-9@]"), _OTHER).otherwise(w))
    words = F.filter(same, lambda w: w.rlike(r"[\p{L}=:#]"))
    last = F.col("words")
    made = F.array(F.when(F.size(last) > 0, F.element_at(last, -1)), F.when(F.size(last) > 1, F.concat_ws(" ", F.slice(last, -2, 2))))
    return rows.withColumn("words", words).withColumn("pattern", F.explode(F.array_compact(made))).where(F.col("pattern").rlike(r"[\p{L}=:]")).drop("words", "before")


def extend(base: DataFrame, words: DataFrame) -> DataFrame:
    """Spans (key, kind, start, end) of unseen identifiers among ``words`` that reliable patterns introduce."""
    spots = base.select("key", "start", "end", F.lit(True).alias("seed"), F.col("match"), "before").unionByName(_trimmed(words).select("key", "start", "end", F.lit(False).alias("seed"), "match", "before"))
    by = Window.partitionBy("key").orderBy("start", F.desc("seed"))
    ahead = F.max(F.when(F.col("seed"), F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(F.col("seed"), F.col("start"))).over(by.rowsBetween(1, Window.unboundedFollowing))
    free = spots.withColumn("ahead", ahead).withColumn("behind", behind).where("not seed and coalesce(ahead <= start, true) and coalesce(behind >= end, true)")
    unseen = cut(_patterns(free.select("key", "start", "end", "match", "before")), "unseen")
    digests = unseen.where(F.col("match").rlike(_DIGEST)).select(F.lit(SECRET).alias("kind"), "match", "pattern")
    led_seeds = _patterns(base.select("kind", "match", "before")).select("kind", "match", "pattern").unionByName(digests)
    seeds = cut(led_seeds.groupBy("pattern", "match", "kind").agg(F.count("*").alias("n")), "seeds")
    of_base = seeds.where(F.col("kind") != SECRET).select("pattern", "match", "n")
    edges = cut(of_base.unionByName(unseen.groupBy("pattern", "match").agg(F.count("*").alias("n"))).groupBy("pattern", "match").agg(F.sum("n").alias("n")), "edges")
    totals = cut(edges.groupBy("pattern").agg(F.sum("n").alias("total")), "totals")
    known = cut(seeds.select("match", "kind").distinct().withColumn("score", F.lit(1.0)), "known")
    score, grown = known, None
    for _ in range(MOST_ROUNDS):
        led = edges.join(score, "match").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("good"), F.count_if(F.col("score") >= RELIABLE).alias("support"))
        rated = led.join(totals, "pattern").withColumn("trust", F.col("good") / (F.col("total") + 0.5))
        strong = cut(rated.where((F.col("support") >= SUPPORT) & (F.col("trust") >= RELIABLE)).select("pattern", "kind", "trust"), "patterns")
        met = unseen.select("pattern", "match").distinct().join(strong, "pattern").where(_shaped())
        news = cut(met.groupBy("match", "kind").agg(F.max("trust").alias("score")), "news")
        score = known.unionByName(news).groupBy("match", "kind").agg(F.max("score").alias("score"))
        before, grown = grown, (strong.count(), news.where(F.col("score") >= RELIABLE).count())
        if before == grown:
            break
    else:
        raise RuntimeError(f"patterns still grow after {MOST_ROUNDS} rounds")
    sure = news.where(F.col("score") >= RELIABLE).select("match", "kind")
    hits = unseen.join(strong, "pattern").where(_shaped()).join(sure, ["match", "kind"], "left_semi")
    ranked = hits.groupBy("key", "start", "end").agg(F.max_by("kind", F.struct("trust", "kind")).alias("kind"))
    return ranked.select("key", "kind", "start", "end")


def _shaped() -> Column:
    return reduce(lambda c, k: c | ((F.col("kind") == k) & F.col("match").rlike(_SHAPES[k])), LISTED, F.lit(False))


def find(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(base spans, added spans) by ``key``, the md5 of a distinct text."""
    found = cut(matches(df, text), "matches")
    base = cut(base_spans(found), "base")
    added = extend(base, found.where("kind = 'word'"))
    return base.select("key", "kind", "start", "end"), added


def _listed(name: str) -> Column:
    rank = F.array_position(F.array(*map(F.lit, LISTED)), F.col("kind"))
    line = F.concat_ws(":", "kind", "start", "end")
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(name), F.struct(rank.alias("r"), F.col("start").alias("s"), line.alias("l"))))), lambda x: x.l), ",")


def report(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``df``: id, the number of base spans of each kind, ``base_sha256``, ``spans`` and ``n_added``.

    Null texts count as empty: no spans, the hash of the empty list. Ids may be null or repeat. Equal texts are
    examined once. Base spans always stay; added spans never overlap one.
    """
    base, added = find(df, text)
    both = base.withColumn("base", F.lit(True)).unionByName(added.withColumn("base", F.lit(False))).withColumn("all", F.lit(True))
    counts = [F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in KINDS]
    by_text = both.groupBy("key").agg(*counts, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("all").alias("spans"), F.count_if(~F.col("base")).alias("n_added"))
    by_text = cut(by_text, "spans")  # the join below then deals out both sides itself, and can split a text with many copies
    rows = df.select(F.col(id_col), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("key"))
    out = rows.join(by_text, "key", "left")
    return out.select(id_col, *(F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS), F.coalesce("base_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_added", F.lit(0).cast("long")).alias("n_added"))


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span in ``text`` replaced by its kind in angle brackets; other texts stay as they are.

    Spans of different kinds that overlap are masked as one, under the kind that starts first.
    """
    base, added = find(df, text)
    spans = base.unionByName(added)
    order = Window.partitionBy("key").orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("island", F.sum(F.when(F.coalesce(reach > F.col("start"), F.lit(False)), 0).otherwise(1)).over(order))
    merged = spans.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"), "kind")).alias("kind"))
    order = Window.partitionBy("key").orderBy("start")
    pieces = merged.withColumn("from", F.coalesce(F.lag("end").over(order), F.lit(0)))
    lists = pieces.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "from", "kind"))).alias("cuts"))
    t = F.col(f"d.`{text}`")
    joined = df.alias("d").select(F.struct(*(F.col(f"d.`{c}`") for c in df.columns)).alias("d"), F.md5(F.coalesce(F.col(f"d.`{text}`"), F.lit(""))).alias("key")).join(lists, "key", "left")
    parts = F.transform("cuts", lambda c: F.concat(F.substring(t, c["from"] + 1, c["start"] - c["from"]), F.lit("<"), c["kind"], F.lit(">")))
    rest = F.substring(t, F.element_at("cuts", -1)["end"] + 1, F.lit(2147483647))
    done = F.when(F.col("cuts").isNull(), t).otherwise(F.concat(F.array_join(parts, ""), rest))
    return joined.select(*((done if c == text else F.col(f"d.`{c}`")).alias(c) for c in df.columns))
