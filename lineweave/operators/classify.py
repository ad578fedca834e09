"""What a string is: classes, scores and filters, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import each_once
from ..functions.text import INK, SPACE, bound, every_word, has_letter, strip, tokens, words

# What the rules look for.
URL_PREFIXES = ("http://", "https://", "ftp://")
SQL_PHRASES = ("SELECT ", "INSERT INTO", "UPDATE ", "DELETE FROM", "CREATE TABLE", "ALTER TABLE", "DROP TABLE")
SQL_KEYWORDS = (
    "SELECT", "INSERT", "UPDATE", "DELETE", "FROM", "WHERE", "JOIN", "VALUES", "ORDER BY", "GROUP BY", "LIMIT", "HAVING", "CREATE",
    "ALTER", "DROP", "TABLE", "DATABASE", "VIEW", "PROCEDURE", "FUNCTION", "TRIGGER", "INDEX", "UNION", "ALL", "DISTINCT",
)
STRICT_SQL_PHRASES = (" = ?", "WHERE ", "ORDER BY", "GROUP BY", "INSERT INTO", "SELECT ", "UPDATE ", "DELETE FROM")
STRICT_SQL_WORDS = ("SELECT", "FROM", "WHERE", "ORDER", "GROUP")
STRONG_SQL = ("select", "insert", "update", "delete", "create", "drop", "alter")
STRUCTURAL_SQL = ("from", "where", "join", "order", "group", "by", "limit", "values", "into", "set")
CSS_UNITS = ("px", "%", "rem", "em")
CSS_KEYWORDS = (
    "display", "flex", "block", "inline", "padding", "margin", "color", "background", "font", "border", "width", "height", "align-items",
    "justify-content", "gap", "div", "div style", "class", "style", "flex:", "background-color", "div class", "span class", "div id", "span id",
    "text-align", "display:", "position:", "top:", "left:", "right:", "bottom:", "overflow:", "z-index:", "float:", "clear:", "cursor:",
    "visibility:", "opacity:",
)
CSS_PREFIXES = ("btn", "col", "row", "container", "alert", "card", "d-", "mt-", "mb-", "pt-", "pb-", "text-", "bg-")
CLEANER_CSS_PREFIXES = ("btn", "col", "row", "container", "d-", "mt-", "mb-", "pt-", "pb-", *CSS_KEYWORDS)
STOPWORDS = ("the", "and", "is", "of", "to", "for", "with", "your", "please", "this", "that", "you")
CODE_MARKS = ("{", "}", ";", "$", "->", "::")
CODE_SIGNS = ("<?php", "?>", "<?= ", "$", "->", "::", "function(", "return ", "{", "}", ";")
CODE_WORDS = (
    "id", "uid", "uuid", "json", "xml", "html", "sql", "api", "url", "uri", "http", "https", "sha1", "sha256", "md5", "true", "false", "null",
    "int", "float", "string", "bool", "var", "let", "const", "function", "class", "return", "select", "insert", "update", "delete",
)
HTML_SIGNS = ("<div", "<span", "<button", "<table", "<tr", "<td", "<form", "<input", "class=", "style=", "id=")
FILE_ENDINGS = (".php", ".js", ".css", ".html", ".json")


class Forms:
    """A text column beside its stripped and case-folded forms, for rules that share them."""

    def __init__(self, raw: Column, bare: Column, upper: Column, lower: Column, bare_lower: Column):
        self.raw, self.bare, self.upper, self.lower, self.bare_lower = raw, bare, upper, lower, bare_lower


def with_forms(df: DataFrame, text: str = "text") -> tuple[DataFrame, Forms]:
    """``df`` with the forms of ``text`` as columns of their own, below the rules, so that each is made once and rules stay in generated code."""
    made = {"_bare": strip(text), "_upper": F.upper(text), "_lower": F.lower(text)}
    out = df.withColumns(made).withColumn("_bare_lower", F.lower("_bare"))
    return out, Forms(*(F.col(c) for c in (text, "_bare", "_upper", "_lower", "_bare_lower")))


def judged(rows: DataFrame, rules, text: str = "text") -> DataFrame:
    """``rows`` with the columns that ``rules`` makes of a text's :class:`Forms`, by name; common texts are judged once."""

    def judge(some: DataFrame) -> DataFrame:
        held, t = with_forms(some, text)
        return held.select(*some.columns, *(rule.alias(name) for name, rule in rules(t).items()))

    return each_once(rows, judge, text)


def _col(c: Column | str | Forms) -> Column:
    return c.raw if isinstance(c, Forms) else F.col(c) if isinstance(c, str) else c


def _upper(c: Column | str | Forms, rules) -> Column:
    return rules(c.upper) if isinstance(c, Forms) else bound(F.upper(_col(c)), rules)


def _lower(c: Column | str | Forms, rules) -> Column:
    return rules(c.lower) if isinstance(c, Forms) else bound(F.lower(_col(c)), rules)


def _bare(c: Column | str | Forms, rules) -> Column:
    return rules(c.bare) if isinstance(c, Forms) else bound(strip(_col(c)), rules)


def _bare_lower(c: Column | str | Forms, rules) -> Column:
    return rules(c.bare_lower) if isinstance(c, Forms) else bound(F.lower(strip(_col(c))), rules)


def contains_any(c: Column, parts: tuple[str, ...]) -> Column:
    return reduce(or_, (F.contains(c, F.lit(p)) for p in parts))


def starts_any(c: Column, parts: tuple[str, ...]) -> Column:
    return reduce(or_, (F.startswith(c, F.lit(p)) for p in parts))


def count_hits(c: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, (F.contains(c, F.lit(p)).cast("int") for p in parts), F.lit(0))


def is_url(c: Column | str) -> Column:
    """A scheme at the start, in any case; leading white space doesn't count."""
    return _col(c).rlike(rf"\A{SPACE}*+(?i:https?|ftp|mailto)://")


def string_class(c: Column | str) -> Column:
    """empty, url, sql, css, identifier, code, human or unknown: the first rule that holds."""
    raw = _col(c)

    def rules(t: Column) -> Column:
        in_upper = lambda up: contains_any(up, SQL_PHRASES) | (F.contains(t, F.lit("(")) & contains_any(up, (" FROM ", " WHERE ")))
        sql = in_upper(c.upper) if isinstance(c, Forms) else bound(F.upper(t), in_upper)
        css = t.rlike(r"\A[a-z]++(?:-[a-z0-9]++)++\z") | (F.contains(t, F.lit(" ")) & every_word(t, "[a-z]++(?:-[a-z0-9]++)*+"))
        identifier = t.rlike(r"\A[a-z][A-Za-z0-9]++\z") | (F.contains(t, F.lit("_")) & (F.lower(t) == t))
        return (
            F.when(starts_any(t, URL_PREFIXES), "url").when(sql, "sql").when(css, "css").when(identifier, "identifier")
            .when(contains_any(t, CODE_MARKS), "code").when(F.contains(t, F.lit(" ")) & has_letter(t), "human").otherwise("unknown")
        )

    # never null, so that no join has to filter it, and evaluate it again
    return F.when(raw.isNull() | (raw == ""), "empty").otherwise(F.coalesce(_bare(c, rules), F.lit("unknown")))


def is_candidate(c: Column | str) -> Column:
    """Whether a string is worth translating: human text of three characters or more, with a letter and a space."""
    t = _col(c)
    return (F.length(t) >= 3) & F.contains(t, F.lit(" ")) & has_letter(t) & (string_class(c) == "human")


def is_skipped(c: Column | str) -> Column:
    """Whether a string is certainly not for people: a technical class, a path, a call, a constant or a single word."""
    t = F.coalesce(_col(c), F.lit(""))
    sql = F.contains(t, F.lit("(")) & F.contains(t, F.lit(")")) & contains_any(F.upper(t), (" FROM ", " WHERE ", " VALUES "))
    path = contains_any(t, ("/", "\\")) | reduce(or_, (F.endswith(t, F.lit(e)) for e in (*FILE_ENDINGS, "()")))
    named = t.rlike(r"\A[a-z][A-Za-z0-9]++\z") | (F.contains(t, F.lit("_")) & (F.lower(t) == t)) | ((F.length(t) > 8) & (F.upper(t) == t))
    one_word = ~t.rlike(rf"{INK}{SPACE}++{INK}")
    return (t == "") | one_word | path | string_class(t).isin("url", "sql", "css", "identifier", "code") | sql | named


def is_binary_like(c: Column | str) -> Column:
    """Over 30 % outside printable ASCII, a NUL, or a long word that is over 40 % punctuation."""
    t = F.coalesce(_col(c), F.lit(""))
    n = F.length(t)
    odd = F.length(F.regexp_replace(t, r"[\x20-\x7e]++", ""))
    signs = F.length(F.regexp_replace(t, r"[\p{L}\p{N}]++", ""))
    return (n > 0) & ((odd > 0.3 * n) | F.contains(t, F.lit("\0")) | ((n > 20) & ~F.contains(t, F.lit(" ")) & (signs > 0.4 * n)))


def is_html_like(c: Column | str) -> Column:
    t = _col(c)
    return (F.contains(t, F.lit("<")) & F.contains(t, F.lit(">"))) | _lower(c, lambda low: contains_any(low, HTML_SIGNS))


def is_code_like(c: Column | str) -> Column:
    return contains_any(_col(c), CODE_SIGNS)


def has_constant(c: Column | str) -> Column:
    """An upper-case word with an underscore."""
    return F.exists(words(_col(c)), lambda w: F.contains(w, F.lit("_")) & (F.upper(w) == w) & (F.lower(w) != w))


def is_sql(c: Column | str) -> Column:
    """A phrase, two keywords, or a keyword with a structural sign."""
    t = _col(c)
    sign = (F.contains(t, F.lit("(")) & F.contains(t, F.lit(")"))) | contains_any(t, ("?", ":", " = ", ";"))

    def rules(up: Column) -> Column:
        # most keywords are nowhere in a text: the plain search decides before the expression is tried
        hits = reduce(lambda a, b: a + b, ((F.contains(up, F.lit(k)) & up.rlike(rf"\b{k}\b")).cast("int") for k in SQL_KEYWORDS))
        return contains_any(up, SQL_PHRASES) | (hits >= F.when(sign, 1).otherwise(2))

    return _upper(c, rules)


def is_sql_strict(c: Column | str) -> Column:
    return _upper(c, lambda up: contains_any(up, STRICT_SQL_PHRASES) | (count_hits(up, STRICT_SQL_WORDS) >= 2))


def is_sql_by_words(c: Column | str, dictionary: Column | None = None) -> Column:
    """SQL by counting dictionary tokens; without a dictionary only the phrases decide."""
    t = _col(c)
    known = F.filter(tokens(t), lambda w: F.array_contains(dictionary, w)) if dictionary is not None else F.array().cast("array<string>")
    strong = F.size(F.filter(known, lambda w: w.isin(*STRONG_SQL)))
    structural = F.size(F.filter(known, lambda w: w.isin(*STRUCTURAL_SQL)))
    both = F.contains(t, F.lit("(")) & F.contains(t, F.lit(")"))
    return ((strong >= 1) & (structural >= 1)) | ((F.size(known) >= 2) & contains_any(t, ("=", "?", "(", ")", "*", ","))) | ((strong >= 1) & both) | contains_any(F.upper(t), SQL_PHRASES)


def is_sentence(c: Column | str) -> Column:
    """Three words or more, one of them a stop word or starting with a capital."""
    t = _col(c)
    three = t.rlike(rf"{INK}{SPACE}++{INK}++{SPACE}++{INK}")
    return three & (t.rlike(rf"(?<!{INK})\p{{Lu}}") | _lower(c, lambda low: low.rlike(rf"(?<!{INK})(?:{'|'.join(STOPWORDS)})(?!{INK})")))


def is_css(c: Column | str) -> Column:

    def rules(t: Column) -> Column:
        classes = every_word(F.lower(t), "[a-z0-9-]++", 2)
        return (t != "") & (F.startswith(t, F.lit(".")) | starts_any(t, CSS_PREFIXES) | t.rlike(r"\A[a-z0-9]++(?:-[a-z0-9]++)++\z") | classes)

    return _bare(c, rules)


def is_css_like(c: Column | str) -> Column:
    """Style attributes, declarations, a unit anywhere, or two keywords."""
    t = _col(c)
    signs = F.contains(t, F.lit(":")) & F.contains(t, F.lit(";"))
    return signs | _lower(c, lambda low: contains_any(low, ("style=", *CSS_UNITS)) | (count_hits(low, CSS_KEYWORDS) >= 2))


def is_code(c: Column | str) -> Column:

    def rules(t: Column) -> Column:
        shape = (t.rlike(r"\A[A-Z0-9_]++\z") & (F.length(t) > 3)) | (t.rlike(r"\A[a-z0-9_]++\z") & F.contains(t, F.lit("_"))) | t.rlike(r"\A[a-z]++[A-Za-z0-9]*+\z")
        path = F.contains(t, F.lit("/")) & ~F.contains(t, F.lit(" "))
        return (t != "") & (F.lower(t).isin(*CODE_WORDS) | shape | F.endswith(t, F.lit("()")) | path | ((F.length(t) <= 4) & t.rlike(r"\A\p{L}++\z")))

    return _bare(c, rules)


def sql_score(c: Column | str) -> Column:
    """Weighted signs of SQL; words of a dictionary weigh 3 each, but a core dictionary has none."""
    t = _col(c)
    sign = lambda p, n: F.when(contains_any(t, (p,)), n).otherwise(0)
    both = F.when(F.contains(t, F.lit("(")) & F.contains(t, F.lit(")")), 2).otherwise(0)
    listed = F.when(F.contains(t, F.lit(",")) & F.contains(F.upper(t), F.lit(" AS ")), 2).otherwise(0)
    return both + sign("=", 1) + sign("?", 2) + listed + sign("`", 2) + sign("_", 1)


def cleaner_score(c: Column | str) -> Column:
    """How little a string looks like text for people; 3 or more is dropped."""
    t = _col(c)
    like_css = lambda low: F.startswith(low, F.lit(".")) | starts_any(low, CLEANER_CSS_PREFIXES) | low.rlike(r"\A[a-z0-9]++(?:-[a-z0-9]++)++\z") | (F.contains(low, F.lit(" ")) & every_word(low, "[a-z0-9-]++"))
    css = _bare_lower(c, like_css)
    code = t.rlike(r"\A[\p{L}_][\p{L}\p{N}_]*+\z") | (t.rlike(r"\A[A-Z0-9_]+\z") & (F.length(t) > 4)) | (t.rlike(r"\A[a-z0-9_]+\z") & F.contains(t, F.lit("_"))) | F.endswith(t, F.lit("()"))
    signs = F.length(F.regexp_replace(t, r"[\p{L}\p{N} .,!?]++", ""))
    points = [(is_sql(c), 3), (is_url(c), 3), (css, 2), (code, 2), (~F.contains(t, F.lit(" ")), 1), (F.length(t) > 80, 2), (signs > 5, 2), ((F.upper(t) == t) & (F.length(t) > 10), 2)]
    return reduce(lambda a, b: a + b, (F.when(test, n).otherwise(0) for test, n in points))


def is_human(c: Column | str) -> Column:
    t = _col(c)
    return has_letter(t) & (F.contains(t, F.lit(" ")) | t.rlike(r"\p{Ll}"))


# Filters over a dictionary (token, text): each keeps a subset of the rows.
FILTERS = {
    "sql": lambda t: ~is_sql_by_words(t),
    "css": lambda t: ~is_css(t) | is_sentence(t),
    "url": lambda t: ~starts_any(t, URL_PREFIXES),
    "code": lambda t: ~is_code(t),
}


def apply_filters(dictionary: DataFrame, names: list[str], text: str = "text") -> DataFrame:
    """The named filters in their fixed order, whatever order and case the names come in; unknown names fail."""
    wanted = {n.strip().lower() for n in names}
    if unknown := wanted - set(FILTERS):
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    for name, keep in FILTERS.items():
        if name in wanted:
            dictionary = dictionary.where(keep(F.col(text)))
    return dictionary


def clean_dictionary(dictionary: DataFrame, text: str = "text") -> DataFrame:
    """What is left without binary-like, URL, CSS-like and SQL-scored texts."""
    t = F.col(text)
    return dictionary.where(t.isNotNull() & ~is_binary_like(t) & ~is_url(t) & ~is_css_like(t) & (sql_score(t) < 4))


def clean_mapping(dictionary: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    return dictionary.where((cleaner_score(t) < 3) & is_human(t))
