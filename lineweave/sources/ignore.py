"""Ordered ignore rules: the last rule that matches a path decides.

The rules become automata over path segments. Every segment of a rule is a place; a path is read segment by segment, with
the places that may come next kept as the bits of a number. A place after ``**`` stays open; a rule that ends within the
path has matched a folder, and so what is below it. Later rules have higher bits, so the highest bit that was reached
names the deciding rule. All of it is arithmetic in column expressions; many rules fill several numbers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places in one number.
BITS = 62


@dataclass(frozen=True)
class Rule:
    """A parsed line: segment globs, whether each may skip folders before it, what it says, and whether it needs a folder."""

    globs: tuple[str, ...]
    open: tuple[bool, ...]
    ignores: bool
    folder: bool


def parse(line: str) -> Rule | None:
    """The rule of a line; None for blank lines, comments and lines that match nothing.

    ``!`` negates, a slash in front or within ties a rule to the root, one at the end asks for a folder, ``**`` stands for any
    folders; a backslash takes the meaning of what follows. White space at the end goes unless it is escaped.
    """
    text = re.sub(r"(?<!\\)((?:\\\\)*)[ \t\r\n]+\Z", r"\1", line.rstrip("\r\n"))
    if not text.strip() or text.startswith("#") or text == "/":
        return None
    ignores = not text.startswith("!")
    text = text if ignores else text[1:]
    folder = text.endswith("/")
    parts = [p for p in text.strip("/").split("/") if p]
    if not parts:
        return None
    tied = text.startswith("/") or len(parts) > 1
    globs, opened, gap = [], [], not tied
    for part in parts:
        if part == "**":
            gap = True
            continue
        globs.append(part)
        opened.append(gap)
        gap = False
    if gap and parts[-1] == "**":  # everything below
        globs.append("*")
        opened.append(False)
    if len(globs) > BITS:
        raise ValueError(f"more than {BITS} segments: {line!r}")
    return Rule(tuple(globs), tuple(opened), ignores, folder)


def segment_pattern(glob: str) -> str:
    """A glob over one path segment as a regular expression."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2 + (glob[i + 1 : i + 2] in "!^" and glob[i + 1 : i + 2] != "")) if c == "[" else -1
        if c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        elif c == "*":
            out.append(".*")
            while glob[i + 1 : i + 2] == "*":
                i += 1
        elif c == "?":
            out.append(".")
        elif close > 0:
            inside = glob[i + 1 : close]
            negated = inside[0] in "!^"
            body = re.sub(r"([\\\[\]&^])", r"\\\1", inside[1:] if negated else inside)
            out.append(f"[{'^' if negated else ''}{body}]")
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return rf"(?s)\A{''.join(out)}\z"


def _literal(glob: str) -> bool:
    return not re.search(r"[*?\[\\]", glob)


def _groups(rules: list[Rule]) -> list[list[Rule]]:
    groups: list[list[Rule]] = [[]]
    for rule in rules:
        if sum(len(r.globs) for r in groups[-1]) + len(rule.globs) > BITS:
            groups.append([])
        groups[-1].append(rule)
    return groups


def _mask(bits) -> int:
    return reduce(lambda a, b: a | b, (1 << b for b in bits), 0)


def _reached(path: Column, rules: list[Rule]) -> Column:
    """The last places of rules that a path comes to, as bits."""
    start, opened, ends, folders, places = 0, 0, 0, 0, {}
    at = 0
    for rule in rules:
        for k, (glob, is_open) in enumerate(zip(rule.globs, rule.open, strict=True)):
            places.setdefault(glob, []).append(at + k)
            opened |= is_open << (at + k)
        start |= 1 << at
        at += len(rule.globs)
        ends |= 1 << (at - 1)
        folders |= rule.folder << (at - 1)
    lit = lambda n: F.lit(n).cast("long")
    both = lambda a, b: a.bitwiseAND(b)
    literals = {g: _mask(b) for g, b in places.items() if _literal(g)}
    globs = {g: _mask(b) for g, b in places.items() if not _literal(g)}
    named = F.create_map(*(x for g, m in literals.items() for x in (F.lit(g), lit(m)))) if literals else None

    def fits(segment: Column) -> Column:
        """Places whose glob the segment fits."""
        known = F.coalesce(F.try_element_at(named, segment), lit(0)) if named is not None else lit(0)
        return reduce(lambda a, b: a.bitwiseOR(b), (F.when(segment.rlike(segment_pattern(g)), lit(m)).otherwise(lit(0)) for g, m in globs.items()), known)

    segments = F.split(path, "/")
    steps = F.transform(segments, lambda s, i: F.struct(fits(s).alias("fits"), (i + 1 == F.size(segments)).alias("last")))
    begin = F.struct(lit(start).alias("next"), lit(0).alias("found"))

    def step(state: Column, s: Column) -> Column:
        hit = both(state["next"], s["fits"])
        # a rule's last place leads to no other rule's first
        onward = both(F.shiftleft(both(hit, lit(~ends & (1 << BITS) - 1)), 1).bitwiseOR(both(state["next"], lit(opened))), lit((1 << BITS) - 1))
        done = both(hit, F.when(s["last"], lit(ends & ~folders)).otherwise(lit(ends)))
        return F.struct(onward.alias("next"), state["found"].bitwiseOR(done).alias("found"))

    return F.aggregate(steps, begin, step)["found"]


def decides(path: Column | str, lines: list[str]) -> Column:
    """true where the last matching rule ignores the path, false where it is negated, null where no rule matches.

    Paths are relative, with slashes. A folder that is ignored doesn't bind the rules after it: a negated rule brings a
    file of it back. Null paths match nothing.
    """
    path = F.col(path) if isinstance(path, str) else path
    rules = [r for r in map(parse, lines) if r]
    answers = []
    for group in _groups(rules) if rules else []:
        found = _reached(path, group)
        top = F.length(F.bin(found)).cast("int")  # the highest bit, counted from 1
        ends, at = {}, 0
        for rule in group:
            at += len(rule.globs)
            ends[at] = rule.ignores
        says = F.create_map(*(x for n, v in ends.items() for x in (F.lit(n), F.lit(v))))
        answers.append(F.when(found > 0, F.try_element_at(says, top)))
    return F.coalesce(*reversed(answers)) if answers else F.lit(None).cast("boolean")


def read_rules(spark: SparkSession, path: str) -> list[str]:
    """The lines of an ignore file, in order; a file that holds a project's rules is small."""
    return [line for (text,) in spark.read.text(path, wholetext=True).collect() for line in text.splitlines()]


def filesystem_scope(tree: DataFrame, lines: list[str]) -> DataFrame:
    """Files of a tree (path, ...) that the rules leave, in order of paths."""
    return tree.where(~F.coalesce(decides("path", lines), F.lit(False))).orderBy("path")


def project_files(tree: DataFrame, lines: list[str], defaults: list[str], context: str, never: str) -> DataFrame:
    """A project's files, in order of paths: what neither the defaults nor its own rules ignore, and all of the context folder.

    Defaults and rules decide apart, so a project can't take a default back. Files that end in ``never`` are left out, but
    for those of the context folder, which must be there: :func:`has_context` tells.
    """
    kept = [~F.coalesce(decides("path", some), F.lit(False)) for some in (defaults, lines)]
    usual = kept[0] & kept[1] & ~F.endswith("path", F.lit(never))
    return tree.where(F.startswith("path", F.lit(context.rstrip("/") + "/")) | usual).orderBy("path")


def has_context(tree: DataFrame, context: str) -> DataFrame:
    """One row: whether the tree has a file in the context folder."""
    return tree.agg(F.coalesce(F.bool_or(F.startswith("path", F.lit(context.rstrip("/") + "/"))), F.lit(False)).alias("there"))
