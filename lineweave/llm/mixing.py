"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

Documents are counted into cells of source, language and topic. Raking scales the cells' token weights to one
marginal after the other until all three fit; a document is then kept with its cell's weight over its tokens, so
that the kept tokens have the target shares in expectation. Cells are many fewer than documents, and stay tables.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MARGINS = ("source", "lang", "topic")
#: A margin's target share of a category is its share of tokens to this power: 1 keeps the mix, 0 levels it.
POWER = 0.9
ROUNDS = 12
#: A category with a smaller share of the tokens doesn't set the scale of the rates: its documents are kept whole instead.
SMALL = 0.001
#: Rounds of raking between two written tables.
STEP = 4
#: A margin further off its target than this is reported.
POOR_FIT = 0.01

_log = logging.getLogger(__name__)


def tokens(text: str = "text") -> Column:
    """Words between ASCII white space; null and empty: none."""
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def topic(text: str = "text") -> Column:
    """A coarse topic read off the whole text: what it shows, in this order of rules."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (
        F.when(F.contains(t, F.lit("!!")), "shout").when(F.contains(t, F.lit(" | ")), "table").when(t.rlike("[0-9]"), "facts")
        .when(F.contains(t, F.lit("\n")), "essay").otherwise("note")
    )


def draw(key: str = "doc_id", seed: str = "mix") -> Column:
    """A number in [0, 1) that depends on the key alone; a null key draws as the empty text."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rake(cells: DataFrame, power: float = POWER, rounds: int = ROUNDS, margins: tuple[str, ...] = MARGINS) -> DataFrame:
    """Cells (margins, ``tokens``) with ``weight``: token shares that fit every margin's target.

    Targets are the margin's token shares to ``power``, scaled to sum to 1. Cells without tokens weigh nothing.
    """
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for m in margins:
        sums = cells.groupBy(F.col(m).alias("_m")).agg(F.sum("tokens").cast("double").alias("t"))
        raised = sums.withColumn("t", F.when(F.col("t") > 0, F.pow("t", F.lit(power))).otherwise(F.lit(0.0)))
        total = raised.agg(F.sum("t")).first()[0] or 1.0
        out = out.join(raised.select("_m", (F.col("t") / F.lit(total)).alias(f"goal_{m}")), F.col(m).eqNullSafe(F.col("_m")), "left").drop("_m")
    out = cut(out, "cells")
    for turn in range(rounds):
        for m in margins:
            own = F.sum("weight").over(Window.partitionBy(m))  # cells, not documents: a margin's category has few
            out = out.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"goal_{m}"), own), F.lit(0.0)))
        if turn % STEP == STEP - 1 or turn == rounds - 1:
            out = cut(out, "cells")
    rest = residual(out, margins)
    if rest > POOR_FIT:
        _log.warning("after %d rounds a margin is %.4f off its target", rounds, rest)
    return out


def residual(cells: DataFrame, margins: tuple[str, ...] = MARGINS) -> float:
    """The largest distance of a margin's weight from its target, of cells as :func:`rake` returns them."""
    worst = 0.0
    for m in margins:
        off = cells.groupBy(m, f"goal_{m}").agg(F.sum("weight").alias("w")).agg(F.max(F.abs(F.col("w") - F.col(f"goal_{m}")))).first()[0]
        worst = max(worst, off or 0.0)
    return worst


def plan(rows: DataFrame, power: float = POWER, rounds: int = ROUNDS) -> DataFrame:
    """(margins, ``weight``, ``rate``) of each cell of rows (margins, tokens).

    Rates are scaled so that the cell that is scarcest against its weight keeps all its documents. Cells of a source,
    language or topic with less than ``SMALL`` of the tokens don't set that scale, else one stray document would thin
    out all others: where they would need more than all their documents, they keep all. If every cell is one of
    these, all set the scale.
    """
    cells = cut(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "cells")
    raked = rake(cells, power, rounds)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    rare = [F.sum("tokens").over(Window.partitionBy(m)) < F.lit(SMALL * total) for m in MARGINS]
    over = raked.withColumns({"over": F.try_divide("weight", F.col("tokens").cast("double")), "rare": rare[0] | rare[1] | rare[2]})
    common, every = over.agg(F.max(F.when(~F.col("rare"), F.col("over"))), F.max("over")).first()
    most = common or every or 1.0
    return over.select(*MARGINS, "weight", F.coalesce(F.least(F.col("over") / F.lit(most), F.lit(1.0)), F.lit(1.0)).alias("rate"))


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", power: float = POWER, rounds: int = ROUNDS) -> DataFrame:
    """(``row``, margins, ``tokens``, ``weight``, ``rate``, ``draw``, ``chosen``) for every row of ``df``, which is in ``row``.

    A document is chosen when its draw is below its cell's rate. Null sources and languages are categories of
    their own. Documents without tokens cost nothing and are chosen at their cell's rate, 1 if it has no tokens.
    Repeated rows have one draw and stay or go together.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    rows = df.select(whole, F.col("source"), F.col("lang"), topic(text).alias("topic"), tokens(text).alias("tokens"), draw(id_col).alias("draw"))
    # the plan reads no texts: they aren't shuffled for it
    cells = plan(df.select("source", "lang", topic(text).alias("topic"), tokens(text).alias("tokens")), power, rounds)
    named = cells.select(*(F.col(m).alias(f"_{m}") for m in MARGINS), "weight", "rate")
    same = [F.col(m).eqNullSafe(F.col(f"_{m}")) for m in MARGINS]
    out = rows.join(named, same[0] & same[1] & same[2], "left")
    return out.select("row", *MARGINS, "tokens", "weight", "rate", "draw", (F.col("draw") < F.col("rate")).alias("chosen"))
