"""Checks of documents: each gives an array of what is wrong, empty if nothing is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chains import lineage_errors

# What a diff may say.
STATUSES = ("added", "removed", "modified", "reconciled")
CHANGE_TYPES = ("insert", "delete", "replace")
FORMATS = {"scan": "obad", "goals": "goal-discovery", "specs": "spec-discovery"}


def _errors(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(True)), text) for test, text in rules)))


def diff_errors(path: str = "path", status: str = "status", changes: str = "changes") -> Column:
    """For a file of a diff: its path, status and changes, each with type, lines and both texts."""
    c = F.col(changes)
    whole = F.forall(c, lambda x: x.type.isin(*CHANGE_TYPES) & x.start_line.isNotNull() & x.end_line.isNotNull() & x.before.isNotNull() & x.after.isNotNull())
    return _errors((F.col(path).isNull(), "missing path"), (~F.col(status).isin(*STATUSES), "unknown status"), (c.isNull(), "missing changes"), (c.isNotNull() & ~whole, "malformed change"))


def manifest_errors(meta: str = "meta", payload: str = "payload", lineage: str = "lineage", formats: tuple[str, ...] = ("dex", "xdex")) -> Column:
    """For a manifest: format and version, payload with a SHA-256, lineage by its type's rules."""
    own = _errors(
        (~F.col(f"{meta}.format").isin(*formats), "unknown format"), (F.col(f"{meta}.version").isNull(), "missing version"), (F.col(f"{meta}.created_at").try_cast("timestamp").isNull(), "no creation time"),
        (F.col(f"{payload}.type").isNull(), "missing payload type"), (F.col(f"{payload}.hash.algorithm") != "sha256", "unknown hash"), (~F.col(f"{payload}.hash.value").rlike(r"\A[0-9a-f]{64}\z"), "malformed hash"),
    )
    return F.concat(own, lineage_errors(F.col(f"{lineage}.type"), F.col(f"{lineage}.lineage_id"), F.col(f"{lineage}.parent")))


def plan_meta_errors(meta: str = "meta") -> Column:
    m = lambda f: F.coalesce(F.col(f"{meta}.{f}"), F.lit(""))
    return _errors((F.col(meta).isNull(), "missing meta"), (m("tool") == "", "missing tool"), (m("version") == "", "missing version"), (m("generated_at").try_cast("timestamp").isNull(), "generated_at is no time"))


def artifact_errors(kind: str, format_: str = "format", items: str = "items") -> Column:
    """For a scan, goal or specification artifact: its format, and that it lists something, if only nothing."""
    return _errors((F.col(format_) != FORMATS[kind], "unknown format"), (F.col(items).isNull(), "missing list"))


def accepted(rows: DataFrame, errors: str = "errors", by: str = "artifact") -> DataFrame:
    """(by, ok, errors): an artifact is taken only if none of its rows has an error; all or nothing."""
    return rows.groupBy(by).agg(F.every(F.size(errors) == 0).alias("ok"), F.sum(F.size(errors)).alias("errors"))
