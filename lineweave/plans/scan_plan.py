"""From lines to a plan: scan, dictionary, cleaning, substitution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify, detect, dictionary
from ..sinks import plan_columns


def generate(text_lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Plan changes for (file, line_no, line): every literal for people becomes a reference to its token.

    Without a ``known`` dictionary (token, text), one is built from the findings and cleaned.
    """
    found = detect.findings(text_lines, "file")
    # order of appearance: by file and line
    seen = found.withColumn("ord", F.struct("file", "line_no", "n"))
    words = known if known is not None else classify.clean_dictionary(dictionary.build(seen.where(F.col("type") == "HUMAN")))
    changes = dictionary.substitute(text_lines, words)
    return plan_columns(changes.select("file", F.col("line_no").alias("line"), "original", "replacement", "token"))


def scan_artifact(text_lines: DataFrame) -> DataFrame:
    """Findings in the shape of a scan artifact: type, file, line, text, detector, severity."""
    found = detect.findings(text_lines, "file")
    return found.select("type", "file", F.col("line_no").alias("line"), "text", F.lit("hardcoded-string").alias("detector"), F.lit("warn").alias("severity"))
