"""Goals from findings, and specifications from goals, through rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Which goals a finding's type suggests, and what each goal requires.
GOAL_RULES = {"HUMAN": ["INTERNATIONALIZE_STRINGS"], "SQL": ["EXTRACT_CONSTANTS"], "URL": ["EXTERNALIZE_CONFIGURATION"], "UNKNOWN": ["MANUAL_REVIEW_REQUIRED"]}
SPEC_RULES = {
    "INTERNATIONALIZE_STRINGS": ["Extract human-readable strings", "Create translation keys", "Externalize messages"],
    "EXTRACT_CONSTANTS": ["Replace repeated literals with constants"],
    "EXTERNALIZE_CONFIGURATION": ["Move URLs into configuration"],
    "MANUAL_REVIEW_REQUIRED": ["Review unknown observations"],
}


def _rules(spark: SparkSession, rules: dict, key: str, value: str) -> DataFrame:
    """A rule table of literals, made without a Python worker; it has a fixed handful of rows, so that joins broadcast it."""
    rows = [F.struct(F.lit(k).alias(key), F.lit(n).alias("n"), F.lit(v).alias(value)) for k, values in rules.items() for n, v in enumerate(values)]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*rows))))


def discover_goals(found: DataFrame, rules: dict = GOAL_RULES) -> DataFrame:
    """(goal, source_type, count, confidence) from findings with a ``type``; types without a rule count for nothing."""
    per_type = found.groupBy(F.col("type").alias("source_type")).agg(F.count("*").alias("count"))
    goals = per_type.join(_rules(found.sparkSession, rules, "source_type", "goal"), "source_type")
    return goals.groupBy("goal", "source_type").agg(F.sum("count").alias("count"), F.lit(1.0).alias("confidence"))


def discover_specs(goals: DataFrame, rules: dict = SPEC_RULES) -> DataFrame:
    """(intent, requirements, source_type, count): goals without a rule give no specification."""
    table = _rules(goals.sparkSession, rules, "intent", "requirement")
    joined = goals.withColumnRenamed("goal", "intent").join(table, "intent")
    lists = joined.groupBy("intent", "source_type", "count").agg(F.array_sort(F.collect_list(F.struct("n", "requirement"))).alias("r"))
    return lists.select("intent", F.transform("r", lambda x: x.requirement).alias("requirements"), "source_type", "count")
