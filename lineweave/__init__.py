"""Change-integrity analytics as composable Spark DataFrame operators."""
