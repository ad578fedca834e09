"""One document for each artifact: what it is, what it changes, who signed it, where it comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import registry
from ..operators.artifact_diff import node_type


def inspect(artifacts: DataFrame, operations: DataFrame, signatures: DataFrame, keys: DataFrame) -> DataFrame:
    """(artifact, parent, node_type, added, removed, modified, files, signatures, trusted, verified, accepted).

    ``artifacts`` has (artifact, parent), ``operations`` (artifact, file, status), ``signatures`` (artifact, key_id,
    valid). Artifacts without operations or signatures have zeros and aren't accepted.
    """
    counts = operations.groupBy("artifact").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "modified")), F.count_distinct("file").alias("files"))
    signed = registry.verify_signatures(signatures, keys).select("artifact", F.col("total").alias("signatures"), "trusted", "verified", "accepted")
    out = artifacts.join(counts, "artifact", "left").join(signed, "artifact", "left").fillna(0, ["added", "removed", "modified", "files", "signatures", "trusted"]).fillna(False, ["verified", "accepted"])
    kind = node_type(F.col("added"), F.col("removed"), F.col("modified"), F.col("parent").isNotNull())
    return out.select("artifact", "parent", kind.alias("node_type"), "added", "removed", "modified", "files", "signatures", "trusted", "verified", "accepted")
