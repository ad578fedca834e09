"""Artifact registry: search, feeds, storage by content, trust and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import ascii_json, canonical_json

PAGE, FEED = 20, 100


def search(artifacts: DataFrame, type_: str | None = None, prefix: str | None = None, limit: int = PAGE, offset: int = 0, ts: str = "ts", digest: str = "hash") -> DataFrame:
    """A page of artifacts, newest first, equal times by hash; filters are pushed down to the scan."""
    out = artifacts
    if type_ is not None:
        out = out.where(F.col("type") == type_)
    if prefix is not None:
        out = out.where(F.startswith(digest, F.lit(prefix)))
    return out.orderBy(F.desc(ts), digest).offset(offset).limit(limit)


def feed(artifacts: DataFrame, since=None, after: str = "", limit: int = FEED, ts: str = "ts", digest: str = "hash") -> DataFrame:
    """The next page of a feed after the cursor (time, hash): artifacts of one time are never skipped at a page's edge."""
    out = artifacts
    if since is not None:
        out = out.where((F.col(ts) > F.lit(since)) | ((F.col(ts) == F.lit(since)) & (F.col(digest) > after)))
    return out.orderBy(ts, digest).limit(limit)


def feed_from(artifacts: DataFrame, cursor: DataFrame, limit: int = FEED, ts: str = "ts", digest: str = "hash") -> DataFrame:
    """:func:`feed` after a cursor that is a table of one row at most (ts, hash); without a row no page."""
    at = F.broadcast(cursor.select(F.col(ts).alias("_ts"), F.col(digest).alias("_hash")).limit(1))  # one row
    later = (F.col(ts) > F.col("_ts")) | ((F.col(ts) == F.col("_ts")) & (F.col(digest) > F.col("_hash")))
    return artifacts.join(at, later).drop("_ts", "_hash").orderBy(ts, digest).limit(limit)


def not_yet_known(remote: DataFrame, local: DataFrame, digest: str = "hash") -> DataFrame:
    """What the remote has and the local side lacks: what to pull; swap the sides for what to push."""
    return remote.join(local.select(digest).distinct(), digest, "left_anti")


def insert_new(stored: DataFrame, offered: DataFrame, digest: str = "hash", order: str = "ord") -> DataFrame:
    """The store after an insert that ignores hashes it has; of equal hashes offered the first is taken."""
    first = offered.groupBy(digest).agg(F.min_by(F.struct(*(c for c in offered.columns if c != digest)), order).alias("r")).select(digest, "r.*")
    return stored.unionByName(not_yet_known(first.select(*stored.columns), stored, digest))


def with_origin(artifacts: DataFrame, registries: DataFrame) -> DataFrame:
    """Artifacts and the name of the registry that they come from, local where none is known."""
    return artifacts.join(registries.select("registry", F.col("name").alias("_name")), "registry", "left").withColumn("origin", F.coalesce("_name", F.lit("local"))).drop("_name")


def trusted(signatures: DataFrame, keys: DataFrame, key: str = "key_id") -> DataFrame:
    """Signatures with ``trusted``: whether their key is in the trust store."""
    known = keys.select(key).distinct().withColumn("_known", F.lit(True))
    return signatures.join(known, key, "left").withColumn("trusted", F.coalesce("_known", F.lit(False))).drop("_known")


def only_trusted(signatures: DataFrame, keys: DataFrame, key: str = "key_id") -> DataFrame:
    return signatures.join(keys.select(key), key, "left_semi")


def identity_status(stated: Column, derived: Column, legacy: Column) -> Column:
    """canonical if the stated key id is the one derived from the public key, legacy if an older form, else anonymous."""
    return F.when(stated.isNotNull() & (stated == derived), "canonical").when(stated.isNotNull() & (stated == legacy), "legacy").otherwise("anonymous")


def verify_signatures(signatures: DataFrame, keys: DataFrame, by: str = "artifact", strict: bool = True) -> DataFrame:
    """(by, total, valid, invalid, trusted, verified, accepted) from signatures whose ``valid`` is known.

    Verified: there are signatures and all are valid. Strict acceptance asks for a valid one of a trusted key,
    otherwise a valid one is enough.
    """
    rows = trusted(signatures, keys)
    counts = rows.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("valid") & F.col("trusted")).alias("trusted")
    )
    return counts.withColumns({"verified": (F.col("total") > 0) & (F.col("invalid") == 0), "accepted": (F.col("trusted") if strict else F.col("valid")) > 0})


def upsert(keys: DataFrame, news: DataFrame, key: str = "key_id") -> DataFrame:
    """Keys after an insert-or-replace."""
    return news.unionByName(keys.join(news.select(key), key, "left_anti"))


def ingestion_errors(limits: dict[str, int]) -> Column:
    """The stages that an archive (header_ok, entries, bytes, packed_bytes, unsafe_paths, manifest_ok, hash, stated_hash) fails."""
    ratio = F.try_divide(F.col("bytes").cast("double"), "packed_bytes")
    rules = [
        (~F.col("header_ok"), "header"),
        (F.col("entries") > limits["entries"], "too many entries"),
        (F.col("bytes") > limits["bytes"], "too large"),
        ((ratio > limits["ratio"]) & (F.col("bytes") > limits["ratio_floor"]), "suspicious ratio"),
        (F.col("unsafe_paths") > 0, "unsafe path"),
        (~F.col("manifest_ok"), "manifest"),
        (~F.col("hash").eqNullSafe(F.col("stated_hash")), "payload hash"),
    ]
    return F.array_compact(F.array(*(F.when(test, text) for test, text in rules)))


# What an archive may hold.
LIMITS = {"entries": 10_000, "bytes": 128 << 20, "ratio": 1_000, "ratio_floor": 1 << 20}


def signed_subset(manifests: DataFrame) -> Column:
    """The canonical JSON of what a signature binds: the payload's type and hash, execution, lineage, and regions if there are any.

    Characters outside ASCII are escaped, as signers write them.
    """
    fields = {"payload_hash_algorithm": F.col("payload.hash.algorithm"), "payload_hash_value": F.col("payload.hash.value"), "payload_type": F.col("payload.type"), "execution": F.col("execution"), "lineage": F.col("lineage")}
    plain = canonical_json(**fields)
    if "regions" in manifests.columns:
        plain = F.when(F.col("regions").isNull(), plain).otherwise(canonical_json(**fields, regions=F.col("regions")))
    return ascii_json(plain)


def bundle(plans: DataFrame, plan: str = "plan") -> DataFrame:
    """Plans (canonical JSON) with ``hash``, sha256: and the hash of the plan, and ``bundle``, the JSON that carries both.

    Bundles hold no time, so that equal plans make equal bundles; keys are sorted.
    """
    digest = F.concat(F.lit("sha256:"), F.sha2(F.col(plan).cast("binary"), 256))
    whole = F.concat(F.lit('{"hash":"'), digest, F.lit('","plan":'), F.col(plan), F.lit(',"version":"1.0"}'))
    return plans.withColumns({"hash": digest, "bundle": whole})


def key_count(keys: DataFrame) -> DataFrame:
    """One row: the number of keys in the store."""
    return keys.agg(F.count("*").alias("keys"))


def latest(files: DataFrame, by: str, modified: str = "modified") -> DataFrame:
    """The file changed last for each ``by``; of equal times the largest path."""
    rest = F.struct(*(c for c in files.columns if c != by))
    return files.groupBy(by).agg(F.max_by(rest, F.struct(modified, "path")).alias("r")).select(by, "r.*")
