"""Packing payloads as artifacts: their hash, their lineage out of a parent or the context, and the archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.canonical import canonical_json, canonical_text
from ..functions.shared import written
from ..operators import chains
from ..sources import archives
from .ingest import MANIFEST, PAYLOAD

_LINEAGE = "struct<type:string,lineage_id:string,parent:string>"


def manifest_json(payload_type: Column, payload_hash: Column, lineage: Column, format_: str, created_by: str, created_at: str) -> Column:
    """A manifest's canonical JSON; the time is given, so that equal inputs make equal archives."""
    meta = canonical_json(format=F.lit(format_), version=F.lit(1), created_at=F.lit(created_at), created_by=F.lit(created_by))
    digest = canonical_json(algorithm=F.lit("sha256"), value=payload_hash)
    own = canonical_json(**{name: lineage[name] for name in ("lineage_id", "parent", "type")})
    kind = F.regexp_extract(canonical_json(type=payload_type), r"(?s)\A\{(.*)\}\z", 1)
    return F.concat(F.lit('{"execution":{},"lineage":'), own, F.lit(',"meta":'), meta, F.lit(',"payload":{"hash":'), digest, F.lit(","), kind, F.lit('},"signatures":[]}'))


def with_lineage(payloads: DataFrame) -> DataFrame:
    """``payloads`` with ``payload_hash``, ``lineage`` and ``error``, which is why an artifact can't be packed.

    ``payloads`` has artifact, payload and the manifests (JSON texts or null) ``parent``, given for it, and ``context``, that of
    the artifact packed last, which counts where no parent is given; ``detached`` asks for no lineage at all. A derived
    artifact has its parent's lineage, and the parent's payload as parent.
    """
    text = canonical_text(F.col("payload"))
    rows = payloads.withColumns({"_text": text, "_given": F.coalesce("parent", "context")})
    rows = rows.withColumns({"payload_hash": F.sha2(F.col("_text").cast("binary"), 256), "_from": F.from_json("_given", schemas.MANIFEST)})
    given, lineage = F.col("_given").isNotNull(), F.col("_from.lineage")
    detached = F.coalesce("detached", F.lit(False))
    error = (
        F.when(F.col("_text").isNull(), "not JSON").when(detached & F.col("parent").isNotNull(), "both a parent and detached")
        .when(~detached & given & lineage.isNull(), "parent without lineage").when(~detached & given & (lineage.type == "detached"), "parent is detached")
        .when(~detached & given & (F.coalesce(lineage.lineage_id, F.lit("")) == ""), "parent without lineage id")
    )
    # without a lineage of its own a derived artifact would start one; the error says so before
    chosen = chains.choose_lineage(F.when(given, F.col("_from.payload.hash.value")), lineage.lineage_id, F.col("payload_hash"), detached)
    return rows.withColumns({"error": error, "lineage": F.when(error.isNull(), chosen).cast(_LINEAGE)}).drop("_given", "_from").withColumnRenamed("_text", "canonical")


def pack(payloads: DataFrame, format_: str, created_by: str, created_at: str, files: DataFrame | None = None) -> DataFrame:
    """(artifact, archive, hash, payload_hash, manifest, error): artifacts packed with their manifest and payload.

    ``payloads`` as in :func:`with_lineage`, and ``type``; ``files`` (artifact, path, content) go into the payload's folder.
    Artifacts are distinct and not null; one that can't be packed has an error and nothing else.
    """
    made = with_lineage(payloads).withColumn("manifest", F.when(F.col("error").isNull(), manifest_json(F.col("type"), F.col("payload_hash"), F.col("lineage"), format_, created_by, created_at)))
    made = written(made.select("artifact", "payload", "payload_hash", "manifest", "error"), "manifests")
    good = made.where("error is null")
    member = lambda name, c: F.struct(F.lit(name).alias("path"), F.col(c).cast("binary").alias("content"))
    members = good.select("artifact", F.inline(F.array(member(MANIFEST, "manifest"), member(PAYLOAD, "payload"))))
    if files is not None:
        members = members.unionByName(files.select("artifact", F.concat(F.lit("payload/files/"), "path").alias("path"), "content").join(good, "artifact", "left_semi"))
    return made.drop("payload").withColumn("payload_hash", F.when(F.col("error").isNull(), F.col("payload_hash"))).join(archives.pack_groups(members), "artifact", "left").select("artifact", "archive", "hash", "payload_hash", "manifest", "error")


def next_context(packed: DataFrame, artifact: Column | str = "artifact") -> DataFrame:
    """(active_lineage_id, root_hash, last_artifact, manifest): the context that each packed artifact leaves behind."""
    lineage = F.from_json("manifest", schemas.MANIFEST)["lineage"]["lineage_id"]
    return packed.where("error is null").select(lineage.alias("active_lineage_id"), lineage.alias("root_hash"), F.col(artifact).alias("last_artifact") if isinstance(artifact, str) else artifact.alias("last_artifact"), "manifest")
