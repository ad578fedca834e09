"""Ingestion of packed artifacts from their bytes, in stages that each read only what the one before admitted.

Header, decompression, structure, manifest, payload, signatures: whatever fails goes to a quarantine table with the stage
and the reason, and nothing of it is stored. Archives are unpacked as a stream, whose bytes are counted as they come: one
that grows past its limit is given up there, whatever its header says. Members are written to the shared folder in
pieces, so no task holds an unpacked archive.
"""

from __future__ import annotations

import tarfile
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.canonical import canonical_text, shard_path
from ..functions.shared import written
from ..operators import registry, validation

STAGES = ("header", "decompression", "structure", "manifest", "payload", "signature")
#: Bytes of a piece of a member; also how much is unpacked at once.
PIECE = 1 << 20
LIMITS = {**registry.LIMITS, "packed": 64 << 20, "manifest": 1 << 20, "payload": 32 << 20}
# What an archive holds, and how signatures are made.
MANIFEST, PAYLOAD, FOLDERS = "manifest.json", "payload/plan.json", ("payload/", "signatures/")
ALGORITHMS = ("ed25519",)

_PIECES = "artifact {}, member string, piece int, content binary, stage string, reason string, bytes long"


@dataclass
class Ingested:
    """What became of a delivery: admitted artifacts, rejected ones, and the payloads to store."""

    admitted: DataFrame
    quarantine: DataFrame
    payloads: DataFrame


class Refused(Exception):
    def __init__(self, stage: str, reason: str):
        super().__init__(stage, reason)


class _Unpacked:
    """The bytes of a gzip stream, counted as they are read; refuses to go past a limit."""

    def __init__(self, raw: bytes, limits: dict[str, int]):
        self.rest, self.size, self.limits = memoryview(raw), len(raw), limits
        self.stream, self.held, self.total = zlib.decompressobj(31), bytearray(), 0
        self.last, self.given = b"", 0

    def _next(self) -> bytes:
        """Packed bytes to go on with; where a stream ends, another may follow, as in archives packed in chunks."""
        if self.stream.eof:
            left = self.stream.unused_data or self.rest[:PIECE]
            if self.stream.unused_data:
                self.stream = zlib.decompressobj(31)
                return left
            if not left:
                return b""
            self.stream = zlib.decompressobj(31)
        elif self.stream.unconsumed_tail:
            return self.stream.unconsumed_tail
        left, self.rest = self.rest[:PIECE], self.rest[PIECE:]
        if not left:
            raise Refused("decompression", "truncated")
        return left

    def read(self, size: int) -> bytes:
        while len(self.held) < size:
            left = self._next()
            if not left:
                break
            try:
                more = self.stream.decompress(left, PIECE)
            except zlib.error as error:
                raise Refused("decompression", "unreadable") from error
            self.total += len(more)
            if self.total > self.limits["bytes"]:
                raise Refused("decompression", "too large")
            if self.total > self.limits["ratio_floor"] and self.total > self.limits["ratio"] * self.size:
                raise Refused("decompression", "suspicious ratio")
            self.held += more
        self.last = bytes(self.held[:size])
        del self.held[:size]
        self.given += len(self.last)
        return self.last

    def finish(self, at: int) -> None:
        """Nothing but zeros may follow an archive that ends before byte ``at``, some of which has been read by now."""
        more = self.last[len(self.last) - (self.given - at) :] if self.given > at else b""
        while True:
            if more.strip(b"\0"):
                raise Refused("structure", "more than one archive")
            if not (more := self.read(PIECE)):
                return


def _allowed(member: tarfile.TarInfo, seen: set[str]) -> None:
    name = member.name
    if name.startswith("/") or ".." in name.split("/"):
        raise Refused("structure", "unsafe path")
    if member.type not in (tarfile.REGTYPE, tarfile.AREGTYPE):
        raise Refused("structure", "not a regular file")
    if name != MANIFEST and not name.startswith(FOLDERS):
        raise Refused("structure", "unknown entry")
    if name in seen:
        raise Refused("structure", "repeated entry")


def pieces(raw: bytes, limits: dict[str, int]):
    """(member, piece, content) of an archive's members, in order, a piece at a time; raises :class:`Refused`.

    An archive without members is fine here: it lacks a manifest.
    """
    stream, seen = _Unpacked(raw, limits), set()
    try:
        with tarfile.open(fileobj=stream, mode="r|", bufsize=PIECE) as tar:
            for member in tar:
                if len(seen) >= limits["entries"]:
                    raise Refused("structure", "too many entries")
                _allowed(member, seen)
                seen.add(member.name)
                content, n = tar.extractfile(member), 0
                while (part := content.read(PIECE)) or not n:
                    yield member.name, n, part
                    n += 1
                tar.members = []  # a stream's members are not asked for again
            end = tar.fileobj.tell()
    except (tarfile.TarError, EOFError, ValueError) as error:
        raise Refused("structure", "unreadable") from error
    stream.finish(end)


def _unpack(limits: dict[str, int]):
    names = ("artifact", "member", "piece", "content", "stage", "reason", "bytes")

    def rows(batch: pa.RecordBatch):
        for at in range(batch.num_rows):
            artifact, raw = batch.column("artifact")[at].as_py(), batch.column("content")[at].as_py()
            total = 0
            try:
                for member, n, content in pieces(raw, limits):
                    total += len(content)
                    yield artifact, member, n, content, None, None, None
                yield artifact, None, None, None, "unpacked", None, total
            except Refused as refused:
                yield artifact, None, None, None, *refused.args, None

    def unpack(batches):
        for batch in batches:
            types = (batch.schema.field("artifact").type, pa.string(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.int64())
            held, size = [], 0
            for row in rows(batch):
                held.append(row)
                size += len(row[3] or b"") + 100
                if size >= PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    return unpack


def _header(content: Column, limits: dict[str, int]) -> Column:
    gzip = F.hex(F.substring(content, F.lit(1), F.lit(3))) == "1F8B08"
    return F.when(content.isNull(), "no content").when(F.octet_length(content) > limits["packed"], "too large").when(~gzip, "no gzip header")


def _whole(parts: DataFrame) -> DataFrame:
    """(artifact, member, content) from pieces."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("piece", "content"))), lambda p: p.content)
    return parts.groupBy("artifact", "member").agg(F.aggregate(ordered, F.lit(b""), lambda a, b: F.concat(a, b)).alias("content"))


def _text(content: str) -> Column:
    return F.try_validate_utf8(F.col(content).cast("string"))


def _manifests(members: DataFrame, whole: DataFrame, limits: dict[str, int], formats: tuple[str, ...]) -> DataFrame:
    """(artifact, reason, payload): what the manifests of all unpacked archives say, or why they are refused."""
    parts = members.where(F.col("member") == MANIFEST)
    size = parts.groupBy("artifact").agg(F.sum(F.octet_length("content")).alias("size"))
    small = parts.join(size.where(F.col("size") <= limits["manifest"]), "artifact", "left_semi")
    said = size.join(_whole(small).select("artifact", _text("content").alias("text")), "artifact", "left")
    # a manifest that isn't an object of these fields has nulls, which the checks find
    seen = whole.select("artifact").join(said, "artifact", "left").withColumn("m", F.from_json("text", schemas.MANIFEST))
    checks = seen.select("artifact", "size", "text", "m.*")
    wrong = validation.manifest_errors(formats=formats)
    reason = F.when(F.col("size").isNull(), "no manifest").when(F.col("size") > limits["manifest"], "manifest too large").when(F.col("meta").isNull(), "not a manifest").when(F.size(wrong) > 0, F.array_join(wrong, ", "))
    return checks.select("artifact", reason.alias("reason"), F.col("payload.type").alias("payload_type"), F.col("payload.hash.value").alias("stated"))


def _payloads(members: DataFrame, manifests: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(artifact, reason, payload_hash, payload) of the archives with a good manifest."""
    parts = members.where(F.col("member") == PAYLOAD)
    size = parts.groupBy("artifact").agg(F.sum(F.octet_length("content")).alias("size"))
    small = parts.join(size.where(F.col("size") <= limits["payload"]), "artifact", "left_semi")
    texts = _whole(small).select("artifact", canonical_text(_text("content")).alias("payload"))
    seen = manifests.where("reason is null").join(size, "artifact", "left").join(texts, "artifact", "left").withColumn("payload_hash", F.sha2(F.col("payload").cast("binary"), 256))
    reason = F.when(F.col("size").isNull(), "no payload").when(F.col("size") > limits["payload"], "payload too large").when(F.col("payload").isNull(), "not JSON").when(F.col("payload_hash") != F.col("stated"), "payload hash")
    return seen.select("artifact", reason.alias("reason"), "payload_type", "payload_hash", "payload")


def _signatures(members: DataFrame, payloads: DataFrame, keys: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(artifact, signatures, faults, trusted, signature_set_hash) of the archives with a good payload; without signatures no row."""
    parts = members.where(F.startswith("member", F.lit(FOLDERS[1]))).join(payloads.where("reason is null"), "artifact", "left_semi")
    made = _whole(parts).select("artifact", F.sha2("content", 256).alias("signature"), F.from_json(_text("content"), "algorithm string, key_id string").alias("s")).select("artifact", "signature", "s.*")
    known = keys.select("key_id").distinct().withColumn("known", F.lit(True))
    told = verdicts.groupBy("signature").agg(F.bool_and("valid").alias("valid"))
    checked = made.join(known, "key_id", "left").join(told, "signature", "left")
    fault = F.when(~F.coalesce(F.col("algorithm").isin(*ALGORITHMS), F.lit(False)), "unsupported algorithm").when(F.col("known").isNull(), "unknown key").when(~F.coalesce("valid", F.lit(False)), "invalid signature")
    joined = F.array_join(F.array_sort(F.collect_list("signature")), ",")
    return checked.withColumn("fault", fault).groupBy("artifact").agg(
        F.count("*").alias("signatures"), F.min("fault").alias("fault"), F.count_if(F.col("fault").isNull()).alias("valid_signatures"), F.sha2(joined.cast("binary"), 256).alias("signature_set_hash")
    )


def ingest(files: DataFrame, known: DataFrame, keys: DataFrame, verdicts: DataFrame, formats: tuple[str, ...], limits: dict[str, int] | None = None, strict: bool = True) -> Ingested:
    """Check a delivery of archives (artifact, content) stage by stage.

    ``formats`` are those that a manifest may name. ``known`` has the payload_hash of stored payloads, ``keys`` the key_id of usable keys, ``verdicts`` (signature, valid)
    what a verifier says of signature members, named by their SHA-256; a signature without a verdict isn't valid. ``strict``
    rejects an archive with a fault in a signature, otherwise it is admitted with ``signature_fault``.

    Admitted: artifact, ``artifact_hash`` (of the archive's bytes), ``payload_type``, ``payload_hash``, ``signature_set_hash``
    (null without signatures), counts of signatures, packed and unpacked bytes, ``path`` in a store, and ``stores_payload``:
    false where the payload is known, or a smaller artifact of the delivery brings it. Quarantine: artifact, ``stage``,
    ``reason``. Payloads: (hash, content) to store. Of an artifact that comes twice, or null, all copies are quarantined.
    """
    limits = {**LIMITS, **(limits or {})}
    once = files.groupBy("artifact").agg(F.count("*").alias("times"))
    heads = files.select("artifact", "content").join(once.where("times = 1 and artifact is not null"), "artifact", "left_semi").withColumn("reason", _header(F.col("content"), limits))
    quarantine = once.where("times > 1 or artifact is null").select("artifact", F.lit("header").alias("stage"), F.when(F.col("artifact").isNull(), "no name").otherwise("repeated artifact").alias("reason"))
    quarantine = quarantine.unionByName(heads.where("reason is not null").select("artifact", F.lit("header").alias("stage"), "reason"))

    kind = files.schema["artifact"].dataType.simpleString()
    unpacked = written(heads.where("reason is null").select("artifact", "content").mapInArrow(_unpack(limits), _PIECES.format(kind)), "members")
    whole = unpacked.where("stage = 'unpacked'").select("artifact", "bytes")
    quarantine = quarantine.unionByName(unpacked.where("reason is not null").select("artifact", "stage", "reason"))
    members = unpacked.where("member is not null").select("artifact", "member", "piece", "content").join(whole, "artifact", "left_semi")

    manifests = written(_manifests(members, whole, limits, formats), "manifests")
    payloads = written(_payloads(members, manifests, limits), "payloads")
    signed = written(_signatures(members, payloads, keys, verdicts), "signatures")
    good = payloads.where("reason is null").drop("reason").join(signed, "artifact", "left")
    for stage, rows in (("manifest", manifests), ("payload", payloads)):
        quarantine = quarantine.unionByName(rows.where("reason is not null").select("artifact", F.lit(stage).alias("stage"), "reason"))
    if strict:
        quarantine = quarantine.unionByName(signed.where("fault is not null").select("artifact", F.lit("signature").alias("stage"), F.col("fault").alias("reason")))
        good = good.where("fault is null")

    first = good.groupBy("payload_hash").agg(F.min("artifact").alias("artifact")).join(known.select("payload_hash").distinct(), "payload_hash", "left_anti").select("artifact", F.lit(True).alias("new"))
    names = files.select("artifact", F.sha2("content", 256).alias("artifact_hash"), F.octet_length("content").cast("long").alias("packed_bytes"))
    admitted = good.drop("payload").join(first, "artifact", "left").join(names, "artifact").join(whole, "artifact").select(
        "artifact", "artifact_hash", "payload_type", "payload_hash", "signature_set_hash", F.coalesce("signatures", F.lit(0)).alias("signatures"), F.coalesce("valid_signatures", F.lit(0)).alias("valid_signatures"),
        F.col("fault").alias("signature_fault"), "packed_bytes", F.col("bytes").alias("unpacked_bytes"), shard_path(F.col("artifact_hash")).alias("path"), F.coalesce("new", F.lit(False)).alias("stores_payload"),
    )
    new = good.join(first, "artifact", "left_semi").select(F.col("payload_hash").alias("hash"), F.col("payload").cast("binary").alias("content"))
    return Ingested(admitted, quarantine, new)
