"""Packed artifacts: reading and checking their members, and writing them reproducibly, also those that no task could hold.

An archive's layout follows from the sizes of its members in order of their names: a prefix sum gives each its place. The
archive is cut into chunks of a fixed number of bytes, which tasks fill and pack on their own; a packed archive is its packed
chunks one after the other, as gzip allows. One chunk is packed as the whole would be, so small archives have the bytes
of :func:`pack`; they are packed one after the other from members in order, without a place for each.
"""

from __future__ import annotations

import gzip
import io
import tarfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import written
from ..operators.registry import LIMITS

#: Unpacked bytes of a chunk.
CHUNK = 32 << 20
#: Bytes of members that a reader's batch holds.
BATCH = 8 << 20


def _entry(name: str, size: int) -> tarfile.TarInfo:
    info = tarfile.TarInfo(name)
    info.size, info.mtime, info.uid, info.gid, info.uname, info.gname, info.mode = size, 0, 0, 0, "", "", 0o644
    return info


_PLAIN = _entry("", 0).tobuf(tarfile.PAX_FORMAT)
_PLAIN_SUM = int(_PLAIN[148:154], 8) - sum(_PLAIN[124:135])


def _header(name: str, size: int) -> bytes:
    """A member's header; a short ASCII name and the size are set into the one that all such members share."""
    if len(name) > tarfile.LENGTH_NAME or not name.isascii() or size >= 8**11:
        return _entry(name, size).tobuf(tarfile.PAX_FORMAT, "utf-8", "surrogateescape")
    raw, digits = name.encode(), b"%011o" % size
    return raw + _PLAIN[len(raw) : 124] + digits + _PLAIN[135:148] + b"%06o" % (_PLAIN_SUM + sum(raw) + sum(digits)) + _PLAIN[154:]


def pack(members: list[tuple[str, bytes]]) -> bytes:
    """A gzipped tar whose bytes depend on names and contents alone: sorted, no times, no owners."""
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for name, content in sorted(members):
            tar.addfile(_entry(name, len(content)), io.BytesIO(content))
    return gzip.compress(raw.getvalue(), 9, mtime=0)


def prefix_sums(rows: DataFrame, by: str, order: list[str], size: str) -> DataFrame:
    """``rows`` with ``offset``: the sum of ``size`` over the rows of the same ``by`` before, in order.

    Sums are taken within ranges of the order first, then over the ranges, so that no task sorts all rows of one ``by``.
    """
    placed = written(rows.repartitionByRange(by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy(by, "_range").agg(F.sum(size).alias("_sum"))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(by, "_range", F.coalesce(F.sum("_sum").over(ahead(Window.partitionBy(by).orderBy("_range"))), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum(size).over(ahead(Window.partitionBy(by, "_range").orderBy(*order))), F.lit(0))
    return placed.withColumn("_inside", inside).join(base, [by, "_range"]).withColumn("offset", F.col("_base") + F.col("_inside")).drop("_range", "_base", "_inside")


def pack_parts(members: DataFrame, by: str = "artifact", chunk: int = CHUNK) -> DataFrame:
    """(by, part, content): the packed chunks of each group's archive, in order, from members (by, path, content).

    Joined they are the archive; a task holds one chunk, and a row one member. Null contents are empty files, rows without
    a path or a group are left out.
    """

    small, large = _by_size(members, by, chunk)
    packed = _pack_small(small, by).select(by, F.lit(0).cast("long").alias("part"), "content")
    return packed if large is None else packed.unionByName(_pack_large(large, by, chunk))


def _by_size(members: DataFrame, by: str, chunk: int) -> tuple[DataFrame, DataFrame | None]:
    """Members (by, path, content) of groups whose archive surely fits in a chunk, and those of the others, if there are any."""
    rows = written(members.where(F.col("path").isNotNull() & F.col(by).isNotNull()).select(by, "path", F.coalesce("content", F.lit(b"")).alias("content")), "members")
    # headers of a name that isn't plain hold it up to twice
    bound = F.octet_length("content").cast("long") + 2 * F.octet_length("path") + 6 * tarfile.BLOCKSIZE
    sizes = rows.groupBy(by).agg(F.sum(bound).alias("_bytes"))
    # one row for each few MB of the input at most
    large = written(sizes.where(F.col("_bytes") + 2 * tarfile.RECORDSIZE > chunk).select(by), "large")
    if large.isEmpty():
        return rows, None
    return rows.join(F.broadcast(large), by, "left_anti"), rows.join(F.broadcast(large), by, "left_semi")


def _pack_small(members: DataFrame, by: str) -> DataFrame:
    """(by, content): the archive of each group, from members dealt by group and sorted; a task holds one archive beside a batch."""
    kind = members.schema[by].dataType.simpleString()

    def read(batches):
        raw, group, made, size = bytearray(), None, [], 0

        def end() -> bytes:
            raw.extend(bytes(-(len(raw) + 2 * tarfile.BLOCKSIZE) % tarfile.RECORDSIZE + 2 * tarfile.BLOCKSIZE))
            return gzip.compress(raw, 9, mtime=0)

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([g for g, _ in made], key), pa.array([c for _, c in made], pa.binary())], [by, "content"])

        for batch in batches:
            key = batch.schema.field(0).type
            for of, name, content in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if of != group and raw:
                    made.append((group, end()))
                    size += len(made[-1][1]) + 100
                    raw.clear()
                    if size >= BATCH:
                        yield table()
                        made, size = [], 0
                group = of
                raw += _header(name, len(content))
                raw += content
                raw += bytes(-len(content) % tarfile.BLOCKSIZE)
        if raw:
            made.append((group, end()))
            yield table()

    return members.repartition(by).sortWithinPartitions(by, "path", "content").mapInArrow(read, f"{by} {kind}, content binary")


def _pack_large(rows: DataFrame, by: str, chunk: int) -> DataFrame:
    """(by, part, content) of groups of any size, see :func:`pack_parts`."""

    @F.arrow_udf("binary")
    def header(paths: pa.Array, sizes: pa.Array) -> pa.Array:
        return pa.array([_header(name, size) for name, size in zip(paths.to_pylist(), sizes.to_pylist(), strict=True)], pa.binary())

    block = tarfile.BLOCKSIZE
    padded = lambda n, to: F.ceil(n / to) * to
    rows = rows.withColumn("head", header("path", F.octet_length("content").cast("long")))
    rows = rows.withColumn("size", (F.octet_length("head") + padded(F.octet_length("content"), block)).cast("long"))
    placed = prefix_sums(rows, by, ["path", "content"], "size")
    total = placed.groupBy(by).agg(F.sum("size").alias("offset"))
    none = F.lit(b"")
    last = total.select(by, none.alias("content"), none.alias("head"), (padded(F.col("offset") + 2 * block, tarfile.RECORDSIZE) - F.col("offset")).cast("long").alias("size"), "offset")
    whole = placed.select(*last.columns).unionByName(last)
    part = F.explode(F.sequence(F.floor(F.col("offset") / chunk), F.floor((F.col("offset") + F.col("size") - 1) / chunk)))
    cut = whole.withColumn("part", part)
    low = F.greatest(F.col("offset"), F.col("part") * chunk)
    high = F.least(F.col("offset") + F.col("size"), (F.col("part") + 1) * chunk)
    begin = (low - F.col("offset")).cast("int")
    after = F.greatest(begin - F.octet_length("head"), F.lit(0))  # where in the content a piece goes on
    data = F.concat(F.substring("head", begin + 1, (high - low).cast("int")), F.substring("content", after + 1, F.greatest((high - low).cast("int") - F.greatest(F.octet_length("head") - begin, F.lit(0)), F.lit(0))))
    pieces = cut.select(by, "part", (low - F.col("part") * chunk).alias("start"), (high - F.col("part") * chunk).alias("end"), data.alias("data"))

    def fill(key, table):
        raw = bytearray(max(table.column("end").to_pylist()))  # members' padding and the archive's end are zeros
        for start, data in zip(table.column("start").to_pylist(), table.column("data").to_pylist(), strict=True):
            raw[start : start + len(data)] = data
        return pa.table({by: table.column(by).slice(0, 1), "part": table.column("part").slice(0, 1), "content": pa.array([gzip.compress(raw, 9, mtime=0)], pa.binary())})

    return pieces.groupBy(by, "part").applyInArrow(fill, f"{by} {rows.schema[by].dataType.simpleString()}, part long, content binary")


def pack_groups(members: DataFrame, by: str = "artifact", chunk: int = CHUNK) -> DataFrame:
    """(by, archive, hash) from members (by, path, content): one archive for each group, which a row has to hold; see :func:`pack_parts`."""
    small, large = _by_size(members, by, chunk)
    packed = _pack_small(small, by).select(by, F.col("content").alias("archive")).withColumn("hash", F.sha2("archive", 256))
    if large is None:
        return packed
    parts = _pack_large(large, by, chunk).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))), lambda x: x["content"]).alias("parts"))
    whole = F.when(F.size("parts") == 1, F.col("parts")[0]).otherwise(F.aggregate("parts", F.lit(b""), lambda a, b: F.concat(a, b)))
    return packed.unionByName(parts.select(by, whole.alias("archive")).withColumn("hash", F.sha2("archive", 256)))


def write_archive(parts: DataFrame, path: str) -> None:
    """Write the parts (part, content) of one archive as one file, a part at a time."""
    spark: SparkSession = parts.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, fresh = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new"))
    files = target.getFileSystem(conf)
    out = files.create(fresh, True)
    ordered = written(parts.select("part", "content"), "parts").orderBy("part")
    for row in ordered.toLocalIterator(prefetchPartitions=False):
        out.write(bytearray(row["content"]))
    out.close()
    files.delete(target, False)
    files.rename(fresh, target)


def _listed(raw: bytes):
    """Regular members of an archive as a stream; raises ValueError where it breaks a rule."""
    total = 0
    # tarfile's own reader stops after the first of several packed chunks
    with gzip.GzipFile(fileobj=io.BytesIO(raw)) as unpacked, tarfile.open(fileobj=unpacked, mode="r|") as tar:
        for n, member in enumerate(tar):
            total += member.size
            if member.name.startswith("/") or ".." in member.name.split("/"):
                raise ValueError("unsafe path")
            if not (member.isreg() or member.isdir()):
                raise ValueError("not a regular file")
            if n >= LIMITS["entries"] or total > LIMITS["bytes"]:
                raise ValueError("too large")
            tar.members = []
            if member.isreg():
                yield member.name, tar.extractfile(member)


def _fault(raw: bytes) -> str | None:
    try:
        for _, content in _listed(raw):
            while content.read(1 << 20):
                pass
    except (tarfile.TarError, OSError, EOFError, zlib.error) as error:
        return f"unreadable: {type(error).__name__}"
    except ValueError as error:
        return str(error)
    return None


def _entry_of(head: bytes) -> tuple[str, int] | None:
    """Name and size of a regular file; None for any other member. A header that :func:`_header` gives isn't taken apart."""
    try:
        name, size = head[: tarfile.LENGTH_NAME].rstrip(b"\0").decode(), int(head[124:135], 8)
        if head == _header(name, size):
            return name, size
    except ValueError:
        pass
    member = tarfile.TarInfo.frombuf(head, "utf-8", "surrogateescape")
    return (member.name, member.size) if member.type == tarfile.REGTYPE and member.size >= 0 else None


def _plain(raw: bytes) -> list[tuple[str, bytes]] | None:
    """The members of an archive of up to a batch that has plain files alone and breaks no rule, read once; None for any other."""
    members, at, block = [], 0, tarfile.BLOCKSIZE
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(raw)) as unpacked:
            data = unpacked.read(BATCH + 1)
        while len(data) <= BATCH and len(members) < LIMITS["entries"] and at <= LIMITS["bytes"]:
            head = data[at : at + block]
            if len(head) == block and not head.strip(b"\0"):
                return members
            member = _entry_of(head)
            if member is None or member[0].startswith("/") or ".." in member[0].split("/"):
                return None
            name, length = member
            content = data[at + block : at + block + length]
            at += block + -(-length // block) * block
            if at > len(data):
                return None
            members.append((name, content))
    except (tarfile.TarError, OSError, EOFError, zlib.error):
        pass
    return None


def read_archives(files: DataFrame, key: str = "path", column: str = "content") -> DataFrame:
    """(key, member, content, error) of every regular member; an archive that breaks a rule gives one row with the error.

    Rules: gzip and tar can be read, no absolute path and no step upwards, no links, entries and bytes within limits. An
    archive of up to a batch is read once; a larger or an odd one twice, as a stream: first to the end for faults, then for its
    members, which are handed on as they come.
    """

    def read(batches):
        for batch in batches:
            types = (batch.schema.field(0).type, pa.string(), pa.binary(), pa.string())
            made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [key, "member", "content", "error"])  # noqa: B023, E731
            held, size = [], 0
            for at in range(batch.num_rows):
                name, raw = batch.column(0)[at].as_py(), batch.column(1)[at].as_py() or b""
                plain = _plain(raw)
                if plain is not None:
                    held.extend((name, member, content, None) for member, content in plain)
                    size += sum(len(content) + 100 for _, content in plain)
                    if size >= BATCH:
                        yield made(held)
                        held, size = [], 0
                    continue
                fault = _fault(raw)
                if fault:
                    held.append((name, None, None, fault))
                    continue
                for member, content in _listed(raw):
                    held.append((name, member, content.read(), None))
                    size += len(held[-1][2]) + 100
                    if size >= BATCH:
                        yield made(held)
                        held, size = [], 0
            if held:
                yield made(held)

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, column).mapInArrow(read, f"{key} {kind}, member string, content binary, error string")


def payload_hashes(members: DataFrame, key: str = "path", prefix: str = "payload/") -> DataFrame:
    """(key, payload_hash): the hash over the sorted names and content hashes of each archive's payload."""
    rows = members.where(F.startswith("member", F.lit(prefix))).select(key, F.concat_ws(":", "member", F.sha2("content", 256)).alias("h"))
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n").cast("binary"), 256).alias("payload_hash"))


def sealed_header_ok(column: str = "content", magic: bytes = b"XDEX1", salt: int = 16):
    """Whether an encrypted archive starts with the magic, a salt and the SHA-256 of both."""
    c, n = F.col(column), len(magic)
    head = F.substring(c, F.lit(1), F.lit(n + salt))
    stated = F.lower(F.hex(F.substring(c, F.lit(n + salt + 1), F.lit(32))))
    return F.coalesce((F.substring(c, F.lit(1), F.lit(n)) == F.lit(magic)) & (stated == F.sha2(head, 256)), F.lit(False))
