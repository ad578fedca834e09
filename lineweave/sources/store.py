"""A store of artifacts as a data source: read by page and prefix, followed as a feed, written in two phases.

    register(spark)
    artifacts.write.format("artifacts").option("path", folder).mode("append").save()
    opened(spark, folder).where("hash like 'ab%'")
    spark.read.format("artifacts").option("path", folder).load()
    spark.readStream.format("artifacts").option("path", folder).load()

Tasks write Parquet parts that nobody reads until the driver's commit names them in an entry of the log, with the least and
greatest of their hashes and times. A reader takes the parts that its conditions on ``hash`` and ``type`` leave, and applies
the conditions in them. The feed's offset is a cursor (time, hash), so that artifacts of one time are neither lost nor
repeated by a restart between them. The folder is on any file system that Arrow opens.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, StringStartsWith, WriterCommitMessage

SCHEMA = "hash string, ts timestamp, type string, parent string, size bigint"
_ARROW = pa.schema([("hash", pa.string()), ("ts", pa.timestamp("us", "UTC")), ("type", pa.string()), ("parent", pa.string()), ("size", pa.int64())])
#: Rows that a task holds before it writes them.
ROWS = 1 << 16
BEGIN = {"ts": -(1 << 63), "hash": ""}


@dataclass
class Part(InputPartition):
    """A part of the store, and the range of the feed that is asked for."""

    name: str
    rows: int
    hashes: tuple[str, str]
    first: tuple[int, str]
    last: tuple[int, str]
    types: list[str]
    above: tuple[int, str] | None = None
    upto: tuple[int, str] | None = None


@dataclass
class Written(WriterCommitMessage):
    parts: list[dict] = field(default_factory=list)


class Folder:
    """The files of a store."""

    def __init__(self, path: str):
        self.files, root = fs.FileSystem.from_uri(path)
        self.parts, self.log = f"{root}/parts", f"{root}/log"

    def entries(self) -> list[dict]:
        """The log's entries in order, without those that a later one replaces."""
        found = [x.path for x in self.files.get_file_info(fs.FileSelector(self.log, allow_not_found=True)) if x.path.endswith(".json")]
        read = []
        for path in sorted(found):
            with self.files.open_input_stream(path) as file:
                read.append({"name": path.rsplit("/", 1)[1], **json.loads(file.read())})
        gone = {name for entry in read for name in entry["replaces"]}
        return [entry for entry in read if entry["name"] not in gone]

    def listed(self) -> list[Part]:
        return [Part(p["name"], p["rows"], tuple(p["hashes"]), tuple(p["first"]), tuple(p["last"]), p["types"]) for entry in self.entries() for p in entry["parts"]]

    def commit(self, parts: list[dict], overwrite: bool) -> None:
        entry = {"parts": parts, "replaces": [e["name"] for e in self.entries()] if overwrite else []}
        self.files.create_dir(self.log)
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        with self.files.open_output_stream(f"{self.log}/{name}.new") as file:
            file.write(json.dumps(entry).encode())
        self.files.move(f"{self.log}/{name}.new", f"{self.log}/{name}.json")  # all of it appears at once

    def delete(self, name: str) -> None:
        """A part, or all of a write's."""
        path = f"{self.parts}/{name}"
        kind = self.files.get_file_info(path).type
        if kind == fs.FileType.Directory:
            self.files.delete_dir(path)
        elif kind == fs.FileType.File:
            self.files.delete_file(path)

    def orphans(self) -> list[str]:
        """Parts that no entry names: of lost tasks, of writes that go on, or replaced. Delete old ones only."""
        named = {p.name for p in self.listed()}
        found = self.files.get_file_info(fs.FileSelector(self.parts, allow_not_found=True, recursive=True))
        names = (x.path.removeprefix(f"{self.parts}/") for x in found if x.type == fs.FileType.File)
        return sorted(n for n in names if n not in named)

    def read(self, part: Part, conditions: list[tuple[str, str, str]]) -> Iterator[pa.RecordBatch]:
        with self.files.open_input_file(f"{self.parts}/{part.name}") as file:
            for batch in pq.ParquetFile(file).iter_batches(ROWS):
                keep = pa.array([True] * batch.num_rows, pa.bool_())
                for column, how, value in conditions:
                    values = batch.column(column)
                    keep = pc.and_(keep, pc.fill_null(pc.equal(values, value) if how == "=" else pc.starts_with(values, value), False))
                times = batch.column("ts").cast(pa.int64())
                for bound, beyond in ((part.above, pc.greater), (part.upto, None)):
                    if bound is not None:
                        t, h = bound
                        strictly = beyond or pc.less
                        same = pc.and_(pc.equal(times, t), (beyond or pc.less_equal)(batch.column("hash"), h))
                        keep = pc.and_(keep, pc.or_(strictly(times, t), same))
                kept = batch.filter(keep)
                if kept.num_rows:
                    yield kept


class Reader(DataSourceReader):
    def __init__(self, path: str, once: bool):
        self.path, self.once, self.conditions = path, once, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Of a table opened for one scan, equality of ``hash`` and ``type`` and prefixes of ``hash`` are applied here; Spark keeps the rest."""
        for f in filters:
            if not self.once:
                yield f
            elif isinstance(f, EqualTo) and f.attribute in (("hash",), ("type",)):
                self.conditions.append((f.attribute[0], "=", f.value))
            elif isinstance(f, StringStartsWith) and f.attribute == ("hash",):
                self.conditions.append(("hash", "^", f.value))
            else:
                yield f

    def possible(self, part: Part) -> bool:
        low, high = part.hashes
        for column, how, value in self.conditions:
            if column == "type":
                if value not in part.types:
                    return False
            elif (value < low or value > high) if how == "=" else (value > high or low > value and not low.startswith(value)):
                return False
        return True

    def partitions(self) -> list[Part]:
        return [p for p in Folder(self.path).listed() if self.possible(p)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # an empty store
            yield from Folder(self.path).read(partition, self.conditions)


class FeedReader(DataSourceStreamReader):
    """Artifacts in the order of their cursors; a registry gives an artifact its time when it takes it."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return BEGIN

    def latestOffset(self) -> dict:  # noqa: N802
        last = max((p.last for p in Folder(self.path).listed()), default=None)
        return BEGIN if last is None else {"ts": last[0], "hash": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        above, upto = (start["ts"], start["hash"]), (end["ts"], end["hash"])
        found = [p for p in Folder(self.path).listed() if p.last > above and p.first <= upto]
        for p in found:
            p.above, p.upto = above, upto
        return found

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from Folder(self.path).read(partition, [])


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        """On the driver: a write has a folder of its own, so a task that outlives an abort finds no place."""
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        folder = Folder(path)
        folder.files.create_dir(f"{folder.parts}/{self.job}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, done = Folder(self.path), Written()
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            table = pa.Table.from_batches(held).select(_ARROW.names).cast(_ARROW)
            if table.column("hash").null_count or table.column("ts").null_count:
                raise ValueError("an artifact needs a hash and a time")
            table = table.sort_by([("ts", "ascending"), ("hash", "ascending")])
            name = f"{self.job}/{uuid.uuid4().hex}.parquet"
            done.parts.append({"name": name})  # from here on it is there to be deleted
            with folder.files.open_output_stream(f"{folder.parts}/{name}") as file:
                pq.write_table(table, file)
            times, hashes = table.column("ts").cast(pa.int64()), table.column("hash")
            edge = lambda i: [times[i].as_py(), hashes[i].as_py()]
            done.parts[-1] |= {
                "rows": table.num_rows, "hashes": [pc.min(hashes).as_py(), pc.max(hashes).as_py()], "first": edge(0), "last": edge(table.num_rows - 1), "types": [t for t in pc.unique(table.column("type")).to_pylist() if t is not None]
            }
            held.clear()

        try:
            for batch in iterator:
                held.append(batch)
                if sum(b.num_rows for b in held) >= ROWS:
                    flush()
            if sum(b.num_rows for b in held):
                flush()
        except BaseException:
            for part in done.parts:
                folder.delete(part["name"])
            raise
        return done

    def commit(self, messages: list[Written | None]) -> None:
        Folder(self.path).commit([p for m in messages if m for p in m.parts], self.overwrite)

    def abort(self, messages: list[Written | None]) -> None:
        Folder(self.path).delete(self.job)


class Artifacts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("scans") == "one")

    def streamReader(self, schema) -> FeedReader:  # noqa: N802
        return FeedReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, which from then on hands conditions to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Artifacts)


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The store's artifacts for one scan, whose conditions reach the parts.

    Spark keeps one set of conditions for a table of a Python source. A query that reads a table twice, in a union or a join
    with itself, would apply the last scan's conditions to both: open the store twice there, or load it plainly, which
    leaves the conditions to Spark.
    """
    return spark.read.format("artifacts").option("path", path).option("scans", "one").load()
