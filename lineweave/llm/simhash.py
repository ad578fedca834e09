"""SimHash near-duplicate groups by anchor-point covering.

A 64-bit fingerprint is read in three segments. Two fingerprints at most 4 bits apart differ, in at least one
segment, by no more than that segment's threshold (1, 1 and 0 bits: were all exceeded, they would differ by
2 + 2 + 1 = 5). The first two segments of 23 bits use a covering code: the direct sum of the perfect
[15,11] Hamming code and 8 free bits, whose covering radius is 1. Every fingerprint has a home anchor, the
codeword within the radius, and is replicated to all anchors within radius + threshold = 2. If two fingerprints
are within the threshold in the segment, the home anchor of one is among the anchors of the other, so comparing
homes with members at each anchor finds every pair. The third segment of 18 bits is its own anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, local_forest, small_batches, text_bytes, whole_keys

THRESHOLD = 4
SEED = 42
SHINGLE = 4
#: Homes at one anchor beyond which its comparisons are dealt out to more tasks.
CELL = 4096
#: Pairs compared at once in a task.
BLOCK = 1 << 21
_FREE, _CODE = 8, 15


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one text: a bit is 1 if it is set in over half of the XXH64 hashes of its word shingles.

    A-Z are lower-cased, words are separated by ASCII white space. Fewer words than a shingle: the whole sequence
    is the only shingle. No words: zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    n = len(words) - shingle + 1
    for at in range(0, n, 1 << 16):
        spans = zip(starts[at : min(n, at + (1 << 16))].tolist(), ends[at + shingle - 1 : at + (1 << 16) + shingle - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``df`` and the fingerprint of ``text`` as a signed long; null text counts as empty."""

    small_batches(df.sparkSession)

    @F.arrow_udf("long")
    def simhash(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x, shingle, seed) for x in text_bytes(column)], np.uint64).view(np.int64))

    return df.withColumn(name, simhash(F.col(text)))


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome of the Hamming code, what to flip for the anchors within distance 2 (-1: none), the home first."""
    single = {s: 1 << (s - 1) if s else 0 for s in range(16)}  # flipping bit i changes the syndrome by i + 1
    rows = []
    for s in range(16):
        pairs = [single[i] | single[i ^ s] for i in range(1, 16) if i < i ^ s] if s else []
        free = [1 << (_CODE + i) for i in range(_FREE)]
        near = [single[s], *pairs, *(single[s] | f for f in free)]
        rows.append(near + ([a | b for k, a in enumerate(free) for b in free[:k]] if not s else []))
    out = np.full((16, max(map(len, rows))), -1, np.int64)
    for s, row in enumerate(rows):
        out[s, : len(row)] = row
    syndrome = np.zeros(1 << _CODE, np.int64)
    for i in range(_CODE):
        syndrome ^= ((np.arange(1 << _CODE) >> i) & 1) * (i + 1)
    return out, syndrome


def _anchors(fp: np.ndarray, homes_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, fingerprint, whether it is the home) for every anchor that a fingerprint is replicated to."""
    masks, syndrome = _masks()
    width = _FREE + _CODE
    found = []
    for segment in range(2):
        part = (fp >> (segment * width)) & ((1 << width) - 1)
        flips = masks[syndrome[part & ((1 << _CODE) - 1)]][:, : 1 if homes_only else None]
        row, column = np.nonzero(flips >= 0)
        found.append(((part[row] ^ flips[row, column]) | (segment << 40), fp[row], column == 0))
    rest = ((fp >> (2 * width)) & ((1 << (64 - 2 * width)) - 1)) | (2 << 40)
    found.append((rest, fp, np.ones(len(fp), bool)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _replicate(fingerprints: DataFrame, homes_only: bool) -> DataFrame:
    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                key, fp, home = _anchors(batch.column(0).slice(at, 4096).to_numpy(), homes_only)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(home)], ["anchor", "fp", "home"])

    return fingerprints.select("fp").mapInArrow(spread, "anchor long, fp long, home boolean")


def _compare(threshold: int):
    def compare(batches):
        held = [np.empty(0, np.int64), np.empty(0, np.int64)]
        for table in whole_keys(batches, "cell"):
            cell, fp, home = (table.column(c).to_numpy() for c in ("cell", "fp", "home"))
            start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            size = np.diff(np.append(start, len(cell)))
            group = np.repeat(np.arange(len(start)), size)
            rows = np.flatnonzero(home & (size[group] > 1))
            at = 0
            while at < len(rows):
                pairs = np.cumsum(size[group[rows[at:]]])
                n = max(1, int(np.searchsorted(pairs, BLOCK, "right")))
                mine = rows[at : at + n]
                width = size[group[mine]]
                offset = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                a, b = np.repeat(fp[mine], width), fp[np.repeat(start[group[mine]], width) + offset]
                near = (np.bitwise_count((a ^ b).view(np.uint64)) <= threshold) & (a != b)
                held = list(local_forest(np.concatenate([held[0], a[near]]), np.concatenate([held[1], b[near]])))
                at += n
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["src", "dst"])

    return compare


def fingerprint_components(fingerprints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(node, component) of distinct fingerprints ``fp`` that link at ``threshold`` or fewer differing bits."""
    if threshold > THRESHOLD:
        raise ValueError(f"the segments cover up to {THRESHOLD} differing bits")
    homes = _replicate(fingerprints, homes_only=True).groupBy("anchor").agg(F.count("*").alias("n"))
    # an anchor with many homes becomes parts x parts cells: each home goes to one row of cells, each member to one column
    hot = homes.where(F.col("n") > CELL).select("anchor", F.ceil(F.col("n") / CELL).cast("int").alias("parts"))
    spread = _replicate(fingerprints, homes_only=False).join(hot, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    as_home = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(True).alias("home")))
    as_member = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(False).alias("home")))
    single = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("home")))
    places = F.when(F.col("parts") == 1, single).when(F.col("home"), F.concat(as_home, as_member)).otherwise(as_member)
    cells = spread.select("fp", F.col("anchor"), F.explode(places).alias("p")).select("fp", F.when(F.col("p.i") + F.col("p.j") == 0, F.col("anchor")).otherwise(F.xxhash64("anchor", "p.i", "p.j")).alias("cell"), F.col("p.home").alias("home"))
    edges = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(threshold), "src long, dst long")
    return components(edges)


def _groups(prints: DataFrame, threshold: int) -> DataFrame:
    """(fp, component) of every fingerprint in (id, fp)."""
    classes = prints.select("fp").distinct()
    member = fingerprint_components(classes, threshold)
    return classes.join(member.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: id, ``fp`` (signed long), ``component_id`` (the smallest id reachable by links).

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id get their group's
    smallest id, or null in a group without ids. Repeated rows are returned as often as they come.
    """
    prints = cut(with_fingerprint(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", "fp").select("id", "fp"), "fingerprints")
    groups = cut(_groups(prints, threshold), "groups")
    reps = prints.groupBy("fp").agg(F.min("id").alias("rep"))
    smallest = reps.join(groups, "fp").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = groups.join(smallest, "component").select("fp", "component_id")
    return prints.join(named, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``df`` with one row of each near-duplicate group: the one with the smallest id, null ids last.

    Of repeated rows one stays.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc")
    rows = cut(with_fingerprint(df.select(whole, F.monotonically_increasing_id().alias("row")), f"doc.`{text}`", "fp"), "fingerprints")
    groups = _groups(rows, threshold)
    order = F.struct(F.col(f"doc.`{id_col}`").isNull().alias("none"), F.col(f"doc.`{id_col}`").alias("id"), "row")
    kept = rows.groupBy("fp").agg(F.min(order).alias("first")).join(groups, "fp").groupBy("component").agg(F.min("first").alias("first"))
    stay = rows.join(kept.select(F.col("first.row").alias("row")), "row", "left_semi")
    return stay.select(*(F.col(f"doc.`{c}`").alias(c) for c in df.columns))
