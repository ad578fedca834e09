"""Periodic runs in word sequences, by Karp-Miller-Rosenberg naming.

Level k names every block of 2^k words of a document: blocks are equal if, and only if, their names are. A level comes
from the one before by sorting pairs of names; a block that its document doesn't repeat gets no name, so that levels
soon thin out, and the last level is the first without a repeat. A run of period q has four periods at least, so some
multiple of q is followed by two more periods of it: positions on that grid, whose names agree with those one and two
periods later, are the candidates. Each is extended to both sides by descending levels.

Documents are independent, so the work is a map over batches of them: nothing is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

#: A run is at least so many words, and at least so many periods, long.
LEAST_WORDS, LEAST_PERIODS = 6, 4


def names(words: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Levels of names over the word numbers of some documents; -1 where a block isn't repeated in its document."""
    n = len(words)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    levels: list[np.ndarray] = []
    at, first, second = np.arange(n), doc, words.astype(np.int64)
    while len(at):
        _, name, count = np.unique(first * (second.max() + 1) + second, return_inverse=True, return_counts=True)
        again = count[name] > 1
        if not again.any():
            break
        level = np.full(n + 1, -1, np.int32)  # one more, for positions past the end
        level[at[again]] = name[again]
        width = 1 << len(levels)
        levels.append(level)
        at = at[again]
        at = at[at + width < n]
        at = at[(doc[at] == doc[at + width]) & (level[at + width] >= 0)]
        first, second = level[at].astype(np.int64), level[at + width].astype(np.int64)
    return levels


def _forward(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from a on and from b on are the same."""
    past = len(levels[0]) - 1
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x = levels[k][np.minimum(a + length, past)]
        length += ((x >= 0) & (x == levels[k][np.minimum(b + length, past)])).astype(np.int64) << k
    return length


def _backward(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words before a and before b are the same."""
    past = len(levels[0]) - 1
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a - length - (1 << k), b - length - (1 << k)
        x = levels[k][np.where(i < 0, past, i)]
        length += ((x >= 0) & (x == levels[k][np.where(j < 0, past, j)])).astype(np.int64) << k
    return length


def _candidates(levels: list[np.ndarray], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of grid positions that are named as one and as two periods later."""
    at, period = [], []
    for k, level in enumerate(levels):
        for q in range(1 << k, min(2 << k, longest // LEAST_PERIODS + 1)):
            grid = level[:-1:q]
            hit = np.flatnonzero((grid[:-2] >= 0) & (grid[:-2] == grid[1:-1]) & (grid[1:-1] == grid[2:])) * q
            if len(hit):
                at.append(hit)
                period.append(np.full(len(hit), q, np.int64))
    none = [np.empty(0, np.int64)]
    return np.concatenate(at or none), np.concatenate(period or none)


def runs(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), in this order, of all runs in documents of word numbers; starts count all words before."""
    levels = names(words, ends)
    if not levels:
        return np.empty((0, 3), np.int64)
    at, period = _candidates(levels, int(np.diff(ends, prepend=0).max()))
    start = at - _backward(levels, at, at + period)
    length = at + period + _forward(levels, at, at + period) - start
    long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    found = np.unique(np.stack([start[long], length[long], period[long]], axis=1), axis=0)
    # the same words with a multiple of their period come right after those with the smallest one
    return found[np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)])] if len(found) else found


def _report(keep: tuple[str, ...]):
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("words")
        flat = lists.flatten()
        ends = np.cumsum(lists.value_lengths().to_numpy(), dtype=np.int64)
        found = runs(flat.dictionary_encode().indices.to_numpy(), ends)
        begins = np.concatenate([[0], ends[:-1]])
        owner = np.searchsorted(ends, found[:, 0], "right")
        first, last = np.searchsorted(owner, np.arange(len(ends))), np.searchsorted(owner, np.arange(len(ends)), "right")
        # words of a run after its first period go
        edge = np.zeros(len(flat) + 1, np.int64)
        np.add.at(edge, found[:, 0] + found[:, 2], 1)
        np.add.at(edge, found[:, 0] + found[:, 1], -1)
        stay = np.cumsum(edge[:-1]) == 0
        left = np.concatenate([[0], np.cumsum(stay)])[np.concatenate([[0], ends])]
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(stay))), " ")
        found[:, 0] -= begins[owner]
        best, listed, digests = [], [], []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            mine = found[a:b].tolist()
            best.append(max(mine, key=lambda r: (r[1], -r[0], -r[2])) if mine else [None] * 3)
            listed.append(mine)
            digests.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in mine).encode()).hexdigest())
        start, length, period = zip(*best, strict=True)
        out = {
            "id": batch.column("id"), "n_runs": pa.array(last - first, pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "period": pa.array(period, pa.int64()),
            "exponent_milli": pa.array([1000 * n // q if q else None for n, q in zip(length, period, strict=True)], pa.int64()), "runs_sha256": pa.array(digests, pa.string()),
            "collapsed_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts.cast(pa.binary()).to_pylist()], pa.string()),
        }
        if "runs" in keep:
            item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            out["runs"] = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in mine] for mine in listed], pa.list_(item))
        if "collapsed" in keep:
            out["collapsed"] = texts
        return pa.RecordBatch.from_arrays(list(out.values()), list(out))

    def report(batches):
        for batch in batches:
            if batch.num_rows:
                yield rows(batch)
                give_back()

    return report


def periodic_runs(df: DataFrame, words: Column, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Runs of every row's ``words``: stretches with a smallest period q, of 6 words and 4 periods at least, as long as they can be.

    Returns a row for each row of ``df``: id, ``n_runs``; ``start`` (word number), ``length``, ``period`` and
    ``exponent_milli`` of the longest run (ties: smallest start, then period), null without runs; ``runs_sha256`` of the
    lines ``start,length,period``; ``collapsed_sha256`` of the words that no run holds after its first period, joined by a
    space. ``keep`` may name ``runs`` and ``collapsed`` to have the list and the text too. A null list counts as empty;
    null and repeated ids are kept as they are. A document's names are in one task's memory: 4 bytes a word and level.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    schema = f"id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    schema += ", runs array<struct<start: long, length: long, period: long>>" * ("runs" in keep) + ", collapsed string" * ("collapsed" in keep)
    return rows.mapInArrow(_report(keep), schema).withColumnRenamed("id", id_col)
