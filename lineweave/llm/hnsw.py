"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, results merged.

Equal vectors are one node of a graph, which carries as many of their rows, smallest ids first, as a result can hold.
Distinct vectors are dealt to shards by a hash, so that no label or source makes a shard hot. A shard's graph is a row
of flat arrays: vectors, their rows and ids, the levels' neighbour lists. Shards are dealt to a bounded number of groups;
queries go in blocks to every group, whose task holds a slab of them and one shard at a time.
"""

from __future__ import annotations

import heapq
import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_path, written

SHARD = 4096
LINKS = 16
BUILD, SEARCH = 80, 160
QUERY_BLOCK = 256
#: Groups of shards, or as many as Spark has cores, and queries that a group's task holds at once.
GROUPS, SLAB = 32, 1 << 16
#: Queries whose results are compared with all vectors, and the recall below which all queries are.
AUDIT, RECALL = 100, 0.95

_log = logging.getLogger(__name__)


def usable(column: str):
    """Whether a vector takes part: not null, not zero, no null or non-finite component."""
    c = F.col(column).cast("array<double>")
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(column).isNotNull() & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: no cosine changes, and no product overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision, without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Graph:
    """The graph over unit vectors ``x``; ``links[l]`` has a row of neighbours (-1: none) for each vector of level l."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, links: list[np.ndarray], entry: int):
        self.x, self.levels, self.links, self.entry = x, levels, links, entry

    @classmethod
    def build(cls, x: np.ndarray, links: int = LINKS, width: int = BUILD, seed: int = 1) -> Graph:
        rng = np.random.default_rng(seed)
        levels = np.minimum(-np.log(rng.random(len(x))) / np.log(links), 8).astype(np.int32)
        near: list[dict[int, list[int]]] = [{} for _ in range(int(levels.max()) + 1)]
        entry = 0
        for i in range(len(x)):
            top, own = int(levels[entry]), int(levels[i])
            if i:
                start = [entry]
                for level in range(top, -1, -1):
                    found = cls._walk(x, near[level], x[i], start, width if level <= own else 1)
                    start = [j for _, j in found]
                    if level <= own:
                        most = links * 2 if level == 0 else links
                        near[level][i] = chosen = cls._diverse(x, found, links)
                        for j in chosen:
                            back = near[level][j]
                            back.append(i)
                            if len(back) > most:
                                sims = x[back] @ x[j]
                                near[level][j] = cls._diverse(x, sorted(zip(sims.tolist(), back, strict=True), reverse=True), most)
            for level in range(own + 1):
                near[level].setdefault(i, [])
            if own > top or not i:
                entry = i
        flat = []
        for level, lists in enumerate(near):
            out = np.full((len(x), links * 2 if level == 0 else links), -1, np.int32)
            for i, js in lists.items():
                out[i, : len(js)] = js
            flat.append(out if level == 0 else out[levels >= level])
        return cls(x, levels, flat, entry)

    @staticmethod
    def _diverse(x, found, most):
        """Neighbours that are nearer to the point than to those chosen before; then the nearest others."""
        chosen, rest = [], []
        for s, j in found:
            if len(chosen) == most:
                break
            (chosen if not chosen or (x[chosen] @ x[j]).max() <= s else rest).append(j)
        return chosen + rest[: most - len(chosen)]

    @staticmethod
    def _walk(x, near, q, start, width):
        """The ``width`` most similar vectors that a best-first walk over one level finds, best first."""
        sims = (x[start] @ q).tolist()
        best = list(zip(sims, start, strict=True))
        heapq.heapify(best)
        todo = [(-s, j) for s, j in best]
        heapq.heapify(todo)
        seen = set(start)
        while todo:
            s, j = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            new = [k for k in near[j] if k not in seen]
            if not new:
                continue
            seen.update(new)
            for s, k in zip((x[new] @ q).tolist(), new, strict=True):
                if len(best) < width:
                    heapq.heappush(best, (s, k))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, k))
                else:
                    continue
                heapq.heappush(todo, (-s, k))
        return sorted(best, reverse=True)

    def lists(self) -> list:
        """Neighbour lists by level as the walk reads them."""
        out = []
        for level, flat in enumerate(self.links):
            rows = np.flatnonzero(self.levels >= level)
            out.append({i: [j for j in js if j >= 0] for i, js in zip(rows.tolist(), flat.tolist(), strict=True)})
        return out

    def search(self, near: list, q: np.ndarray, width: int = SEARCH) -> list[tuple[float, int]]:
        start = [self.entry]
        for level in range(len(near) - 1, 0, -1):
            start = [self._walk(self.x, near[level], q, start, 1)[0][1]]
        return self._walk(self.x, near[0], q, start, width)


_INDEX = "shard long, dim int, rows array<long>, ids array<long>, sizes array<int>, vectors {}, levels array<int>, entry int, base array<int>, upper array<array<int>>"


def build_index(vectors: DataFrame, shards: int) -> DataFrame:
    """One row of flat arrays for each shard, from (row, vector, members); shards never mix lengths of vectors.

    ``members`` are the (id, row) of the vector's rows; ``sizes`` says how many of ``rows`` and ``ids`` each vector has.
    """

    def build(key, table):
        table = table.sort_by("row")
        dim = key[1].as_py()
        flat = table.column("vector").combine_chunks().flatten()
        g = Graph.build(unit(_doubles(flat).reshape(-1, dim)))
        lists = table.column("members").combine_chunks()
        members = lists.flatten()
        one = {"shard": [key[0].as_py()], "dim": [dim], "rows": [members.field("row")], "ids": [members.field("id")], "sizes": [lists.value_lengths()], "vectors": [flat]}
        one |= {"levels": [g.levels], "entry": [g.entry], "base": [g.links[0].ravel()], "upper": [[u.ravel() for u in g.links[1:]]]}
        types = {"shard": pa.int64(), "dim": pa.int32(), "rows": pa.list_(pa.int64()), "ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "vectors": pa.list_(flat.type), "levels": pa.list_(pa.int32()), "entry": pa.int32(), "base": pa.list_(pa.int32()), "upper": pa.list_(pa.list_(pa.int32()))}
        return pa.table({k: pa.array([x.to_numpy() if isinstance(x, pa.Array) else x for x in v], types[k]) for k, v in one.items()})

    dealt = vectors.withColumn("dim", F.size("vector")).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return dealt.groupBy("shard", "dim").applyInArrow(build, _INDEX.format(vectors.schema["vector"].dataType.simpleString()))


def _doubles(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.float64)


def _read(row: dict, dim: int) -> tuple[Graph, np.ndarray, list[list[tuple[int, int]]]]:
    """The graph, its vectors, and the (id, row) of each vector's rows."""
    of = lambda c: row[c].values.to_numpy(zero_copy_only=False)
    x = _doubles(row["vectors"].values).reshape(-1, dim)
    links = [of("base").reshape(len(x), -1), *(np.array(u, np.int32).reshape(-1, LINKS) for u in row["upper"].as_py())]
    pairs, ends = list(zip(of("ids").tolist(), of("rows").tolist(), strict=True)), np.cumsum(of("sizes")).tolist()
    members = [pairs[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    return Graph(unit(x), of("levels"), links, row["entry"].as_py()), scaled(x), members


def nearest(df: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", shard: int = SHARD, width: int = SEARCH) -> DataFrame:
    """The ``k`` nearest vectors by cosine of each row whose id is divisible by ``every``.

    Returns (query_id, rank, id, score): nearest first, ties to the smaller id. A query's own row isn't among its
    results, another row with the same id is. Vectors that are null, zero or hold null or non-finite components
    and rows with a null id take no part; vectors of different length never meet. Every distinct vector is indexed, and
    found ones stand for their rows: a query that is itself one of them needs ``k + 1`` of each to lose none.
    """
    spark = df.sparkSession
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"  # floats are kept as such
    valid = df.where(F.col(id_col).isNotNull() & usable(vector)).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast(kind).alias("vector"))
    table, all_rows = written(valid.select(F.monotonically_increasing_id().alias("row"), "id", "vector"), "vectors")
    order = Window.partitionBy("vector").orderBy("id", "row")
    first = table.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    classes = first.groupBy("vector").agg(F.array_sort(F.collect_list(F.struct("id", "row"))).alias("members"))
    classes, distinct = written(classes.select(F.col("members")[0]["row"].alias("row"), "vector", "members"), "classes")
    asked = cut(table.where(F.col("id") % every == 0).withColumn("dim", F.size("vector")), "asked")
    drop_path(spark, all_rows)
    shards = max(1, -(-classes.count() // shard))
    index = cut(build_index(classes, shards), "hnsw")
    drop_path(spark, distinct)
    best = cut(_search(asked, index, shards, k, width), "nearest")
    sample = asked.orderBy(F.xxhash64("row"), "row").limit(AUDIT)
    recall = _recall(best, _search(sample, index, shards, k, None))
    _log.info("audited recall %.4f", recall)
    if recall < RECALL:
        _log.warning("audited recall %.4f is below %.2f: queries are compared with all vectors", recall, RECALL)
        best = _search(asked, index, shards, k, None)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true results' number that ``found`` has at the last true score or above."""
    last = truth.groupBy("row").agg(F.min("score").alias("last"), F.count("*").alias("n"))
    hits = last.join(found.select("row", "score"), "row", "left").groupBy("row", "n").agg(F.least(F.count_if(F.col("score") >= F.col("last") - 1e-12), F.col("n")).alias("hits"))
    got = hits.agg(F.sum("hits"), F.sum("n")).first()
    return got[0] / got[1] if got[1] else 1.0


def _dealt(asked: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Blocks of queries (kind 0) and shards (kind 1) by unit: a slab of queries and a group of shards, queries first.

    A query is there once a group, of which there are no more for more vectors, and a shard once a slab.
    """
    n = asked.count()
    blocks, slabs = max(1, -(-n // QUERY_BLOCK)), max(1, -(-n // SLAB))
    groups = min(shards, max(GROUPS, asked.sparkSession.sparkContext.defaultParallelism))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    in_blocks = asked.groupBy("dim", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("row", "id", "vector")).alias("queries"))
    queries = in_blocks.select("dim", "queries", F.lit(0).alias("kind"), (F.col("block") % slabs).alias("slab"), each(groups).alias("group"))
    graphs = index.select("*", F.lit(1).alias("kind"), (F.col("shard") % groups).alias("group"), each(slabs).alias("slab"))
    units = graphs.unionByName(queries, allowMissingColumns=True).withColumn("unit", F.col("group") * slabs + F.col("slab"))
    return units.drop("group", "slab").repartitionByRange(groups * slabs, "unit").sortWithinPartitions("unit", "kind")


def _search(asked: DataFrame, index: DataFrame, shards: int, k: int, width: int | None) -> DataFrame:
    """(row, query_id, id, score, rank) of queries (row, id, vector, dim) in every shard's graph, or without ``width`` among all its vectors."""

    def search(batches):
        unit_of, slab = None, {}
        for batch in batches:
            for one in range(batch.num_rows):
                row = {c: batch.column(c)[one] for c in batch.schema.names}
                if row["unit"].as_py() != unit_of:
                    unit_of, slab = row["unit"].as_py(), {}
                dim = row["dim"].as_py()
                if not row["kind"].as_py():
                    rows, ids, vectors = row["queries"].values.flatten()
                    slab.setdefault(dim, []).append((rows.to_pylist(), ids.to_pylist(), scaled(_doubles(vectors.flatten()).reshape(-1, dim))))
                elif dim in slab:
                    graph, x, members = _read(row, dim)
                    near, norms = graph.lists() if width else None, np.linalg.norm(x, axis=1)
                    for block in slab[dim]:
                        yield _found(graph, near, x, norms, members, *block, k, width)

    found = _dealt(asked, index, shards).mapInArrow(search, "row long, query_id long, id long, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _found(graph, near, x, norms, members, rows, ids, vectors, k, width) -> pa.RecordBatch:
    """The best ``k`` rows of a shard for each query of a block."""
    out = []
    for row, id, v, u in zip(rows, ids, vectors, unit(vectors), strict=True):
        found = [j for _, j in graph.search(near, u, width)] if width else range(len(x))
        exact = (x[found] if width else x) @ v / ((norms[found] if width else norms) * np.linalg.norm(v))
        last = np.partition(exact, -k - 1)[-k - 1] if len(exact) > k else -2  # one of the best may hold the query alone
        best = sorted((-float(exact[n]), i, r) for n in np.flatnonzero(exact >= last).tolist() for i, r in members[found[n]] if r != row)
        out += [(row, id, i, -s) for s, i, _ in best[:k]]
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["row", "query_id", "id", "score"])
