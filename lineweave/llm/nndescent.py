"""Embedding near-duplicates by NN-descent.

Every vector keeps a list of its most similar vectors. The lists start from random-hyperplane leaves; each round
joins neighbours of neighbours through their common neighbour and keeps what is better, until few lists change.
Links are list entries at the threshold or above. Where a list is saturated (its last entry still links), it is
enlarged to its whole saturated region, which is compared in blocks with itself and with every saturated region that
a bound on their angles can't rule out, so that large groups lose no link. Recall is audited against brute force on a
sample; if it is low, lists are doubled and refined again, and if doubling doesn't help, all vectors are compared.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, local_forest, whole_keys
from .hnsw import unit, usable

THRESHOLD = 0.93
LIST = 12
TREES = 4
#: Vectors compared at once: leaves, groups of neighbours and blocks of regions are split to this size.
LEAF, BLOCK = 64, 512
ROUNDS = 8
#: Rounds end when so small a share of the lists' entries is new.
STILL = 0.002
AUDIT, RECALL = 400, 0.97

_log = logging.getLogger(__name__)


def _codes(dims: int) -> np.ndarray:
    return np.random.default_rng(dims).normal(size=(dims, 15 * TREES))


def _leaf_codes(column: pa.Array) -> pa.Array:
    """For each tree, 15 signs of random projections."""
    out = []
    for v in column.to_pylist():
        x = np.array(v, np.float64)
        signs = (x @ _codes_of(len(x)) > 0).reshape(TREES, 15)
        out.append((signs @ (1 << np.arange(15))).tolist())
    return pa.array(out, pa.list_(pa.int64()))


_kept: dict[int, np.ndarray] = {}


def _codes_of(dims: int) -> np.ndarray:
    if dims not in _kept:
        _kept[dims] = _codes(dims)
    return _kept[dims]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(column), -1)) if len(column) else flat.reshape(0, 0)


def _groups(table: pa.Table, *keys: str):
    """Slices of a key-sorted table whose rows share the keys."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for key in keys:
        values = table.column(key).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    start = np.flatnonzero(change)
    return zip(start.tolist(), np.append(start[1:], table.num_rows).tolist(), strict=True)


def _compare(most: int):
    """In each group: for every member, the ``most`` most similar others that beat its list's last entry."""

    def compare(batches):
        for table in whole_keys(batches, "key"):
            found = []
            for a, b in _groups(table, "key"):
                if b - a < 2:
                    continue
                part = table.slice(a, b - a)
                ids, x = part.column("id").to_numpy(), _matrix(part.column("vec"))
                s = x @ x.T
                s[ids[:, None] == ids[None, :]] = -2
                if len(ids) > most:
                    floor = np.maximum(-np.partition(-s, most - 1, axis=1)[:, most - 1], -1)
                else:
                    floor = np.full(len(ids), -1.0)
                i, j = np.nonzero((s >= floor[:, None]) & (s > part.column("floor").to_numpy()[:, None]))
                found.append((ids[i], ids[j], s[i, j]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["id", "nbr", "sim"])

    return compare


def _meet(members: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(id, nbr, sim) found by comparing members (key, id) of each key; large keys are split by a hash."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > LEAF)
    dealt = members.join(sizes, "key", "left").withColumn("key", F.when(F.col("n").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("n") / LEAF)))))
    rows = dealt.select("key", "id").join(nodes.select("id", "vec", "floor"), "id").select("key", "id", "vec", "floor")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(most), "id long, nbr long, sim double")


def _best(edges: DataFrame, most: int) -> DataFrame:
    """The ``most`` most similar neighbours of each id; ``fresh`` stays only for entries that weren't there before."""
    once = edges.groupBy("id", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "nbr")
    return once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)


def _floors(nodes: DataFrame, lists: DataFrame, most: int) -> DataFrame:
    full = lists.where(F.col("n") == most).select("id", F.col("sim").alias("last"))
    return nodes.drop("floor").join(full, "id", "left").withColumn("floor", F.coalesce("last", F.lit(-2.0))).drop("last")


def neighbour_lists(nodes: DataFrame, most: int = LIST, rounds: int = ROUNDS, start: DataFrame | None = None) -> DataFrame:
    """(id, nbr, sim, n) after NN-descent over nodes (id, grp, vec); only vectors of one ``grp`` are compared."""
    nodes = nodes.withColumn("floor", F.lit(-2.0))
    if start is None:
        sizes = nodes.groupBy("grp").agg(F.count("*").alias("size"))
        bits = F.least(F.lit(15), F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / LEAF)))).cast("int")
        coded = nodes.join(sizes, "grp").select("id", "grp", bits.alias("bits"), F.posexplode(F.arrow_udf(_leaf_codes, "array<long>")("vec")).alias("tree", "code"))
        low = F.col("code") % F.pow(F.lit(2.0), F.col("bits")).cast("long")
        start = _meet(coded.select("id", F.xxhash64("grp", "tree", low).alias("key")), nodes, most)
    now = cut(_best(start.select("id", "nbr", "sim").withColumn("fresh", F.lit(1)), most), "lists")
    total = max(1, nodes.count()) * most
    for turn in range(rounds):
        both = now.select(F.col("nbr").alias("key"), "id").unionByName(now.select(F.col("id").alias("key"), F.col("nbr").alias("id")))
        members = both.unionByName(now.select(F.col("id").alias("key"), "id")).distinct()
        better = _meet(members, _floors(nodes, now, most), most)
        now = cut(_best(now.select("id", "nbr", "sim", F.lit(0).alias("fresh")).unionByName(better.withColumn("fresh", F.lit(1))), most), "lists")
        new = now.where("fresh = 1").count()
        _log.info("round %d: %d of %d entries are new", turn + 1, new, total)
        if new <= STILL * total:
            break
    return now.select("id", "nbr", "sim", "n")


def _sized(members: DataFrame) -> DataFrame:
    """Members (region, id) with their region's number of blocks and their own block."""
    sizes = members.groupBy("region").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    return members.join(sizes, "region").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))


def _count(rows: DataFrame, nodes: DataFrame, threshold: float, edges: str) -> DataFrame:
    """(id, links, other) for rows (key, own, id): each key compares its one block with itself, or its two with each other.

    Rows with ``other`` are edges, and count no links: with ``edges`` "all" they connect all that a key links, with
    "one" there is one for each key that links anything.
    """
    rows = rows.join(nodes.select("id", "vec", "copies"), "id").select("key", "own", "id", "vec", "copies")

    def count(batches):
        for table in whole_keys(batches, "key"):
            out = []
            for a, b in _groups(table, "key"):
                part = table.slice(a, b - a)
                who, own, copies = (part.column(c).to_numpy() for c in ("id", "own", "copies"))
                x = _matrix(part.column("vec"))
                s = x @ x.T >= threshold
                s[who[:, None] == who[None, :]] = False
                if own.min() != own.max():  # two blocks meet; each within itself has its own key
                    s[own[:, None] == own[None, :]] = False
                out.append((who, s @ copies, np.full(len(who), -1)))
                if edges == "one" and s.any():
                    i, j = np.unravel_index(s.argmax(), s.shape)
                    out.append((who[[i]], np.zeros(1, np.int64), who[[j]]))
                elif edges == "all":
                    i, j = np.nonzero(s)
                    src, dst = local_forest(who[i], who[j])
                    out.append((src, np.zeros(len(src), np.int64), dst))
            if out:
                ids, links, other = (np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(other, mask=other < 0)], ["id", "links", "other"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(count, "id long, links long, other long")


def _within_regions(members: DataFrame, nodes: DataFrame, threshold: float, edges: str = "none") -> DataFrame:
    """:func:`_count` of members (region, id) with the others of their region, in blocks."""
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = _sized(members).withColumn("other", other)
    rows = rows.select("id", "own", F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
    return _count(rows, nodes, threshold, edges)


def _angles(a: pa.Array, b: pa.Array) -> pa.Array:
    """The angle between the vectors of two columns."""
    out = []
    for v, w in zip(a.to_pylist(), b.to_pylist(), strict=True):
        x, y = unit(np.array([v], np.float64))[0], unit(np.array([w], np.float64))[0]
        out.append(float(np.arccos(np.clip(x @ y, -1, 1))))
    return pa.array(out, pa.float64())


def _close_regions(members: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a < b: regions of one ``grp`` that may hold vectors at the threshold.

    A region is named after one of its members; no member is further from it than the region's radius. By the
    triangle inequality vectors of two regions link only if the named ones are within both radii and the threshold's angle.
    """
    named = nodes.select(F.col("id").alias("region"), "grp", F.col("vec").alias("middle"))
    spread = members.join(nodes.select("id", "vec"), "id").join(named.select("region", "middle"), "region")
    radius = spread.select("region", F.arrow_udf(_angles, "double")("vec", "middle").alias("angle")).groupBy("region").agg(F.max("angle").alias("radius"))
    regions = cut(radius.join(named, "region"), "radii")
    sized = _sized(regions.select(F.col("grp").alias("region"), F.col("region").alias("id")).distinct()).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = sized.select("id", "own", F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
    rows = keyed.join(regions.select(F.col("region").alias("id"), F.col("middle").alias("vec"), "radius"), "id").select("key", "own", "id", "vec", "radius")
    reach = float(np.arccos(threshold)) + 1e-6  # more than the angles' rounding errors

    def close(batches):
        for table in whole_keys(batches, "key"):
            found = []
            for a, b in _groups(table, "key"):
                part = table.slice(a, b - a)
                who, own, radius = (part.column(c).to_numpy() for c in ("id", "own", "radius"))
                x = _matrix(part.column("vec"))
                near = np.arccos(np.clip(x @ x.T, -1, 1)) <= radius[:, None] + radius[None, :] + reach
                near &= who[:, None] < who[None, :]
                if own.min() != own.max():
                    near &= own[:, None] != own[None, :]
                i, j = np.nonzero(near)
                found.append((who[i], who[j]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(close, "a long, b long")


def _between_regions(members: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """:func:`_count` of members (region, id) with those of other regions, in blocks; regions that are too far apart are left out."""
    pairs = cut(_close_regions(members, nodes, threshold), "pairs")
    sized = cut(_sized(members), "members")
    parts = sized.select("region", "parts").distinct()
    both = pairs.join(parts.select(F.col("region").alias("a"), F.col("parts").alias("parts_a")), "a").join(parts.select(F.col("region").alias("b"), F.col("parts").alias("parts_b")), "b")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
    left = both.select("a", "b", each("parts_b")).join(sized.withColumnRenamed("region", "a"), "a").select("id", F.lit(0).alias("own"), F.xxhash64("a", "b", "own", "other").alias("key"))
    right = both.select("a", "b", each("parts_a")).join(sized.withColumnRenamed("region", "b"), "b").select("id", F.lit(1).alias("own"), F.xxhash64("a", "b", "other", "own").alias("key"))
    return _count(left.unionByName(right), nodes, threshold, "one")


def _edges(counted: DataFrame) -> DataFrame:
    return counted.where("other is not null").select(F.col("id").alias("src"), F.col("other").alias("dst"))


def _links(nodes: DataFrame, lists: DataFrame, most: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, links) and the (src, dst) edges that connect what is linked."""
    near = lists.where(F.col("sim") >= threshold)
    saturated = near.where(F.col("n") == most).select("id")
    full = cut(saturated, "saturated")
    inner = near.select("id", "nbr").join(full, "id", "left_semi").join(full.withColumnRenamed("id", "nbr"), "nbr", "left_semi")
    reached = cut(components(inner.select(F.col("id").alias("src"), F.col("nbr").alias("dst"))), "regions")
    # what no edge reaches is the smallest node of its region, or alone in it
    region = cut(full.withColumnRenamed("id", "node").join(reached, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "regions")
    both = near.select("id", "nbr").unionByName(near.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"))).distinct()
    # pairs of saturated vectors are compared below
    outer = both.join(full.withColumn("a", F.lit(True)), "id", "left").join(full.select(F.col("id").alias("nbr"), F.lit(True).alias("b")), "nbr", "left").where("a is null or b is null")
    listed = outer.join(nodes.select(F.col("id").alias("nbr"), "copies"), "nbr").groupBy("id").agg(F.sum("copies").alias("links"))
    members = region.select(F.col("component").alias("region"), F.col("node").alias("id"))
    between = cut(_between_regions(members, nodes, threshold), "between")
    counted = _within_regions(members, nodes, threshold).unionByName(between).groupBy("id").agg(F.sum("links").alias("links"))
    total = listed.unionByName(counted).groupBy("id").agg(F.sum("links").alias("links"))
    return cut(total, "links"), near.select(F.col("id").alias("src"), F.col("nbr").alias("dst")).unionByName(_edges(between))


def _all_links(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """What :func:`_links` returns, from comparing all vectors of each ``grp``."""
    counted = cut(_within_regions(nodes.select(F.col("grp").alias("region"), "id"), nodes, threshold, "all"), "counted")
    return cut(counted.groupBy("id").agg(F.sum("links").alias("links")), "links"), _edges(counted)


def audit(nodes: DataFrame, links: DataFrame, threshold: float = THRESHOLD, sample: int = AUDIT) -> float:
    """Share of the links of a bounded sample of vectors, found by brute force, that ``links`` has."""
    taken = nodes.orderBy(F.xxhash64(F.lit(17), F.col("id")), "id").limit(sample)
    rows = [(r.id, r.grp, list(r.vec)) for r in taken.collect()]
    if not rows:
        return 1.0
    by: dict[int, list] = {}
    for i, g, v in rows:
        by.setdefault(g, []).append((i, v))
    shipped = nodes.sparkSession.sparkContext.broadcast({g: ([i for i, _ in m], unit(np.array([v for _, v in m], np.float64))) for g, m in by.items()})

    def brute(batches):
        total: dict[int, int] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by("grp")
            for a, b in _groups(table, "grp"):
                ids, x = shipped.value.get(table.column("grp")[a].as_py(), ([], None))
                if ids:
                    part = table.slice(a, b - a)
                    s = (x @ _matrix(part.column("vec")).T >= threshold) & (np.array(ids)[:, None] != part.column("id").to_numpy()[None, :])
                    for i, n in zip(ids, (s @ part.column("copies").to_numpy()).tolist(), strict=True):
                        total[i] = total.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["id", "truth"])

    truth = nodes.select("id", "grp", "vec", "copies").mapInArrow(brute, "id long, truth long").groupBy("id").agg(F.sum("truth").alias("truth"))
    got = truth.join(links, "id", "left").agg(F.sum(F.least("truth", F.coalesce("links", F.lit(0)))), F.sum("truth")).first()
    return float(got[0]) / got[1] if got[1] else 1.0


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: id, ``n_links``, ``component_id``, ``kept`` (id = component_id).

    Vectors are compared only when their labels are equal and not null, and their lengths. Vectors that are null,
    zero or hold null or non-finite components link with nothing, nor do rows with a null id; their component is
    themselves. Equal vectors are compared once and counted as often as they come. ``n_links`` counts other rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vec"), F.col(label).alias("label"))
    rows = rows.withColumn("ok", F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vec"))
    classes = rows.where("ok").groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    # the row's own number tells apart different vectors that share an id
    classes = classes.withColumn("at", F.monotonically_increasing_id())
    classes = cut(classes.select("label", "vec", "rep", "copies", "at"), "vectors")
    nodes = classes.select(F.col("at").alias("id"), F.xxhash64("label", F.size("vec")).alias("grp"), "vec", "copies")
    most, lists = LIST, None
    while True:
        lists = neighbour_lists(nodes, most, start=lists)
        links, edges = _links(nodes, lists, most, threshold)
        recall = audit(nodes, links, threshold)
        _log.info("lists of %d: audited recall %.4f", most, recall)
        if recall >= RECALL:
            break
        if most >= 4 * LIST:
            _log.warning("lists of %d: audited recall %.4f is below %.2f; all vectors are compared", most, recall, RECALL)
            links, edges = _all_links(nodes, threshold)
            break
        most *= 2
    reach = components(edges)
    found = classes.select("at", "rep", "copies").join(links.withColumnRenamed("id", "at"), "at", "left").join(reach.withColumnRenamed("node", "at"), "at", "left")
    found = found.withColumn("component", F.coalesce("component", "at"))
    least = found.groupBy("component").agg(F.min("rep").alias("component_id"))
    result = found.join(least, "component").select("at", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = classes.select(F.col("label"), F.col("vec"), "at").join(result, "at").drop("at").withColumn("ok", F.lit(True))
    out = rows.join(named, ["label", "vec", "ok"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
