"""Hash chains, provenance, lineage, regions' history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_hash, canonical_json, canonical_text
from ..functions.shared import drop, written, written_at


def chain(entries: DataFrame, scope: str, order: str, payload: list[str]) -> DataFrame:
    """Entries with ``sequence`` from 0, ``state_hash`` of the payload, and ``previous_hash``, null for the first."""
    by = Window.partitionBy(scope).orderBy(order)
    state = canonical_hash(**{c: F.col(c) for c in payload})
    out = entries.withColumns({"sequence": F.row_number().over(by) - 1, "state_hash": state})
    return out.withColumn("previous_hash", F.lag("state_hash").over(Window.partitionBy(scope).orderBy("sequence")))


def verify_chain(entries: DataFrame, scope: str, payload: list[str]) -> DataFrame:
    """(scope, entries, valid, first_bad): recomputed hashes, links to the entry before, sequences without a gap."""
    by = Window.partitionBy(scope).orderBy("sequence")
    good = (
        (F.col("state_hash") == canonical_hash(**{c: F.col(c) for c in payload}))
        & F.col("previous_hash").eqNullSafe(F.lag("state_hash").over(by))
        & (F.col("sequence") == F.row_number().over(by) - 1)
    )
    checked = entries.withColumn("good", F.coalesce(good, F.lit(False)))
    return checked.groupBy(scope).agg(F.count("*").alias("entries"), F.every("good").alias("valid"), F.min(F.when(~F.col("good"), F.col("sequence"))).alias("first_bad"))


def provenance_hash(history: Column, version: Column) -> Column:
    """The hash of a provenance record without its own hash field; the keys of its steps are sorted too."""
    record = canonical_json(history=history, provenance_version=version)
    return F.sha2(canonical_text(record).cast("binary"), 256)


def append_provenance(records: DataFrame, step: Column) -> DataFrame:
    """Records (provenance_version, history, provenance_hash) with one more step and the hash anew."""
    longer = records.withColumn("history", F.array_append("history", step))
    return longer.withColumn("provenance_hash", provenance_hash(F.col("history"), F.col("provenance_version")))


def valid_provenance(history: Column) -> Column:
    """Whether every step names step, actor, action and time; no history is valid."""
    return F.coalesce(F.forall(history, lambda h: h.step.isNotNull() & h.actor.isNotNull() & h.action.isNotNull() & h.generated_at.isNotNull()), F.lit(True))


def lineage_errors(kind: Column, lineage_id: Column, parent: Column) -> Column:
    """What is wrong with a lineage: root has an id and no parent, derived both, detached neither."""
    rules = [
        (~kind.isin("root", "derived", "detached") | kind.isNull(), "unknown lineage type"),
        ((kind == "root") & lineage_id.isNull(), "root without id"),
        ((kind == "root") & parent.isNotNull(), "root with parent"),
        ((kind == "derived") & lineage_id.isNull(), "derived without id"),
        ((kind == "derived") & parent.isNull(), "derived without parent"),
        ((kind == "detached") & (lineage_id.isNotNull() | parent.isNotNull()), "detached with lineage"),
    ]
    return F.array_compact(F.array(*(F.when(test, text) for test, text in rules)))


def choose_lineage(parent: Column, parent_lineage: Column, own: Column, detached: Column) -> Column:
    """The lineage of a new artifact: detached if asked for, derived with a parent, else a root of its own."""
    as_struct = lambda k, i, p: F.struct(F.lit(k).alias("type"), i.cast("string").alias("lineage_id"), p.cast("string").alias("parent"))
    none = F.lit(None)
    return F.when(detached, as_struct("detached", none, none)).when(parent.isNotNull(), as_struct("derived", F.coalesce(parent_lineage, own), parent)).otherwise(as_struct("root", own, none))


def walk(artifacts: DataFrame, starts: DataFrame, node: str = "hash", parent: str = "parent", depth: int | None = None) -> DataFrame:
    """(start, node, depth): the artifacts on the way from each start to its root, through parent pointers.

    Pointer doubling over all starts at once, however long a lineage is. A missing parent ends a walk, a node that it
    has met ends a cycle. With ``depth`` it goes so many steps at most, round a cycle too.
    """
    own = artifacts.select(F.col(node).alias("node"), F.col(parent).alias("up"))
    known = written(own.select("node").where("node is not null").distinct(), "artifacts")
    jump = written(own.join(known.withColumnRenamed("node", "up"), "up", "left_semi").select("node", "up").distinct(), "jumps")
    begun = starts.select(F.col(node).alias("start")).distinct().join(known.withColumnRenamed("node", "start"), "start", "left_semi")
    now = written(begun.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")), "walks")
    most, step = known.count() - 1 if depth is None else depth, 1
    while step <= most and jump.limit(1).count():
        further = now.join(jump, "node").select("start", F.col("up").alias("node"), (F.col("depth") + step).alias("depth")).where(F.col("depth") <= most)
        both = now.unionByName(further)
        now = written(both.groupBy("start", "node").agg(F.min("depth").alias("depth")) if depth is None else both.distinct(), "walks")
        jump = written(jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up")).distinct(), "jumps")
        step *= 2
    return now


def approved_keys(keys: DataFrame, approvals: DataFrame) -> DataFrame:
    """(key_id, depth): the first key is trusted, others if a trusted key has signed them; ``keys`` has ord.

    A key with a single signer is as far behind it as the signer is from the root, so chains of them are followed by
    pointer doubling to their heads; only between heads, which are the root and keys with several signers, distances go round
    by round. A cycle that no trusted key signs into isn't reached.
    """
    spark = keys.sparkSession
    root = keys.agg(F.min_by("key_id", "ord").alias("key_id")).where("key_id is not null")
    signed = approvals.where("key_id is not null and signer is not null and key_id != signer").select("signer", "key_id").distinct().join(F.broadcast(root), "key_id", "left_anti")  # one row
    signed, signed_at = written_at(signed, "approvals")
    single = signed.groupBy("key_id").agg(F.count("*").alias("n"), F.min("signer").alias("up")).where("n = 1").select("key_id", "up", F.lit(1).alias("steps"))
    chains, chains_at = written_at(single.join(single.select(F.col("key_id").alias("up"), F.lit(False).alias("done")), "up", "left").select("key_id", "up", "steps", F.coalesce("done", F.lit(True)).alias("done")), "chains")
    ahead = chains.where("not done").count()
    for _ in range(ahead.bit_length() + 1):
        if not chains.where("not done").limit(1).count():
            break
        further = chains.select(F.col("key_id").alias("up"), F.col("up").alias("top"), F.col("steps").alias("more"), F.col("done").alias("ended"))
        moved = chains.where("not done").join(further, "up").select("key_id", F.col("top").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ended").alias("done"))
        old, (chains, chains_at) = chains_at, written_at(chains.where("done").unionByName(moved), "chains")
        drop(spark, old)
    # what isn't done by now goes round in a cycle
    behind, behind_at = written_at(chains.where("done").select("key_id", F.col("up").alias("head"), "steps"), "behind")
    several = signed.join(single.select("key_id"), "key_id", "left_anti")
    reach = several.join(behind.withColumnRenamed("key_id", "signer"), "signer", "left").select(F.coalesce("head", "signer").alias("head"), "key_id", (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    in_cycle = several.select("signer").join(single.select(F.col("key_id").alias("signer")), "signer", "left_semi").join(behind.select(F.col("key_id").alias("signer")), "signer", "left_anti").distinct()
    links, links_at = written_at(reach.join(in_cycle.withColumnRenamed("signer", "head"), "head", "left_anti").groupBy("head", "key_id").agg(F.min("steps").alias("steps")), "links")
    depths, depths_at = written_at(root.withColumn("depth", F.lit(0)).withColumn("new", F.lit(True)), "depths")
    while depths.where("new").limit(1).count():
        near = depths.where("new").select(F.col("key_id").alias("head"), "depth").join(links, "head").groupBy("key_id").agg(F.min(F.col("depth") + F.col("steps")).alias("better"))
        both = depths.select("key_id", "depth").join(near, "key_id", "full")
        better = F.coalesce(F.col("better") < F.col("depth"), F.col("depth").isNull())
        old, (depths, depths_at) = depths_at, written_at(both.select("key_id", F.least("depth", "better").alias("depth"), better.alias("new")), "depths")
        drop(spark, old)
    rest = behind.join(depths.select(F.col("key_id").alias("head"), "depth"), "head").select("key_id", (F.col("depth") + F.col("steps")).alias("depth"))
    found = written(depths.select("key_id", "depth").unionByName(rest), "reached")
    drop(spark, signed_at, chains_at, behind_at, links_at, depths_at)
    return found


def revisions(states: DataFrame, scope: str, order: str, semantic: list[str]) -> DataFrame:
    """States with ``revision``: 1 at first and after an absence, one more whenever the semantic fields change.

    ``states`` has a row for each region and snapshot ``order`` that it is present in, snapshots numbered without a gap.
    """
    by = Window.partitionBy(scope).orderBy(order)
    key = F.struct(*semantic)
    seen = F.lag(F.col(order)).over(by)
    started = F.sum(F.when(seen.isNull() | (seen != F.col(order) - 1), 1).otherwise(0)).over(by)
    out = states.withColumn("_run", started)
    inside = Window.partitionBy(scope, "_run").orderBy(order)
    out = out.withColumn("_new", F.when(F.lag(key).over(inside).isNull(), 0).when(~F.lag(key).over(inside).eqNullSafe(key), 1).otherwise(0))
    return out.withColumn("revision", F.sum("_new").over(inside) + 1).drop("_run", "_new")
