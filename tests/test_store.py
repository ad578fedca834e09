"""The artifact store as a data source: conditions, two-phase writes, the feed's restarts."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from lineweave.operators import registry
from lineweave.sources import store

T = datetime.datetime(2024, 1, 1, 12)


def rows(spark, items):
    return spark.createDataFrame([(h, T + datetime.timedelta(seconds=s), t, None, 1) for h, s, t in items], store.SCHEMA)


@pytest.fixture
def path(spark, tmp_path):
    store.register(spark)
    return str(tmp_path / "store")


def save(df, path, mode="append"):
    df.write.format("artifacts").option("path", path).mode(mode).save()


def load(spark, path):
    return store.opened(spark, path)


def test_pages_and_prefixes(spark, path):
    assert load(spark, path).count() == 0
    items = [(f"{i % 16:x}{i:03d}", i // 3, "plan" if i % 2 else "scan") for i in range(300)]
    save(rows(spark, items).repartition(3), path)
    save(rows(spark, [("zz", 5, None)]), path)
    whole = rows(spark, [*items, ("zz", 5, None)])
    plain = lambda df: [tuple(r) for r in df.collect()]
    assert sorted(map(repr, plain(load(spark, path)))) == sorted(map(repr, plain(whole)))
    for kind, prefix in (("plan", "a"), (None, "b0"), ("scan", None), ("none", None), (None, "zz"), (None, "~")):
        assert plain(registry.search(load(spark, path), kind, prefix, offset=2)) == plain(registry.search(whole, kind, prefix, offset=2))
    assert plain(registry.feed(load(spark, path), T + datetime.timedelta(seconds=5), "3")) == plain(registry.feed(whole, T + datetime.timedelta(seconds=5), "3"))
    assert plain(load(spark, path).where("hash = 'zz' and size = 1")) == plain(whole.where("hash = 'zz'"))


def test_conditions_reach_the_reader(spark, path):
    save(rows(spark, [("aa", 1, "plan"), ("ab", 2, "plan")]).coalesce(1), path)
    save(rows(spark, [("ba", 1, "scan"), ("bb", 2, "scan")]).coalesce(1), path)
    asked = lambda condition: load(spark, path).where(condition)
    assert [asked(c).rdd.getNumPartitions() for c in ("hash like 'a%'", "type = 'scan'", "hash = 'bb'", "size = 1")] == [1, 1, 1, 2]
    plan = asked("hash like 'a%' and size > 0")._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith(hash" not in plan.split("BatchScan")[0] and "size" in plan.split("BatchScan")[0]
    reader = store.Reader(path, True)
    assert list(reader.pushFilters([store.EqualTo(("type",), "scan"), store.StringStartsWith(("type",), "s")])) == [store.StringStartsWith(("type",), "s")]
    assert len(reader.partitions()) == 1


def test_a_table_that_is_read_twice(spark, path):
    save(rows(spark, [("aa", 1, "plan"), ("ab", 2, "scan"), ("ba", 3, "plan")]).coalesce(1), path)
    some = lambda df, prefix: df.where(F.startswith("hash", F.lit(prefix)))
    plainly = spark.read.format("artifacts").option("path", path).load()
    for one, other in ((plainly, plainly), (load(spark, path), load(spark, path))):
        both = some(one, "a").unionByName(some(other, "b"))
        assert sorted(r.hash for r in both.collect()) == ["aa", "ab", "ba"]
        assert some(one, "a").join(other.where("type = 'scan'").select("hash"), "hash").count() == 1


def test_an_aborted_write_leaves_nothing(spark, path):
    save(rows(spark, [("aa", 1, "plan")]), path)
    files = lambda: sorted(f for _, _, names in os.walk(path) for f in names if not f.endswith(".crc"))
    before = files()
    fails = F.when(F.col("size") < 900, F.lit(1)).otherwise(F.raise_error(F.lit("stop")).cast("int")).cast("long")
    wide = spark.range(0, 1000, 1, 4).select(F.concat(F.lit("x"), "id").alias("hash"), F.lit(T).alias("ts"), F.lit("t").alias("type"), F.lit(None).cast("string").alias("parent"), F.col("id").alias("size"))
    with pytest.raises(Exception, match="stop"):
        save(wide.withColumn("size", fails), path)
    with pytest.raises(Exception, match="needs a hash"):
        save(wide.withColumn("hash", F.when(F.col("size") != 999, F.col("hash"))), path)
    assert files() == before
    assert load(spark, path).count() == 1 and store.Folder(path).orphans() == []


def test_overwriting(spark, path):
    save(rows(spark, [("aa", 1, "plan")]), path)
    save(rows(spark, [("bb", 1, "plan")]), path, "overwrite")
    assert [r.hash for r in load(spark, path).collect()] == ["bb"]
    assert len(store.Folder(path).orphans()) == 1
    save(rows(spark, []), path, "overwrite")
    assert load(spark, path).count() == 0


def test_a_feed_restarts_between_tied_times(spark, path, tmp_path):
    save(rows(spark, [("b", 0, "t"), ("a", 0, "t"), ("c", 1, "t")]), path)
    out, fail = [], [False]

    def take(batch, n):
        got = [r.hash for r in batch.orderBy("ts", "hash").collect()]
        if fail[0]:
            fail[0] = False
            raise RuntimeError("lost")
        out.append((n, got))

    def go():
        stream = spark.readStream.format("artifacts").option("path", path).load()
        q = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    go()
    assert out == [(0, ["a", "b", "c"])]
    save(rows(spark, [("d", 1, "t"), ("e", 1, "t"), ("f", 2, "t")]), path)  # of the time at which the reader stands
    fail[0] = True
    with pytest.raises(Exception, match="lost"):
        go()
    save(rows(spark, [("g", 3, "t")]), path)
    go()
    assert out[1:] == [(1, ["d", "e", "f"]), (2, ["g"])]
    go()
    assert len(out) == 3
