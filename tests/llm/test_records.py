"""Vectors and conversations against brute force."""

import json

import numpy as np
import pytest

from lineweave.llm import hnsw, nndescent, toolcalls

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vec string, component long, shard int"


def make(spark, rows):
    return spark.createDataFrame([(i, [float(x) if x is not None else None for x in v] if v is not None else None, label, 1, "v", 2, 3) for i, v, label in rows], SCHEMA)


def vectors():
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16), int(i % 3)) for i in range(240)]
    for i in range(40):  # close pairs
        rows.append((300 + i, rows[i][1] + rng.normal(size=16) * 0.05, rows[i][2]))
    heart = rng.normal(size=16)
    rows += [(400 + i, heart + rng.normal(size=16) * 0.1, 1) for i in range(90)]  # a group larger than any list
    rows += [(500 + i, rows[7][1], rows[7][2]) for i in range(30)]  # copies
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] + [1.0] * 15, 1), (603, [None] + [1.0] * 15, 1), (604, [float("inf")] * 16, 1), (605, rows[0][1], None), (606, [1.0, 2.0], 1), (607, [], 1), (None, heart, 1)]
    return rows


def plain(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def as_float(v):
    return np.array(v, np.float32).astype(np.float64)


def test_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "BLOCK", 32)
    rows = vectors()
    got = {r.vec_id: r for r in nndescent.near_duplicates(make(spark, rows)).collect()}
    assert len(got) == len(rows)
    use = [(i, as_float(v), label) for i, v, label in rows if i is not None and label is not None and plain(v)]
    links = {i: set() for i, *_ in rows if i is not None}
    for a, (i, v, label) in enumerate(use):
        for j, w, other in use[:a]:
            if label == other and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links[i].add(j)
                links[j].add(i)
    root = dict.fromkeys(links)
    for i in sorted(links):
        if root[i] is None:
            todo = [i]
            while todo:
                j = todo.pop()
                if root[j] is None:
                    root[j] = i
                    todo += links[j]
    assert max(map(len, links.values())) > 60
    for i in links:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), root[i], root[i] == i), i
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)


def saturated_groups():
    """Two groups of one label that fill every list, with links between them that no list holds."""
    rng = np.random.default_rng(5)
    a = np.eye(16)[0]
    b = 0.945 * a + np.sqrt(1 - 0.945**2) * np.eye(16)[1]
    x = [c + rng.normal(size=16) * 0.012 for c in (a, b) for _ in range(70)]
    far = [rng.normal(size=16) for _ in range(20)]
    return [(i, v, 1) for i, v in enumerate([*x, *far])]


@pytest.mark.parametrize("recall", [nndescent.RECALL, 2])
def test_saturated_groups_that_link_only_to_each_other(spark, monkeypatch, recall):
    monkeypatch.setattr(nndescent, "BLOCK", 32)
    monkeypatch.setattr(nndescent, "RECALL", recall)  # no audit reaches 2: all vectors are compared
    rows = saturated_groups()
    x = np.array([as_float(v) / np.linalg.norm(as_float(v)) for _, v, _ in rows])
    true = (x @ x.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    assert true[:70, :70].sum() == 70 * 69 and 1000 < true[:70, 70:140].sum()
    assert np.sort(x[:70] @ x[:70].T, axis=1)[:, -50].min() > (x[:70] @ x[70:140].T).max()
    got = {r.vec_id: r for r in nndescent.near_duplicates(make(spark, rows)).collect()}
    assert [got[i].n_links for i in range(len(rows))] == true.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(rows))] == [0] * 140 + list(range(140, 160))


def test_links_of_nothing(spark):
    assert nndescent.near_duplicates(make(spark, [])).count() == 0
    assert [tuple(r) for r in nndescent.near_duplicates(make(spark, [(3, None, 1)])).collect()] == [(3, 0, 3, True)]


def test_nearest_matches_brute_force(spark):
    rows = vectors() + [(0, vectors()[1][1], 0)]  # another row of a query's id
    got = {}
    for r in hnsw.nearest(make(spark, rows), every=50, shard=120).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    use = [(n, i, as_float(v)) for n, (i, v, _) in enumerate(rows) if i is not None and plain(v)]
    hits = total = 0
    for n, i, v in use:
        if i % 50 or i == 0:
            continue
        exact = sorted((-(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), j) for m, j, w in use if m != n and len(w) == len(v))[:5]
        mine = sorted(got[i])
        assert [x[0] for x in mine] == list(range(1, 6))
        hits += len({j for _, j in exact} & {x[1] for x in mine})
        total += 5
        assert mine[0][2] == pytest.approx(-exact[0][0], abs=1e-12)
    assert hits / total >= 0.95
    assert len(got[0]) == 10
    assert hnsw.nearest(make(spark, [])).count() == 0
    assert hnsw.nearest(make(spark, [(50, [1.0, 0.0], 1)])).count() == 0
    few = hnsw.nearest(make(spark, [(50, [1.0, 0.0], 1), (2, [1.0, 1.0], 1), (1, [1.0, 1.0], 1)])).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]


def test_nearest_with_a_third_of_copies(spark):
    rng = np.random.default_rng(3)
    hub = rng.normal(size=16)
    rows = [(i, hub + rng.normal(size=16) * (0.2 if i % 3 == 1 else 1) if i % 3 else hub, 1) for i in range(900)]
    rows = [rows[i] for i in np.random.default_rng(7).permutation(900)]
    got = {}
    for r in hnsw.nearest(make(spark, rows), every=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    x = {i: as_float(v) / np.linalg.norm(as_float(v)) for i, v, _ in rows}
    hits = total = 0
    for i in range(0, 900, 50):
        exact = [j for _, j in sorted((-round(float(x[i] @ x[j]), 12), j) for j in x if j != i)[:5]]
        mine = [j for _, j in sorted(got[i])]
        assert len(mine) == 5
        if i % 3 == 0:
            assert mine == exact == [j for j in range(0, 21, 3) if j != i][:5]
        hits += len(set(mine) & set(exact))
        total += 5
    assert hits / total >= 0.95


MESSAGES = "conv_id long, pos long, role string, content string, call_id string, after_id string, name string, arguments map<string,string>, reply_to string, depth int, status string"


def test_tool_calls(spark):
    call = lambda c, p, i, after, name, args: (c, p, "assistant", None, i, after, name, args, None, 0, "x")
    result = lambda c, p, to, text: (c, p, "tool", text, None, None, None, None, to, 0, "x")
    rows = [
        result(1, 0, "a", 'r"\n\x01é'), call(1, 1, "a", None, "reply", {"prompt": 'q\t"', "turn": "3"}), call(1, 2, "b", "a", "reply", {"turn": "x", "prompt": "p"}),
        result(1, 3, "b", "ok"), result(1, 4, "b", "again"), result(1, 5, "zz", "lost"), call(1, 6, "a", None, "reply", {"prompt": "p"}), call(1, 7, "c", None, "other", {}), call(1, 8, "d", None, None, None),
        call(2, 0, "x", "y", "reply", {"prompt": "p", "turn": "1"}), call(2, 1, "y", "x", "reply", {"prompt": None, "turn": "1"}), (2, 2, "user", "hi", None, None, None, None, None, 0, "x"), (None, None, None, None, None, None, None, None, None, 0, "x"),
    ]
    out = toolcalls.link(spark.createDataFrame(rows, MESSAGES), toolcalls.schemas(spark)).collect()
    by = {(r.conv_id, r.pos): r for r in out}
    assert len(out) == len(rows)
    assert [by[1, p].status for p in range(9)] == ["linked", "call", "call", "linked", "duplicate", "orphan", "duplicate", "call", "call"]
    assert [by[2, p].status for p in range(3)] == ["cycle", "cycle", "message"]
    assert [by[1, p].depth for p in range(4)] == [1, 0, 1, 2]
    assert by[1, 1].place < by[1, 0].place < by[1, 3].place and by[1, 2].place < by[1, 3].place
    assert [by[1, p].valid for p in (1, 2, 6, 7, 8)] == [True, False, False, False, False] and by[2, 1].valid is False
    for r in out:
        value = json.loads(r.json)
        assert json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
    assert json.loads(by[1, 1].json)["arguments"] == {"prompt": 'q\t"', "turn": 3}
    assert json.loads(by[1, 0].json)["content"] == 'r"\n\x01é' and json.loads(by[None, None].json)["role"] is None
    assert toolcalls.link(spark.createDataFrame([], MESSAGES), toolcalls.schemas(spark)).count() == 0


def test_long_chains_take_few_rounds(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(700)], "row long, parent long")
    assert {r.row: r.depth for r in toolcalls.depths(nodes).collect()} == {i: i for i in range(700)}


def test_conversations_as_calls(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (1, 3, "assistant", "no"), (2, 0, "system", "s"), (2, 1, "user", "q"), (2, 2, "assistant", "a")]
    out = toolcalls.link(toolcalls.as_calls(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")), toolcalls.schemas(spark))
    got = {(r.conv_id, r.pos): (r.status, r.depth, r.valid) for r in out.collect()}
    assert got == {(1, 0): ("call", 0, True), (1, 1): ("linked", 1, None), (1, 2): ("call", 1, False), (1, 3): ("linked", 2, None), (2, 0): ("message", 0, None), (2, 1): ("call", 0, True), (2, 2): ("linked", 1, None)}


@pytest.mark.parametrize("recall", [hnsw.RECALL, 2])
def test_nearest_of_large_and_small_components(spark, monkeypatch, recall):
    monkeypatch.setattr(hnsw, "RECALL", recall)  # no audit reaches 2: queries meet all vectors
    rows = [(50, [1e200, 1e200]), (1, [1e200, 0.9e200]), (2, [1.0, 0.0]), (3, [1e-200, 1e-200]), (4, [-1e-300, 1e-300])]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [3, 1, 2, 4]
    assert [r.score for r in sorted(got, key=lambda r: r["rank"])] == pytest.approx([1.0, 1.9 / np.sqrt(2 * 1.81), np.sqrt(0.5), 0.0], abs=1e-12)


def test_queries_are_not_copied_for_every_shard(spark, monkeypatch):
    """Rows grow with the queries and with the shards, not with their product; floats stay floats; slabs and groups find the same."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=16), 0) for i in range(400)] + [(1000 + i, rng.normal(size=8), 0) for i in range(60)]
    plain = sorted(map(tuple, hnsw.nearest(make(spark, rows), every=10, shard=20).collect()))
    assert len(plain) == 46 * 5
    seen, dealt = [], hnsw._dealt

    def watched(asked, index, shards):
        out = dealt(asked, index, shards)
        seen.append((asked.count(), index.count(), shards, out.count(), index.schema["vectors"].dataType.simpleString()))
        return out

    monkeypatch.setattr(hnsw, "_dealt", watched)
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", 1)
    monkeypatch.setattr(hnsw, "GROUPS", 2)
    for slab in (1 << 16, 7):
        monkeypatch.setattr(hnsw, "SLAB", slab)
        assert sorted(map(tuple, hnsw.nearest(make(spark, rows), every=10, shard=20).collect())) == plain
    n, graphs, shards, most, kind = seen[0]
    assert (n, shards, kind) == (46, 23, "array<float>")
    assert most <= graphs + n * spark.sparkContext.defaultParallelism
