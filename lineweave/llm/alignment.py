"""Aligning the tokens of two vocabularies through one dictionary of groups.

A group is a shortest stretch of tokens that begins and ends at the same bytes in both vocabularies; its key is the ids of
both. Texts are cut before single spaces, where neither vocabulary has a token across, so a block of documents
encodes each of its distinct units once and keeps documents as numbers of its own groups. The groups of all blocks are
interned in one dictionary with their frequencies; links are expanded once for each distinct group and weighed with its
frequency; what a group's links are worth returns to the blocks by the group's key, and to documents by number.

A block holds a bounded number of units, and sends one row for each of its distinct groups: rows grow with the input, and a
group as frequent as " the" is one row a block.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_letters, cut, give_back, pack, scratch, small_batches, spans, unpack

#: Units of a block.
BLOCK = 1 << 20
#: What some Unicode version calls white space.
_SPACE = r"\s\x0B\x1C-\x1F\x85\xA0\u1680\u180E\u2000-\u200B\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: Before a space that follows anything but white space and isn't the last character.
_CUT = re.compile(rf"(?<=[^{_SPACE}])(?= [\s\S])")
_SPACED = re.compile(rf"[{_SPACE}]\Z")
#: Which tokens of a group are linked: those that end together, those that begin together, or all of A with all of B.
RULES = ("ends", "starts", "all")


def default_vocabularies() -> tuple[str, str]:
    """Paths of the public vocabularies that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def _byte_level(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    tokenizer.encode_special_tokens = True
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    byte = {c: i for i, c in enumerate(byte_letters())}
    spelt = [b""] * tokenizer.get_vocab_size()
    for token, i in vocabulary.items():
        spelt[i] = bytes(map(byte.__getitem__, token))
    return tokenizer, spelt, np.array(list(map(len, spelt)), np.int64)


@functools.cache
def _pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelt = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        spelt.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
        if "▁" in piece.lstrip("▁"):
            raise ValueError(f"{path}: {piece!r} crosses a space")
    return model, spelt, np.array(list(map(len, spelt)), np.int64)


def _units(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Units of each text after a space: how many, the distinct ones, and which one stands at each place; none for null and empty.

    Most texts are cut at every space. Those with white space that holds together go through the expression.
    """
    pieces = pc.split_pattern(pc.fill_null(texts, ""), " ")
    coded = pieces.flatten().dictionary_encode()
    distinct, numbers, counts = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(), pieces.value_lengths().to_numpy()
    held = np.fromiter((not p or (p[-1] <= 32 or p[-1] >= 128) and bool(_SPACED.search(p.decode("utf-8", "replace"))) for p in distinct), bool, len(distinct))
    empty = np.fromiter((not p for p in distinct), bool, len(distinct))
    ends = np.cumsum(counts, dtype=np.int64)
    inside = np.concatenate([[0], np.cumsum(held[numbers])])
    last = numbers[ends - 1] if len(ends) else numbers
    odd = np.flatnonzero((inside[ends] - inside[ends - counts] - held[last] > 0) | empty[last])
    distinct = [b" " + p for p in distinct]
    known: dict[bytes, int] = {}
    parts, at = [], 0
    counts = counts.copy()
    for i in odd.tolist():
        text = texts[i].as_py()
        units = [u.encode() for u in _CUT.split(" " + text)] if text else []
        for u in units:
            if u not in known:
                known[u] = len(distinct)
                distinct.append(u)
        parts += [numbers[at : ends[i] - counts[i]], np.fromiter(map(known.__getitem__, units), numbers.dtype, len(units))]
        at, counts[i] = ends[i], len(units)
    return counts, distinct, np.concatenate([*parts, numbers[at:]])


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    length = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(length.sum())), length


class _Block:
    """A block as it is filled: distinct units and groups, and documents as numbers of groups."""

    def __init__(self, number: int, paths: tuple[str, str], rule: str):
        self.number, self.paths, self.rule = number, paths, rule
        self.units: dict[bytes, int] = {}
        self.groups: dict[str, int] = {}
        self.keys: list[bytes] = []  # by unit: its groups as text
        self.void: list[bool] = []
        self.tally, self.of = np.empty((0, 4), np.int64), np.empty(0, np.int64)  # by unit: tokens of A and B, groups, links; and the numbers of its groups
        self.rows, self.flat, self.held = [], [], 0

    def learn(self, new: list[bytes]) -> None:
        """Encode units that the block hasn't met."""
        (a_tokenizer, a_spelt, a_sizes), (b_model, b_spelt, b_sizes) = _byte_level(self.paths[0]), _pieces(self.paths[1])
        texts = [u.decode("utf-8", "replace") for u in new]
        a = [x.ids for x in a_tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        b = b_model.encode([t[1:] for t in texts], num_threads=1)
        (a_ids, a_count), (b_ids, b_count) = _flat(a), _flat(b)
        whole, void = b"".join(new), [False] * len(new)
        if any(b"".join(map(spelt.__getitem__, ids.tolist())) != whole for spelt, ids in ((a_spelt, a_ids), (b_spelt, b_ids))):
            void = [b"".join(map(a_spelt.__getitem__, x)) != u or b"".join(map(b_spelt.__getitem__, y)) != u for u, x, y in zip(new, a, b, strict=True)]
            a, b = ([[] if v else x for v, x in zip(void, side, strict=True)] for side in (a, b))
            (a_ids, a_count), (b_ids, b_count) = _flat(a), _flat(b)
        a_end, b_end = np.cumsum(a_sizes[a_ids]), np.cumsum(b_sizes[b_ids])
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        a_to, b_to = np.searchsorted(a_end, cuts, "right"), np.searchsorted(b_end, cuts, "right")
        in_a, in_b = np.diff(a_to, prepend=0), np.diff(b_to, prepend=0)
        # groups of one token each are named by the pair, each pair once; the others one by one
        keys, own, number = np.empty(len(cuts), object), np.empty(len(cuts), np.int64), lambda k: self.groups.setdefault(k, len(self.groups))
        single = (in_a == 1) & (in_b == 1)
        pairs, at = np.unique(a_ids[a_to[single] - 1] << 32 | b_ids[b_to[single] - 1], return_inverse=True)
        named = [f"{p >> 32}|{p & 0xFFFFFFFF}" for p in pairs.tolist()]
        keys[single], own[single] = np.array(named, object)[at], np.array(list(map(number, named)), np.int64)[at]
        for i in np.flatnonzero(~single).tolist():
            keys[i] = f"{','.join(map(str, a_ids[a_to[i] - in_a[i] : a_to[i]].tolist()))}|{','.join(map(str, b_ids[b_to[i] - in_b[i] : b_to[i]].tolist()))}"
            own[i] = number(keys[i])
        keys = keys.tolist()
        links = in_a * in_b if self.rule == "all" else np.ones(len(keys), np.int64)
        # a unit ends where its last tokens end; units without tokens have no groups
        last = np.searchsorted(a_to, np.cumsum(a_count), "right")
        count = np.diff(last, prepend=0)
        total = np.concatenate([[0], np.cumsum(links)])
        self.tally = np.concatenate([self.tally, np.stack([a_count, b_count, count, total[last] - total[last - count]], axis=1)])
        self.of = np.concatenate([self.of, own])
        self.void += void
        self.keys += [";".join(keys[t - n : t]).encode() for t, n in zip(last.tolist(), count.tolist(), strict=True)]
        for u in new:
            self.units[u] = len(self.units)

    def add(self, ids: list, counts: np.ndarray, distinct: list[bytes], numbers: np.ndarray) -> None:
        used, place = np.unique(numbers, return_inverse=True)
        words = [distinct[i] for i in used.tolist()]
        self.learn(list(dict.fromkeys(u for u in words if u not in self.units)))  # a unit may come from both ways of cutting
        own = np.fromiter(map(self.units.__getitem__, words), np.int64, len(words))[place.ravel()]
        begin = np.cumsum(self.tally[:, 2]) - self.tally[:, 2]
        void = np.array(self.void, bool)
        at = 0
        for i, n in zip(ids, counts.tolist(), strict=True):
            mine = own[at : at + n]
            at += n
            if void[mine].any():
                mine = mine[:0]
            tally = self.tally[mine].sum(axis=0).tolist()
            digest = hashlib.sha256(b";".join(map(self.keys.__getitem__, mine.tolist()))).hexdigest() if len(mine) else ""
            self.rows.append((i, *tally, digest))
            self.flat.append(self.of[spans(begin[mine], self.tally[mine, 2])].astype(np.int32))
        self.held += len(numbers)

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        """One row with the documents, and one for each distinct group that they have."""
        flat = np.concatenate(self.flat)
        times = np.bincount(flat, minlength=len(self.groups))
        met = np.flatnonzero(times)
        n, keys = len(met), list(self.groups)
        doc = pa.struct([("id", kind), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())])
        docs = [dict(zip(("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), r, strict=True)) for r in self.rows]
        columns = {
            "kind": pa.array(["docs"] + ["groups"] * n), "block": pa.array([self.number] * (n + 1), pa.int64()), "docs": pa.array([docs] + [None] * n, pa.list_(doc)), "data": pa.array([pack(flat)] + [None] * n, pa.binary()),
            "number": pa.array([None, *met.tolist()], pa.int32()), "key": pa.array([None, *(keys[i] for i in met.tolist())], pa.string()), "times": pa.array([None, *times[met].tolist()], pa.int64()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _gather(paths: tuple[str, str], rule: str):
    def gather(batches):
        block = _Block(TaskContext.get().partitionId() << 32, paths, rule)
        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            ids = batch.column("id").to_pylist()
            counts, distinct, numbers = _units(batch.column("text"))
            ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            at = 0
            while at < len(ids):
                # as many documents as fit, one at least
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK - block.held, "right")) - 1)
                block.add(ids[at:to], counts[at:to], distinct, numbers[ends[at] : ends[to]])
                at = to
                if block.held >= BLOCK:
                    yield block.batch(kind)
                    block = _Block(block.number + 1, paths, rule)
            del distinct, numbers
            give_back()
        if block.rows:
            yield block.batch(kind)

    return gather


def _finish(key, docs, worth):
    flat = unpack(docs.column("data")[0].as_py(), np.int32)
    known = worth.column("number").to_numpy()
    value = np.zeros((int(known.max()) + 1 if len(known) else 0, 2), np.int64)
    value[known, 0], value[known, 1] = worth.column("best").to_numpy(), worth.column("total").to_numpy()
    rows = docs.column("docs").combine_chunks().flatten()
    own = {name: rows.field(name) for name in ("id", "n_a", "n_b", "n_groups", "n_links")}
    ends = np.cumsum(own["n_groups"].to_numpy())
    sums = np.zeros((len(flat) + 1, 2), np.int64)
    np.cumsum(value[flat], axis=0, out=sums[1:])
    found = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
    give_back()
    return pa.table({**own, "n_best": pa.array(found[:, 0]), "count_sum": pa.array(found[:, 1]), "groups_sha256": rows.field("groups_sha256")})


def _links(rule: str) -> Column:
    """The linked pairs of a group, from its key."""
    sides = [F.split(F.split("key", r"\|")[k], ",").cast("array<int>") for k in (0, 1)]
    if rule == "all":
        return F.flatten(F.transform(sides[0], lambda a: F.transform(sides[1], lambda b: F.struct(a.alias("a"), b.alias("b")))))
    place = -1 if rule == "ends" else 1
    return F.array(F.struct(*(F.element_at(s, place).alias(c) for s, c in zip(sides, "ab", strict=True))))


def dictionary(groups: DataFrame) -> DataFrame:
    """Distinct groups (key, times) of (key, times) rows."""
    return groups.groupBy("key").agg(F.sum("times").alias("times"))


def pair_counts(found: DataFrame, rule: str = "ends") -> DataFrame:
    """(a, b, n, best) of a dictionary's linked pairs: n links hold the pair, best if no other pair of the same b has more."""
    pairs = found.select("times", F.explode(_links(rule)).alias("link")).groupBy("link.a", "link.b").agg(F.sum("times").alias("n"))
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return pairs.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(df: DataFrame, id_col: str = "doc_id", text: str = "text", vocabularies: tuple[str, str] | None = None, rule: str = "ends") -> DataFrame:
    """How the tokens of two vocabularies, a byte-level one (A) and one of pieces (B), go together in every text.

    Returns a row for each row of ``df``: id, ``n_a`` and ``n_b`` tokens, ``n_groups``, ``n_links`` by ``rule``, ``n_best`` (links
    whose pair of ids no other pair with the same B id outnumbers in the whole table), ``count_sum`` (over its links, how
    many links of the table hold the same pair) and ``groups_sha256`` of ``a1,a2|b1;a3|b2,b3``. Null and empty texts, and
    those that a vocabulary doesn't spell as they are, have no tokens: zeros and ''. Null and repeated ids are kept.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    spark = df.sparkSession
    small_batches(spark)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    doc = f"struct<id: {kind}, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string>"
    schema = f"kind string, block long, docs array<{doc}>, data binary, number int, key string, times long"
    path = scratch(spark, "groups")
    rows.mapInArrow(_gather(vocabularies or default_vocabularies(), rule), schema).write.partitionBy("kind").parquet(path)
    both = spark.read.schema(schema).parquet(path)
    lists = both.where("kind = 'groups'").select("block", "number", "key", "times")
    found = dictionary(lists)
    linked = found.select("key", F.explode(_links(rule)).alias("link")).select("key", "link.a", "link.b")
    worth = linked.join(pair_counts(found, rule), ["a", "b"]).groupBy("key").agg(F.sum(F.col("best").cast("long")).alias("best"), F.sum("n").alias("total"))
    worth = cut(worth, "worth")
    back = lists.select(F.col("block").alias("home"), "number", "key").join(worth, "key").select("home", "number", "best", "total")
    docs = both.where("kind = 'docs'").select("block", "docs", "data")
    out = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return docs.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(_finish, out).withColumnRenamed("id", id_col)
