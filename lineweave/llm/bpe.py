"""BPE encoding and decoding through one table of distinct words.

Spark splits the texts into words. Documents are dealt, as they are read, into blocks of bounded size: a block numbers
its distinct words, keeps its documents as word numbers by position, and sends its list of words to buckets by the
word's hash. There every distinct word of the corpus is encoded once. The ids return to the blocks and are joined to
the positions by number; what they decode to is found by a join of each block's ids with the id-to-piece table.

Words and ids travel as packed lists, a row for each block and bucket, and a word as frequent as "the" costs one entry
a block, so that no key is hot. Blocks and buckets grow with the root of the input up to a bound, so that the number
of these rows is in proportion to the input; beyond it there are never more of them than words in the blocks' lists.
"""

from __future__ import annotations

import functools
import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, give_back, pack, scratch, small_batches, unpack, written

#: A row for each block and bucket stands for so many bytes of text; blocks and buckets have between these sizes.
ROW_BYTES = 512 << 10
LEAST_BYTES, MOST_BYTES = 8 << 20, 32 << 20
#: Bytes of text for a word, its white space included: blocks are measured in words.
WORD_BYTES = 6


def default_tokenizer() -> str:
    """Path of the public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def words(text: str | Column) -> Column:
    """Words between ASCII white space, which the tokenizer's own splitting never crosses; null has none."""
    parts = F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]++")
    return F.filter(parts, lambda w: w != "")


def pieces(spark, tokenizer: str | None = None) -> DataFrame:
    """The id-to-piece table (token, piece); its size is the vocabulary's."""
    known = _tokenizer(tokenizer or default_tokenizer()).get_vocab(with_added_tokens=True)
    table = pa.table({"token": pa.array(list(known.values()), pa.int32()), "piece": pa.array(list(known), pa.string())})
    return spark.createDataFrame(table)


def sizes(total: int) -> tuple[int, int]:
    """(words of a block, number of buckets) for so many bytes of text."""
    size = min(MOST_BYTES, max(LEAST_BYTES, int((total * ROW_BYTES) ** 0.5)))
    return max(1, size // WORD_BYTES), max(1, -(-total // size))


def _squeezed(words: list[bytes]) -> bytes:
    data = b"\n".join(words)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def _opened(data: bytes) -> list[bytes]:
    return pa.Codec("zstd").decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True).split(b"\n")


class _Block:
    """A block as it is filled: distinct words in order of first appearance, and documents as word numbers."""

    def __init__(self, number: int):
        self.number, self.words, self.ids, self.counts, self.flat, self.held = number, {}, [], [], [], 0

    def add(self, ids: list, counts: np.ndarray, distinct: list[bytes], numbers: np.ndarray) -> None:
        used, place = np.unique(numbers, return_inverse=True)
        own = np.fromiter((self.words.setdefault(distinct[i], len(self.words)) for i in used.tolist()), np.int32, len(used))
        self.ids += ids
        self.counts.append(counts)
        self.flat.append(own[place.ravel()])
        self.held += len(numbers)

    def rows(self, buckets: int, kind: pa.DataType) -> pa.RecordBatch:
        """One row with the documents, and one for each bucket that has a word.

        Words are numbered anew, in order of first appearance, and a first appearance is written as zero: it is the
        next number. Most other numbers are small and compress well.
        """
        flat, words = np.concatenate(self.flat), list(self.words)
        used, first = np.unique(flat, return_index=True)
        known = used[np.argsort(first)]
        words = [words[i] for i in known.tolist()]
        rank = np.empty(len(words), np.uint32)
        rank[known] = np.arange(1, len(words) + 1, dtype=np.uint32)
        coded = rank[flat]
        coded[first] = 0
        of = np.fromiter((zlib.crc32(w) % buckets for w in words), np.uint32, len(words))
        order = np.argsort(of, kind="stable")
        full, start = np.unique(of[order], return_index=True)
        lists = [_squeezed([words[i] for i in part.tolist()]) for part in np.split(order, start[1:])] if len(words) else []
        n = len(lists)
        columns = {
            "kind": pa.array(["docs"] + ["words"] * n), "block": pa.array([self.number] * (n + 1), pa.int64()), "bucket": pa.array([None, *full.tolist()], pa.int32()), "data": pa.array([pack(coded), *lists], pa.binary()),
            "buckets": pa.array([pack(of)] + [None] * n, pa.binary()), "ids": pa.array([self.ids] + [None] * n, pa.list_(kind)), "counts": pa.array([np.concatenate(self.counts).tolist()] + [None] * n, pa.list_(pa.int32())),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _numbered(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of a batch of word lists, the number of the word at each position, and the lengths of the lists."""
    coded = column.flatten().dictionary_encode()
    return coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(), column.value_lengths().to_numpy()


def _gather(most: int, buckets: int):
    def gather(batches):
        block = _Block(TaskContext.get().partitionId() << 32)
        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            ids = batch.column("id").to_pylist()
            distinct, numbers, counts = _numbered(batch.column("words"))
            ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            at = 0
            while at < len(ids):
                # as many documents as fit, one at least
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + most - block.held, "right")) - 1)
                block.add(ids[at:to], counts[at:to], distinct, numbers[ends[at] : ends[to]])
                at = to
                if block.held >= most:
                    yield block.rows(buckets, kind)
                    block = _Block(block.number + 1)
            del distinct, numbers
            give_back()
        if block.ids:
            yield block.rows(buckets, kind)

    return gather


def encode_words(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids by word, ids in order). Bytes that aren't UTF-8 count as U+FFFD."""
    tokenizer, ids = _tokenizer(path), []
    for at in range(0, len(words), 4096):
        part = tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words[at : at + 4096]], add_special_tokens=False)
        ids.append([x.ids for x in part])
    counts = np.fromiter((len(x) for part in ids for x in part), np.uint32, len(words))
    return counts, np.fromiter((i for part in ids for x in part for i in x), np.uint32, int(counts.sum()))


def _encode_bucket(path: str):
    def encode(key, table):
        number: dict[bytes, int] = {}
        asked = []
        for data in table.column("data").to_pylist():
            words = _opened(data)
            asked.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        length, ids = encode_words(list(number), path)
        del number
        start = np.cumsum(length, dtype=np.int64) - length
        lengths = [pack(length[words]) for words in asked]
        found = [pack(ids[_spans(start[words], length[words])]) for words in asked]
        give_back()
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "lengths": pa.array(lengths, pa.binary()), "ids": pa.array(found, pa.binary())})

    return encode


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions start[0], start[0] + 1, ... of each span in turn."""
    length = length.astype(np.int64)
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


def _distinct_ids(batches):
    """(block, token) of the ids of each (block, bucket): what is to be decoded."""
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            tokens = np.unique(unpack(data, np.uint32)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), block, np.int64)), pa.array(tokens)], ["block", "token"])


def _finish(keep: tuple[str, ...]):
    def finish(key, docs, encoded):
        encoded = encoded.sort_by("bucket")
        none = [np.empty(0, np.uint32)]
        found = np.concatenate([unpack(x, np.uint32) for x in encoded.column("lengths").to_pylist()] or none)
        pool = np.concatenate([unpack(x, np.uint32) for x in encoded.column("ids").to_pylist()] or none)
        # ids come by bucket, and within a bucket in the order of the words' numbers
        order = np.argsort(unpack(docs.column("buckets")[0].as_py(), np.uint32), kind="stable")
        length, start = np.empty(len(order), np.uint32), np.empty(len(order), np.int64)
        length[order], start[order] = found, np.cumsum(found, dtype=np.int64) - found
        piece = dict(zip(docs.column("tokens")[0].as_py() or [], (x.encode() for x in docs.column("pieces")[0].as_py() or []), strict=True))
        # a word's ids decode alike wherever it stands; a word without ids adds nothing, not even a space
        parts = list(map(piece.__getitem__, pool.tolist()))
        ends = (start + length).tolist()
        decoded = [b" ".join(parts[a:b]) for a, b in zip(start.tolist(), ends, strict=True)]
        void = bool((length == 0).any())
        del parts
        flat = unpack(docs.column("data")[0].as_py(), np.uint32).astype(np.int64) - 1
        flat[flat < 0] = np.arange(len(order))
        tokens, shas, sums, texts, id_lists, at = [], [], [], [], [], 0
        for count in docs.column("counts")[0].as_py():
            mine = flat[at : at + count]
            at += count
            ids = pool[_spans(start[mine], length[mine])]
            words = [decoded[i] for i in mine.tolist()]
            text = b" ".join(filter(None, words) if void else words)
            tokens.append(len(ids))
            shas.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            sums.append(hashlib.sha256(text).hexdigest())
            if "decoded" in keep:
                texts.append(text)
            if "ids" in keep:
                id_lists.append(ids.astype(np.int32))
        out = {"id": docs.column("ids").combine_chunks().flatten(), "n_tokens": pa.array(tokens, pa.int64()), "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(sums, pa.string())}
        if "ids" in keep:
            out["ids"] = pa.array(id_lists, pa.list_(pa.int32()))
        if "decoded" in keep:
            out["decoded"] = pa.array(texts, pa.binary()).cast(pa.string())
        del decoded, pool, flat
        give_back()
        return pa.table(out)

    return finish


def encode_decode(df: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode every text as the tokenizers library does without special tokens, and decode the ids again.

    Returns a row for each row of ``df``: id, ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit
    integers) and ``decoded_sha256``; ``keep`` may name ``ids`` and ``decoded`` to have the lists and texts too. Null
    texts count as empty: no ids, an empty decoded text. Null and repeated ids are kept as they are.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = tokenizer or default_tokenizer()
    most, buckets = sizes(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), words(text).alias("words"))
    schema = f"kind string, block long, bucket int, data binary, buckets binary, ids array<{kind}>, counts array<int>"
    blocks = scratch(spark, "blocks")
    rows.mapInArrow(_gather(most, buckets), schema).write.partitionBy("kind").parquet(blocks)
    both = spark.read.schema(schema).parquet(blocks)
    lists = both.where("kind = 'words'").select("block", "bucket", "data")
    encoded, _ = written(lists.groupBy("bucket").applyInArrow(_encode_bucket(path), "block long, bucket int, lengths binary, ids binary"), "encoded")
    drop_path(spark, f"{blocks}/kind=words")
    asked = encoded.select("block", "ids").mapInArrow(_distinct_ids, "block long, token int").repartition("block").distinct()  # one shuffle for all that follows
    met = asked.join(F.broadcast(pieces(spark, path)), "token").groupBy("block").agg(F.collect_list(F.struct("token", "piece")).alias("met"))
    docs = both.where("kind = 'docs'").select("block", "data", "buckets", "ids", "counts").join(met, "block", "left").select("block", "data", "buckets", "ids", "counts", F.col("met.token").alias("tokens"), F.col("met.piece").alias("pieces"))
    result = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ("ids" in keep) + ", decoded string" * ("decoded" in keep)
    return docs.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(_finish(keep), result).withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """(id, decoded) of id lists, through a join with the id-to-piece table, whose size is the vocabulary's.

    A null or empty list decodes to the empty text; ids outside the vocabulary are left out, as the library does.
    """
    rows = df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(ids).alias("ids"))
    at = rows.select("id", "row", F.posexplode_outer("ids").alias("pos", "token"))
    joined = at.join(F.broadcast(pieces(df.sparkSession, tokenizer)), "token", "left")
    pairs = joined.groupBy("row", "id").agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece")))).alias("pairs"))
    return pairs.select(F.col("id").alias(id_col), F.array_join(F.transform("pairs", lambda x: x.piece), " ").alias("decoded"))
