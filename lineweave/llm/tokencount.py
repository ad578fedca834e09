"""Exact token counts at every prefix of a text, by prefix dynamic programming over a vocabulary's merges.

A token sequence is the encoding of what it spells if, and only if, each token is so of its own text and each two
neighbours are so of theirs. So the encoding of a word's first i letters is that of its first j, followed by the one
token for letters j to i that fits the last token there: one pass from left to right leaves the number of tokens of every
prefix, the shorter ones being the table of the longer. A prefix ends its word, so each position has two cells: tokens
with the mark of a word's end, which are counted, and without, from which the word goes on. Words in sorted order share the
cells of what they begin with alike.

The counts are stored once for a text; how many tokens a cut at any place leaves, and how much fits a budget, are then
joins with that table. Documents are independent, so nothing is shuffled to count them.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_tokenizer
from .common import byte_letters, give_back, small_batches, text_bytes

LIMIT = 2048
#: Letters of a row of the stored table.
SEGMENT = 4096
#: Words and letters of a generation of the words that a worker remembers the counts of.
REMEMBERED = 1 << 18, 1 << 22
#: How the vocabularies that this module reads split normalised text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters that have one lower-case form and nothing to compose with, and perhaps a sign after them, which is a piece by itself.
_USUAL = re.compile("([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]{1,99})([.,:;!?]?)")
_CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)")


@functools.cache
def _joiners() -> frozenset[str]:
    """Characters that normalisation may compose with, or move before, the one in front of them."""
    found = {chr(c) for c in (*range(0x1160, 0x1200), *range(0xD7B0, 0xD800))}  # Hangul vowels and finals
    for c in map(chr, range(0x110000)):
        parts = unicodedata.decomposition(c).split()
        if unicodedata.combining(c):
            found.add(c)
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


class Counter:
    """Token counts of all prefixes of words, for one vocabulary of lower-case words with marked ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or steps != ["NFC", "Replace", "Lowercase"] or split != PATTERN:
            raise ValueError(f"{path} isn't a vocabulary of lower-case words with marked ends")
        self.normal, self.split, self.end = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str, model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        letters = byte_letters()
        self.letter = dict(enumerate(letters))
        whole = {a + b for a, b in merges} | set(letters) | {x + self.end for x in letters}
        #: What tokens spell; a number of it stands for the token within a word and the one at its end.
        self.cores = ["", *sorted({t.removesuffix(self.end) for t in whole} - {""})]
        self.there = [(t in whole, t + self.end in whole) for t in self.cores]
        #: Numbers of all that a token may end in, 0 where it is no token by itself.
        self.tokens = {t[i:]: 0 for t in self.cores for i in range(len(t))} | {t: n for n, t in enumerate(self.cores) if n}
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = re.compile("|".join(sorted(map(re.escape, special), key=len, reverse=True))) if special else None
        self.known_fits: dict[int, int] = {}
        self.kinds: dict[str, str] = {}
        self.spelt, self.last, self.inner, self.full = "", [0], [0], [0]

    def _merged(self, parts: list[str]) -> list[str]:
        """The tokens of a word's letters: the first merge of the lowest rank, again and again."""
        rank, never = self.rank.get, len(self.rank)
        while len(parts) > 1:
            ranks = [rank(pair, never) for pair in zip(parts, parts[1:], strict=False)]
            low = min(ranks)
            if low == never:
                break
            at = ranks.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, before: int, core: int) -> int:
        """Whether a token may follow ``before`` (0: begin a word): 1 within the word, 2 at its end, 3 both."""
        key = before << 20 | core
        found = self.known_fits.get(key)
        if found is None:
            if len(self.known_fits) > 1 << 20:
                self.known_fits.clear()
            text, first, found = self.cores[core], self.cores[before], 0
            for bit, there, end in ((1, self.there[core][0], ""), (2, self.there[core][1], self.end)):
                if there and (not before or self._fits(0, core) & bit):
                    parts = self._merged([*first, *text[:-1], text[-1] + end])
                    found |= bit * (parts == ([first, text + end] if before else [text + end]))
            self.known_fits[key] = found
        return found

    def cells(self, spelt: str) -> list[int]:
        """Number of tokens of the words that the first 0, 1, 2, ... letters of ``spelt`` make."""
        spell, known = self.tokens.get, self.known_fits.get
        same = 0
        for a, b in zip(spelt, self.spelt, strict=False):
            if a != b:
                break
            same += 1
        last, inner, full = self.last, self.inner, self.full
        del last[same + 1 :], inner[same + 1 :], full[same + 1 :]
        for i in range(same + 1, len(spelt) + 1):
            going = done = token = 0
            for j in range(i - 1, -1, -1):
                core = spell(spelt[j:i])
                if core is None:
                    break  # nor does a token end in more letters
                if core:
                    fits = known(last[j] << 20 | core)
                    if fits is None:
                        fits = self._fits(last[j], core)
                    if fits:
                        if fits & 1:
                            going, token = inner[j] + 1, core
                        if fits & 2:
                            done = inner[j] + 1
                        if going and done:
                            break
            last.append(token)
            inner.append(going)
            full.append(done)
        self.spelt = spelt
        return full

    def run(self, text: str) -> list[int]:
        """Counts after each character of what splitting leaves whole."""
        if text.isascii() and text.isalpha():
            return self.cells(text)[1:]
        full = self.cells(text.encode().decode("latin-1").translate(self.letter))
        return [full[i] for i in accumulate([1 if c < "\x80" else len(c.encode()) for c in text])]

    def _kind(self, c: str) -> str:
        """How splitting sees a character: white space, a letter, a digit or anything else. The library tells."""
        kind = self.kinds.get(c)
        if kind is None:
            kind = "space" if not self.split(c) else "digit" if len(self.split(c + c)) > 1 else "letter" if len(self.split(c + "a")) == 1 else "other"
            self.kinds[c] = kind
        return kind

    def _scan(self, text: str) -> tuple[list[int], list[int]]:
        """Counts after 0, 1, 2, ... characters of normalised text, and where the piece of each character begins."""
        counts, begins, i = [0], [], 0
        kinds = [self._kind(c) for c in text]
        while i < len(text):
            base, kind, short = counts[-1], kinds[i], _CONTRACTION.match(text, i)
            to = i + 1
            if kind == "space":
                counts.append(base)
            elif short:
                to = short.end()
                part = short.group()
                mark = self.run(part[0])[-1]
                if len(part) == 3:  # its first two characters are no contraction, but two pieces
                    counts += [base + mark, base + mark + self.run(part[1])[-1]]
                else:
                    counts.append(base + mark)
                counts.append(base + self.run(part)[-1])
            else:
                while kind != "digit" and to < len(text) and kinds[to] == kind:
                    to += 1
                counts += [base + n for n in self.run(text[i:to])]
            begins += [i] * (to - i)
            i = to
        return counts, begins

    def _plain(self, text: str) -> list[int]:
        """Counts after 0, 1, 2, ... characters of text without special tokens."""
        if max(text) < "\u0300" and "\u0130" not in text:  # nothing to compose, a character stays one
            return [0, *self.run(text.lower())] if text.isalpha() else self._scan(text.lower())[0]
        joiners = _joiners()
        starts = [i for i, c in enumerate(text) if not i or c not in joiners]
        normal = [self.normal(text[a:b]) for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
        whole = "".join(normal)
        at, begins = self._scan(whole)
        counts, place = [0], 0
        for a, b, part in zip(starts, [*starts[1:], len(text)], normal, strict=True):
            for cut in range(a + 1, b):  # within a character and its marks: only the last piece is counted anew
                before = self.normal(text[a:cut])
                # a piece that the cut changes may be the one that the text before goes on with
                begin = begins[place - 1] if place else 0
                if begin and whole[begin - 1] == "'" and begins[begin - 1] == begin - 1:
                    begin -= 1  # nor may an apostrophe before it
                counts.append(at[begin] + self._scan(whole[begin:place] + before)[0][-1])
            place += len(part)
            counts.append(at[place])
        return counts

    def counts(self, word: str) -> list[int]:
        """Number of tokens of the first 0, 1, 2, ... characters of a word without ASCII white space."""
        if not self.special or not (hits := list(self.special.finditer(word))):
            return self._plain(word)
        out, base, at = [0], 0, 0
        for hit in hits:
            # until it is whole, a special token is text
            part = self._plain(word[at : hit.end()])
            out += [base + n for n in part[1:-1]]
            base += part[hit.start() - at] + 1 if hit.start() > at else 1
            out.append(base)
            at = hit.end()
        return out + [base + n for n in self._plain(word[at:])[1:]] if at < len(word) else out


@functools.cache
def _counter(path: str) -> Counter:
    return Counter(path)


class _Remembered:
    """Counts at every prefix of the words that a worker has met lately: the present generation and the one before."""

    def __init__(self, path: str):
        self.counter, self.words, self.older, self.letters = _counter(path), {}, {}, 0

    def learn(self, texts: list[bytes]) -> dict[bytes, bytes | tuple]:
        """The counts of these texts' words, and of others."""
        if len(self.words) > REMEMBERED[0] or self.letters > REMEMBERED[1]:
            self.words, self.older, self.letters = {}, self.words, 0
        words, older, counts, run, usual = self.words, self.older, self.counter.counts, self.counter.run, _USUAL.fullmatch
        for word in sorted((w for w in set().union(*map(bytes.split, texts)) if w not in words), key=bytes.lower):
            found = older.get(word)
            if found is None:
                text = word.decode("utf-8", "replace")
                short = usual(text)
                if short:
                    found = bytes([0, *run(short[1].lower())])
                    found += bytes([found[-1] + 1]) if short[2] else b""
                else:
                    found = counts(text)
                    found = bytes(found) if max(found) < 256 else tuple(found)
            words[word] = found
            self.letters += len(word)
        return words


@functools.cache
def _remembered(path: str) -> _Remembered:
    return _Remembered(path)


def _length(text: bytes) -> int:
    return len(text.decode("utf-8", "replace"))


def _cut(text: bytes, known: dict, limit: int) -> int:
    """Characters of the longest prefix with ``limit`` tokens or fewer, of a text with more: it ends in, or before, the word that goes past."""
    used = 0
    for at, word in enumerate(text.split()):
        if used + known[word][-1] > limit:
            break
        used += known[word][-1]
    start = next(islice(re.finditer(rb"[^\x20\x09-\x0D]+", text), at, None)).start()
    return _length(text[:start]) + max(k for k, n in enumerate(known[word]) if used + n <= limit)


def count(df: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = LIMIT, tokenizer: str | None = None) -> DataFrame:
    """Token counts of every text, and how much of it ``limit`` tokens hold.

    Returns a row for each row of ``df``: id, ``n_bytes``, ``n_tokens`` (as the tokenizers library counts, without special
    tokens around the text; special tokens inside it count as one), ``over_limit``, and ``fitting_chars``: the characters of
    the longest prefix that is ``limit`` tokens or fewer by itself. Null texts count as empty; null and repeated ids are
    kept. Bytes that aren't UTF-8 count as U+FFFD.
    """
    small_batches(df.sparkSession)
    path = tokenizer or default_tokenizer()

    def counted(batches):
        for batch in batches:
            out, texts = [], text_bytes(batch.column("text"))
            table = _remembered(path).learn(texts)
            for data in texts:
                n = sum([table[w][-1] for w in data.split()])
                out.append((len(data), n, n > limit, _cut(data, table, limit) if n > limit else _length(data)))
            sizes, tokens, over, fitting = zip(*out, strict=True) if out else ([],) * 4
            columns = [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(over, pa.bool_()), pa.array(fitting, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens", "over_limit", "fitting_chars"])
            give_back()

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long").withColumnRenamed("id", id_col)


def prefix_table(df: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The stored counts: rows (id, ``segment``, ``counts``), ``counts[i]`` being those of the first segment * 4096 + i + 1 characters.

    A null or empty text has one row without counts. Long texts have many rows, so none is larger than a segment. Write
    the table once; :func:`tokens_within` and :func:`fitting` ask it. Ids should be distinct: rows of repeated ids
    can't be told apart.
    """
    small_batches(df.sparkSession)
    path = tokenizer or default_tokenizer()

    def segments(data: bytes):
        known = _remembered(path).learn([data])
        held, base = [], 0
        for found in re.finditer(rb"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", data):
            counts = known.get(found.group())
            held += [base] * (found.end() - found.start()) if counts is None else [base + n for n in counts[1:]]
            base = held[-1]
            while len(held) >= SEGMENT:
                yield held[:SEGMENT]
                held = held[SEGMENT:]
        if held or not data:
            yield held

    def stored(batches):
        for batch in batches:
            for i, data in enumerate(text_bytes(batch.column("text"))):
                for k, part in enumerate(segments(data)):
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, 1), pa.array([k], pa.int64()), pa.array([part], pa.list_(pa.int32()))], ["id", "segment", "counts"])
            give_back()

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(stored, f"id {kind}, segment long, counts array<int>").withColumnRenamed("id", id_col)


def tokens_within(table: DataFrame, asked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``asked`` (id, ``chars`` long) and ``n_tokens`` of the text's first ``chars`` characters.

    Zero and fewer characters have no tokens; null characters, ids that the table hasn't, and places beyond the end have
    null.
    """
    place = asked.withColumn("segment", F.when(F.col("chars") > 0, F.floor((F.col("chars") - 1) / SEGMENT)).otherwise(F.when(F.col("chars").isNotNull(), 0)))
    found = place.join(table.select(id_col, "segment", "counts"), [id_col, "segment"], "left")
    at = ((F.col("chars") - 1) % SEGMENT + 1).cast("int")
    within = F.when(F.size("counts") >= at, F.try_element_at("counts", at))
    return found.select(*(F.col(f"`{c}`") for c in asked.columns), F.when(F.col("chars") <= 0, F.when(F.col("counts").isNotNull(), 0)).otherwise(within).cast("long").alias("n_tokens"))


def fitting(table: DataFrame, asked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``asked`` (id, ``budget`` long), each row once, and ``chars``: the length of the longest prefix within the budget.

    A budget below zero holds no prefix, not even the empty one: null; as are null budgets and ids that the table hasn't.
    """
    fits = F.filter(F.transform("counts", lambda n, i: F.when(n <= F.col("budget"), i + 1)), lambda x: x.isNotNull())
    ends = table.join(asked.select(id_col, "budget").distinct(), id_col).where("budget >= 0")
    best = ends.select(id_col, "budget", F.coalesce(F.col("segment") * SEGMENT + F.array_max(fits), F.lit(0).cast("long")).alias("chars"))
    longest = best.groupBy(id_col, "budget").agg(F.max("chars").alias("chars"))
    return asked.join(longest, [id_col, "budget"], "left")
