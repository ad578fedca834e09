"""Canonical JSON and hashes."""

from __future__ import annotations

import json
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPTIONS = {"ignoreNullFields": "false"}


def canonical_json(**fields: Column) -> Column:
    """An object with sorted keys, no spaces and no ASCII escaping; null fields are written as null.

    Spark writes control characters with upper-case hex digits, JSON's usual writers with lower-case ones. Objects
    inside keep their fields' order; where that matters, :func:`canonical_text` of the result sorts them.
    """
    text = F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), _OPTIONS)
    for code in (11, 14, 15, *range(26, 32)):
        raw = f"\\u{code:04X}"
        if raw != raw.lower():
            text = F.replace(text, F.lit(raw), F.lit(raw.lower()))
    return text


def ascii_json(c: Column) -> Column:
    """JSON text with each character outside ASCII written as an escape, in surrogate pairs beyond the first plane."""

    def escaped(ch: Column) -> Column:
        code = F.ascii(ch)
        unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
        high, low = F.floor((code - 0x10000) / 1024) + 0xD800, (code - 0x10000) % 1024 + 0xDC00
        return F.when(code < 128, ch).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))

    return F.when(~c.rlike(r"[^\x00-\x7F]"), c).otherwise(F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), escaped), ""))


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON, in hex."""
    return F.sha2(canonical_json(**fields).cast("binary"), 256)


#: Digits of a hash that group it, from the leaves of :func:`set_digest` to its root.
LEVELS = (6, 4, 2, 0)


def set_digest(hashes: DataFrame, name: str) -> DataFrame:
    """One row: the hash of a table (h) of hex hashes in whatever order, repeats counted.

    A tree of digests with up to 256 children a node: of n hashes a leaf gathers about n / 16 million. No hashes
    have the digest of the empty text.
    """
    out = hashes.select("h")
    for digits in LEVELS:
        joined = F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ",").cast("binary"), 256)
        group = F.substring("h", 1, digits).alias("at")
        grouped = out.groupBy(group).agg(joined.alias("d")) if digits else out.agg(joined.alias("d"))
        out = grouped.select((F.concat("at", "d") if digits else F.col("d")).alias("h"))
    return out.withColumnRenamed("h", name)


def pretty_json(**fields: Column) -> Column:
    """An object of plain values for people: sorted keys, one a line, two spaces before, a newline at the end."""
    members = []
    for k in sorted(fields):
        whole = canonical_json(**{k: fields[k]})  # {"key":value}
        mark = len(k) + 5
        members.append(F.concat(F.lit(f'  "{k}": '), F.substring(whole, mark, F.length(whole) - mark)))
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *members), F.lit("\n}\n"))


def iso_time(ts: Column) -> Column:
    """A time in UTC to the second as text. Times stay out of what is hashed."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def file_time(ts: Column) -> Column:
    """:func:`iso_time` fit for file names."""
    return F.replace(iso_time(ts), F.lit(":"), F.lit("-"))


def canonical_text(document: Column, normal: bool = False) -> Column:
    """Canonical JSON of JSON text of any shape, absent keys and nulls kept apart; ``normal`` also applies NFC and LF.

    Shapes differ by row, so this goes through Arrow. Text that isn't JSON gives null.
    """

    def clean(x):
        if isinstance(x, str):
            return unicodedata.normalize("NFC", x.replace("\r\n", "\n").replace("\r", "\n"))
        if isinstance(x, list):
            return [clean(y) for y in x]
        return {clean(k): clean(v) for k, v in x.items()} if isinstance(x, dict) else x

    @F.arrow_udf("string")
    def rewrite(column: pa.Array) -> pa.Array:
        out = []
        for raw in column.to_pylist():
            try:
                value = json.loads(raw) if raw is not None else None
                out.append(None if raw is None else json.dumps(clean(value) if normal else value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
            except ValueError:
                out.append(None)
        return pa.array(out, pa.string())

    return rewrite(document)


def short_hash(content: Column, digits: int) -> Column:
    """The first digits of a SHA-256: 12 for helpers, 16 for keys."""
    return F.substring(F.sha2(content.cast("binary"), 256), 1, digits)


def shard_path(digest: Column) -> Column:
    """Two levels of folders by the first digits of a hash."""
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)
