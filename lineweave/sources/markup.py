"""Strings of HTML, DOCX, ODT and Python files, as rows with exact places.

Parsing a document is sequential, so each goes through Arrow; documents are many and small, rows are exploded.
"""

from __future__ import annotations

import ast
import html
import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame

# Attributes that people read, elements whose content they don't.
ATTRIBUTES = ("alt", "title", "placeholder", "aria-label", "aria-description", "label")
HIDDEN = ("script", "style")
#: An archive beyond these limits is refused: entries, bytes in all, bytes of a part, packing ratio and its floor.
LIMITS = (10_000, 128 << 20, 32 << 20, 1_000, 1 << 20)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+))")


def _place(text: str, at: int) -> tuple[int, int]:
    return text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at)


def html_strings(text: str) -> list[dict]:
    """Text nodes and attributes that people read, in order of their places; comments, scripts and broken tags give none."""
    out: list[dict] = []

    def add(kind, tag, attribute, start, end):
        raw = text[start:end]
        lead = len(raw) - len(raw.lstrip())
        start, raw = start + lead, raw.strip()
        if raw and (kind == "attribute" or not raw.startswith("<!")):
            line, column = _place(text, start)
            out.append({"text": html.unescape(raw), "line": line, "column": column, "start": start, "end": start + len(raw), "kind": kind, "tag": tag, "attribute": attribute})

    at, stack, pos = 0, [""], 0
    while m := _TAG.search(text, pos):
        if stack[-1] not in HIDDEN:
            add("text", stack[-1], None, at, m.start())
        at = pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            while len(stack) > 1 and stack.pop() != tag:
                pass
            continue
        given = {x[1].lower(): x for x in _ATTRIBUTE.finditer(m[3])}
        button = tag == "input" and (t := given.get("type")) and (t[2] or t[3] or t[4] or "").lower() in ("submit", "button")
        for name, x in given.items():
            if name in ATTRIBUTES or button and name == "value":
                group = next((g for g in (2, 3, 4) if x[g] is not None))
                add("attribute", tag, name, m.start(3) + x.start(group), m.start(3) + x.end(group))
        if tag in HIDDEN:
            close = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            at = pos = close.end() if close else len(text)
        elif not m[3].rstrip().endswith("/") and tag not in ("br", "img", "input", "meta", "link", "hr"):
            stack.append(tag)
    if stack[-1] not in HIDDEN:
        add("text", stack[-1], None, at, len(text))
    return sorted(out, key=lambda x: (x["start"], x["end"], x["kind"], x["attribute"] or ""))


def i18n_strings(text: str) -> list[dict]:
    """(key, text) of elements with a data-i18n attribute: the text up to the next tag."""
    found = re.finditer(r"<[A-Za-z][^<>]*?\sdata-i18n\s*=\s*[\"']([^\"']+)[\"'][^<>]*>([^<]*)", text)
    return [{"key": m[1], "text": html.unescape(m[2].strip())} for m in found]


def office_strings(content: bytes) -> list[dict]:
    """Paragraphs of a DOCX or ODT file with their part and number; archives beyond the limits or with a DTD are refused."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        files = z.infolist()
        entries, total, one, ratio, floor = LIMITS
        if len(files) > entries or sum(f.file_size for f in files) > total:
            raise ValueError("archive too large")
        odt = any(f.filename == "content.xml" for f in files)
        wanted = ("content.xml", "styles.xml") if odt else r"word/(?:document|header\d*|footer\d*)\.xml"
        out = []
        for f in files:
            if not (f.filename in wanted if odt else re.fullmatch(wanted, f.filename)):
                continue
            if f.file_size > one or f.file_size > floor and f.file_size > ratio * max(1, f.compress_size):
                raise ValueError("part too large")
            raw = z.read(f)
            if b"<!DOCTYPE" in raw:
                raise ValueError("document type declarations aren't read")
            number = 0
            for p in ET.fromstring(raw).iter():
                name = p.tag.rpartition("}")[2]
                if name not in ("p", "h"):
                    continue
                parts = p.itertext() if odt else (t.text or "" for t in p.iter() if t.tag.rpartition("}")[2] == "t")
                if text := "".join(parts).strip():
                    out.append({"part": f.filename, "paragraph": number, "kind": "heading" if name == "h" else "paragraph", "text": text})
                number += 1
        return out


class _Normal(ast.NodeTransformer):
    """Names don't matter to a function's structure, nor does its docstring."""

    def visit_Name(self, node):
        return ast.copy_location(ast.Name("v", node.ctx), node)

    def visit_arg(self, node):
        return ast.copy_location(ast.arg("v", None), node)

    def visit_FunctionDef(self, node):
        self.generic_visit(node)
        first = node.body[0] if node.body else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            node.body = node.body[1:] or [ast.Pass()]
        node.name = "f"
        return node


def python_functions(text: str) -> list[dict]:
    """Functions (not async ones) with their places and a signature of their structure; text that doesn't parse gives none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    lines = text.splitlines()
    out = []
    for node in [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)]:
        first, last, name = node.lineno, node.end_lineno or node.lineno, node.name
        normal = _Normal().visit(ast.parse(ast.unparse(node)).body[0])
        out.append({"name": name, "start_line": first, "end_line": last, "line_count": last - first + 1, "signature": ast.dump(normal), "source_excerpt": lines[first - 1 : first + 4]})
    return out


_SPAN = {"text": "string", "line": "int", "column": "int", "start": "int", "end": "int", "kind": "string", "tag": "string", "attribute": "string"}
_FUNCTION = {"name": "string", "start_line": "int", "end_line": "int", "line_count": "int", "signature": "string", "source_excerpt": "array<string>"}
_PARAGRAPH = {"part": "string", "paragraph": "int", "kind": "string", "text": "string"}
_ARROW = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}


def _rows(df: DataFrame, key: str, column: str, read, fields: dict[str, str]) -> DataFrame:
    def parse(batches):
        for batch in batches:
            keys, found = [], []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for one in read(raw) if raw else ():
                    keys.append(name)
                    found.append(one)
            columns = [pa.array([x[f] for x in found], _ARROW[t]) for f, t in fields.items()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *columns], [key, *fields])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInArrow(parse, f"{key} {kind}, " + ", ".join(f"`{f}` {t}" for f, t in fields.items()))


def extract_html(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    return _rows(pages, key, column, html_strings, _SPAN)


def extract_i18n(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    return _rows(pages, key, column, i18n_strings, {"key": "string", "text": "string"})


def extract_office(files: DataFrame, key: str = "path", column: str = "content") -> DataFrame:
    return _rows(files, key, column, office_strings, _PARAGRAPH)


def extract_functions(files: DataFrame, key: str = "file", column: str = "text") -> DataFrame:
    return _rows(files, key, column, python_functions, _FUNCTION)


def json_findings(spark, path: str) -> DataFrame:
    """Findings with a text from a JSON list on the cluster's file system."""
    return spark.read.schema("text string, file string, line int, type string").option("multiLine", "true").json(path).where("text is not null and text != ''")


