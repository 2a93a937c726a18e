"""Word documents: files become rows of body items (paragraphs and tables) inside Arrow tasks, with the standard library only."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
ITEMS = "path string, pos int, kind string, style string, num_id string, ilvl int, fmt string, runs array<struct<text:string,bold:boolean,italic:boolean,url:string>>, rows array<array<string>>, error string"


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Body items of every .docx below path; a file that cannot be read is one row with its error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return docx_items(files.select("path", "content"))


def docx_items(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("pos", pa.int32()), ("kind", pa.string()), ("style", pa.string()), ("num_id", pa.string()), ("ilvl", pa.int32()), ("fmt", pa.string()), ("runs", pa.list_(pa.struct([("text", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("url", pa.string())]))), ("rows", pa.list_(pa.list_(pa.string()))), ("error", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    items = list(_items(content.as_py()))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as problem:
                    items = [{"kind": "error", "error": f"Not a readable Word file: {problem}"}]
                yield from pa.Table.from_pylist([dict.fromkeys(schema.names) | x | {"path": path, "pos": k} for k, x in enumerate(items)], schema).to_batches()

    return files.select("path", "content").mapInArrow(run, ITEMS)


def _value(parent: ElementTree.Element | None, *tags: str) -> str | None:
    for tag in tags:
        parent = parent.find(W + tag) if parent is not None else None
    return parent.get(W + "val") if parent is not None else None


def _on(props: ElementTree.Element | None, tag: str) -> bool:
    found = props.find(W + tag) if props is not None else None
    return found is not None and found.get(W + "val") not in ("0", "false")


def _text(run: ElementTree.Element) -> str:
    return "".join({"t": x.text or "", "tab": " ", "br": " ", "cr": " ", "noBreakHyphen": "-"}.get(x.tag.removeprefix(W), "") for x in run)


def _table(el: ElementTree.Element) -> list[list[str]]:
    """Cell texts by row; a merged cell stands in every column and row that it covers."""
    rows: list[list[str]] = []
    for row in el.findall(W + "tr"):
        cells: list[str] = []
        for cell in row.findall(W + "tc"):
            props = cell.find(W + "tcPr")
            text = "\n".join("".join(_text(r) for r in p.iter(W + "r")) for p in cell.iter(W + "p"))
            merge = props.find(W + "vMerge") if props is not None else None
            if merge is not None and merge.get(W + "val") != "restart" and rows and len(cells) < len(rows[-1]):
                text = rows[-1][len(cells)]
            cells += [text] * int(_value(props, "gridSpan") or 1)
        rows.append(cells)
    return rows


def _numbered(el: ElementTree.Element | None) -> tuple[str, int] | None:
    props = el.find(f"{W}pPr/{W}numPr") if el is not None else None
    number = _value(props, "numId")
    return (number, int(_value(props, "ilvl") or 0)) if number not in (None, "0") else None


def _items(content: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as parts:
        tree = lambda name: ElementTree.fromstring(parts.read(name)) if name in parts.namelist() else ElementTree.Element("none")
        body = ElementTree.fromstring(parts.read("word/document.xml")).find(W + "body")
        styles = {s.get(W + "styleId"): s for s in tree("word/styles.xml").iter(W + "style")}
        numbering = tree("word/numbering.xml")
        links = {x.get("Id"): x.get("Target") for x in tree("word/_rels/document.xml.rels")}
    levels = {a.get(W + "abstractNumId"): {int(x.get(W + "ilvl")): _value(x, "numFmt") or "decimal" for x in a.findall(W + "lvl")} for a in numbering.findall(W + "abstractNum")}
    formats = {n.get(W + "numId"): levels.get(_value(n, "abstractNumId"), {}) for n in numbering.findall(W + "num") if n.find(W + "abstractNumId") is not None}
    for el in body:
        if el.tag == W + "tbl":
            yield {"kind": "table", "rows": _table(el)}
        elif el.tag == W + "p":
            style = styles.get(_value(el, "pPr", "pStyle"))
            number = _numbered(el) or _numbered(style)
            runs = []
            for x in el:
                if x.tag == W + "hyperlink":
                    runs.append({"text": "".join(_text(r) for r in x.iter(W + "r")), "bold": False, "italic": False, "url": links.get(x.get(R + "id")) or ""})
                elif x.tag == W + "r":
                    props = x.find(W + "rPr")
                    runs.append({"text": _text(x), "bold": _on(props, "b"), "italic": _on(props, "i"), "url": ""})
            name = _value(style, "name") if style is not None else None
            yield {"kind": "para", "style": name or "", "num_id": number[0] if number else None, "ilvl": number[1] if number else None, "fmt": formats.get(number[0], {}).get(number[1]) if number else None, "runs": runs}
