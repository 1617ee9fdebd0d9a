"""Scans: binary files of many formats, one row per element.

``scan`` reads a folder with Spark's binary source; each file is parsed where it is
read.  PDF, image and OCR readers need packages that may be absent: they are
parameters (``parsers``), and files of a format without a parser get one row with
``error`` set.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import unicodedata
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

Element = dict
Parser = Callable[[bytes], list[Element]]
PREVIEW_ROWS = 200
ELEMENT = "type string, text string, position int, level int, extra map<string,string>"
SKIPPED = ("script", "style", "noscript", "nav", "footer", "header", "aside")
BLOCKS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6, "p": 0, "li": 0}
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def element(kind: str, text: str, position: int | None = None, level: int | None = None, **extra) -> Element:
    return {"type": kind, "text": text, "position": position, "level": level, "extra": {k: str(v) for k, v in extra.items()}}


#: Byte order marks, and single-byte code pages that are told apart by what they make of a text.
MARKS = {b"\xef\xbb\xbf": "utf-8-sig", b"\xff\xfe\x00\x00": "utf-32", b"\x00\x00\xfe\xff": "utf-32", b"\xff\xfe": "utf-16", b"\xfe\xff": "utf-16"}
PAGES = ("cp1252", "cp1250", "cp1251", "koi8_r", "cp1253", "iso8859_7")


def _plausible(text: str) -> float:
    """How much a text looks like words: letters beyond ASCII of one script that stand as they do in it, less what seldom occurs."""
    score = 0.0
    for before, c, after in zip(" " + text, text, text[1:] + " ", strict=False):
        if ord(c) < 128:
            continue
        kind = unicodedata.category(c)
        if kind[0] != "L":
            score -= 1.5 if kind[0] in "CS" else 0.5 if kind[0] != "P" else 0.2
            continue
        latin = ord(c) < 0x250
        near_latin = any(x.isascii() and x.isalpha() for x in (before, after))
        if latin:  # an accented letter stands among plain ones
            score += 1.0 if near_latin else -0.3 if before.isalpha() else 0.3
        else:  # letters of another script stand among their like
            score += -1.0 if near_latin else 1.0 if before.isalpha() else 0.4
        score -= 0.4 if c in SELDOM else 0.0
        if before.isalpha() and before.islower() and c.isupper():
            score -= 1.5
    return score


#: Letters that seldom occur in the languages of these code pages.
SELDOM = "ŔŕĹĺŐőÐÞÝðþýЂЃѓЉЊЌЋЏђљњќћџЎўЈҐґΐΰ"
#: Bytes by which a code page is chosen; the whole text is decoded by it.
TRIED = 65_536


def detect(data: bytes) -> str:
    """The character set of a text: by its mark, UTF-8 if it is valid, UTF-16 by its zero bytes, else the code page that makes most sense."""
    for mark, name in MARKS.items():
        if data.startswith(mark):
            return name
    try:
        data.decode("utf-8")
        if b"\0" not in data:
            return "utf-8"
    except UnicodeDecodeError:
        pass
    sample = data[:TRIED]
    zeros = [sample[k::2].count(0) / max(1, len(sample[k::2])) for k in (0, 1)]
    if max(zeros) > 0.2 and min(zeros) < 0.05:
        return "utf-16-le" if zeros[1] > zeros[0] else "utf-16-be"
    tried = [(_plausible(sample.decode(page, "replace")), -i, page) for i, page in enumerate(PAGES)]
    return max(tried)[2]


def decode(data: bytes, charset: str | None = None) -> str:
    """A text in its character set, Unix line ends."""
    return data.decode(charset or detect(data), "replace").replace("\r\n", "\n").replace("\r", "\n")


def parse_text(data: bytes) -> list[Element]:
    """Paragraphs; the first one names the character set unless it is UTF-8."""
    charset = detect(data)
    found = [element("paragraph", p.strip()) for p in decode(data, charset).split("\n\n") if p.strip()]
    if found and not charset.startswith("utf-8"):
        found[0]["extra"] = {"charset": charset}
    return found


class _Html(HTMLParser):
    """Collects blocks in document order; tables are one element, chrome is skipped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[Element] = []
        self.title: list[str] = []
        self.skip = 0
        self.lists = 0
        self.in_title = False
        self.open: list[dict] = []
        self.tables: list[dict] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in SKIPPED:
            self.skip += 1
        if self.skip or tag in VOID:
            return
        if tag == "title":
            self.in_title = True
        elif tag == "table":
            slot = element("table", "")
            self.out.append(slot)
            self.tables.append({"slot": slot, "rows": []})
        elif self.tables:
            if tag == "tr":
                self.tables[-1]["rows"].append([])
            elif tag in ("td", "th") and self.tables[-1]["rows"]:
                self.tables[-1]["rows"][-1].append([])
        elif tag in ("ul", "ol"):
            self.lists += 1
        elif tag in BLOCKS:
            if tag == "p":
                self._close("p")
            elif tag == "li" and any(b["tag"] == "li" and b["lists"] == self.lists for b in self.open):
                self._close("li")  # its end tag may be left out
            slot = element("heading" if BLOCKS[tag] else "list_item" if tag == "li" else "paragraph", "", level=BLOCKS[tag] or None)
            self.out.append(slot)
            self.open.append({"tag": tag, "slot": slot, "parts": [], "lists": self.lists})

    def _close(self, tag: str) -> None:
        if any(b["tag"] == tag for b in self.open):
            while self.open:
                block = self.open.pop()
                block["slot"]["text"] = " ".join(block["parts"])
                if block["tag"] == tag:
                    break

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag == "title":
            self.in_title = False
        elif tag == "table" and self.tables:
            table = self.tables.pop()
            rows = [[" ".join(c) for c in r] for r in table["rows"]]
            rows = [r for r in rows if any(r)]
            table["slot"]["text"] = "\n".join(" | ".join(r) for r in rows)
            table["slot"]["extra"] = {"rows": str(len(rows))}
        elif tag in ("ul", "ol"):
            self.lists = max(0, self.lists - 1)
            while self.open and self.open[-1]["tag"] == "li" and self.open[-1]["lists"] > self.lists:
                self._close("li")
        elif tag in BLOCKS and not self.tables:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        text = " ".join(data.split())
        if not text or self.skip:
            return
        if self.in_title:
            self.title.append(text)
        elif self.tables:
            if self.tables[-1]["rows"] and self.tables[-1]["rows"][-1]:
                self.tables[-1]["rows"][-1][-1].append(text)
        else:
            for block in self.open:
                block["parts"].append(text)

    def elements(self) -> list[Element]:
        for block in self.open:
            block["slot"]["text"] = " ".join(block["parts"])
        return [e for e in self.out if e["text"]]


def parse_html(data: bytes) -> list[Element]:
    parser = _Html()
    parser.feed(decode(data))
    parser.close()
    found = parser.elements()
    if found and parser.title:
        found[0]["extra"] = found[0]["extra"] | {"title": " ".join(parser.title)}
    return found


def parse_csv(data: bytes) -> list[Element]:
    """Each row as ``header: value`` pairs at its row number, then a preview of the table."""
    text = decode(data)
    try:
        dialect = csv.Sniffer().sniff(text[:4096], delimiters=",;\t|")
    except csv.Error:
        first = text.partition("\n")[0]  # what the first line has most of, of its own file alone
        dialect = type("Own", (csv.excel,), {"delimiter": max(",;\t|", key=first.count)})
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text), dialect)]
    rows = [r for r in rows if any(r)]
    if not rows:
        return []
    header = rows[0]
    name = lambda j: header[j] if j < len(header) else f"col{j + 1}"
    out = [element("row", " | ".join(f"{name(j)}: {c}" for j, c in enumerate(r) if c), i) for i, r in enumerate(rows[1:], 2)]
    preview = "\n".join(" | ".join(r) for r in rows[: PREVIEW_ROWS + 1])
    return [*out, element("table", preview, rows=len(rows) - 1, cols=len(header), truncated=len(rows) - 1 > PREVIEW_ROWS)]


#: XML names of the two office formats.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _cells(table, row: str, cell: str, text: str) -> str:
    rows = [[" ".join("".join(t.text or "" for t in c.iter(text)).split()) for c in r.iter(cell)] for r in table.iter(row)]
    return "\n".join(" | ".join(r) for r in rows if any(r))


def parse_docx(data: bytes) -> list[Element]:
    """The body in order: headings by style, list items, paragraphs, tables."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        core = _core(z)
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    for node in body if body is not None else ():
        if node.tag == f"{_W}tbl":
            text = _cells(node, f"{_W}tr", f"{_W}tc", f"{_W}t")
            if text:
                out.append(element("table", text))
        elif node.tag == f"{_W}p":
            text = "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
            style = next((s.get(f"{_W}val", "") for s in node.iter(f"{_W}pStyle")), "").lower().replace(" ", "")
            level = re.fullmatch(r"heading(\d)", style)
            if not text:
                continue
            if level or style == "title":
                out.append(element("heading", text, level=int(level[1]) if level else 1))
            else:
                out.append(element("list_item" if style.startswith("list") else "paragraph", text))
    return _described(out, core)


def _core(archive: zipfile.ZipFile) -> dict[str, str]:
    """Title, author and times of an office file."""
    if "docProps/core.xml" not in archive.namelist():
        return {}
    named = {"title": "title", "creator": "author", "created": "created", "modified": "modified"}
    root = ElementTree.fromstring(archive.read("docProps/core.xml"))
    found = {named[tag]: (node.text or "").strip() for node in root.iter() if (tag := node.tag.rpartition("}")[2]) in named}
    return {k: v for k, v in found.items() if v}


def _described(found: list[Element], core: dict[str, str]) -> list[Element]:
    """Elements, of which the first tells the file's own properties."""
    if found and core:
        found[0]["extra"] = found[0]["extra"] | core
    return found


def _related(archive: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """(kind, target part) by id of the parts that a part refers to."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in archive.namelist():
        return {}
    return {r.get("Id"): (r.get("Type", "").rpartition("/")[2], posixpath.normpath(posixpath.join("/", folder, r.get("Target", ""))).lstrip("/")) for r in ElementTree.fromstring(archive.read(rels))}


def _slides(archive: zipfile.ZipFile) -> list[str]:
    """The slides' parts in the order of the presentation; by number where it doesn't list them."""
    names = set(archive.namelist())
    if "ppt/presentation.xml" in names:
        parts = _related(archive, "ppt/presentation.xml")
        listed = [parts.get(s.get(f"{_R}id"), ("", ""))[1] for s in ElementTree.fromstring(archive.read("ppt/presentation.xml")).iter(f"{_P}sldId")]
        if listed and all(n in names for n in listed):
            return listed
    numbered = [(int(m[1]), n) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))]
    return [n for _, n in sorted(numbered)]


def _paragraphs(node) -> str:
    return "\n".join(t for p in node.iter(f"{_A}p") if (t := "".join(x.text or "" for x in p.iter(f"{_A}t")).strip()))


def _notes(root) -> str:
    """The text of a notes page's body; its other shapes repeat the slide's number or picture."""
    bodies = [s for s in root.iter(f"{_P}sp") if any(h.get("type") == "body" for h in s.iter(f"{_P}ph"))]
    return "\n".join(t for s in bodies if (t := _paragraphs(s))) if bodies else _paragraphs(root)


def parse_pptx(data: bytes) -> list[Element]:
    """Per slide, in the order of the presentation: title, bodies and tables, and the notes that belong to it."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        core = _core(z)
        for number, name in enumerate(_slides(z), 1):
            root = ElementTree.fromstring(z.read(name))
            for shape in root.iter():
                if shape.tag == f"{_A}tbl":
                    text, kind = _cells(shape, f"{_A}tr", f"{_A}tc", f"{_A}t"), "table"
                elif shape.tag == f"{_P}sp":
                    holder = next(iter(shape.iter(f"{_P}ph")), None)
                    kind = "slide_title" if holder is not None and holder.get("type") in ("title", "ctrTitle") else "slide_body"
                    text = _paragraphs(shape)
                else:
                    continue
                if text:
                    out.append(element(kind, text, number, 1 if kind == "slide_title" else None))
            for kind, part in _related(z, name).values():
                if kind == "notesSlide" and part in z.namelist() and (text := _notes(ElementTree.fromstring(z.read(part)))):
                    out.append(element("speaker_notes", text, number))
    return _described(out, core)


PARSERS: dict[str, Parser] = {
    ".txt": parse_text, ".md": parse_text, ".log": parse_text, ".html": parse_html, ".htm": parse_html, ".csv": parse_csv, ".tsv": parse_csv, ".docx": parse_docx, ".pptx": parse_pptx,
}


def elements_of(content: Column, ext: Column, parsers: dict[str, Parser] | None = None) -> Column:
    """Struct of elements and error for a binary column and its extension."""
    known = PARSERS | (parsers or {})

    @F.pandas_udf(f"elements array<struct<{', '.join(':'.join(f.split(' ', 1)) for f in ELEMENT.split(', '))}>>, error string")
    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, exts in T.slices(batches):
            out = []
            for data, e in zip(contents, exts, strict=True):
                try:
                    out.append((known[e](bytes(data)), None) if e in known else ([], f"unsupported format {e!r}"))
                except Exception as error:  # a broken file must not stop the others
                    out.append(([], f"{type(error).__name__}: {error}"[:300]))
            yield pd.DataFrame(out, columns=["elements", "error"])

    return parse.asNondeterministic()(content, ext)  # else the filter of an explode is pushed down and parses all once more


def scan(spark: SparkSession, folder: str, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """One row per file: path, ext, size, modified, sha256, elements, error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = files.select("path", T.suffix("path").alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), "content")
    return rows.withColumn("p", elements_of(F.col("content"), F.col("ext"), parsers)).select("path", "ext", "size", "modified", "sha256", "p.elements", "p.error")


def explode_elements(files: DataFrame, *keep: str) -> DataFrame:
    """One row per element, in order."""
    return files.select(*keep, F.posexplode("elements").alias("elem_idx", "e")).select(*keep, "elem_idx", "e.*")


#: Small pages that a task parses, about.
PAGES_A_TASK = 20_000


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a table that is small on disk, dealt over as many partitions as the parsing of a page for each asks for."""
    return rows.repartition(max(1, -(-rows.count() // PAGES_A_TASK)))


def html_elements(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """Elements of an HTML column."""
    parsed = pages.select(F.col(id_col).alias("doc_id"), elements_of(F.col(html).cast("binary"), F.lit(".html")).alias("p"))
    return explode_elements(parsed.select("doc_id", "p.elements"), "doc_id")


def text_elements(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Paragraphs of a text column, split at blank lines: no Python needed."""
    unix = F.regexp_replace(F.col(text), "\r\n?", "\n")
    parts = F.filter(F.transform(F.split(unix, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("elem_idx", "text"))
    return rows.select("doc_id", "elem_idx", F.lit("paragraph").alias("type"), "text", F.lit(None).cast("int").alias("position"), F.lit(None).cast("int").alias("level"))


def row_text(*names: str) -> Column:
    """A table row as ``name: value | name: value``, empty values left out."""
    cell = lambda n: F.when(F.trim(F.col(n).cast("string")) != "", F.concat(F.lit(f"{n}: "), F.trim(F.col(n).cast("string"))))
    return F.concat_ws(" | ", *[cell(n) for n in names])


def document_metadata(files: DataFrame) -> DataFrame:
    """Title, media type and counts of scanned files."""
    title = F.element_at(F.element_at("elements", 1)["extra"], "title")
    return files.select(
        "path", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), F.col("ext").alias("file_type"), F.col("size").alias("size_bytes"), "sha256", T.mime_type("path").alias("mime_type"),
        F.coalesce(F.when(F.size("elements") > 0, title), T.stem("path")).alias("title"), F.size("elements").alias("element_count"), F.col("modified").alias("modified_at"), F.current_timestamp().alias("ingested_at"),
    )


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, question, relevant_sources, expected_keywords, agent_id) of a golden dataset file."""
    schema = "name string, cases array<struct<question:string, relevant_sources:array<string>, expected_keywords:array<string>, agent_id:string>>"
    read = spark.read.schema(schema).json(path, multiLine=True)
    return read.select(F.col("name").alias("dataset"), F.explode("cases").alias("c")).select("dataset", "c.*")
