"""File contents to documents: one `mapInPandas` that dispatches by extension; an error becomes a column, never a failed job.

Extractors are functions (path, bytes, Limits) -> Document. `Registry.register` adds or replaces one."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import LANGUAGES

# Extensions read as plain text and as program source.
PLAIN = "txt md markdown csv tsv json xml yaml yml toml ini cfg conf log tex rst org html css sql sh bat ps1 properties env".split()
CODE = "rs py js ts tsx jsx java kt c cpp h hpp cs go rb php swift".split()


@dataclass(frozen=True)
class Limits:
    max_bytes: int = 50 * 1024 * 1024
    max_pages: int = 1000


@dataclass
class Document:
    title: str | None = None
    blocks: list[tuple[str, int | None, str | None, int, int]] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)
    language_guess: str | None = None
    needs_ocr: bool = False

    def full_text(self) -> str:
        return "\n\n".join(b[0] for b in self.blocks)


Extractor = Callable[[str, bytes, Limits], Document]


def extension(path: str) -> str:
    name = path.replace("\\", "/").rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


def stem(path: str) -> str:
    name = path.replace("\\", "/").rpartition("/")[2]
    return name.rpartition(".")[0] or name


def decode(data: bytes) -> str:
    """By the byte-order mark, else UTF-8; damaged bytes become U+FFFD."""
    for mark, enc in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            try:
                return data[len(mark) :].decode(enc)
            except UnicodeDecodeError:
                return data.decode("utf-8", "replace")
    return data.decode("utf-8", "replace")


def _counts(text: str) -> dict[str, str]:
    return {"char_count": str(len(text)), "line_count": str(len(text.splitlines()))}


def plain_text(path: str, data: bytes, limits: Limits) -> Document:
    text = decode(data)
    doc = Document(metadata=_counts(text))
    if extension(path) in ("md", "markdown"):
        m = re.search(r"(?m)^\s*# (.*)$", text)
        doc.title = m.group(1).strip() if m else None
    at = 0
    for part in text.split("\n\n"):
        if part.strip():
            doc.blocks.append((part.strip(), None, None, at, at + len(part)))
        at += len(part) + 2
    return doc


def source_code(path: str, data: bytes, limits: Limits) -> Document:
    text = decode(data)
    return Document(stem(path), [(text, None, None, 0, len(text))] if text.strip() else [], _counts(text), LANGUAGES.get(extension(path)))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _properties(z: zipfile.ZipFile) -> dict[str, str]:
    out = {}
    if "docProps/core.xml" in z.namelist():
        for e in ET.fromstring(z.read("docProps/core.xml")):
            if e.text and e.text.strip():
                out[_local(e.tag)] = e.text.strip()
    return out


def _running(blocks: list[tuple[str, int | None, str | None]]) -> list[tuple[str, int | None, str | None, int, int]]:
    out, at = [], 0
    for text, page, section in blocks:
        out.append((text, page, section, at, at + len(text)))
        at += len(text) + 2
    return out


def docx(path: str, data: bytes, limits: Limits) -> Document:
    """Paragraphs; one in a heading style names the section of those after it, the first one the title."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body, meta = ET.fromstring(z.read("word/document.xml")), _properties(z)
    blocks, section, title = [], None, None
    for p in (e for e in body.iter() if _local(e.tag) == "p"):
        style, parts = "", []
        for e in p.iter():
            name = _local(e.tag)
            if name == "pStyle":
                style = next((v for k, v in e.attrib.items() if _local(k) == "val"), "")
            elif name == "t":
                parts.append(e.text or "")
            elif name == "tab":
                parts.append("\t")
            elif name in ("br", "cr"):
                parts.append("\n")
        text = "".join(parts).strip()
        if not text:
            continue
        if style.lower().startswith(("heading", "title")):
            section = text
            title = title or text
        blocks.append((text, None, section))
    return Document(meta.get("title") or title or stem(path), _running(blocks), meta)


def pptx(path: str, data: bytes, limits: Limits) -> Document:
    """A block per slide, in the order of the slide numbers; section `Slide n`; the first line of the first slide is the title."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide[^/]*\.xml", n)]
        number = lambda n: int(m.group(1)) if (m := re.search(r"(\d+)\.xml$", n)) else 1 << 30
        blocks = []
        for k, n in enumerate(sorted(names, key=lambda n: (number(n), n))[: limits.max_pages], 1):
            lines = []
            for p in (e for e in ET.fromstring(z.read(n)).iter() if _local(e.tag) == "p"):
                line = "".join(t.text or "" for t in p.iter() if _local(t.tag) == "t").strip()
                if line:
                    lines.append(line)
            if lines:
                blocks.append(("\n".join(lines), k, f"Slide {k}"))
        meta = _properties(z)
    title = meta.get("title") or (blocks[0][0].split("\n")[0] if blocks else stem(path))
    return Document(title, _running(blocks), meta | {"slide_count": str(len(names))})


def _cell(c: ET.Element, shared: list[str]) -> str:
    kind = c.attrib.get("t", "n")
    value = next((e.text or "" for e in c if _local(e.tag) == "v"), "")
    if kind == "s":
        return shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
    if kind == "inlineStr":
        return "".join(e.text or "" for e in c.iter() if _local(e.tag) == "t")
    if kind == "b":
        return "true" if value == "1" else "false"
    return value[:-2] if kind == "n" and value.endswith(".0") else value


def xlsx(path: str, data: bytes, limits: Limits) -> Document:
    """A block per sheet: rows as lines, cells parted by tabs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        titles = []
        if "xl/workbook.xml" in names:
            titles = [e.attrib.get("name", "") for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rpartition("/")[2]).group()))
        blocks = []
        for k, n in enumerate(sheets[: limits.max_pages]):
            rows = []
            for r in (e for e in ET.fromstring(z.read(n)).iter() if _local(e.tag) == "row"):
                cells = [_cell(c, shared) for c in r if _local(c.tag) == "c"]
                if any(cells):
                    rows.append("\t".join(cells))
            if rows:
                blocks.append(("\n".join(rows), k + 1, titles[k] if k < len(titles) else f"Sheet {k + 1}"))
        meta = _properties(z)
    return Document(stem(path), _running(blocks), meta | {"sheet_count": str(len(sheets))})


def ods(path: str, data: bytes, limits: Limits) -> Document:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("content.xml"))
    blocks = []
    for k, t in enumerate(e for e in body.iter() if _local(e.tag) == "table"):
        rows = []
        for r in (e for e in t.iter() if _local(e.tag) == "table-row"):
            cells = ["".join(c.itertext()).strip() for c in r if _local(c.tag) == "table-cell"]
            if any(cells):
                rows.append("\t".join(cells).rstrip("\t"))
        if rows and k < limits.max_pages:
            blocks.append(("\n".join(rows), k + 1, next((v for a, v in t.attrib.items() if _local(a) == "name"), f"Sheet {k + 1}")))
    return Document(stem(path), _running(blocks), {})


def _literals(content: bytes) -> str:
    out = []
    for m in re.finditer(rb"\((?:\\.|[^()\\])*\)|(?<![A-Za-z])(?:T\*|Td|TD|ET)(?![A-Za-z])", content):
        t = m.group(0)
        if t.startswith(b"("):
            s = re.sub(rb"\\([nrtbf()\\])", lambda e: {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}.get(e.group(1), e.group(1)), t[1:-1])
            out.append(re.sub(rb"\\(\d{1,3})", lambda e: bytes([int(e.group(1), 8) & 255]), s).decode("latin-1"))
        else:
            out.append("\n")
    return re.sub(r"[ \t]*\n[\n ]*", "\n", "".join(out)).strip()


def pdf(path: str, data: bytes, limits: Limits) -> Document:
    """Text operators of plain and deflated page streams. A page whose fonts need more than that has no text here; a
    document without any text needs OCR."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    pages = len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", data))
    meta = {"page_count": str(pages)}
    for key in (b"Title", b"Author", b"Creator"):
        m = re.search(rb"/" + key + rb"\s*\(((?:\\.|[^()\\])*)\)", data)
        if m:
            meta[key.decode().lower()] = m.group(1).decode("latin-1")
    blocks = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        raw = m.group(1)
        if b"FlateDecode" in data[max(0, m.start() - 300) : m.start()].rpartition(b"obj")[2]:
            try:
                raw = zlib.decompress(raw)
            except zlib.error:
                continue
        if b"BT" in raw and (b"Tj" in raw or b"TJ" in raw):
            text = _literals(raw)
            if text and len(blocks) < limits.max_pages:
                blocks.append((text, len(blocks) + 1, None))
    return Document(meta.get("title") or stem(path), _running(blocks), meta, needs_ocr=not blocks)


def image_header(data: bytes) -> tuple[int | None, int | None, str | None]:
    """Width, height and format from the header of PNG, JPEG, GIF, BMP or WebP."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return (*struct.unpack(">II", data[16:24]), "png")
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return (*struct.unpack("<HH", data[6:10]), "gif")
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h), "bmp"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"), "webp"
        if data[12:16] == b"VP8 ":
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF, "webp"
        if data[12:16] == b"VP8L":
            b = int.from_bytes(data[21:25], "little")
            return 1 + (b & 0x3FFF), 1 + ((b >> 14) & 0x3FFF), "webp"
    if data[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(data) and data[i] == 0xFF:
            kind, size = data[i + 1], int.from_bytes(data[i + 2 : i + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[i + 5 : i + 9])
                return w, h, "jpeg"
            i += 2 + size
        return None, None, "jpeg"
    return None, None, None


_EXIF = {0x010F: "camera_make", 0x0110: "camera_model", 0x0132: "exif_date", 0x9003: "exif_date"}


def exif(data: bytes) -> dict[str, str]:
    """Camera and date of a JPEG's EXIF block."""
    at = data.find(b"Exif\x00\x00")
    if data[:2] != b"\xff\xd8" or at < 0:
        return {}
    t = data[at + 6 :]
    end = "<" if t[:2] == b"II" else ">"
    out: dict[str, str] = {}
    try:
        todo = [struct.unpack(end + "I", t[4:8])[0]]
        for ifd in todo[:3]:
            for k in range(struct.unpack(end + "H", t[ifd : ifd + 2])[0]):
                tag, kind, count, value = struct.unpack(end + "HHII", t[ifd + 2 + 12 * k : ifd + 14 + 12 * k])
                if tag == 0x8769 and len(todo) < 3:
                    todo.append(value)
                elif tag in _EXIF and kind == 2:
                    raw = t[value : value + count] if count > 4 else struct.pack(end + "I", value)[:count]
                    out.setdefault(_EXIF[tag], raw.rstrip(b"\x00").decode("latin-1").strip())
    except struct.error:
        pass
    return {k: v for k, v in out.items() if v}


class Registry:
    def __init__(self):
        self.by_ext: dict[str, Extractor] = {}
        for exts, f in ((PLAIN, plain_text), (CODE, source_code), (["pdf"], pdf), (["docx"], docx), (["pptx"], pptx), (["xlsx", "xlsm"], xlsx), (["ods"], ods)):
            self.register(exts, f)

    def register(self, exts: list[str], extractor: Extractor) -> None:
        for e in exts:
            self.by_ext[e.lower()] = extractor

    def extract(self, path: str, data: bytes, limits: Limits | None = None) -> Document:
        """By extension; an unknown one by content: text is read as plain text, binary gives an empty document."""
        limits = limits or Limits()
        if len(data) > limits.max_bytes:
            raise ValueError(f"larger than {limits.max_bytes} bytes")
        f = self.by_ext.get(extension(path))
        if f is None:
            head = data[:8192]
            binary = b"\x00" in head or (head and sum(b < 9 or 13 < b < 32 for b in head) / len(head) > 0.1)
            return Document(stem(path)) if binary else plain_text(path, data, limits)
        return f(path, data, limits)


RESULT = "path string, title string, blocks array<struct<text: string, page: int, section: string, start_offset: int, end_offset: int>>, metadata map<string,string>, language_guess string, needs_ocr boolean, error string"


def list_files(spark, root: str) -> DataFrame:
    """path, length, modificationTime of all files below root; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")


def read_files(spark, root: str, max_bytes: int = Limits.max_bytes) -> DataFrame:
    """Files up to the size limit; the filter on length reaches the source."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)


def extract(files: DataFrame, registry: Registry | None = None, limits: Limits | None = None) -> DataFrame:
    """files: path, content. One row per file; a failure has its words in `error`."""
    registry, limits = registry or Registry(), limits or Limits()

    def run(batches):
        for pdf_ in batches:
            rows = []
            for path, data in zip(pdf_["path"], pdf_["content"]):
                try:
                    d, err = registry.extract(path, bytes(data or b""), limits), None
                except Exception as e:  # noqa: BLE001 - one file never stops the job
                    d, err = Document(), f"{type(e).__name__}: {e}"[:500]
                rows.append((path, d.title, d.blocks, d.metadata, d.language_guess, d.needs_ocr, err))
            yield pd.DataFrame(rows, columns=["path", "title", "blocks", "metadata", "language_guess", "needs_ocr", "error"])

    return files.select("path", "content").mapInPandas(run, RESULT)


def image_metadata(files: DataFrame) -> DataFrame:
    """path, width, height, format and EXIF fields from the first bytes of images."""

    def run(batches):
        for pdf_ in batches:
            rows = []
            for path, data in zip(pdf_["path"], pdf_["content"]):
                data = bytes(data or b"")
                w, h, kind = image_header(data)
                e = exif(data)
                rows.append((path, w, h, kind, e.get("exif_date"), e.get("camera_make"), e.get("camera_model")))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "format", "exif_date", "camera_make", "camera_model"])

    return files.select("path", "content").mapInPandas(run, "path string, width int, height int, format string, exif_date string, camera_make string, camera_model string")
