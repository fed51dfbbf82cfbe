"""A small corpus of files of all readable kinds, for tests and for the evaluation command. The texts are made by rule."""

from __future__ import annotations

import random
import zipfile
import zlib
from pathlib import Path
from xml.sax.saxutils import escape

TOPICS = "orchard harbour telescope ledger vineyard turbine archive glacier lantern compass".split()
WORDS = "plan review draft meeting survey sample report update outline summary method result table figure notes index".split()
KINDS = ("txt", "md", "csv", "json", "py", "rs", "docx", "pptx", "xlsx", "pdf")


def _zip(path: Path, parts: dict[str, str]) -> None:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)


def write_file(path: Path, topic: str, sentences: list[str]) -> None:
    body = " ".join(sentences)
    ext = path.suffix[1:]
    if ext == "md":
        path.write_text(f"# The {topic}\n\n" + "\n\n".join(sentences), "utf-8")
    elif ext == "csv":
        path.write_text("topic,sentence\n" + "\n".join(f'{topic},"{s}"' for s in sentences), "utf-8")
    elif ext == "json":
        path.write_text('{"topic": "%s", "text": "%s"}' % (topic, body), "utf-8")
    elif ext == "py":
        path.write_text(f'def {topic}_total(rows):\n    """{body}"""\n    return sum(rows)\n', "utf-8")
    elif ext == "rs":
        path.write_text(f"/// {body}\npub fn {topic}_total(rows: &[i64]) -> i64 {{\n    rows.iter().sum()\n}}\n", "utf-8")
    elif ext == "docx":
        p = "".join(f"<w:p><w:r><w:t>{escape(s)}</w:t></w:r></w:p>" for s in sentences)
        _zip(path, {"[Content_Types].xml": "<Types/>", "word/document.xml": f'<w:document xmlns:w="urn:w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>The {topic}</w:t></w:r></w:p>{p}</w:body></w:document>'})
    elif ext == "pptx":
        _zip(path, {f"ppt/slides/slide{k}.xml": f'<s xmlns:a="urn:a"><a:p><a:t>{escape(s)}</a:t></a:p></s>' for k, s in enumerate(sentences, 1)})
    elif ext == "xlsx":
        rows = "".join(f'<row><c t="inlineStr"><is><t>{topic}</t></is></c><c t="inlineStr"><is><t>{escape(s)}</t></is></c></row>' for s in sentences)
        _zip(path, {"xl/workbook.xml": '<w><sheets><sheet name="Data"/></sheets></w>', "xl/worksheets/sheet1.xml": f"<w><sheetData>{rows}</sheetData></w>"})
    elif ext == "pdf":
        stream = zlib.compress(("BT " + " T* ".join(f"({s}) Tj" for s in sentences) + " ET").encode("latin-1"))
        path.write_bytes(b"%PDF-1.4\n1 0 obj <</Type /Page>> endobj\n2 0 obj <</Filter /FlateDecode>>\nstream\n" + stream + b"\nendstream\nendobj\n%%EOF")
    else:
        path.write_text(body, "utf-8")


def generate(root: str, files: int = 300, seed: int = 5) -> list[dict]:
    """Writes the files below root; returns a query suite: for each file a query by name, and for each topic one by content."""
    rng = random.Random(seed)
    suite, base = [], Path(root)
    for k in range(files):
        topic, kind = TOPICS[k % len(TOPICS)], KINDS[(k // len(TOPICS)) % len(KINDS)]
        code = f"{topic[:3]}{k:04d}"
        folder = base / topic / ("deep" if k % 3 else "")
        folder.mkdir(parents=True, exist_ok=True)
        path = folder / f"{code}_{rng.choice(WORDS)}.{kind}"
        write_file(path, topic, [f"The {topic} {rng.choice(WORDS)} {code} names the {rng.choice(WORDS)} and the {rng.choice(WORDS)}." for _ in range(4)])
        if k % 20 == 0:
            suite.append({"id": f"n{k}", "query": path.stem, "query_type": "exact-name", "expected_files": [path.name]})
        if k % 20 == 7:
            suite.append({"id": f"k{k}", "query": f"{topic} {code}", "query_type": "keyword", "expected_files": [path.name]})
    return suite
