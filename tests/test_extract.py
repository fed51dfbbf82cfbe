import io
import struct
import zipfile
import zlib

import pytest

from lumenfold.sources import extract as ex
from lumenfold.sources.config import Settings


def zipped(**parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in parts.items():
            z.writestr(n.replace("__", "/").replace("_DOT_", "."), t)
    return b.getvalue()


def make_zip(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return b.getvalue()


W = 'xmlns:w="http://w"'
DOCX = make_zip({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Plan</w:t></w:r></w:p><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/></w:body></w:document>', "docProps/core.xml": '<c xmlns:d="http://d"><d:creator>Someone</d:creator></c>'})
PPTX = make_zip({f"ppt/slides/slide{k}.xml": f'<s xmlns:a="http://a"><a:p><a:t>Slide text {k}</a:t></a:p></s>' for k in (10, 2, 1)})
XLSX = make_zip({"xl/workbook.xml": '<w><sheets><sheet name="First"/></sheets></w>', "xl/sharedStrings.xml": "<s><si><t>name</t></si></s>", "xl/worksheets/sheet1.xml": '<w><sheetData><row><c t="s"><v>0</v></c><c><v>3.0</v></c><c t="b"><v>1</v></c><c t="inlineStr"><is><t>x</t></is></c></row></sheetData></w>'})
ODS = make_zip({"content.xml": '<o xmlns:t="http://t"><t:table t:name="S"><t:table-row><t:table-cell><p>a</p></t:table-cell><t:table-cell><p>b</p></t:table-cell></t:table-row></t:table></o>'})
PDF = b"%PDF-1.4\n1 0 obj <</Type /Catalog>> endobj\n2 0 obj <</Type /Page>> endobj\n3 0 obj <</Length 9>>\nstream\nBT (Hello \\(world\\)) Tj T* (again) Tj ET\nendstream\nendobj\n4 0 obj <</Title (My title)>> endobj\n5 0 obj <</Filter /FlateDecode>>\nstream\n" + zlib.compress(b"BT (packed) Tj ET") + b"\nendstream\nendobj"
R = ex.Registry()


def test_plain_and_code():
    d = R.extract("/a/n.md", "x\n# Head \n\n\n\nbody".encode())
    assert d.title == "Head" and [b[0] for b in d.blocks] == ["x\n# Head", "body"] and d.metadata["line_count"] == "6"
    assert R.extract("a.txt", b"\xff\xfeh\x00i\x00").blocks[0][0] == "hi" and R.extract("a.txt", b"\xef\xbb\xbfhi").blocks[0][0] == "hi" and "\ufffd" in R.extract("a.txt", b"a\xff").full_text()
    c = R.extract("x/main.RS", b"fn main() {}\n")
    assert c.language_guess == "rust" and c.title == "main" and len(c.blocks) == 1


def test_office():
    d = R.extract("a.docx", DOCX)
    assert d.title == "Plan" and [(b[0], b[2]) for b in d.blocks] == [("Plan", "Plan"), ("One\ttwo", "Plan")] and d.metadata["creator"] == "Someone" and d.blocks[1][3] == 6
    assert [(b[0], b[1], b[2]) for b in R.extract("a.pptx", PPTX).blocks] == [("Slide text 1", 1, "Slide 1"), ("Slide text 2", 2, "Slide 2"), ("Slide text 10", 3, "Slide 3")]
    x = R.extract("a.xlsx", XLSX)
    assert x.blocks[0][0] == "name\t3\ttrue\tx" and x.blocks[0][2] == "First"
    assert R.extract("a.ods", ODS).blocks[0][0] == "a\tb"


def test_pdf():
    d = R.extract("a.pdf", PDF)
    assert d.title == "My title" and d.blocks[0][0] == "Hello (world)\nagain" and d.blocks[1][0] == "packed" and not d.needs_ocr
    assert R.extract("a.pdf", b"%PDF-1.4 /Type /Page").needs_ocr


def test_unknown_and_custom():
    assert R.extract("a.zzz", b"text here").blocks and not R.extract("a.zzz", b"\x00\x01\x02").blocks and not R.extract("a", b"").blocks
    r = ex.Registry()
    r.register(["ZZZ"], lambda p, d, lim: ex.Document("own"))
    assert r.extract("b.zzz", b"").title == "own"
    with pytest.raises(ValueError):
        r.extract("a.txt", b"123", ex.Limits(max_bytes=2))


GARBAGE = [b"", b"\x00" * 64, b"PK\x03\x04broken", b"%PDF", b"<xml", bytes(range(256))]


def test_robust(spark):
    rows = [(f"/{k}.{e}", g) for k, g in enumerate(GARBAGE) for e in ("docx", "pptx", "xlsx", "ods", "pdf", "txt", "rs", "json")]
    rows += [("/ok.docx", DOCX), ("/null.txt", None)]
    got = {r.path: r for r in ex.extract(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert len(got) == len(rows) and got["/2.docx"].error and got["/ok.docx"].error is None and got["/ok.docx"].blocks[1].section == "Plan" and got["/null.txt"].blocks == []


def test_read_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("hello")
    (tmp_path / "big.txt").write_text("x" * 100)
    assert ex.list_files(spark, str(tmp_path)).count() == 2
    small = ex.read_files(spark, str(tmp_path), 50)
    assert [r.blocks[0].text for r in ex.extract(small).collect()] == ["hello"]


def test_image_headers(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + struct.pack(">II", 640, 480)
    gif = b"GIF89a" + struct.pack("<HH", 7, 9)
    tiff = b"II*\x00\x08\x00\x00\x00\x01\x00" + struct.pack("<HHII", 0x010F, 2, 6, 26) + b"\x00\x00\x00\x00" + b"Canon\x00"
    app1 = b"Exif\x00\x00" + tiff
    jpg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 30, 40) + b"\x00\x00"
    df = spark.createDataFrame([("p", png), ("g", gif), ("j", jpg), ("x", b"nothing"), ("n", None)], "path string, content binary")
    got = {r.path: (r.width, r.height, r.format, r.camera_make) for r in ex.image_metadata(df).collect()}
    assert got == {"p": (640, 480, "png", None), "g": (7, 9, "gif", None), "j": (40, 30, "jpeg", "Canon"), "x": (None, None, None, None), "n": (None, None, None, None)}


def test_settings(tmp_path):
    p = tmp_path / "c.json"
    assert Settings.load(str(p)) == Settings()
    p.write_text("{broken")
    assert Settings.load(str(p)) == Settings()
    p.write_text('{"workers": 4, "max_file_size": "x", "unknown": 1}')
    s = Settings.load(str(p))
    assert s.workers == 4 and s.max_file_size == Settings().max_file_size
    s.save(str(p))
    assert Settings.load(str(p)) == s and Settings(workers=0, folders=["/none"], exclusions=[" "]).validate() == ["workers must be 1 to 64", "folder doesn't exist: /none", "empty exclusion pattern"]
