import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import dates, images, ranking, text, vectors

NOW = datetime(2026, 9, 22, 14, 30, tzinfo=UTC)
CFG = ranking.RankingConfig()


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("v")).first().v


def test_rrf_depth_recency(spark):
    assert one(spark, ranking.rrf(F.lit(1), 60.0, 1.0)) == pytest.approx(1 / 61)
    assert one(spark, ranking.rrf(F.lit(0), 60.0, 1.0)) == 0 and one(spark, ranking.rrf(F.lit(None).cast("int"), 60.0, 1.0)) == 0
    assert one(spark, ranking.depth_boost(F.lit("a"), 0.4)) == pytest.approx(1.4) and one(spark, ranking.depth_boost(F.lit("/a\\b/c"), 0.4)) == pytest.approx(1.1)
    at = lambda s: one(spark, ranking.recency_boost(F.lit(s).cast("timestamp"), NOW, 0.3, 90.0))
    assert at("2026-09-22 14:00:00Z") == pytest.approx(1.3) and at("2026-06-24 14:30:00Z") == pytest.approx(1.15) and at(None) == pytest.approx(1.3) and at("2030-01-01 00:00:00Z") == pytest.approx(1.3)


@pytest.mark.parametrize("name, query, want", [("Report.docx", "report.docx", 6.0), ("report.docx", "Report", 4.0), ("reports.docx", "report", 2.5), ("notes", "not", 2.5), ("my report.docx", "report", 1.0), ("x", " ", 1.0)])
def test_name_boost(spark, name, query, want):
    assert one(spark, ranking.name_boost(F.lit(name), query, CFG)) == want


def test_location_boost(spark):
    assert one(spark, ranking.location_boost(F.lit("C:\\Users\\me\\Downloads\\a"), ["downloads"], 0.8)) == pytest.approx(1.8)
    assert one(spark, ranking.location_boost(F.lit("/a"), [" ", "b"], 0.8)) == 1.0


@pytest.mark.parametrize("query, want", [("", "general"), ("photo beach", "image"), ("fn main", "code"), ("std::vec", "code"), ("snake_case", "code"), ("camelCase", "code"), ("budget", "document"), ("one two three four", "document"), ("alpha beta", "general"), ("ALLCAPS", "general")])
def test_intent(query, want):
    assert ranking.query_intent(query) == want


def test_type_prior(spark):
    p = lambda i, e, k=None: one(spark, ranking.type_prior(i, F.lit(e), F.lit(k).cast("string"), 0.3))
    assert p("code", "RS") == 1.3 and p("code", "pdf") == pytest.approx(1 / 1.3) and p("image", "pdf") == 1.0 and p("image", "py") == pytest.approx(1 / 1.3) and p("document", "zip", "document") == 1.3 and p("general", "rs") == 1.0


def test_trigrams_and_jaccard(spark):
    j = lambda a, b: one(spark, text.jaccard(text.trigrams(F.lit(a)), text.trigrams(F.lit(b))))
    assert j("Hello, World", "hello world!") == 1.0 and j("ab", "abc") == 0.0 and j("abcd", "bcde") == pytest.approx(1 / 3)
    assert one(spark, text.trigrams(F.lit("a"))) == []


def test_paths_kinds_globs(spark):
    for p, want in [("C:\\a\\b.TXT", ("b.TXT", "C:/a", "txt")), ("a", ("a", "", "")), ("/x/.git", (".git", "/x", "")), ("/x/a.tar.gz", ("a.tar.gz", "/x", "gz"))]:
        assert (one(spark, text.path_name(F.lit(p))), one(spark, text.path_parent(F.lit(p))), one(spark, text.path_ext(F.lit(p)))) == want
    assert [one(spark, text.file_kind(F.lit(e))) for e in ("PDF", "rs", "png", "zip", "xyz")] == ["document", "code", "image", "archive", "other"]
    x = lambda p, g: one(spark, text.excluded(F.lit(p), [g]))
    assert x("/a/node_modules/b", "**/node_modules/**") and not x("/a/modules/b", "**/node_modules/**") and x("a.tmp", "*.{tmp,log}") and x("ab1", "ab[0-9]") and not x("abx", "ab[!x]") and x("a.c", "a?c")


def test_terms_and_expression():
    assert text.match_expression('foo "bar* (baz-q) !') == '"foo"* "bar"* "baz-q"*' and text.match_expression(" ?! ") == ""
    assert text.query_terms("Foo baz-q x_y") == [["foo"], ["baz", "q"], ["x", "y"]]


def test_snippets(spark):
    assert one(spark, text.short_snippet(F.lit("a" * 160))) == "a" * 160 and one(spark, text.short_snippet(F.lit("b" * 159 + "  c"))) == "b" * 159 + "..."
    df = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(60)) + " Dusty ledger end"), (2, "short"), (3, None), (4, "")], "id int, text string")
    got = {r.id: r.snippet for r in text.with_snippet(df, ["dust", "ledger"]).collect()}
    assert got[2] == "short" and got[3] is None and got[4] == ""
    s = got[1]
    assert s.startswith("…") and "<mark>Dusty</mark> <mark>ledger</mark>" in s and len(s.split()) == 24
    assert one(spark, text.strip_marks(F.lit(s))).count("<") == 0
    assert one(spark, text.sentences(F.lit("A b. C d!\nE 3.5 f"))) == ["A b.", "C d!", "E 3.5 f"]


def test_dates(spark):
    d = lambda s: one(spark, dates.db_datetime(F.lit(s)))
    assert d("2026-01-02T03:04:05Z") == d("2026-01-02 03:04:05") == d("2026-01-02T04:04:05+01:00") is not None and d("2026-01-02") is None and d("x") is None


PAYLOADS = [
    ("upi://pay?pa=john.smith@bank&pn=J", "qr:payment", "upi://pay?pa=jo***h@bank&pn=J"), ("upi://pay?pa=ab@x", "qr:payment", "upi://pay?pa=***@x"), ("upi://pay?x=1", "qr:payment", "upi://pay?pa=***"),
    ("bitcoin:1A1zP1eP5QGefi2?amount=1", "qr:payment", "bitcoin:1A1z...efi2?amount=1"), ("00020101021126580014", "qr:payment", "000201010211...[EMVCo Payment QR]"), ("https://paypal.me/x", "qr:payment", None),
    ("WIFI:S:Net;T:WPA;P:secret;;", "qr:wifi", "WIFI:S:Net;T:WPA;P:***;;"), ("WIFI:P:secret;S:Net;;", "qr:wifi", "WIFI:P:***;S:Net;;"), ("BEGIN:VCARD\nN:x", "qr:contact", "BEGIN:VCARD\nN:x"), ("mailto:a@b", "qr:email", "mailto:a@b"),
    ("tel:1", "qr:tel", "tel:1"), ("SMSTO:1", "qr:sms", "SMSTO:1"), (" http://a", "qr:url", " http://a"), ("plain", "qr:text", "plain"),
]


@pytest.mark.parametrize("payload, tag, masked", PAYLOADS)
def test_payloads(spark, payload, tag, masked):
    t = one(spark, images.payload_tag(F.lit(payload)))
    assert t == tag
    if masked is not None:
        assert one(spark, images.mask_payload(F.lit(t), F.lit(payload))) == masked


@pytest.mark.parametrize("path, w, h, make, want", [("/a/Screenshot 1.png", 5, 5, None, True), ("/a/x.jpg", 1080, 1920, None, True), ("/a/x.jpg", 1081, 1920, None, False), ("/a/x.png", 1600, 1000, None, True), ("/a/x.png", 1920, 1080, "Canon", False), ("/a/x.png", 0, 0, None, False), ("/a/x.png", None, None, None, False)])
def test_screenshot(spark, path, w, h, make, want):
    got = one(spark, images.is_screenshot(F.lit(path), F.lit(w).cast("int"), F.lit(h).cast("int"), F.lit(make).cast("string"), F.lit(None).cast("string")))
    assert got is want


def test_vectors(spark):
    arr = lambda v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, vectors.dot(arr([1, 2]), arr([3, 4]))) == 11.0 and one(spark, vectors.dot(arr([1, 2]), arr([3]))) == 0.0
    assert one(spark, vectors.l2_norm(arr([3, 4]))) == 5.0 and one(spark, vectors.normalised(arr([0, 0]))) == [0.0, 0.0] and one(spark, vectors.rms(arr([1, -1]))) == 1.0
    assert vectors.unpack_half(vectors.pack_half([0.5, -2.0])) == [0.5, -2.0]


def test_schema_versions(spark, tmp_path):
    from lumenfold import schemas

    assert schemas.migrate(spark, str(tmp_path)) == 6 and schemas.migrate(spark, str(tmp_path)) == 0
    assert spark.read.parquet(f"{tmp_path}/files").schema == schemas.schema("files") and json.dumps(schemas.MIGRATIONS)
