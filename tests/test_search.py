from datetime import UTC, datetime

import pytest

from lumenfold.operators import search
from lumenfold.plans.nlq import parse_query

NOW = datetime(2026, 9, 22, 14, 30, tzinfo=UTC)
M = datetime(2026, 9, 1)


@pytest.fixture(scope="module")
def index(spark):
    names = [(1, "/a/report.docx", "document"), (2, "/a/b/c/report.docx", "document"), (3, "/a/report_final.docx", "document"), (4, "/x/AnnualReport.pdf", "document"), (5, "/x/shot.png", "image"), (6, "/x/main.rs", "code"), (7, "/x/old report.txt", "document")]
    files = [(i, p, p.rpartition("/")[0], p.rpartition("/")[2], p.rpartition(".")[2], 1, M, M, k, None, "deleted" if i == 7 else "error" if i == 6 else "active", None, None) for i, p, k in names]
    F_ = spark.createDataFrame(files, "id long, path string, parent_dir string, name string, ext string, size long, mtime timestamp, ctime timestamp, kind string, content_hash string, status string, last_indexed_at timestamp, error string")
    texts = [(10, 3, 0, "the quarterly ledger shows a dusty surplus in every column of the page"), (11, 3, 1, "the quarterly ledger shows a dusty surplus in every column of the page again"), (12, 3, 2, "another topic: gardens, ledgers and lanterns"), (13, 4, 0, "ledger"), (14, 6, 0, "fn ledger() {}"), (15, 7, 0, "ledger ledger")]
    C = spark.createDataFrame([(i, f, o, t, 0, len(t), 1, "s", None) for i, f, o, t in texts], "id long, file_id long, ordinal int, text string, start_offset int, end_offset int, page int, section string, symbol string")
    V = spark.createDataFrame([(10, 3, "m", 2, "h", [1.0, 0.0]), (11, 3, "m", 2, "h", [0.9, 0.1]), (13, 4, "m", 2, "h", [0.8, 0.6]), (14, 6, "m", 2, "h", [0.5, 0.5]), (15, 7, "m", 2, "h", [1.0, 1.0]), (12, 3, "n", 2, "h", [5.0, 0.0])], "chunk_id long, file_id long, model_id string, dims int, text_hash string, vector array<float>")
    T = spark.createDataFrame([(1, 5, "qr:payment", "upi://x"), (2, 5, "type:photo", None)], "id long, file_id long, tag string, payload string")
    I = spark.createDataFrame([(5, 10, 10, True)], "file_id long, width int, height int, is_screenshot boolean")  # noqa: E741
    return {"files": F_, "chunks": C, "chunk_vectors": V, "image_tags": T, "image_metadata": I}


def test_filename(spark, index):
    got = [r.path for r in search.filename_search(index["files"], "report", 10, NOW).collect()]
    assert got[0] == "/a/report.docx" and got.index("/a/report.docx") < got.index("/a/b/c/report.docx") and "/x/old report.txt" not in got and "/x/AnnualReport.pdf" in got
    assert [r.id for r in search.filename_search(index["files"], "sh", 10, NOW).collect()] == [5]
    assert search.filename_search(index["files"], "  ", 10, NOW).count() == 0


def test_content(spark, index):
    got = {r.chunk_id: r for r in search.content_search(index["chunks"], index["files"], "dust ledg", 10, NOW).collect()}
    assert set(got) == {10, 11} and "<mark>ledger</mark>" in got[10].snippet and got[10].page == 1
    assert search.content_search(index["chunks"], index["files"], "?!", 10, NOW).count() == 0
    assert {r.chunk_id for r in search.content_hits(index["chunks"], "dusty-surp").collect()} == {10, 11}  # a phrase
    assert search.content_hits(index["chunks"], "surplus-dusty").count() == 0
    assert search.postings(index["chunks"]).where("chunk_id = 15").first().tf == 2


def test_vectors(spark, index):
    assert [r.chunk_id for r in search.vector_search(index["chunk_vectors"], [1.0, 0.0], 2, "m").collect()] == [10, 15]
    got = search.semantic_search(index["chunk_vectors"], index["chunks"], index["files"], [1.0, 0.0], 10, "m").collect()
    assert [r.file_id for r in got] == [3, 4, 6] and got[0].score == pytest.approx(1.03, abs=1e-6)  # error rows stay, deleted ones don't
    assert search.vector_search(index["chunk_vectors"], [-1.0, 0.0], 9, positive=True).count() == 0


def test_tags(spark, index):
    t = lambda f, q="": [r.id for r in search.tag_search(index["image_tags"], index["files"], index["image_metadata"], f, q, 9).collect()]
    assert t(["qr:*"]) == [1] and t(["type:screenshot"]) == [2, 1] and t(["qr:payment", "type:photo"]) == [2, 1] and t([], "UPI") == [1] and t(["qr:wifi"]) == []


def test_hybrid(spark, index):
    run = lambda q, **k: search.hybrid_search(index, parse_query(q, NOW), 10, NOW, [1.0, 0.0], "m", **k).collect()
    got = {r.file_id: r for r in run("ledger")}
    assert got[3].match_type == "hybrid" and got[4].match_type == "hybrid" and 7 not in got
    # the near copy of the best chunk is no further match; the content hit and vector hit of one chunk are near copies too
    texts = [m.text for m in got[3].matches]
    assert got[3].primary.chunk_id in (10, 12, 11) and len(texts) <= 3 and len({t[:40] for t in texts + [got[3].primary.text]}) == len(texts) + 1
    assert {r.file_id for r in run("ledger pdf")} == {4}
    relaxed = run("ledger terraform")
    assert {r.file_id for r in relaxed} == set(got)
    image = run("payment qr code shot")
    assert image[0].file_id == 5 and image[0].tag == "qr:payment" and image[0].is_screenshot


def test_attribute_only_and_empty(spark, index):
    run = lambda q: [r.id for r in search.hybrid_search(index, parse_query(q, NOW), 10, NOW).collect()]
    assert set(run("pdf")) == {4}
    assert run("photos") == []  # the tag of least id decides
    assert run("qr codes") == [5]
    assert set(run("screenshots")) == {5}
    assert search.hybrid_search(index, parse_query("", NOW), 10, NOW).count() == 0


def test_projects(spark):
    p = spark.createDataFrame([(1, "/a/ledger", "ledger", "x", M), (2, "/b", "b", "a ledger tool", M), (3, "/c", "c", None, M)], "id long, path string, name string, readme_summary string, last_detected_at timestamp")
    assert {r.id for r in search.project_search(p, "ledger", 5).collect()} == {1, 2}
    assert [r.id for r in search.project_search(p, "le", 5).collect()] == [2, 1]
