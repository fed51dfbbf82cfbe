from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import blocks, catalog, pipeline
from lumenfold.plans import evaluation
from lumenfold.streaming import changes

T0 = datetime(2026, 1, 1)
FILES = "id long, path string, parent_dir string, name string, ext string, size long, mtime timestamp, ctime timestamp, kind string, content_hash string, status string, last_indexed_at timestamp, error string"
SEEN = "id long, path string, parent_dir string, name string, ext string, size long, mtime timestamp, ctime timestamp, kind string"


def old(spark, rows):
    return spark.createDataFrame([(i, p, p.rpartition("/")[0], p.rpartition("/")[2], "x", s, m, T0, "other", None, st, None, "broken" if st == "error" else None) for i, p, s, m, st in rows], FILES)


def seen(spark, rows):
    return spark.createDataFrame([(i, p, p.rpartition("/")[0], p.rpartition("/")[2], "x", s, m, T0 + timedelta(days=9), "other") for i, p, s, m in rows], SEEN)


def test_scan_upsert_moves(spark):
    o = old(spark, [(1, "/r/same", 1, T0, "active"), (2, "/r/grown", 1, T0, "active"), (3, "/r/gone", 1, T0, "active"), (4, "/q/far", 1, T0, "active"), (5, "/r/broken", 1, T0, "error"), (6, "/r/back", 1, T0, "deleted"), (7, "/r/a/moved", 1, T0, "active")])
    s = seen(spark, [(91, "/r/same", 1, T0), (92, "/r/grown", 2, T0), (95, "/r/broken", 1, T0), (96, "/r/back", 1, T0), (97, "/r/b/moved", 1, T0), (98, "/r/c/moved", 1, T0)])
    assert {(r.path, r.action) for r in catalog.scan_changes(o, s, "/r/").collect()} == {("/r/same", "same"), ("/r/grown", "changed"), ("/r/gone", "deleted"), ("/r/broken", "changed"), ("/r/back", "changed"), ("/r/a/moved", "deleted"), ("/r/b/moved", "new"), ("/r/c/moved", "new")}
    u = {r.path: r for r in catalog.upsert(o, s).collect()}
    assert u["/r/grown"].id == 2 and u["/r/grown"].size == 2 and u["/r/grown"].ctime == T0 and u["/r/broken"].error is None and u["/r/broken"].status == "active" and u["/r/back"].status == "active" and u["/r/gone"].status == "active" and u["/r/b/moved"].id == 97
    assert [tuple(r) for r in catalog.moves(o, s).collect()] == [("/r/a/moved", "/r/b/moved")]
    assert catalog.remove_folder(o, "/q").where("status = 'deleted'").count() == 2
    assert catalog.scan_changes(o.limit(0), s.limit(0)).count() == 0


def test_listing(spark):
    df = spark.createDataFrame([("C:\\x\\A.PDF", 5, T0)], "path string, length long, modificationTime timestamp")
    r = catalog.listing(df).first()
    assert (r.path, r.parent_dir, r.name, r.ext, r.kind) == ("C:/x/A.PDF", "C:/x", "A.PDF", "pdf", "document")


def test_embedding_diff(spark):
    c = lambda rows: spark.createDataFrame(rows, "id long, file_id long, text string")
    two = c([(1, 9, "alpha"), (2, 9, "beta")])
    v = pipeline.embed_texts(two, pipeline.byte_histogram, "m1")
    count = lambda ch, vec, m: tuple(pipeline.embedding_counts(pipeline.embedding_diff(ch, vec, m)).select("embedded_chunks", "skipped_chunks", "pruned_vectors").first())
    assert count(two, v.limit(0), "m1") == (2, 0, 0) and count(two, v, "m1") == (0, 2, 0) and count(c([(1, 9, "alpha"), (2, 9, "other")]), v, "m1") == (1, 1, 0)
    assert count(two, v, "m2") == (2, 0, 0) and count(c([(1, 9, "alpha")]), v, "m1") == (0, 1, 1)
    again = pipeline.upsert_vectors(v, pipeline.embed_texts(c([(1, 9, "alpha")]), pipeline.byte_histogram, "m2"))
    assert sorted((r.chunk_id, r.model_id) for r in again.collect()) == [(1, "m2"), (2, "m1")]


def test_jobs(spark):
    j = spark.createDataFrame([(1, "extract", 1, 5, "pending", 0, None, T0), (2, "extract", 2, 10, "pending", 2, None, T0), (3, "embed", 3, 10, "running", 0, None, T0), (4, "embed", 4, 1, "done", 1, None, T0)], "id long, kind string, file_id long, priority int, state string, attempts int, error string, created_at timestamp")
    assert pipeline.dequeue_order(j).first().id == 2 and pipeline.dequeue_order(j, ["embed"]).count() == 0
    out = {r.id: (r.state, r.attempts, r.error) for r in pipeline.apply_outcomes(j, spark.createDataFrame([(1, False, "e"), (2, False, "e"), (3, True, None)], "id long, ok boolean, message string")).collect()}
    assert out == {1: ("pending", 1, "e"), 2: ("failed", 3, "e"), 3: ("done", 1, None), 4: ("done", 1, None)}
    assert pipeline.recover(j).where("state = 'pending'").count() == 3
    files = spark.createDataFrame([(3,), (4,), (5,)], "file_id long")
    assert {r.file_id for r in pipeline.enqueue(files, j, "embed", T0).collect()} == {4, 5}
    assert tuple(pipeline.status_counts(j).first()) == (2, 1, 1, 0)


def test_problem_files(spark):
    from lumenfold.schemas import schema

    f = lambda rows: spark.createDataFrame(rows, "file_id long, path string, error_kind string, error_message string, at timestamp")
    p = pipeline.record_problems(spark.createDataFrame([], schema("problem_files")), f([(1, "/a", "k", "m1", T0), (1, "/a", "k", "m2", T0 + timedelta(1)), (None, "/b", "k", "m", T0)]))
    p = pipeline.resolve_problems(p, p.where("path = '/a'").select("path"), T0)
    assert [r.path for r in pipeline.open_problems(p).collect()] == ["/b"]
    p = {r.path: r for r in pipeline.record_problems(p, f([(None, "/a", "k2", "m3", T0 + timedelta(2))])).collect()}
    assert p["/a"].attempts == 3 and p["/a"].error_message == "m3" and p["/a"].file_id == 1 and p["/a"].resolved_at is None and p["/b"].attempts == 1


def test_blocks(spark):
    t = "one\n\n\n\n  two \n\nthree"
    got = spark.range(1).select(blocks.paragraphs(F.lit(t)).alias("b")).first().b
    assert [(b.text, t[b.start_offset : b.end_offset].strip()) for b in got] == [("one", "one"), ("two", "two"), ("three", "three")]
    w = spark.range(1).select(blocks.line_windows(F.lit("\n".join(str(k) for k in range(1, 121)))).alias("w")).first().w
    assert [(x.first, x.last) for x in w] == [(1, 50), (41, 90), (81, 120)] and w[1].text.startswith("41\n")
    assert [(x.first, x.last) for x in spark.range(1).select(blocks.line_windows(F.lit("a\nb")).alias("w")).first().w] == [(1, 2)]


def test_prose_windows():
    s = "This is sentence number {} of a long text with some words in it. "
    text = "".join(s.format(k) for k in range(100)).strip()
    got = blocks.prose_windows(text)
    assert len(got) > 4 and all(len(t) >= 1000 for t, _, _ in got[:-1])
    for (a, _, _), (b, _, _) in zip(got, got[1:]):
        head = b[: b.index(".") + 1]
        assert head in a  # at least one sentence is shared
    assert blocks.prose_windows("short") == [("short", 0, 5)] and blocks.prose_windows("  ") == []
    assert [x[0] for x in blocks.split_sentences("A 3.5 b. C!\nd")] == ["A 3.5 b.", "C!", "d"]


def test_readme_summary(spark):
    t = "# Title\n[![badge](x)](y)\n![img](a.png)\n```\ncode\n```\nA <b>fine</b> [tool](http://x) here.\n" + "word " * 100
    got = spark.range(1).select(blocks.readme_summary(F.lit(t)).alias("s")).first().s
    assert got.startswith("Title A fine tool here. word") and got.endswith("...") and len(got) == 303 and "code" not in got
    assert spark.range(1).select(blocks.readme_summary(F.lit(" \n```\nx\n```")).alias("s")).first().s is None


def test_preview(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\n"), (2, "x"), (3, "")], "id long, text string")
    got = {r.id: (r.content_preview, r.line_count, r.is_truncated) for r in blocks.preview(df, "id", "text", lines=2).collect()}
    assert got == {1: ("a\nb\n", 3, True), 2: ("x", 1, False), 3: ("", 0, False)}


MS = timedelta(milliseconds=1)
EVENTS = [("/a", "created_or_modified", 0, 1), ("/a", "deleted", 400, 2), ("/b", "created_or_modified", 0, 3), ("/b", "deleted", 500, 4), ("/c", "created_or_modified", 0, 5), ("/c", "created_or_modified", 300, 6), ("/c", "created_or_modified", 700, 7), ("/d", "deleted", 0, 8), ("/d", "deleted", 100, 9), ("/e", "created_or_modified", 3_599_900, 10), ("/e", "deleted", 3_600_100, 11)]


def test_changes_batch(spark):
    df = spark.createDataFrame([(p, k, T0 + ms * MS, n) for p, k, ms, n in EVENTS], "path string, kind string, ts timestamp, seq long")
    got = {(r.path, r.kind[:1], int((r.ts - T0) / MS)) for r in changes.released(df).collect()}
    assert got == {("/b", "c", 0), ("/b", "d", 500), ("/c", "c", 700), ("/d", "d", 100)}
    assert {r.path for r in changes.churn_cancelled(df).collect()} == {"/a", "/e"}


def test_changes_stream_is_the_batch(spark, tmp_path):
    rows = [(p, k, T0 + ms * MS, n) for p, k, ms, n in EVENTS] + [("/z", "deleted", T0 + timedelta(days=1), 99), ("/z", "deleted", T0 + timedelta(days=2), 100)]
    df = spark.createDataFrame(rows, "path string, kind string, ts timestamp, seq long")
    src = str(tmp_path / "in")
    df.where("seq < 99").coalesce(1).write.parquet(src)
    df.where("seq >= 99").coalesce(1).write.mode("append").parquet(src)
    out = str(tmp_path / "out")
    q = changes.flush(changes.debounced_stream(spark.readStream.schema(df.schema).parquet(src)), lambda b, n: b.write.mode("append").parquet(out), str(tmp_path / "ck"))
    q.awaitTermination()
    want = {(r.path, r.kind, r.ts) for r in changes.released(df).collect()}
    got = {(r.path, r.kind, r.ts) for r in spark.read.parquet(out).collect()}
    assert got == {w for w in want if not (w[0] == "/z" and w[2] == T0 + timedelta(days=2))}  # the last one still waits


def test_actions(spark):
    b = spark.createDataFrame([("/a", "deleted", T0), ("/b", "created_or_modified", T0), ("/c", "created_or_modified", T0), ("/d", "created_or_modified", T0)], "path string, kind string, ts timestamp")
    known = spark.createDataFrame([("/b", 1), ("/c", 99), ("/a", 1)], "path string, size long")
    assert {(r.path, r.action) for r in changes.as_actions(b, known, 10).collect()} == {("/a", "delete"), ("/b", "upsert"), ("/c", "skip"), ("/d", "delete")}


def test_evaluation(spark, tmp_path):
    suite_file = tmp_path / "s.toml"
    suite_file.write_text('[[queries]]\nid="q1"\nquery="a"\nquery_type="t"\nexpected_files=["b/x.txt"]\n[[queries]]\nid="q2"\nquery="b"\nquery_type="u"\nexpected_files=["Y.TXT"]\n')
    suite = evaluation.load_suite(spark, str(suite_file))
    results = spark.createDataFrame([("q1", 1, "/a/z.txt", "z.txt"), ("q1", 2, "C:\\b\\x.txt", "x.txt"), ("q2", 1, "/y.txt", "y.txt")], "id string, place int, path string, name string")
    rep = {r.query_type: (r.mrr, r.recall_at_1) for r in evaluation.report(evaluation.first_ranks(results, suite)).collect()}
    assert rep == {"t": (0.5, 0.0), "u": (1.0, 1.0), None: (0.75, 0.5)}
    assert evaluation.gate(0.8, 0.85, 0.05) and not evaluation.gate(0.79, 0.85, 0.05) and evaluation.gate(0.0, 0.01, 0.5)
    assert evaluation.load_suite(spark, "/none").count() == 0
    assert evaluation.grid(spark).count() == 486


@pytest.mark.parametrize("content, name, want", [('[package]\nname = "core"\n', "Cargo.toml", "core"), ('{"name": "@scope/web"}', "package.json", "web"), ("module example.org/a/tool\n", "go.mod", "tool"), ("", "setup.py", None), ("", "App.csproj", "App")])
def test_manifests(spark, content, name, want):
    from lumenfold.sources.projects import manifest_name

    assert spark.range(1).select(manifest_name(F.lit(name), F.lit(content)).alias("n")).first().n == want


def test_project_detection(spark):
    from lumenfold.sources.projects import detect

    rows = [("/p/a", "Cargo.toml", '[package]\nname = "core"'), ("/p/a", "package.json", "{}"), ("/p/b", "package.json", '{"name": "@s/web"}'), ("/p/b", "tsconfig.json", ""), ("/p/c/.git", "HEAD", None), ("/p/.hidden/x", "go.mod", "module m"), ("/p/d", "build.gradle", "")]
    df = spark.createDataFrame([(f"{d}/{n}", d, n, c) for d, n, c in rows], "path string, parent_dir string, name string, content string")
    assert {(r.path, r.name, r.project_type) for r in detect(df).collect()} == {("/p/a", "core", "rust"), ("/p/b", "web", "typescript"), ("/p/c", "c", "git"), ("/p/d", "d", "java")}
