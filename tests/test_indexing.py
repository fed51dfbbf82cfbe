import os
from datetime import UTC, datetime
from pathlib import Path

from lumenfold.__main__ import evaluate
from lumenfold.operators.extension import ByteHistogram
from lumenfold.plans import evaluation, indexing
from lumenfold.sources import corpus

NOW = datetime(2026, 9, 22, 14, 30, tzinfo=UTC)


def test_folder_to_answers(spark, tmp_path):
    folder, root = str(tmp_path / "corpus"), str(tmp_path / "index")
    suite = corpus.generate(folder, 100)
    (tmp_path / "corpus" / "broken.docx").write_bytes(b"PK nonsense")
    (tmp_path / "corpus" / "node_modules").mkdir()
    (tmp_path / "corpus" / "node_modules" / "x.txt").write_text("hidden")
    emb = ByteHistogram()
    assert indexing.index_folder(spark, folder, root, NOW, embedder=emb) == {"new": 101}
    t = indexing.Index(spark, root).tables()
    assert t["files"].where("status = 'active'").count() == 100 and t["problem_files"].first().path.endswith("broken.docx") and t["files"].where("status = 'error'").count() == 1
    assert t["chunk_vectors"].count() == t["chunks"].count() > 100 and t["chunks"].where("symbol IS NOT NULL").count() >= 20 and t["postings"].where("term = 'orchard'").count() > 0
    report = evaluate(spark, root, suite, NOW)
    assert evaluation.gate(report["all"]["mrr"], 0.85, 0.05), report
    # nothing changed: only the broken file is tried again
    assert indexing.index_folder(spark, folder, root, NOW, embedder=emb) == {"same": 100, "changed": 1}
    # one edited, one gone, one new
    paths = sorted(Path(folder).rglob("*.txt"))
    paths = [p for p in paths if "node_modules" not in str(p)]
    paths[0].write_text("an entirely different zeppelin story")
    os.remove(paths[1])
    (tmp_path / "corpus" / "fresh.md").write_text("# Zeppelin\n\nnews of the zeppelin")
    got = indexing.index_folder(spark, folder, root, NOW, embedder=emb)
    assert got == {"same": 98, "changed": 2, "deleted": 1, "new": 1}
    hits = {r.name for r in indexing.search_index(spark, root, "zeppelin", NOW, embedder=None).collect()}
    assert hits == {paths[0].name, "fresh.md"}
    t = indexing.Index(spark, root).tables()
    assert t["problem_files"].first().attempts == 3 and t["chunk_vectors"].count() == t["chunks"].count()
    assert t["postings"].select("chunk_id").distinct().join(t["chunks"].withColumnRenamed("id", "chunk_id"), "chunk_id", "left_anti").count() == 0


def test_compact(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(100).repartition(7).write.parquet(p)
    assert indexing.compact(spark, p) == 1 and spark.read.parquet(p).count() == 100 and len([f for f in os.listdir(p) if f.endswith(".parquet")]) == 1
