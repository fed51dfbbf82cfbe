"""python -m lumenfold generate|index|search|eval ..."""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
from datetime import UTC, datetime

from lumenfold.operators.extension import ByteHistogram
from lumenfold.plans import evaluation, indexing
from lumenfold.session import local_session
from lumenfold.sources import corpus


def evaluate(spark, root: str, suite: list[dict], now: datetime, limit: int = 10) -> dict:
    """Measures of a suite against an index. One plan per query, as each query's filters shape its plan."""
    rows, found = [], []
    for q in suite:
        rows.append((q["id"], q["query"], q["query_type"], q["expected_files"], None))
        for n, r in enumerate(indexing.search_index(spark, root, q["query"], now, limit).select("path", "name").collect(), 1):
            found.append((q["id"], n, r.path, r.name))
    table = spark.createDataFrame(rows, evaluation.SUITE)
    ranks = evaluation.first_ranks(spark.createDataFrame(found, "id string, place int, path string, name string"), table)
    return {r.query_type or "all": {"mrr": r.mrr, "recall_at_10": r.recall_at_10, "queries": r.queries} for r in evaluation.report(ranks).collect()}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lumenfold")
    sub = p.add_subparsers(dest="do", required=True)
    g = sub.add_parser("generate", help="write a test corpus; its query suite goes to standard output")
    g.add_argument("folder")
    g.add_argument("--files", type=int, default=300)
    i = sub.add_parser("index")
    i.add_argument("folder")
    i.add_argument("index")
    s = sub.add_parser("search")
    s.add_argument("index")
    s.add_argument("query")
    s.add_argument("--limit", type=int, default=20)
    e = sub.add_parser("eval", help="generate, index, evaluate, and fail below the gate")
    e.add_argument("--files", type=int, default=60)
    e.add_argument("--baseline", type=float, default=0.85)
    e.add_argument("--drop", type=float, default=0.05)
    a = p.parse_args(args)
    now = datetime.now(UTC)
    if a.do == "generate":
        print(json.dumps(corpus.generate(a.folder, a.files)))
        return 0
    spark = local_session("lumenfold")
    if a.do == "index":
        print(json.dumps(indexing.index_folder(spark, a.folder, a.index, now, embedder=ByteHistogram())))
    elif a.do == "search":
        for r in indexing.search_index(spark, a.index, a.query, now, a.limit, ByteHistogram()).select("score", "match_type", "path").collect():
            print(f"{r.score:.4f}\t{r.match_type}\t{r.path}")
    else:
        with tempfile.TemporaryDirectory() as d:
            suite = corpus.generate(f"{d}/corpus", a.files)
            indexing.index_folder(spark, f"{d}/corpus", f"{d}/index", now)
            report = evaluate(spark, f"{d}/index", suite, now)
        print(json.dumps(report))
        return 0 if evaluation.gate(report["all"]["mrr"], a.baseline, a.drop) else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
