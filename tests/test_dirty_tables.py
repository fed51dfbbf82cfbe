"""Queries over empty tables and over nulls in every column end, with their columns."""

import os

import pytest

from lumenfold.plans import core_queries, ingest_queries, search_queries
from tests.tables import SF, write

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
NAMES = ["p7_found", "content_bm25", "filename_trigram_search", "hybrid_search", "attribute_only", "semantic_by_file", "project_search", "scan_changes", "upsert_files", "embed_diff", "problem_files_upsert", "change_debounce", "change_stream_live", "eval_mrr_recall", "grid_search", "paragraph_blocks", "prose_chunks", "payload_mask"]
QUERIES = core_queries.QUERIES | search_queries.QUERIES | ingest_queries.QUERIES


@pytest.fixture(scope="module", params=["empty", "nulls"])
def folder(request, tmp_path_factory):
    return write(request.param, str(tmp_path_factory.mktemp(request.param)))


@pytest.mark.parametrize("name", NAMES)
def test_runs(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert df.columns and len(df.collect()) >= 0
