"""Explicit schemas of the index tables and the versioned layout."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 6



DDL = {
    "files": "id long, path string, parent_dir string, name string, ext string, size long, mtime timestamp, ctime timestamp, kind string, content_hash string, status string, last_indexed_at timestamp, error string",
    "chunks": "id long, file_id long, ordinal int, text string, start_offset int, end_offset int, page int, section string, symbol string",
    "chunk_vectors": "chunk_id long, file_id long, model_id string, dims int, text_hash string, vector array<float>",
    "projects": "id long, path string, name string, project_type string, manifest_path string, readme_summary string, last_detected_at timestamp",
    "image_metadata": "file_id long, width int, height int, format string, exif_date string, camera_make string, camera_model string, is_screenshot boolean, has_qr boolean, qr_count int",
    "image_tags": "id long, file_id long, tag string, payload string, created_at timestamp",
    "image_vectors": "file_id long, model_id string, dims int, vector array<float>",
    "jobs": "id long, kind string, file_id long, priority int, state string, attempts int, error string, created_at timestamp",
    "problem_files": "id long, file_id long, path string, error_kind string, error_message string, attempts int, last_failed_at timestamp, resolved_at timestamp",
    "postings": "chunk_id long, term string, tf int, positions array<int>",
    "chunk_stats": "chunk_id long, dl int",
    "meta": "key string, value string",
}

#: Which table came with which version of the layout.
MIGRATIONS = {1: ["files", "chunks", "jobs", "meta"], 2: ["postings", "chunk_stats"], 3: ["chunk_vectors"], 4: ["projects"], 5: ["image_metadata", "image_tags", "image_vectors"], 6: ["problem_files"]}

EXTRACTED = "title string, blocks array<struct<text: string, page: int, section: string, start_offset: int, end_offset: int>>, metadata map<string,string>, language_guess string, needs_ocr boolean"


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def migrate(spark, root: str) -> int:
    """Create the tables that the layout below `root` still lacks; returns the number of versions applied. Running it twice applies none."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = 0
    for version in sorted(MIGRATIONS):
        marker = jvm.org.apache.hadoop.fs.Path(f"{root}/_versions/{version}")
        if fs.exists(marker):
            continue
        for name in MIGRATIONS[version]:
            spark.createDataFrame([], schema(name)).write.mode("ignore").parquet(f"{root}/{name}")
        fs.create(marker, True).close()
        done += 1
    return done
