"""From a folder to an index and back: listing, difference, extraction, chunks, postings and problem files as Parquet
tables, each stage idempotent by key. A new version of all tables is put in force by one rename of a pointer."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.text import excluded
from lumenfold.operators import catalog, pipeline, search, symbols, text_index
from lumenfold.operators.blocks import prose_windows
from lumenfold.operators.incremental import VersionedState
from lumenfold.plans.nlq import parse_query
from lumenfold.schemas import schema
from lumenfold.sources import extract as ex
from lumenfold.sources.config import EXCLUSIONS

TABLES = ("files", "chunks", "chunk_vectors", "postings", "lengths", "problem_files", "image_metadata", "image_tags")


@dataclass
class Index:
    """Tables of one index below `root`, in numbered versions."""

    spark: SparkSession
    root: str

    def _hadoop(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    @property
    def _state(self) -> VersionedState:
        return VersionedState(self.spark, self.root)

    def version(self) -> int:
        return self._state.version()

    def table(self, name: str) -> DataFrame:
        state = self._state
        v = state.version()
        columns = {"postings": text_index.POSTINGS, "lengths": text_index.LENGTHS}.get(name) or schema(name)
        path = f"{self.root}/{state.folder(v)}/{name}" if v else ""
        p, fs = self._hadoop(path or self.root)
        return self.spark.read.schema(columns).parquet(path) if v and fs.exists(p) else self.spark.createDataFrame([], columns)

    def tables(self) -> dict[str, DataFrame]:
        return {t: self.table(t) for t in TABLES}

    def text_index(self) -> text_index.TextIndex:
        return text_index.TextIndex(self.table("postings"), self.table("lengths"), self.table("chunks"))

    def publish(self, tables: dict[str, DataFrame], after: int | None = None) -> int:
        """Write all tables to a folder of their own and put it in force as the version after `after`."""
        v = (self.version() if after is None else after) + 1
        name = f"v{v}-{uuid.uuid4().hex}"
        for t, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/{t}")
        self._state.point(v, name)
        return v

    def compact(self, target_bytes: int = 128 << 20) -> int:
        """A new version whose tables have files of about target_bytes; readers go on with the old one until it's in force."""
        v = self.version()
        if not v:
            return 0
        p, fs = self._hadoop(f"{self.root}/{self._state.folder(v)}")
        size = lambda t: fs.getContentSummary(self._hadoop(f"{p.toString()}/{t}")[0]).getLength() if fs.exists(self._hadoop(f"{p.toString()}/{t}")[0]) else 0
        files = lambda t: max(1, -(-size(t) // target_bytes))
        return self.publish({t: text_index.by_term(df.coalesce(files(t))) if t == "postings" else df.repartition(files(t)) for t, df in self.tables().items()}, after=v)


def chunk_documents(docs: DataFrame) -> DataFrame:
    """docs: file_id, path, blocks. Source files by symbol or lines, others by sentence windows of each block."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = []
            for fid, path, blocks in zip(pdf["file_id"], pdf["path"], pdf["blocks"]):
                n = 0
                for b in blocks if blocks is not None else []:
                    if ex.extension(path) in ex.CODE:
                        parts = symbols.code_chunks(path, b["text"])
                    else:
                        parts = [(t, b["section"], None, b["start_offset"] + a, b["start_offset"] + e) for t, a, e in prose_windows(b["text"])]
                    for text, section, symbol, a, e in parts:
                        out.append((fid, n, text, a, e, b["page"], section, symbol))
                        n += 1
            yield pd.DataFrame(out, columns=["file_id", "ordinal", "text", "start_offset", "end_offset", "page", "section", "symbol"])

    rows = docs.select("file_id", "path", "blocks").mapInPandas(run, "file_id long, ordinal int, text string, start_offset int, end_offset int, page int, section string, symbol string")
    return rows.select(F.xxhash64("file_id", "ordinal").alias("id"), "*")


def refresh_postings(old: DataFrame, gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """Postings without those of the chunks in `gone` (id), with those of the chunks in `fresh`."""
    kept = old.join(gone.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")
    return kept.unionByName(search.postings(fresh).select(*kept.columns))


def index_folder(spark: SparkSession, folder: str, root: str, now: datetime, exclusions: list[str] | None = None, max_bytes: int = ex.Limits.max_bytes, embedder=None) -> dict[str, int]:
    """Bring the index at `root` up to date with `folder`; only new and changed files are read. Returns counts."""
    index = Index(spark, root)
    v = index.version()
    old = index.tables()
    stage = f"{root}/_stage-{v + 1}-{uuid.uuid4().hex}"
    listed = ex.list_files(spark, folder).where(F.col("length") <= max_bytes)
    listed = listed.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    # listed once: a file that changes while the run reads it keeps the time of this listing, so the next run takes it again
    catalog.listing(listed).where(~excluded(F.col("path"), EXCLUSIONS if exclusions is None else exclusions)).write.parquet(f"{stage}/seen")
    seen = spark.read.parquet(f"{stage}/seen")
    changes = catalog.scan_changes(old["files"], seen, folder.rstrip("/") + "/")
    todo = changes.where(F.col("action").isin("new", "changed")).select("path")
    files = catalog.upsert(old["files"], seen)
    dead = changes.where("action = 'deleted'").select("path", F.lit(True).alias("dead"))
    files = files.join(dead, "path", "left").withColumn("status", F.when(F.col("dead"), "deleted").otherwise(F.col("status"))).drop("dead")
    files = files.select(*[f.name for f in schema("files")])
    content = ex.read_files(spark, folder, max_bytes).withColumn("path", F.regexp_replace("path", "^file:/*", "/")).join(todo, "path", "left_semi")
    ex.extract(content).join(files.select("path", F.col("id").alias("file_id")), "path").write.mode("overwrite").parquet(f"{stage}/docs")
    docs = spark.read.parquet(f"{stage}/docs")
    chunk_documents(docs.where("error IS NULL")).write.mode("overwrite").parquet(f"{stage}/chunks")
    fresh = spark.read.parquet(f"{stage}/chunks").select(*[f.name for f in schema("chunks")])
    replaced = docs.select("file_id").unionByName(files.where("status = 'deleted'").select(F.col("id").alias("file_id"))).distinct()
    kept = old["chunks"].join(replaced, "file_id", "left_anti").select(*fresh.columns)
    gone = old["chunks"].join(replaced, "file_id", "left_semi")
    stamp = F.lit(now.strftime("%Y-%m-%d %H:%M:%SZ")).cast("timestamp")
    broken = docs.where("error IS NOT NULL").select("file_id", "path", F.lit("extract").alias("error_kind"), F.col("error").alias("error_message"), stamp.alias("at"))
    files = files.join(broken.select(F.col("file_id").alias("id"), F.col("error_message").alias("_e")), "id", "left")
    files = files.withColumn("status", F.when(F.col("_e").isNotNull(), "error").otherwise(F.col("status"))).withColumn("error", F.coalesce("_e", "error")).drop("_e")
    done = docs.where("error IS NULL").select(F.col("file_id").alias("id"), stamp.alias("_at"))
    files = files.join(done, "id", "left").withColumn("last_indexed_at", F.coalesce("_at", "last_indexed_at")).drop("_at").select(*[f.name for f in schema("files")])
    chunks = kept.unionByName(fresh)
    tables = {
        "files": files, "chunks": chunks, "postings": text_index.by_term(refresh_postings(old["postings"], gone, fresh)), "lengths": text_index.lengths(chunks), "problem_files": pipeline.record_problems(old["problem_files"], broken).select(*[f.name for f in schema("problem_files")]),
        "image_metadata": old["image_metadata"], "image_tags": old["image_tags"],
    }
    if embedder is not None:
        diff = pipeline.embedding_diff(chunks, old["chunk_vectors"], embedder.model_id)
        todo_ids = diff.where("action = 'embed'").select(F.col("chunk_id").alias("id"))
        new = pipeline.embed_texts(chunks.join(todo_ids, "id", "left_semi"), embedder.embed_documents, embedder.model_id)
        live = old["chunk_vectors"].join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
        tables["chunk_vectors"] = pipeline.upsert_vectors(live, new).select(*[f.name for f in schema("chunk_vectors")])
    else:
        tables["chunk_vectors"] = old["chunk_vectors"]
    counts = {r.action: r.n for r in changes.groupBy("action").agg(F.count("*").alias("n")).collect()}
    index.publish(tables, after=v)
    p, fs = index._hadoop(stage)
    fs.delete(p, True)
    return counts


def search_index(spark: SparkSession, root: str, query: str, now: datetime, limit: int = 20, embedder=None) -> DataFrame:
    index = Index(spark, root)
    tables = index.tables() | {"text_index": index.text_index()}
    parsed = parse_query(query, now)
    vector = embedder.embed_query(parsed.text) if embedder is not None and parsed.text else None
    return search.hybrid_search(tables, parsed, limit, now, vector, embedder.model_id if embedder is not None else None)


def compact(spark: SparkSession, path: str, target_bytes: int = 128 << 20) -> int:
    """Rewrite a table's small files into files of about target_bytes, beside it, and swap the folders; returns the
    number of files. For a folder without readers; tables of an index are compacted by Index.compact."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = max(1, -(-fs.getContentSummary(p).getLength() // target_bytes))
    spark.read.parquet(path).repartition(int(n)).write.mode("overwrite").parquet(f"{path}._compact")
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}._old")
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}._compact")
    if not fs.rename(p, old):
        raise RuntimeError(f"{path} could not be set aside")
    if not fs.rename(new, p):
        fs.rename(old, p)
        raise RuntimeError(f"{path} could not be replaced and stands as before")
    fs.delete(old, True)
    return int(n)
