"""Extension points: what a model or a vector index must offer, and the parts built on that."""

from __future__ import annotations

from collections import OrderedDict
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import pipeline, search


class Embedder(Protocol):
    """Unit vectors of texts. `embed_documents` is called on executors, once per Arrow batch."""

    model_id: str
    dims: int

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...
    def embed_query(self, text: str) -> list[float]: ...


class ByteHistogram:
    """The deterministic stand-in."""

    model_id, dims = "bytes-32", 32

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return pipeline.byte_histogram(texts, self.dims)

    def embed_query(self, text: str) -> list[float]:
        return self.embed_documents([text])[0]


class QueryCache:
    """Query vectors on the driver, least recently used ones go first."""

    def __init__(self, embedder: Embedder, size: int = 128):
        self.embedder, self.size = embedder, size
        self._held: OrderedDict[str, list[float]] = OrderedDict()
        self.hits = 0

    def get(self, text: str) -> list[float]:
        if text in self._held:
            self.hits += 1
            self._held.move_to_end(text)
        else:
            self._held[text] = self.embedder.embed_query(text)
            if len(self._held) > self.size:
                self._held.popitem(last=False)
        return self._held[text]


class VectorIndex(Protocol):
    """One vector per chunk; other indexes (ANN) take the place of the exact one by these methods."""

    def insert(self, vectors: DataFrame) -> None: ...
    def search(self, query: list[float], limit: int, model: str | None = None) -> DataFrame: ...
    def delete_for_file(self, file_id: int) -> None: ...
    def delete_for_chunk(self, chunk_id: int) -> None: ...
    def clear(self) -> None: ...
    def count(self, model: str | None = None) -> int: ...
    def get(self, chunk_id: int) -> DataFrame: ...
    def hashes(self, file_id: int, model: str) -> DataFrame: ...


class ExactIndex:
    """The exact index over a table of vectors. Changes are plans; `table` is what a job writes."""

    def __init__(self, table: DataFrame):
        self.table = table

    def insert(self, vectors: DataFrame) -> None:
        self.table = pipeline.upsert_vectors(self.table, vectors.select(*self.table.columns))

    def search(self, query: list[float], limit: int, model: str | None = None) -> DataFrame:
        return search.vector_search(self.table, query, limit, model)

    def delete_for_file(self, file_id: int) -> None:
        self.table = self.table.where(F.col("file_id") != file_id)

    def delete_for_chunk(self, chunk_id: int) -> None:
        self.table = self.table.where(F.col("chunk_id") != chunk_id)

    def clear(self) -> None:
        self.table = self.table.where(F.lit(False))

    def count(self, model: str | None = None) -> int:
        return (self.table if model is None else self.table.where(F.col("model_id") == model)).count()

    def get(self, chunk_id: int) -> DataFrame:
        return self.table.where(F.col("chunk_id") == chunk_id)

    def hashes(self, file_id: int, model: str) -> DataFrame:
        return self.table.where((F.col("file_id") == file_id) & (F.col("model_id") == model)).select("chunk_id", "text_hash")


def recent_queries(log: DataFrame, limit: int = 8) -> DataFrame:
    """log: query, at. The last distinct queries but for case, the latest spelling first."""
    q = F.trim("query")
    last = log.where(q != "").groupBy(F.lower(q).alias("k")).agg(F.max(F.struct("at", q.alias("query"))).alias("l"))
    return last.select("l.query", "l.at").orderBy(F.col("at").desc(), "query").limit(limit)


def retry_problems(problems: DataFrame, jobs: DataFrame, now) -> DataFrame:
    """Extract jobs of highest priority for the open problem files; the caller then clears them."""
    todo = problems.where("resolved_at IS NULL AND file_id IS NOT NULL").select("file_id")
    return pipeline.enqueue(todo, jobs, "extract", now).withColumn("priority", F.lit(10))


def in_folders(files: DataFrame, folders: list[str]) -> DataFrame:
    """Files below any of the folders."""
    ok = F.lit(False)
    for f in folders:
        ok = ok | F.col("path").startswith(f.replace("\\", "/").rstrip("/") + "/")
    return files.where(ok)


def thumbnail_keys(files: DataFrame) -> DataFrame:
    """The cache key of an image: its content hash, else the SHA-256 of its path."""
    image = F.lower("ext").isin("png", "jpg", "jpeg", "webp", "bmp", "gif")
    return files.where(image).select("id", F.coalesce("content_hash", F.sha2("path", 256)).alias("key"))
