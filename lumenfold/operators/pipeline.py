"""Stages behind the index: embedding differences, the job table, problem files. All merges are by key and idempotent."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# embeddings


def embedding_diff(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """chunk_id, file_id, action: `embed` (new text or other model), `skip` (same hash), `prune` (vector of the model without chunk)."""
    c = chunks.select(F.col("id").alias("chunk_id"), "file_id", F.sha2("text", 256).alias("hash"))
    v = vectors.where(F.col("model_id") == model).select("chunk_id", F.col("file_id").alias("v_file"), "text_hash")
    j = c.join(v, "chunk_id", "full_outer")
    action = F.when(F.col("hash").isNull(), "prune").when(F.col("text_hash").eqNullSafe(F.col("hash")), "skip").otherwise("embed")
    return j.select("chunk_id", F.coalesce("file_id", "v_file").alias("file_id"), action.alias("action"))


def embedding_counts(diff: DataFrame) -> DataFrame:
    n = lambda a: F.count_if(F.col("action") == a)
    return diff.groupBy("file_id").agg((n("embed") + n("skip")).alias("total_chunks"), n("embed").alias("embedded_chunks"), n("skip").alias("skipped_chunks"), n("prune").alias("pruned_vectors"))


def missing_embeddings(chunks: DataFrame, files: DataFrame, vectors: DataFrame, model: str, jobs: DataFrame | None = None) -> DataFrame:
    """Active files with a chunk that has no vector of the model, and no embed job under way."""
    lacking = chunks.join(vectors.where(F.col("model_id") == model).select(F.col("chunk_id").alias("id")), "id", "left_anti").select("file_id").distinct()
    out = lacking.join(files.where("status = 'active'").select(F.col("id").alias("file_id")), "file_id", "left_semi")
    return out if jobs is None else not_queued(out, jobs, "embed")


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """One vector per chunk: a new one replaces that of any model."""
    return old.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)


def embed_texts(chunks: DataFrame, embed, model: str) -> DataFrame:
    """Vectors of the chunks by `embed`, a function from a list of texts to a list of vectors, called per Arrow batch."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            v = embed(pdf["text"].tolist())
            yield pd.DataFrame({"chunk_id": pdf["id"], "file_id": pdf["file_id"], "model_id": model, "dims": [len(x) for x in v], "text_hash": pdf["text_hash"], "vector": v})

    rows = chunks.select("id", "file_id", "text", F.sha2("text", 256).alias("text_hash"))
    return rows.mapInPandas(run, "chunk_id long, file_id long, model_id string, dims int, text_hash string, vector array<float>")


def byte_histogram(texts: list[str], dims: int = 32) -> list[list[float]]:
    """A deterministic stand-in for a model: normalised counts of bytes by their remainder."""
    import numpy as np

    out = []
    for t in texts:
        v = np.bincount(np.frombuffer((t or "").encode(), dtype=np.uint8) % dims, minlength=dims).astype(float)
        n = np.sqrt((v * v).sum())
        out.append((v / n if n else v).tolist())
    return out


# jobs

ATTEMPTS = 3
PRIORITIES = {"index_filename": 10, "extract": 5, "embed": 3, "vision": 1}


def not_queued(files: DataFrame, jobs: DataFrame, kind: str) -> DataFrame:
    """Files without a pending or running job of the kind."""
    under_way = jobs.where((F.col("kind") == kind) & F.col("state").isin("pending", "running")).select("file_id")
    return files.join(under_way, "file_id", "left_anti")


def enqueue(files: DataFrame, jobs: DataFrame, kind: str, now: datetime) -> DataFrame:
    new = not_queued(files.select("file_id").distinct(), jobs, kind)
    return new.select(F.xxhash64(F.lit(kind), "file_id").alias("id"), F.lit(kind).alias("kind"), "file_id", F.lit(PRIORITIES.get(kind, 0)).alias("priority"), F.lit("pending").alias("state"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"), F.lit(now.strftime("%Y-%m-%d %H:%M:%SZ")).cast("timestamp").alias("created_at"))


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("pending", "running", "done", "failed")])


def dequeue_order(jobs: DataFrame, kinds: list[str] | None = None, limit: int = 1) -> DataFrame:
    """The next pending jobs: highest priority, then lowest id, of admitted kinds."""
    ready = jobs.where("state = 'pending'")
    if kinds is not None:
        ready = ready.where(F.col("kind").isin(kinds))
    return ready.orderBy(F.col("priority").desc(), "id").limit(limit)


def recover(jobs: DataFrame) -> DataFrame:
    """After a crash running jobs are pending again."""
    return jobs.withColumn("state", F.when(F.col("state") == "running", "pending").otherwise(F.col("state")))


def apply_outcomes(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """outcomes: id, ok, message. A done job is done; a failed one is pending again, or failed after its third attempt."""
    j = jobs.join(outcomes.select("id", "ok", "message"), "id", "left")
    tried = F.when(F.col("ok").isNotNull(), F.col("attempts") + 1).otherwise(F.col("attempts"))
    state = F.when(F.col("ok").isNull(), F.col("state")).when(F.col("ok"), "done").when(tried >= ATTEMPTS, "failed").otherwise("pending")
    return j.withColumn("state", state).withColumn("error", F.when(F.col("ok") == F.lit(False), F.col("message")).otherwise(F.col("error"))).withColumn("attempts", tried).drop("ok", "message")


def backoff_seconds(attempts: Column) -> Column:
    return F.when(attempts <= 1, 2).when(attempts == 2, 10).otherwise(60)


# problem files


def record_problems(old: DataFrame, failures: DataFrame) -> DataFrame:
    """failures: file_id, path, error_kind, error_message, at. By path: attempts grow, the last failure's words stay, it's open again."""
    f = failures.groupBy("path").agg(F.count("*").alias("n"), F.max_by(F.struct("file_id", "error_kind", "error_message", "at"), F.struct("at", "error_message")).alias("l"))
    o = old.select("path", *[F.col(c).alias(f"o_{c}") for c in ("id", "file_id", "error_kind", "error_message", "attempts", "last_failed_at", "resolved_at")])
    j = o.join(f, "path", "full_outer")
    hit = F.col("n").isNotNull()
    pick = lambda new, was: F.when(hit, F.col(new)).otherwise(F.col(was))
    return j.select(
        F.coalesce("o_id", F.xxhash64("path")).alias("id"), F.coalesce("l.file_id", "o_file_id").alias("file_id"), "path", pick("l.error_kind", "o_error_kind").alias("error_kind"), pick("l.error_message", "o_error_message").alias("error_message"),
        (F.coalesce("o_attempts", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("int").alias("attempts"), pick("l.at", "o_last_failed_at").alias("last_failed_at"), F.when(hit, F.lit(None).cast("timestamp")).otherwise(F.col("o_resolved_at")).alias("resolved_at"),
    )


def resolve_problems(problems: DataFrame, paths: DataFrame, now: datetime) -> DataFrame:
    done = paths.select("path", F.lit(now.strftime("%Y-%m-%d %H:%M:%SZ")).cast("timestamp").alias("_at")).distinct()
    return problems.join(done, "path", "left").withColumn("resolved_at", F.coalesce("resolved_at", "_at")).drop("_at").select(*problems.columns)


def open_problems(problems: DataFrame, limit: int = 20) -> DataFrame:
    return problems.where("resolved_at IS NULL").orderBy(F.col("last_failed_at").desc(), "path").limit(limit)
