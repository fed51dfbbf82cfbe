"""The file catalogue: current rows, scan difference, upserts, moves, removals, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import file_kind, normalise_path, path_ext, path_name, path_parent
from lumenfold.operators import incremental

COLUMNS = ("path", "parent_dir", "name", "ext", "size", "mtime", "ctime", "kind", "content_hash", "status", "last_indexed_at", "error")


def current_files(log: DataFrame) -> DataFrame:
    """One row per file id: its last observation, with the path's slashes normalised."""
    return incremental.latest(log, "id", columns=COLUMNS).withColumnRenamed("_key", "id").withColumn("path", normalise_path(F.col("path")))


def active(files: DataFrame) -> DataFrame:
    return files.where(F.col("status") == "active")


def listing(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Catalogue columns of a raw listing (path, length, modificationTime)."""
    p = normalise_path(F.col(path_col))
    ext = path_ext(F.col(path_col))
    return paths.select(
        F.xxhash64(p).alias("id"), p.alias("path"), path_parent(F.col(path_col)).alias("parent_dir"), path_name(F.col(path_col)).alias("name"), ext.alias("ext"),
        F.col("length").cast("long").alias("size"), F.col("modificationTime").alias("mtime"), F.col("modificationTime").alias("ctime"), file_kind(ext).alias("kind"),
    )


def scan_changes(old: DataFrame, seen: DataFrame, root: str | None = None) -> DataFrame:
    """Compare the catalogue with a listing, by path: path, action (new, changed, same, deleted).
    A row is the same if it's active with equal size and mtime. Unseen live rows below root are deleted."""
    o = old.select("path", F.col("size").alias("o_size"), F.col("mtime").alias("o_mtime"), F.col("status").alias("o_status"))
    j = o.join(seen.select("path", "size", "mtime", F.lit(True).alias("seen")), "path", "full_outer")
    same = (F.col("o_status") == "active") & F.col("size").eqNullSafe(F.col("o_size")) & F.col("mtime").eqNullSafe(F.col("o_mtime"))
    below = F.lit(True) if root is None else F.col("path").startswith(root)
    action = (
        F.when(F.col("seen").isNull() & (F.col("o_status") != "deleted") & below, "deleted")
        .when(F.col("seen").isNull(), None)
        .when(F.col("o_status").isNull(), "new")
        .when(same, "same")
        .otherwise("changed")
    )
    return j.select("path", action.alias("action")).where(F.col("action").isNotNull())


def upsert(old: DataFrame, seen: DataFrame) -> DataFrame:
    """The catalogue after a scan: by path, seen rows take the new size, mtime, kind; ctime of a known path stays, error is
    cleared, status becomes active; unseen rows stay as they are. The id of a known path stays."""
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in ("id", *COLUMNS)])
    j = o.join(seen, F.col("o_path") == F.col("path"), "full_outer")
    hit = F.col("path").isNotNull()
    pick = lambda c: F.when(hit, F.col(c)).otherwise(F.col(f"o_{c}")).alias(c)
    return j.select(
        F.coalesce("o_id", "id").alias("id"), F.coalesce("path", "o_path").alias("path"), *[pick(c) for c in ("parent_dir", "name", "ext", "size", "mtime")],
        F.coalesce("o_ctime", "ctime").alias("ctime"), pick("kind"), F.col("o_content_hash").alias("content_hash"),
        F.when(hit, "active").otherwise(F.col("o_status")).alias("status"), F.col("o_last_indexed_at").alias("last_indexed_at"), F.when(hit, F.lit(None).cast("string")).otherwise(F.col("o_error")).alias("error"),
    )


def moves(old: DataFrame, seen: DataFrame) -> DataFrame:
    """Files that went: an unseen live path whose name stands at new paths moves to the least of them. old_path, new_path."""
    gone = old.where(F.col("status") != "deleted").join(seen.select("path"), "path", "left_anti").select(F.col("path").alias("old_path"), "name")
    fresh = seen.join(old.select("path"), "path", "left_anti").groupBy("name").agg(F.min("path").alias("new_path"))
    pairs = gone.join(fresh, "name")
    # one old path per new path
    return pairs.groupBy("new_path").agg(F.min("old_path").alias("old_path")).select("old_path", "new_path")


def remove_folder(files: DataFrame, prefix: str) -> DataFrame:
    return files.withColumn("status", F.when(F.col("path").startswith(prefix), "deleted").otherwise(F.col("status")))


def live_children(children: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows whose file still is in the catalogue (what a cascading delete leaves)."""
    return children.join(files.select(F.col("id").alias(key)), key, "left_semi")


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace all rows of old with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def first_per(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def index_status(files: DataFrame, chunks: DataFrame, vectors: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of counts."""
    parts = [
        files.agg(F.count_if(F.col("status") == "active").alias("active_files"), F.count_if(F.col("status") == "deleted").alias("deleted_files"), F.count_if(F.col("status") == "error").alias("error_files")),
        chunks.agg(F.count("*").alias("chunks")), vectors.agg(F.count("*").alias("vectors")),
        jobs.agg(*[F.count_if(F.col("state") == s).alias(f"jobs_{s}") for s in ("pending", "running", "done", "failed")]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out
