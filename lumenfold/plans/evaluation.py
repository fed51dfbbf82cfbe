"""Relevance evaluation: reciprocal rank, recall, a regression gate, and grid search over ranking weights in one plan."""

from __future__ import annotations

import itertools
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The grid.
GRID = {"rrf_k": [30.0, 60.0, 90.0], "weight_filename": [0.8, 1.2, 1.5], "weight_content": [0.8, 1.0, 1.2], "weight_vector": [0.8, 1.1, 1.4], "exact_name_boost": [1.5, 2.0, 2.5], "multi_chunk_bonus": [0.02, 0.05]}
SUITE = "id string, query string, query_type string, expected_files array<string>, description string"


def load_suite(spark: SparkSession, path: str, local: str | None = None) -> DataFrame:
    """A TOML file of [[queries]]; a local file takes its place if it exists; neither gives an empty suite."""
    for p in (local, path):
        if p and Path(p).exists():
            rows = tomllib.loads(Path(p).read_text("utf-8")).get("queries", [])
            return spark.createDataFrame([(q["id"], q["query"], q["query_type"], q["expected_files"], q.get("description")) for q in rows], SUITE)
    return spark.createDataFrame([], SUITE)


def matches_expected(path: Column, name: Column, expected: Column) -> Column:
    """The path ends in an expected file, or the name is one but for case."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.exists(expected, lambda e: p.endswith(F.replace(e, F.lit("\\"), F.lit("/"))) | (F.lower(name) == F.lower(e)))


def first_ranks(results: DataFrame, suite: DataFrame) -> DataFrame:
    """results: id, place, path, name. One row per query of the suite: id, query_type, rank of the first relevant result or null."""
    hit = results.join(suite.select("id", "expected_files"), "id").where(matches_expected(F.col("path"), F.col("name"), F.col("expected_files")))
    best = hit.groupBy("id").agg(F.min("place").alias("rank"))
    return suite.select("id", "query_type").join(best, "id", "left")


def measures(rank: Column) -> list[Column]:
    at = lambda k: F.avg(F.when(rank <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}")
    return [F.avg(F.coalesce(1.0 / rank, F.lit(0.0))).alias("mrr"), at(1), at(5), at(10), F.count("*").alias("queries")]


def report(ranks: DataFrame) -> DataFrame:
    """Measures by query_type, and over all (query_type null), in one pass."""
    return ranks.rollup("query_type").agg(*measures(F.col("rank")))


def gate(mrr: float, baseline: float, drop: float) -> bool:
    return mrr >= max(0.0, baseline - drop)


def grid(spark: SparkSession) -> DataFrame:
    """All configurations with their trial number, first varying last."""
    rows = [(n, *values) for n, values in enumerate(itertools.product(*GRID.values()), 1)]
    return spark.createDataFrame(rows, "trial int, " + ", ".join(f"{k} double" for k in GRID))


def grid_search(candidates: DataFrame, configs: DataFrame) -> DataFrame:
    """candidates: query_id, file_id, filename_rank, content_rank, vector_rank, exact (name is the query), extra (further
    chunks), prior, relevant. Retrieval doesn't depend on the tuned weights, so each configuration only re-scores: the
    configurations (a fixed number of rows) go to the candidates. Result: trial, mrr, recall_at_10."""
    spark = candidates.sparkSession
    features = ["filename_rank", "content_rank", "vector_rank", "exact", "extra", "prior"]

    def score(p: str) -> Column:
        part = lambda r, w: F.coalesce(F.col(w) / (F.col("rrf_k") + F.col(p + r)), F.lit(0.0))
        base = part("filename_rank", "weight_filename") + part("content_rank", "weight_content") + part("vector_rank", "weight_vector")
        return F.round(base * F.col(p + "prior") * F.when(F.col(p + "exact"), 1 + F.col("exact_name_boost")).otherwise(F.lit(1.0)) + F.col("multi_chunk_bonus") * F.col(p + "extra"), 12)

    # a relevant file's rank is 1 + the files of its query before it: its features go to each candidate, so a candidate and
    # a configuration give one row, and no list is ranked whole
    right = candidates.where("relevant").select("query_id", F.col("file_id").alias("r_file_id"), *[F.col(c).alias(f"r_{c}") for c in features])
    # each row becomes one per configuration, so the rows are dealt evenly first, whatever their query
    pairs = candidates.join(right, "query_id").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = pairs.crossJoin(F.broadcast(configs)).select("trial", "query_id", "file_id", "r_file_id", score("").alias("s"), score("r_").alias("r"))  # GRID rows
    before = F.count_if((F.col("s") > F.col("r")) | ((F.col("s") == F.col("r")) & (F.col("file_id") < F.col("r_file_id")))) + 1
    rank = rows.groupBy("trial", "query_id", "r_file_id").agg(before.alias("rank")).groupBy("trial", "query_id").agg(F.min("rank").alias("rank"))
    n = candidates.select("query_id").distinct().agg(F.count("*").alias("n"))
    out = rank.groupBy("trial").agg(F.sum(F.when(F.col("rank") <= 10, 1.0 / F.col("rank")).otherwise(0.0)).alias("s"), F.sum(F.when(F.col("rank") <= 10, 1.0).otherwise(0.0)).alias("r"))
    return configs.select("trial").join(out, "trial", "left").crossJoin(n).select("trial", F.try_divide(F.coalesce("s", F.lit(0.0)), "n").alias("mrr"), F.try_divide(F.coalesce("r", F.lit(0.0)), "n").alias("recall_at_10"))  # n: one row


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial of greatest mrr, then recall; the first wins ties."""
    return trials.orderBy(F.round("mrr", 9).desc(), F.round("recall_at_10", 9).desc(), "trial").limit(1)
