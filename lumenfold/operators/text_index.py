"""The inverted index of chunk texts, read by term.

Two tables: `postings` (term, chunk_id, tf), range-partitioned and sorted by term, so a query's terms and prefixes reach the
scan as filters and only the row groups that hold them are read; and `lengths` (chunk_id, file_id, ordinal, dl), one row per
chunk, for the lengths and counts of BM25. A query reads no texts but those of a phrase's candidates.

Defined results: chunks without text aren't indexed; redeliveries of a chunk id count once; an empty index has no hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.text import fold, query_terms, tokens, word_count
from lumenfold.session import apart, spread

POSTINGS = "chunk_id long, term string, tf long, dl int"
LENGTHS = "chunk_id long, file_id long, ordinal int, dl int"


def lengths(chunks: DataFrame) -> DataFrame:
    rows = spread(chunks.where(F.col("text").isNotNull()).select(F.col("id").alias("chunk_id"), "file_id", "ordinal", word_count(fold(F.col("text"))).alias("dl")))
    return rows.groupBy("chunk_id").agg(F.min(F.struct("file_id", "ordinal", "dl")).alias("x")).select("chunk_id", "x.*")


def postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, term, tf, dl: the inverted index of the chunk texts."""
    t = chunks.select(F.col("id").alias("chunk_id"), tokens(F.col("text")).alias("t"))
    return t.select("chunk_id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def by_term(rows: DataFrame) -> DataFrame:
    """Postings as they are stored: a frequent term is spread over several files by the chunk id."""
    return rows.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id")


@dataclass
class TextIndex:
    postings: DataFrame
    lengths: DataFrame
    chunks: DataFrame

    @classmethod
    def build(cls, spark: SparkSession, chunks: DataFrame, path: str) -> TextIndex:
        """Write both tables below `path`. chunks: id, file_id, ordinal, text."""
        once = chunks.where(F.col("text").isNotNull())
        lengths(once).write.parquet(f"{path}/lengths")
        by_term(postings(once.dropDuplicates(["id"]))).write.parquet(f"{path}/postings")
        return cls(spark.read.schema(POSTINGS).parquet(f"{path}/postings"), spark.read.schema(LENGTHS).parquet(f"{path}/lengths"), chunks)

    def hits(self, query: str, bm25) -> DataFrame:
        """chunk_id, file_id, ordinal, bm25 of chunks in which every term of the query occurs: a prefix of a word, or a phrase
        whose last piece is one. bm25: the part of one term by (n, df, tf, dl, avgdl)."""
        terms = query_terms(query)
        if not terms:
            return self.lengths.where(F.lit(False)).select("chunk_id", "file_id", "ordinal", F.lit(0.0).alias("bm25"))
        has = lambda p: F.col("term").startswith(p)
        any_of: Column = F.lit(False)
        for pieces in terms:
            any_of = any_of | (has(pieces[0]) if len(pieces) == 1 else F.col("term") == pieces[0])
        counts = [F.sum(F.when(has(p[0]) if len(p) == 1 else F.col("term") == p[0], F.col("tf")).otherwise(0)).alias(f"f{k}") for k, p in enumerate(terms)]
        found = self.postings.where(any_of).groupBy("chunk_id").agg(*counts)
        phrases = [k for k, p in enumerate(terms) if len(p) > 1]
        if phrases:  # a phrase is counted in the texts of the chunks that hold its first word
            from lumenfold.operators.search import term_count

            texts = self.chunks.where(F.col("text").isNotNull()).select(F.col("id").alias("chunk_id"), fold(F.col("text")).alias("_t")).dropDuplicates(["chunk_id"])
            found = apart(found).join(apart(texts), "chunk_id")
            found = found.select("chunk_id", *[term_count(F.col("_t"), terms[k]).cast("long").alias(f"f{k}") if k in phrases else f"f{k}" for k in range(len(terms))])
        frequencies = found.agg(*[F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(terms))])
        stats = self.lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).crossJoin(frequencies)  # one row each
        every = F.lit(True)
        for k in range(len(terms)):
            every = every & (F.col(f"f{k}") > 0)
        score = sum((bm25(F.col("n"), F.col(f"n{k}"), F.col(f"f{k}"), F.col("dl"), F.col("avgdl")) for k in range(len(terms))), F.lit(0.0))
        return apart(found.where(every)).join(apart(self.lengths), "chunk_id").crossJoin(F.broadcast(stats)).select("chunk_id", "file_id", "ordinal", score.alias("bm25"))
