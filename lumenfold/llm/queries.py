"""Queries of the llm operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import leakage, markup, mixing, mojibake, near_duplicates, pii, rank_fusion, scan_repair, vector_join
from lumenfold.session import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


RANKS = ["filename_rank", "content_rank", "vector_rank", "image_vector_rank"]

_RANKED = """
    WITH one AS (SELECT query_id, file_id, min(filename_rank) f, min(content_rank) c, min(vector_rank) v, min(image_vector_rank) i
        FROM candidate_files WHERE query_id IS NOT NULL AND file_id IS NOT NULL GROUP BY ALL),
    p AS (SELECT query_id, file_id,
        CASE WHEN f IS NOT NULL THEN rank() OVER (PARTITION BY query_id ORDER BY f NULLS LAST) END AS pf,
        CASE WHEN c IS NOT NULL THEN rank() OVER (PARTITION BY query_id ORDER BY c NULLS LAST) END AS pc,
        CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY query_id ORDER BY v NULLS LAST) END AS pv,
        CASE WHEN i IS NOT NULL THEN rank() OVER (PARTITION BY query_id ORDER BY i NULLS LAST) END AS pi FROM one)
"""


@query(
    "p2_found",
    _RANKED
    + """SELECT query_id, file_id FROM p WHERE (coalesce(pf, 99) <= 3)::INT + (coalesce(pc, 99) <= 3)::INT
        + (coalesce(pv, 99) <= 3)::INT + (coalesce(pi, 99) <= 3)::INT >= 3""",
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = rank_fusion.fuse(table(spark, sf_dir, "candidate_files"), "query_id", "file_id", RANKS)
    return fused.where(F.col("lists_best") >= 3).select("query_id", "file_id")


@query(
    "p2_fused",
    _RANKED
    + """, s AS (SELECT *, coalesce(1.0::DOUBLE / (60.0::DOUBLE + pf), 0) + coalesce(1.0::DOUBLE / (60.0::DOUBLE + pc), 0)
        + coalesce(1.0::DOUBLE / (60.0::DOUBLE + pv), 0) + coalesce(1.0::DOUBLE / (60.0::DOUBLE + pi), 0) AS x FROM p)
    SELECT query_id, file_id, round(x, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, file_id) AS place FROM s""",
)
def p2_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = rank_fusion.fuse(table(spark, sf_dir, "candidate_files"), "query_id", "file_id", RANKS)
    placed = rank_fusion.ordered(fused, "query_id", "file_id")
    return placed.select("query_id", "file_id", F.round("score", 9).alias("score"), F.col("place").cast("long").alias("place"))


def _chunk_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates.class_pairs(table(spark, sf_dir, "chunks"), "id", "text", n=3, num=3, den=5, min_words=20)


@query(
    "p6_found",
    r"""
    WITH t AS (SELECT DISTINCT id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL),
    g AS (SELECT DISTINCT id, hash(unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS h FROM t WHERE len(w) >= 20),
    n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
    s AS (SELECT a.id AS a, b.id AS b, count(*) AS s FROM g a JOIN g b ON a.h = b.h AND a.id < b.id GROUP BY a.id, b.id)
    SELECT a AS chunk_id_a, b AS chunk_id_b FROM s JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 5 * s >= 3 * (x.n + y.n - s)
    """,
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.record_pairs(*_chunk_pairs(spark, sf_dir))
    return found.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


@query("p6_groups")
def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(*_chunk_pairs(spark, sf_dir))


_NEAREST = """
    WITH v AS (SELECT DISTINCT ON (chunk_id) chunk_id, model_id, dims, vector::DOUBLE[] AS x FROM chunk_vectors WHERE chunk_id IS NOT NULL AND model_id IS NOT NULL AND vector IS NOT NULL AND len(vector) = dims
        AND len(list_filter(vector, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(vector, lambda e: e <> 0)) > 0 ORDER BY chunk_id),
    u AS (SELECT chunk_id, model_id, dims, list_transform(x, lambda e: e / sqrt(list_inner_product(x, x))) AS x FROM v),
    p AS (SELECT a.model_id, a.chunk_id AS x, b.chunk_id AS y, list_inner_product(a.x, b.x) AS c FROM u a JOIN u b ON a.model_id = b.model_id AND a.dims = b.dims AND a.chunk_id <> b.chunk_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(c, 12) DESC, y) AS k FROM p)
"""


@query("p5_found", _NEAREST + "SELECT DISTINCT least(x, y) AS chunk_id_a, greatest(x, y) AS chunk_id_b FROM r WHERE k <= 5 AND c >= 0.82")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = vector_join.neighbour_pairs(vector_join.neighbours(table(spark, sf_dir, "chunk_vectors"), k=5, floor=0.82))
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


@query("p5_neighbours", _NEAREST + "SELECT model_id, x AS chunk_id, k::INT AS place, y AS neighbour_id, round(least(c, 1), 6) AS cosine FROM r WHERE k <= 5 AND c >= 0.82")
def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = vector_join.neighbours(table(spark, sf_dir, "chunk_vectors"), k=5, floor=0.82)
    return lists.select(F.col("grp").alias("model_id"), F.col("id").alias("chunk_id"), "place", F.col("other").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"))


@query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # `symbol` is set for program source
    chunks = markup.marked_ids(table(spark, sf_dir, "chunks"), "id", "text", F.col("symbol").isNotNull())
    projects = markup.marked_ids(table(spark, sf_dir, "projects"), "id", "readme_summary")
    return chunks.select(F.lit("chunks").alias("origin"), F.col("id").alias("row_id")).unionByName(
        projects.select(F.lit("projects").alias("origin"), F.col("id").alias("row_id"))
    )


@query("p1_clean")
def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = markup.clean_table(table(spark, sf_dir, "chunks"), "id", "text", F.col("symbol").isNotNull()).withColumn("origin", F.lit("chunks"))
    projects = markup.clean_table(table(spark, sf_dir, "projects"), "id", "readme_summary").withColumn("origin", F.lit("projects"))
    return chunks.unionByName(projects).dropDuplicates(["origin", "id"])


def _pii(spark: SparkSession, sf_dir: str, masked: bool) -> DataFrame:
    chunks = pii.tag_table(table(spark, sf_dir, "chunks"), "id", {"chunks.text": "text"}, masked)
    fields = {"decoded_barcodes.raw_payload": "raw_payload", "decoded_barcodes.masked_payload": "masked_payload"}
    return chunks.unionByName(pii.tag_table(table(spark, sf_dir, "decoded_barcodes"), "id", fields, masked))


@query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pii(spark, sf_dir, masked=False).select("field", "row_id", F.explode("kinds").alias("kind")).distinct()


@query("p4_masked")
def p4_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pii(spark, sf_dir, masked=True).dropDuplicates(["field", "row_id"])


def _scans(spark: SparkSession, sf_dir: str) -> scan_repair.ScanRepair:
    docs = scan_repair.read_layout(table(spark, sf_dir, "extracted_docs"), "extracted_docs", "blocks", "title")
    return scan_repair.ScanRepair(docs.unionByName(scan_repair.read_layout(table(spark, sf_dir, "vision_results"), "vision_results", "ocr_blocks", None)))


@query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).found()


@query("p3_repaired")
def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).repaired()


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "text", least=12)


_SHARED = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
    dg AS (SELECT doc_id, x.i AS i, x.g AS g FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: {'i': i - 1, 'g': array_to_string(w[i:i + 11], ' ')})) AS x FROM d)),
    eg AS (SELECT item_id, x.i AS j, x.g AS g FROM (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: {'i': i - 1, 'g': array_to_string(w[i:i + 11], ' ')})) AS x FROM e)),
    hit AS (SELECT DISTINCT doc_id, item_id, i, j FROM dg JOIN eg USING (g))
"""


@query("p8_found", _SHARED + "SELECT DISTINCT doc_id, item_id FROM hit")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


@query(
    "p8_matches",
    _SHARED
    + """, runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM hit),
    m AS (SELECT doc_id, item_id, count(*) + 11 AS words, min(i) AS doc_word, min(j) AS item_word FROM runs GROUP BY doc_id, item_id, i - j, run)
    SELECT doc_id, item_id, words::INT AS words, doc_word::INT AS doc_word, item_word::INT AS item_word FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY words DESC, doc_word, item_word) = 1""",
)
def p8_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


@query("p8_kept", _SHARED + "SELECT doc_id FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM hit)")
def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return leakage.cleaned(docs, _leaks(spark, sf_dir), "doc_id").select("doc_id")


@query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.judged(table(spark, sf_dir, "documents"), "doc_id", "text").where("garbled").select(F.col("id").alias("doc_id")).distinct()


@query("p10_restored")
def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.judged(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "restored", "garbled")


def _mix(spark: SparkSession, sf_dir: str, budget_share: float | None) -> tuple[DataFrame, DataFrame]:
    """The exponent is bisected to the caps and to the entropy of the targets that can be met."""
    counts = cut(mixing.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", "source"))
    targets = table(spark, sf_dir, "source_targets")
    budget = None if budget_share is None else budget_share * float(counts.agg(F.sum("n")).first()[0] or 0)
    if budget is not None:
        return mixing.mix(counts, targets, budget)
    held = {r.source for r in counts.select("source").join(F.broadcast(targets.select(F.lower(F.trim("source")).alias("source"))), "source", "left_semi").distinct().collect()}  # a row per target source
    shares = {r.s: float(r.t) for r in targets.where("source IS NOT NULL").groupBy(F.lower(F.trim("source")).alias("s")).agg(F.sum("target_share").alias("t")).collect() if r.s in held and r.t}
    goal = mixing.entropy({s: t / sum(shares.values()) for s, t in shares.items()}) if shares else None
    return mixing.mix(counts, targets, None, least_entropy=goal)


@query("p9_mix")
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir, None)[0].select(F.col("id").alias("doc_id"), "source", F.col("n").alias("tokens"), "copies")


@query("p9_shares")
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir, None)[1]


@query("p9_tempered")
def p9_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares at a budget of the whole corpus, where caps bind and the exponent gives way."""
    return _mix(spark, sf_dir, 1.0)[1]
