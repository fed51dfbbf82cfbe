"""Queries of the catalogue, retrieval streams, fusion and scalars, with their SQL."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import images as I
from lumenfold.functions import ranking as R
from lumenfold.functions import text as X
from lumenfold.functions.vectors import line_vector
from lumenfold.operators import catalog, search
from lumenfold.operators.text_index import TextIndex
from lumenfold.plans.nlq import parse_query
from lumenfold.session import scratch, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = datetime(2026, 9, 22, 14, 30, tzinfo=UTC)
CFG = R.RankingConfig()
MODEL = "desk-embed-small-v2"
QUERY_VECTOR = line_vector(96, 7)
CONTENT = "seasonal ledger"
NAME = "ledger"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# tables as the operators want them


def files_of(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.current_files(table(spark, sf, "files"))


def chunks_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").where("text IS NOT NULL").dropDuplicates(["id"])


def vectors_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunk_vectors").where("vector IS NOT NULL AND size(vector) = dims").where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x))).dropDuplicates(["chunk_id"])


def tags_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "decoded_barcodes").select("id", "file_id", "tag", F.col("masked_payload").alias("payload"), "created_at").dropDuplicates(["id"])


def images_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "vision_results").select("file_id", "width", "height", "format", "is_screenshot", "has_qr", "qr_count").dropDuplicates(["file_id"])


def projects_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "projects").dropDuplicates(["id"])


def raw_chunks_of(spark: SparkSession, sf: str) -> DataFrame:
    """With redeliveries; the search operators drop them where it costs least."""
    return table(spark, sf, "chunks").where("text IS NOT NULL")


_text_indexes: dict[tuple[str, str], TextIndex] = {}


def text_index_of(spark: SparkSession, sf: str) -> TextIndex:
    """The inverted index of the chunks, built once in the application and kept in the shared folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _text_indexes:
        _text_indexes[key] = TextIndex.build(spark, raw_chunks_of(spark, sf), scratch(spark, "text-index"))
    return _text_indexes[key]


def index_of(spark: SparkSession, sf: str) -> dict:
    return {"text_index": text_index_of(spark, sf), "files": files_of(spark, sf), "chunks": raw_chunks_of(spark, sf), "chunk_vectors": vectors_of(spark, sf), "image_tags": tags_of(spark, sf), "image_metadata": images_of(spark, sf)}


CUR = r"""cur AS (SELECT id, replace(path, '\', '/') AS path, parent_dir, name, ext, size, mtime, ctime, kind, content_hash, status, last_indexed_at, error FROM files WHERE id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY seen_at DESC NULLS LAST, loaded_at DESC NULLS LAST) = 1)"""
CHU = "ch AS (SELECT DISTINCT ON (id) * FROM chunks WHERE text IS NOT NULL ORDER BY id)"
VEC = "vec AS (SELECT DISTINCT ON (chunk_id) * FROM chunk_vectors WHERE vector IS NOT NULL AND len(vector) = dims AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 ORDER BY chunk_id)"
TAG = "tags AS (SELECT DISTINCT ON (id) id, file_id, tag, masked_payload AS payload FROM decoded_barcodes ORDER BY id)"
IMG = "img AS (SELECT DISTINCT ON (file_id) file_id, width, height, is_screenshot FROM vision_results ORDER BY file_id)"
DEPTH = "(1.0::DOUBLE + 0.4::DOUBLE / (1 + length(path) - length(replace(path, '/', ''))))"


def recency(col: str = "mtime") -> str:
    days = f"coalesce(greatest(floor((epoch(TIMESTAMP '2026-09-22 14:30:00') - floor(epoch({col}))) / 86400), 0), 0)"
    return f"(1.0::DOUBLE + 0.3::DOUBLE * pow(2.0::DOUBLE, -{days} / 90.0::DOUBLE))"


def name_boost(q: str) -> str:
    stem = r"CASE WHEN contains(name, '.') THEN regexp_replace(lower(name), '\.[^.]*$', '') ELSE lower(name) END"
    return f"(CASE WHEN lower(name) = '{q}' THEN 6.0 WHEN contains(name, '.') AND {stem} = '{q}' THEN 4.0 WHEN starts_with({stem}, '{q}') THEN 2.5 ELSE 1.0 END)::DOUBLE"


def bm25(n: str, df: str, tf: str, dl: str, avgdl: str) -> str:
    return f"(greatest(ln(({n} - {df} + 0.5::DOUBLE) / ({df} + 0.5::DOUBLE)), 1e-6::DOUBLE) * {tf} * 2.2::DOUBLE / ({tf} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * {dl} / {avgdl})))"


_SRC = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďđęěğīłńňőœřśšťůűźżžßø"
_DST = "aaaaaaceeeeiiiinooooouuuuyyaaaccddeegilnnoorsstuuzzzso"
TOKENS = rf"list_filter(string_split_regex(translate(lower(text), '{_SRC}', '{_DST}'), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def content_cte(words: list[str]) -> str:
    counts = ", ".join(f"len(list_filter(t, lambda w: starts_with(w, '{w}'))) AS f{k}" for k, w in enumerate(words))
    dfs = ", ".join(f"count(*) FILTER (f{k} > 0) AS n{k}" for k in range(len(words)))
    score = " + ".join(bm25("n", f"n{k}", f"f{k}", "dl", "avgdl") for k in range(len(words)))
    every = " AND ".join(f"f{k} > 0" for k in range(len(words)))
    return f"""{CHU}, tok AS (SELECT id AS chunk_id, {TOKENS} AS t FROM ch), cnt AS (SELECT chunk_id, len(t) AS dl, {counts} FROM tok),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {dfs} FROM cnt), hit AS (SELECT chunk_id, {score} AS bm25 FROM cnt, st WHERE {every})"""


def content_sql(words: list[str], limit: int) -> str:
    return f"""{content_cte(words)}, con AS (SELECT hit.chunk_id, ch.file_id, ch.ordinal, hit.bm25, cur.path, cur.mtime FROM hit JOIN ch ON ch.id = hit.chunk_id JOIN cur ON cur.id = ch.file_id
        WHERE cur.status = 'active' ORDER BY bm25 DESC, hit.chunk_id LIMIT {3 * limit})"""


def filename_sql(q: str, limit: int) -> str:
    g, tf = "greatest(length(name) - 2, 0)", f"(length(lower(name)) - length(replace(lower(name), '{q}', ''))) / {len(q)}"
    return f"""fst AS (SELECT count(*) AS n, avg({g}) AS avgdl, count(*) FILTER (contains(lower(name), '{q}')) AS df FROM cur),
    fhit AS (SELECT cur.*, {bm25('n', 'df', tf, g, 'avgdl')} AS bm25 FROM cur, fst WHERE status = 'active' AND contains(lower(name), '{q}') ORDER BY bm25 DESC, id LIMIT {3 * limit}),
    fil AS (SELECT *, bm25 * ({name_boost(q)} * {DEPTH} * {recency()}) AS score FROM fhit ORDER BY score DESC, path, id LIMIT {limit})"""


_QV = "[" + ", ".join(f"{x!r}::DOUBLE" for x in QUERY_VECTOR) + "]"


def vector_sql(limit: int, where: str = "true") -> str:
    return f"""{VEC}, vh AS (SELECT chunk_id, file_id, list_inner_product({_QV}, vector::DOUBLE[]) AS score FROM vec WHERE len(vector) >= 96 AND {where}),
    vtop AS (SELECT * FROM vh ORDER BY score DESC, chunk_id LIMIT {limit})"""


# catalogue


@query("files_current", f"WITH {CUR} SELECT id, path, status, size, content_hash FROM cur")
def files_current(spark, sf):
    return files_of(spark, sf).select("id", "path", "status", "size", "content_hash")


@query("files_kind_counts", "WITH " + CUR + ", k AS (SELECT *, CASE " + " ".join(f"WHEN lower(ext) IN ({', '.join(repr(e) for e in v)}) THEN '{k}'" for k, v in X.KINDS.items()) + " ELSE 'other' END AS kk FROM cur) SELECT kk AS kind, count(*) AS files, sum(size)::BIGINT AS bytes FROM k WHERE status = 'active' GROUP BY kk")
def files_kind_counts(spark, sf):
    f = catalog.active(files_of(spark, sf)).withColumn("k", X.file_kind(F.col("ext")))
    return f.groupBy(F.col("k").alias("kind")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("path_parts", r"""SELECT DISTINCT path, regexp_extract(replace(path, '\', '/'), '[^/]*$') AS nm, CASE WHEN contains(replace(path, '\', '/'), '/') THEN regexp_replace(replace(path, '\', '/'), '/[^/]*$', '') ELSE '' END AS parent,
    CASE WHEN regexp_matches(regexp_extract(replace(path, '\', '/'), '[^/]*$'), '^.+\.[^.]+$') THEN lower(regexp_extract(path, '[^.]*$')) ELSE '' END AS extension FROM files WHERE path IS NOT NULL""")
def path_parts(spark, sf):
    p = F.col("path")
    return table(spark, sf, "files").where("path IS NOT NULL").select("path", X.path_name(p).alias("nm"), X.path_parent(p).alias("parent"), X.path_ext(p).alias("extension")).distinct()


@query("files_excluded", rf"""WITH {CUR} SELECT id FROM cur WHERE NOT (regexp_matches(path, '^(?:.*/)?node_modules/.*$') OR regexp_matches(path, '^.*\.(?:tmp|log)$'))""")
def files_excluded(spark, sf):
    return files_of(spark, sf).where(~X.excluded(F.col("path"), ["**/node_modules/**", "*.{tmp,log}"])).select("id")


# scalars over the current files


@query("ranking_scalars", f"""WITH {CUR} SELECT id, round({DEPTH}, 9) AS depth, round({recency()}, 9) AS recency, {name_boost('ledger')} AS name_boost,
    CASE WHEN contains(lower(path), 'documents') OR contains(lower(path), 'desktop') THEN 1.8::DOUBLE ELSE 1.0::DOUBLE END AS location FROM cur""")
def ranking_scalars(spark, sf):
    return files_of(spark, sf).select(
        "id", F.round(R.depth_boost(F.col("path"), 0.4), 9).alias("depth"), F.round(R.recency_boost(F.col("mtime"), NOW, 0.3, 90.0), 9).alias("recency"),
        R.name_boost(F.col("name"), "ledger", CFG).alias("name_boost"), R.location_boost(F.col("path"), ["documents", "Desktop "], 0.8).alias("location"),
    )


def _prior_sql(intent: str) -> str:
    lists = {"code": R.PRIOR_CODE, "document": R.PRIOR_DOCUMENT, "image": R.PRIOR_IMAGE}
    kinds = {"code": ["code"], "document": ["document", "pdf", "text"], "image": ["image", "screenshot"]}
    is_ = {k: f"(lower(ext) IN ({', '.join(map(repr, lists[k]))}) OR coalesce(kind, '') IN ({', '.join(map(repr, kinds[k]))}))" for k in lists}
    down = {"code": ["document", "image"], "document": ["code", "image"], "image": ["code"]}[intent]
    return f"CASE WHEN {is_[intent]} THEN 1.3::DOUBLE WHEN {' OR '.join(is_[d] for d in down)} THEN 1.0::DOUBLE / 1.3::DOUBLE ELSE 1.0::DOUBLE END"


@query("ranking_type_prior", f"WITH {CUR} SELECT id, {_prior_sql('code')} AS code, {_prior_sql('document')} AS document, {_prior_sql('image')} AS image FROM cur")
def ranking_type_prior(spark, sf):
    return files_of(spark, sf).select("id", *[R.type_prior(i, F.col("ext"), F.col("kind"), 0.3).alias(i) for i in ("code", "document", "image")])


@query("trigram_jaccard_neighbours", rf"""WITH {CHU}, g AS (SELECT file_id, ordinal, id, lower(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) AS s FROM ch),
    t AS (SELECT file_id, ordinal, id, CASE WHEN length(s) < 3 THEN [] ELSE list_distinct(list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3))) END AS g FROM g)
    SELECT a.id AS chunk_id, b.id AS next_id, round(CASE WHEN len(a.g) = 0 OR len(b.g) = 0 THEN 0 ELSE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::DOUBLE END, 9) AS similarity
    FROM t a JOIN t b ON a.file_id = b.file_id AND b.ordinal = a.ordinal + 1""")
def trigram_jaccard_neighbours(spark, sf):
    t = chunks_of(spark, sf).select("file_id", "ordinal", "id", X.trigrams(F.col("text")).alias("g"))
    b = t.select("file_id", (F.col("ordinal") - 1).alias("ordinal"), F.col("id").alias("next_id"), F.col("g").alias("h"))
    return t.join(b, ["file_id", "ordinal"]).select(F.col("id").alias("chunk_id"), "next_id", F.round(X.jaccard(F.col("g"), F.col("h")), 9).alias("similarity"))


@query("sha256_chunks", f"WITH {CHU} SELECT id, sha256(text) AS hash FROM ch")
def sha256_chunks(spark, sf):
    return chunks_of(spark, sf).select("id", F.sha2("text", 256).alias("hash"))


@query("short_snippets", f"WITH {CHU} SELECT id, CASE WHEN length(text) <= 160 THEN text ELSE trim(left(text, 160), ' ') || '...' END AS snippet FROM ch")
def short_snippets(spark, sf):
    return chunks_of(spark, sf).select("id", X.short_snippet(F.col("text")).alias("snippet"))


# streams


@query("filename_trigram_search", f"WITH {CUR}, {filename_sql(NAME, 20)} SELECT id, path, round(score, 6) AS score FROM fil")
def filename_trigram_search(spark, sf):
    return search.filename_search(files_of(spark, sf), NAME, 20, NOW).select("id", "path", F.round("score", 6).alias("score"))


@query("filename_prefix_search", f"WITH {CUR} SELECT id, path, round({name_boost('ma')} * {DEPTH} * {recency()}, 6) AS score FROM cur WHERE status = 'active' AND starts_with(lower(name), 'ma') ORDER BY {name_boost('ma')} * {DEPTH} * {recency()} DESC, path, id LIMIT 20")
def filename_prefix_search(spark, sf):
    return search.filename_search(files_of(spark, sf), "ma", 20, NOW).select("id", "path", F.round("score", 6).alias("score"))


@query("postings", f"WITH {CHU}, tok AS (SELECT id AS chunk_id, {TOKENS} AS t FROM ch), u AS (SELECT chunk_id, unnest(t) AS term, len(t) AS dl FROM tok) SELECT chunk_id, term, count(*) AS tf, any_value(dl)::INT AS dl FROM u GROUP BY chunk_id, term")
def postings(spark, sf):
    return search.postings(chunks_of(spark, sf))


@query("corpus_stats", f"WITH {CHU}, tok AS (SELECT {TOKENS} AS t FROM ch) SELECT count(*) AS n_docs, round(avg(len(t)), 6) AS avg_dl FROM tok")
def corpus_stats(spark, sf):
    return search.corpus_stats(chunks_of(spark, sf)).select("n_docs", F.round("avg_dl", 6).alias("avg_dl"))


@query("content_bm25", f"WITH {CUR}, {content_sql(CONTENT.split(), 20)} SELECT chunk_id, file_id, ordinal, round(bm25, 6) AS bm25, round(bm25 * {DEPTH} * {recency()}, 6) AS score FROM con")
def content_bm25(spark, sf):
    got = search.content_search(raw_chunks_of(spark, sf), files_of(spark, sf), CONTENT, 20, NOW, index=text_index_of(spark, sf))
    return got.select("chunk_id", "file_id", "ordinal", F.round("bm25", 6).alias("bm25"), F.round("score", 6).alias("score"))


@query("content_bm25_all", f"WITH {content_cte(['scan', 'led', 'dust'])} SELECT chunk_id, round(bm25, 6) AS bm25 FROM hit")
def content_bm25_all(spark, sf):
    """Every chunk in which all three prefixes occur."""
    return search.content_hits(raw_chunks_of(spark, sf), "scan led* dust!").select("chunk_id", F.round("bm25", 6).alias("bm25"))


@query("content_bm25_texts", f"WITH {CUR}, {content_sql(CONTENT.split(), 20)} SELECT chunk_id, file_id, ordinal, round(bm25, 6) AS bm25 FROM con")
def content_bm25_texts(spark, sf):
    """The same answer without an index, by reading all texts."""
    return search.content_search(raw_chunks_of(spark, sf), files_of(spark, sf), CONTENT, 20, NOW).select("chunk_id", "file_id", "ordinal", F.round("bm25", 6).alias("bm25"))


@query("content_snippet")
def content_snippet(spark, sf):
    return search.content_search(raw_chunks_of(spark, sf), files_of(spark, sf), CONTENT, 20, NOW, index=text_index_of(spark, sf)).select("chunk_id", "snippet")


@query("vector_topk", f"WITH {vector_sql(20)} SELECT chunk_id, file_id, round(score, 6) AS score FROM vtop")
def vector_topk(spark, sf):
    return search.vector_search(vectors_of(spark, sf), QUERY_VECTOR, 20).select("chunk_id", "file_id", F.round("score", 6).alias("score"))


@query("vector_topk_model", f"""WITH {vector_sql(20, f"model_id = '{MODEL}'")} SELECT chunk_id, round(score, 6) AS score FROM vtop""")
def vector_topk_model(spark, sf):
    return search.vector_search(vectors_of(spark, sf), QUERY_VECTOR, 20, MODEL).select("chunk_id", F.round("score", 6).alias("score"))


@query("vector_positive_only", f"WITH {VEC}, s AS (SELECT chunk_id, list_inner_product({_QV}, vector::DOUBLE[]) AS score FROM vec WHERE len(vector) >= 96) SELECT chunk_id, round(score, 6) AS score FROM s WHERE score > 0.25")
def vector_positive_only(spark, sf):
    v = search.vector_search(vectors_of(spark, sf), QUERY_VECTOR, 2**31 - 1, positive=True)
    return v.where("score > 0.25").select("chunk_id", F.round("score", 6).alias("score"))


_EQ = "[" + ", ".join(f"{x!r}::DOUBLE" for x in line_vector(64, 3)) + "]"


@query("embedding_label_best", f"""WITH s AS (SELECT vec_id, label, list_inner_product({_EQ}, embedding::DOUBLE[]) AS score FROM embeddings) SELECT label, max(round(score, 9)) AS best, count(*) AS n, arg_max(vec_id, round(score, 9)) AS vec_id FROM s GROUP BY label""")
def embedding_label_best(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("file_id"), F.col("embedding").alias("vector"))
    s = search.vector_search(e, line_vector(64, 3), 2**31 - 1).withColumn("r", F.round("score", 9))
    return s.groupBy(F.col("file_id").alias("label")).agg(F.max("r").alias("best"), F.count("*").alias("n"), F.max_by("chunk_id", "r").alias("vec_id"))


@query("semantic_by_file", f"""WITH {CUR}, {CHU}, {vector_sql(80, f"model_id = '{MODEL}'")}, h AS (SELECT v.* FROM vtop v JOIN ch ON ch.id = v.chunk_id),
    b AS (SELECT file_id, max(score) + 0.03::DOUBLE * least(count(*) - 1, 3) AS score, first(chunk_id ORDER BY score DESC, chunk_id) AS chunk_id FROM h GROUP BY file_id)
    SELECT b.file_id, b.chunk_id, round(score, 6) AS score FROM b JOIN cur ON cur.id = b.file_id WHERE cur.status <> 'deleted' ORDER BY b.score DESC, path, b.file_id LIMIT 20""")
def semantic_by_file(spark, sf):
    return search.semantic_search(vectors_of(spark, sf), raw_chunks_of(spark, sf), files_of(spark, sf), QUERY_VECTOR, 20, MODEL).select("file_id", "chunk_id", F.round("score", 6).alias("score"))


@query("image_tag_search_or", f"WITH {CUR}, {TAG}, {IMG} SELECT t.id, t.file_id, t.tag FROM tags t JOIN cur ON cur.id = t.file_id LEFT JOIN img ON img.file_id = t.file_id WHERE cur.status = 'active' AND (t.tag = 'qr:payment' OR coalesce(img.is_screenshot, false)) ORDER BY t.id DESC LIMIT 40")
def image_tag_search_or(spark, sf):
    return search.tag_search(tags_of(spark, sf), files_of(spark, sf), images_of(spark, sf), ["qr:payment", "type:screenshot"], "", 40).select("id", "file_id", "tag")


@query("tag_substring", f"WITH {CUR}, {TAG} SELECT t.id, t.file_id, t.tag FROM tags t JOIN cur ON cur.id = t.file_id WHERE cur.status = 'active' AND (t.tag ILIKE '%bakery%' OR t.payload ILIKE '%bakery%') ORDER BY t.id DESC LIMIT 40")
def tag_substring(spark, sf):
    return search.tag_search(tags_of(spark, sf), files_of(spark, sf), images_of(spark, sf), [], "Bakery", 40).select("id", "file_id", "tag")


@query("image_vector_search", f"""WITH {CUR}, {VEC}, one AS (SELECT file_id, first(vector ORDER BY chunk_id) AS vector FROM vec WHERE model_id = 'desk-clip-text' GROUP BY file_id),
    s AS (SELECT o.file_id, list_inner_product({_QV}, vector::DOUBLE[]) AS score FROM one o JOIN cur ON cur.id = o.file_id WHERE cur.status = 'active') SELECT file_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, file_id LIMIT 30""")
def image_vector_search(spark, sf):
    v = vectors_of(spark, sf).where("model_id = 'desk-clip-text'").groupBy("file_id").agg(F.min_by("vector", "chunk_id").alias("vector"))
    return search.image_vector_search(v, files_of(spark, sf), QUERY_VECTOR, 30).select("file_id", F.round("score", 6).alias("score"))


# images


@query("qr_classify", """WITH p AS (SELECT DISTINCT id, raw_payload AS p, lower(regexp_replace(raw_payload, '^\\s+|\\s+$', '', 'g')) AS l FROM decoded_barcodes WHERE raw_payload IS NOT NULL)
    SELECT id, CASE WHEN starts_with(l, 'upi://') OR (starts_with(l, '000201') AND strlen(p) >= 20) OR regexp_matches(l, '^(bitcoin|ethereum|solana|litecoin|bitcoincash|dogecoin):')
        OR contains(l, 'paypal.me/') OR contains(l, 'venmo.com/') OR contains(l, 'cash.app/$') OR contains(l, 'revolut.me/') OR contains(l, 'pay.google.com') OR contains(l, 'paytm.me/') THEN 'qr:payment'
      WHEN regexp_matches(l, '^wifi[:;]') THEN 'qr:wifi' WHEN regexp_matches(l, '^(begin:vcard|mecard:|bizcard:)') THEN 'qr:contact' WHEN regexp_matches(l, '^(mailto|matmsg):') THEN 'qr:email'
      WHEN starts_with(l, 'tel:') THEN 'qr:tel' WHEN regexp_matches(l, '^sms(to)?:') THEN 'qr:sms' WHEN regexp_matches(l, '^(http|https|ftp)://') THEN 'qr:url' ELSE 'qr:text' END AS tag FROM p""")
def qr_classify(spark, sf):
    return table(spark, sf, "decoded_barcodes").where("raw_payload IS NOT NULL").select("id", I.payload_tag(F.col("raw_payload")).alias("tag")).distinct()


@query("payload_mask", "SELECT DISTINCT id, masked_payload AS masked FROM decoded_barcodes WHERE raw_payload IS NOT NULL AND masked_payload IS NOT NULL")
def payload_mask(spark, sf):
    b = table(spark, sf, "decoded_barcodes").where("raw_payload IS NOT NULL AND masked_payload IS NOT NULL")
    return b.select("id", I.mask_payload(F.col("tag"), F.col("raw_payload")).alias("masked")).distinct()


_RES = ", ".join(f"({max(r)}, {min(r)})" for r in I.RESOLUTIONS)


@query("screenshot_heuristic", f"""WITH {CUR}, {IMG}, j AS (SELECT img.file_id, lower(path) AS p, width AS w, height AS h, greatest(width, height) AS g, least(width, height) AS l FROM img JOIN cur ON cur.id = img.file_id),
    r AS (SELECT *, g / nullif(l, 0)::DOUBLE AS q FROM j) SELECT file_id, ({' OR '.join(f"contains(p, '{w}')" for w in I.SCREENSHOT_WORDS)}
    OR coalesce((g, l) IN ({_RES}), false) OR coalesce(regexp_matches(p, '\\.(png|webp)$') AND w >= 1280 AND h >= 720 AND (abs(q - 1.777) < 0.02 OR abs(q - 1.6) < 0.02 OR abs(q - 1.5) < 0.02 OR abs(q - 2.333) < 0.05), false)) AS shot FROM r""")
def screenshot_heuristic(spark, sf):
    j = images_of(spark, sf).join(files_of(spark, sf).select(F.col("id").alias("file_id"), "path"), "file_id")
    none = F.lit(None).cast("string")
    return j.select("file_id", I.is_screenshot(F.col("path"), F.col("width"), F.col("height"), none, none).alias("shot"))


# fusion


@query("rrf_candidates", f"""WITH {CUR}, one AS (SELECT query_id, file_id, min(filename_rank) f, min(content_rank) c, min(vector_rank) v, min(image_vector_rank) i FROM candidate_files GROUP BY ALL),
    s AS (SELECT query_id, file_id, coalesce(1.2::DOUBLE / (60.0::DOUBLE + f), 0) + coalesce(1.0::DOUBLE / (60.0::DOUBLE + c), 0) + coalesce(1.1::DOUBLE / (60.0::DOUBLE + v), 0) + coalesce(1.1::DOUBLE / (60.0::DOUBLE + i), 0) AS rrf,
      (f IS NOT NULL)::INT + (c IS NOT NULL)::INT + (v IS NOT NULL)::INT + (i IS NOT NULL)::INT AS streams, f, c, v, i FROM one)
    SELECT query_id, file_id, round(rrf * {DEPTH} * {recency()}, 9) AS score, CASE WHEN streams >= 2 THEN 'hybrid' WHEN f IS NOT NULL THEN 'filename' WHEN c IS NOT NULL THEN 'content' WHEN i IS NOT NULL THEN 'visual' ELSE 'semantic' END AS match_type
    FROM s JOIN cur ON cur.id = s.file_id""")
def rrf_candidates(spark, sf):
    """All candidate lists at once: weighted reciprocal ranks with the depth and recency priors of each file."""
    ranks = ["filename_rank", "content_rank", "vector_rank", "image_vector_rank"]
    one = table(spark, sf, "candidate_files").groupBy("query_id", "file_id").agg(*[F.min(r).alias(r) for r in ranks]).withColumn("image_tag_rank", F.lit(None).cast("int"))
    j = one.join(files_of(spark, sf).select(F.col("id").alias("file_id"), "path", "mtime"), "file_id")
    score = search.rrf_total(CFG) * R.depth_boost(F.col("path"), 0.4) * R.recency_boost(F.col("mtime"), NOW, 0.3, 90.0)
    return j.select("query_id", "file_id", F.round(score, 9).alias("score"), search.match_type().alias("match_type"))


HYBRID = "ledger pdf"


def _hybrid_sql(limit: int, text: str, exts: list[str] | None) -> str:
    words = text.split()
    w = max(4 * limit, 30)
    ok = f"lower(ext) IN ({', '.join(map(repr, exts))})" if exts else "true"
    return f"""WITH {CUR}, {filename_sql(text, w)}, {content_sql(words, w)}, {vector_sql(w, f"model_id = '{MODEL}'")},
    s1 AS (SELECT id AS file_id, row_number() OVER (ORDER BY score DESC, path) AS r FROM fil), r1 AS (SELECT file_id, row_number() OVER (ORDER BY min(r)) AS f FROM s1 GROUP BY file_id),
    s2 AS (SELECT file_id, row_number() OVER (ORDER BY bm25 DESC, chunk_id) AS r FROM con), r2 AS (SELECT file_id, row_number() OVER (ORDER BY min(r)) AS c FROM s2 GROUP BY file_id),
    s3 AS (SELECT file_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM vtop v WHERE EXISTS (SELECT 1 FROM cur WHERE cur.id = v.file_id AND status <> 'deleted') AND EXISTS (SELECT 1 FROM ch WHERE ch.id = v.chunk_id)),
    r3 AS (SELECT file_id, row_number() OVER (ORDER BY min(r)) AS v FROM s3 GROUP BY file_id),
    ids AS (SELECT file_id FROM r1 UNION SELECT file_id FROM r2 UNION SELECT file_id FROM r3),
    cand AS (SELECT ids.file_id, f, c, v, cur.* EXCLUDE (id) FROM ids LEFT JOIN r1 USING (file_id) LEFT JOIN r2 USING (file_id) LEFT JOIN r3 USING (file_id) JOIN cur ON cur.id = ids.file_id),
    flagged AS (SELECT *, coalesce({ok}, false) AS ok FROM cand), kept AS (SELECT * FROM flagged WHERE ok OR (SELECT count(*) FROM flagged WHERE ok) = 0),
    scored AS (SELECT *, (coalesce(1.2::DOUBLE / (60.0::DOUBLE + f), 0) + coalesce(1.0::DOUBLE / (60.0::DOUBLE + c), 0) + coalesce(1.1::DOUBLE / (60.0::DOUBLE + v), 0))
      * (CASE WHEN f IS NOT NULL THEN {name_boost(text)} ELSE 1.0 END * {DEPTH} * {recency()}) AS score,
      CASE WHEN (f IS NOT NULL)::INT + (c IS NOT NULL)::INT + (v IS NOT NULL)::INT >= 2 THEN 'hybrid' WHEN f IS NOT NULL THEN 'filename' WHEN c IS NOT NULL THEN 'content' ELSE 'semantic' END AS match_type FROM kept)
    SELECT file_id, round(score, 6) AS score, match_type FROM scored ORDER BY scored.score DESC, path, file_id LIMIT {limit}"""


def _hybrid(spark, sf, text: str, diversity: bool) -> DataFrame:
    return search.hybrid_search(index_of(spark, sf), parse_query(text, NOW), 20, NOW, QUERY_VECTOR, MODEL, diversity=diversity)


@query("hybrid_score_strict", _hybrid_sql(20, "ledger", ["pdf"]))
def hybrid_score_strict(spark, sf):
    """Fusion of name, content and vector streams for one query with a type filter; chunk diversity left out."""
    return _hybrid(spark, sf, HYBRID, False).select("file_id", F.round("score", 6).alias("score"), "match_type")


@query("hybrid_fallback_relaxed", _hybrid_sql(20, "ledger", ["tf"]))
def hybrid_fallback_relaxed(spark, sf):
    """The filter leaves nothing, so all candidates are scored."""
    return _hybrid(spark, sf, "ledger terraform", False).select("file_id", F.round("score", 6).alias("score"), "match_type")


@query("hybrid_search")
def hybrid_search(spark, sf):
    """The full answer: nested further matches, snippets and flags."""
    got = _hybrid(spark, sf, CONTENT, True)
    return got.select("file_id", "path", "name", F.round("score", 6).alias("score"), "match_type", F.col("primary.snippet").alias("snippet"), F.col("primary.page").alias("page"), F.col("primary.section").alias("section"), F.size("matches").alias("more"), "is_screenshot")


@query("attribute_only", f"""WITH {CUR}, {TAG}, {IMG}, j AS (SELECT cur.*, img.is_screenshot, t.id AS tag_id, t.tag FROM cur LEFT JOIN img ON img.file_id = cur.id LEFT JOIN tags t ON t.file_id = cur.id WHERE status = 'active' ORDER BY mtime DESC NULLS LAST, cur.id, tag_id NULLS FIRST LIMIT 1000),
    o AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY tag_id NULLS LAST) = 1)
    SELECT id, round({DEPTH} * {recency()}, 6) AS score FROM o WHERE lower(ext) IN ('pdf') AND coalesce(epoch(mtime) >= epoch(TIMESTAMP '2026-01-01'), true) AND coalesce(epoch(mtime) <= epoch(TIMESTAMP '2026-12-31 23:59:59'), true)
    ORDER BY {DEPTH} * {recency()} DESC, path, id LIMIT 50""")
def attribute_only(spark, sf):
    p = parse_query("pdf this year", NOW)
    return search.attribute_search(files_of(spark, sf), images_of(spark, sf), tags_of(spark, sf), p, 50, NOW).select("id", F.round("score", 6).alias("score"))


@query("attribute_tags_and", f"""WITH {CUR}, {TAG}, {IMG}, j AS (SELECT cur.*, img.is_screenshot, t.id AS tag_id, t.tag FROM cur LEFT JOIN img ON img.file_id = cur.id LEFT JOIN tags t ON t.file_id = cur.id WHERE status = 'active' ORDER BY mtime DESC NULLS LAST, cur.id, tag_id NULLS FIRST LIMIT 1000),
    o AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY tag_id NULLS LAST) = 1)
    SELECT id, tag, round({DEPTH} * {recency()}, 6) AS score FROM o WHERE starts_with(tag, 'qr:') AND lower(ext) IN ('png', 'jpg', 'jpeg', 'webp') ORDER BY {DEPTH} * {recency()} DESC, path, id LIMIT 50""")
def attribute_tags_and(spark, sf):
    p = parse_query("qr codes", NOW)
    return search.attribute_search(files_of(spark, sf), images_of(spark, sf), tags_of(spark, sf), p, 50, NOW).select("id", "tag", F.round("score", 6).alias("score"))


_PC = "lower(coalesce(name, '')) AS a, lower(coalesce(path, '')) AS b, lower(coalesce(readme_summary, '')) AS c"


@query("project_search", f"""WITH p AS (SELECT DISTINCT ON (id) *, {_PC} FROM projects ORDER BY id), m AS (SELECT *, greatest(length(a) - 2, 0) + greatest(length(b) - 2, 0) + greatest(length(c) - 2, 0) AS dl, contains(a, 'ledger') OR contains(b, 'ledger') OR contains(c, 'ledger') AS hit,
      (length(a) - length(replace(a, 'ledger', ''))) / 6 + (length(b) - length(replace(b, 'ledger', ''))) / 6 + (length(c) - length(replace(c, 'ledger', ''))) / 6 AS tf FROM p),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (hit) AS df FROM m) SELECT id, name, round({bm25('n', 'df', 'tf', 'dl', 'avgdl')}, 6) AS score FROM m, st WHERE hit ORDER BY {bm25('n', 'df', 'tf', 'dl', 'avgdl')} DESC, id LIMIT 20""")
def project_search(spark, sf):
    return search.project_search(projects_of(spark, sf), "ledger", 20).select("id", "name", F.round("score", 6).alias("score"))


@query("project_search_short", f"WITH p AS (SELECT DISTINCT ON (id) *, {_PC} FROM projects ORDER BY id) SELECT id, name FROM p WHERE contains(a, 'ld') OR contains(b, 'ld') OR contains(c, 'ld') ORDER BY length(name), last_detected_at DESC, id LIMIT 20")
def project_search_short(spark, sf):
    return search.project_search(projects_of(spark, sf), "ld", 20).select("id", "name")


@query("project_list", "SELECT id, name FROM (SELECT DISTINCT ON (id) * FROM projects ORDER BY id) ORDER BY last_detected_at DESC NULLS LAST, id LIMIT 50")
def project_list(spark, sf):
    return search.list_projects(projects_of(spark, sf), 50).select("id", "name")


