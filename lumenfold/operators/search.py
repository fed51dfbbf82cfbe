"""Retrieval streams and their fusion into one ranked answer. Every stream is a DataFrame; one plan answers a query."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import ranking as R
from lumenfold.functions.text import fold, jaccard, query_terms, short_snippet, tokens, trigrams, with_snippet, word_count
from lumenfold.functions.vectors import dot
from lumenfold.operators.text_index import TextIndex, postings  # noqa: F401
from lumenfold.plans.nlq import ParsedQuery
from lumenfold.session import spread

K1, B = 1.2, 0.75
FILE_COLUMNS = ["path", "name", "parent_dir", "ext", "size", "mtime", "ctime", "kind"]


def _bm25(n: Column, df: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    """One term's part; rare idf below zero is floored."""
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.try_divide(dl, avgdl)))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: n_docs, avg_dl over all chunks."""
    return chunks.select(F.size(tokens(F.col("text"))).alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))


_SIGN, _BREAK = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"


def term_count(folded: Column, pieces: list[str]) -> Column:
    """Occurrences of a term in a folded text: a prefix of a word, or a phrase whose last piece is a prefix. A pattern
    over the text, as an array of its words would cost far more than counting."""
    pattern = rf"(?<!{_SIGN})" + rf"{_BREAK}+".join(re.escape(p) for p in pieces)
    return F.when(folded.contains(pieces[0]), F.regexp_count(folded, F.lit(pattern))).otherwise(0)


def _counted(chunks: DataFrame, terms: list[list[str]]) -> DataFrame:
    """chunk_id, file_id, ordinal, dl and a count per term. Redeliveries are dropped here, on a few numbers per chunk and not on texts."""
    t = spread(chunks.where(F.col("text").isNotNull()).select(F.col("id").alias("chunk_id"), "file_id", "ordinal", "text")).withColumn("t", fold(F.col("text")))
    return t.select("chunk_id", "file_id", "ordinal", word_count(F.col("t")).alias("dl"), *[term_count(F.col("t"), p).alias(f"f{k}") for k, p in enumerate(terms)]).dropDuplicates(["chunk_id"])


def content_hits(chunks: DataFrame, query: str) -> DataFrame:
    """chunk_id, file_id, ordinal, bm25 of chunks in which every term of the query occurs; document counts and mean length over all chunks."""
    terms = query_terms(query)
    if not terms:
        return chunks.where(F.lit(False)).select(F.col("id").alias("chunk_id"), "file_id", "ordinal", F.lit(0.0).alias("bm25"))
    # document counts and lengths need every chunk; the hits only those that hold each term's first piece, a look that is cheap
    likely = chunks
    for p in terms:
        likely = likely.where(fold(F.col("text")).contains(p[0]))
    stats = _counted(chunks, terms).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(terms))])
    every = F.lit(True)
    for k in range(len(terms)):
        every = every & (F.col(f"f{k}") > 0)
    score = sum((_bm25(F.col("n"), F.col(f"n{k}"), F.col(f"f{k}"), F.col("dl"), F.col("avgdl")) for k in range(len(terms))), F.lit(0.0))
    return _counted(likely, terms).where(every).crossJoin(F.broadcast(stats)).select("chunk_id", "file_id", "ordinal", score.alias("bm25"))  # stats: one row


def with_texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk columns of a short list of hits."""
    c = chunks.select(F.col("id").alias("chunk_id"), "text", "page", "section", "symbol")
    return hits.join(c, "chunk_id").dropDuplicates(["chunk_id"])


def content_search(chunks: DataFrame, files: DataFrame, query: str, limit: int, now: datetime, cfg: R.RankingConfig | None = None, index: TextIndex | None = None) -> DataFrame:
    """By the inverted index where there is one, else by the texts: best 3 * limit chunks of active files by BM25, with the score that path depth and recency give; the order is BM25's."""
    cfg = cfg or R.RankingConfig()
    live = files.where("status = 'active'").select(F.col("id").alias("file_id"), *FILE_COLUMNS)
    hits = index.hits(query, _bm25) if index is not None else content_hits(chunks, query)
    best = hits.join(live, "file_id").orderBy(F.col("bm25").desc(), "chunk_id").limit(3 * limit)
    score = F.col("bm25") * R.depth_boost(F.col("path"), cfg.depth_weight) * R.recency_boost(F.col("mtime"), now, cfg.recency_weight, cfg.recency_half_life_days)
    flat = [p[-1] for p in query_terms(query)]
    return with_snippet(with_texts(best, chunks).withColumn("score", score), flat)


def filename_search(files: DataFrame, query: str, limit: int, now: datetime, cfg: R.RankingConfig | None = None) -> DataFrame:
    """Names that hold the query as a substring, by BM25 over trigrams times name, depth and recency boosts; the best
    3 * limit by BM25 are scored again. Queries under three bytes match as a prefix, shallow paths first."""
    cfg = cfg or R.RankingConfig()
    q = query.strip().lower()
    name = F.lower("name")
    boosts = R.name_boost(F.col("name"), query, cfg) * R.depth_boost(F.col("path"), cfg.depth_weight) * R.recency_boost(F.col("mtime"), now, cfg.recency_weight, cfg.recency_half_life_days)
    cols = ["id", *FILE_COLUMNS]
    if not q:
        return files.where(F.lit(False)).select(*cols, F.lit(0.0).alias("bm25"), F.lit(0.0).alias("score"))
    live = files.where("status = 'active'")
    if len(query.strip().encode()) < 3:
        found = live.where(name.startswith(q)).select(*cols, F.lit(1.0).alias("bm25"), boosts.alias("score"))
    else:
        grams = F.greatest(F.length("name") - 2, F.lit(0))
        tf = (F.length(name) - F.length(F.replace(name, F.lit(q), F.lit("")))) / len(q)
        stats = files.agg(F.count("*").alias("_n"), F.avg(grams).alias("_avgdl"), F.count_if(name.contains(q)).alias("_df"))
        hits = live.where(name.contains(q)).crossJoin(F.broadcast(stats))  # one row
        found = hits.withColumn("bm25", _bm25(F.col("_n"), F.col("_df"), tf, grams, F.col("_avgdl"))).orderBy(F.col("bm25").desc(), "id").limit(3 * limit).select(*cols, "bm25", (F.col("bm25") * boosts).alias("score"))
    return found.orderBy(F.col("score").desc(), "path", "id").limit(limit)


def vector_search(vectors: DataFrame, query_vector: list[float], limit: int, model: str | None = None, positive: bool = False) -> DataFrame:
    """chunk_id, file_id, score: the greatest dot products with the query vector, in double precision."""
    if model is not None:
        vectors = vectors.where(F.col("model_id") == model)
    v = F.array(*[F.lit(float(x)) for x in query_vector])
    scored = vectors.where(F.col("vector").isNotNull()).select("chunk_id", "file_id", dot(v, F.col("vector")).alias("score"))
    if positive:
        scored = scored.where("score > 0")
    return scored.orderBy(F.col("score").desc(), "chunk_id").limit(limit)


def semantic_search(vectors: DataFrame, chunks: DataFrame, files: DataFrame, query_vector: list[float], limit: int, model: str | None = None) -> DataFrame:
    """Files by their best chunk among the top max(4 * limit, 20), plus 0.03 per further chunk (at most 3). Files that
    aren't deleted count, also those in error."""
    hits = vector_search(vectors, query_vector, max(4 * limit, 20), model)
    c = with_texts(hits, chunks)
    best = c.groupBy("file_id").agg(F.max(F.struct("score", (-F.col("chunk_id")).alias("c"), "text", "page", "section", "symbol")).alias("b"), F.count("*").alias("n"))
    live = files.where("status <> 'deleted'").select(F.col("id").alias("file_id"), *FILE_COLUMNS)
    score = F.col("b.score") + F.lit(0.03) * F.least(F.col("n") - 1, F.lit(3))
    out = best.join(live, "file_id").select("file_id", *FILE_COLUMNS, score.alias("score"), (-F.col("b.c")).alias("chunk_id"), short_snippet(F.col("b.text")).alias("snippet"), "b.page", "b.section", "b.symbol")
    return out.orderBy(F.col("score").desc(), "path", "file_id").limit(limit)


def tag_condition(tag_filters: list[str], tag: Column, flag: Column, any_of: bool) -> Column:
    out = F.lit(not any_of)
    for t in tag_filters:
        if t == "qr:*":
            c = tag.startswith("qr:")
        elif t == "type:screenshot":
            c = (tag == t) | F.coalesce(flag, F.lit(False))
        else:
            c = tag == t
        c = F.coalesce(c, F.lit(False))
        out = (out | c) if any_of else (out & c)
    return out


def tag_search(tags: DataFrame, files: DataFrame, images: DataFrame, tag_filters: list[str], text: str, limit: int) -> DataFrame:
    """Image tags of active files: any of the filters, or else the text inside tag or payload; newest ids first."""
    live = files.where("status = 'active'").select(F.col("id").alias("file_id"), *FILE_COLUMNS)
    t = tags.join(live, "file_id").join(images.select("file_id", "is_screenshot"), "file_id", "left")
    if tag_filters:
        t = t.where(tag_condition(tag_filters, F.col("tag"), F.col("is_screenshot"), any_of=True))
    elif text.strip():
        like = "%" + text.strip() + "%"
        t = t.where(F.col("tag").ilike(like) | F.coalesce(F.col("payload").ilike(like), F.lit(False)))
    return t.orderBy(F.col("id").desc()).limit(limit)


def image_vector_search(vectors: DataFrame, files: DataFrame, query_vector: list[float], limit: int) -> DataFrame:
    """file_id, score: images of active files with a positive dot product, greatest first."""
    live = files.where("status = 'active'").select(F.col("id").alias("file_id"))
    v = F.array(*[F.lit(float(x)) for x in query_vector])
    s = vectors.join(live, "file_id", "left_semi").select("file_id", dot(v, F.col("vector")).alias("score"))
    return s.where("score > 0").orderBy(F.col("score").desc(), "file_id").limit(limit)


def stream_ranks(hits: DataFrame, order: list[Column], name: str, chunk: list[Column] | None = None) -> DataFrame:
    """Dense numbering of the files of an ordered stream by their first hit: file_id, stream, rank, chunks."""
    # a stream holds at most a few times the limit, so one task numbers it
    pos = F.row_number().over(Window.orderBy(*order))
    by = hits.withColumn("_pos", pos).groupBy("file_id").agg(F.min("_pos").alias("_first"), *([F.collect_list(F.struct(*chunk)).alias("chunks")] if chunk else []))
    ranked = by.withColumn("rank", F.row_number().over(Window.orderBy("_first")))
    empty = F.array().cast(CHUNK)
    return ranked.select("file_id", F.lit(name).alias("stream"), "rank", (F.col("chunks").cast(CHUNK) if chunk else empty).alias("chunks"))


CHUNK = "array<struct<score: double, chunk_id: bigint, text: string, snippet: string, page: int, section: string, symbol: string>>"


def merge_streams(streams: list[DataFrame]) -> DataFrame:
    """Candidates by file: a rank per stream and all chunks. One union and one aggregation instead of outer joins."""
    all_hits = streams[0]
    for s in streams[1:]:
        all_hits = all_hits.unionByName(s)
    ranks = [F.min(F.when(F.col("stream") == s, F.col("rank"))).alias(f"{s}_rank") for s in R.STREAMS]
    return all_hits.groupBy("file_id").agg(*ranks, F.flatten(F.collect_list("chunks")).alias("raw_chunks"))


def passes_filters(parsed: ParsedQuery) -> Column:
    """Extension, screenshot and date filters. A file without a known time passes the date filter."""
    ok = F.lit(True)
    if parsed.file_types:
        ok = ok & F.lower("ext").isin([t.lower() for t in parsed.file_types])
    if parsed.is_screenshot_query:
        name, path = F.lower("name"), F.lower("path")
        image = F.lower("ext").isin("png", "jpg", "jpeg", "webp", "bmp") | F.col("kind").isin("image", "screenshot")
        named = F.coalesce(F.col("is_screenshot"), F.lit(False))
        for w in ("screenshot", "screen shot", "screen_shot", "capture"):
            named = named | name.contains(w)
        ok = ok & (image | named | path.contains("screenshot") | path.contains("screen shot"))
    if parsed.after or parsed.before:
        t = F.coalesce("ctime", "mtime") if parsed.use_ctime else F.col("mtime")
        if parsed.after:
            ok = ok & F.coalesce(t >= _ts(parsed.after), F.lit(True))
        if parsed.before:
            ok = ok & F.coalesce(t <= _ts(parsed.before), F.lit(True))
    return F.coalesce(ok, F.lit(False))


def _ts(d: datetime) -> Column:
    return F.lit(d.strftime("%Y-%m-%d %H:%M:%SZ")).cast("timestamp")


def rrf_total(cfg: R.RankingConfig) -> Column:
    total = F.lit(0.0)
    for s in R.STREAMS:
        total = total + R.rrf(F.coalesce(F.col(f"{s}_rank"), F.lit(0)), cfg.rrf_k, getattr(cfg, f"weight_{s}"))
    return total


def streams_matched() -> Column:
    return sum((F.when(F.col(f"{s}_rank").isNotNull(), 1).otherwise(0) for s in R.STREAMS), F.lit(0))


def match_type() -> Column:
    return (
        F.when(streams_matched() >= 2, "hybrid")
        .when(F.col("filename_rank").isNotNull(), "filename")
        .when(F.col("content_rank").isNotNull(), "content")
        .when(F.col("image_tag_rank").isNotNull(), "tag")
        .when(F.col("image_vector_rank").isNotNull(), "visual")
        .otherwise("semantic")
    )


def multipliers(parsed: ParsedQuery, now: datetime, cfg: R.RankingConfig) -> Column:
    intent = R.query_intent(parsed.text)
    return (
        F.when(F.col("filename_rank").isNotNull(), R.name_boost(F.col("name"), parsed.text, cfg)).otherwise(F.lit(1.0))
        * R.depth_boost(F.col("path"), cfg.depth_weight)
        * R.recency_boost(F.col("mtime"), now, cfg.recency_weight, cfg.recency_half_life_days)
        * R.type_prior(intent, F.col("ext"), F.col("kind"), cfg.file_type_prior_weight)
        * R.location_boost(F.col("path"), parsed.location_hints, cfg.location_boost_weight)
        * R.tag_boost(F.col("tag").isNotNull(), cfg.tag_boost_weight)
    )


def diverse(raw_chunks: Column, threshold: float, most: int) -> Column:
    """Chunks by score, the best first, then up to `most` others whose trigram similarity to every accepted one is below the threshold."""
    ordered = F.transform(F.array_sort(F.transform(raw_chunks, lambda c: F.struct((-c["score"]).alias("o"), c["chunk_id"].alias("i"), F.length(c["text"]).alias("l"), trigrams(c["text"]).alias("g"), c.alias("c")))), lambda x: F.struct(x["g"].alias("g"), x["c"].alias("c")))
    none = F.slice(ordered, 1, 0)

    def step(acc, x):
        near = F.exists(acc, lambda a: jaccard(a["g"], x["g"]) >= threshold)
        return F.when((F.size(acc) == 0) | ((F.size(acc) <= most) & ~near), F.concat(acc, F.array(x))).otherwise(acc)

    return F.transform(F.aggregate(ordered, none, step), lambda x: x["c"])


def score_candidates(candidates: DataFrame, parsed: ParsedQuery, now: datetime, cfg: R.RankingConfig | None = None, diversity: bool = True) -> DataFrame:
    """Scores candidates (ranks, file columns, tag, is_screenshot, raw_chunks). If the hard filters leave none, all are
    scored unfiltered; both cases are one plan."""
    cfg = cfg or R.RankingConfig()
    flagged = candidates.withColumn("_ok", passes_filters(parsed))
    kept = flagged.agg(F.count_if("_ok").alias("_kept"))
    scored = flagged.crossJoin(F.broadcast(kept)).where(F.col("_ok") | (F.col("_kept") == 0))  # one row
    scored = scored.withColumn("base", rrf_total(cfg) * multipliers(parsed, now, cfg)).withColumn("match_type", match_type())
    if diversity:
        scored = scored.withColumn("_d", diverse(F.col("raw_chunks"), cfg.chunk_similarity_threshold, cfg.max_additional_matches))
        scored = scored.withColumn("primary", F.get("_d", F.lit(0))).withColumn("matches", F.when(F.size("_d") > 1, F.slice("_d", 2, cfg.max_additional_matches)).otherwise(F.slice("_d", 1, 0)))
    else:
        scored = scored.withColumn("primary", F.lit(None)).withColumn("matches", F.array())
    return scored.withColumn("score", F.col("base") + F.lit(cfg.multi_chunk_bonus) * F.size("matches")).drop("_ok", "_kept", "_d")


def attribute_search(files: DataFrame, images: DataFrame, tags: DataFrame, parsed: ParsedQuery, limit: int, now: datetime, cfg: R.RankingConfig | None = None) -> DataFrame:
    """Filters alone: the 1000 newest joined rows, one per file (its tag of least id), all tag filters and hard filters,
    scored by depth, recency and place."""
    cfg = cfg or R.RankingConfig()
    time = "ctime" if parsed.use_ctime else "mtime"
    one = images.groupBy("file_id").agg(F.max("is_screenshot").alias("is_screenshot"))
    t = tags.select("file_id", F.col("id").alias("tag_id"), "tag", "payload")
    rows = files.where("status = 'active'").join(one.withColumnRenamed("file_id", "id"), "id", "left").join(t.withColumnRenamed("file_id", "id"), "id", "left")
    newest = rows.orderBy(F.col(time).desc_nulls_last(), "id", "tag_id").limit(1000)
    single = newest.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.col("tag_id").asc_nulls_last()))).where("_n = 1")
    shot = F.coalesce(F.col("is_screenshot"), F.lit(False)) | F.lower("name").contains("screenshot") | F.lower("path").contains("screenshot")
    ok = F.lit(True)
    for f in parsed.tag_filters:
        c = shot if f == "type:screenshot" else F.col("tag").startswith("qr:") if f == "qr:*" else F.col("tag") == f
        ok = ok & F.coalesce(c, F.lit(False))
    when = F.coalesce("ctime", "mtime") if parsed.use_ctime else F.col("mtime")
    score = R.depth_boost(F.col("path"), cfg.depth_weight) * R.recency_boost(when, now, cfg.recency_weight, cfg.recency_half_life_days) * R.location_boost(F.col("path"), parsed.location_hints, cfg.location_boost_weight)
    return single.where(ok & passes_filters(parsed)).withColumn("score", score).withColumn("match_type", F.lit("attribute")).orderBy(F.col("score").desc(), "path", "id").limit(limit)


def hybrid_search(index: dict, parsed: ParsedQuery, limit: int, now: datetime, query_vector: list[float] | None = None, model: str | None = None, image_query_vector: list[float] | None = None, cfg: R.RankingConfig | None = None, diversity: bool = True) -> DataFrame:
    """One ranked answer from up to five streams. index: files, chunks, chunk_vectors, image_tags, image_metadata, image_vectors,
    and text_index (the inverted index of the chunks) where there is one.

    Without residual text the filters alone decide; without both the answer is empty. Streams that can't help aren't built."""
    cfg = cfg or R.RankingConfig()
    files, chunks = index["files"], index["chunks"]
    text = parsed.text.strip()
    if not text and parsed.has_filters:
        return attribute_search(files, index["image_metadata"], index["image_tags"], parsed, limit, now, cfg)
    wide = max(4 * limit, 30)
    streams = [stream_ranks(filename_search(files, text, wide, now).withColumnRenamed("id", "file_id"), [F.col("score").desc(), F.col("path")], "filename")]
    content = content_search(chunks, files, text, wide, now, index=index.get("text_index"))
    cols = lambda score, full: [F.col(score).alias("score"), "chunk_id", full.alias("text"), F.col("snippet"), "page", "section", "symbol"]
    streams.append(stream_ranks(content, [F.col("bm25").desc(), F.col("chunk_id")], "content", cols("score", F.col("text"))))
    if query_vector is not None:
        hits = vector_search(index["chunk_vectors"], query_vector, wide, model)
        hits = with_texts(hits, chunks).join(files.where("status <> 'deleted'").select(F.col("id").alias("file_id")), "file_id", "left_semi").withColumn("snippet", short_snippet(F.col("text")))
        streams.append(stream_ranks(hits, [F.col("score").desc(), F.col("chunk_id")], "vector", cols("score", F.col("text"))))
    tagged = None
    if parsed.tag_filters or parsed.is_screenshot_query or "qr" in text.lower():
        tagged = tag_search(index["image_tags"], files, index["image_metadata"], parsed.tag_filters, text, wide)
        streams.append(stream_ranks(tagged, [F.col("id").desc()], "image_tag"))
    if image_query_vector is not None and "image_vectors" in index:
        streams.append(stream_ranks(image_vector_search(index["image_vectors"], files, image_query_vector, wide), [F.col("score").desc(), F.col("file_id")], "image_vector"))
    cand = merge_streams(streams).join(files.select(F.col("id").alias("file_id"), *FILE_COLUMNS), "file_id").join(index["image_metadata"].groupBy("file_id").agg(F.max("is_screenshot").alias("is_screenshot")), "file_id", "left")
    if tagged is not None:
        cand = cand.join(tagged.groupBy("file_id").agg(F.max_by("tag", "id").alias("tag"), F.max_by("payload", "id").alias("masked_payload")), "file_id", "left")
    else:
        cand = cand.withColumn("tag", F.lit(None).cast("string")).withColumn("masked_payload", F.lit(None).cast("string"))
    scored = score_candidates(cand, parsed, now, cfg, diversity)
    shot = F.coalesce(F.col("is_screenshot"), F.lit(False)) | F.lower("name").contains("screenshot") | F.lower("path").contains("screenshot")
    return scored.withColumn("is_screenshot", shot).orderBy(F.col("score").desc(), "path", "file_id").limit(limit)


PROJECT_COLUMNS = ["id", "path", "name", "project_type", "manifest_path", "readme_summary", "last_detected_at"]


def project_search(projects: DataFrame, query: str, limit: int) -> DataFrame:
    """Projects whose name, path or summary hold the query, by BM25 over trigrams of the three together; shorter queries
    than three characters by substring, short names first."""
    q = query.strip().lower()
    projects = projects.select(*[c for c in PROJECT_COLUMNS if c in projects.columns])
    cols = [F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "path", "readme_summary")]
    hit = cols[0].contains(q) | cols[1].contains(q) | cols[2].contains(q)
    if len(q) < 3:
        return projects.where(hit).withColumn("score", F.lit(0.0)).orderBy(F.length("name"), F.col("last_detected_at").desc(), "id").limit(limit)
    dl = sum((F.greatest(F.length(c) - 2, F.lit(0)) for c in cols), F.lit(0))
    tf = sum(((F.length(c) - F.length(F.replace(c, F.lit(q), F.lit("")))) / len(q) for c in cols), F.lit(0))
    stats = projects.agg(F.count("*").alias("_n"), F.avg(dl).alias("_avgdl"), F.count_if(hit).alias("_df"))
    return projects.where(hit).crossJoin(F.broadcast(stats)).withColumn("score", _bm25(F.col("_n"), F.col("_df"), tf, dl, F.col("_avgdl"))).drop("_n", "_avgdl", "_df").orderBy(F.col("score").desc(), "id").limit(limit)


def list_projects(projects: DataFrame, limit: int) -> DataFrame:
    return projects.orderBy(F.col("last_detected_at").desc(), "id").limit(limit)
