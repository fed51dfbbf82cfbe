"""Queries of ingestion, jobs, blocks, change streams and evaluation, with their SQL."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.dates import db_datetime
from lumenfold.functions.text import sentences
from lumenfold.functions.vectors import rms
from lumenfold.operators import blocks, catalog, extension, pipeline, symbols
from lumenfold.plans import evaluation
from lumenfold.plans.nlq import parsed
from lumenfold.plans.search_queries import CHU, CUR, MODEL, NOW, chunks_of, files_of, images_of, projects_of, tags_of, vectors_of
from lumenfold.session import scratch, table
from lumenfold.sources import projects as project_source
from lumenfold.streaming import changes

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Observations up to here are the old catalogue, later ones a new listing.
CUT = "2026-08-15 00:00:00"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# scan and catalogue


def _by_path(log: DataFrame) -> DataFrame:
    """A path's last row, so paths are unique as the catalogue wants them."""
    f = catalog.current_files(log)
    return f.groupBy("path").agg(F.max_by(F.struct(*[c for c in f.columns if c != "path"]), "id").alias("r")).select("path", "r.*")


def _old(spark: SparkSession, sf: str) -> DataFrame:
    return _by_path(table(spark, sf, "files").where(F.col("seen_at") <= F.lit(CUT + "Z").cast("timestamp")))


def _seen(spark: SparkSession, sf: str) -> DataFrame:
    new = _by_path(table(spark, sf, "files").where(F.col("seen_at") > F.lit(CUT + "Z").cast("timestamp"))).where("status <> 'deleted'")
    return new.select("id", "path", "parent_dir", "name", "ext", "size", "mtime", "ctime", "kind")


def _snap(alias: str, cond: str) -> str:
    return rf"""{alias}0 AS (SELECT *, replace(path, '\', '/') AS p FROM files WHERE id IS NOT NULL AND epoch(seen_at) {cond} epoch(TIMESTAMP '{CUT}') QUALIFY row_number() OVER (PARTITION BY id ORDER BY seen_at DESC NULLS LAST, loaded_at DESC NULLS LAST) = 1),
    {alias} AS (SELECT * EXCLUDE (path), p AS path FROM {alias}0 QUALIFY row_number() OVER (PARTITION BY p ORDER BY id DESC) = 1)"""


SNAPS = f"{_snap('o', '<=')}, {_snap('s1', '>')}, s AS (SELECT * FROM s1 WHERE status <> 'deleted')"


@query("scan_changes", f"""WITH {SNAPS}, j AS (SELECT coalesce(o.path, s.path) AS path, CASE WHEN s.path IS NULL THEN CASE WHEN o.status <> 'deleted' THEN 'deleted' END WHEN o.path IS NULL THEN 'new'
    WHEN o.status = 'active' AND s.size IS NOT DISTINCT FROM o.size AND s.mtime IS NOT DISTINCT FROM o.mtime THEN 'same' ELSE 'changed' END AS action FROM o FULL JOIN s ON o.path = s.path) SELECT * FROM j WHERE action IS NOT NULL""")
def scan_changes(spark, sf):
    return catalog.scan_changes(_old(spark, sf), _seen(spark, sf))


@query("skip_unchanged", f"WITH {SNAPS} SELECT s.path FROM s JOIN o ON o.path = s.path WHERE o.status = 'active' AND s.size IS NOT DISTINCT FROM o.size AND s.mtime IS NOT DISTINCT FROM o.mtime")
def skip_unchanged(spark, sf):
    return catalog.scan_changes(_old(spark, sf), _seen(spark, sf)).where("action = 'same'").select("path")


@query("delete_detect", f"WITH {SNAPS} SELECT path FROM o WHERE status <> 'deleted' AND path NOT IN (SELECT path FROM s)")
def delete_detect(spark, sf):
    return catalog.scan_changes(_old(spark, sf), _seen(spark, sf)).where("action = 'deleted'").select("path")


@query("upsert_files", f"""WITH {SNAPS} SELECT coalesce(o.id, s.id) AS id, coalesce(s.path, o.path) AS path, CASE WHEN s.path IS NOT NULL THEN s.size ELSE o.size END AS size, epoch(coalesce(o.ctime, s.ctime))::BIGINT AS ctime_s,
    CASE WHEN s.path IS NOT NULL THEN 'active' ELSE o.status END AS status, CASE WHEN s.path IS NULL THEN o.error END AS error FROM o FULL JOIN s ON o.path = s.path""")
def upsert_files(spark, sf):
    return catalog.upsert(_old(spark, sf), _seen(spark, sf)).select("id", "path", "size", F.round(F.unix_micros("ctime") / 1e6).cast("long").alias("ctime_s"), "status", "error")


_MOVED = "CASE WHEN id % 5 = 0 THEN '/moved' || path ELSE path END"


@query("move_detect", f"""WITH {SNAPS}, t AS (SELECT {_MOVED} AS path, name FROM s), gone AS (SELECT path AS old_path, name FROM o WHERE status <> 'deleted' AND path NOT IN (SELECT path FROM t)),
    fresh AS (SELECT name, min(path) AS new_path FROM t WHERE path NOT IN (SELECT path FROM o) GROUP BY name) SELECT min(old_path) AS old_path, new_path FROM gone JOIN fresh USING (name) GROUP BY new_path""")
def move_detect(spark, sf):
    """The second listing finds every fifth file in another folder."""
    return catalog.moves(_old(spark, sf), _seen(spark, sf).withColumn("path", F.expr(_MOVED)))


@query("folder_removed", f"WITH {CUR} SELECT CASE WHEN starts_with(path, '/home') THEN 'deleted' ELSE status END AS status, count(*) AS files FROM cur GROUP BY 1")
def folder_removed(spark, sf):
    return catalog.remove_folder(files_of(spark, sf), "/home").groupBy("status").agg(F.count("*").alias("files"))


@query("live_chunks", f"WITH {CUR}, {CHU} SELECT ch.id FROM ch WHERE file_id IN (SELECT id FROM cur WHERE status <> 'deleted')")
def live_chunks(spark, sf):
    return catalog.live_children(chunks_of(spark, sf), files_of(spark, sf).where("status <> 'deleted'")).select("id")


@query("replace_chunks", f"WITH {CHU}, new AS (SELECT id + 1000000000 AS id, file_id, text || '!' AS text FROM ch WHERE ordinal = 0) SELECT id, file_id, sha256(text) AS h FROM new UNION ALL SELECT id, file_id, sha256(text) FROM ch WHERE file_id NOT IN (SELECT file_id FROM new)")
def replace_chunks(spark, sf):
    old = chunks_of(spark, sf).select("id", "file_id", "text")
    new = chunks_of(spark, sf).where("ordinal = 0").select((F.col("id") + 1000000000).alias("id"), "file_id", F.concat("text", F.lit("!")).alias("text"))
    return catalog.replace_by_key(old, new, ["file_id"]).select("id", "file_id", F.sha2("text", 256).alias("h"))


@query("index_status", f"""WITH {CUR}, {CHU}, v AS (SELECT count(DISTINCT chunk_id) AS n FROM chunk_vectors WHERE vector IS NOT NULL AND len(vector) = dims AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0), e AS (SELECT CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'done' WHEN 'click' THEN 'pending' ELSE 'running' END AS st FROM events)
    SELECT (SELECT count(*) FILTER (status = 'active') FROM cur) AS active_files, (SELECT count(*) FILTER (status = 'deleted') FROM cur) AS deleted_files, (SELECT count(*) FILTER (status = 'error') FROM cur) AS error_files, (SELECT count(*) FROM ch) AS chunks, (SELECT n FROM v) AS vectors,
    (SELECT count(*) FILTER (st = 'pending') FROM e) AS jobs_pending, (SELECT count(*) FILTER (st = 'running') FROM e) AS jobs_running, (SELECT count(*) FILTER (st = 'done') FROM e) AS jobs_done, (SELECT count(*) FILTER (st = 'failed') FROM e) AS jobs_failed""")
def index_status(spark, sf):
    return catalog.index_status(files_of(spark, sf), chunks_of(spark, sf), vectors_of(spark, sf), _jobs(spark, sf))


@query("db_datetimes", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE floor(epoch(ts))::BIGINT END AS s FROM events")
def db_datetimes(spark, sf):
    """The three accepted spellings of a time, and a bare date, which is none."""
    e = table(spark, sf, "events")
    k = F.col("event_id") % 4
    t = F.date_trunc("second", "ts")
    text = F.when(k == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k == 2, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(t, "yyyy-MM-dd"))
    return e.select("event_id", F.unix_seconds(db_datetime(text)).alias("s"))


@query("diagnostics_json")
def diagnostics_json(spark, sf):
    s = index_status(spark, sf)
    p = pipeline.open_problems(_problems(spark, sf)).agg(F.collect_list(F.struct("path", "error_kind", "attempts")).alias("problems"))  # 20 rows at most
    return s.crossJoin(p).select(F.to_json(F.struct("*")).alias("json"))


# embeddings

_DIFF = f"""{CHU}, v AS (SELECT DISTINCT ON (chunk_id) * FROM chunk_vectors WHERE model_id = '{MODEL}' ORDER BY chunk_id), d AS (SELECT coalesce(ch.id, v.chunk_id) AS chunk_id, coalesce(ch.file_id, v.file_id) AS file_id,
    CASE WHEN ch.id IS NULL THEN 'prune' WHEN v.text_hash = sha256(ch.text) THEN 'skip' ELSE 'embed' END AS action FROM ch FULL JOIN v ON v.chunk_id = ch.id)"""


def _vectors(spark, sf):
    return table(spark, sf, "chunk_vectors").where(F.col("model_id") == MODEL).dropDuplicates(["chunk_id"])


@query("embed_diff", f"WITH {_DIFF} SELECT * FROM d")
def embed_diff(spark, sf):
    return pipeline.embedding_diff(chunks_of(spark, sf), _vectors(spark, sf), MODEL)


@query("embed_counts", f"WITH {_DIFF} SELECT file_id, count(*) FILTER (action <> 'prune') AS total_chunks, count(*) FILTER (action = 'embed') AS embedded_chunks, count(*) FILTER (action = 'skip') AS skipped_chunks, count(*) FILTER (action = 'prune') AS pruned_vectors FROM d GROUP BY file_id")
def embed_counts(spark, sf):
    return pipeline.embedding_counts(pipeline.embedding_diff(chunks_of(spark, sf), _vectors(spark, sf), MODEL))


@query("enqueue_missing_embeddings", f"WITH {CUR}, {CHU} SELECT DISTINCT file_id FROM ch WHERE id NOT IN (SELECT chunk_id FROM chunk_vectors WHERE model_id = '{MODEL}') AND file_id IN (SELECT id FROM cur WHERE status = 'active')")
def enqueue_missing_embeddings(spark, sf):
    return pipeline.missing_embeddings(chunks_of(spark, sf), files_of(spark, sf), _vectors(spark, sf), MODEL)


@query("embed_missing")
def embed_missing(spark, sf):
    """Vectors by the deterministic stand-in for the chunks that lack one."""
    todo = pipeline.embedding_diff(chunks_of(spark, sf), _vectors(spark, sf), MODEL).where("action = 'embed'").select(F.col("chunk_id").alias("id"))
    return pipeline.embed_texts(chunks_of(spark, sf).join(todo, "id", "left_semi"), pipeline.byte_histogram, "bytes-32").select("chunk_id", "file_id", "dims", "text_hash")


# jobs and problems


def _jobs(spark, sf):
    """Events read as jobs."""
    e = table(spark, sf, "events")
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "done").when(F.col("event_type") == "click", "pending").otherwise("running")
    return e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "extract").otherwise("embed").alias("kind"), F.col("user_id").alias("file_id"), (F.col("event_id") % 11).cast("int").alias("priority"), state.alias("state"), (F.col("event_id") % 4).cast("int").alias("attempts"), F.lit(None).cast("string").alias("error"), F.col("ts").cast("timestamp").alias("created_at"))


_JOBS = "jobs AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'extract' ELSE 'embed' END AS kind, user_id AS file_id, (event_id % 11)::INT AS priority, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'done' WHEN 'click' THEN 'pending' ELSE 'running' END AS state, (event_id % 4)::INT AS attempts FROM events)"


@query("job_status_counts", f"WITH {_JOBS} SELECT count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed FROM jobs")
def job_status_counts(spark, sf):
    return pipeline.status_counts(_jobs(spark, sf))


@query("job_dequeue_order", f"WITH {_JOBS} SELECT id, priority FROM jobs WHERE state = 'pending' AND kind = 'extract' ORDER BY priority DESC, id LIMIT 25")
def job_dequeue_order(spark, sf):
    return pipeline.dequeue_order(_jobs(spark, sf), ["extract"], 25).select("id", "priority")


@query("job_enqueue", f"WITH {_JOBS}, {CUR} SELECT id AS file_id FROM cur WHERE status = 'active' AND id NOT IN (SELECT file_id FROM jobs WHERE kind = 'extract' AND state IN ('pending', 'running'))")
def job_enqueue(spark, sf):
    return pipeline.enqueue(files_of(spark, sf).where("status = 'active'").select(F.col("id").alias("file_id")), _jobs(spark, sf), "extract", NOW).select("file_id")


@query("job_outcomes", f"""WITH {_JOBS}, r AS (SELECT *, CASE WHEN state = 'running' THEN id % 3 = 0 END AS ok FROM jobs), a AS (SELECT id, ok, state, attempts + (ok IS NOT NULL)::INT AS attempts FROM r)
    SELECT CASE WHEN ok IS NULL THEN state WHEN ok THEN 'done' WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END AS state, attempts, count(*) AS jobs, min(CASE WHEN attempts <= 1 THEN 2 WHEN attempts = 2 THEN 10 ELSE 60 END) AS delay FROM a GROUP BY 1, 2""")
def job_outcomes(spark, sf):
    j = _jobs(spark, sf)
    out = pipeline.apply_outcomes(j, j.where("state = 'running'").select("id", (F.col("id") % 3 == 0).alias("ok"), F.lit("broken").alias("message")))
    return out.groupBy("state", "attempts").agg(F.count("*").alias("jobs"), F.min(pipeline.backoff_seconds(F.col("attempts"))).alias("delay"))


@query("job_recover", f"WITH {_JOBS} SELECT CASE WHEN state = 'running' THEN 'pending' ELSE state END AS state, count(*) AS jobs FROM jobs GROUP BY 1")
def job_recover(spark, sf):
    return pipeline.recover(_jobs(spark, sf)).groupBy("state").agg(F.count("*").alias("jobs"))


def _problems(spark, sf):
    from lumenfold.schemas import schema

    e = table(spark, sf, "events").where("event_type = 'error'")
    failed = e.select(F.col("user_id").alias("file_id"), F.concat(F.lit("/u/"), F.col("user_id")).alias("path"), F.lit("event").alias("error_kind"), F.concat(F.lit("e"), F.col("event_id")).alias("error_message"), F.col("ts").cast("timestamp").alias("at"), "event_id")
    first = pipeline.record_problems(spark.createDataFrame([], schema("problem_files")), failed.where("event_id % 2 = 0"))
    done = pipeline.resolve_problems(first, first.where("file_id % 2 = 0").select("path"), NOW)
    return pipeline.record_problems(done, failed.where("event_id % 2 = 1"))


@query("problem_files_upsert", """WITH f AS (SELECT user_id, '/u/' || user_id AS path, 'e' || event_id AS msg, ts, event_id % 2 = 1 AS late FROM events WHERE event_type = 'error')
    SELECT path, count(*)::INT AS attempts, first(msg ORDER BY late DESC, ts DESC, msg DESC) AS error_message, count(*) FILTER (late) = 0 AND any_value(user_id) % 2 = 0 AS resolved FROM f GROUP BY path""")
def problem_files_upsert(spark, sf):
    return _problems(spark, sf).select("path", "attempts", "error_message", F.col("resolved_at").isNotNull().alias("resolved"))


@query("problem_files_open", """WITH f AS (SELECT user_id, '/u/' || user_id AS path, 'e' || event_id AS msg, ts, event_id % 2 = 1 AS late FROM events WHERE event_type = 'error'),
    p AS (SELECT path, first(ts ORDER BY late DESC, ts DESC, msg DESC) AS last_at, count(*) FILTER (late) = 0 AND any_value(user_id) % 2 = 0 AS resolved FROM f GROUP BY path) SELECT path FROM p WHERE NOT resolved ORDER BY last_at DESC, path LIMIT 20""")
def problem_files_open(spark, sf):
    return pipeline.open_problems(_problems(spark, sf), 20).select("path")


# blocks and chunks


@query("paragraph_blocks", r"""WITH p AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS parts FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM p),
    o AS (SELECT doc_id, k, part, (coalesce(sum(length(part) + 2) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS start_offset FROM u)
    SELECT doc_id, start_offset, (start_offset + length(part))::INT AS end_offset, sha256(regexp_replace(part, '^\s+|\s+$', '', 'g')) AS hash FROM o WHERE regexp_replace(part, '^\s+|\s+$', '', 'g') <> ''""")
def paragraph_blocks(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.explode(blocks.paragraphs(F.col("text"))).alias("b"))
    return d.select("doc_id", "b.start_offset", "b.end_offset", F.sha2("b.text", 256).alias("hash"))


@query("line_chunks_50_10", r"""WITH f AS (SELECT file_id, string_agg(text, chr(10) ORDER BY ordinal, id) AS t FROM (SELECT DISTINCT ON (id) * FROM chunks WHERE text IS NOT NULL AND symbol IS NOT NULL ORDER BY id) GROUP BY file_id),
    l AS (SELECT file_id, string_split(regexp_replace(t, '\n$', ''), chr(10)) AS l FROM f), w AS (SELECT file_id, l, unnest(range(0, ceil(greatest(len(l) - 50, 0) / 40.0)::INT + 1)) * 40 AS s FROM l)
    SELECT file_id, (s + 1)::INT AS first, least(s + 50, len(l))::INT AS last, sha256(array_to_string(l[s + 1:s + 50], chr(10))) AS hash FROM w""")
def line_chunks_50_10(spark, sf):
    c = chunks_of(spark, sf).where("symbol IS NOT NULL")
    f = c.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id", "text"))), lambda x: x["text"]), "\n").alias("t"))
    return f.select("file_id", F.explode(blocks.line_windows(F.col("t"))).alias("w")).select("file_id", "w.first", "w.last", F.sha2("w.text", 256).alias("hash"))


@query("sentence_counts", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?\n])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, len(s) AS sentences, sha256(array_to_string(s, '|')) AS hash FROM s""")
def sentence_counts(spark, sf):
    s = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("sentences"), F.sha2(F.array_join("s", "|"), 256).alias("hash"))


@query("prose_chunks")
def prose_chunks(spark, sf):
    return blocks.prose_chunks(table(spark, sf, "documents"), "doc_id", "text")


@query("readme_summaries")
def readme_summaries(spark, sf):
    return projects_of(spark, sf).select("id", blocks.readme_summary(F.col("readme_summary")).alias("summary"))


@query("file_preview", r"""WITH x AS (SELECT doc_id AS id, list_filter(string_split(replace(text, chr(10), chr(10) || chr(1)), chr(1)), lambda s: s <> '') AS x FROM documents WHERE text IS NOT NULL),
    s AS (SELECT id, x, list_slice(x, 1, 5) AS s FROM x) SELECT id, sha256(array_to_string(s, '')) AS hash, len(x) AS line_count, len(x) > 5 AS is_truncated FROM s""")
def file_preview(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return blocks.preview(d, "doc_id", "text", lines=5).select("id", F.sha2("content_preview", 256).alias("hash"), "line_count", "is_truncated")


@query("image_details", f"""WITH {CUR}, img AS (SELECT DISTINCT ON (file_id) file_id, width, height, format, ocr_blocks FROM vision_results ORDER BY file_id), t AS (SELECT file_id, count(*) AS tags FROM (SELECT DISTINCT ON (id) * FROM decoded_barcodes ORDER BY id) GROUP BY file_id)
    SELECT img.file_id, cur.path, width, height, coalesce(tags, 0) AS tags, sha256(coalesce(array_to_string(list_transform(ocr_blocks, lambda b: b.text), chr(10) || chr(10)), '')) AS ocr_hash FROM img JOIN cur ON cur.id = img.file_id LEFT JOIN t ON t.file_id = img.file_id""")
def image_details(spark, sf):
    v = table(spark, sf, "vision_results").dropDuplicates(["file_id"])
    t = tags_of(spark, sf).groupBy("file_id").agg(F.count("*").alias("tags"))
    j = v.join(files_of(spark, sf).select(F.col("id").alias("file_id"), "path"), "file_id").join(t, "file_id", "left")
    text = F.coalesce(F.array_join(F.transform("ocr_blocks", lambda b: b["text"]), "\n\n"), F.lit(""))
    return j.select("file_id", "path", "width", "height", F.coalesce("tags", F.lit(0)).alias("tags"), F.sha2(text, 256).alias("ocr_hash"))


@query("vision_tags", """WITH img AS (SELECT DISTINCT ON (file_id) file_id, is_screenshot FROM vision_results ORDER BY file_id), b AS (SELECT DISTINCT ON (id) * FROM decoded_barcodes ORDER BY id)
    SELECT file_id, 'type:screenshot' AS tag, NULL AS payload FROM img WHERE is_screenshot UNION ALL SELECT file_id, tag, masked_payload FROM b""")
def vision_tags(spark, sf):
    """Tags of a vision pass: screenshots, and barcodes with their masked payload."""
    shots = images_of(spark, sf).where("is_screenshot").select("file_id", F.lit("type:screenshot").alias("tag"), F.lit(None).cast("string").alias("payload"))
    return shots.unionByName(tags_of(spark, sf).select("file_id", "tag", "payload"))


@query("ocr_chunks", """WITH v AS (SELECT DISTINCT ON (file_id) file_id, ocr_blocks FROM vision_results WHERE ocr_blocks IS NOT NULL ORDER BY file_id), u AS (SELECT file_id, unnest(ocr_blocks) AS b, generate_subscripts(ocr_blocks, 1) - 1 AS ordinal FROM v) SELECT file_id, ordinal::INT AS ordinal, sha256(b.text) AS hash, b.page AS page FROM u WHERE b.text IS NOT NULL""")
def ocr_chunks(spark, sf):
    v = table(spark, sf, "vision_results").where("ocr_blocks IS NOT NULL").dropDuplicates(["file_id"])
    return v.select("file_id", F.posexplode("ocr_blocks").alias("ordinal", "b")).where("b.text IS NOT NULL").select("file_id", "ordinal", F.sha2("b.text", 256).alias("hash"), "b.page")


@query("extracted_full_text", "WITH d AS (SELECT DISTINCT ON (file_id) file_id, blocks FROM extracted_docs ORDER BY file_id) SELECT file_id, sha256(array_to_string(list_transform(list_filter(blocks, lambda b: b.text IS NOT NULL), lambda b: b.text), chr(10) || chr(10))) AS hash, len(blocks) AS blocks FROM d WHERE blocks IS NOT NULL")
def extracted_full_text(spark, sf):
    d = table(spark, sf, "extracted_docs").where("blocks IS NOT NULL").dropDuplicates(["file_id"])
    return d.select("file_id", F.sha2(F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n"), 256).alias("hash"), F.size("blocks").alias("blocks"))


@query("projects_upserted", "WITH p AS (SELECT DISTINCT ON (id) * FROM projects ORDER BY id) SELECT path, max(id) AS id FROM p GROUP BY path")
def projects_upserted(spark, sf):
    p = projects_of(spark, sf)
    return catalog.replace_by_key(p.where(F.lit(False)), p, ["path"]).groupBy("path").agg(F.max("id").alias("id"))


_MANIFEST_TEXT = "CASE n WHEN 'Cargo.toml' THEN '[package]' || chr(10) || 'name = \"' || t || '\"' WHEN 'package.json' THEN '{\"name\": \"@desk/' || t || '\"}' WHEN 'go.mod' THEN 'module desk.example/x/' || t END"


@query("project_detect", rf"""WITH {CUR}, f AS (SELECT path FROM cur WHERE status <> 'deleted' AND contains(path, '/') UNION SELECT manifest_path FROM projects WHERE manifest_path IS NOT NULL),
    m AS (SELECT regexp_replace(path, '/[^/]*$', '') AS d, path, list_position(['Cargo.toml', 'package.json', 'pyproject.toml', 'setup.py', 'requirements.txt', 'Pipfile', 'go.mod', 'pom.xml', 'build.gradle.kts', 'build.gradle'], regexp_extract(path, '[^/]*$')) AS o FROM f),
    b AS (SELECT d, min((o, path)) AS x FROM m WHERE o IS NOT NULL AND o > 0 AND NOT regexp_matches(d, '/\.[^/]+') GROUP BY d)
    SELECT d AS path, x[2] AS manifest_path, CASE WHEN x[1] IN (1, 2, 7) THEN upper(regexp_extract(d, '[^/]*$')) ELSE regexp_extract(d, '[^/]*$') END AS name,
        ['rust', 'javascript', 'python', 'python', 'python', 'python', 'go', 'java', 'kotlin', 'java'][x[1]] AS project_type FROM b""")
def project_detect(spark, sf):
    """Projects in a listing of the files and of the known manifests, whose contents name the project in capitals."""
    f = files_of(spark, sf).where("status <> 'deleted'").where(F.col("path").contains("/")).select("path")
    f = f.unionByName(table(spark, sf, "projects").where("manifest_path IS NOT NULL").select(F.col("manifest_path").alias("path"))).distinct()
    rows = f.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("parent_dir"), F.regexp_extract("path", "[^/]*$", 0).alias("name"))
    named = rows.withColumns({"n": F.col("name"), "t": F.upper(F.regexp_extract("parent_dir", "[^/]*$", 0))}).withColumn("content", F.expr(_MANIFEST_TEXT))
    found = project_source.detect(named.select("path", "parent_dir", "name", "content")).where("manifest_path IS NOT NULL")
    return found.where(F.regexp_extract("manifest_path", "[^/]*$", 0).isin(*[m for m, _ in project_source.MANIFESTS])).select("path", "manifest_path", "name", "project_type")


@query("nlq_batch")
def nlq_batch(spark, sf):
    """The query parser over all distinct project names as queries."""
    return parsed(table(spark, sf, "projects"), "name", NOW)


# change stream

WINDOW_MS = 1_800_000


def _changes(e: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", changes.DELETED).otherwise(changes.MODIFIED)
    return e.select(F.concat(F.lit("/u/"), F.col("user_id")).alias("path"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


_CH = f"""c AS (SELECT '/u/' || user_id AS path, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'created_or_modified' END AS kind, epoch_us(ts) // 1000 AS ms, event_id FROM events),
    n AS (SELECT *, lag(kind) OVER w AS pk, lag(ms) OVER w AS pm, lead(ms) OVER w AS nm FROM c WINDOW w AS (PARTITION BY path ORDER BY ms, event_id)),
    x AS (SELECT *, kind = 'deleted' AND pk = 'created_or_modified' AND ms - pm < {WINDOW_MS} AS gone, nm - ms < {WINDOW_MS} AS soon FROM n)"""


@query("change_debounce", f"WITH {_CH} SELECT path, kind, ms FROM x WHERE NOT coalesce(gone, false) AND NOT coalesce(soon, false)")
def change_debounce(spark, sf):
    return changes.released(_changes(table(spark, sf, "events")), WINDOW_MS).select("path", "kind", F.unix_millis("ts").alias("ms"))


@query("change_churn_cancel", f"WITH {_CH} SELECT path, ms FROM x WHERE coalesce(gone, false)")
def change_churn_cancel(spark, sf):
    return changes.churn_cancelled(_changes(table(spark, sf, "events")), WINDOW_MS).select("path", F.unix_millis("ts").alias("ms"))


@query("change_coalesce", f"WITH {_CH} SELECT path, max(ms) AS ms, count(*) AS changes FROM c GROUP BY path")
def change_coalesce(spark, sf):
    c = _changes(table(spark, sf, "events"))
    return c.groupBy("path").agg(F.max(F.unix_millis("ts")).alias("ms"), F.count("*").alias("changes"))


@query("change_actions", f"WITH {_CH}, {CUR}, r AS (SELECT path, kind FROM x WHERE NOT coalesce(gone, false) AND NOT coalesce(soon, false)) SELECT path, CASE WHEN kind = 'deleted' THEN 'delete' ELSE 'upsert' END AS action, count(*) AS n FROM r GROUP BY 1, 2")
def change_actions(spark, sf):
    e = table(spark, sf, "events")
    batch = changes.released(_changes(e), WINDOW_MS)
    known = e.select(F.concat(F.lit("/u/"), F.col("user_id")).alias("path"), F.lit(1).alias("size")).distinct()
    return changes.as_actions(batch, known).groupBy("path", "action").agg(F.count("*").alias("n"))


_stream_lock = threading.Lock()


@query("change_stream_live")
def change_stream_live(spark, sf):
    """The stateful stream over the event file as it is; released changes are merged into a table by foreachBatch."""
    out = scratch(spark, "changes")
    schema = table(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/event[s].parquet")
    with _stream_lock:
        q = changes.flush(changes.debounced_stream(_changes(source), WINDOW_MS), lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"), f"{out}-progress")
        q.awaitTermination()
    return spark.read.schema("path string, kind string, ts timestamp, batch int").parquet(out).select("path", "kind", F.unix_millis("ts").alias("ms"))


# evaluation


def _ranked(spark, sf):
    """Candidate lists as results: the fused order of each query against the file its name list leads with."""
    c = table(spark, sf, "candidate_files").groupBy("query_id", "file_id").agg(*[F.min(r).alias(r) for r in ("filename_rank", "content_rank", "vector_rank")])
    lead = c.where("filename_rank IS NOT NULL").groupBy("query_id").agg(F.min(F.struct("filename_rank", "file_id")).alias("l"))
    return c, lead.select("query_id", F.col("l.file_id").alias("expected"))


_EV = """c AS (SELECT query_id, file_id, min(filename_rank) f, min(content_rank) t, min(vector_rank) v FROM candidate_files GROUP BY ALL), lead_ AS (SELECT query_id, first(file_id ORDER BY f, file_id) AS expected FROM c WHERE f IS NOT NULL GROUP BY query_id),
    p AS (SELECT c.query_id, c.file_id, row_number() OVER (PARTITION BY c.query_id ORDER BY t NULLS LAST, c.file_id) AS place FROM c), r AS (SELECT l.query_id, CASE WHEN l.query_id % 3 = 0 THEN 'keyword' ELSE 'mixed' END AS query_type, p.place AS rank FROM lead_ l LEFT JOIN p ON p.query_id = l.query_id AND p.file_id = l.expected)"""
_MEASURES = ", ".join(["round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr"] + [f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_at_{k}" for k in (1, 5, 10)] + ["count(*) AS queries"])


def _ranks(spark, sf):
    from pyspark.sql import Window

    c, lead = _ranked(spark, sf)
    # candidates of a query are the few hundred rows its streams return
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("content_rank").asc_nulls_last(), "file_id"))
    name = F.concat(F.lit("f"), F.col("file_id"))
    results = c.select(F.col("query_id").alias("id"), place.alias("place"), F.concat(F.lit("/x/"), name).alias("path"), name.alias("name"))
    suite = lead.select(F.col("query_id").alias("id"), F.when(F.col("query_id") % 3 == 0, "keyword").otherwise("mixed").alias("query_type"), F.array(F.concat(F.lit("F"), F.col("expected"))).alias("expected_files"))
    return evaluation.first_ranks(results, suite)


@query("eval_mrr_recall", f"WITH {_EV} SELECT query_type, {_MEASURES} FROM r GROUP BY ROLLUP (query_type)")
def eval_mrr_recall(spark, sf):
    r = evaluation.report(_ranks(spark, sf))
    return r.select("query_type", *[F.round(c, 6).alias(c) for c in ("mrr", "recall_at_1", "recall_at_5", "recall_at_10")], "queries")


def _trials(spark, sf):
    c, lead = _ranked(spark, sf)
    cand = c.join(lead, "query_id").select("query_id", "file_id", "filename_rank", "content_rank", "vector_rank", (F.col("file_id") % 10 == 0).alias("exact"), (F.col("file_id") % 4).alias("extra"), (1 + (F.col("file_id") % 7) / 20).alias("prior"), (F.col("file_id") == F.col("expected")).alias("relevant"))
    return evaluation.grid_search(cand, evaluation.grid(spark))


@query("grid_search", """WITH c AS (SELECT query_id, file_id, min(filename_rank) f, min(content_rank) t, min(vector_rank) v FROM candidate_files GROUP BY ALL), lead_ AS (SELECT query_id, first(file_id ORDER BY f, file_id) AS expected FROM c WHERE f IS NOT NULL GROUP BY query_id),
    k(k, ik) AS (VALUES (30.0::DOUBLE, 0), (60, 1), (90, 2)), a(a, ia) AS (VALUES (0.8::DOUBLE, 0), (1.2, 1), (1.5, 2)), b(b, ib) AS (VALUES (0.8::DOUBLE, 0), (1.0, 1), (1.2, 2)), d(d, id_) AS (VALUES (0.8::DOUBLE, 0), (1.1, 1), (1.4, 2)), x(x, ix) AS (VALUES (1.5::DOUBLE, 0), (2.0, 1), (2.5, 2)), m(m, im) AS (VALUES (0.02::DOUBLE, 0), (0.05, 1)),
    g AS (SELECT 1 + ((((ik * 3 + ia) * 3 + ib) * 3 + id_) * 3 + ix) * 2 + im AS trial, * FROM k, a, b, d, x, m),
    s AS (SELECT g.trial, c.query_id, c.file_id, c.file_id = l.expected AS rel, round((coalesce(a / (k + f), 0) + coalesce(b / (k + t), 0) + coalesce(d / (k + v), 0)) * (1 + (c.file_id % 7) / 20.0::DOUBLE) * (CASE WHEN c.file_id % 10 = 0 THEN 1 + x ELSE 1.0 END) + m * (c.file_id % 4), 12) AS score FROM c JOIN lead_ l USING (query_id), g),
    r AS (SELECT trial, query_id, file_id, rel, row_number() OVER (PARTITION BY trial, query_id ORDER BY score DESC, file_id) AS place FROM s)
    SELECT trial::INT AS trial, round(sum(CASE WHEN rel AND place <= 10 THEN 1.0::DOUBLE / place ELSE 0 END) / count(DISTINCT query_id), 6) AS mrr, round(sum(CASE WHEN rel AND place <= 10 THEN 1.0::DOUBLE ELSE 0 END) / count(DISTINCT query_id), 6) AS recall_at_10 FROM r GROUP BY trial""")
def grid_search(spark, sf):
    return _trials(spark, sf).select("trial", F.round("mrr", 6).alias("mrr"), F.round("recall_at_10", 6).alias("recall_at_10"))


@query("grid_search_best", SQL["grid_search"].replace("SELECT trial::INT", ", t AS (SELECT trial::INT") + ") SELECT * FROM t ORDER BY mrr DESC, recall_at_10 DESC, trial LIMIT 1")
def grid_search_best(spark, sf):
    return evaluation.best_trial(_trials(spark, sf)).select("trial", F.round("mrr", 6).alias("mrr"), F.round("recall_at_10", 6).alias("recall_at_10"))


@query("eval_gate", f"WITH {_EV} SELECT avg(coalesce(1.0 / rank, 0)) >= greatest(0.0, 0.85 - 0.05) AS passed FROM r")
def eval_gate(spark, sf):
    return _ranks(spark, sf).agg((F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))) >= F.lit(max(0.0, 0.85 - 0.05))).alias("passed"))


# further operators


@query("code_symbol_chunks")
def code_symbol_chunks(spark, sf):
    c = chunks_of(spark, sf).where("symbol IS NOT NULL")
    ext = F.when(F.col("text").rlike(r"(?m)^def "), "py").when(F.col("text").rlike(r"(?m)^(pub )?fn "), "rs").when(F.col("text").rlike(r"(?m)^func "), "go").when(F.col("text").rlike(r"(?m)^export "), "ts").otherwise("txt")
    return symbols.code_chunk_table(c.withColumn("path", F.concat(F.lit("/f"), F.col("file_id"), F.lit("."), ext)), "id", "path", "text")


@query("audio_energy", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) / len(embedding)), 9) AS rms FROM embeddings")
def audio_energy(spark, sf):
    """Root mean square of a sample array; the vectors stand for samples."""
    return table(spark, sf, "embeddings").select("vec_id", F.round(rms(F.col("embedding")), 9).alias("rms"))


@query("recent_queries", "WITH l AS (SELECT lower(event_type || ' ' || user_id % 20) AS k, max(epoch_us(ts)) AS last_at FROM events GROUP BY 1) SELECT k AS query FROM l ORDER BY last_at DESC, k LIMIT 8")
def recent_queries(spark, sf):
    log = table(spark, sf, "events").select(F.concat_ws(" ", "event_type", F.col("user_id") % 20).alias("query"), F.col("ts").cast("timestamp").alias("at"))
    return extension.recent_queries(log).select("query")


@query("thumbnail_keys", f"WITH {CUR} SELECT id, coalesce(content_hash, sha256(path)) AS key FROM cur WHERE lower(ext) IN ('png', 'jpg', 'jpeg', 'webp', 'bmp', 'gif')")
def thumbnail_keys(spark, sf):
    return extension.thumbnail_keys(files_of(spark, sf))


@query("files_in_folders", f"WITH {CUR} SELECT id FROM cur WHERE starts_with(path, '/home/desk/Downloads/') OR starts_with(path, '/home/desk/vault/')")
def files_in_folders(spark, sf):
    return extension.in_folders(files_of(spark, sf), ["/home/desk/Downloads/", "/home/desk/vault"]).select("id")


@query("retry_problems", """WITH f AS (SELECT user_id, '/u/' || user_id AS path, event_id % 2 = 1 AS late FROM events WHERE event_type = 'error'), p AS (SELECT user_id FROM f GROUP BY user_id HAVING NOT (count(*) FILTER (late) = 0 AND user_id % 2 = 0)),
    j AS (SELECT user_id FROM events WHERE event_id % 2 = 0 AND event_type NOT IN ('error', 'view') AND user_id % 3 <> 0) SELECT user_id AS file_id, 10 AS priority FROM p WHERE user_id NOT IN (SELECT user_id FROM j)""")
def retry_problems(spark, sf):
    return extension.retry_problems(_problems(spark, sf), _jobs(spark, sf).where("file_id % 3 <> 0"), NOW).select("file_id", "priority")
