"""Ranking scalars. `now` is always a parameter."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RankingConfig:
    """Tunables with their standard values."""

    rrf_k: float = 60.0
    weight_filename: float = 1.2
    weight_content: float = 1.0
    weight_vector: float = 1.1
    weight_image_tag: float = 1.2
    weight_image_vector: float = 1.1
    exact_name_boost: float = 5.0
    stem_name_boost: float = 3.0
    prefix_name_boost: float = 1.5
    recency_weight: float = 0.3
    recency_half_life_days: float = 90.0
    depth_weight: float = 0.4
    multi_chunk_bonus: float = 0.05
    chunk_similarity_threshold: float = 0.6
    max_additional_matches: int = 3
    file_type_prior_weight: float = 0.3
    location_boost_weight: float = 0.8
    tag_boost_weight: float = 1.0


STREAMS = ("filename", "content", "vector", "image_tag", "image_vector")

# Word lists of the intent rules.
IMAGE_WORDS = ["screenshot", "screen shot", "screengrab", "photo", "picture", "qr", "barcode", "whiteboard", "wallpaper", "drawing"]
CODE_WORDS = ["fn ", "def ", "class ", "import ", "async ", "const ", "struct ", "impl ", "interface ", "export ", "public ", "private ", "void ", "return ", "typedef "]
CODE_SIGNS = ["::", "->", "()", "=>", "==", "!="]
DOCUMENT_WORDS = ["pdf", "report", "presentation", "sheet", "summary", "notes", "slides", "proposal", "invoice", "manual", "guide", "whitepaper", "budget", "minutes", "downloaded"]
# Extensions the type prior counts as code, document and image.
PRIOR_CODE = "rs py js ts tsx jsx c cpp h hpp go java cs rb php swift kt".split()
PRIOR_DOCUMENT = "pdf docx doc pptx ppt xlsx xls md txt csv rtf".split()
PRIOR_IMAGE = "png jpg jpeg webp gif bmp svg tiff ico".split()


def rrf(rank: Column, k: float, weight: float) -> Column:
    """weight / (k + rank); 0 for rank 0 or none."""
    return F.when(rank > 0, F.lit(weight) / (F.lit(k) + rank)).otherwise(F.lit(0.0))


def depth_boost(path: Column, weight: float) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    slashes = F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))
    return F.lit(1.0) + F.lit(weight) / (F.lit(1.0) + slashes)


def whole_days(ts: Column, now: datetime) -> Column:
    """Whole days of 24 hours from ts to now, not below 0; an unknown time counts as now."""
    seconds = F.unix_seconds(F.lit(now.strftime("%Y-%m-%d %H:%M:%SZ")).cast("timestamp")) - F.unix_seconds(ts)
    return F.coalesce(F.greatest(F.floor(seconds / 86400), F.lit(0)), F.lit(0))


def recency_boost(ts: Column, now: datetime, weight: float, half_life_days: float) -> Column:
    return F.lit(1.0) + F.lit(weight) * F.pow(F.lit(2.0), -whole_days(ts, now) / F.lit(max(half_life_days, 1.0)))


def name_boost(name: Column, query: str, cfg: RankingConfig) -> Column:
    """Exact name, exact stem, stem prefix; a name without a dot: exact or prefix."""
    q = query.lower().strip()
    if not q:
        return F.lit(1.0)
    n = F.lower(name)
    stem = F.when(n.contains("."), F.regexp_replace(n, r"\.[^.]*$", "")).otherwise(n)
    return (
        F.when(n == q, 1.0 + cfg.exact_name_boost)
        .when(n.contains(".") & (stem == q), 1.0 + cfg.stem_name_boost)
        .when(stem.startswith(q), 1.0 + cfg.prefix_name_boost)
        .otherwise(F.lit(1.0))
    )


def location_boost(path: Column, hints: list[str], weight: float) -> Column:
    p = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    hit = F.lit(False)
    for h in hints:
        if h.strip():
            hit = hit | p.contains(h.lower().strip())
    return F.when(hit, F.lit(1.0 + weight)).otherwise(F.lit(1.0))


def tag_boost(has_tag: Column, weight: float) -> Column:
    return F.when(has_tag, F.lit(1.0 + weight)).otherwise(F.lit(1.0))


def query_intent(query: str) -> str:
    """image, code, document or general, tried in this order."""
    q = query.strip()
    low = q.lower()
    if not q:
        return "general"
    if any(w in low for w in IMAGE_WORDS):
        return "image"
    code_word = any(q.startswith(w) or f" {w}" in q for w in CODE_WORDS)
    one_word = " " not in q
    camel_or_snake = one_word and ("_" in q or (re.search(r"[^\W\d_]", q) is not None and q != low and q != q.upper()))
    if code_word or any(s in q for s in CODE_SIGNS) or camel_or_snake:
        return "code"
    if any(w in low for w in DOCUMENT_WORDS) or (len(q.split()) >= 4 and "{" not in q and "(" not in q):
        return "document"
    return "general"


def type_prior(intent: str, ext: Column, kind: Column, weight: float) -> Column:
    """1 + w for files of the intent's type, 1 / (1 + w) for the types it speaks against."""
    e = F.lower(ext)
    k = F.coalesce(kind, F.lit(""))
    code = e.isin(PRIOR_CODE) | (k == "code")
    document = e.isin(PRIOR_DOCUMENT) | k.isin("document", "pdf", "text")
    image = e.isin(PRIOR_IMAGE) | k.isin("image", "screenshot")
    rules = {"code": (code, document | image), "document": (document, code | image), "image": (image, code)}
    if intent not in rules:
        return F.lit(1.0)
    up, down = rules[intent]
    return F.when(up, F.lit(1.0 + weight)).when(down, F.lit(1.0) / F.lit(1.0 + weight)).otherwise(F.lit(1.0))
