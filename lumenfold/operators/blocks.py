"""Texts to blocks and chunks: paragraphs, line windows, sentence windows, README summaries, previews."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paragraphs(text: Column) -> Column:
    """Array of struct(ordinal, text, start_offset, end_offset): parts between empty lines, trimmed, with the offsets of the
    untrimmed part; empty parts keep their place in the count of offsets only."""
    parts = F.split(text, "\n\n")
    ends = F.aggregate(parts, F.array().cast("array<int>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)) + 2, F.lit(0)) + F.length(p))))
    joined = F.zip_with(parts, ends, lambda p, e: F.struct(F.regexp_replace(p, r"^\s+|\s+$", "").alias("text"), (e - F.length(p)).cast("int").alias("start_offset"), e.cast("int").alias("end_offset")))
    return F.filter(joined, lambda b: b["text"] != "")


def line_windows(text: Column, size: int = 50, overlap: int = 10) -> Column:
    """Array of struct(text, first, last): windows of lines, each starting `size - overlap` after the one before, the last one ending with the text."""
    lines = F.split(F.regexp_replace(text, r"\n$", ""), r"\r?\n")
    n = F.size(lines)
    step = max(size - overlap, 1)
    count = F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int") + 1
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda k: k * step)
    return F.transform(starts, lambda s: F.struct(F.array_join(F.slice(lines, s + 1, size), "\n").alias("text"), (s + 1).alias("first"), F.least(s + size, n).alias("last")))


def split_sentences(text: str) -> list[tuple[str, int, int]]:
    out, start = [], 0
    for m in re.finditer(r"[.!?\n](?=\s|\Z)", text):
        s = text[start : m.end()].strip()
        if s:
            out.append((s, start, m.end()))
        start = m.end()
    tail = text[start:].strip()
    return out + ([(tail, start, len(text))] if tail else [])


def prose_windows(text: str, target: int = 1000, overlap: int = 150, least: int = 100) -> list[tuple[str, int, int]]:
    """Sentence-bounded chunks of at least `target` characters that share up to `overlap` characters (at least a sentence)
    with the one before; a rest under `least` joins the last chunk. Short texts are one chunk."""
    text = text.strip()
    if not text:
        return []
    if len(text) <= target + overlap:
        return [(text, 0, len(text))]
    out: list[tuple[str, int, int]] = []
    held: list[str] = []
    size = begin = 0
    for s, a, b in split_sentences(text):
        if not held:
            begin = a
        held.append(s)
        size += len(s)
        if size >= target:
            out.append((" ".join(held), begin, b))
            back = 0
            keep: list[str] = []
            for x in reversed(held):
                if keep and back + len(x) > overlap:
                    break
                keep.insert(0, x)
                back += len(x)
            held, size, begin = keep, back, max(b - back, 0)
    rest = " ".join(held)
    if rest.strip():
        if len(rest) < least and out:
            t, a, _ = out[-1]
            out[-1] = (f"{t} {rest}", a, len(text))
        else:
            out.append((rest, begin, len(text)))
    return out


def prose_chunks(df: DataFrame, id_col: str, text_col: str, **kw) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = [(i, n, t, a, b) for i, text in zip(pdf["id"], pdf["text"]) for n, (t, a, b) in enumerate(prose_windows(text or "", **kw))]
            yield pd.DataFrame(rows, columns=["id", "ordinal", "text", "start_offset", "end_offset"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, ordinal int, text string, start_offset int, end_offset int")


def readme_summary(text: Column) -> Column:
    """Up to five kept lines of the first 60: fences, badges and image lines left out, heading signs, tags and link targets
    removed; white space folded; at most 300 characters and `...`; null if nothing is left."""
    lines = F.transform(F.slice(F.split(text, r"\r?\n"), 1, 60), lambda x: F.trim(x))
    # a line is code if an odd number of fences stands before it
    seen = F.aggregate(lines, F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out")), lambda a, x: F.struct((a["n"] + F.when(x.startswith("```"), 1).otherwise(0)).alias("n"), F.when(~x.startswith("```") & (a["n"] % 2 == 0) & (x != ""), F.concat(a["out"], F.array(x))).otherwise(a["out"]).alias("out")))["out"]
    image = lambda x: x.startswith("[![") | (x.startswith("![") & (x.contains("badge") | x.endswith(")")))
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(x, r"^#+", "")), r"<[^>]*>?", ""), r"\[([^\]]*)\]\([^)]*\)?", "$1"))
    kept = F.slice(F.filter(F.transform(F.filter(seen, lambda x: ~image(x)), clean), lambda x: x != ""), 1, 5)
    flat = F.trim(F.regexp_replace(F.array_join(kept, " "), r"\s+", " "))
    return F.when(flat == "", None).when(F.length(flat) > 300, F.concat(F.substring(flat, 1, 300), F.lit("..."))).otherwise(flat)


def preview(df: DataFrame, id_col: str, text_col: str, lines: int = 200, most_bytes: int = 32768) -> DataFrame:
    """id, content_preview (first lines until `lines` or `most_bytes` are reached), line_count, is_truncated."""
    x = F.filter(F.split(F.col(text_col), r"(?<=\n)"), lambda s: s != "")
    shown = F.aggregate(F.slice(x, 1, lines), F.struct(F.lit(0).cast("long").alias("b"), F.array().cast("array<string>").alias("l")), lambda a, s: F.when(a["b"] < most_bytes, F.struct((a["b"] + F.octet_length(s)).cast("long").alias("b"), F.concat(a["l"], F.array(s)).alias("l"))).otherwise(a))["l"]
    return df.select(F.col(id_col).alias("id"), x.alias("x"), shown.alias("s")).select("id", F.array_join("s", "").alias("content_preview"), F.size("x").alias("line_count"), (F.size("s") < F.size("x")).alias("is_truncated"))
