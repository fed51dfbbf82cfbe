"""Text, path and classification expressions. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File kinds by extension.
KINDS = {
    "document": "pdf doc docx xls xlsx ppt pptx odt ods odp rtf txt md csv tsv json xml yaml yml toml ini cfg conf log tex epub".split(),
    "code": "rs py js ts tsx jsx java kt c cpp h hpp cs go rb php swift m scala clj hs erl ex exs lua r jl sql sh bash zsh ps1 bat cmd html css scss sass less vue svelte zig nim dart v wasm proto graphql".split(),
    "image": "png jpg jpeg gif bmp svg webp ico tiff tif raw heic heif avif".split(),
    "archive": "zip tar gz bz2 xz 7z rar zst".split(),
}
# Language names by extension.
LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "java": "java", "cs": "csharp", "rb": "ruby", "php": "php", "sql": "sql", "sh": "shell", "ps1": "powershell", "html": "html", "css": "css"}


def normalise_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def path_name(path: Column) -> Column:
    return F.substring_index(normalise_path(path), "/", -1)


def path_parent(path: Column) -> Column:
    p = normalise_path(path)
    return F.when(p.contains("/"), F.regexp_replace(p, r"/[^/]*$", "")).otherwise("")


def path_ext(path: Column) -> Column:
    name = path_name(path)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def file_kind(ext: Column) -> Column:
    e = F.lower(ext)
    out = None
    for kind, exts in KINDS.items():
        out = F.when(e.isin(exts), kind) if out is None else out.when(e.isin(exts), kind)
    return out.otherwise("other")


def language(ext: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.lower(ext)]


def glob_regex(pattern: str) -> str:
    """A glob (`*`, `**`, `?`, `[..]`, `{a,b}`) as a regular expression over the whole path."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = pattern.find("]", i + 2)
            if j < 0:
                out.append(r"\[")
            else:
                body = pattern[i + 1 : j]
                out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
                i = j
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether any glob takes the path out."""
    p = normalise_path(path)
    out = F.lit(False)
    for g in patterns:
        out = out | p.rlike(glob_regex(g))
    return out


def fold(text: Column) -> Column:
    """Lower case without diacritics (the letters of Latin scripts that have them)."""
    src, dst = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďđęěğīłńňőœřśšťůűźżžßø", "aaaaaaceeeeiiiinooooouuuuyyaaaccddeegilnnoorsstuuzzzso"
    low = F.lower(text)
    # most texts have no such letter, and a look is cheaper than the translation
    return F.when(is_ascii(low), low).otherwise(F.translate(low, src, dst))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def word_count(folded: Column) -> Column:
    """Number of terms of a folded text. The pattern for ASCII texts is several times as fast."""
    return F.when(is_ascii(folded), F.regexp_count(folded, F.lit("[a-z0-9]+"))).otherwise(F.regexp_count(folded, F.lit(r"[\p{L}\p{N}]+")))


def tokens(text: Column) -> Column:
    """Terms of the content index: runs of letters and digits, folded."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(query: str) -> list[list[str]]:
    """The terms of a content query: words stripped to letters, digits, `_` and `-`; a word that the index splits is a phrase.
    The last piece of each is a prefix."""
    out = []
    for w in query.split():
        clean = "".join(c for c in w if c.isalnum() or c in "_-")
        pieces = [p for p in re.split(r"[\W_]+", clean.lower()) if p]
        if pieces:
            out.append(pieces)
    return out


def match_expression(query: str) -> str:
    """The query in the syntax of a full-text index: quoted prefix terms, all of which must occur."""
    words = ("".join(c for c in w if c.isalnum() or c in "_-") for w in query.split())
    return " ".join(f'"{w}"*' for w in words if w)


def trigrams(text: Column) -> Column:
    """Distinct runs of three letters or digits, lower-cased, other signs left out."""
    chars = F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), ""), lambda c: c != "")
    n = F.greatest(F.size(chars) - 2, F.lit(0))
    # lambdas that only use their arguments: whatever else stands in one is computed anew for each element
    pairs = F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.zip_with(pairs, F.slice(chars, 3, n), lambda a, b: F.concat(a, b)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def short_snippet(text: Column, limit: int = 160) -> Column:
    """At most `limit` characters; longer texts are cut, trimmed and end in `...`."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.trim(F.substring(text, 1, limit)), F.lit("...")))


def strip_marks(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<mark>"), F.lit("")), F.lit("</mark>"), F.lit(""))


def sentences(text: Column) -> Column:
    """Sentences: up to a `.`, `!`, `?` or line end that white space or the end follows; trimmed, none empty."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?\n])(?=\s)"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def with_snippet(df: DataFrame, terms: list[str], text_col: str = "text", width: int = 24) -> DataFrame:
    """Adds `snippet`: the first window of `width` words that holds most distinct terms, its matches in <mark>; `…` where text
    was cut. A term is a prefix of a folded word.

    The words and their hits pass through an `explode` of one element, so the window search reads them as plain columns;
    inlined into its lambda they would be computed for every window."""
    words = F.split(F.trim(F.col(text_col)), r"\s+")
    folded = F.transform(words, lambda w: F.regexp_replace(fold(w), r"^[^\p{L}\p{N}]+", ""))
    marks = F.transform(folded, lambda w: sum((F.when(w.startswith(t), F.lit(1 << k)).otherwise(0) for k, t in enumerate(terms[:30])), F.lit(0)))
    held = df.select("*", F.explode(F.array(F.struct(words.alias("w"), marks.alias("h")))).alias("_s"))
    w, h = F.col("_s.w"), F.col("_s.h")
    n = F.size(w)
    starts = F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1)))
    score = lambda i: F.bit_count(F.aggregate(F.slice(h, i, width), F.lit(0), lambda a, x: a.bitwiseOR(x)))
    best = F.array_max(F.transform(starts, lambda i: F.struct(score(i).alias("s"), (-i).alias("i"))))
    placed = held.select("*", F.explode(F.array(-best["i"])).alias("_at"))
    at = F.col("_at")
    marked = F.zip_with(F.slice(w, at, width), F.slice(h, at, width), lambda x, k: F.when(k > 0, F.concat(F.lit("<mark>"), x, F.lit("</mark>"))).otherwise(x))
    return placed.withColumn("snippet", F.concat(F.when(at > 1, "…").otherwise(""), F.array_join(marked, " "), F.when(at + width <= n, "…").otherwise(""))).drop("_s", "_at")
