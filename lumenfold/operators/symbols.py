"""Source code to chunks: one per outermost definition, with a header that names file and symbol; else windows of lines."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import LANGUAGES

_HEADS = {
    "rust": r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+|extern\s+\"[^\"]*\"\s+)*(?:fn|struct|enum|trait|impl|type)\b\s*(?:<[^>{]*>\s*)?(\w+)?",
    "go": r"(?:func\s*(?:\([^)]*\)\s*)?|type\s+)(\w+)",
    "javascript": r"(?:export\s+(?:default\s+)?)?(?:async\s+)?(?:function\*?|class)\s+(\w+)",
    "typescript": r"(?:export\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\*?|class|interface|enum|type)\s+(\w+)",
    "java": r"(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?:class|interface|enum|record)\s+(\w+)",
    "csharp": r"(?:(?:public|private|protected|internal|static|sealed|abstract|partial)\s+)*(?:class|interface|enum|struct|record)\s+(\w+)",
    "c": r"(?:(?:static|inline|extern|const|unsigned|struct|enum)\s+)*[\w*]+[\s*]+(\w+)\s*\([^;{]*\)(?=\s*\{)|(?:typedef\s+)?(?:struct|enum|union)\s+(\w+)(?=\s*\{)",
}
_HEADS["cpp"] = r"(?:class|struct|enum(?:\s+class)?)\s+(\w+)(?=[^;{]*\{)|" + _HEADS["c"]


def _close(text: str, at: int) -> int:
    """The place after the brace that closes the first one opened from `at`; a `;` before any brace ends there. Braces in
    strings and comments don't count."""
    depth, i, n = 0, at, len(text)
    while i < n:
        c = text[i]
        if text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else n
            continue
        if text.startswith("/*", i):
            j = text.find("*/", i + 2)
            i = n if j < 0 else j + 2
            continue
        if c in "\"`" or (c == "'" and re.match(r"'(?:\\.|[^\\'])'", text[i:])):
            j = i + 1
            while j < n and text[j] != c:
                j += 2 if text[j] == "\\" else 1
            i = j + 1
            continue
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i + 1
        elif c == ";" and depth == 0:
            return i + 1
        i += 1
    return n


def symbols(text: str, language: str) -> list[tuple[str, int, int]]:
    """(name, start, end) of the outermost definitions, in order."""
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return []
        lines = [0]
        for line in text.splitlines(keepends=True):
            lines.append(lines[-1] + len(line))
        raw = text.splitlines(keepends=True)
        place = lambda row, col: lines[row - 1] + len(raw[row - 1].encode()[:col].decode("utf-8", "ignore"))
        kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
        out, todo = [], list(reversed(tree.body))
        while todo:
            n = todo.pop()
            if isinstance(n, kinds):
                out.append((n.name, place(n.lineno, n.col_offset), place(n.end_lineno, n.end_col_offset)))
            else:
                todo += [c for c in reversed(list(ast.iter_child_nodes(n))) if isinstance(c, ast.stmt)]
        return out
    head = _HEADS.get(language)
    if head is None:
        return []
    out, end = [], 0
    for m in re.finditer(rf"(?m)^[ \t]*(?:{head})", text):
        if m.start() < end:
            continue
        start = m.start() + len(m.group(0)) - len(m.group(0).lstrip())
        end = _close(text, m.end())
        name = next((g for g in m.groups() if g), None) or re.search(r"\w+", m.group(0)).group(0)
        out.append((name, start, end))
    return out


def code_chunks(path: str, text: str, lines: int = 50, overlap: int = 10) -> list[tuple[str, str | None, str | None, int, int]]:
    """(text, section, symbol, start, end)."""
    ext = path.rpartition(".")[2].lower()
    found = symbols(text, LANGUAGES.get(ext, ""))
    out = []
    for name, a, b in found:
        body = text[a:b].strip()
        if body:
            out.append((f"// File: {path} | Symbol: {name}\n{body}", None, name, a, b))
    if out:
        return out
    rows = text.splitlines()
    i = 0
    while i < len(rows):
        j = min(i + lines, len(rows))
        out.append((f"// File: {path} (lines {i + 1}-{j})\n" + "\n".join(rows[i:j]), f"lines {i + 1}-{j}", None, 0, 0))
        if j == len(rows):
            break
        i += max(lines - overlap, 1)
    return out


RESULT = "id long, ordinal int, text string, section string, symbol string, start_offset int, end_offset int"


def code_chunk_table(df: DataFrame, id_col: str, path_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = [(i, n, *c) for i, p, t in zip(pdf["id"], pdf["path"], pdf["text"]) for n, c in enumerate(code_chunks(p or "", t or ""))]
            yield pd.DataFrame(rows, columns=["id", "ordinal", "text", "section", "symbol", "start_offset", "end_offset"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text")).mapInPandas(run, RESULT)
