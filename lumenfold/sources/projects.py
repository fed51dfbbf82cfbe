"""Project detection over a listing of files: one row per directory that holds a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Manifests in order of precedence, with the project type each stands for.
MANIFESTS = [("Cargo.toml", "rust"), ("package.json", "javascript"), ("pyproject.toml", "python"), ("setup.py", "python"), ("requirements.txt", "python"), ("Pipfile", "python"), ("go.mod", "go"), ("pom.xml", "java"), ("build.gradle.kts", "kotlin"), ("build.gradle", "java")]
READMES = ["README.md", "readme.md", "README.MD", "README.txt", "readme.txt", "README", "readme"]


def manifest_name(name: Column, content: Column) -> Column:
    """The project's name in a manifest: a TOML `name`, package.json's without scope, the last part of a Go module."""
    toml = F.nullif(F.regexp_extract(content, r"(?m)^\s*name\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))
    npm = F.substring_index(F.get_json_object(content, "$.name"), "/", -1)
    go = F.nullif(F.substring_index(F.regexp_extract(content, r"(?m)^\s*module\s+(\S+)", 1), "/", -1), F.lit(""))
    return F.when(name.isin("Cargo.toml", "pyproject.toml"), toml).when(name == "package.json", F.regexp_replace(npm, "^@", "")).when(name == "go.mod", go).when(name.rlike(r"(?i)\.(sln|csproj)$"), F.regexp_replace(name, r"\.[^.]*$", ""))


def detect(files: DataFrame) -> DataFrame:
    """files: path, parent_dir, name, content (may be null). path, name, project_type, manifest_path of each project directory.

    Hidden directories other than `.git` are passed over; `.git` alone makes a directory a project of type git."""
    visible = files.where(~F.col("parent_dir").rlike(r"/\.(?!git(?:/|$))[^/]+"))
    order = F.lit(None).cast("int")
    for k, (m, _) in enumerate(MANIFESTS):
        order = F.when(F.col("name") == m, k).otherwise(order)
    order = F.coalesce(order, F.when(F.col("name").rlike(r"(?i)\.(sln|csproj)$"), len(MANIFESTS)))
    kinds = F.array(*[F.lit(k) for _, k in MANIFESTS], F.lit("csharp"))
    rows = visible.withColumn("o", order).withColumn("title", manifest_name(F.col("name"), F.col("content")))
    found = rows.groupBy("parent_dir").agg(
        F.min(F.when(F.col("o").isNotNull(), F.struct("o", "path", "title"))).alias("m"), F.max(F.col("name") == "tsconfig.json").alias("ts")
    ).where(F.col("m").isNotNull())
    kind = F.get(kinds, F.col("m.o"))
    named = found.select(F.col("parent_dir").alias("path"), F.coalesce("m.title", F.substring_index("parent_dir", "/", -1)).alias("name"), F.when((kind == "javascript") & F.col("ts"), "typescript").otherwise(kind).alias("project_type"), F.col("m.path").alias("manifest_path"))
    git = visible.where(F.col("parent_dir").rlike(r"/\.git(?:/|$)")).select(F.regexp_replace("parent_dir", r"/\.git(?:/.*)?$", "").alias("path")).distinct().join(named.select("path"), "path", "left_anti")
    return named.unionByName(git.select("path", F.substring_index("path", "/", -1).alias("name"), F.lit("git").alias("project_type"), F.lit(None).cast("string").alias("manifest_path")))
