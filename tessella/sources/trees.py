"""Project directories as file inventories, and the annotated tree of what matters in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import file_category
from tessella.operators.drift import kept_files

# Root files that mark a codebase.
ROOT_FILES = (
    "package.json", "Cargo.toml", "go.mod", "pyproject.toml", "setup.py", "pom.xml", "build.gradle", "build.gradle.kts", "Gemfile", "composer.json",
    "mix.exs", "pubspec.yaml", "Package.swift", "Makefile", "CMakeLists.txt", "deno.json", "flake.nix",
)


def inventory(spark: SparkSession, folder: str, model: str = "main") -> DataFrame:
    """(model, path, mtime_ns): files below a folder by path relative to it; contents are not read.

    Noise and build folders are taken out by ``kept_files``. Hidden files are
    not seen and ignore files not interpreted; ``ignore.scan`` does both.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/") + "/"
    plain = F.url_decode(F.regexp_replace("path", "^[a-z]+:/*", "/"))
    bare = root if "://" not in root else "/" + root.split("://", 1)[1].lstrip("/")
    rows = files.select(F.lit(model).alias("model"), F.substring(plain, F.lit(len(bare) + 1), F.length(plain)).alias("path"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    return kept_files(rows)


def is_codebase(file: DataFrame) -> DataFrame:
    """(model, is_codebase): a manifest, a .NET project or ``.git`` at the root."""
    name = F.col("path")
    mark = name.isin(*ROOT_FILES) | name.rlike("^[^/]+\\.(csproj|fsproj|sln)\\z") | F.startswith(name, F.lit(".git/"))
    return file.groupBy("model").agg((F.count_if(mark) > 0).alias("is_codebase"))


def tree_lines(file: DataFrame, context_depth: int = 1) -> DataFrame:
    """(model, path, is_dir, depth, category, hidden): what a tree shows of each directory, to be sorted and indented by the reader.

    Annotated files are shown; directories with annotated files below are
    shown; other directories only while less deep than ``context_depth``.
    Every shown directory tells how many of its entries stay hidden; the root
    has the path "".
    """
    name = F.element_at(F.split("path", "/"), -1)
    files = file.select("model", "path", file_category(name, F.col("path")).alias("category"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    up = F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))
    dirs = files.select("model", F.explode(up).alias("path"), F.col("category").isNotNull().alias("marked")).groupBy("model", "path").agg(F.max("marked").alias("marked"))
    depth = F.size(F.split("path", "/")) - 1
    shown_dirs = dirs.select("model", "path", F.lit(True).alias("is_dir"), depth.alias("depth"), F.lit(None).cast("string").alias("category"), (F.col("marked") | (depth < context_depth)).alias("shown"))
    rows = shown_dirs.unionByName(files.select("model", "path", F.lit(False).alias("is_dir"), depth.alias("depth"), "category", F.col("category").isNotNull().alias("shown")))
    parent = F.when(F.col("depth") > 0, F.regexp_replace("path", "/[^/]*\\z", "")).otherwise("")
    hidden = rows.withColumn("parent", parent).groupBy("model", F.col("parent").alias("path")).agg(F.count_if(~F.col("shown")).alias("hidden"))
    root = rows.select("model").distinct().select("model", F.lit("").alias("path"), F.lit(True).alias("is_dir"), F.lit(-1).alias("depth"), F.lit(None).cast("string").alias("category"))
    lines = rows.where("shown").drop("shown").unionByName(root)
    # a directory is shown only where its own parents are; those of a shown deep one are marked too
    return lines.join(hidden, ["model", "path"], "left").select("model", "path", "is_dir", "depth", "category", F.when(F.col("is_dir"), F.coalesce("hidden", F.lit(0))).alias("hidden"))
