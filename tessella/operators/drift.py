"""Drift between source files and a model.

Supported glob dialect: ``**`` crosses directories (``**/`` also matches none),
``*`` and ``?`` stay inside one name, ``[...]`` and ``[!...]`` are classes; a
leading dot is not special and case matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.lineage import written

#: Directories that scans leave out.
SKIP_DIRS = ("node_modules", ".git", ".next", "__pycache__", ".direnv", ".venv", ".turbo", ".cache", ".nuxt", ".output", ".svelte-kit", ".parcel-cache", ".webpack", "vendor")
SKIP_BUILD_DIRS = ("dist", "build", "out", "target", ".build", "bin", "obj", "pkg")


def glob_regex(pattern: Column) -> Column:
    """Regular expression of a glob column."""
    p = F.regexp_replace(pattern, r"([.+()|^$\{\}\\])", r"\\$1")
    p = F.replace(p, F.lit("[!"), F.lit("[^"))
    for old, new in (("**/", "\x01"), ("**", "\x02"), ("*", "[^/]*"), ("?", "[^/]"), ("\x01", "(?:.*/)?"), ("\x02", ".*")):
        p = F.replace(p, F.lit(old), F.lit(new))
    return F.concat(F.lit("^"), p, F.lit("\\z"))


def directories(path: Column) -> Column:
    """All directories above a path, from "" down, each with a closing slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))


#: Rows of one pattern that meet in a task: so many files and so many source-map rows.
PORTION = 4096


def glob_join(source_map: DataFrame, file: DataFrame) -> DataFrame:
    """Pairs of source-map rows and files that their pattern matches.

    A pattern's literal directory prefix is an equi-join key against all
    directories above a file, so the regular expression is only tried inside it,
    and once for all rows with the pattern. These and its files meet in squares
    of about ``PORTION`` by ``PORTION``, so that a pattern with many of both is
    spread over tasks.
    """
    keys = [c for c in ("model",) if c in source_map.columns and c in file.columns]
    side = [*keys, "pattern"]
    patterns = source_map.select(*side).distinct().select("*", F.regexp_extract("pattern", "^((?:[^*?\\[/]*/)*)", 1).alias("_dir"), glob_regex(F.col("pattern")).alias("_regex"))
    placed = file.select("*", F.explode(directories(F.col("path"))).alias("_dir"))
    hit = written(patterns.join(placed, ["_dir", *keys]).where(F.expr("path RLIKE _regex")).drop("_dir", "_regex"), "hits")
    portions = lambda df, name: df.groupBy(*side).agg(F.ceil(F.count("*") / PORTION).alias(name))
    sizes = portions(source_map, "_rows").join(portions(hit, "_files"), side)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = lambda n, *of: F.pmod(F.xxhash64(*of), F.col(n))
    rows = source_map.join(sizes, side).select(*source_map.columns, one("_rows", *source_map.columns).alias("_row"), every("_files").alias("_file"))
    files = hit.join(sizes, side).select(*hit.columns, one("_files", "path").alias("_file"), every("_rows").alias("_row"))
    return rows.join(files, [*side, "_row", "_file"]).select(*keys, *[c for df in (source_map, file) for c in df.columns if c not in keys])


def source_drift(source_map: DataFrame, file: DataFrame, node: DataFrame, since: Column) -> DataFrame:
    """(model, id, name, patterns): owners with a file strictly newer than ``since``; hit patterns in order, unknown owners unnamed."""
    newer = file.where(F.col("mtime") > since)
    hits = glob_join(source_map, newer).select("model", "owner_id", "pos", "pattern").distinct()
    listed = hits.groupBy("model", F.col("owner_id").alias("id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "pattern"))), lambda x: x["pattern"]), ",").alias("patterns")
    )
    return listed.join(node.select("model", "id", "name"), ["model", "id"], "left").select("model", "id", F.coalesce("name", F.lit("")).alias("name"), "patterns")


def kept_files(file: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
    """Files outside of skipped and build directories, and of those that the caller names as its ``own``."""
    skipped = [*SKIP_DIRS, *SKIP_BUILD_DIRS, *own]
    parts = F.split("path", "/")
    return file.where(~F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: d.isin(*skipped)))


def structure_drift(file: DataFrame, since: Column, own: tuple[str, ...] = ()) -> DataFrame:
    """(model, changed): was any kept file created strictly after ``since``. Deletions are not seen."""
    return kept_files(file, own).groupBy("model").agg(F.bool_or(F.col("created") > since).alias("changed"))


def drift_report(source_map: DataFrame, file: DataFrame, node: DataFrame, since: Column, lock: DataFrame) -> DataFrame:
    """(model, id, structure_changed): drifted nodes and a row without id for the structure; nothing while a model is locked (model, locked)."""
    nodes = source_drift(source_map, file, node, since).select("model", "id", F.lit(None).cast("boolean").alias("structure_changed"))
    structure = structure_drift(file, since).select("model", F.lit("").alias("id"), F.col("changed").alias("structure_changed"))
    return nodes.unionByName(structure).join(lock.where("locked").select("model"), "model", "left_anti")


def drift_baseline(marker: DataFrame) -> DataFrame:
    """(model, baseline_ns): the marker's nanoseconds, else the legacy marker's time, else the model file's."""
    return marker.select("model", F.coalesce("baseline_ns", "legacy_mtime_ns", "model_mtime_ns").alias("baseline_ns"))


def directory_flags(file: DataFrame, annotated: Column) -> DataFrame:
    """(model, dir, annotated, files): a directory is annotated if any file below it is; the root is left out."""
    rows = file.withColumn("_a", annotated).select("model", "_a", F.explode(F.filter(directories(F.col("path")), lambda d: d != "")).alias("dir"))
    return rows.groupBy("model", F.expr("rtrim('/', dir)").alias("dir")).agg(F.bool_or("_a").alias("annotated"), F.count("*").alias("files"))
