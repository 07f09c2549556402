"""Project scans that obey ignore files: a distributed walk, and the rules as a join of paths with their directories' files.

``.ignore`` files hold everywhere and come before ``.gitignore`` files, which
hold inside a repository (up to the next ``.git`` above a path), and these
before ``.git/info/exclude``. Of one kind a deeper file comes first, in a file
the last line that matches; ``!`` opens again, but nothing in a closed
directory. Hidden files are seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessella.lineage import cut
from tessella.operators.drift import SKIP_BUILD_DIRS, SKIP_DIRS, directories

# Files of rules, weakest first.
KINDS = (".git/info/exclude", ".gitignore", ".ignore")
_SPECIAL = set(".+()|^$\\{}[]*?")


def glob_to_regex(glob: str) -> str:
    """Java regular expression of an ignore glob, to be matched whole against a path below the rules' directory.

    ``*`` and ``?`` stay inside one name; ``**`` as a whole name stands for any
    number of names; classes, ``{a,b}`` and backslashes as usual.
    """
    quoted = lambda c: "\\" + c if c in _SPECIAL else c
    out, i, braces = [], 0, 0
    while i < len(glob):
        c, rest = glob[i], glob[i:]
        starts = i == 0 or glob[i - 1] == "/"
        if starts and rest.startswith("**/"):
            out.append("(?:.*/)?")
            i += 3
        elif starts and rest == "**":
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^")))) > 0:
            body = glob[i + 1 : end]
            no = body[0] in "!^"
            body = "".join("\\" + x if x in "\\[]^&~" else x for x in body[no:])
            out.append(f"(?!/)[{'^' if no else ''}{body}]")
            i = end + 1
        elif c == "{" and "}" in rest:
            out.append("(?:")
            braces += 1
            i += 1
        elif c == "," and braces:
            out.append("|")
            i += 1
        elif c == "}" and braces:
            out.append(")")
            braces -= 1
            i += 1
        elif c == "\\" and len(rest) > 1:
            out.append(quoted(rest[1]))
            i += 2
        else:
            out.append(quoted(c))
            i += 1
    return "^" + "".join(out) + "\\z"


@F.pandas_udf(StringType())
def _regex(globs: pd.Series) -> pd.Series:
    return globs.map(glob_to_regex, na_action="ignore")


def rules(text: DataFrame) -> DataFrame:
    """(model, dir, kind, ord, negated, dir_only, regex) from (model, dir, kind, text), a row for each file of rules.

    ``dir`` is the directory that the rules hold below: "" or with a closing
    slash; ``kind`` is the file's place in ``KINDS``.
    """
    line = F.when(F.endswith("line", F.lit("\\ ")), F.col("line")).otherwise(F.regexp_replace("line", "\\s+\\z", ""))
    lines = text.select("model", "dir", "kind", F.posexplode(F.split("text", "\r?\n")).alias("ord", "line")).withColumn("line", line)
    lines = lines.where("line <> '' AND NOT startswith(line, '#')")
    escaped = F.startswith("line", F.lit("\\!")) | F.startswith("line", F.lit("\\#"))
    negated = ~escaped & F.startswith("line", F.lit("!"))
    cut_line = lines.withColumn("negated", negated).withColumn("line", F.when(escaped | negated, F.substring("line", F.lit(2), F.length("line"))).otherwise(F.col("line")))
    told = cut_line.withColumn("rooted", F.startswith("line", F.lit("/"))).withColumn("line", F.when(F.col("rooted"), F.substring("line", F.lit(2), F.length("line"))).otherwise(F.col("line")))
    told = told.withColumn("dir_only", F.endswith("line", F.lit("/"))).withColumn("line", F.when(F.col("dir_only"), F.left("line", F.length("line") - 1)).otherwise(F.col("line"))).where("line <> ''")
    anywhere = ~F.col("rooted") & ~F.contains("line", F.lit("/"))
    glob = F.when(anywhere & ~F.startswith("line", F.lit("**/")), F.concat(F.lit("**/"), "line")).otherwise(F.col("line"))
    glob = F.when(F.endswith("line", F.lit("/**")), F.concat(glob, F.lit("/*"))).otherwise(glob)
    return told.select("model", "dir", "kind", "ord", "negated", "dir_only", _regex(glob).alias("regex"))


def _depth(folder: Column) -> Column:
    return F.size(F.split(folder, "/")) - 1


def verdicts(entry: DataFrame, rule: DataFrame) -> DataFrame:
    """(model, path, is_dir, ignored): is an entry named by the rules of the directories above it; closed directories are not looked at.

    ``entry`` has each directory and file once, ``.git`` included where there is one.
    """
    repository = entry.where("path = '.git' OR endswith(path, '/.git')").select("model", F.left("path", F.length("path") - 4).alias("dir"), F.lit(True).alias("_git"))
    above = entry.select("model", "path", "is_dir", F.explode(directories(F.col("path"))).alias("dir"))
    seen = above.join(repository.distinct(), ["model", "dir"], "left").join(rule, ["model", "dir"], "left")
    below = F.substring("path", F.length("dir") + 1, F.length("path"))
    fits = (F.col("is_dir") | ~F.col("dir_only")) & F.regexp_like(below, "regex")
    hit = F.struct("kind", _depth(F.col("dir")).alias("depth"), "ord", "negated")
    told = seen.groupBy("model", "path", "is_dir").agg(F.max(F.when(F.col("_git"), _depth(F.col("dir")))).alias("_root"), F.collect_list(F.when(fits, hit)).alias("_hits"))
    holds = lambda h: (h["kind"] == len(KINDS) - 1) | (F.col("_root").isNotNull() & (h["depth"] >= F.col("_root")))
    best = F.array_max(F.filter("_hits", holds))
    return told.select("model", "path", "is_dir", F.coalesce(~best["negated"], F.lit(False)).alias("ignored"))


def visible(entry: DataFrame, rule: DataFrame) -> DataFrame:
    """All columns of the entries that are not ignored and lie in no ignored directory."""
    judged = verdicts(entry.select("model", "path", "is_dir"), rule)
    closed = judged.where("ignored AND is_dir").select("model", F.concat("path", F.lit("/")).alias("dir"))
    inside = entry.select("model", "path", F.explode(directories(F.col("path"))).alias("dir")).join(closed, ["model", "dir"], "left_semi").select("model", "path")
    gone = inside.unionByName(judged.where("ignored").select("model", "path")).distinct()
    return entry.join(gone, ["model", "path"], "left_anti")


def _listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import os

    from pyarrow import fs

    for frame in frames:
        rows = []
        for model, root, folder in frame[["model", "root", "path"]].itertuples(index=False):
            store, base = fs.FileSystem.from_uri(root)
            for info in store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True)):
                linked = store.type_name == "local" and os.path.islink(info.path)
                if info.type == fs.FileType.File or (info.type == fs.FileType.Directory and not linked):
                    below = info.path[len(base.rstrip("/")) + 1 :]
                    rows.append((model, root, below, info.type == fs.FileType.Directory, info.mtime_ns))
        yield pd.DataFrame(rows, columns=["model", "root", "path", "is_dir", "mtime_ns"]).astype({"mtime_ns": "Int64"})


def walk(root: DataFrame, skip: tuple[str, ...] = (*SKIP_DIRS, *SKIP_BUILD_DIRS)) -> DataFrame:
    """(model, root, path, is_dir, mtime_ns): all entries below each (model, root), hidden ones too; links to directories are not followed.

    A round lists the directories of one depth, spread over tasks. ``root`` is
    a URI or an absolute path. Directories with a name in ``skip`` are entries,
    but are not walked into.
    """
    kind = "model string, root string, path string, is_dir boolean, mtime_ns long"
    level = cut(root.select("model", "root", F.lit("").alias("path")).repartition("model", "path").mapInPandas(_listed, kind))
    out = level
    while True:
        down = level.where("is_dir").where(~F.element_at(F.split("path", "/"), -1).isin(*skip))
        if down.isEmpty():
            return out
        level = cut(down.select("model", "root", "path").repartition("model", "path").mapInPandas(_listed, kind))
        out = out.unionByName(level)


def _texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for frame in frames:
        texts = []
        for root, path in zip(frame["root"], frame["path"], strict=True):
            store, base = fs.FileSystem.from_uri(root)
            try:
                with store.open_input_stream(f"{base}/{path}") as file:
                    texts.append(file.read().decode("utf-8", "replace"))
            except FileNotFoundError:
                texts.append(None)
        yield frame[["model", "dir", "kind"]].assign(text=texts)


def rule_files(entry: DataFrame) -> DataFrame:
    """(model, dir, kind, text) of the files of rules among the entries of ``walk``, and of the repositories' own."""
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.left("path", F.length("path") - F.length(name))
    kind = F.when(name == ".gitignore", 1).when(name == ".ignore", 2).when(F.col("is_dir") & (name == ".git"), 0)
    path = F.when(F.col("is_dir"), F.concat("path", F.lit("/info/exclude"))).otherwise(F.col("path"))
    found = entry.select("model", "root", path.alias("path"), folder.alias("dir"), kind.alias("kind"), "is_dir").where("kind IS NOT NULL AND is_dir = (kind = 0)")
    return found.drop("is_dir").mapInPandas(_texts, "model string, dir string, kind int, text string").where("text IS NOT NULL")


def scan(root: DataFrame) -> DataFrame:
    """(model, path, mtime_ns): the files of each (model, root) that the walk and the ignore files leave."""
    entry = walk(root)
    kept = visible(entry, rules(cut(rule_files(entry))))
    return kept.where("NOT is_dir").select("model", "path", "mtime_ns")
