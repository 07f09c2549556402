"""Text functions over columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File names and endings of each category, in the order in which they are tried.
MANIFEST_NAMES = (
    "package.json", "Cargo.toml", "go.mod", "pyproject.toml", "setup.py", "setup.cfg", "pom.xml", "build.gradle", "build.gradle.kts", "Gemfile",
    "composer.json", "mix.exs", "pubspec.yaml", "Package.swift", "Makefile", "CMakeLists.txt", "deno.json", "deno.jsonc", "bun.lock", "flake.nix",
)
MANIFEST_ENDS = (".csproj", ".fsproj", ".sln")
INFRA_NAMES = (
    "fly.toml", "Procfile", "vercel.json", "netlify.toml", "render.yaml", "railway.json", "app.yaml", "Jenkinsfile", "shell.nix",
    "docker-compose.yml", "docker-compose.yaml", "serverless.yml", "serverless.yaml", "skaffold.yaml",
    "template.yaml", "template.yml", "sam.yaml", "sam.yml", "deploy.yml", "deploy.yaml", ".gitlab-ci.yml",
)
INFRA_DIRS = ("k8s/", "kubernetes/", "deploy/", "infra/", ".github/workflows/")
ENVIRONMENT_NAMES = (".env.example", ".env.sample", ".env.template")


def file_category(name: Column, path: Column) -> Column:
    """manifest, infrastructure, environment or null; the first rule that fits decides."""
    yaml = F.endswith(name, F.lit(".yml")) | F.endswith(name, F.lit(".yaml"))
    in_dir = F.lit(False)
    for d in INFRA_DIRS:
        in_dir = in_dir | F.startswith(path, F.lit(d))
    ends = F.lit(False)
    for e in MANIFEST_ENDS:
        ends = ends | F.endswith(name, F.lit(e))
    infra = (
        name.isin(*INFRA_NAMES)
        | F.startswith(name, F.lit("Dockerfile"))
        | (F.startswith(name, F.lit("docker-compose")) & yaml)
        | F.endswith(name, F.lit(".tf"))
        | F.endswith(name, F.lit(".tfvars"))
        | ((name == "config.yml") & F.startswith(path, F.lit(".circleci/")))
        | (in_dir & yaml)
    )
    return F.when(name.isin(*MANIFEST_NAMES) | ends, "manifest").when(infra, "infrastructure").when(name.isin(*ENVIRONMENT_NAMES), "environment")


def has_bullets(text: Column) -> Column:
    """Does any line start with a dash or star and white space, after leading blanks."""
    return F.exists(F.split(text, "\n"), lambda line: F.ltrim(line).rlike("^[-*]\\s"))


def truncated(text: Column, limit: int = 80, keep: int = 77, end: str = "...") -> Column:
    """Texts of more than ``limit`` bytes cut to ``keep`` characters, never inside a character."""
    return F.when(F.octet_length(text) > limit, F.concat(F.substring(text, 1, keep), F.lit(end))).otherwise(text)


def elapsed(seconds: Column) -> Column:
    """12s, 3m 4s."""
    s = F.floor(seconds)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))


def contract_item(v: Column) -> Column:
    """(text, passed, url, image) of a contract item that is a string or an object."""
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    return F.struct(
        F.coalesce(get("$.text", "string"), get("$", "string")).alias("text"),
        get("$.passed", "boolean").alias("passed"),
        get("$.url", "string").alias("url"),
        get("$.image.filename", "string").alias("image"),
    )


def contract_line(item: Column) -> Column:
    """A contract item as one line."""
    mark = F.when(item["passed"].isNull(), "").when(item["passed"], "[x] ").otherwise("[ ] ")
    url = F.when(item["url"].isNotNull(), F.concat(F.lit(" ("), item["url"], F.lit(")"))).otherwise("")
    image = F.when(item["image"].isNotNull(), F.concat(F.lit(" [image: "), item["image"], F.lit("]"))).otherwise("")
    return F.concat(mark, item["text"], url, image)


def contract_block(name: Column, expect: Column, ask: Column, never: Column, notes: Column) -> Column:
    """Contract sections and notes of a node as indented text; empty parts are left out."""

    def section(title: str, items: Column) -> Column:
        lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("    - "), x, F.lit("\n"))), "")
        return F.when(F.size(items) > 0, F.concat(F.lit(f"  {title}:\n"), lines)).otherwise("")

    body = F.concat(section("MUST", expect), section("ASK USER FIRST", ask), section("NEVER", never))
    head = F.when(body != "", F.concat(F.lit("\n"), name, F.lit(" — Contract (MUST follow):\n"), body)).otherwise("")
    listed = F.array_join(F.transform(notes, lambda x: F.concat(F.lit("  - "), x, F.lit("\n"))), "")
    return F.concat(head, F.when(F.size(notes) > 0, F.concat(F.lit("\n"), name, F.lit(" — Notes:\n"), listed)).otherwise(""))


def node_lines(node: DataFrame) -> DataFrame:
    """(model, ord, line): one line of diagram text for every node."""
    outside = F.coalesce("external", F.lit(False))
    mark = (
        F.when(F.col("kind") == "person", "[P]")
        .when((F.col("kind") == "system") & outside, "[S!]")
        .when(F.col("kind") == "system", "[S]")
        .when(F.col("kind") == "container", "[C]")
        .when(F.col("kind") == "component", "[K]")
        .when(F.col("kind") == "operation", "[M]")
        .when(F.col("kind") == "process", "[Pr]")
        .otherwise("[Md]")
    )
    above = node.select("model", F.col("id").alias("parent_id"), F.col("name").alias("_above"))
    rows = node.join(above, ["model", "parent_id"], "left")
    some = lambda c, head, tail="": F.when(c.isNotNull() & (c != ""), F.concat(F.lit(head), c, F.lit(tail))).otherwise("")
    line = F.concat(
        mark, F.lit(" "), "id", F.lit(' "'), "name", F.lit('" ('), "kind",
        F.when(outside, ",external").otherwise(""),
        F.when(F.col("parent_id").isNotNull(), F.concat(F.lit(",parent="), F.coalesce("_above", "parent_id"))).otherwise(""),
        F.lit(")"),
        some(F.col("technology"), " tech=") if "technology" in node.columns else F.lit(""),
        some(F.col("status"), " status="),
        some(truncated(F.col("description"), 80, 80), ' | "', '"') if "description" in node.columns else F.lit(""),
    )
    return rows.select("model", "ord", line.alias("line"))


def edge_lines(edge: DataFrame, node: DataFrame) -> DataFrame:
    """(model, id, line): one line of diagram text for every edge; without a label it says "uses"."""
    name = lambda end: node.select("model", F.col("id").alias(end), F.col("name").alias(f"_{end}"))
    rows = edge.join(name("source"), ["model", "source"], "left").join(name("target"), ["model", "target"], "left")
    method = F.coalesce(F.concat(F.lit("/"), F.col("method")), F.lit("")) if "method" in edge.columns else F.lit("")
    shown = lambda end: F.concat(F.col(end), F.lit(' "'), F.coalesce(f"_{end}", end), F.lit('"'))
    return rows.select("model", "id", F.concat(shown("source"), F.lit(" --["), F.coalesce("label", F.lit("uses")), method, F.lit("]--> "), shown("target")).alias("line"))


def event_summary(line: Column) -> Column:
    """A one-line summary of an event line in JSON, null where there is nothing to say. Cut after 120 characters."""
    v = F.try_parse_json(line)
    get = lambda path: F.try_variant_get(v, path, "string")
    kind = get("$.type")
    blocks = F.from_json(F.to_json(F.try_variant_get(v, "$.message.content", "variant")), "array<struct<type:string,name:string,text:string>>")
    first = lambda text: F.trim(F.element_at(F.split(F.trim(text), "\n"), 1))
    said = F.filter(
        F.transform(
            blocks,
            lambda b: F.when(b["type"] == "tool_use", F.concat(F.lit("-> "), b["name"])).when(
                (b["type"] == "text") & (first(b["text"]) != ""),
                F.when(F.octet_length(first(b["text"])) > 120, F.concat(F.substring(first(b["text"]), 1, 120), F.lit("…"))).otherwise(first(b["text"])),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    return (
        F.when(kind == "assistant", F.get(said, 0))
        .when(kind.isin("tool_result", "tool_use"), F.concat(F.lit("-> "), F.coalesce(get("$.name"), F.lit("tool"))))
        .when(kind == "result", F.concat(F.lit("Done ("), F.coalesce(get("$.subtype"), F.lit("")), F.lit(")")))
    )


def salvaged_array(df: DataFrame, column: str) -> DataFrame:
    """(all columns but ``column``, item): objects of the JSON array between the first ``[`` and the last ``]``.

    Where the array does not parse, balanced ``{...}`` pieces are taken one by
    one, without regard to quotes. Brace counting is sequential per text, hence
    a batched Python function; whole arrays go through the JSON parser only.
    """
    rest = [c for c in df.columns if c != column]
    body = F.regexp_extract(F.col(column), "(?s)(\\[.*\\])", 1)
    parsed = df.withColumn("_body", body).withColumn("_items", F.from_json("_body", "array<string>"))

    @F.pandas_udf("array<string>")
    def objects(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def cut(text: str | None) -> list[str]:
            out, depth, start = [], 0, 0
            for i, c in enumerate(text or ""):
                if c == "{":
                    start = start if depth else i
                    depth += 1
                elif c == "}" and depth:
                    depth -= 1
                    if not depth:
                        out.append(text[start : i + 1])
            return out

        for batch in texts:
            yield batch.map(cut)

    whole = F.try_parse_json("_body").isNotNull()
    return parsed.withColumn("_found", F.when(whole, F.col("_items")).otherwise(objects(F.col("_body")))).select(*rest, F.explode("_found").alias("item")).where(
        F.try_parse_json("item").isNotNull()
    )


def ranked_matches(names: DataFrame, query: str) -> DataFrame:
    """Names that contain the query, any case: those that start with it first, then by name."""
    low, q = F.lower("name"), query.lower()
    return names.where(F.contains(low, F.lit(q))).withColumn("starts", F.startswith(low, F.lit(q)))


def compact(node: DataFrame, left_out: tuple[str, ...] = ("x", "y", "node_type", "notes")) -> DataFrame:
    """(model, text): each node as JSON without positions and notes, and without fields that are null, empty strings, empty arrays or empty maps.

    Only a field itself is tested: a struct all of whose fields fall away stays, as an empty object.
    """

    def some(field) -> Column:
        c = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        empty = c == "" if kind == "string" else F.size(c) == 0 if kind in ("array", "map") else F.lit(False)
        return F.when(~F.coalesce(empty, F.lit(False)), c).alias(field.name)

    fields = [some(f) for f in node.schema.fields if f.name not in ("model", *left_out)]
    return node.select("model", F.to_json(F.struct(*fields)).alias("text"))
