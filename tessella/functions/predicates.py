"""Column predicates and labels. Java's ``$`` also matches before a final newline, hence ``\\z``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.schema import SHAPES, STATUSES


def is_identifier(name: Column) -> Column:
    return name.rlike("^[a-z][A-Za-z0-9_]*\\z")


def is_type_name(name: Column) -> Column:
    return name.rlike("^[A-Za-z][A-Za-z0-9_]*\\z")


def sanitized_identifier(name: Column) -> Column:
    """Illegal characters out, one leading non-letter out, first letter lower."""
    legal = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_]", ""), "^[^A-Za-z]", "")
    return F.concat(F.lower(F.substring(legal, 1, 1)), F.substring(legal, F.lit(2), F.length(legal)))


def sanitized_type_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_]", ""), "^[^A-Za-z]", "")


def parsed_kind(kind: Column) -> Column:
    """Known kinds; ``member`` is an alias of operation; anything else is an error."""
    known = ("person", "system", "container", "component", "operation", "process", "model")
    return F.when(kind == "member", "operation").when(kind.isin(*known), kind).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), kind)))


def parsed_status(status: Column) -> Column:
    return F.when(status.isin(*STATUSES), status)


def parsed_shape(shape: Column) -> Column:
    return F.when(shape.isin(*SHAPES), shape)


def status_label(status: Column) -> Column:
    return F.coalesce(status, F.lit("none"))


def shape_label(shape: Column) -> Column:
    return F.coalesce(shape, F.lit("default"))


def too_long(kind: Column, description: Column, technology: Column) -> Column:
    """Comma-joined names of fields over their limit in bytes; code-level kinds have no description limit."""
    code = kind.isin("operation", "process", "model")
    return F.concat_ws(
        ",",
        F.when(~code & (F.octet_length(description) > 200), "description"),
        F.when(F.octet_length(technology) > 28, "technology"),
    )


def label_too_long(label: Column) -> Column:
    return F.coalesce(F.octet_length(label) > 30, F.lit(False))


def is_vetoed(title: Column) -> Column:
    """Is the text after the last double underscore the planner's own tool."""
    return F.substring_index(title, "__", -1) == "get_task"


def model_ref(name: Column) -> Column:
    """(scope, key) of "project:<path>" or a global name."""
    project = F.startswith(name, F.lit("project:"))
    return F.struct(
        F.when(project, "project").otherwise("global").alias("scope"),
        F.when(project, F.substring(name, F.lit(9), F.length(name))).otherwise(name).alias("key"),
    )


def model_path(ref: Column, home: str, folder: str, ending: str) -> Column:
    """File of a model reference: ``model`` in the project's own ``folder``, or by its name in ``home``."""
    return F.when(ref["scope"] == "project", F.concat(ref["key"], F.lit(f"/{folder}/model{ending}"))).otherwise(F.concat(F.lit(home + "/"), ref["key"], F.lit(ending)))


def severity(code: Column) -> Column:
    return F.when(F.startswith(F.lower(code), F.lit("w")), "warning").otherwise("info")
