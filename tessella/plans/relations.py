"""Fixture relations under the names that the operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.fixtures import Fixture


def node(f: Fixture) -> DataFrame:
    """One DataFrame for each fixture, so that operators share its closure."""
    if "node" not in f._known:
        f._known["node"] = f["nodes"].withColumnRenamed("ext", "external")
    return f._known["node"]


def described(f: Fixture) -> DataFrame:
    return node(f).join(f["descr"].drop("model"), "id", "left")


def edge(f: Fixture) -> DataFrame:
    return f["edges"]


def note(f: Fixture) -> DataFrame:
    """A note on every system and container, and two on components that have a status."""
    return node(f).where("kind IN ('system', 'container') OR (kind = 'component' AND status IS NOT NULL)").select(
        "model",
        F.col("id").alias("node_id"),
        F.explode(F.when(F.col("kind") == "component", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("pos"),
        F.concat(F.lit("note on "), "name").alias("text"),
    )
