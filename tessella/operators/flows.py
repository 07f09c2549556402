"""Behavioural flows. Steps are adjacency rows: a step may hold branches, a branch holds steps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import closure

_SEP = "\x01"


def _keyed(step: DataFrame) -> DataFrame:
    """Steps with a key that is unique over flows."""
    return step.withColumn("id", F.concat_ws(_SEP, "flow_id", "step_id")).withColumn(
        "parent_id", F.when(F.col("parent_step_id").isNotNull(), F.concat_ws(_SEP, "flow_id", "parent_step_id"))
    )


def paths(step: DataFrame) -> DataFrame:
    """(model, flow_id, step_id, path): (branch, position, number) from the top step down to each step.

    ``number`` counts steps of one branch of one step from 1.
    """
    numbered = _keyed(step).withColumn(
        "number", F.row_number().over(Window.partitionBy("model", "flow_id", "parent_step_id", "branch_idx").orderBy("pos", "step_id"))
    )
    part = numbered.select("model", F.col("id").alias("ancestor"), F.coalesce("branch_idx", F.lit(-1)).alias("branch"), "pos", "number")
    chains = closure(numbered).join(part, ["model", "ancestor"]).groupBy("model", F.col("descendant").alias("id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), "branch", "pos", "number"))), lambda x: F.struct(x["branch"].alias("branch"), x["pos"].alias("pos"), x["number"].alias("number"))).alias("path")
    )
    return numbered.join(chains, ["model", "id"]).select("model", "flow_id", "step_id", "path")


def flatten(step: DataFrame) -> DataFrame:
    """(model, flow_id, step_id, depth, place): all steps in pre-order, nested ones included."""
    w = Window.partitionBy("model", "flow_id").orderBy("path", "step_id")
    return paths(step).select("model", "flow_id", "step_id", (F.size("path") - 1).alias("depth"), F.row_number().over(w).alias("place"))


def step_counts(step: DataFrame) -> DataFrame:
    return step.groupBy("model", "flow_id").agg(F.count("*").alias("steps"))


def outline(step: DataFrame) -> DataFrame:
    """(model, flow_id, step_id, label): 1, 2, 2a.1, 2b.1; numbers restart in each branch, a letter stands for the branch."""
    label = F.array_join(
        F.transform(
            "path",
            lambda x, i: F.when(i == 0, x["number"].cast("string")).otherwise(F.concat(F.char(F.lit(97) + x["branch"]), F.lit("."), x["number"].cast("string"))),
        ),
        "",
    )
    return paths(step).select("model", "flow_id", "step_id", label.alias("label"))


def labels_to_descriptions(step: DataFrame) -> DataFrame:
    """A label becomes the description where there is none, and is then cleared."""
    moves = F.col("description").isNull() & F.col("label").isNotNull()
    return step.withColumn("_moves", moves).withColumn("description", F.coalesce("description", "label")).withColumn(
        "label", F.when(~F.col("_moves"), F.col("label"))
    ).drop("_moves")


def siblings(step: DataFrame, a: str, b: str) -> DataFrame:
    """(model, flow_id, siblings): do two steps share their parent step and branch."""
    pair = step.where(F.col("step_id").isin(a, b)).groupBy("model", "flow_id").agg(
        F.count("*").alias("n"), F.count_distinct(F.struct(F.coalesce("parent_step_id", F.lit("")), F.coalesce("branch_idx", F.lit(-1)))).alias("places")
    )
    return pair.select("model", "flow_id", ((F.col("n") == 2) & (F.col("places") == 1)).alias("siblings"))


def move_step(step: DataFrame, flow_id: str, step_id: str, place: int) -> DataFrame:
    """Put a step at another place (from 0) among its siblings; positions are numbered anew."""
    home = step.where((F.col("flow_id") == flow_id) & (F.col("step_id") == step_id)).select(
        "model", "flow_id", F.col("parent_step_id").alias("_p"), F.col("branch_idx").alias("_b")
    )
    near = F.col("parent_step_id").eqNullSafe(F.col("_p")) & F.col("branch_idx").eqNullSafe(F.col("_b"))
    rows = step.join(home, ["model", "flow_id"], "left").withColumn("_near", F.coalesce((F.col("flow_id") == flow_id) & near, F.lit(False)))
    others = Window.partitionBy("model", "flow_id", "_near", F.col("step_id") == step_id).orderBy("pos", "step_id")
    rank = F.row_number().over(others) - 1
    fresh = F.when(F.col("step_id") == step_id, F.lit(place)).otherwise(rank + F.when(rank >= place, 1).otherwise(0))
    return rows.withColumn("_fresh", fresh).withColumn("pos", F.when(F.col("_near"), F.col("_fresh").cast("long")).otherwise(F.col("pos"))).select(*step.columns)


def update_steps(step: DataFrame, change: DataFrame) -> DataFrame:
    """Steps at any depth with new values: ``change`` has (model, flow_id, step_id) once each and the columns to set, null included.

    Changes of unknown steps do nothing; other columns, places and nested steps stay.
    """
    keys = ["model", "flow_id", "step_id"]
    fields = [c for c in change.columns if c not in keys]
    known = change.select(*keys, *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_set"))
    rows = step.join(known, keys, "left")
    return rows.select(*[F.when(F.col("_set"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in step.columns])


def delete_step(step: DataFrame, flow_id: str, step_id: str) -> DataFrame:
    """Without a step and all steps nested in it."""
    inside = closure(_keyed(step)).where(F.col("ancestor") == f"{flow_id}{_SEP}{step_id}").select("model", F.col("descendant").alias("_id"))
    return step.withColumn("_id", F.concat_ws(_SEP, "flow_id", "step_id")).join(inside, ["model", "_id"], "left_anti").select(*step.columns)


def flatten_branch(step: DataFrame, flow_id: str, step_id: str, branch: int) -> DataFrame:
    """The steps of one branch move up behind the step that held it; later siblings move back."""
    here = (F.col("flow_id") == flow_id) & (F.col("parent_step_id") == step_id) & (F.col("branch_idx") == branch)
    moved = F.coalesce(here, F.lit(False))
    host = step.where((F.col("flow_id") == flow_id) & (F.col("step_id") == step_id)).select(
        "model", "flow_id", F.col("parent_step_id").alias("_p"), F.col("branch_idx").alias("_b"), F.col("pos").alias("_at")
    )
    count = step.where(moved).groupBy("model", "flow_id").agg(F.count("*").alias("_n"))
    rows = step.withColumn("_moved", moved).join(host, ["model", "flow_id"], "left").join(count, ["model", "flow_id"], "left")
    near = F.col("parent_step_id").eqNullSafe(F.col("_p")) & F.col("branch_idx").eqNullSafe(F.col("_b")) & F.col("_at").isNotNull() & ~F.col("_moved")
    order = F.row_number().over(Window.partitionBy("model", "flow_id", "_moved").orderBy("pos", "step_id"))
    pos = F.when(F.col("_moved"), F.col("_at") + order).when(near & (F.col("pos") > F.col("_at")), F.col("pos") + F.coalesce("_n", F.lit(0))).otherwise(F.col("pos"))
    return (
        rows.withColumn("_pos", pos)
        .withColumn("parent_step_id", F.when(F.col("_moved"), F.col("_p")).otherwise(F.col("parent_step_id")))
        .withColumn("branch_idx", F.when(F.col("_moved"), F.col("_b")).otherwise(F.col("branch_idx")))
        .withColumn("pos", F.col("_pos").cast("long"))
        .select(*step.columns)
    )


def duplicate_steps(step: DataFrame) -> DataFrame:
    """(model, flow_id, step_id) of step ids that a flow has more than once."""
    return step.groupBy("model", "flow_id", "step_id").agg(F.count("*").alias("n")).where("n > 1").drop("n")


def topological(step: DataFrame, transition: DataFrame) -> DataFrame:
    """(model, flow_id, step_id, place): first-in-first-out order of steps along transitions, cycles last in their own order.

    The order inside one flow is sequential, so each flow is one group.
    """
    rows = step.select("model", "flow_id", "step_id", "pos", F.lit(None).cast("string").alias("target")).unionByName(
        transition.select("model", "flow_id", F.col("source").alias("step_id"), "pos", "target")
    )

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "step_id"], kind="stable")
        ids = list(dict.fromkeys(pdf.loc[pdf.target.isna(), "step_id"]))
        after: dict[str, list[str]] = {i: [] for i in ids}
        waits = dict.fromkeys(ids, 0)
        for a, b in pdf.loc[pdf.target.notna(), ["step_id", "target"]].itertuples(index=False):
            if a in after and b in waits:
                after[a].append(b)
                waits[b] += 1
        done = [i for i in ids if not waits[i]]
        for i in done:
            for b in after[i]:
                waits[b] -= 1
                if not waits[b]:
                    done.append(b)
        placed = set(done)
        done += [i for i in ids if i not in placed]
        return pd.DataFrame({"model": pdf.model.iloc[0], "flow_id": pdf.flow_id.iloc[0], "step_id": done, "place": range(len(done))})

    return rows.groupBy("model", "flow_id").applyInPandas(order, "model string, flow_id string, step_id string, place long")
