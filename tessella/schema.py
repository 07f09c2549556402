"""Relations of an architecture model. Every relation has a ``model`` key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

NODE = (
    "model string, ord long, id string, parent_id string, node_type string, kind string, name string, description string, "
    "technology string, external boolean, shape string, status string, status_reason string, x double, y double"
)
EDGE = "model string, ord long, id string, source string, target string, label string, method string"
CONTRACT_ITEM = (
    "model string, owner_type string, owner_id string, section string, pos long, text string, passed boolean, url string, "
    "image struct<filename:string,mimeType:string,data:binary>"
)
NOTE = "model string, node_id string, pos long, text string"
PROPERTY = "model string, node_id string, pos long, label string, description string"
SOURCE_REF = "model string, node_id string, pos long, pattern string, comment string"
SOURCE_MAP = "model string, owner_id string, pos long, pattern string, line int, end_line int, command string"
GROUP = "model string, ord long, id string, name string, description string, parent_group_id string"
GROUP_MEMBER = "model string, group_id string, pos long, node_id string"
FLOW = "model string, ord long, id string, name string, description string"
FLOW_STEP = (
    "model string, flow_id string, step_id string, parent_step_id string, branch_idx int, pos long, condition string, "
    "description string, label string"
)
FILE = "model string, path string, mtime_ns long, created_ns long"

KINDS = ("person", "system", "container", "component", "operation", "process", "model")
CODE_KINDS = ("operation", "process", "model")
STATUSES = ("proposed", "implemented", "verified", "vagrant")
DONE = ("implemented", "verified", "vagrant")
SHAPES = ("person", "rectangle", "cylinder", "pipe", "trapezoid", "bucket", "hexagon")


@dataclass(frozen=True)
class Model:
    """The relations of one or many models."""

    node: DataFrame
    edge: DataFrame
    contract_item: DataFrame
    group: DataFrame
    group_member: DataFrame
    flow: DataFrame
    flow_step: DataFrame
    source_map: DataFrame
    file: DataFrame
