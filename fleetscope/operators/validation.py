"""Structural validation of launch programs: every rule gives (ld_id, severity, rule, message, action_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tree

ID_PATTERN = r"^la:[a-zA-Z0-9_]+:[0-9a-f]{8}#[0-9]+$"
SCOPES = ("push_namespace", "group", "include")


def _errors(rows: DataFrame, rule: str, message: Column, severity: str = "error", action: str = "action_id") -> DataFrame:
    return rows.select("ld_id", F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), message.alias("message"), F.col(action).cast("string").alias("action_id"))


def map_consistency(actions: DataFrame) -> DataFrame:
    return _errors(actions.where("map_key <> action_id"), "actions_map_consistency", F.format_string("key %s holds %s", "map_key", "action_id"))


def sequence_validity(sequence: DataFrame, actions: DataFrame) -> DataFrame:
    gone = sequence.join(actions.select("ld_id", "action_id"), ["ld_id", "action_id"], "left_anti")
    return _errors(gone, "sequence_validity", F.format_string("the sequence names %s, which does not exist", "action_id"))


def walked(sequence: DataFrame, edges: DataFrame) -> DataFrame:
    """What the sequence leads to: one walk that three rules share."""
    return tree.reachable(sequence.select("ld_id", F.col("action_id").alias("id")), edges)


def no_orphans(actions: DataFrame, sequence: DataFrame, edges: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    items = actions.select("ld_id", F.col("action_id").alias("id"))
    lost = tree.orphans(items, sequence.select("ld_id", F.col("action_id").alias("id")), edges, reached)
    return _errors(lost, "no_orphans", F.format_string("%s cannot be reached", "id"), "warning", "id")


def reachability(sequence: DataFrame, edges: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """Sequence ids that are not reached from the sequence: none, by construction; kept so that a report names every rule."""
    ids = sequence.select("ld_id", F.col("action_id").alias("id"))
    reached = walked(sequence, edges) if reached is None else reached
    missed = ids.join(reached.select("ld_id", "id"), ["ld_id", "id"], "left_anti")
    return _errors(missed, "reachability", F.lit("unreachable"), action="id")


def id_format(actions: DataFrame, column: str = "action_id") -> DataFrame:
    return _errors(actions.where(~F.col(column).rlike(ID_PATTERN)), "id_format", F.format_string("%s is no valid id", column), action=column)


def no_cycles(sequence: DataFrame, edges: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """Every action of the sequence's trees that reaches itself, once each, whatever order a walk would take."""
    found = tree.cycles(edges, reached=walked(sequence, edges) if reached is None else reached)
    return _errors(found, "no_cycles", F.format_string("%s lies on a cycle", "id"), action="id")


def scope_actions_only(actions: DataFrame, edges: DataFrame) -> DataFrame:
    owners = edges.select("ld_id", F.col("parent").alias("action_id")).distinct()
    wrong = actions.where(~F.col("action_type").isin(*SCOPES)).join(owners, ["ld_id", "action_id"], "left_semi")
    return _errors(wrong, "scope_actions_only", F.format_string("%s has children", "action_type"))


def node_required_fields(actions: DataFrame) -> DataFrame:
    return _errors(actions.where("action_type = 'node' AND (package IS NULL OR executable IS NULL)"), "node_required_fields", F.lit("a node needs package and executable"))


def include_required_fields(actions: DataFrame) -> DataFrame:
    return _errors(actions.where("action_type = 'include' AND (included_launch_id IS NULL OR included_launch_id = '')"), "include_required_fields", F.lit("an include needs a target"))


def validate(actions: DataFrame, sequence: DataFrame, edges: DataFrame) -> DataFrame:
    """All nine rules as one union; the tree is walked once."""
    reached = walked(sequence, edges)
    parts = [
        map_consistency(actions), sequence_validity(sequence, actions), reachability(sequence, edges, reached), no_orphans(actions, sequence, edges, reached), id_format(actions), no_cycles(sequence, edges, reached),
        scope_actions_only(actions, edges), node_required_fields(actions), include_required_fields(actions),
    ]
    return reduce(DataFrame.unionByName, parts)
