"""Structural rules over actions(ld_id, file_id, pos, action_id, action_type, name, package, executable, namespace, default_value, confidence, cond, included_launch_id, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import text as T

IDS = ("ld_id", "pos", "action_id")


def node_no_name(actions: DataFrame) -> DataFrame:
    """Pseudo-nodes of plain processes count too."""
    return actions.where("action_type = 'node' AND name IS NULL")


def _condition_rule(actions: DataFrame) -> DataFrame:
    """The first rule that a condition's text meets wins."""
    text = F.col("cond")
    if "conditions" in actions.columns:  # one row a condition
        actions = actions.withColumn("cond", F.explode_outer("conditions"))
    rule = F.when(text.contains("has_resource"), "node_runtime_condition").when(text.contains("for") & text.contains("range"), "opaque_symbolic_node")
    return actions.where("action_type = 'node' AND cond IS NOT NULL").withColumn("rule", rule)


def node_runtime_condition(actions: DataFrame) -> DataFrame:
    return _condition_rule(actions).where("rule = 'node_runtime_condition'").drop("rule")


def opaque_symbolic_node(actions: DataFrame) -> DataFrame:
    return _condition_rule(actions).where("rule = 'opaque_symbolic_node'").drop("rule")


def include_unresolved(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("action_type") == "include").where(T.unresolved_include(F.col("included_launch_id")))


def include_self(actions: DataFrame) -> DataFrame:
    """The target is the description's own id, or the one that its file gives."""
    return actions.where("action_type = 'include' AND included_launch_id IN (CAST(ld_id AS STRING), concat('launch_desc_', file_id))")


def arg_no_default(actions: DataFrame) -> DataFrame:
    return actions.where("action_type = 'declare_argument' AND default_value IS NULL")


def arg_orphan(actions: DataFrame) -> DataFrame:
    return actions.where("action_type = 'declare_argument' AND confidence < 0.9")


def namespace_implicit(actions: DataFrame) -> DataFrame:
    """Nodes without namespace and condition in descriptions that push one anywhere."""
    pushing = actions.where("action_type = 'push_namespace'").select("ld_id").distinct()
    return actions.where("action_type = 'node' AND namespace IS NULL AND cond IS NULL").join(pushing, "ld_id", "left_semi")


RULES = {f.__name__: f for f in (node_no_name, node_runtime_condition, opaque_symbolic_node, include_unresolved, include_self, arg_no_default, arg_orphan, namespace_implicit)}
#: Rules whose issues are numbered together.
FAMILY = {"include_unresolved": "inc_", "include_self": "inc_", "arg_no_default": "arg_", "arg_orphan": "arg_", "namespace_implicit": "ns_"}


def candidates(actions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The bag union of the rules' rows, with issue_key, family and entity_id."""
    parts = [RULES[k](actions).withColumn("issue_key", F.lit(k)).withColumn("family", F.lit(FAMILY.get(k, ""))) for k in keys or RULES]
    return reduce(DataFrame.unionByName, parts).withColumn("entity_id", F.col("action_id"))


#: What descriptions may refer to: key and column.
CONTEXT = {"executable": "executable", "package": "package", "condition": "cond", "arg_name": "name", "action_id": "action_id", "included_id": "included_launch_id"}


def detect(actions: DataFrame, catalog: DataFrame | None = None, timestamp: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Issues of all rules, numbered by file and family, with the description and source file of what they are about."""
    from . import catalog as C

    rows = candidates(actions, keys).withColumn("location", F.col("source_file"))
    known = catalog if catalog is not None else C.load_catalog(actions.sparkSession)
    return C.issues(rows, known, F.concat(F.lit("issue_"), "file_id", F.lit("_"), "family"), {k: F.col(c) for k, c in CONTEXT.items()}, ["pos", "issue_key"], ["file_id", "family"], timestamp=timestamp, beside=("ld_id", "location"))


# Rules as conjunctive queries over exported triples state them; on entity tables each is one scan.


def query_node_no_name(actions: DataFrame) -> DataFrame:
    """Without pseudo-nodes; package and executable must be known."""
    return actions.where("action_type = 'node' AND name IS NULL AND package IS NOT NULL AND executable IS NOT NULL AND package <> '__executable__'")


def query_action_without_provenance(actions: DataFrame) -> DataFrame:
    return actions.where("source_file IS NULL")


def query_node_without_remappings(actions: DataFrame) -> DataFrame:
    return actions.where("action_type = 'node' AND n_remappings = 0")
