"""The issue catalogue: a small dimension table, and issues rendered from rule rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetscope.functions import text as T

COLUMNS = "issue_key string, enabled boolean, severity string, category string, title string, description string, recommendation string, entity_type string"

#: key: (enabled, severity, category, title, description, recommendation, entity type)
CATALOG = {
    "node_no_name": (True, "info", "architecture", "Unnamed node", "Node '{executable}' of package {package} has no name and takes that of its executable.", "Give the node a name if other parts refer to it.", "node"),
    "node_runtime_condition": (True, "info", "architecture", "Node under a runtime condition", "Node '{executable}' only starts if '{condition}' holds.", "Check the condition in a concrete configuration.", "node"),
    "opaque_symbolic_node": (True, "warning", "architecture", "Node from a loop", "Node '{executable}' comes from a loop whose bounds are known at runtime only.", "Annotate how many instances there are.", "node"),
    "include_unresolved": (True, "warning", "architecture", "Dynamic include path", "The included file is known at runtime only.", "Resolve the path for a concrete configuration.", "include"),
    "include_self": (True, "error", "architecture", "File includes itself", "The launch description includes itself.", "Break the cycle.", "include"),
    "arg_no_default": (True, "warning", "standards_compliance", "Argument without default", "Argument '{arg_name}' must always be given.", "Add a default value where a safe one exists.", "arg"),
    "arg_orphan": (True, "info", "architecture", "Argument out of reach", "Argument '{arg_name}' is declared but not added to the description.", "Add it, or remove the declaration.", "arg"),
    "namespace_implicit": (True, "info", "architecture", "Inherited namespace", "Node '{executable}' takes its namespace from its surroundings.", "State the namespace unless that is meant.", "node"),
    "action_without_provenance": (True, "warning", "architecture", "Action of unknown origin", "Action '{action_id}' has no source location.", "Keep source locations when exporting.", "launch_action"),
    "node_without_remappings": (False, "info", "architecture", "No remappings", "Node '{executable}' of package {package} renames no topic.", "Nothing, unless topics should be renamed here.", "node"),
    "isolated_node": (True, "warning", "communication", "Isolated node", "Node '{runtime_name}' neither publishes nor subscribes.", "Check whether its annotation is complete.", "runtime_node"),
    "publisher_without_subscriber": (True, "warning", "communication", "Nobody listens", "Nothing subscribes to '{topic_name}', which '{runtime_name}' publishes.", "Check whether a subscriber lacks its annotation.", "publication"),
    "subscriber_without_publisher": (True, "warning", "communication", "Nobody speaks", "Nothing publishes '{topic_name}', to which '{runtime_name}' subscribes.", "Check whether a publisher lacks its annotation.", "subscription"),
    "topic_multiple_publishers": (True, "warning", "communication", "Several publishers", "Topic '{topic_name}' has {publisher_count} publishers: {publishers}.", "Check that they are meant to share the topic.", "topic"),
    "qos_reliability_mismatch": (True, "error", "communication", "Reliability mismatch", "On '{topic_name}', '{publisher_node}' offers {publisher_reliability} and '{subscriber_node}' needs {subscriber_reliability}.", "Align the two.", "topic"),
    "message_type_mismatch": (True, "critical", "communication", "Message type mismatch", "On '{topic_name}', '{publisher_node}' sends {publisher_msg_type} and '{subscriber_node}' expects {subscriber_msg_type}.", "Correct a type or separate the topics.", "topic"),
}


def load_catalog(spark: SparkSession, entries: dict[str, tuple] | None = None, strict: bool = True) -> DataFrame:
    """The catalogue as a table. strict: an entry of another length is an error; else it is left out."""
    rows = []
    for key, entry in (CATALOG if entries is None else entries).items():
        if len(entry) != 7:
            if strict:
                raise ValueError(f"catalogue entry {key} is incomplete")
            continue
        rows.append((key, *entry))
    return spark.createDataFrame(rows, COLUMNS)


FIELDS = ("enabled", "severity", "category", "title", "description", "recommendation", "entity_type")


def read_catalog(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A catalogue file: a mapping ``issues`` of key to fields. strict: a missing field is an error; else it takes an empty default."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]  # one small file
    entries = (yaml.safe_load(text) or {}).get("issues") or {}
    rows: dict[str, tuple] = {}
    for key, e in entries.items():
        missing = [f for f in FIELDS if f not in e]
        if missing and strict:
            raise ValueError(f"catalogue entry {key} lacks {missing}")
        rows[key] = tuple(bool(e.get(f, True)) if f == "enabled" else str(e.get(f) or "") for f in FIELDS)
    return load_catalog(spark, rows) if rows else spark.createDataFrame([], COLUMNS)


def issues(candidates: DataFrame, catalog: DataFrame, id_of: Column, context: dict[str, Column], order: list[str], partition: list[str], strict: bool = True, timestamp: str | None = None, tool: str = "fleetscope", beside: tuple[str, ...] = ()) -> DataFrame:
    """Numbered and rendered issues.

    ``candidates`` has issue_key and entity_id beside what ``context`` reads. Numbers run over all candidates of a partition, so a
    disabled rule still uses numbers up; only then the catalogue is joined and disabled rules go. The timestamp is a parameter.
    Columns of ``candidates`` named in ``beside`` come along.
    """
    n = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    known = catalog.where("enabled").select("issue_key", F.struct("severity", "category", "title", "description", "recommendation", "entity_type").alias("_c"))  # rows may have columns of these names
    rows = candidates.withColumn("_n", n).join(F.broadcast(known), "issue_key")
    render = T.render_strict if strict else T.render_lenient
    return rows.select(
        F.concat(id_of, T.numbered(F.col("_n"))).alias("issue_id"), "issue_key", "_c.severity", "_c.category", render(F.col("_c.description"), context).alias("description"), "_c.entity_type", "entity_id",
        F.lit(tool).alias("analysis_tool"), F.lit(timestamp).cast("string").alias("analysis_timestamp"),
        F.create_map(F.lit("title"), F.col("_c.title"), F.lit("recommendation"), F.col("_c.recommendation")).alias("metadata"), *beside,
    )
