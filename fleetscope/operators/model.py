"""Assembly of the model document: packages, main packages, execution configurations, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def packages(actions: DataFrame) -> DataFrame:
    """Each package's distinct executables, sorted, and its launch files; plain processes have a package of their own."""
    nodes = actions.where("action_type = 'node' AND package <> ''")
    return nodes.groupBy("package").agg(F.array_join(F.sort_array(F.collect_set("executable")), ",").alias("executables"), F.countDistinct("file_id").alias("files"))


def main_package(actions: DataFrame) -> DataFrame:
    """Each description's package of most distinct executables; of equals the one seen first. Two combinable aggregates, no window."""
    each = actions.where("action_type = 'node'").groupBy("ld_id", "package").agg(F.countDistinct("executable").alias("n"), F.min("pos").alias("first"))
    best = each.groupBy("ld_id").agg(F.max(F.struct("n", (-F.col("first")).alias("early"), "package")).alias("best"))
    return best.select("ld_id", F.col("best.package").alias("package"), F.col("best.n").alias("executables"))


def exec_configs(descriptions: DataFrame) -> DataFrame:
    """A number for each description of a workspace(workspace, ld_id), in order of its id."""
    n = F.row_number().over(Window.partitionBy("workspace").orderBy("ld_id"))
    return descriptions.select("workspace", "ld_id", F.concat(F.lit("exec_config_"), n.cast("string")).alias("config_id"))


def counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("ld_id").agg(
        F.count_if((F.col("action_type") == "node") & ~F.col("package").eqNullSafe(F.lit("__executable__"))).alias("nodes"), F.count_if(F.col("action_type") == "declare_argument").alias("args"), F.count_if(F.col("action_type") == "include").alias("includes"), F.count(F.lit(1)).alias("total")
    )


def document(actions: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """One JSON document a description, with its main package, counts and nodes; arrays are ordered by position."""
    nodes = actions.where("action_type = 'node'").groupBy("ld_id").agg(F.sort_array(F.collect_list(F.struct("pos", "action_id", "package", "executable", "name"))).alias("nodes"))
    out = counts(actions).select("ld_id", F.struct("nodes", "args", "includes", "total").alias("counts")).join(main_package(actions).select("ld_id", F.col("package").alias("main_package")), "ld_id", "left").join(nodes, "ld_id", "left")
    if issues is not None:
        out = out.join(issues.groupBy("ld_id").agg(F.sort_array(F.collect_list(F.struct("issue_id", "issue_key", "severity", "description"))).alias("issues")), "ld_id", "left")
    return out.select("ld_id", F.to_json(F.struct(*[c for c in out.columns])).alias("document"))


def lines(actions: DataFrame) -> DataFrame:
    """(ld_id, pos, depth, line): one readable line an action."""
    from fleetscope.functions import text as T

    part = lambda before, c, after="": F.coalesce(F.concat(F.lit(before), F.col(c), F.lit(after)), F.lit(""))
    node = F.concat(F.lit("NODE      "), F.coalesce("package", F.lit("?")), F.lit(" / "), F.coalesce("executable", F.lit("?")), part("   [", "name", "]"), part("   ns=", "namespace"))
    title = (
        F.when(F.col("package").eqNullSafe(F.lit("__executable__")), F.concat(F.lit("PROCESS   "), "executable")).when(F.col("action_type") == "node", node)
        .when(F.col("action_type") == "include", F.concat(F.lit("INCLUDE   "), T.truncate(T.include_display(F.col("included_launch_id")), 70))).when(F.col("action_type") == "declare_argument", F.concat(F.lit("ARG       "), "name", part(" = ", "default_value")))
        .when(F.col("action_type") == "set_parameter", F.concat(F.lit("SET       "), "name", part(" = ", "value"))).when(F.col("action_type") == "push_namespace", F.concat(F.lit("NAMESPACE "), F.coalesce("namespace", F.lit("")))).otherwise(F.lit("GROUP"))
    )
    return actions.select("ld_id", "pos", "depth", F.concat(T.short_id(F.col("action_id")), F.lit("  "), title, part("   [if: ", "cond", "]")).alias("line"))
