"""Canonical tables derived from star-schema tables, so that every operator runs at any scale; the same in SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).selectExpr("n_name AS graph", "c_custkey AS node_id", "c_name AS runtime_name", "n_name AS package", "c_mktsegment AS executable")


def topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey AS topic_id", "concat('/', lower(p_brand), '/', p_partkey) AS topic_name", "CASE WHEN p_size % 4 > 0 THEN concat('T', p_size % 3) END AS msg_type")


def endpoints(spark: SparkSession, d: str, flag: str, status: str) -> DataFrame:
    ends = table(spark, d, "lineitem").where((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status))
    rows = ends.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("o_custkey AS node_id", "l_partkey AS topic_id", "l_orderkey % 3 AS mt", "l_linenumber % 2 AS be")
    each = rows.groupBy("node_id", "topic_id").agg(F.min("mt").alias("mt"), F.min("be").alias("be"))
    return each.selectExpr("concat(node_id, ':', topic_id) AS endpoint_id", "node_id", "topic_id", "concat('T', mt) AS msg_type", "CASE WHEN be = 1 THEN 'BEST_EFFORT' ELSE 'reliable' END AS reliability")


pubs = partial(endpoints, flag="A", status="F")
subs = partial(endpoints, flag="R", status="O")


def graph_of(ends: DataFrame, node: DataFrame) -> DataFrame:
    return ends.join(node.select("graph", "node_id"), "node_id")


def _ends(name: str, flag: str, status: str) -> str:
    return f"""{name} AS (SELECT CAST(o_custkey AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) AS endpoint_id, o_custkey AS node_id, l_partkey AS topic_id,
  'T' || CAST(min(l_orderkey % 3) AS VARCHAR) AS msg_type, CASE WHEN min(l_linenumber % 2) = 1 THEN 'best_effort' ELSE 'reliable' END AS reliability
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = '{flag}' AND l_linestatus = '{status}' GROUP BY o_custkey, l_partkey)"""


COMM = f"""WITH node AS (SELECT n_name AS graph, c_custkey AS node_id, c_name AS runtime_name, n_name AS package, c_mktsegment AS executable FROM customer JOIN nation ON c_nationkey = n_nationkey),
topic AS (SELECT p_partkey AS topic_id, '/' || lower(p_brand) || '/' || CAST(p_partkey AS VARCHAR) AS topic_name, CASE WHEN p_size % 4 > 0 THEN 'T' || CAST(p_size % 3 AS VARCHAR) END AS topic_type FROM part),
{_ends("pub", "A", "F")},
{_ends("sub", "R", "O")}
"""

#: Actions of launch programs out of conversations: (expression in both dialects, name).
_ACTION = """SELECT conv_id AS ld_id, turn AS pos, role, length(text) AS n,
  'file_conv_' || CAST(conv_id AS {s}) AS file_id,
  'la:file_conv_' || CAST(conv_id AS {s}) || ':' || substr(md5(substr(text, 1, 1)), 1, 8) || '#' || CAST(turn AS {s}) AS action_id,
  CASE WHEN length(text) % 13 = 0 THEN 'la:bad-id:ZZ#' || CAST(turn AS {s})
       ELSE 'la:file_conv_' || CAST(conv_id AS {s}) || ':' || substr(md5(substr(text, 1, 1)), 1, 8) || '#' || CAST(turn AS {s}) END AS stated_id,
  CASE turn % 5 WHEN 0 THEN 'node' WHEN 1 THEN 'declare_argument' WHEN 2 THEN 'include' WHEN 3 THEN 'push_namespace' ELSE 'set_parameter' END AS action_type,
  CASE WHEN length(text) % 3 = 0 THEN NULL ELSE lower(substr(text, 1, 3)) END AS name,
  CASE WHEN length(text) % 11 = 0 THEN '__executable__' ELSE 'pkg_' || role END AS package,
  'exe_' || CAST(length(text) % 7 AS {s}) AS executable,
  CASE WHEN length(text) % 4 = 1 THEN NULL ELSE '/ns' || CAST(length(text) % 4 AS {s}) END AS namespace,
  CASE WHEN length(text) % 2 = 0 THEN NULL ELSE 'default' END AS default_value,
  CASE WHEN length(text) % 4 = 0 THEN 0.8 ELSE 1.0 END AS confidence,
  CASE length(text) % 6 WHEN 0 THEN '["for_range","i",["launch_arg_get","n"]]' WHEN 1 THEN '["truthy",["var_get","has_resource"]]' WHEN 2 THEN '["eq",["launch_arg_get","a"],"true"]' ELSE NULL END AS cond,
  CASE length(text) % 5 WHEN 0 THEN 'launch_desc_os_path_join_x' WHEN 1 THEN 'launch_desc_file_conv_' || CAST(conv_id AS {s}) WHEN 2 THEN '' ELSE 'launch_desc_file_other' END AS included_launch_id,
  CASE WHEN length(text) % 7 = 0 THEN NULL ELSE 'src/' || role || '.launch' END AS source_file,
  length(text) % 3 AS n_remappings
FROM {conversations}"""


def actions(spark: SparkSession, d: str) -> DataFrame:
    """One action a turn of a conversation; see the SQL for how the fields vary."""
    return spark.sql(_ACTION.format(s="STRING", conversations="{c}"), c=table(spark, d, "conversations"))


ACTION = "WITH action AS (" + _ACTION.format(s="VARCHAR", conversations="conversations") + ")\n"


def tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: ld_id, id; edges: ld_id, parent, child): turns without those of the system, each below the turn before it, so that what hangs on a removed turn is orphaned."""
    turns = table(spark, d, "conversations").where("role <> 'system'").select(F.col("conv_id").alias("ld_id"), F.col("turn").alias("id"))
    return turns, turns.where("id > 0").select("ld_id", (F.col("id") - 1).alias("parent"), F.col("id").alias("child"))


TREE = """WITH RECURSIVE item AS (SELECT conv_id AS ld_id, turn AS id FROM conversations WHERE role <> 'system'),
edge AS (SELECT ld_id, id - 1 AS parent, id AS child FROM item WHERE id > 0)
"""

#: Launch files out of parts: an argument, and a group with a node that the argument conditions, in the three formats. {k}: key, {z}: size, {b}: brand.
LAUNCH = {
    "xml": """<launch>
  <arg name="size_{k}" default="{z}"/>
  <group>
    <node pkg="{b}" exec="exe_{z}" name="part_{k}" if="$(var size_{k})"><remap from="/in" to="/out_{k}"/></node>
  </group>
  <include file="other_{z}.launch.xml"/>
</launch>
""",
    "yaml": """launch:
  - arg:
      name: size_{k}
      default: "{z}"
  - group:
      - node:
          pkg: {b}
          exec: exe_{z}
          name: part_{k}
          if: "$(var size_{k})"
          remap:
            - from: /in
              to: /out_{k}
  - include:
      file: other_{z}.launch.xml
""",
    "python": """from launch import LaunchDescription

def generate_launch_description():
    size = LaunchConfiguration("size_{k}")
    return LaunchDescription([
        DeclareLaunchArgument("size_{k}", default_value="{z}"),
        GroupAction([Node(package="{b}", executable="exe_{z}", name="part_{k}", condition=IfCondition(size), remappings=[("/in", "/out_{k}")])]),
        IncludeLaunchDescription(PythonLaunchDescriptionSource("other_{z}.launch.xml")),
    ])
""",
}

#: Launch files out of parts with the rarer actions: environment, parameters, namespaces, conditions of both kinds, processes, components, opaque functions, branches and loops.
FEATURES = {
    "xml": """<launch>
  <let name="l_{k}" value="v"/>
  <set_env name="E_{k}" value="1"/>
  <unset_env name="U_{k}"/>
  <group>
    <push-ros-namespace namespace="ns_{k}"/>
    <node pkg="{b}" exec="x_{z}" if="$(var a)" unless="not $(env E) and $(var b)"/>
  </group>
  <node pkg="{b}" exec="x_{z}" namespace="n"/>
  <executable cmd="echo"/>
  <set_parameter name="p_{k}" value="3"/>
</launch>
""",
    "yaml": """launch:
  - let: {name: l_{k}, value: v}
  - set_env: {name: E_{k}, value: "1"}
  - unset_env: {name: U_{k}}
  - group:
      - push-ros-namespace: {namespace: ns_{k}}
      - node: {pkg: {b}, exec: x_{z}, if: "$(var a)", unless: "not $(env E) and $(var b)"}
  - node: {pkg: {b}, exec: x_{z}, namespace: n}
  - executable: {cmd: echo}
  - set_parameter: {name: p_{k}, value: "3"}
""",
    "python": """from launch import LaunchDescription

def spawn(context):
    wanted = LaunchConfiguration("n_{k}")
    n = int(wanted.perform(context))
    out = []
    if n == 1:
        out.append(Node(package="{b}", executable="one_{z}"))
    else:
        for i in range(0, n):
            out.append(Node(package="{b}", executable="many_{z}"))
    return out

def generate_launch_description():
    lost = []
    lost.append(DeclareLaunchArgument("lost_{k}"))
    ld = LaunchDescription()
    ld.add_action(SetEnvironmentVariable("E_{k}", "1"))
    ld.add_action(UnsetEnvironmentVariable("U_{k}"))
    ld.add_action(SetParameter("p_{k}", 3))
    ld.add_action(ExecuteProcess(cmd="run_{z}"))
    ld.add_action(GroupAction([PushRosNamespace("ns_{k}"), Node(package="{b}", executable="in_{z}", condition=UnlessCondition(LaunchConfiguration("u_{k}")))], condition=IfCondition("a == 'b'")))
    ld.add_action(ComposableNodeContainer(name="box_{k}", namespace="", package="{b}", executable="container", composable_node_descriptions=[ComposableNode(package="{b}", plugin="plug_{z}", name="c_{k}")]))
    ld.add_action(OpaqueFunction(function=spawn))
    return ld
""",
}

#: The rows that they give: (text that the id is the hash of, ordinal, type, text of the parent, name, package, executable, conditions, confidence).
_DECLARED = (
    ("let_l_{k}", 0, "set_parameter", None, "l_{k}", None, None, None, 1.0),
    ("set_env_E_{k}", 0, "set_parameter", None, "E_{k}", None, None, None, 1.0),
    ("group", 0, "group", None, None, None, None, None, 1.0),
    ("push_ns_ns_{k}", 0, "push_namespace", "group", None, None, None, None, 1.0),
    ("Node(pkg={b},exec=x_{z},name=None)", 0, "node", "group", None, "{b}", "x_{z}", '["eq", ["launch_arg_get", "a"], "true"]\n["not", ["and", ["not", ["truthy", ["env_get", "E"]]], ["eq", ["launch_arg_get", "b"], "true"]]]', 1.0),
    ("Node(pkg={b},exec=x_{z},name=None)", 1, "node", None, None, "{b}", "x_{z}", None, 1.0),
    ("set_param_p_{k}", 0, "set_parameter", None, "p_{k}", None, None, None, 1.0),
)
FEATURE_ROWS = {
    "xml": _DECLARED,
    "yaml": _DECLARED,
    "python": (
        ("set_env_E_{k}", 0, "set_parameter", None, "E_{k}", None, None, None, 1.0),
        ("set_param_p_{k}", 0, "set_parameter", None, "p_{k}", None, None, None, 1.0),
        ("exec_run_{z}", 0, "node", None, None, "__executable__", "run_{z}", None, 1.0),
        ("group_action", 0, "group", None, None, None, None, '["eq", ["var_get", "a"], "b"]', 0.9),
        ("push_ns_ns_{k}", 0, "push_namespace", "group_action", None, None, None, None, 1.0),
        ("Node(pkg={b},exec=in_{z},name=None)", 0, "node", "group_action", None, "{b}", "in_{z}", '["not", ["eq", ["launch_arg_get", "u_{k}"], "true"]]', 0.9),
        ("Node(pkg={b},exec=container,name=box_{k})", 0, "node", None, "box_{k}", "{b}", "container", None, 1.0),
        ("Node(pkg={b},exec=plug_{z},name=c_{k})", 0, "node", None, "c_{k}", "{b}", "plug_{z}", None, 1.0),
        ("Node(pkg={b},exec=one_{z},name=None)", 0, "node", None, None, "{b}", "one_{z}", '["eq", ["var_get", "n"], "1"]', 0.9),
        ("Node(pkg={b},exec=many_{z},name=None)", 0, "node", None, None, "{b}", "many_{z}", '["and", ["not", ["eq", ["var_get", "n"], "1"]], ["for_range", "i", ["launch_arg_get", "n_{k}"]]]', 0.9),
        ("arg_lost_{k}", 0, "declare_argument", None, "lost_{k}", None, None, None, 0.8),
    ),
}


def feature_sql(fmt: str) -> str:
    """FEATURE_ROWS for every part."""

    def text(x: str | None) -> str:
        if x is None:
            return "CAST(NULL AS VARCHAR)"
        said = "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
        return f"replace(replace(replace({said}, '{{k}}', ks), '{{z}}', z), '{{b}}', b)"

    def action(x: str | None, n: int = 0) -> str:
        return "CAST(NULL AS VARCHAR)" if x is None else f"pre || substr(md5({text(x)}), 1, 8) || '#{n}'"

    rows = (
        f"SELECT {action(said, n)} AS action_id, '{kind}' AS action_type, {action(parent)} AS parent_id, {text(name)} AS name, {text(package)} AS package, {text(executable)} AS executable, {text(cond)} AS cond, {sure}::DOUBLE AS confidence FROM p"
        for said, n, kind, parent, name, package, executable, cond, sure in FEATURE_ROWS[fmt]
    )
    return "WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS ks, CAST(p_size AS VARCHAR) AS z, replace(lower(p_brand), '#', '_') AS b, 'la:file_parts_' || CAST(p_partkey AS VARCHAR) || '_launch:' AS pre FROM part)\n" + " UNION ALL ".join(rows)


def launch_documents(spark: SparkSession, d: str, fmt: str, templates: dict[str, str] = LAUNCH) -> DataFrame:
    """(path, format, content) of one launch file a part. The parts are dealt to all cores before their texts are made: a table of small rows is read in few tasks, its texts take long to parse."""
    parts = spread(table(spark, d, "part").select("p_partkey", "p_size", "p_brand"))
    text = F.lit(templates[fmt])
    for key, value in (("k", F.col("p_partkey").cast("string")), ("z", F.col("p_size").cast("string")), ("b", F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")))):
        text = F.replace(text, F.lit("{" + key + "}"), value)
    return parts.select(F.concat(F.lit("parts/"), F.col("p_partkey").cast("string"), F.lit(".launch")).alias("path"), F.lit(fmt).alias("format"), text.alias("content"))


def launch_sql(fmt: str) -> str:
    """The rows that parsing those files gives: (action_id, action_type, parent_id, name, package, executable, cond, confidence)."""
    group = "group_action" if fmt == "python" else "group"
    sure = "0.9" if fmt == "python" else "1.0"
    return f"""WITH p AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS ks, CAST(p_size AS VARCHAR) AS z, replace(lower(p_brand), '#', '_') AS b, 'la:file_parts_' || CAST(p_partkey AS VARCHAR) || '_launch:' AS pre FROM part)
SELECT pre || substr(md5('arg_size_' || ks), 1, 8) || '#0' AS action_id, 'declare_argument' AS action_type, CAST(NULL AS VARCHAR) AS parent_id, 'size_' || ks AS name, CAST(NULL AS VARCHAR) AS package, CAST(NULL AS VARCHAR) AS executable, CAST(NULL AS VARCHAR) AS cond, 1.0::DOUBLE AS confidence FROM p
UNION ALL SELECT pre || substr(md5('{group}'), 1, 8) || '#0', 'group', NULL, NULL, NULL, NULL, NULL, 1.0 FROM p
UNION ALL SELECT pre || substr(md5('Node(pkg=' || b || ',exec=exe_' || z || ',name=part_' || ks || ')'), 1, 8) || '#0', 'node', pre || substr(md5('{group}'), 1, 8) || '#0', 'part_' || ks, b, 'exe_' || z, '["eq", ["launch_arg_get", "size_' || ks || '"], "true"]', {sure} FROM p
UNION ALL SELECT pre || substr(md5('include_file_other_' || z || '_launch_xml'), 1, 8) || '#0', 'include', NULL, NULL, NULL, NULL, NULL, 1.0 FROM p"""


def architecture(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"nodes": nodes(spark, d), "topics": topics(spark, d), "publications": pubs(spark, d), "subscriptions": subs(spark, d)}
