"""Launch programs and runtime architectures as triples: every property of an entity becomes one element of one exploded array."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import text as T

from .triples import ROS, TYPES, shred


def _text(c: str) -> tuple[Column, str]:
    return F.col(c).cast("string"), "string"


def _iri(kind: str, c: Column) -> tuple[Column, str]:
    return T.resource(kind, c), "iri"


def _when(kind: str, value: tuple[Column, str]) -> tuple[Column, str]:
    return F.when(F.col("action_type") == kind, value[0]), value[1]


def launch_triples(model) -> DataFrame:
    """Triples of a sources.launch.LaunchModel; the graph of each is its description."""
    graph, act = F.col("ld_id"), T.resource("action", F.col("action_id"))
    launch = T.resource("launch", F.col("ld_id"))
    own = lambda sep, n: F.concat("action_id", F.lit(sep), n.cast("string"))
    cls = F.lit(ROS + "LaunchAction")
    for k, v in TYPES.items():
        cls = F.when(F.col("action_type") == k, F.lit(ROS + v)).otherwise(cls)
    scoped = F.when(F.col("action_type").isin("node", "push_namespace", "group"), F.col("namespace"))
    prov = F.concat("action_id", F.lit(":provenance"))
    actions = model.actions
    located = actions.where("confidence IS NOT NULL OR source_file IS NOT NULL")
    param, remap, cond = own(":param:", F.col("name")), own(":remap:", F.col("pos")), own(":condition:", F.col("pos"))
    parts = [
        shred(model.descriptions, graph, launch, {"label": _text("ld_id"), "hasLaunchFileId": _text("launch_file_id"), "hasFormat": _text("format")}, ["LaunchDescription"]),
        shred(
            actions, graph, act,
            {
                "type": (cls, "iri"), "label": _text("action_id"), "hasActionId": _text("action_id"), "hasPackage": _when("node", _text("package")), "hasExecutable": _when("node", _text("executable")), "hasNodeName": _when("node", _text("name")), "hasNamespace": (scoped, "string"),
                "hasArgumentName": _when("declare_argument", _text("name")), "hasDefaultValue": _when("declare_argument", _text("default_value")), "hasTargetScope": _when("set_parameter", _text("target_scope")),
                "includesLaunch": _when("include", (F.when(F.col("included_launch_id") != "", T.resource("launch", F.col("included_launch_id"))), "iri")),
            },
            ["LaunchAction"],
        ),
        shred(actions, graph, launch, {"hasAction": (act, "iri")}, []),
        shred(model.sequence, graph, launch, {"hasTopLevelAction": (act, "iri")}, []),
        shred(model.edges, graph, T.resource("action", F.col("parent")), {"hasChildAction": _iri("action", F.col("child"))}, []),
        shred(located, graph, act, {"hasProvenance": _iri("provenance", prov)}, []),
        shred(located, graph, T.resource("provenance", prov), {"hasSourceFile": _text("source_file"), "hasConfidence": (F.col("confidence").cast("string"), "decimal")}, ["Provenance"]),
        shred(model.parameters, graph, act, {"hasParameter": _iri("parameter", param)}, []),
        shred(model.parameters, graph, T.resource("parameter", param), {"hasParameterName": _text("name"), "hasParameterValue": (F.when(F.col("dtype") == "boolean", F.lower("value")).otherwise(F.col("value")), F.coalesce("dtype", F.lit("string")))}, ["Parameter"]),
        shred(model.remappings, graph, act, {"hasRemapping": _iri("remapping", remap)}, []),
        shred(model.remappings, graph, T.resource("remapping", remap), {"remapFrom": (T.some(F.col("from_topic")), "string"), "remapTo": _text("to_topic")}, ["Remapping"]),
        shred(model.conditions, graph, act, {"hasCondition": _iri("condition", cond)}, []),
        shred(model.conditions, graph, T.resource("condition", cond), {"hasConditionExpression": _text("condition")}, ["Condition"]),
    ]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["graph", "s", "p", "o"])


def architecture_triples(arch: dict[str, DataFrame], meta: DataFrame | None = None) -> DataFrame:
    """Triples of compose.build()'s tables; ``meta`` has graph, configuration_id, source_path and ld_id. Endpoints look their node and topic up: unknown ones give no link."""
    graph = F.col("graph")
    root = T.resource("architecture", graph)
    node, topic = T.resource("runtime-node", F.col("node_id")), T.resource("topic", F.col("topic_id"))
    label = lambda *c: (F.coalesce(*c), "string")
    graphs = meta if meta is not None else arch["nodes"].select("graph").distinct().selectExpr("graph", *(f"CAST(NULL AS STRING) AS {c}" for c in ("configuration_id", "source_path", "ld_id")))
    parts = [
        shred(graphs, graph, root, {"label": _text("graph"), "hasArchitectureId": _text("graph"), "hasConfigurationId": _text("configuration_id"), "hasSourceLayer2Path": _text("source_path"), "hasSourceLaunchDescriptionId": _text("ld_id")}, ["RuntimeArchitecture"]),
        shred(
            arch["nodes"], graph, node,
            {"label": label("runtime_name", "node_id"), "hasRuntimeNodeId": _text("node_id"), "hasActionId": _text("action_id"), "hasPackage": _text("package"), "hasExecutable": _text("executable"), "hasRuntimeName": _text("runtime_name"), "hasNamespace": _text("namespace"), "hasSourceLayer2Id": _text("ld_id"), "hasNodeImplementationId": _text("impl_id")},
            ["RuntimeNode"],
        ),
        shred(arch["nodes"], graph, root, {"hasRuntimeNode": (node, "iri")}, []),
        shred(arch["topics"], graph, topic, {"label": label("topic_name", "topic_id"), "hasTopicId": _text("topic_id"), "hasTopicName": _text("topic_name"), "hasMessageType": _text("msg_type")}, ["Topic"]),
        shred(arch["topics"], graph, root, {"hasTopic": (topic, "iri")}, []),
    ]
    known_nodes, known_topics = arch["nodes"].select("graph", "node_id", F.lit(True).alias("_node")), arch["topics"].select("graph", "topic_id", F.lit(True).alias("_topic"))
    for name, kind, cls, has, role, verb in (("publications", "publication", "Publication", "hasPublication", "hasPublisher", "publishes"), ("subscriptions", "subscription", "Subscription", "hasSubscription", "hasSubscriber", "subscribes")):
        rows = arch[name].join(known_nodes, ["graph", "node_id"], "left").join(known_topics, ["graph", "topic_id"], "left")
        s, qos = T.resource(kind, F.col("endpoint_id")), F.concat("endpoint_id", F.lit(":qos"))
        own_node, own_topic = F.when(F.col("_node"), node), F.when(F.col("_topic"), topic)
        said = {"hasTopicName": "topic_name", "hasMessageType": "msg_type", "hasDeclarationId": "declared_in", "hasNodeImplementationId": "impl_id", "hasSourceLayer2ActionId": "action_id", "hasOriginalTopicName": "original_topic_name", "hasRemapFrom": "from_topic", "hasRemapTo": "to_topic"}
        with_qos = rows.where("coalesce(reliability, durability, history, CAST(depth AS STRING)) IS NOT NULL")
        parts += [
            shred(rows, graph, s, {"label": _text("endpoint_id"), f"{has}Id": _text("endpoint_id"), **{p: _text(c) for p, c in said.items()}, "remapApplied": (F.col("remap_applied").cast("string"), "boolean"), role: (own_node, "iri"), "onTopic": (own_topic, "iri")}, [cls]),
            shred(rows, graph, root, {has: (s, "iri")}, []),
            shred(rows.where("_node"), graph, node, {verb: (s, "iri")}, []),
            shred(rows.where("_topic"), graph, topic, {has: (s, "iri")}, []),
            shred(with_qos, graph, s, {"hasQoS": _iri("qos", qos)}, []),
            shred(with_qos, graph, T.resource("qos", qos), {"qosReliability": _text("reliability"), "qosDurability": _text("durability"), "qosHistory": _text("history"), "qosDepth": (F.col("depth").cast("string"), "integer")}, ["QoSProfile"]),
        ]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["graph", "s", "p", "o"])
