"""Rules over a publish/subscribe graph.

Tables: nodes(graph, node_id, runtime_name, package, executable), topics(graph, topic_id, topic_name, msg_type),
endpoints pubs and subs(graph, endpoint_id, node_id, topic_id, msg_type, reliability). ``scope`` per_graph joins within a graph;
global lets equal ids of different graphs meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keys(scope: str, *names: str) -> list[str]:
    return ["graph", *names] if scope == "per_graph" else list(names)


def isolated_node(nodes: DataFrame, pubs: DataFrame, subs: DataFrame, scope: str = "global") -> DataFrame:
    on = keys(scope, "node_id")
    return nodes.join(pubs.select(*on), on, "left_anti").join(subs.select(*on), on, "left_anti").select("node_id", "runtime_name", "package", "executable")


def _lonely(ends: DataFrame, others: DataFrame, topics: DataFrame, nodes: DataFrame, scope: str) -> DataFrame:
    on = keys(scope, "topic_id")
    alone = ends.select(*dict.fromkeys((*on, "endpoint_id", "node_id", "msg_type"))).join(others.select(*on), on, "left_anti")
    named = alone.join(topics.select(*on, "topic_name"), on).join(nodes.select(*keys(scope, "node_id"), "runtime_name"), keys(scope, "node_id"))
    return named.select("endpoint_id", "topic_id", "topic_name", "node_id", "runtime_name", "msg_type")


def publisher_without_subscriber(pubs: DataFrame, subs: DataFrame, topics: DataFrame, nodes: DataFrame, scope: str = "global") -> DataFrame:
    return _lonely(pubs, subs, topics, nodes, scope)


def subscriber_without_publisher(pubs: DataFrame, subs: DataFrame, topics: DataFrame, nodes: DataFrame, scope: str = "global") -> DataFrame:
    return _lonely(subs, pubs, topics, nodes, scope)


def topic_multiple_publishers(pubs: DataFrame, topics: DataFrame, nodes: DataFrame, scope: str = "global") -> DataFrame:
    """Topics with several publishers (of nodes with a name), by topic and message type; their names in ascending order. Names are only joined for topics that pass the count."""
    on = keys(scope, "topic_id")
    busy = pubs.groupBy(*on).agg(F.countDistinct("endpoint_id").alias("publisher_count")).where("publisher_count > 1")
    named = pubs.join(busy, on, "left_semi").join(nodes.where("runtime_name IS NOT NULL").select(*keys(scope, "node_id"), "runtime_name"), keys(scope, "node_id"))
    names = named.groupBy(*on).agg(F.countDistinct("endpoint_id").alias("publisher_count"), F.array_join(F.sort_array(F.collect_set("runtime_name")), ", ").alias("publishers")).where("publisher_count > 1")
    return names.join(topics.select(*on, "topic_name", "msg_type").distinct(), on).select("topic_id", "topic_name", "msg_type", "publisher_count", "publishers")


def _pairs(pubs: DataFrame, subs: DataFrame, topics: DataFrame, nodes: DataFrame, scope: str) -> DataFrame:
    """Publication and subscription of one topic, an equi-join that adaptive execution splits where a topic is common."""
    on = keys(scope, "topic_id")
    p = pubs.select(*on, F.col("endpoint_id").alias("publication_id"), F.col("node_id").alias("pub_node"), F.col("msg_type").alias("publisher_msg_type"), F.lower("reliability").alias("publisher_reliability"))
    s = subs.select(*on, F.col("endpoint_id").alias("subscription_id"), F.col("node_id").alias("sub_node"), F.col("msg_type").alias("subscriber_msg_type"), F.lower("reliability").alias("subscriber_reliability"))
    return p.join(s, on)


def _named(pairs: DataFrame, topics: DataFrame, nodes: DataFrame, scope: str, left: str, right: str) -> DataFrame:
    on = keys(scope, "topic_id")
    graph = ["graph"] if scope == "per_graph" else []
    a = nodes.select(*graph, F.col("node_id").alias("pub_node"), F.col("runtime_name").alias("publisher_node"))
    b = nodes.select(*graph, F.col("node_id").alias("sub_node"), F.col("runtime_name").alias("subscriber_node"))
    out = pairs.join(topics.select(*on, "topic_name"), on).join(a, [*graph, "pub_node"]).join(b, [*graph, "sub_node"])
    return out.select("topic_id", "topic_name", "publisher_node", left, "subscriber_node", right)


def qos_reliability_mismatch(pubs: DataFrame, subs: DataFrame, topics: DataFrame, nodes: DataFrame, scope: str = "global") -> DataFrame:
    """Best-effort publishers of reliable subscribers; both sides are filtered before they meet."""
    pairs = _pairs(pubs.where("lower(reliability) = 'best_effort'"), subs.where("lower(reliability) = 'reliable'"), topics, nodes, scope)
    return _named(pairs, topics, nodes, scope, "publisher_reliability", "subscriber_reliability")


def message_type_mismatch(pubs: DataFrame, subs: DataFrame, topics: DataFrame, nodes: DataFrame, scope: str = "global") -> DataFrame:
    pairs = _pairs(pubs, subs, topics, nodes, scope).where("publisher_msg_type <> subscriber_msg_type")
    return _named(pairs, topics, nodes, scope, "publisher_msg_type", "subscriber_msg_type")


def summary(nodes: DataFrame, pubs: DataFrame, subs: DataFrame) -> DataFrame:
    """Counts of nodes, publications and subscriptions by graph: each table is aggregated before they meet."""
    n = nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("nodes"))
    p = pubs.groupBy("graph").agg(F.count(F.lit(1)).alias("publications"), F.countDistinct("topic_id").alias("published_topics"))
    s = subs.groupBy("graph").agg(F.count(F.lit(1)).alias("subscriptions"))
    return n.join(p, "graph", "left").join(s, "graph", "left").na.fill(0).select("graph", "nodes", "publications", "published_topics", "subscriptions")


RULES = ("isolated_node", "publisher_without_subscriber", "subscriber_without_publisher", "topic_multiple_publishers", "qos_reliability_mismatch", "message_type_mismatch")
#: Which id an issue is about, the first that a rule's row has.
ENTITY = ("endpoint_id", "node_id", "topic_id", "action_id")


def rule_rows(arch: dict[str, DataFrame], key: str, scope: str = "per_graph") -> DataFrame:
    nodes, topics, pubs, subs = (arch[k] for k in ("nodes", "topics", "publications", "subscriptions"))
    rules = {
        "isolated_node": lambda: isolated_node(nodes, pubs, subs, scope),
        "publisher_without_subscriber": lambda: publisher_without_subscriber(pubs, subs, topics, nodes, scope),
        "subscriber_without_publisher": lambda: subscriber_without_publisher(pubs, subs, topics, nodes, scope),
        "topic_multiple_publishers": lambda: topic_multiple_publishers(pubs, topics, nodes, scope),
        "qos_reliability_mismatch": lambda: qos_reliability_mismatch(pubs, subs, topics, nodes, scope),
        "message_type_mismatch": lambda: message_type_mismatch(pubs, subs, topics, nodes, scope),
    }
    return rules[key]()


def detect(arch: dict[str, DataFrame], catalog: DataFrame | None = None, scope: str = "per_graph", keys: tuple[str, ...] = RULES, prefix: str = "ontology", strict: bool = True, unbound: str | None = None, timestamp: str | None = None) -> DataFrame:
    """Issues of the rules ``keys``, numbered for each rule in order of what they are about.

    scope global lets equal ids of several architectures meet, as in one merged repository. ``unbound`` stands for a value that
    a row lacks: None leaves it out, "None" writes that word.
    """
    from . import catalog as C

    some = next(iter(arch.values()))
    parts = []
    for key in keys:
        rows = rule_rows(arch, key, scope)
        about = F.coalesce(*(F.col(c).cast("string") for c in ENTITY if c in rows.columns))
        texts = [(F.coalesce(F.col(c).cast("string"), F.lit(unbound)) if unbound else F.col(c).cast("string")).alias(c) for c in rows.columns]
        parts.append(rows.select(*texts, F.lit(key).alias("issue_key"), about.alias("entity_id")))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    context = {c: F.col(c) for c in rows.columns if c not in ("issue_key", "entity_id")}
    known = catalog if catalog is not None else C.load_catalog(some.sparkSession)
    return C.issues(rows, known, F.concat(F.lit(prefix + "_"), "issue_key", F.lit("_")), context, ["entity_id", *context], ["issue_key"], strict=strict, timestamp=timestamp)
