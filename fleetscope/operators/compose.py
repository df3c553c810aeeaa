"""Composition of launch programs with node interfaces into a runtime architecture."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions import text as T

SELECTOR_KEYS = ("package", "executable", "name", "namespace")


def match_selectors(impls: DataFrame, actions: DataFrame, keys: tuple[str, ...] = SELECTOR_KEYS, scope: tuple[str, ...] = ()) -> DataFrame:
    """(*scope, impl_id, matches, action_id, status): each annotation's launch action, if exactly one fits; null selector keys fit anything.

    ``scope`` names columns of both sides that must agree (such as the launch description).

    Wildcards become an equi-join: actions are counted once for every subset of their keys (combined before the shuffle), and a
    selector looks its own subset up.
    """
    k = len(keys)
    subsets = F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), *(F.when(F.lit(bool(m >> i & 1)), F.col(c)).cast("string").alias(f"_{c}") for i, c in enumerate(keys))) for m in range(1 << k)])).alias("x")
    counted = actions.select("action_id", *scope, subsets).select("action_id", *scope, "x.*")
    for i, c in enumerate(keys):  # a key that is asked for must be there
        counted = counted.where((F.col("mask").bitwiseAND(1 << i) == 0) | F.col(f"_{c}").isNotNull())
    counted = counted.groupBy("mask", *scope, *(f"_{c}" for c in keys)).agg(F.count(F.lit(1)).alias("n"), F.min("action_id").alias("one"))
    mask = reduce(Column.__add__, [F.when(F.col(c).isNull(), 0).otherwise(1 << i) for i, c in enumerate(keys)])
    asked = impls.select("impl_id", *scope, mask.alias("mask"), *(F.col(c).cast("string").alias(c) for c in keys))
    on = [asked["mask"] == counted["mask"], *(asked[c] == counted[c] for c in scope), *(asked[c].eqNullSafe(counted[f"_{c}"]) for c in keys)]
    n = F.coalesce("n", F.lit(0))
    return asked.join(counted, on, "left").select(*(asked[c] for c in scope), "impl_id", n.cast("long").alias("matches"), F.when(n == 1, F.col("one")).alias("action_id"), F.when(n == 1, "match").when(n == 0, "none").otherwise("ambiguous").alias("status"))


def explicit_actions(impls: DataFrame, actions: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """(*scope, impl_id, action_id, status) for annotations that name their action; an action that is no node doesn't count."""
    a = actions.select(*scope, "action_id", "action_type")
    return impls.where("action_id IS NOT NULL").join(a, [*scope, "action_id"], "left").selectExpr(*scope, "impl_id", "CASE WHEN action_type = 'node' THEN action_id END AS action_id", "CASE WHEN action_type = 'node' THEN 'match' ELSE 'none' END AS status")


def first_match(left: DataFrame, right: DataFrame, on: list[str], by: list[str], pos: str, columns: list[str]) -> DataFrame:
    """``left`` with the columns of the first row of ``right`` by ``pos`` that has its keys, null if none has.

    The first row of each key is found by a combinable minimum before the join, so no window over matches is needed.
    """
    best = right.groupBy(*on).agg(F.min_by(F.struct(*columns), pos).alias("_first"))
    return left.join(best, on, "left").select(*by, *(F.col(f"_first.{c}").alias(c) for c in columns))


def apply_remaps(endpoints: DataFrame, remaps: DataFrame) -> DataFrame:
    """Endpoints (endpoint_id, action_id, topic_name) with the first remapping (action_id, pos, from_topic, to_topic) whose source is their topic, both resolved without namespace."""
    ends = endpoints.withColumn("_key", T.resolve_topic(F.col("topic_name")))
    rules = remaps.withColumn("_key", T.resolve_topic(F.col("from_topic"))).where("to_topic <> '' AND from_topic <> ''")
    out = first_match(ends, rules, ["action_id", "_key"], ["endpoint_id", "action_id", "topic_name"], "pos", ["from_topic", "to_topic"])
    return out.select("endpoint_id", "action_id", F.col("topic_name").alias("original_topic_name"), F.coalesce("to_topic", "topic_name").alias("topic_name"), F.col("to_topic").isNotNull().alias("remap_applied"), "from_topic", "to_topic")


def dedupe_topics(endpoints: DataFrame) -> DataFrame:
    """(topic_id, topic_name, msg_type, types): each topic once, with its first known message type by ``pos``."""
    known = F.col("msg_type").isNotNull()
    return endpoints.groupBy("topic_id").agg(F.min_by("topic_name", "pos").alias("topic_name"), F.min_by("msg_type", F.when(known, F.col("pos"))).alias("msg_type"), F.countDistinct("msg_type").alias("types"))


def type_conflicts(endpoints: DataFrame) -> DataFrame:
    return dedupe_topics(endpoints).where("types > 1")


def last_wins(rows: DataFrame, key: str, pos: str, columns: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), pos).alias("_last")).select(key, *(F.col(f"_last.{c}").alias(c) for c in columns))


def bind(impls: DataFrame, bindings: DataFrame, keys: tuple[str, ...] = SELECTOR_KEYS) -> DataFrame:
    """impls with bound_name and bound_ns of their first runtime binding (graph, pos, impl_id, selector: map, runtime_name, namespace).

    A binding fits by the id it names, or by a selector that is not empty and part of the annotation's. Both are equi-joins:
    an annotation offers every subset of its own selector.
    """
    said = bindings.select("graph", "pos", F.struct("runtime_name", "namespace").alias("b"), "impl_id", "selector")
    by_id = impls.select("graph", "impl_id").join(said.where("impl_id IS NOT NULL"), ["graph", "impl_id"]).select("graph", "impl_id", "pos", "b")
    entries = lambda cols: F.array_sort(F.filter(F.array(*cols), lambda x: x.isNotNull()))
    pair = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(c + "="), F.col(c)))
    subsets = F.explode(F.array(*[entries([pair(c) for i, c in enumerate(keys) if m >> i & 1]) for m in range(1, 1 << len(keys))])).alias("wanted")
    wanted = F.array_sort(F.transform(F.filter(F.map_entries("selector"), lambda e: e["value"].isNotNull()), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    by_selector = impls.select("graph", "impl_id", subsets).distinct().join(said.where("size(selector) > 0").select("graph", "pos", "b", wanted.alias("wanted")), ["graph", "wanted"]).select("graph", "impl_id", "pos", "b")
    first = by_id.unionByName(by_selector).groupBy("graph", "impl_id").agg(F.min_by("b", "pos").alias("_b"))
    return impls.join(first, ["graph", "impl_id"], "left").withColumn("bound_name", F.col("_b.runtime_name")).withColumn("bound_ns", F.col("_b.namespace")).drop("_b")


def build(impls: DataFrame, endpoints: DataFrame, actions: DataFrame, remaps: DataFrame, bindings: DataFrame | None = None, use_launch_namespace: bool = False) -> dict[str, DataFrame]:
    """nodes, topics, publications, subscriptions and warnings of many architectures at once.

    impls(graph, ld_id, pos, impl_id, package, executable, name, namespace, action_id, runtime_name, node_namespace) hold the selector in
    package, executable, name, namespace and action_id; endpoints(graph, impl_id, kind: pub or sub, pos, endpoint_id, topic_name, msg_type,
    reliability, durability, history, depth). An annotation's namespace counts; that of the launch action only if asked for.
    """
    scope = ("ld_id",)
    keyed = impls.withColumn("impl", F.col("impl_id")).withColumn("impl_id", F.concat_ws("\n", "graph", "impl_id"))  # ids are unique in an architecture only
    launched = actions.where("action_type = 'node'")
    chosen = match_selectors(keyed.where("action_id IS NULL"), launched, scope=scope).select("impl_id", "matches", "action_id", "status").unionByName(explicit_actions(keyed, actions, scope).selectExpr("impl_id", "CAST(1 AS BIGINT) AS matches", "action_id", "status"))
    facts = launched.selectExpr("ld_id", "action_id", "name AS _name", "executable AS _exe", "package AS _package", "namespace AS _ns")
    bound = bind(impls, bindings) if bindings is not None else impls.selectExpr("*", "CAST(NULL AS STRING) AS bound_name", "CAST(NULL AS STRING) AS bound_ns")
    rows = bound.withColumn("_key", F.concat_ws("\n", "graph", "impl_id")).drop("action_id").join(chosen.where("status = 'match'").select(F.col("impl_id").alias("_key"), "action_id"), "_key").drop("_key").join(facts, ["ld_id", "action_id"])
    names = [T.some(F.col(c)) for c in ("bound_name", "runtime_name", "_name", "_exe", "action_id")]
    spaces = [T.some(F.col(c)) for c in ("bound_ns", "node_namespace", *(["_ns"] if use_launch_namespace else []))]
    rows = rows.withColumn("node", F.coalesce(*names)).withColumn("ns", F.coalesce(*spaces)).withColumn("node_id", T.runtime_node_id(F.col("action_id")))

    def last(frame: DataFrame, key: str, pos: str, columns: dict[str, str]) -> DataFrame:
        return frame.groupBy("graph", key).agg(F.max_by(F.struct(*(F.col(c).alias(a) for c, a in columns.items())), pos).alias("_last")).select("graph", key, "_last.*")

    nodes = last(rows, "node_id", "pos", {"action_id": "action_id", "_package": "package", "_exe": "executable", "node": "runtime_name", "ns": "namespace", "ld_id": "ld_id", "impl_id": "impl_id"})
    ends = endpoints.select("graph", "impl_id", "kind", F.col("pos").alias("epos"), F.col("endpoint_id").alias("declared_in"), "topic_name", "msg_type", "reliability", "durability", "history", "depth")
    ends = ends.join(rows.select("graph", "impl_id", "ld_id", "pos", "action_id", "node_id", "node", "ns"), ["graph", "impl_id"]).withColumn("order", F.struct("pos", "kind", "epos")).withColumn("ekey", F.concat_ws("\n", "graph", "impl_id", "kind", F.col("epos").cast("string")))
    moved = apply_remaps(ends.where("topic_name <> ''").select(F.col("ekey").alias("endpoint_id"), "action_id", "topic_name"), remaps).withColumnRenamed("endpoint_id", "ekey").drop("action_id")
    full = ends.drop("topic_name").join(moved, "ekey").withColumn("topic_name", T.resolve_topic(F.col("topic_name"), F.col("ns"))).withColumn("topic_id", T.topic_id(F.col("topic_name")))
    columns = ["node_id", "topic_id", "topic_name", "msg_type", "reliability", "durability", "history", "depth", "declared_in", "impl_id", "action_id", "original_topic_name", "remap_applied", "from_topic", "to_topic"]

    def side(kind: str, name: str) -> DataFrame:
        own = full.where(F.col("kind") == kind).withColumn("endpoint_id", T.endpoint_id(F.lit(name), F.col("node_id"), F.col("topic_name")))
        return last(own, "endpoint_id", "order", dict(zip(columns, columns, strict=True)))

    known = F.col("msg_type").isNotNull()
    topics = full.groupBy("graph", "topic_id").agg(F.min_by("topic_name", "order").alias("topic_name"), F.min_by("msg_type", F.when(known, F.col("order"))).alias("msg_type"), F.countDistinct("msg_type").alias("types"))
    status = keyed.select("graph", "impl", "impl_id").join(chosen, "impl_id").where("status <> 'match'")
    said = [
        status.select("graph", F.when(F.col("status") == "none", F.format_string("annotation %s: no launch action fits", "impl")).otherwise(F.format_string("annotation %s: ambiguous, %d launch actions fit", "impl", "matches")).alias("message")),
        full.where("remap_applied").select("graph", F.format_string("remapping applied at %s: %s to %s (declared %s, now %s)", "node", "from_topic", "to_topic", "original_topic_name", "topic_name").alias("message")),
        ends.where("coalesce(topic_name, '') = ''").select("graph", F.format_string("an endpoint of %s has no topic", "node").alias("message")),
        topics.where("types > 1").select("graph", F.format_string("topic %s has %d message types", "topic_name", "types").alias("message")),
    ]
    return {"nodes": nodes, "topics": topics.drop("types"), "publications": side("pub", "publication"), "subscriptions": side("sub", "subscription"), "warnings": reduce(DataFrame.unionByName, said)}
