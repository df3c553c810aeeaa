"""Every query by name, and the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetscope.functions import conditions
from fleetscope.functions import text as T
from fleetscope.operators import catalog, communication, compose, model, shapes, structural, tree, triples, validation

from fleetscope.sources.launch import LaunchModel, parse_documents

from . import views
from .views import ACTION, COMM, TREE, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# Communication

_NODE = "JOIN node USING (node_id)"


@query(COMM + "SELECT node_id, runtime_name, package, executable FROM node WHERE NOT EXISTS (SELECT 1 FROM pub WHERE pub.node_id = node.node_id) AND NOT EXISTS (SELECT 1 FROM sub WHERE sub.node_id = node.node_id)")
def comm_isolated_node(s, d):
    return communication.isolated_node(views.nodes(s, d), views.pubs(s, d), views.subs(s, d))


def _lonely_sql(a: str, b: str) -> str:
    return COMM + f"SELECT {a}.endpoint_id, {a}.topic_id, topic_name, {a}.node_id, runtime_name, msg_type FROM {a} JOIN topic USING (topic_id) {_NODE} WHERE NOT EXISTS (SELECT 1 FROM {b} WHERE {b}.topic_id = {a}.topic_id)"


@query(_lonely_sql("pub", "sub"))
def comm_publisher_without_subscriber(s, d):
    return communication.publisher_without_subscriber(views.pubs(s, d), views.subs(s, d), views.topics(s, d), views.nodes(s, d))


@query(_lonely_sql("sub", "pub"))
def comm_subscriber_without_publisher(s, d):
    return communication.subscriber_without_publisher(views.pubs(s, d), views.subs(s, d), views.topics(s, d), views.nodes(s, d))


@query(COMM + f"SELECT topic_id, topic_name, topic_type AS msg_type, count(DISTINCT endpoint_id) AS publisher_count, string_agg(DISTINCT runtime_name, ', ' ORDER BY runtime_name) AS publishers FROM pub JOIN topic USING (topic_id) {_NODE} GROUP BY topic_id, topic_name, topic_type HAVING count(DISTINCT endpoint_id) > 1")
def comm_topic_multiple_publishers(s, d):
    return communication.topic_multiple_publishers(views.pubs(s, d), views.topics(s, d), views.nodes(s, d))


def _pair_sql(column: str, where: str) -> str:
    return COMM + f"SELECT topic_id, topic_name, a.runtime_name AS publisher_node, pub.{column} AS publisher_{column}, b.runtime_name AS subscriber_node, sub.{column} AS subscriber_{column} FROM pub JOIN sub USING (topic_id) JOIN topic USING (topic_id) JOIN node a ON a.node_id = pub.node_id JOIN node b ON b.node_id = sub.node_id WHERE {where}"


@query(_pair_sql("reliability", "pub.reliability = 'best_effort' AND sub.reliability = 'reliable'"))
def comm_qos_reliability_mismatch(s, d):
    return communication.qos_reliability_mismatch(views.pubs(s, d), views.subs(s, d), views.topics(s, d), views.nodes(s, d))


@query(_pair_sql("msg_type", "pub.msg_type <> sub.msg_type"))
def comm_message_type_mismatch(s, d):
    return communication.message_type_mismatch(views.pubs(s, d), views.subs(s, d), views.topics(s, d), views.nodes(s, d))


@query(COMM + f"""SELECT n.graph, n.nodes, coalesce(p.publications, 0) AS publications, coalesce(p.published_topics, 0) AS published_topics, coalesce(s.subscriptions, 0) AS subscriptions
FROM (SELECT graph, count(*) AS nodes FROM node GROUP BY graph) n LEFT JOIN (SELECT graph, count(*) AS publications, count(DISTINCT topic_id) AS published_topics FROM pub {_NODE} GROUP BY graph) p ON p.graph = n.graph
LEFT JOIN (SELECT graph, count(*) AS subscriptions FROM sub {_NODE} GROUP BY graph) s ON s.graph = n.graph""")
def comm_summary_by_architecture(s, d):
    n = views.nodes(s, d)
    return communication.summary(n, views.graph_of(views.pubs(s, d), n), views.graph_of(views.subs(s, d), n))


@query(COMM + "SELECT DISTINCT graph, topic_id FROM pub JOIN node USING (node_id) WHERE (graph, topic_id) NOT IN (SELECT graph, topic_id FROM sub JOIN node USING (node_id))")
def comm_unheard_by_graph(s, d):
    """The rule's per-graph scope: a topic heard in another graph does not count."""
    n = views.nodes(s, d)
    p, q = (views.graph_of(e, n).select("graph", "topic_id").distinct() for e in (views.pubs(s, d), views.subs(s, d)))
    return p.join(q, ["graph", "topic_id"], "left_anti")


# Launch programs

_ROW = "ld_id, action_id, package, executable, source_file"


def _rows(df: DataFrame) -> DataFrame:
    return df.selectExpr(*_ROW.split(", "))


def _simple(name: str, rule: Callable[[DataFrame], DataFrame], where: str) -> None:
    query(ACTION + f"SELECT {_ROW} FROM action WHERE {where}", name)(lambda s, d: _rows(rule(views.actions(s, d))))


_UNRESOLVED = "(contains(included_launch_id, 'os_path_join') OR contains(included_launch_id, 'type____var') OR contains(included_launch_id, 'type____launch'))"
_simple("l2_node_no_name", structural.query_node_no_name, "action_type = 'node' AND name IS NULL AND package <> '__executable__'")
_simple("l2_arg_no_default", structural.arg_no_default, "action_type = 'declare_argument' AND default_value IS NULL")
_simple("l2_include_unresolved", structural.include_unresolved, f"action_type = 'include' AND {_UNRESOLVED}")
_simple("l2_action_without_provenance", structural.query_action_without_provenance, "source_file IS NULL")
_simple("l2_node_without_remappings", structural.query_node_without_remappings, "action_type = 'node' AND n_remappings = 0")
_simple("issue_node_no_name", structural.node_no_name, "action_type = 'node' AND name IS NULL")
_simple("issue_arg_orphan", structural.arg_orphan, "action_type = 'declare_argument' AND confidence < 0.9")
_simple("issue_namespace_implicit", structural.namespace_implicit, "action_type = 'node' AND namespace IS NULL AND cond IS NULL AND EXISTS (SELECT 1 FROM action b WHERE b.ld_id = action.ld_id AND b.action_type = 'push_namespace')")
_simple("issue_include_self", structural.include_self, "action_type = 'include' AND included_launch_id IN (CAST(ld_id AS VARCHAR), 'launch_desc_' || file_id)")
_simple("issue_runtime_condition", structural.node_runtime_condition, "action_type = 'node' AND contains(cond, 'has_resource')")
_simple("issue_opaque_symbolic", structural.opaque_symbolic_node, "action_type = 'node' AND NOT contains(cond, 'has_resource') AND contains(cond, 'for') AND contains(cond, 'range')")

_WHERE = {
    "node_no_name": "action_type = 'node' AND name IS NULL", "node_runtime_condition": "action_type = 'node' AND contains(cond, 'has_resource')",
    "opaque_symbolic_node": "action_type = 'node' AND NOT contains(cond, 'has_resource') AND contains(cond, 'for') AND contains(cond, 'range')",
    "include_unresolved": f"action_type = 'include' AND {_UNRESOLVED}", "include_self": "action_type = 'include' AND included_launch_id IN (CAST(ld_id AS VARCHAR), 'launch_desc_' || file_id)",
    "arg_no_default": "action_type = 'declare_argument' AND default_value IS NULL", "arg_orphan": "action_type = 'declare_argument' AND confidence < 0.9",
    "namespace_implicit": "action_type = 'node' AND namespace IS NULL AND cond IS NULL AND EXISTS (SELECT 1 FROM action b WHERE b.ld_id = action.ld_id AND b.action_type = 'push_namespace')",
}
_CONTEXT = {"executable": "executable", "package": "package", "condition": "cond", "arg_name": "name", "action_id": "action_id"}


def _rendered_sql() -> str:
    union = " UNION ALL ".join(f"SELECT *, '{k}' AS issue_key, '{structural.FAMILY.get(k, '')}' AS family FROM action WHERE {w}" for k, w in _WHERE.items())
    text = lambda t: t.replace("'", "''")
    entries = ", ".join(f"('{k}', '{e[1]}', '{e[2]}', '{text(e[4])}', '{e[6]}')" for k, e in catalog.CATALOG.items() if e[0] and k != "arg_orphan")
    rendered = "description"
    for k, c in _CONTEXT.items():
        rendered = f"replace({rendered}, '{{{k}}}', coalesce({c}, ''))"
    return ACTION + f""", cand AS ({union}), num AS (SELECT *, row_number() OVER (PARTITION BY file_id, family ORDER BY pos, issue_key) AS rn FROM cand)
SELECT 'issue_' || file_id || '_' || family || CASE WHEN rn < 1000 THEN lpad(CAST(rn AS VARCHAR), 3, '0') ELSE CAST(rn AS VARCHAR) END AS issue_id, issue_key, severity, category, {rendered} AS description, entity_type, action_id AS entity_id
FROM num JOIN (VALUES {entries}) c(issue_key, severity, category, description, entity_type) USING (issue_key)"""


@query(_rendered_sql())
def issue_rendered(s, d):
    """arg_orphan is disabled here: its candidates still use numbers up."""
    entries = {k: (e if k != "arg_orphan" else (False, *e[1:])) for k, e in catalog.CATALOG.items()}
    rows = structural.candidates(views.actions(s, d))
    out = catalog.issues(rows, catalog.load_catalog(s, entries), F.concat(F.lit("issue_"), "file_id", F.lit("_"), "family"), {k: F.col(c) for k, c in _CONTEXT.items()}, ["pos", "issue_key"], ["file_id", "family"])
    return out.select("issue_id", "issue_key", "severity", "category", "description", "entity_type", "entity_id")


# Identifiers and scalar functions

_NORM = r"""regexp_replace(replace(regexp_replace(text, '#[^\n]*', '', 'g'), '''', '"'), '\s+', '', 'g')"""


@query(f"WITH h AS (SELECT doc_id, source, CASE WHEN {_NORM} = '' THEN '00000000' ELSE substr(md5({_NORM}), 1, 8) END AS hash FROM documents) SELECT doc_id, 'la:file_' || source || ':' || hash || '#' || CAST(row_number() OVER (PARTITION BY source, hash ORDER BY doc_id) - 1 AS VARCHAR) AS action_id FROM h")
def id_action_hash_ordinal(s, d):
    h = table(s, d, "documents").select("doc_id", "source", T.action_hash(F.col("text")).alias("hash"))
    n = F.row_number().over(Window.partitionBy("source", "hash").orderBy("doc_id")) - 1
    return h.select("doc_id", T.action_id(T.file_id(F.col("source")), F.col("hash"), n).alias("action_id"))


@query("SELECT page_id, 'file_' || regexp_replace(url, '[^a-zA-Z0-9_]', '_', 'g') AS file_id FROM pages")
def id_file_id(s, d):
    return table(s, d, "pages").select("page_id", T.file_id(F.col("url")).alias("file_id"))


@query(f"SELECT doc_id, md5({_NORM}) AS digest, length({_NORM}) AS n FROM documents")
def id_normalize_snippet(s, d):
    t = T.normalize_snippet(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n"))


_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'root')"


@query(f"SELECT page_id, 'topic:' || {_SLUG} AS topic_id, 'runtime_node:' || {_SLUG} AS node_id FROM pages")
def fn_slug(s, d):
    u = F.col("url")
    return table(s, d, "pages").select("page_id", T.topic_id(u).alias("topic_id"), T.runtime_node_id(u).alias("node_id"))


_PATH = "regexp_extract(url, '://[^/]*(/[^?#]*)', 1)"
_REL = f"CASE WHEN page_id % 2 = 0 THEN {_PATH} ELSE substr({_PATH}, 2) END"
_NS = "CASE page_id % 4 WHEN 0 THEN 'robot/' WHEN 1 THEN '/' WHEN 2 THEN '$(arg ns)' ELSE '/a/b/' END"


@query(f"""WITH t AS (SELECT page_id, {_REL} AS topic, CASE page_id % 4 WHEN 0 THEN '/robot' WHEN 3 THEN '/a/b' ELSE '' END AS ns FROM pages),
b AS (SELECT *, regexp_replace(topic, '^/+|/+$', '', 'g') AS body FROM t)
SELECT page_id, ns AS namespace, CASE WHEN starts_with(topic, '/') THEN '/' || body ELSE ns || '/' || body END AS topic_name, '/' || body = '/en' AS is_en FROM b""")
def fn_topic_resolve(s, d):
    rows = table(s, d, "pages").selectExpr("page_id", f"{_REL} AS topic", f"{_NS} AS ns")
    return rows.select("page_id", T.normalize_namespace(F.col("ns")).alias("namespace"), T.resolve_topic(F.col("topic"), F.col("ns")).alias("topic_name"), T.topic_matches(F.col("topic"), F.lit("en")).alias("is_en"))


@query("SELECT page_id, 'http://example.org/ros-launch/resource/page/' || url_encode(url || ' ~*é') AS uri FROM pages")
def fn_uri_encode(s, d):
    return table(s, d, "pages").select("page_id", T.resource("page", F.concat("url", F.lit(" ~*é"))).alias("uri"))


_SUBST = """CASE event_id % 6 WHEN 0 THEN '$(var ' || event_type || ')' WHEN 1 THEN '$(arg a' || CAST(user_id AS {s}) || ')' WHEN 2 THEN '$(env HOME ' || event_type || ')' WHEN 3 THEN '$(env HOME)'
 WHEN 4 THEN '$(find-pkg-share ' || event_type || ')/x/' || CAST(user_id AS {s}) || '.yaml' ELSE event_type END"""
_SUBST_SQL = f"""WITH t AS (SELECT event_id, event_type, user_id, {_SUBST.format(s="VARCHAR")} AS c FROM events),
p AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'argument_reference' WHEN 1 THEN 'argument_reference' WHEN 2 THEN 'environment_variable' WHEN 3 THEN 'environment_variable' WHEN 4 THEN 'file_path' ELSE 'literal' END AS type,
 CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN 'a' || CAST(user_id AS VARCHAR) WHEN 2 THEN 'HOME' WHEN 3 THEN 'HOME' WHEN 4 THEN event_type END AS name,
 CASE event_id % 6 WHEN 2 THEN event_type WHEN 4 THEN 'x/' || CAST(user_id AS VARCHAR) || '.yaml' WHEN 5 THEN event_type END AS value FROM t)
"""


def _substitutions(s, d):
    return table(s, d, "events").selectExpr("event_id", f"{_SUBST.format(s='STRING')} AS c").select("event_id", T.parse_substitution(F.col("c")).alias("x"))


@query(_SUBST_SQL + "SELECT * FROM p")
def fn_subst_parse(s, d):
    return _substitutions(s, d).select("event_id", "x.*")


_WRITE = "CASE type WHEN 'argument_reference' THEN '$(arg ' || name || ')' WHEN 'environment_variable' THEN '$(env ' || name || coalesce('{gap}' || value, '') || ')' WHEN 'file_path' THEN '$(find-pkg-share ' || name || ')' || coalesce('/' || value, '') ELSE value END"


@query(_SUBST_SQL + f"SELECT event_id, {_WRITE.format(gap='=')} AS display, {_WRITE.format(gap=' ')} AS written FROM p")
def fn_subst_display(s, d):
    return _substitutions(s, d).select("event_id", T.display_substitution(F.col("x")).alias("display"), T.substitution_text(F.col("x")).alias("written"))


_COND = "CASE event_id % 5 WHEN 0 THEN '$(var a) and $(var ' || event_type || ')' WHEN 1 THEN 'not $(var ' || event_type || ')' WHEN 2 THEN '$(env E)' WHEN 3 THEN '$(var x) or $(var y) and z' ELSE '$(arg ' || event_type || ')' END"


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'and' WHEN 1 THEN 'not' WHEN 2 THEN 'truthy' WHEN 3 THEN 'or' ELSE 'eq' END AS kind FROM events")
def fn_condition_kind(s, d):
    return table(s, d, "events").selectExpr("event_id", f"{_COND} AS c").select("event_id", conditions.condition_kind(F.col("c")).alias("kind"))


@query("""SELECT event_id, CASE event_id % 5
 WHEN 0 THEN '["and", ["eq", ["launch_arg_get", "a"], "true"], ["eq", ["launch_arg_get", "' || event_type || '"], "true"]]'
 WHEN 1 THEN '["not", ["eq", ["launch_arg_get", "' || event_type || '"], "true"]]' WHEN 2 THEN '["truthy", ["env_get", "E"]]'
 WHEN 3 THEN '["or", ["eq", ["launch_arg_get", "x"], "true"], ["and", ["eq", ["launch_arg_get", "y"], "true"], ["truthy", ["var_get", "z"]]]]'
 ELSE '["eq", ["launch_arg_get", "' || event_type || '"], "true"]' END AS ir FROM events""")
def cond_ir_parse(s, d):
    from fleetscope.shipping import ship

    ship(s)
    return table(s, d, "events").selectExpr("event_id", f"{_COND} AS c").select("event_id", conditions.condition_json(F.col("c")).alias("ir"))


@query("SELECT action_id, '#' || substr(action_id, length('la:file_conv_') + length(CAST(ld_id AS VARCHAR)) + 2, 8) || CASE WHEN pos = 0 THEN '' ELSE '.' || CAST(pos AS VARCHAR) END AS short FROM (" + ACTION + "SELECT * FROM action)")
def fn_short_id(s, d):
    return views.actions(s, d).select("action_id", T.short_id(F.col("action_id")).alias("short"))


@query("SELECT part.p_partkey, CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 7) || '…' ELSE p_name END AS short, 'X ' || p_brand || CASE WHEN p_size > 25 THEN ' {size}' ELSE ' ' || CAST(p_size AS VARCHAR) END AS lenient, 'X {a} {b} [missing_context=b]' AS strict FROM part")
def fn_render(s, d):
    size = F.when(F.col("p_size") <= 25, F.col("p_size"))
    return table(s, d, "part").select("p_partkey", T.truncate(F.col("p_name"), 8).alias("short"), T.render_lenient(F.lit("X {brand} {size}"), {"brand": F.col("p_brand"), "size": size}).alias("lenient"), T.render_strict(F.lit("X {a} {b}"), {"a": F.col("p_brand")}).alias("strict"))


# Composition

_IMPL = "SELECT s_suppkey AS impl_id, CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE n_name END AS package, CASE s_suppkey % 6 WHEN 0 THEN 'MACHINERY' WHEN 1 THEN 'HOUSEHOLD' WHEN 2 THEN 'BUILDING' WHEN 3 THEN 'AUTOMOBILE' WHEN 4 THEN 'FURNITURE' ELSE NULL END AS executable, CASE WHEN s_suppkey % 7 = 6 THEN NULL ELSE '/ns' || CAST(s_suppkey % 13 AS {s}) END AS namespace FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"
_ACT = "SELECT c_custkey AS action_id, n_name AS package, c_mktsegment AS executable, '/ns' || CAST(c_custkey % 13 AS {s}) AS namespace FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"


@query("WITH i AS (" + _IMPL.format(s="VARCHAR", supplier="supplier", nation="nation") + "), a AS (" + _ACT.format(s="VARCHAR", customer="customer", nation="nation") + """)
SELECT impl_id, count(a.action_id) AS matches, CASE WHEN count(a.action_id) = 1 THEN min(a.action_id) END AS action_id, CASE WHEN count(a.action_id) = 1 THEN 'match' WHEN count(a.action_id) = 0 THEN 'none' ELSE 'ambiguous' END AS status
FROM i LEFT JOIN a ON (i.package IS NULL OR i.package = a.package) AND (i.executable IS NULL OR i.executable = a.executable) AND (i.namespace IS NULL OR i.namespace = a.namespace) GROUP BY impl_id""")
def compose_selector_exactly_one(s, d):
    t = {k: table(s, d, k) for k in ("supplier", "nation", "customer")}
    impls = s.sql(_IMPL.format(s="STRING", supplier="{supplier}", nation="{nation}"), supplier=t["supplier"], nation=t["nation"])
    acts = s.sql(_ACT.format(s="STRING", customer="{customer}", nation="{nation}"), customer=t["customer"], nation=t["nation"])
    return compose.match_selectors(impls, acts, ("package", "executable", "namespace"))


@query("WITH b AS (SELECT user_id, arg_min(event_type, event_id) AS runtime_name, arg_min(props, event_id) AS props FROM events GROUP BY user_id) SELECT s_suppkey AS impl_id, runtime_name, props FROM supplier LEFT JOIN b ON s_suppkey = user_id")
def compose_first_binding(s, d):
    impls = table(s, d, "supplier").selectExpr("s_suppkey AS impl_id")
    return compose.first_match(impls, table(s, d, "events").selectExpr("user_id AS impl_id", "event_id AS pos", "event_type AS runtime_name", "props"), ["impl_id"], ["impl_id"], "pos", ["runtime_name", "props"])


@query("""WITH e AS (SELECT p_partkey AS endpoint_id, p_partkey % 20 AS action_id, 't' || CAST(p_partkey % 7 AS VARCHAR) AS topic_name FROM part),
r AS (SELECT event_id % 20 AS action_id, event_id % 11 AS t, arg_min(user_id, event_id) AS u FROM events GROUP BY 1, 2)
SELECT endpoint_id, e.action_id, e.topic_name AS original_topic_name, coalesce('/robot/' || CAST(u AS VARCHAR), e.topic_name) AS topic_name, u IS NOT NULL AS remap_applied
FROM e LEFT JOIN r ON r.action_id = e.action_id AND 't' || CAST(t AS VARCHAR) = e.topic_name""")
def compose_remap_first_match(s, d):
    ends = table(s, d, "part").selectExpr("p_partkey AS endpoint_id", "p_partkey % 20 AS action_id", "concat('t', p_partkey % 7) AS topic_name")
    remaps = table(s, d, "events").selectExpr("event_id % 20 AS action_id", "event_id AS pos", "concat('/t', event_id % 11, '/') AS from_topic", "concat('/robot/', user_id) AS to_topic")
    return compose.apply_remaps(ends, remaps).select("endpoint_id", "action_id", "original_topic_name", "topic_name", "remap_applied")


_ENDS = "SELECT user_id AS topic_id, event_type AS topic_name, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'T' || CAST(event_id % 5 AS {s}) END AS msg_type, event_id AS pos FROM {events}"
_DEDUPE = "WITH e AS (" + _ENDS.format(s="VARCHAR", events="events") + ") SELECT topic_id, arg_min(topic_name, pos) AS topic_name, arg_min(msg_type, CASE WHEN msg_type IS NOT NULL THEN pos END) AS msg_type, count(DISTINCT msg_type) AS types FROM e GROUP BY topic_id"


def _ends(s, d):
    return s.sql(_ENDS.format(s="STRING", events="{e}"), e=table(s, d, "events"))


@query(_DEDUPE)
def compose_topic_dedupe(s, d):
    return compose.dedupe_topics(_ends(s, d))


@query(_DEDUPE + " HAVING count(DISTINCT msg_type) > 1")
def compose_type_conflicts(s, d):
    return compose.type_conflicts(_ends(s, d))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(props, event_id) AS props FROM events GROUP BY user_id")
def compose_last_wins(s, d):
    return compose.last_wins(table(s, d, "events"), "user_id", "event_id", ["event_type", "props"])


# Trees

_REACH = TREE + ", reach AS (SELECT ld_id, id, 0 AS depth FROM item WHERE id = 0 UNION ALL SELECT e.ld_id, e.child, depth + 1 FROM reach r JOIN edge e ON e.ld_id = r.ld_id AND e.parent = r.id)\n"


def _rooted(s, d):
    items, edges = views.tree(s, d)
    return items, items.where("id = 0"), edges


@query(_REACH + "SELECT ld_id, id, depth FROM reach")
def tree_reachable(s, d):
    _, roots, edges = _rooted(s, d)
    return tree.reachable(roots, edges)


@query(_REACH + "SELECT ld_id, id FROM item WHERE (ld_id, id) NOT IN (SELECT ld_id, id FROM reach)")
def tree_orphans(s, d):
    return tree.orphans(*_rooted(s, d)).select("ld_id", "id")


@query(_REACH + "SELECT ld_id, max(depth) AS depth, count(*) AS items FROM reach GROUP BY ld_id")
def tree_depth(s, d):
    _, roots, edges = _rooted(s, d)
    return tree.reachable(roots, edges).groupBy("ld_id").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("items"))


@query("""WITH RECURSIVE edge AS (SELECT DISTINCT c_nationkey AS ld_id, c_custkey % 23 AS parent, (c_custkey * 5 + c_custkey // 100) % 23 AS child FROM customer),
path AS (SELECT ld_id, parent AS a, child AS b FROM edge UNION SELECT p.ld_id, p.a, e.child FROM path p JOIN edge e ON e.ld_id = p.ld_id AND e.parent = p.b)
SELECT DISTINCT ld_id, a AS id FROM path WHERE a = b""")
def tree_cycles(s, d):
    edges = table(s, d, "customer").selectExpr("c_nationkey AS ld_id", "c_custkey % 23 AS parent", "(c_custkey * 5 + c_custkey div 100) % 23 AS child")
    return tree.cycles(edges)


# Validation

_ERROR = "'{severity}' AS severity, '{rule}' AS rule, {message} AS message"


@query(ACTION + r"SELECT ld_id, 'error' AS severity, 'id_format' AS rule, stated_id || ' is no valid id' AS message, stated_id AS action_id FROM action WHERE NOT regexp_matches(stated_id, '^la:[a-zA-Z0-9_]+:[0-9a-f]{8}#[0-9]+$')")
def validate_id_format(s, d):
    return validation.id_format(views.actions(s, d), "stated_id")


@query(ACTION + "SELECT ld_id, 'error' AS severity, 'sequence_validity' AS rule, 'the sequence names ' || action_id || ', which does not exist' AS message, action_id FROM action WHERE role = 'system'")
def validate_sequence(s, d):
    a = views.actions(s, d)
    return validation.sequence_validity(a.select("ld_id", "action_id"), a.where("role <> 'system'"))


@query(ACTION + "SELECT ld_id, 'error' AS severity, 'actions_map_consistency' AS rule, 'key ' || stated_id || ' holds ' || action_id AS message, action_id FROM action WHERE stated_id <> action_id")
def validate_map_keys(s, d):
    return validation.map_consistency(views.actions(s, d).withColumnRenamed("stated_id", "map_key"))


def _edges(a: DataFrame) -> DataFrame:
    child = a.selectExpr("ld_id", "pos - 1 AS pos", "action_id AS child")
    return a.selectExpr("ld_id", "pos", "action_id AS parent").join(child, ["ld_id", "pos"]).select("ld_id", "parent", "child")


@query(ACTION + "SELECT ld_id, 'error' AS severity, 'scope_actions_only' AS rule, action_type || ' has children' AS message, action_id FROM action WHERE action_type NOT IN ('push_namespace', 'group', 'include') AND EXISTS (SELECT 1 FROM action b WHERE b.ld_id = action.ld_id AND b.pos = action.pos + 1)")
def validate_scope(s, d):
    a = views.actions(s, d)
    return validation.scope_actions_only(a, _edges(a))


@query(ACTION + "SELECT ld_id, 'error' AS severity, 'include_required_fields' AS rule, 'an include needs a target' AS message, action_id FROM action WHERE action_type = 'include' AND included_launch_id = ''")
def validate_required(s, d):
    a = views.actions(s, d)
    return validation.include_required_fields(a).unionByName(validation.node_required_fields(a))


# Triples, patterns and shapes

_RES = "'http://example.org/ros-launch/resource/"
_S = f"{_RES}action/' || url_encode(action_id)"
_P = f"{_RES}provenance/' || url_encode(action_id)"
_TYPE = " ".join(f"WHEN '{k}' THEN '{triples.ROS}{v}'" for k, v in triples.TYPES.items())


def _triple(p: str, o: str, where: str = "TRUE", s: str = _S) -> str:
    return f"SELECT CAST(ld_id AS VARCHAR) AS graph, {s} AS s, '{p}' AS p, {o} AS o FROM action WHERE {where}"


TRIPLES = ACTION.rstrip() + ", t AS (" + " UNION ALL ".join([
    _triple("type", f"'{triples.ROS}LaunchAction'"), _triple("hasSpecificType", f"CASE action_type {_TYPE} END"), _triple("hasActionId", "action_id"), _triple("hasName", "name", "name IS NOT NULL"),
    _triple("hasNamespace", "namespace", "namespace IS NOT NULL"), _triple("hasPackage", "package", "action_type = 'node'"), _triple("hasExecutable", "executable", "action_type = 'node'"),
    _triple("hasDefaultValue", "default_value", "action_type = 'declare_argument' AND default_value IS NOT NULL"), _triple("includesLaunch", f"{_RES}launch/' || url_encode(included_launch_id)", "action_type = 'include' AND included_launch_id <> ''"),
    _triple("hasCondition", "cond", "cond IS NOT NULL"), _triple("hasProvenance", _P, "source_file IS NOT NULL"), _triple("type", f"'{triples.ROS}Provenance'", "source_file IS NOT NULL", _P),
    _triple("hasSourceFile", "source_file", "source_file IS NOT NULL", _P), _triple("hasConfidence", "CAST(confidence AS VARCHAR)", "source_file IS NOT NULL", _P),
]) + ")\n"


@query(TRIPLES + "SELECT graph, s, p, o FROM t")
def triples_shred(s, d):
    return triples.action_triples(views.actions(s, d)).select("graph", "s", "p", "o")


@query(TRIPLES + "SELECT p, count(*) AS n FROM (SELECT DISTINCT s, p, o FROM t) GROUP BY p")
def triples_dedupe_count(s, d):
    """All graphs merged into one set."""
    merged = triples.as_set(triples.action_triples(views.actions(s, d)).withColumn("graph", F.lit("")))
    return merged.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query(TRIPLES + "SELECT md5(string_agg(s || ' ' || p || ' ' || o, ' ' ORDER BY s, p, o)) AS digest, graph, count(*) AS n FROM t WHERE p <> 'hasCondition' GROUP BY graph")
def triples_ntriples_round_trip(s, d):
    t = triples.action_triples(views.actions(s, d)).where("p <> 'hasCondition'")
    parts = triples.to_ntriples(t).withColumn("g", F.regexp_extract("value", "file_conv_([0-9]+)|file_conv_([0-9]+)%3A", 1))
    back = triples.from_ntriples(parts, F.regexp_extract("value", "file_conv_([0-9]+)", 1))
    lines = back.groupBy("graph").agg(F.sort_array(F.collect_list(F.struct("s", "p", "o"))).alias("x"), F.count(F.lit(1)).alias("n"))
    return lines.select(F.md5(F.array_join(F.transform("x", lambda v: F.concat_ws(" ", v["s"], v["p"], v["o"])), " ")).alias("digest"), "graph", "n")


@query(ACTION + "SELECT action_id AS id, package AS pkg, executable AS exe FROM action WHERE action_type = 'node'")
def bgp_star(s, d):
    P = triples.Pattern
    t = triples.action_triples(views.actions(s, d))
    return triples.solve(t, triples.Query([P("?a", "hasSpecificType", triples.ROS + "NodeAction"), P("?a", "hasActionId", "?id"), P("?a", "hasPackage", "?pkg"), P("?a", "hasExecutable", "?exe")])).select("id", "pkg", "exe")


@query(ACTION + "SELECT action_id AS id, package AS pkg, source_file AS file FROM action WHERE action_type = 'node'")
def bgp_chain_optional(s, d):
    P = triples.Pattern
    t = triples.action_triples(views.actions(s, d))
    q = triples.Query([P("?a", "hasActionId", "?id"), P("?a", "hasPackage", "?pkg")], optional=[[P("?a", "hasProvenance", "?prov"), P("?prov", "hasSourceFile", "?file")]])
    return triples.solve(t, q).select("id", "pkg", "file")


@query(ACTION + "SELECT action_id AS id, executable AS exe FROM action WHERE action_type = 'node' AND name IS NULL")
def bgp_not_exists(s, d):
    P = triples.Pattern
    t = triples.action_triples(views.actions(s, d))
    return triples.solve(t, triples.Query([P("?a", "hasActionId", "?id"), P("?a", "hasExecutable", "?exe")], absent=[[P("?a", "hasName", "?n")]])).select("id", "exe")


@query(COMM + "SELECT count(*) AS n, count(DISTINCT node_id) AS nodes FROM (SELECT node_id FROM pub UNION ALL SELECT node_id FROM sub)")
def bgp_communication(s, d):
    """Endpoints and their nodes, counted over the triple view."""
    t = triples.communication_triples(views.nodes(s, d), views.topics(s, d), views.pubs(s, d), views.subs(s, d))
    found = triples.match(t, triples.Pattern("?e", "fromNode", "?n"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("n").alias("nodes"))


def _descriptions(s, d):
    convs = table(s, d, "conversations").select("conv_id").distinct()
    kind = F.element_at(F.array(*map(F.lit, ("python", "xml", "yaml", "json"))), (F.col("conv_id") % 4 + 1).cast("int"))
    return triples.shred(convs, F.col("conv_id").cast("string"), T.resource("launch", F.col("conv_id").cast("string")), {"hasFormat": (kind, "string")}, ["LaunchDescription"])


def _violation(shape: str, path: str, constraint: str, where: str, focus: str = _S) -> str:
    return f"SELECT CAST(ld_id AS VARCHAR) AS graph, {focus} AS focus, '{shape}' AS shape, '{path}' AS path, '{constraint}' AS \"constraint\" FROM action WHERE {where}"


@query(ACTION + _violation("IncludeAction", "includesLaunch", "minCount", "action_type = 'include' AND included_launch_id = ''"))
def shacl_min_count(s, d):
    return shapes.violations(triples.action_triples(views.actions(s, d)), shapes.Shape("IncludeAction", "includesLaunch", 1))


@query(ACTION + _violation("LaunchAction", "hasActionId", "pattern", "NOT regexp_matches(stated_id, '^la:[^:]+:[0-9a-f]{8}#[0-9]+$')", f"{_RES}action/' || url_encode(stated_id)"))
def shacl_pattern(s, d):
    a = views.actions(s, d).withColumn("action_id", F.col("stated_id")).where(F.lit(True))
    return shapes.violations(triples.action_triples(a), shapes.SHAPES[3])


@query(f"SELECT DISTINCT CAST(conv_id AS VARCHAR) AS graph, {_RES}launch/' || CAST(conv_id AS VARCHAR) AS focus, 'LaunchDescription' AS shape, 'hasFormat' AS path, 'in' AS \"constraint\" FROM conversations WHERE conv_id % 4 = 3")
def shacl_in(s, d):
    return shapes.violations(_descriptions(s, d), shapes.SHAPES[1])


@query(ACTION + _violation("Provenance", "hasConfidence", "datatype", "source_file IS NOT NULL", _P))
def shacl_datatype(s, d):
    return shapes.violations(triples.action_triples(views.actions(s, d)), shapes.Shape("Provenance", "hasConfidence", 1, "string"))


@query(ACTION + """SELECT shape, path, "constraint", count(*) AS n FROM (SELECT 'LaunchDescription' AS shape, 'hasFormat' AS path, 'in' AS "constraint" FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 4 = 3)
UNION ALL SELECT 'LaunchDescription', 'hasLaunchFileId', 'minCount' FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT 'LaunchDescription', 'hasAction', 'minCount' FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT 'IncludeAction', 'includesLaunch', 'minCount' FROM action WHERE action_type = 'include' AND included_launch_id = ''
UNION ALL SELECT 'SetParameterAction', 'hasParameter', 'minCount' FROM action WHERE action_type = 'set_parameter' UNION ALL SELECT 'DeclareArgumentAction', 'hasArgumentName', 'minCount' FROM action WHERE action_type = 'declare_argument') GROUP BY ALL""")
def shacl_report(s, d):
    t = triples.action_triples(views.actions(s, d)).unionByName(_descriptions(s, d))
    return shapes.report(t).groupBy("shape", "path", "constraint").agg(F.count(F.lit(1)).alias("n"))


# Model document

_REAL = "action_type = 'node' AND package <> '__executable__'"


@query(ACTION + f"SELECT package, string_agg(DISTINCT executable, ',' ORDER BY executable) AS executables, count(DISTINCT file_id) AS files FROM action WHERE action_type = 'node' GROUP BY package")
def model_packages(s, d):
    return model.packages(views.actions(s, d))


@query(ACTION + """SELECT ld_id, package, n AS executables FROM (SELECT *, row_number() OVER (PARTITION BY ld_id ORDER BY n DESC, first) AS r FROM
(SELECT ld_id, package, count(DISTINCT executable) AS n, min(pos) AS first FROM action WHERE action_type = 'node' GROUP BY ld_id, package)) WHERE r = 1""")
def model_main_package(s, d):
    return model.main_package(views.actions(s, d))


@query("SELECT workspace, ld_id, 'exec_config_' || CAST(row_number() OVER (PARTITION BY workspace ORDER BY ld_id) AS VARCHAR) AS config_id FROM (SELECT DISTINCT conv_id % 10 AS workspace, conv_id AS ld_id FROM conversations)")
def model_exec_configs(s, d):
    return model.exec_configs(table(s, d, "conversations").selectExpr("conv_id % 10 AS workspace", "conv_id AS ld_id").distinct())


@query(ACTION + f"SELECT ld_id, count(*) FILTER ({_REAL}) AS nodes, count(*) FILTER (action_type = 'declare_argument') AS args, count(*) FILTER (action_type = 'include') AS includes, count(*) AS total FROM action GROUP BY ld_id")
def model_counts(s, d):
    return model.counts(views.actions(s, d))


# Sources


def _parsed(name: str, fmt: str, templates: dict[str, str], sql: str) -> None:
    def run(s, d):
        rows = LaunchModel(parse_documents(views.launch_documents(s, d, fmt, templates))).actions
        return rows.select("action_id", "action_type", "parent_id", "name", "package", "executable", "cond", "confidence")

    query(sql, name)(run)


for _fmt in views.LAUNCH:
    _parsed(f"parse_{_fmt}_launch", _fmt, views.LAUNCH, views.launch_sql(_fmt))
    _parsed(f"parse_{_fmt}_features", _fmt, views.FEATURES, views.feature_sql(_fmt))


@query(
    COMM + """, cand AS (SELECT 'isolated_node' AS issue_key, CAST(node_id AS VARCHAR) AS entity_id, runtime_name, CAST(NULL AS VARCHAR) AS topic_name FROM node WHERE node_id NOT IN (SELECT node_id FROM pub) AND node_id NOT IN (SELECT node_id FROM sub)
UNION ALL SELECT 'publisher_without_subscriber', endpoint_id, runtime_name, topic_name FROM pub JOIN topic USING (topic_id) JOIN node USING (node_id) WHERE topic_id NOT IN (SELECT topic_id FROM sub))
SELECT 'graphdb_' || issue_key || '_' || CASE WHEN rn < 1000 THEN lpad(CAST(rn AS VARCHAR), 3, '0') ELSE CAST(rn AS VARCHAR) END AS issue_id, entity_id, CASE issue_key WHEN 'isolated_node' THEN 'Node ''' || runtime_name || ''' neither publishes nor subscribes.' ELSE 'Nothing subscribes to ''' || topic_name || ''', which ''' || runtime_name || ''' publishes.' END AS description
FROM (SELECT *, row_number() OVER (PARTITION BY issue_key ORDER BY entity_id) AS rn FROM cand)"""
)
def comm_issues_numbered(s, d):
    """Rendered and numbered communication issues of the merged repository."""
    return communication.detect(views.architecture(s, d), scope="global", keys=("isolated_node", "publisher_without_subscriber"), prefix="graphdb", strict=False).select("issue_id", "entity_id", "description")


@query(
    COMM + ", t AS (SELECT CAST(node_id AS VARCHAR) AS s, 'hasRuntimeName' AS p, runtime_name AS o FROM node UNION SELECT CAST(node_id AS VARCHAR), 'hasPackage', package FROM node UNION SELECT CAST(topic_id AS VARCHAR), 'hasTopicName', topic_name FROM topic) SELECT p, count(*) AS n, count(DISTINCT o) AS n_values FROM t GROUP BY p"
)
def triples_predicates(s, d):
    """Counts of predicates of the communication triples, taken as a set."""
    a = views.architecture(s, d)
    t = triples.as_set(triples.communication_triples(a["nodes"], a["topics"], a["publications"], a["subscriptions"]))
    return t.where("p IN ('hasRuntimeName', 'hasPackage', 'hasTopicName')").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o").alias("n_values"))
