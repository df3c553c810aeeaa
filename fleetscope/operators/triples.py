"""A triple view of entity tables, and basic graph patterns over it.

Triples are (graph, s, p, o, kind, dtype). The patterns of a star around one subject whose predicates have few values are
answered in one pass with conditional aggregates; other patterns become equi-joins, in an order in which each shares a variable
with those before it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import text as T

ROS = "http://example.org/ros-launch#"


def shred(rows: DataFrame, graph: Column, subject: Column, properties: dict[str, tuple[Column, str | Column]], types: list[str]) -> DataFrame:
    """An entity's triples: one explode of an array of structs; null values give none. Kinds are iri, string, decimal, integer and boolean, or a column of those."""
    parts = [F.struct(F.lit("type").alias("p"), F.lit(ROS + t).alias("o"), F.lit("iri").alias("kind"), F.lit(None).cast("string").alias("dtype")) for t in types]
    for p, (value, kind) in properties.items():
        iri = isinstance(kind, str) and kind == "iri"
        dtype = F.lit(None).cast("string") if iri else F.lit(kind) if isinstance(kind, str) else kind
        parts.append(F.struct(F.lit(p).alias("p"), value.cast("string").alias("o"), F.lit("iri" if iri else "lit").alias("kind"), dtype.alias("dtype")))
    out = rows.select(graph.alias("graph"), subject.alias("s"), F.explode(F.array(*parts)).alias("t"))
    return out.select("graph", "s", "t.*").where("o IS NOT NULL")


TYPES = {"node": "NodeAction", "declare_argument": "DeclareArgumentAction", "include": "IncludeAction", "push_namespace": "PushNamespaceAction", "set_parameter": "SetParameterAction", "group": "GroupAction"}


def action_triples(actions: DataFrame) -> DataFrame:
    """Both types, the literal fields, and a provenance node with file and confidence, of every action."""
    s = T.resource("action", F.col("action_id"))
    kind = reduce(lambda c, kv: c.when(F.col("action_type") == kv[0], F.lit(ROS + kv[1])), list(TYPES.items())[1:], F.when(F.col("action_type") == "node", F.lit(ROS + TYPES["node"])))
    prov = F.when(F.col("source_file").isNotNull(), T.resource("provenance", F.col("action_id")))
    own = shred(
        actions, F.col("ld_id").cast("string"), s,
        {
            "hasSpecificType": (kind, "iri"), "hasActionId": (F.col("action_id"), "string"), "hasName": (F.col("name"), "string"), "hasNamespace": (F.col("namespace"), "string"),
            "hasPackage": (F.when(F.col("action_type") == "node", F.col("package")), "string"), "hasExecutable": (F.when(F.col("action_type") == "node", F.col("executable")), "string"),
            "hasDefaultValue": (F.when(F.col("action_type") == "declare_argument", F.col("default_value")), "string"),
            "includesLaunch": (F.when((F.col("action_type") == "include") & (F.col("included_launch_id") != ""), T.resource("launch", F.col("included_launch_id"))), "iri"),
            "hasCondition": (F.col("cond"), "string"), "hasProvenance": (prov, "iri"),
        },
        ["LaunchAction"],
    )
    located = shred(actions.where("source_file IS NOT NULL"), F.col("ld_id").cast("string"), T.resource("provenance", F.col("action_id")), {"hasSourceFile": (F.col("source_file"), "string"), "hasConfidence": (F.col("confidence"), "decimal")}, ["Provenance"])
    return own.unionByName(located)


def child_triples(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("ld_id").cast("string").alias("graph"), T.resource("action", F.col("parent").cast("string")).alias("s"), F.lit("hasChildAction").alias("p"), T.resource("action", F.col("child").cast("string")).alias("o"), F.lit("iri").alias("kind"), F.lit(None).cast("string").alias("dtype"))


def communication_triples(nodes: DataFrame, topics: DataFrame, pubs: DataFrame, subs: DataFrame) -> DataFrame:
    """Runtime nodes, topics, publications and subscriptions with their links and quality of service."""
    text = lambda c: (F.col(c), "string")

    def ends(rows: DataFrame, kind: str, link: str) -> DataFrame:
        s, node = T.resource(kind, F.col("endpoint_id")), T.resource("runtime_node", F.col("node_id").cast("string"))
        own = shred(rows, F.lit(""), s, {"onTopic": (T.resource("topic", F.col("topic_id").cast("string")), "iri"), "fromNode": (node, "iri"), "hasMessageType": text("msg_type"), "hasReliability": text("reliability")}, [kind.capitalize()])
        return own.unionByName(shred(rows, F.lit(""), node, {link: (s, "iri")}, []))

    parts = [
        shred(nodes, F.lit(""), T.resource("runtime_node", F.col("node_id").cast("string")), {"hasRuntimeName": text("runtime_name"), "hasPackage": text("package"), "hasExecutable": text("executable")}, ["RuntimeNode"]),
        shred(topics, F.lit(""), T.resource("topic", F.col("topic_id").cast("string")), {"hasTopicName": text("topic_name")}, ["Topic"]),
        ends(pubs, "publication", "publishes"),
        ends(subs, "subscription", "subscribes"),
    ]
    return reduce(DataFrame.unionByName, parts)


def as_set(triples: DataFrame) -> DataFrame:
    return triples.dropDuplicates(["graph", "s", "p", "o"])


def to_ntriples(triples: DataFrame) -> DataFrame:
    """One line of N-Triples a row, in the column ``value``."""
    esc = F.replace(F.replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    p = F.when(F.col("p") == "type", F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#type")).otherwise(F.concat(F.lit(ROS), "p"))
    o = F.when(F.col("kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), esc, F.lit('"'), F.when(F.col("dtype").isin("decimal", "integer", "boolean"), F.concat(F.lit("^^<http://www.w3.org/2001/XMLSchema#"), "dtype", F.lit(">"))).otherwise("")))
    return triples.select(F.concat(F.lit("<"), "s", F.lit("> <"), p, F.lit("> "), o, F.lit(" .")).alias("value"))


_LINE = r'^<([^>]*)> <([^>]*)> (?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:\^\^<[^#>]*#(\w+)>)?) \.$'


def from_ntriples(lines: DataFrame, graph: Column) -> DataFrame:
    part = lambda i: F.regexp_extract("value", _LINE, i)
    lit = F.replace(F.replace(F.replace(part(4), F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    rows = lines.where(F.col("value").rlike(_LINE))
    return rows.select(graph.alias("graph"), part(1).alias("s"), F.regexp_replace(part(2), "^.*[#/]", "").alias("p"), F.when(part(3) != "", part(3)).otherwise(lit).alias("o"), F.when(part(3) != "", "iri").otherwise("lit").alias("kind"), F.when(part(3) != "", F.lit(None)).otherwise(F.coalesce(T.some(part(5)), F.lit("string"))).alias("dtype"))


@dataclass
class Pattern:
    """subject and object are variables (``?x``), or constants; predicates are constants."""

    subject: str
    predicate: str
    object: str


@dataclass
class Query:
    required: list[Pattern]
    optional: list[list[Pattern]] = field(default_factory=list)
    absent: list[list[Pattern]] = field(default_factory=list)


def match(triples: DataFrame, p: Pattern) -> DataFrame:
    rows = triples.where(F.col("p") == p.predicate)
    columns = []
    if p.subject == p.object and p.subject.startswith("?"):  # one variable: one column, and an equality
        return rows.where("s = o").select("graph", F.col("s").alias(p.subject[1:]))
    for side, term in (("s", p.subject), ("o", p.object)):
        if term.startswith("?"):
            columns.append(F.col(side).alias(term[1:]))
        else:
            rows = rows.where(F.col(side) == term)
    return rows.select(F.col("graph"), *columns)


#: Predicates that a subject has one value of in each graph, or a few.
SINGLE = frozenset(
    "hasSpecificType hasActionId hasName hasNamespace hasPackage hasExecutable hasNodeName hasDefaultValue hasArgumentName hasTargetScope includesLaunch hasProvenance hasSourceFile hasConfidence hasLaunchFileId hasFormat"
    " hasRuntimeName hasTopicId hasTopicName hasMessageType hasReliability onTopic fromNode remapFrom remapTo hasParameterName hasParameterValue hasConditionExpression".split()
)


def star(triples: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Patterns around one subject variable in one pass: the sets of their predicates' values by subject, then every combination of them."""
    subject = patterns[0].subject[1:]
    predicates = list(dict.fromkeys(p.predicate for p in patterns))
    sets = [F.collect_set(F.when(F.col("p") == p, F.col("o"))).alias(f"_{i}") for i, p in enumerate(predicates)]
    rows = triples.where(F.col("p").isin(*predicates)).groupBy("graph", F.col("s").alias(subject)).agg(*sets).where(" AND ".join(f"size(_{i}) > 0" for i in range(len(predicates))))
    for p in patterns:
        values = F.col(f"_{predicates.index(p.predicate)}")
        name = p.object[1:]
        if not p.object.startswith("?"):
            rows = rows.where(F.array_contains(values, p.object))
        elif name in rows.columns:
            rows = rows.where(F.array_contains(values, F.col(name)))
        else:
            rows = rows.withColumn(name, F.explode(values))
    return rows.drop(*(f"_{i}" for i in range(len(predicates))))


def _parts(triples: DataFrame, patterns: list[Pattern]) -> list[DataFrame]:
    stars: dict[str, list[Pattern]] = {}
    for p in patterns:
        if p.subject.startswith("?") and p.predicate in SINGLE and p.subject != p.object:
            stars.setdefault(p.subject, []).append(p)
    starred = {id(p) for group in stars.values() if len(group) > 1 for p in group}
    return [star(triples, group) for group in stars.values() if len(group) > 1] + [match(triples, p) for p in patterns if id(p) not in starred]


def _joined(triples: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Stars first, then the patterns that share a variable with what is there; a pattern that never does would multiply rows and is refused."""
    out, *rest = _parts(triples, patterns)
    while rest:
        i = next((i for i, x in enumerate(rest) if len(set(x.columns) & set(out.columns)) > 1), None)
        if i is None:
            raise ValueError("patterns without a common variable would give a product")
        new = rest.pop(i)
        out = out.join(new, [c for c in out.columns if c in new.columns])
    return out


def solve(triples: DataFrame, q: Query) -> DataFrame:
    """Bindings: required patterns by inner, optional groups by left, absent groups by left anti joins on their shared variables."""
    out = _joined(triples, q.required)
    for kind, groups in (("left", q.optional), ("left_anti", q.absent)):
        for g in groups:
            other = _joined(triples, g)
            out = out.join(other, [c for c in out.columns if c in other.columns], kind)
    return out


class Repository:
    """A table of triples in place of a triplestore, with a column for the graph; clear, upload and query are table operations."""

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path

    def clear(self) -> None:
        empty = "graph string, s string, p string, o string, kind string, dtype string"
        self.spark.createDataFrame([], empty).write.mode("overwrite").parquet(self.path)

    def upload(self, triples: DataFrame, graph: str | None = None) -> None:
        rows = triples if graph is None else triples.withColumn("graph", F.lit(graph))
        rows.select("graph", "s", "p", "o", "kind", "dtype").write.mode("append").parquet(self.path)

    def triples(self, merged: bool = True) -> DataFrame:
        """All graphs as one set, or each for itself."""
        rows = self.spark.read.parquet(self.path)
        return as_set(rows.withColumn("graph", F.lit("")) if merged else rows)

    def query(self, q: Query) -> DataFrame:
        return solve(self.triples(), q)
