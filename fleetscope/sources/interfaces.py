"""Node-interface annotations (YAML) as flat tables: implementations with their selectors, endpoints, runtime bindings."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.shipping import arrow_schema, ship

_END = "struct<kind: string, pos: int, endpoint_id: string, topic_name: string, msg_type: string, reliability: string, durability: string, history: string, depth: int, provenance: string>"
_IMPL = f"struct<pos: int, impl_id: string, package: string, executable: string, name: string, namespace: string, action_id: string, runtime_name: string, node_namespace: string, node_type: string, language: string, provenance: string, endpoints: array<{_END}>>"
_BIND = "struct<pos: int, impl_id: string, selector: map<string, string>, runtime_name: string, namespace: string>"
SCHEMA = f"path string, graph string, configuration_id string, impls array<{_IMPL}>, bindings array<{_BIND}>, error string"


def _text(x: object) -> str | None:
    return None if x is None else str(x)


def provenance(of_impl: dict, end: dict) -> dict:
    """The endpoint's over the implementation's; evidence becomes notes where there are none, validation_status joins the context."""
    out = {**of_impl, **(end.get("provenance") or {})}
    if end.get("evidence"):
        out.setdefault("notes", end["evidence"])
    if end.get("validation_status"):
        out["extraction_context"] = {**(out.get("extraction_context") or {}), "validation_status": end["validation_status"]}
    return out


def implementation(pos: int, impl: dict) -> dict:
    sel = dict(impl.get("selector") or {})
    for key, field in (("package", "package"), ("executable", "executable"), ("name", "node_name")):
        if impl.get(field):
            sel.setdefault(key, impl[field])
    ends = []
    for kind, field in (("pub", "publishers"), ("sub", "subscriptions")):
        for i, e in enumerate(impl.get(field) or []):
            qos = e.get("qos_profile") or {}
            ends.append({
                "kind": kind, "pos": i, "endpoint_id": _text(e.get("id")), "topic_name": _text(e.get("topic_name")), "msg_type": _text(e.get("message_type")), **{q: _text(qos.get(q)) for q in ("reliability", "durability", "history")},
                "depth": None if qos.get("depth") is None else int(qos["depth"]), "provenance": json.dumps(provenance(impl.get("provenance") or {}, e), ensure_ascii=False, default=str),
            })
    strange = [k for k, v in sel.items() if k not in ("package", "executable", "name", "namespace", "action_id") and v is not None]
    return {
        "pos": pos, "impl_id": str(impl.get("id") or f"node_impl:{sel.get('package') or 'unknown_pkg'}:{sel.get('executable') or 'unknown_exec'}"), **{k: _text(sel.get(k)) for k in ("package", "executable", "name", "namespace")},
        "action_id": f"no action has {strange}" if strange and not sel.get("action_id") else _text(sel.get("action_id")) or None,  # a key that no action has fits none
        "runtime_name": _text(impl.get("runtime_name")), "node_namespace": _text(impl.get("node_namespace")), "node_type": _text(impl.get("node_type")), "language": _text(impl.get("language")),
        "provenance": json.dumps(impl.get("provenance") or {}, ensure_ascii=False, default=str), "endpoints": ends,
    }


def parse(path: str, text: str) -> dict:
    import yaml

    row = dict.fromkeys(("path", "graph", "configuration_id", "impls", "bindings", "error")) | {"path": path}
    try:
        d = yaml.safe_load(text) or {}
        impls = d.get("node_implementations")
        if not impls:
            raise ValueError("node_implementations expected; the format of nodes, publishes and subscribes is not read")
        binds = [{"pos": i, "impl_id": _text(b.get("node_implementation_id")), "selector": [(str(k), _text(v)) for k, v in (b.get("selector") or {}).items()], "runtime_name": _text(b.get("runtime_name")), "namespace": _text(b.get("namespace"))} for i, b in enumerate(d.get("runtime_bindings") or [])]
        return row | {"graph": _text(d.get("architecture_id")), "configuration_id": str(d.get("configuration_id", "default")), "impls": [implementation(i, x) for i, x in enumerate(impls)], "bindings": binds}
    except Exception as e:  # any text may be thrown at a parser; its row says what happened
        return row | {"error": f"{type(e).__name__}: {e}"[:500]}


@dataclass(eq=False)
class Interfaces:
    """``files``: SCHEMA rows. Files without an architecture id take one from their launch description when they are paired with it."""

    files: DataFrame

    def strict(self) -> Interfaces:
        """Fails on the first file that can't be read."""
        bad = self.files.where("error IS NOT NULL").select("path", "error").first()
        if bad:
            raise ValueError(f"{bad['path']}: {bad['error']}")
        return self

    def paired(self, descriptions: DataFrame) -> Interfaces:
        """With the description (path, ld_id, launch_file_id) that each file annotates; files that are in no pair go."""
        rows = self.files.where("error IS NULL").join(descriptions.select("path", "ld_id", "launch_file_id"), "path")
        return Interfaces(rows.withColumn("graph", F.coalesce("graph", F.concat(F.lit("architecture:"), "launch_file_id"))))

    @property
    def impls(self) -> DataFrame:
        keys = ["graph", *(c for c in ("ld_id",) if c in self.files.columns)]
        return self.files.select(*keys, F.explode("impls").alias("i")).select(*keys, "i.*").drop("endpoints")

    @property
    def endpoints(self) -> DataFrame:
        each = self.files.select("graph", F.explode("impls").alias("i")).select("graph", "i.impl_id", F.explode("i.endpoints").alias("e"))
        return each.select("graph", "impl_id", "e.*")

    @property
    def bindings(self) -> DataFrame:
        return self.files.select("graph", F.explode("bindings").alias("b")).select("graph", "b.*")


def read_interfaces(spark: SparkSession, path: str) -> Interfaces:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.y*ml").load(path)
    ship(spark)
    schema = SCHEMA
    target = arrow_schema(schema)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([parse(p, c.decode("utf-8", "replace")) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], target)

    return Interfaces(files.select("path", "content").mapInArrow(run, schema))


def compose(model, interfaces: Interfaces, use_launch_namespace: bool = False) -> dict[str, DataFrame]:
    """The runtime architectures of paired interfaces over a launch model."""
    from fleetscope.operators import compose as C

    return C.build(interfaces.impls, interfaces.endpoints, model.actions, model.remappings, interfaces.bindings, use_launch_namespace)
