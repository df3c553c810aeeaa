"""Launch files of a folder tree as a model of DataFrames: one pass of Arrow-batched parsing, everything after it declarative."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.functions import text as T
from fleetscope.shared import kept
from fleetscope.shipping import arrow_schema, ship

from . import program

#: Suffixes of each format.
SUFFIXES = {"python": (".py",), "xml": (".xml",), "yaml": (".yaml", ".yml")}
CONFIDENCE = {"python": 0.85, "xml": 0.95, "yaml": 0.95}


def format_of(path: Column) -> Column:
    """The format that a path's suffix names; null for others."""
    out = F.lit(None).cast("string")
    for fmt, suffixes in SUFFIXES.items():
        for s in suffixes:
            out = F.when(path.endswith(s), fmt).otherwise(out)
    return out


def discover(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """(path, content, format) of the launch files below ``path``, or of that file; the suffix is checked before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select("path", "content", format_of(F.lower("path")).alias("format"))
    return rows.where(F.col("format").isNotNull() if fmt == "auto" else F.col("format") == fmt)


def parse(path: str, fmt: str, text: str) -> list[dict]:
    """The rows of one document; what can't be read gives one row with ``error``."""
    from . import markup, python_launch

    readers = {"python": python_launch.read_python, "xml": markup.read_xml, "yaml": markup.read_yaml}
    try:
        return program.rows(path, fmt, CONFIDENCE[fmt], readers[fmt](text)) or [program.described(path, fmt, CONFIDENCE[fmt])]
    except Exception as e:  # any text may be thrown at a parser; its row says what happened
        return [program.failed(path, fmt, f"{type(e).__name__}: {e}")]


#: Rows that leave a worker together: what it holds at once doesn't grow with the rows of a document.
BATCH_ROWS = 2048


def record_batch(rows: list[dict], target: pa.Schema) -> pa.RecordBatch:
    """Rows of program.SCHEMA; a map that is not there is an empty one."""
    for r in rows:
        for m in ("parameters", "argument_mappings"):
            r[m] = list((r[m] or {}).items())
    return pa.RecordBatch.from_pylist(rows, target)


def parse_documents(docs: DataFrame) -> DataFrame:
    """program.SCHEMA rows of documents (path, format, content: string or binary)."""
    ship(docs.sparkSession)
    schema = program.SCHEMA
    target = arrow_schema(schema)

    def run(batches):
        for b in batches:
            rows = []
            for path, fmt, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                rows += parse(path, fmt, content.decode("utf-8", "replace") if isinstance(content, bytes) else content or "")
                if len(rows) >= BATCH_ROWS:
                    yield record_batch(rows, target)
                    rows = []
            if rows:
                yield record_batch(rows, target)

    return docs.select("path", "format", "content").mapInArrow(run, schema)


def read_launch(spark: SparkSession, path: str, fmt: str = "auto", base: str | None = None) -> LaunchModel:
    """The launch files below ``path``. Ids are made of the path without ``base`` (and without the file system's prefix)."""
    rel = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    if base is not None:
        rel = F.when(rel.startswith(base), F.ltrim(F.substring(rel, len(base) + 1, 1 << 30), F.lit("/"))).otherwise(rel)
    return LaunchModel(parse_documents(discover(spark, path, fmt).withColumn("path", rel)))


def text_of(c: str) -> Column:
    return T.substitution_text(F.col(c))


@dataclass(eq=False)
class LaunchModel:
    """Launch programs: ``rows`` in program.SCHEMA, and the tables that rules, composition and export work on."""

    rows: DataFrame
    once: bool = False

    @cached_property
    def stored(self) -> LaunchModel:
        """This model with its rows in a table, so that files are parsed once however many rules and tables read them."""
        return self if self.once else LaunchModel(kept(self.rows, "launch"), True)

    @cached_property
    def descriptions(self) -> DataFrame:
        """(ld_id, launch_file_id, format, file_path, confidence), an empty program included."""
        return self.rows.where("error IS NULL").groupBy("ld_id").agg(*(F.first(c).alias(a) for c, a in (("file_id", "launch_file_id"), ("format", "format"), ("file_path", "file_path"), ("ld_confidence", "confidence"))))

    @cached_property
    def errors(self) -> DataFrame:
        return self.rows.where("error IS NOT NULL").select("file_path", "format", "error")

    @cached_property
    def actions(self) -> DataFrame:
        """One row an action, substitutions as text; ``cond`` is its conditions' text, null without any."""
        rows = self.rows.where("error IS NULL AND action_id IS NOT NULL")
        texts = [text_of(c).alias(c) for c in ("name", "package", "executable", "namespace", "default_value", "value")]
        return rows.select(
            "ld_id", "file_id", "format", "pos", "action_id", F.col("action_id").alias("map_key"), "action_type", "parent_id", "depth", *texts, "description", "choices", "target_scope", "ros_arguments", "launch_prefix",
            F.coalesce("included_launch_id", F.lit("")).alias("included_launch_id"), "conditions", F.when(F.size("conditions") > 0, F.array_join("conditions", "\n")).alias("cond"), "confidence", "source_file", F.coalesce(F.size("remappings"), F.lit(0)).alias("n_remappings"),
        )

    @cached_property
    def sequence(self) -> DataFrame:
        """(ld_id, pos, action_id): what no group holds."""
        return self.rows.where("error IS NULL AND action_id IS NOT NULL AND parent_id IS NULL").select("ld_id", "pos", "action_id")

    @cached_property
    def edges(self) -> DataFrame:
        """(ld_id, parent, child, pos)."""
        return self.rows.where("parent_id IS NOT NULL").select("ld_id", F.col("parent_id").alias("parent"), F.col("action_id").alias("child"), "pos")

    @cached_property
    def parameters(self) -> DataFrame:
        """(ld_id, action_id, name, value, dtype): parameters of nodes, set_parameter values and include arguments; dtype of literals that are no text."""
        rows = self.rows.where("error IS NULL AND action_id IS NOT NULL")
        held = rows.select("ld_id", "action_id", F.explode(F.when(F.col("action_type") == "include", F.col("argument_mappings")).otherwise(F.col("parameters"))).alias("name", "v"))
        own = rows.where("action_type = 'set_parameter'").select("ld_id", "action_id", text_of("name").alias("name"), text_of("value").alias("value"), "value.dtype")
        return held.select("ld_id", "action_id", "name", text_of("v").alias("value"), "v.dtype").unionByName(own)

    @cached_property
    def remappings(self) -> DataFrame:
        """(ld_id, action_id, pos, from_topic, to_topic)."""
        each = self.rows.where("error IS NULL").select("ld_id", "action_id", F.posexplode("remappings").alias("pos", "r"))
        return each.select("ld_id", "action_id", "pos", "r.from_topic", T.substitution_text(F.col("r.to_topic")).alias("to_topic"))

    @cached_property
    def conditions(self) -> DataFrame:
        """(ld_id, action_id, pos, condition)."""
        return self.rows.where("error IS NULL").select("ld_id", "action_id", F.posexplode("conditions").alias("pos", "condition"))

    def validate(self) -> DataFrame:
        from fleetscope.operators import validation

        return validation.validate(self.stored.actions, self.stored.sequence, self.stored.edges)

    def issues(self, catalog: DataFrame | None = None, timestamp: str | None = None) -> DataFrame:
        from fleetscope.operators import structural

        return structural.detect(self.stored.actions, catalog, timestamp)

    def triples(self) -> DataFrame:
        from fleetscope.operators import rdf

        return rdf.launch_triples(self.stored)

    def summary(self) -> DataFrame:
        """Counts of each description; a pseudo-node of a plain process is no node."""
        from fleetscope.operators import model

        return self.stored.descriptions.select("ld_id", "format", "file_path").join(model.counts(self.stored.actions), "ld_id", "left").na.fill(0)


# Documents of extracted programs


def _put(out: dict, **fields: object) -> dict:
    return out | {k: v for k, v in fields.items() if v not in (None, [], {})}


def _raw(s: dict | None) -> dict | None:
    """A substitution in the document's form."""
    if s is None:
        return None
    names = {"argument_reference": ("argument_name", "default_value"), "environment_variable": ("variable_name", "default_value"), "file_path": ("package", "relative_path")}
    if s["type"] in names:
        a, b = names[s["type"]]
        return _put({"type": s["type"], a: s["name"]}, **{b: s["value"]})
    if s["type"] == "expression":
        return {"type": "expression", "expression": json.loads(s["value"]) if s["value"] else s["value"]}
    return {"type": s["type"], "value": program.typed(s)}


def _source(path: str, confidence: float) -> dict:
    return {"extraction_method": "static_analysis", "confidence": confidence, "source_location": {"file_path": path}}


def document(rows: list[dict]) -> dict:
    """The document of one description's rows (in order of ``pos``)."""
    head, actions, children = rows[0], {}, {}
    for r in rows:
        if r["action_id"] is None:
            continue
        if r["parent_id"]:
            children.setdefault(r["parent_id"], []).append(r["action_id"])
        text = lambda s: None if s is None else s["value"]
        a = _put({"id": r["action_id"], "action_type": r["action_type"]}, conditions=[json.loads(c) for c in r["conditions"] or []]) | {"provenance": _source(r["source_file"], r["confidence"])}
        if r["action_type"] == "node":
            remaps = [_put({"from": m["from_topic"]}, to=_raw(m["to_topic"])) for m in r["remappings"] or []]
            a = _put(a, package=_raw(r["package"]), executable=_raw(r["executable"]), name=_raw(r["name"]), namespace=_raw(r["namespace"]), parameters={k: _raw(v) for k, v in r["parameters"]}, remappings=remaps, ros_arguments=r["ros_arguments"], launch_prefix=r["launch_prefix"])
        elif r["action_type"] == "declare_argument":
            a = _put(a | {"name": text(r["name"]) or ""}, default_value=_raw(r["default_value"]), description=r["description"], choices=r["choices"])
        elif r["action_type"] == "set_parameter":
            a = _put(a | {"name": text(r["name"]) or ""}, value=_raw(r["value"]), target_scope=r["target_scope"])
        elif r["action_type"] == "include":
            a = _put(a | {"included_launch_id": r["included_launch_id"]}, argument_mappings={k: _raw(v) for k, v in r["argument_mappings"]})
        elif r["action_type"] == "push_namespace":
            a = a | {"namespace": _raw(r["namespace"]), "children": []}
        elif r["action_type"] == "group":
            a = a | {"children": children.setdefault(r["action_id"], [])}
        actions[r["action_id"]] = a
    top = [r["action_id"] for r in rows if r["action_id"] and not r["parent_id"]]
    return {"id": head["ld_id"], "launch_file_id": head["file_id"], "format": head["format"], "actions": actions, "launch_sequence": top, "provenance": _source(head["file_path"], head["ld_confidence"]) | {"extractor_version": "fleetscope"}}


def to_documents(model: LaunchModel) -> DataFrame:
    """(ld_id, stem, document: JSON text) of each description; a file is small, so its rows are gathered by its id."""
    ship(model.rows.sparkSession)
    rows = model.rows.where("error IS NULL")
    each = rows.groupBy("ld_id").agg(F.min("file_path").alias("file_path"), F.sort_array(F.collect_list(F.struct("pos", *[c for c in rows.columns if c not in ("pos", "ld_id", "parameters", "argument_mappings")], F.map_entries("parameters").alias("parameters"), F.map_entries("argument_mappings").alias("argument_mappings")))).alias("rows"))

    def run(batches):
        for b in batches:
            said = []
            for ld, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for r in rows:
                    r["ld_id"] = ld
                    for m in ("parameters", "argument_mappings"):
                        r[m] = [(e["key"], e["value"]) for e in r[m] or []]
                said.append(json.dumps(document(rows), ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(said, pa.string())], names=["ld_id", "stem", "document"])

    return each.select("ld_id", "rows", stem(F.col("file_path")).alias("stem")).mapInArrow(run, "ld_id string, stem string, document string")


def stem(path: Column) -> Column:
    """``a/x.launch.py`` gives ``x.launch``: the last suffix goes. Files of one stem overwrite each other in a folder of documents."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"(?<=.)\.[^.]*$", "")


def relative_stem(path: Column) -> Column:
    """A document's path below a folder as one name: ``a/b.layer2.json`` gives ``a__b``."""
    return F.regexp_replace(F.regexp_replace(path, r"\.layer2\.json$|\.json$", ""), "/", "__")


def read_documents(spark: SparkSession, path: str) -> LaunchModel:
    """Extracted programs (one JSON document a file) as a model; results kept beside them (rdf, issues, architecture) are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    return documents_model(files.where(~F.col("path").rlike("/(rdf|issues|architecture)/")))


def documents_model(files: DataFrame) -> LaunchModel:
    """Extracted programs out of rows (path, content: one JSON document)."""
    ship(files.sparkSession)
    schema = program.SCHEMA
    target = arrow_schema(schema)

    def run(batches):
        for b in batches:
            rows = []
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += program.from_document(json.loads(content))
                except Exception as e:  # as in parse()
                    rows.append(program.failed(p, "json", f"{type(e).__name__}: {e}"))
                if len(rows) >= BATCH_ROWS:
                    yield record_batch(rows, target)
                    rows = []
            if rows:
                yield record_batch(rows, target)

    return LaunchModel(files.select("path", "content").mapInArrow(run, schema))
