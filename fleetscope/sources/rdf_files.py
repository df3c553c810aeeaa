"""Triples of RDF files, by suffix: N-Triples line by line in built-in expressions; Turtle, RDF/XML and expanded JSON-LD a file at a time.

Turtle is read without blank-node lists and collections, RDF/XML without nested nodes. What can't be read gives one row with ``error``.
"""

from __future__ import annotations

import json
import re
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.operators.triples import from_ntriples
from fleetscope.shipping import arrow_schema, ship

RDF, RDFS, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2001/XMLSchema#"
SCHEMA = "graph string, s string, p string, o string, kind string, dtype string, error string"
_TOKEN = re.compile(r'\s+|#[^\n]*|(?P<iri><[^>\s]*>)|(?P<long>"""(?:[^\\]|\\.)*?""")|(?P<text>"(?:[^"\\\n]|\\.)*")|(?P<type>\^\^)|(?P<lang>@[A-Za-z][\w-]*)|(?P<number>[+-]?(?:\d+\.\d+|\d+)(?![\w:]))|(?P<name>[A-Za-z_][\w.-]*(?<!\.))?(?P<colon>:)(?P<local>(?:[\w%-]|\.(?=[\w%-])|\\.)*)|(?P<word>[A-Za-z]+)|(?P<mark>[.;,])', re.S)


def short(predicate: str) -> str:
    """Predicates are kept by their local name, as the exporter writes them."""
    return re.sub(r"^.*[#/]", "", predicate)


def _literal(text: str, dtype: str | None) -> tuple[str, str, str]:
    return text, "lit", short(dtype) if dtype else "string"


def _unescaped(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text)


def turtle(text: str) -> list[tuple]:
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not read: {text[at : at + 30]!r}")
        at = m.end()
        if m.lastgroup:
            tokens.append(m)
    prefixes: dict[str, str] = {}
    i = 0

    def term() -> tuple[str, str, str | None]:
        nonlocal i
        m = tokens[i]
        i += 1
        if m["iri"]:
            return m["iri"][1:-1], "iri", None
        if m["colon"]:
            return prefixes[m["name"] or ""] + re.sub(r"\\(.)", r"\1", m["local"]), "iri", None
        if m["text"] or m["long"]:
            value = _unescaped(m["long"][3:-3] if m["long"] else m["text"][1:-1])
            if i < len(tokens) and tokens[i]["type"]:
                i += 1
                return _literal(value, term()[0])
            i += i < len(tokens) and bool(tokens[i]["lang"])
            return _literal(value, None)
        if m["number"]:
            return _literal(m["number"], XSD + ("decimal" if "." in m["number"] else "integer"))
        if m["word"] == "a":
            return RDF + "type", "iri", None
        if m["word"] in ("true", "false"):
            return _literal(m["word"], XSD + "boolean")
        raise ValueError(f"not expected: {m[0]!r}")

    out = []
    while i < len(tokens):
        m = tokens[i]
        if m["lang"] == "@prefix" or (m["word"] or "").upper() == "PREFIX":
            prefixes[tokens[i + 1]["name"] or ""] = tokens[i + 2]["iri"][1:-1]
            i += 3 + (i + 3 < len(tokens) and tokens[i + 3]["mark"] == "." and m["lang"] is not None)
            continue
        s = term()[0]
        while True:
            p = term()[0]
            while True:
                out.append((s, short(p), *term()))
                if tokens[i]["mark"] != ",":
                    break
                i += 1
            while tokens[i]["mark"] == ";":
                i += 1
            if tokens[i]["mark"] == ".":
                i += 1
                break
    return out


def rdf_xml(text: str) -> list[tuple]:
    split = lambda tag: tag[1:].replace("}", "", 1) if tag[0] == "{" else tag
    out = []
    for node in ElementTree.fromstring(text):
        s = node.get(f"{{{RDF}}}about", "")
        if split(node.tag) != RDF + "Description":
            out.append((s, "type", split(node.tag), "iri", None))
        for e in node:
            link = e.get(f"{{{RDF}}}resource")
            out.append((s, short(split(e.tag)), *((link, "iri", None) if link is not None else _literal(e.text or "", e.get(f"{{{RDF}}}datatype")))))
    return out


def json_ld(text: str) -> list[tuple]:
    out = []
    for node in json.loads(text):
        out += [(node["@id"], "type", t, "iri", None) for t in node.get("@type", [])]
        for p, values in node.items():
            if not p.startswith("@"):
                for v in values:
                    value = v.get("@value")
                    dtype = v.get("@type") or {bool: XSD + "boolean", int: XSD + "integer", float: XSD + "decimal"}.get(type(value))
                    out.append((node["@id"], short(p), *((v["@id"], "iri", None) if "@id" in v else _literal(json.dumps(value) if not isinstance(value, str) else value, dtype))))
    return out


READERS = {".ttl": turtle, ".rdf": rdf_xml, ".xml": rdf_xml, ".jsonld": json_ld, ".json": json_ld}


def read_rdf(spark: SparkSession, path: str, exclude: str = "architecture") -> DataFrame:
    """(graph, s, p, o, kind, dtype, error) of the files below ``path``, the file's path as graph; folders of the name ``exclude`` are passed over."""
    fine = ~F.col("graph").rlike(f"/{exclude}/") if exclude else F.lit(True)
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.nt").text(path).select("value", F.input_file_name().alias("file"))
    plain = from_ntriples(lines, F.col("file")).withColumn("error", F.lit(None).cast("string"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{ttl,rdf,xml,jsonld,json}").load(path)
    ship(spark)
    target = arrow_schema(SCHEMA)

    def run(batches):
        for b in batches:
            rows = []
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(file, *t, None) for t in READERS["." + file.rpartition(".")[2].lower()](content.decode("utf-8", "replace"))]
                except Exception as e:  # any text may be thrown at a parser; its row says what happened
                    rows.append((file, *[None] * 5, f"{type(e).__name__}: {e}"[:500]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 7, schema=target)

    return plain.unionByName(files.select("path", "content").mapInArrow(run, SCHEMA)).where(fine)
