"""Launch programs as rows: what the readers of all formats share.

A reader turns a document into items (dicts with a kind, fields, conditions and children); ``rows`` numbers them and gives the
schema's tuples. Bad documents give one row with ``error``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict

#: dtype: boolean, integer or decimal for a literal that is no text; its value is Python's text of it.
SUBST = "struct<type: string, name: string, value: string, dtype: string>"
COLUMNS = {
    **dict.fromkeys(("file_path", "file_id", "format", "ld_id"), "string"), "ld_confidence": "double", "pos": "int", **dict.fromkeys(("action_id", "action_type", "parent_id"), "string"), "depth": "int",
    **dict.fromkeys(("name", "package", "executable", "namespace", "default_value", "value"), SUBST), "description": "string", "choices": "array<string>", "target_scope": "string",
    "parameters": f"map<string, {SUBST}>", "remappings": f"array<struct<from_topic: string, to_topic: {SUBST}>>", "ros_arguments": "array<string>", "launch_prefix": "string",
    "included_launch_id": "string", "argument_mappings": f"map<string, {SUBST}>", "conditions": "array<string>", "confidence": "double", "source_file": "string", "error": "string",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in COLUMNS.items())
FIELDS = list(COLUMNS)


def subst(kind: str, name: str | None = None, value: str | None = None, dtype: str | None = None) -> dict:
    return {"type": kind, "name": name, "value": value} | ({"dtype": dtype} if dtype else {})


#: Datatypes of literals that are no text.
DTYPES = {bool: "boolean", int: "integer", float: "decimal"}


def literal(value: object) -> dict | None:
    return None if value is None else subst("literal", None, str(value), DTYPES.get(type(value)))


def typed(s: dict) -> object:
    """A literal's value in its own type."""
    read = {"boolean": lambda v: v == "True", "integer": int, "decimal": float}.get(s.get("dtype"))
    return s["value"] if read is None or s["value"] is None else read(s["value"])


_ARGUMENT = re.compile(r"\$\((?:var|arg)\s+([^)\s]+)\)")
_ENVIRONMENT = re.compile(r"\$\(env\s+([^)\s]+)(?:\s+([^)]*))?\)")
_SHARE = re.compile(r"\$\(find-pkg-share\s+([^)]+)\)/?(.*)")
_COMMENT, _SPACE, _NO_WORD = re.compile(r"#[^\n]*"), re.compile(r"\s+"), re.compile(r"[^a-zA-Z0-9_]")


def parse_text(text: str | None) -> dict | None:
    """Substitution text of XML and YAML files."""
    if text is None:
        return None
    t = text.strip()
    if not t.startswith("$("):
        return literal(text)
    if m := _ARGUMENT.fullmatch(t):
        return subst("argument_reference", m[1])
    if m := _ENVIRONMENT.fullmatch(t):
        return subst("environment_variable", m[1], m[2] or None)
    if m := _SHARE.fullmatch(t):
        return subst("file_path", m[1].strip(), m[2] or None)
    return literal(text)


def file_id(path: str) -> str:
    return "file_" + _NO_WORD.sub("_", path)


def digest(snippet: str) -> str:
    text = _SPACE.sub("", _COMMENT.sub("", snippet).replace("'", '"'))
    return hashlib.md5(text.encode()).hexdigest()[:8] if text else "00000000"


ACTION_TYPES = {"node": "node", "process": "node", "include": "include", "push_namespace": "push_namespace", "group": "group", "arg": "declare_argument", "let": "set_parameter", "set_env": "set_parameter", "set_param": "set_parameter"}
SCOPES = {"let": "local", "set_env": "global", "set_param": "local"}


def rows(path: str, fmt: str, confidence: float, items: list[dict]) -> list[dict]:
    fid = file_id(path)
    ordinals: dict[str, int] = defaultdict(int)
    out: list[dict] = []

    def walk(item: dict, parent: str | None, depth: int) -> None:
        h = digest(item["snippet"])
        action = f"la:{fid}:{h}#{ordinals[h]}"
        ordinals[h] += 1
        row = dict.fromkeys(FIELDS)
        row |= {k: v for k, v in item.items() if k in row}
        conditions = item.get("conditions") or []
        sure = item.get("confidence", 0.9 if conditions and (fmt == "python" or item["kind"] != "node") else 1.0)
        row |= {"file_path": path, "file_id": fid, "format": fmt, "ld_id": f"launch_desc_{fid}", "ld_confidence": confidence, "pos": len(out), "action_id": action, "action_type": ACTION_TYPES[item["kind"]], "parent_id": parent, "depth": depth,
                "target_scope": SCOPES.get(item["kind"]), "conditions": conditions, "confidence": sure, "source_file": path}
        out.append(row)
        for child in item.get("children") or []:
            walk(child, action, depth + 1)

    for item in items:
        walk(item, None, 0)
    return out


def failed(path: str, fmt: str, message: str) -> dict:
    row = dict.fromkeys(FIELDS)
    return row | {"file_path": path, "file_id": file_id(path), "format": fmt, "error": message[:500]}


def described(path: str, fmt: str, confidence: float) -> dict:
    """The row of a program without actions."""
    row = dict.fromkeys(FIELDS)
    return row | {"file_path": path, "file_id": file_id(path), "format": fmt, "ld_id": f"launch_desc_{file_id(path)}", "ld_confidence": confidence}


def _field(s: object) -> dict | None:
    """A substitution of a document, whose literals keep their JSON type."""
    if not isinstance(s, dict):
        return literal(s)
    kind = s.get("type")
    names = {"argument_reference": ("argument_name", "default_value"), "environment_variable": ("variable_name", "default_value"), "file_path": ("package", "relative_path")}
    if kind in names:
        a, b = names[kind]
        return subst(kind, s.get(a), None if s.get(b) is None else str(s[b]))
    if kind == "expression":
        return subst(kind, None, json.dumps(s.get("expression"), ensure_ascii=False))
    return literal(s.get("value"))


def from_document(d: dict) -> list[dict]:
    """The rows of a document; positions are those of the actions' order in it."""
    where = (d.get("provenance") or {}).get("source_location") or {}
    head = {"file_path": where.get("file_path") or d.get("launch_file_id"), "file_id": d.get("launch_file_id"), "format": d.get("format"), "ld_id": d["id"], "ld_confidence": (d.get("provenance") or {}).get("confidence")}
    parent = {c: k for k, a in d.get("actions", {}).items() for c in a.get("children") or []}
    out = []
    for pos, (key, a) in enumerate(d.get("actions", {}).items()):
        prov = a.get("provenance") or {}
        row = dict.fromkeys(FIELDS) | head | {"pos": pos, "action_id": a.get("id", key), "action_type": a.get("action_type"), "parent_id": parent.get(key), "conditions": [json.dumps(c, ensure_ascii=False) for c in a.get("conditions") or []]}
        row |= {"confidence": prov.get("confidence"), "source_file": (prov.get("source_location") or {}).get("file_path")}
        row |= {k: _field(a[k]) for k in ("name", "package", "executable", "namespace", "default_value", "value") if a.get(k) is not None}
        row |= {k: a[k] for k in ("description", "choices", "target_scope", "ros_arguments", "launch_prefix", "included_launch_id") if k in a}
        row |= {k: {n: _field(v) for n, v in (a.get(k) or {}).items()} for k in ("parameters", "argument_mappings")}
        if a.get("set_parameters"):
            row["parameters"] |= {n: _field(v) for n, v in a["set_parameters"].items()}
        pick = lambda m, *names: next((m[n] for n in names if m.get(n)), None)
        row["remappings"] = [{"from_topic": pick(m, "from", "from_topic", "src"), "to_topic": _field(pick(m, "to", "to_topic", "dst"))} for m in a.get("remappings") or []]
        out.append(row)
    return out or [dict.fromkeys(FIELDS) | head]
