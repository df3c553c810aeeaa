"""XML and YAML launch files as items. Both read the same constructs; unset_env, executable, env, args and ros_args give nothing."""

from __future__ import annotations

import json
import re
from xml.etree import ElementTree

from fleetscope.functions.conditions import launch_condition

from .program import file_id, literal, parse_text


def normalise(text: str) -> str:
    return re.sub(r"\r\n?", "\n", text).rstrip("\n") + "\n"


def conditions(attributes: dict) -> list[str]:
    out = []
    if attributes.get("if"):
        out.append(json.dumps(launch_condition(attributes["if"]), ensure_ascii=False))
    if attributes.get("unless"):
        out.append(json.dumps(["not", launch_condition(attributes["unless"])], ensure_ascii=False))
    return out


def item(tag: str, a: dict, children: list[tuple[str, dict, list]]) -> dict | None:
    """An item for one element: its attributes, and its children as (tag, attributes, children). Ids are made of the text as it stands."""
    tag = tag.replace("_", "-")
    name, cond = a.get("name"), conditions(a)
    sub = lambda k: parse_text(a.get(k))
    if tag == "node":
        params = {c["name"]: parse_text(c.get("value")) for t, c, _ in children if t == "param" and c.get("name")}
        remaps = [{"from_topic": c.get("from") or "", "to_topic": parse_text(c.get("to") or "")} for t, c, _ in children if t == "remap"]
        text = f"Node(pkg={a.get('pkg')},exec={a.get('exec')},name={name})"
        return {"kind": "node", "package": sub("pkg"), "executable": sub("exec"), "name": sub("name"), "namespace": sub("namespace"), "parameters": params, "remappings": remaps, "conditions": cond, "snippet": text}
    if tag == "arg":
        return {"kind": "arg", "name": literal(name or ""), "default_value": parse_text(a.get("default", a.get("value"))), "description": a.get("description"), "snippet": f"arg_{name or ''}"}
    if tag in ("let", "set-env", "set-parameter"):
        kind = {"let": "let", "set-env": "set_env", "set-parameter": "set_param"}[tag]
        return {"kind": kind, "name": literal(name or ""), "value": sub("value"), "conditions": cond, "snippet": f"{kind}_{name or ''}"}
    if tag == "include":
        mappings = {c["name"]: parse_text(c.get("value", c.get("default"))) for t, c, _ in children if t in ("arg", "let") and c.get("name")}
        fid = file_id(a.get("file") or "unknown")
        return {"kind": "include", "included_launch_id": "launch_desc_" + fid, "argument_mappings": mappings, "conditions": cond, "snippet": f"include_{fid}"}
    if tag == "push-ros-namespace":
        return {"kind": "push_namespace", "namespace": sub("namespace"), "conditions": cond, "snippet": f"push_ns_{a.get('namespace')}"}
    if tag == "group":
        return {"kind": "group", "conditions": cond, "children": [x for c in children if (x := item(*c))], "snippet": "group"}
    return None


def _element(e: ElementTree.Element) -> tuple[str, dict, list]:
    return e.tag, dict(e.attrib), [_element(c) for c in e]


def read_xml(text: str) -> list[dict]:
    root = ElementTree.fromstring(normalise(text))
    if root.tag != "launch":
        raise ValueError("no launch element")
    return [x for c in root if (x := item(*_element(c)))]


#: Keys of a YAML entry that hold lists of child entries rather than attributes.
_LISTS = frozenset("remap param env arg let".split())


def _entry(tag: str, body: object) -> tuple[str, dict, list]:
    if isinstance(body, list):  # a group's body is its list of children
        return tag, {}, [c for x in body for c in _entries(x)]
    attributes, children = {}, []
    for k, v in (body or {}).items() if isinstance(body, dict) else ():
        if k in _LISTS and isinstance(v, (list, dict)):
            children += [(k, c, []) for c in (v if isinstance(v, list) else [v]) if isinstance(c, dict)]
        elif isinstance(v, list):
            children += [c for x in v for c in _entries(x)]
        elif isinstance(v, dict):
            children.append(_entry(k, v))
        else:
            attributes[k] = v
    return tag, attributes, children


def _entries(x: object) -> list[tuple[str, dict, list]]:
    """An entry is a mapping of one tag; keys beside it (if, unless) are its attributes."""
    if not isinstance(x, dict):
        return []
    out = []
    for tag, body in x.items():
        if isinstance(body, (dict, list)):
            out.append(_entry(tag, body))
    extra = {k: v for k, v in x.items() if not isinstance(v, (dict, list))}
    return [(t, {**extra, **a}, c) for t, a, c in out]


def plain(text: str) -> object:
    """A YAML document of dicts, lists and strings: what yaml's BaseLoader makes of it, every scalar a string, without its generators and tag tables."""
    import yaml

    loader = getattr(yaml, "CBaseLoader", yaml.BaseLoader)(text)
    made: dict[int, object] = {}  # by identity of the node, so that an anchor is built once; the document holds its nodes
    open_: set[int] = set()

    def build(node: yaml.Node) -> object:
        if type(node) is yaml.ScalarNode:
            return node.value
        key = id(node)
        if key in made:
            return made[key]
        if key in open_:
            raise yaml.constructor.ConstructorError(None, None, "found unconstructable recursive node", node.start_mark)
        open_.add(key)
        if type(node) is yaml.SequenceNode:
            out: object = [build(x) for x in node.value]
        else:
            out = {}
            for k, v in node.value:
                if type(k) is not yaml.ScalarNode:
                    raise yaml.constructor.ConstructorError("while constructing a mapping", node.start_mark, "found unhashable key", k.start_mark)
                out[k.value] = build(v)
        made[key] = out
        return out

    try:
        root = loader.get_single_node()
        return None if root is None else build(root)
    finally:
        loader.dispose()


def read_yaml(text: str) -> list[dict]:
    loaded = plain(normalise(text))
    if not isinstance(loaded, dict) or "launch" not in loaded:
        raise ValueError("no launch list")
    return [x for e in loaded["launch"] or [] for c in _entries(e) if (x := item(*c))]
