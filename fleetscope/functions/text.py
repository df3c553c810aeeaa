"""Scalar functions of launch programs, all of them built-in expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def some(c: Column) -> Column:
    """Null for an empty string, so that coalesce passes it over."""
    return F.nullif(c, F.lit(""))


def normalize_snippet(c: Column) -> Column:
    """Source text for hashing: comments and all white space dropped, single quotes made double."""
    return F.regexp_replace(F.replace(F.regexp_replace(c, r"#[^\n]*", ""), F.lit("'"), F.lit('"')), r"\s+", "")


def action_hash(c: Column) -> Column:
    """Eight hex digits of the normalised snippet; zeros if nothing is left."""
    n = normalize_snippet(c)
    return F.when(n == "", F.lit("00000000")).otherwise(F.substring(F.md5(n), 1, 8))


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file_"), F.regexp_replace(path, "[^a-zA-Z0-9_]", "_"))


def action_id(file: Column, digest: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("la:"), file, F.lit(":"), digest, F.lit("#"), ordinal.cast("string"))


def short_id(c: Column) -> Column:
    """``#hash``, with the ordinal behind a dot where it is not 0."""
    digest, n = F.regexp_extract(c, r":([0-9a-f]{8})#(\d+)$", 1), F.regexp_extract(c, r":([0-9a-f]{8})#(\d+)$", 2)
    return F.when(digest == "", c).otherwise(F.concat(F.lit("#"), digest, F.when(n == "0", F.lit("")).otherwise(F.concat(F.lit("."), n))))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9_]+", "_"), "_+", "_")
    return F.coalesce(some(F.regexp_replace(s, "^_+|_+$", "")), F.lit("root"))


def topic_id(name: Column) -> Column:
    return F.concat(F.lit("topic:"), slug(name))


def runtime_node_id(name: Column) -> Column:
    return F.concat(F.lit("runtime_node:"), slug(name))


def endpoint_id(kind: Column, node: Column, topic: Column) -> Column:
    return F.concat(kind, F.lit(":"), slug(node), F.lit(":"), slug(topic))


def normalize_namespace(c: Column) -> Column:
    """Empty for the root and for unresolved text; else one leading and no trailing slash."""
    t = F.coalesce(F.trim(c), F.lit(""))
    body = F.regexp_replace(t, "/+$", "")
    return F.when((t == "") | t.contains("$(") | (body == ""), F.lit("")).when(body.startswith("/"), body).otherwise(F.concat(F.lit("/"), body))


def resolve_topic(topic: Column, namespace: Column | None = None) -> Column:
    """Absolute names stay, relative ones go below the namespace."""
    t = F.coalesce(F.trim(topic), F.lit(""))
    body = F.regexp_replace(t, "^/+|/+$", "")
    prefix = F.lit("") if namespace is None else normalize_namespace(namespace)
    return F.when(t.startswith("/"), F.concat(F.lit("/"), body)).otherwise(F.concat(prefix, F.lit("/"), body))


def topic_matches(a: Column, b: Column) -> Column:
    return (a == b) | (resolve_topic(a) == resolve_topic(b))


def encode_uri(c: Column) -> Column:
    """Percent-encoding with no safe characters but letters, digits and ``-._~``."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def resource(kind: str, c: Column) -> Column:
    return F.concat(F.lit(f"http://example.org/ros-launch/resource/{kind}/"), encode_uri(c))


_ARG = r"^\$\((?:var|arg) +([^) ]+)\)$"
_ENV = r"^\$\(env +([^) ]+)(?: +([^)]*))?\)$"
_PKG = r"^\$\(find-pkg-share +([^)]+)\)/?(.*)$"


def parse_substitution(c: Column) -> Column:
    """Struct of type, name and default (or package and path, or the literal) of substitution text."""
    t = F.trim(c)
    arg, env, pkg = F.regexp_extract(t, _ARG, 1), F.regexp_extract(t, _ENV, 1), F.regexp_extract(t, _PKG, 1)
    kind = F.when(arg != "", "argument_reference").when(env != "", "environment_variable").when(pkg != "", "file_path").otherwise("literal")
    name = F.when(arg != "", arg).when(env != "", env).when(pkg != "", F.trim(pkg))
    rest = F.when(arg != "", F.lit(None)).when(env != "", some(F.regexp_extract(t, _ENV, 2))).when(pkg != "", some(F.regexp_extract(t, _PKG, 2))).otherwise(c)
    return F.struct(kind.alias("type"), name.alias("name"), rest.alias("value"))


def substitution_text(s: Column) -> Column:
    """A parsed substitution as launch text: an argument stands without its default, an environment variable's follows a blank."""
    return F.when(s["type"] == "argument_reference", F.concat(F.lit("$(arg "), s["name"], F.lit(")"))).otherwise(_written(s, " "))


def display_substitution(s: Column) -> Column:
    """A parsed substitution for people: defaults follow an equals sign."""
    return _written(s, "=")


def _written(s: Column, gap: str) -> Column:
    kind, name, value = s["type"], s["name"], s["value"]
    default = F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(gap), value))
    return (
        F.when(kind == "argument_reference", F.concat(F.lit("$(arg "), name, default, F.lit(")")))
        .when(kind == "environment_variable", F.concat(F.lit("$(env "), name, default, F.lit(")")))
        .when(kind == "file_path", F.concat(F.lit("$(find-pkg-share "), name, F.lit(")"), F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), value))))
        .when(kind == "expression", F.concat(F.lit("$(expr "), value, F.lit(")")))
        .otherwise(value)
    )


def render_strict(template: Column, values: dict[str, Column]) -> Column:
    """Every known key replaced (null as nothing); with a key of the template unknown, the template and a note of the first such key."""
    out = template
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    holes = F.filter(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), 1), lambda k: ~k.isin(*values) if values else F.lit(True))
    return F.when(F.size(holes) > 0, F.concat(template, F.lit(" [missing_context="), F.get(holes, 0), F.lit("]"))).otherwise(out)


def render_lenient(template: Column, values: dict[str, Column]) -> Column:
    """Keys that are unknown or null stay as they are."""
    out = template
    for k, v in values.items():
        out = F.when(v.isNull(), out).otherwise(F.replace(out, F.lit("{" + k + "}"), v.cast("string")))
    return out


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def include_display(c: Column) -> Column:
    """The file name of an included launch id, as far as it can be told: suffixes get their dots back, a dynamic path keeps its last part."""

    def dotted(x: Column) -> Column:
        return F.regexp_replace(x, "_launch_(py|xml|yaml)$", ".launch.$1")

    clean = dotted(F.regexp_replace(c, "^launch_desc_file_", ""))
    last = F.regexp_extract(c, "_____([a-z][a-z0-9_]+_launch(?:_py|_xml|_yaml)?)__+$", 1)
    tail = F.regexp_extract(clean, r"[a-z][a-z0-9_]+\.launch(?:\.py|\.xml|\.yaml)?$", 0)
    dynamic = clean.contains("type") | clean.contains("var")
    return F.when(~dynamic, clean).when(last != "", dotted(last)).when(tail != "", tail).otherwise(truncate(clean, 70))


def contains_value(json: Column, value: str | float | bool | None) -> Column:
    """Whether a JSON text holds ``value`` anywhere as a value (not as a key)."""
    import json as _json

    text = F.lit(_json.dumps(value, ensure_ascii=False))
    bare = F.regexp_replace(json, r'"((?:[^"\\]|\\.)*)"\s*:', ":")  # keys go
    if isinstance(value, str):
        return bare.contains(text)
    return F.regexp_replace(bare, r'"((?:[^"\\]|\\.)*)"', '""').rlike(rf"(^|[\[,:\s]){_json.dumps(value)}($|[\],}}\s])".replace(".", r"\."))


def unresolved_include(c: Column) -> Column:
    return c.contains("os_path_join") | c.contains("type____var") | c.contains("type____launch")


def numbered(n: Column) -> Column:
    """At least three digits."""
    return F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))
