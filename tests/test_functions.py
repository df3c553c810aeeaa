import json

import pytest
from pyspark.sql import functions as F

from fleetscope.functions import conditions as C
from fleetscope.functions import text as T

PAIRS = [
    (T.normalize_snippet, "a = 'x'  # c", 'a="x"'), (T.action_hash, "Node(pkg=demo_nodes_cpp,exec=talker,name=talker_node)", "190a4ef8"), (T.action_hash, " # nothing", "00000000"), (T.file_id, "examples/a-b/c.launch.py", "file_examples_a_b_c_launch_py"),
    (T.slug, "/robot//odom/", "robot_odom"), (T.slug, "/", "root"), (T.slug, " a-b ", "a_b"), (T.slug, "", "root"), (T.topic_id, "/a/b", "topic:a_b"), (T.topic_id, "/a_b", "topic:a_b"),
    (T.normalize_namespace, "robot", "/robot"), (T.normalize_namespace, "/robot/", "/robot"), (T.normalize_namespace, "/", ""), (T.normalize_namespace, "$(arg ns)", ""), (T.normalize_namespace, None, ""),
    (T.resolve_topic, "scan", "/scan"), (T.resolve_topic, "", "/"), (T.resolve_topic, "/scan/", "/scan"), (T.encode_uri, "la:f:00000000#0", "la%3Af%3A00000000%230"), (T.encode_uri, "a b~*", "a%20b~%2A"),
    (T.short_id, "la:f:0123abcd#0", "#0123abcd"), (T.short_id, "la:f:0123abcd#2", "#0123abcd.2"), (T.include_display, "launch_desc_file_nav_launch_py", "nav.launch.py"), (T.include_display, "launch_desc_file_os_path_join___type____var____name____d_____slam_launch_py__", "slam.launch.py"),
    (lambda c: T.contains_value(c, "for"), '["for", {"a": 1}]', True), (lambda c: T.contains_value(c, "a"), '["for", {"a": 1}]', False), (lambda c: T.contains_value(c, 1), '["1", {"a": 1}]', True), (lambda c: T.contains_value(c, 1), '["1", 11]', False),
    (lambda c: T.resolve_topic(c, F.lit("/robot")), "scan", "/robot/scan"), (lambda c: T.resolve_topic(c, F.lit("/robot")), "/scan/", "/scan"), (lambda c: T.topic_matches(c, F.lit("/cmd_vel")), "cmd_vel", True),
    (lambda c: T.substitution_text(T.parse_substitution(c)), "$(env E d)", "$(env E d)"), (lambda c: T.substitution_text(T.parse_substitution(c)), "$(env E)", "$(env E)"), (lambda c: T.display_substitution(T.parse_substitution(c)), "$(env E d)", "$(env E=d)"),
    (lambda c: T.display_substitution(T.parse_substitution(c)), "$(find-pkg-share p)/c/d.yaml", "$(find-pkg-share p)/c/d.yaml"), (lambda c: T.truncate(c, 4), "abcdef", "abc…"), (lambda c: T.truncate(c, 4), "abcd", "abcd"),
]


def test_scalars(spark):
    got = spark.createDataFrame([tuple(p[1] for p in PAIRS)], ", ".join(f"c{i} string" for i in range(len(PAIRS)))).select(*(f(F.col(f"c{i}")).alias(f"o{i}") for i, (f, _, _) in enumerate(PAIRS))).first()
    for (_, given, want), have in zip(PAIRS, got, strict=True):
        assert have == want, (given, have, want)


@pytest.mark.parametrize(("given", "want"), [
    ("$(var x)", ("argument_reference", "x", None)), ("$(arg x)", ("argument_reference", "x", None)), ("$(env E d)", ("environment_variable", "E", "d")), ("$(find-pkg-share p)/c/d.yaml", ("file_path", "p", "c/d.yaml")), ("x", ("literal", None, "x")),
])
def test_substitutions(spark, given, want):
    assert tuple(spark.createDataFrame([(given,)], "t string").select(T.parse_substitution(F.col("t")).alias("s")).first()["s"]) == want


@pytest.mark.parametrize(("text", "want"), [
    ("$(var a) and $(var b)", ["and", ["eq", ["launch_arg_get", "a"], "true"], ["eq", ["launch_arg_get", "b"], "true"]]), ("not $(var a)", ["not", ["eq", ["launch_arg_get", "a"], "true"]]), ("$(env E)", ["truthy", ["env_get", "E"]]), ("foo", ["truthy", ["var_get", "foo"]]),
    ("a or b or c", ["or", ["or", ["truthy", ["var_get", "a"]], ["truthy", ["var_get", "b"]]], ["truthy", ["var_get", "c"]]]), ("'$(var a)'", ["eq", ["launch_arg_get", "a"], "true"]),
])
def test_launch_conditions(text, want):
    assert C.launch_condition(text) == want


@pytest.mark.parametrize(("text", "want"), [
    ("N<1 or N>5", ["or", ["lt", ["var_get", "N"], "1"], ["gt", ["var_get", "N"], "5"]]), ("os.environ['D'] == 'humble'", ["eq", ["env_get", "D"], "humble"]), ("not x and y != 2", ["and", ["not", ["truthy", ["var_get", "x"]]], ["neq", ["var_get", "y"], "2"]]),
    ("LaunchConfiguration('z') >= 3", ["gte", ["launch_arg_get", "z"], "3"]),
])
def test_python_conditions(text, want):
    assert C.python_condition(text) == want


def test_condition_column_keeps_nulls(spark):
    rows = spark.createDataFrame([("a and b",), (None,)], "t string").select(C.condition_json(F.col("t")).alias("j")).collect()
    assert json.loads(rows[0]["j"])[0] == "and" and rows[1]["j"] is None


def test_templates(spark):
    row = spark.range(1).select(T.render_strict(F.lit("X {a} {b}"), {"a": F.lit(1)}).alias("s"), T.render_lenient(F.lit("X {a} {b}"), {"a": F.lit(1), "b": F.lit(None).cast("string")}).alias("l"), T.render_strict(F.lit("X {a}"), {"a": F.lit(None)}).alias("n")).first()
    assert tuple(row) == ("X {a} {b} [missing_context=b]", "X 1 {b}", "X ")
