import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import shapes
from fleetscope.sources import interfaces as I
from fleetscope.sources import launch as L
from fleetscope.sources import markup, program, python_launch, sinks

HERE = Path(__file__).parent / "fixtures"


def items(name):
    text = (HERE / name).read_text()
    fmt = {"py": "python", "ml": "xml"}.get(name[-2:], "") if not name.endswith("yaml") else "yaml"
    return program.rows(f"fixtures/{name}", fmt, 1.0, {"python": python_launch.read_python, "xml": markup.read_xml, "yaml": markup.read_yaml}[fmt](text))


def kinds(rows):
    return [(r["action_type"], r["depth"]) for r in rows]


def test_xml_actions():
    rows = items("robot.launch.xml")
    assert kinds(rows) == [("declare_argument", 0), ("declare_argument", 0), ("set_parameter", 0), ("set_parameter", 0), ("node", 0), ("group", 0), ("push_namespace", 1), ("set_parameter", 1), ("node", 1), ("node", 1), ("group", 1), ("node", 2), ("include", 0)]
    node = rows[4]
    assert [json.loads(c) for c in node["conditions"]] == [["and", ["eq", ["launch_arg_get", "use_lidar"], "true"], ["truthy", ["env_get", "HAS_LIDAR"]]], ["not", ["eq", ["launch_arg_get", "off"], "true"]]]
    assert node["confidence"] == 1.0 and rows[5]["confidence"] == 0.9  # conditions lower a group's, not a node's
    assert node["namespace"] == {"type": "argument_reference", "name": "prefix", "value": None}
    assert node["parameters"]["rate"]["value"] == "10" and node["remappings"] == [{"from_topic": "scan", "to_topic": {"type": "literal", "name": None, "value": "/base_scan"}}]
    assert [r["target_scope"] for r in rows if r["action_type"] == "set_parameter"] == ["local", "global", "local"]  # let, set_env, set_parameter
    twins = [r["action_id"] for r in rows if r["name"] and r["name"]["value"] == "fake"]
    assert twins[0][:-1] == twins[1][:-1] and [t[-1] for t in twins] == ["0", "1"]
    assert rows[8]["parent_id"] == rows[5]["action_id"] and rows[11]["parent_id"] == rows[10]["action_id"]
    assert rows[-1]["included_launch_id"] == "launch_desc_file___find_pkg_share_nav__launch_nav_launch_xml" and rows[-1]["argument_mappings"]["map"]["value"] == "lab"


def test_yaml_actions():
    rows = items("robot.launch.yaml")
    assert kinds(rows) == [("declare_argument", 0), ("declare_argument", 0), ("set_parameter", 0), ("set_parameter", 0), ("node", 0), ("group", 0), ("push_namespace", 1), ("node", 1), ("include", 0)]
    assert rows[1]["default_value"]["value"] == "bot"  # value serves as default
    assert rows[3]["value"]["value"] == "10"  # scalars stay text
    assert rows[0]["action_id"].split(":")[2] == items("robot.launch.xml")[0]["action_id"].split(":")[2]


def test_python_actions():
    rows = items("robot.launch.py")
    by = {}
    for r in rows:
        by.setdefault(r["action_type"], []).append(r)
    assert [n["executable"]["value"] for n in by["node"]] == ["base", "ctl", "['echo', 'hi']", "component_container", "cam::Driver", "one", "worker"]
    base, ctl, process, box, cam, one, worker = by["node"]
    assert json.loads(base["conditions"][0]) == ["not", ["eq", ["launch_arg_get", "use_sim"], "true"]] and base["confidence"] == 0.9
    assert base["parameters"]["file"] == {"type": "file_path", "name": "robot", "value": "config/base.yaml"}
    assert base["ros_arguments"] == ["--log", "$(arg use_sim=false)"]
    assert process["package"]["value"] == "__executable__"
    assert cam["conditions"] == box["conditions"] and box["namespace"] is None
    assert json.loads(one["conditions"][0]) == ["eq", ["var_get", "n"], "1"]  # an elif does not exclude what came before
    assert json.loads(worker["conditions"][0]) == ["and", ["not", ["or", ["or", ["lt", ["var_get", "n"], "1"], ["gt", ["var_get", "n"], "9"]], ["eq", ["var_get", "n"], "1"]]], ["for_range", "i", ["launch_arg_get", "use_sim"]]]
    args = {a["name"]["value"]: a for a in by["declare_argument"]}
    assert set(args) == {"count", "mode", "forgotten"} and args["forgotten"]["confidence"] == 0.8 and args["mode"]["choices"] == ["fast", "slow"]
    assert args["mode"]["parent_id"] == by["group"][0]["action_id"]
    assert "os_path_join" in by["include"][0]["included_launch_id"] and "type____var" in by["include"][0]["included_launch_id"] and by["include"][0]["argument_mappings"] == {}  # of {...}.items(); a plain dict is read
    assert by["set_parameter"][0]["value"]["type"] == "environment_variable" and by["set_parameter"][0]["target_scope"] == "global"
    assert not any(r["package"] and r["package"]["value"] == "never" for r in rows)  # loops of the main body are passed over


def test_include_arguments():
    text = "def generate_launch_description():\n    return LaunchDescription([IncludeLaunchDescription(PythonLaunchDescriptionSource('a.launch.py'), launch_arguments={'map': 'lab', 'sim': LaunchConfiguration('sim')})])\n"
    (row,) = python_launch.read_python(text)
    assert row["argument_mappings"]["map"]["value"] == "lab" and row["argument_mappings"]["sim"]["type"] == "argument_reference"


def test_inline_description_drops_opaque_functions():
    head = "def helper(context):\n    return [Node(package='p', executable='e')]\n\ndef generate_launch_description():\n    return {}([OpaqueFunction(function=helper)])\n"
    assert python_launch.read_python(head.format("LaunchDescription")) == []
    assert len(python_launch.read_python(head.format("launch.LaunchDescription"))) == 1


def test_has_resource_branch_comes_first():
    text = "def generate_launch_description():\n    nodes = []\n    if has_resource('a', 'b'):\n        nodes.append(ComposableNode(package='p', plugin='q', condition=IfCondition(LaunchConfiguration('x'))))\n    return LaunchDescription([DeclareLaunchArgument('x')])\n"
    rows = python_launch.read_python(text)
    assert [r["kind"] for r in rows] == ["node", "arg"]
    assert json.loads(rows[0]["conditions"][0]) == ["and", ["truthy", ["var_get", "has_resource('a', 'b')"]], ["eq", ["launch_arg_get", "x"], "true"]]


@pytest.mark.parametrize(("fmt", "text"), [("xml", "<launch><node"), ("yaml", "launch: ["), ("python", "def f(:"), ("xml", ""), ("yaml", "a: b"), ("python", "x = 1")])
def test_bad_documents_give_an_error_row(fmt, text):
    (row,) = L.parse("a/b", fmt, text)
    assert row["error"] and row["action_id"] is None


def test_known_ids():
    assert program.digest("Node(pkg=demo_nodes_cpp,exec=talker,name=talker_node)") == "190a4ef8"
    assert program.digest("# only a comment") == "00000000"
    assert program.file_id("examples/a-b/c.launch.py") == "file_examples_a_b_c_launch_py"


@pytest.fixture(scope="module")
def fleet(spark):
    return L.LaunchModel(L.read_launch(spark, str(HERE), base=str(HERE.parent)).rows.coalesce(1).cache())


def test_read_launch_finds_all_formats(fleet):
    assert {(r["file_path"], r["format"]) for r in fleet.descriptions.collect()} == {("fixtures/robot.launch.xml", "xml"), ("fixtures/robot.launch.yaml", "yaml"), ("fixtures/robot.launch.py", "python"), ("fixtures/demo.launch.py", "python")}
    bad = fleet.errors.collect()
    assert [r["file_path"] for r in bad] == ["fixtures/demo.layer1.yaml"]  # no launch file


def test_documents_round_trip(spark, fleet, tmp_path):
    sinks.write_documents(fleet, str(tmp_path / "out"))
    for p in (tmp_path / "out").rglob("*.txt"):
        p.rename(p.with_suffix(".json"))
    again = L.read_documents(spark, str(tmp_path / "out"))
    for name in ("actions", "edges", "parameters", "remappings", "conditions", "sequence"):
        cols = [c for c in getattr(fleet, name).columns if c not in ("depth", "ros_arguments", "choices", "conditions", "launch_prefix", "n_remappings")]
        one, two = (sorted(map(tuple, getattr(m, name).select(*cols).collect()), key=repr) for m in (fleet, again))
        assert one == two, name


def test_summary_counts_pseudo_nodes_apart(fleet):
    rows = {r["file_path"]: r for r in fleet.summary().collect()}
    assert (rows["fixtures/robot.launch.py"]["nodes"], rows["fixtures/robot.launch.py"]["args"], rows["fixtures/robot.launch.py"]["includes"]) == (6, 3, 1)


def test_validation_and_shapes_of_read_files(spark, fleet, tmp_path):
    assert fleet.validate().count() == 0
    fleet.triples().write.parquet(str(tmp_path / "t"))
    assert shapes.conforms(spark.read.parquet(str(tmp_path / "t")))


def test_structural_issues(fleet):
    got = fleet.issues(timestamp="2024-01-01T00:00:00Z")
    counts = {(r["ld_id"].split("_robot_")[-1], r["issue_key"]): r["count"] for r in got.where("ld_id LIKE '%robot%'").groupBy("ld_id", "issue_key").count().collect()}
    assert counts[("launch_py", "node_no_name")] == 4  # the pseudo-node and three unnamed ones
    assert counts[("launch_py", "opaque_symbolic_node")] == 1 and counts[("launch_py", "arg_orphan")] == 1 and counts[("launch_py", "include_unresolved")] == 1
    assert counts[("launch_xml", "arg_no_default")] == 1
    assert counts[("launch_xml", "namespace_implicit")] == 3
    ids = [r["issue_id"] for r in got.collect()]
    assert len(ids) == len(set(ids)) and any("_inc_001" in i for i in ids) and any("_arg_001" in i for i in ids) and any("_ns_001" in i for i in ids)


def test_interfaces(spark):
    got = I.read_interfaces(spark, str(HERE / "demo.layer1.yaml"))
    assert got.impls.count() == 10 and got.endpoints.count() == 8 and got.bindings.count() == 2
    speaker = got.impls.where("impl_id = 'impl:speaker_b'").first()
    assert (speaker["package"], speaker["executable"], speaker["name"]) == ("demo", None, "speaker_b")
    end = got.endpoints.where("endpoint_id = 'e1'").first()
    assert end["depth"] == 10 and json.loads(end["provenance"]) == {"confidence": 0.8, "notes": "seen"}


def test_legacy_interfaces_are_refused(spark, tmp_path):
    (tmp_path / "old.yaml").write_text("nodes:\n  - name: a\n    publishes: []\n")
    with pytest.raises(ValueError, match="node_implementations"):
        I.read_interfaces(spark, str(tmp_path)).strict()


def test_model_document(fleet):
    doc = json.loads(sinks.model_document(fleet, fleet.issues(timestamp="t"), "lab").first()["document"])
    assert [p["name"] for p in doc["packages"]][:3] == ["__executable__", "arm", "cam"]
    assert [c["id"] for c in doc["execution_configurations"]] == [f"exec_config_{i}" for i in range(1, 5)]
    assert any(d["launch_file_id"].startswith("demo/") for d in doc["launch_descriptions"]) and len(doc["issues"]) > 5
    assert {f["language"] for p in doc["packages"] for f in p["files"]} == {"yaml"}  # ids of files have no suffix


def test_lines(fleet):
    from fleetscope.operators import model

    said = [r["line"] for r in model.lines(fleet.actions).where("ld_id LIKE '%robot_launch_py'").orderBy("pos").collect()]
    assert any("NODE      robot / base   [base]   [if: " in x for x in said) and any("PROCESS   ['echo', 'hi']" in x for x in said) and any("INCLUDE   nav.launch.py" in x for x in said) and any("ARG       mode = fast" in x for x in said)


def test_folder_document(spark, tmp_path):
    out = tmp_path / "output"
    (out / "issues").mkdir(parents=True)
    (tmp_path / "node_interfaces").mkdir()
    (out / "issues" / "a.json").write_text('{"issues": [{"issue_id": "i1", "severity": "info"}]}')
    (out / "a.layer2.json").write_text('{"id": "launch_desc_a", "launch_file_id": "a", "format": "python", "actions": {"la:a:00000000#0": {"id": "la:a:00000000#0", "action_type": "node", "package": {"type": "literal", "value": "p"}, "executable": {"type": "literal", "value": 7}}}}')
    (tmp_path / "node_interfaces" / "a.layer1.yaml").write_text((HERE / "demo.layer1.yaml").read_text())
    doc = json.loads(sinks.folder_document(spark, str(out)).first()["document"])
    assert doc["launch_descriptions"][0]["launch_file_id"] == "p/a" and doc["issues"][0]["issue_id"] == "i1" and len(doc["node_implementations"]) == 10


def test_issue_documents(fleet):
    rows = sinks.issue_documents(fleet.issues(timestamp="T0"), "T0").collect()
    for r in rows:
        d = json.loads(r["document"])
        assert d["issue_count"] == len(d["issues"]) > 0 and d["analysis_timestamp"] == "T0"


def test_read_issues_takes_both_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "x", "severity": "info"}]')
    (tmp_path / "b.json").write_text('{"issues": [{"issue_id": "y"}, {"issue_id": "z"}]}')
    assert sorted(r["issue_id"] for r in sinks.read_issues(spark, str(tmp_path)).collect()) == ["x", "y", "z"]


def test_stems(spark):
    row = spark.createDataFrame([("a/x.launch.py", "a/b.layer2.json")], "p string, q string").select(L.stem(F.col("p")).alias("s"), L.relative_stem(F.col("q")).alias("r")).first()
    assert tuple(row) == ("x.launch", "a__b")


def test_stream_parses_new_files_once(spark, tmp_path):
    from fleetscope.streaming import ingest

    (tmp_path / "in").mkdir()

    def drain():
        q = ingest.keep_issues(ingest.launch_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), "T").trigger(availableNow=True).start()
        q.awaitTermination()

    (tmp_path / "in" / "a.launch.xml").write_text((HERE / "robot.launch.xml").read_text())
    drain()
    first = spark.read.parquet(str(tmp_path / "out/issues")).count()
    (tmp_path / "in" / "b.launch.yaml").write_text((HERE / "robot.launch.yaml").read_text())
    drain()
    assert spark.read.parquet(str(tmp_path / "out/rows")).select("file_path").distinct().count() == 2
    assert spark.read.parquet(str(tmp_path / "out/issues")).count() > first > 0


TYPED = """from launch import LaunchDescription

def generate_launch_description():
    return LaunchDescription([Node(package="p", executable="e", parameters=[{"n": 3, "on": True, "x": 0.5, "s": "3"}])])
"""


def test_literals_keep_their_type(spark):
    from fleetscope.operators import rdf

    model = L.LaunchModel(L.parse_documents(spark.createDataFrame([("a.launch.py", "python", TYPED)], "path string, format string, content string")))
    document = json.loads(L.to_documents(model).first()["document"])
    (action,) = document["actions"].values()
    assert {k: v["value"] for k, v in action["parameters"].items()} == {"n": 3, "on": True, "x": 0.5, "s": "3"}
    assert [type(action["parameters"][k]["value"]) for k in ("n", "on", "x", "s")] == [int, bool, float, str]
    said = {(r["o"], r["dtype"]) for r in rdf.launch_triples(model).where("p = 'hasParameterValue'").collect()}
    assert said == {("3", "integer"), ("true", "boolean"), ("0.5", "decimal"), ("3", "string")}


def test_triples_parse_each_file_once(spark):
    model = L.LaunchModel(L.parse_documents(spark.createDataFrame([("a.launch.py", "python", TYPED)], "path string, format string, content string")))
    assert "MapInArrow" not in model.triples()._jdf.queryExecution().executedPlan().toString()
    assert model.triples().count() > 10 and model.validate().count() == 0


def test_documents_as_one_table(spark, tmp_path):
    model = L.LaunchModel(L.parse_documents(spark.createDataFrame([("a.launch.py", "python", TYPED), ("b.launch.py", "python", TYPED)], "path string, format string, content string")))
    sinks.write_documents(model, str(tmp_path / "table"), as_files=False)
    back = sinks.read_document_table(spark, str(tmp_path / "table"))
    assert sorted(r["action_id"] for r in back.actions.collect()) == sorted(r["action_id"] for r in model.actions.collect())
    sinks.write_issues(model.issues(timestamp="T"), str(tmp_path / "issues"), "T", as_files=False)
    assert spark.read.parquet(str(tmp_path / "issues")).count() == 2


def test_large_models_are_refused_as_one_document(spark, monkeypatch):
    model = L.LaunchModel(L.parse_documents(spark.createDataFrame([("a.launch.py", "python", TYPED)], "path string, format string, content string")))
    monkeypatch.setattr(sinks, "MOST_ACTIONS", 0)
    with pytest.raises(ValueError):
        sinks.model_document(model)
