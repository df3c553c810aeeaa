from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import communication, compose, rdf, triples
from fleetscope.sources import interfaces as I
from fleetscope.sources import launch as L

HERE = Path(__file__).parent / "fixtures"


@pytest.fixture(scope="module")
def arch(spark):
    model = L.read_launch(spark, str(HERE / "demo.launch.py"), base=str(HERE.parent))
    files = I.read_interfaces(spark, str(HERE / "demo.layer1.yaml"))
    pairs = files.files.select("path").crossJoin(model.descriptions.select("ld_id", "launch_file_id"))
    return {k: v.cache() for k, v in I.compose(model, files.strict().paired(pairs)).items()}


def test_sizes(arch):
    assert {k: v.count() for k, v in arch.items() if k != "warnings"} == {"nodes": 8, "topics": 4, "publications": 4, "subscriptions": 3}


def test_warnings(arch):
    said = " | ".join(r["message"] for r in arch["warnings"].collect())
    for part in ("impl:both: ambiguous, 2", "impl:none: no launch action", "image to /camera/image", "has no topic", "/camera/image has 2 message types"):
        assert part in said, said
    assert arch["warnings"].count() == 5


def test_names_and_ids(arch):
    names = {r["impl_id"]: (r["runtime_name"], r["namespace"]) for r in arch["nodes"].collect()}
    assert names["impl:hearer"] == ("ears", "/head")  # the first binding that fits
    assert names["impl:view"] == ("viewer", None) and names["impl:alone"] == ("alone", None)
    sub = arch["subscriptions"].where("declared_in = 'e7'").first()
    assert sub["remap_applied"] and sub["topic_id"] == "topic:camera_image" and sub["original_topic_name"] == "image"
    assert sub["endpoint_id"] == f"subscription:{sub['node_id'].replace(':', '_')}:camera_image"
    assert arch["topics"].where("topic_id = 'topic:camera_image'").first()["msg_type"] == "std/Image"


def test_communication_issues(arch):
    got = communication.detect(arch, timestamp="T")
    rows = {r["issue_key"]: r for r in got.collect()}
    assert got.count() == 6 and set(rows) == set(communication.RULES)
    assert "speaker_a, speaker_b" in rows["topic_multiple_publishers"]["description"]
    assert "'alone'" in rows["isolated_node"]["description"] and "/nobody" in rows["publisher_without_subscriber"]["description"] and "/silence" in rows["subscriber_without_publisher"]["description"]
    assert rows["qos_reliability_mismatch"]["issue_id"] == "ontology_qos_reliability_mismatch_001"


def test_architecture_triples_answer_the_rules(spark, arch, tmp_path):
    repo = triples.Repository(spark, str(tmp_path / "repo"))
    repo.upload(rdf.architecture_triples(arch))
    t, p = repo.triples(merged=False), triples.Pattern
    isolated = triples.solve(t, triples.Query([p("?n", "type", triples.ROS + "RuntimeNode"), p("?n", "hasRuntimeName", "?name")], absent=[[p("?n", "publishes", "?x")], [p("?n", "subscribes", "?y")]]))
    assert [r["name"] for r in isolated.collect()] == ["alone"]
    assert t.where("p = 'hasQoS'").count() == 5 and t.where("p = 'onTopic'").count() == 7
    assert t.count() == t.dropDuplicates(["graph", "s", "p", "o"]).count()


def test_scopes(spark, arch):
    """A topic of the same id in another graph ends loneliness in the merged repository only."""
    other = {k: v.withColumn("graph", F.lit("other")) for k, v in arch.items()}
    both = {k: arch[k].unionByName(other[k].where("false") if k == "publications" else other[k]) for k in arch}
    lonely = lambda scope: communication.publisher_without_subscriber(both["publications"].where("topic_id = 'topic:shared'").withColumn("graph", F.lit("third")), both["subscriptions"], both["topics"].unionByName(both["topics"].withColumn("graph", F.lit("third"))), both["nodes"].unionByName(both["nodes"].withColumn("graph", F.lit("third"))), scope)
    assert lonely("per_graph").select("endpoint_id").distinct().count() == 2 and lonely("global").count() == 0


def test_selector_of_an_unknown_key_fits_nothing():
    assert I.implementation(0, {"selector": {"colour": "red"}})["action_id"].startswith("no action")


def test_last_publication_wins(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, pos int, v string")
    assert sorted(map(tuple, compose.last_wins(rows, "k", "pos", ["v"]).collect())) == [("a", "y"), ("b", "z")]


def test_launch_namespace_only_on_request(spark):
    actions = spark.createDataFrame([("ld", "la:x#0", "node", "n", "p", "e", "/launch")], "ld_id string, action_id string, action_type string, name string, package string, executable string, namespace string")
    impls = spark.createDataFrame([("g", "ld", 0, "i", "p", "e", None, None, None, None, None)], "graph string, ld_id string, pos int, impl_id string, package string, executable string, name string, namespace string, action_id string, runtime_name string, node_namespace string")
    ends = spark.createDataFrame([("g", "i", "pub", 0, "d", "scan", "T", None, None, None, None)], "graph string, impl_id string, kind string, pos int, endpoint_id string, topic_name string, msg_type string, reliability string, durability string, history string, depth int")
    remaps = spark.createDataFrame([], "ld_id string, action_id string, pos int, from_topic string, to_topic string")
    name = lambda flag: compose.build(impls, ends, actions, remaps, use_launch_namespace=flag)["topics"].first()["topic_name"]
    assert name(False) == "/scan" and name(True) == "/launch/scan"
