import pytest

from fleetscope.operators import triples
from fleetscope.sources import rdf_files as R

TTL = """@prefix ros: <http://example.org/ros-launch#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
# a comment
<http://x/a> a ros:LaunchAction,
        ros:NodeAction ;
    ros:hasActionId "la:f:00000000#0" ;
    ros:hasConfidence 0.9 ;
    ros:qosDepth 10 ;
    ros:remapApplied true ;
    ros:hasCondition "say \\"hi\\" \\n" , \"\"\"long
text\"\"\" ;
    ros:typed "5"^^xsd:integer ;
    ros:tagged "hallo"@de .
ros:thing.b ros:hasProvenance <http://x/p%3A1> .
"""
WANT = {
    ("http://x/a", "type", triples.ROS + "LaunchAction", "iri", None), ("http://x/a", "type", triples.ROS + "NodeAction", "iri", None), ("http://x/a", "hasActionId", "la:f:00000000#0", "lit", "string"), ("http://x/a", "hasConfidence", "0.9", "lit", "decimal"),
    ("http://x/a", "qosDepth", "10", "lit", "integer"), ("http://x/a", "remapApplied", "true", "lit", "boolean"), ("http://x/a", "hasCondition", 'say "hi" \n', "lit", "string"), ("http://x/a", "hasCondition", "long\ntext", "lit", "string"), ("http://x/a", "typed", "5", "lit", "integer"),
    ("http://x/a", "tagged", "hallo", "lit", "string"), (triples.ROS + "thing.b", "hasProvenance", "http://x/p%3A1", "iri", None),
}


def test_turtle():
    assert set(R.turtle(TTL)) == WANT


@pytest.mark.parametrize("text", ["<a> <b>", "<a> nope:b <c> .", "%%%"])
def test_bad_turtle(text):
    with pytest.raises((ValueError, KeyError, IndexError)):
        R.turtle(text)


def test_read_rdf_by_suffix(spark, tmp_path):
    (tmp_path / "architecture").mkdir()
    (tmp_path / "a.ttl").write_text(TTL)
    (tmp_path / "b.nt").write_text('<http://x/n> <http://example.org/ros-launch#hasName> "n" .\n')
    (tmp_path / "c.rdf").write_text('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:r="http://example.org/ros-launch#"><rdf:Description rdf:about="http://x/x"><r:hasName>v</r:hasName><r:to rdf:resource="http://x/y"/></rdf:Description><r:Topic rdf:about="http://x/t"/></rdf:RDF>')
    (tmp_path / "d.jsonld").write_text('[{"@id": "http://x/j", "@type": ["http://example.org/ros-launch#Topic"], "http://example.org/ros-launch#hasName": [{"@value": "j"}], "http://example.org/ros-launch#qosDepth": [{"@value": 3}]}]')
    (tmp_path / "e.ttl").write_text("<a> <b>")
    (tmp_path / "architecture" / "f.ttl").write_text(TTL)
    rows = R.read_rdf(spark, str(tmp_path)).collect()
    assert {tuple(r)[1:6] for r in rows if r["error"] is None} == WANT | {
        ("http://x/n", "hasName", "n", "lit", "string"), ("http://x/x", "hasName", "v", "lit", "string"), ("http://x/x", "to", "http://x/y", "iri", None), ("http://x/t", "type", triples.ROS + "Topic", "iri", None),
        ("http://x/j", "type", triples.ROS + "Topic", "iri", None), ("http://x/j", "hasName", "j", "lit", "string"), ("http://x/j", "qosDepth", "3", "lit", "integer"),
    }
    assert [r["graph"].rpartition("/")[2] for r in rows if r["error"]] == ["e.ttl"]
