import random

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import catalog, model, shapes, structural, tree, triples, validation

ACTION = "ld_id string, map_key string, action_id string, action_type string, package string, executable string, included_launch_id string"


def program(spark, actions, sequence, edges):
    a = spark.createDataFrame(actions, ACTION)
    return a, spark.createDataFrame([("L", s) for s in sequence], "ld_id string, action_id string"), spark.createDataFrame([("L", p, c) for p, c in edges], "ld_id string, parent string, child string")


def node(i, key=None, **k):
    return ("L", key or i, i, k.get("t", "node"), k.get("p", "p"), k.get("e", "e"), k.get("inc"))


def ids(n):
    return f"la:f:{n:08x}#0"


def test_every_validation_rule_fires(spark):
    a, b, c, d, e, f, g = map(ids, range(7))
    actions = [node(a, t="group"), node(b, t="group"), node(c, key="other"), node(d, p=None), node("la:x-y:00000000#0"), node(e, t="include", inc=""), node(f, t="node"), node(g, t="group")]
    got = validation.validate(*program(spark, actions, [a, c, d, e, f, "gone", "la:x-y:00000000#0"], [(a, b), (b, a), (f, e)]))
    seen = {(r["rule"], r["severity"]) for r in got.collect()}
    assert seen == {(r, "warning" if r == "no_orphans" else "error") for r in ("actions_map_consistency", "sequence_validity", "no_orphans", "id_format", "no_cycles", "scope_actions_only", "node_required_fields", "include_required_fields")}
    assert [r["action_id"] for r in got.where("rule = 'no_orphans'").collect()] == [g]


def test_a_sound_program_has_no_errors(spark):
    a, b = ids(1), ids(2)
    assert validation.validate(*program(spark, [node(a, t="group"), node(b)], [a], [(a, b)])).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_trees_match_plain_walks(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(45)}
    roots = {0, 1}
    seen, depth, front = dict.fromkeys(roots, 0), 0, set(roots)
    while front:
        depth += 1
        front = {c for p, c in edges if p in front} - set(seen)
        seen |= dict.fromkeys(front, depth)
    e = spark.createDataFrame([(1, p, c) for p, c in edges], "ld_id int, parent int, child int")
    got = tree.reachable(spark.createDataFrame([(1, r) for r in roots], "ld_id int, id int"), e)
    assert {r["id"]: r["depth"] for r in got.collect()} == seen


def test_long_chains_have_no_limit(spark):
    e = spark.range(12).selectExpr("1 AS ld_id", "id AS parent", "id + 1 AS child")
    assert tree.reachable(spark.createDataFrame([(1, 0)], "ld_id int, id long"), e).agg(F.max("depth")).first()[0] == 12


def test_self_loops_are_cycles(spark):
    e = spark.createDataFrame([(1, 1, 1), (1, 2, 3)], "ld_id int, parent int, child int")
    assert [r["id"] for r in tree.cycles(e).collect()] == [1]


def test_disabled_rules_use_numbers_up(spark):
    rows = spark.createDataFrame([("f", 0, "a", "x"), ("f", 1, "b", "y")], "file_id string, pos int, issue_key string, entity_id string").withColumn("family", F.lit(""))
    entries = {"a": (False, "info", "c", "t", "d", "r", "node"), "b": (True, "info", "c", "t", "d {gone}", "r", "node")}
    out = catalog.issues(rows, catalog.load_catalog(spark, entries), F.concat(F.lit("issue_"), "file_id", F.lit("_")), {}, ["pos"], ["file_id"], timestamp="T").collect()
    assert [(r["issue_id"], r["description"], r["analysis_timestamp"]) for r in out] == [("issue_f_002", "d {gone} [missing_context=gone]", "T")]


def test_catalogue_files(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("issues:\n  k:\n    enabled: false\n    severity: info\n    title: t\n")
    with pytest.raises(ValueError, match="lacks"):
        catalog.read_catalog(spark, str(tmp_path / "c.yaml"))
    assert tuple(catalog.read_catalog(spark, str(tmp_path / "c.yaml"), strict=False).first())[:3] == ("k", False, "info")


def test_first_matching_condition_rule_wins(spark):
    rows = spark.createDataFrame([("L", 0, "node", ["for range has_resource"]), ("L", 1, "node", ["for_range", "has_resource"]), ("L", 2, "node", [])], "ld_id string, pos int, action_type string, conditions array<string>").withColumn("cond", F.array_join("conditions", "\n"))
    assert [r["pos"] for r in structural.node_runtime_condition(rows).orderBy("pos").collect()] == [0, 1]
    assert [r["pos"] for r in structural.opaque_symbolic_node(rows).collect()] == [1]


def test_main_package_ties_go_to_the_first_seen(spark):
    rows = spark.createDataFrame([("L", 0, "node", "b", "x"), ("L", 1, "node", "a", "y"), ("L", 2, "node", "c", "x"), ("L", 3, "node", "c", "z"), ("M", 0, "node", "b", "x"), ("M", 1, "node", "a", "y")], "ld_id string, pos int, action_type string, package string, executable string")
    assert {r["ld_id"]: r["package"] for r in model.main_package(rows).collect()} == {"L": "c", "M": "b"}


def test_registry_takes_functions_and_sql(spark):
    from fleetscope.operators.registry import Registry

    actions = spark.createDataFrame([("a", "node", None), ("b", "node", "x"), ("c", "include", None)], "action_id string, action_type string, name string")
    r = Registry()
    r.register("nameless", lambda t: t["actions"].where("action_type = 'node' AND name IS NULL"))
    r.register("named", "SELECT action_id, name FROM {actions} WHERE name IS NOT NULL")
    r.register("off", lambda t: 1 / 0)
    entry = lambda on, d: (on, "info", "c", "t", d, "r", "node")
    known = catalog.load_catalog(spark, {"nameless": entry(True, "no name: {action_id}"), "named": entry(True, "{name}"), "off": entry(False, "")})
    got = {r["issue_id"]: (r["entity_id"], r["description"]) for r in r.run({"actions": actions}, known).collect()}
    assert got == {"rule_nameless_001": ("a", "no name: a"), "rule_named_001": ("b", "x")}


# triples


def test_ntriples_round_trip(spark):
    rows = [("g", "http://s", "hasName", 'a "q" \\ \n b', "lit", "string"), ("g", "http://s", "type", triples.ROS + "NodeAction", "iri", None), ("g", "http://s", "qosDepth", "5", "lit", "integer"), ("g", "http://s", "hasName", "", "lit", "string")]
    t = spark.createDataFrame(rows, "graph string, s string, p string, o string, kind string, dtype string")
    assert sorted(map(tuple, triples.from_ntriples(triples.to_ntriples(t), F.lit("g")).collect()), key=repr) == sorted(rows, key=repr)


def test_patterns(spark):
    rows = [("g", "a", "type", "N", "iri", None), ("g", "b", "type", "N", "iri", None), ("g", "a", "name", "x", "lit", "string"), ("g", "b", "hidden", "y", "lit", "string")]
    t = spark.createDataFrame(rows, "graph string, s string, p string, o string, kind string, dtype string")
    p = triples.Pattern
    q = triples.Query([p("?s", "type", "N")], optional=[[p("?s", "name", "?n")]], absent=[[p("?s", "hidden", "?h")]])
    assert [(r["s"], r["n"]) for r in triples.solve(t, q).collect()] == [("a", "x")]
    assert triples.match(t, p("?s", "name", "x")).count() == 1


def test_repository_merges_graphs(spark, tmp_path):
    repo = triples.Repository(spark, str(tmp_path / "r"))
    t = spark.createDataFrame([("g", "a", "name", "x", "lit", "string")], "graph string, s string, p string, o string, kind string, dtype string")
    repo.clear()
    repo.upload(t, "one")
    repo.upload(t, "two")
    assert repo.triples().count() == 1 and repo.triples(merged=False).count() == 2
    assert repo.query(triples.Query([triples.Pattern("?s", "name", "?n")])).count() == 1
    repo.clear()
    assert repo.triples().count() == 0


def test_shapes(spark):
    ros = triples.ROS
    rows = [
        ("g", "l", "type", ros + "LaunchDescription", "iri", None), ("g", "l", "hasLaunchFileId", "f", "lit", "string"), ("g", "l", "hasFormat", "json", "lit", "string"), ("g", "l", "hasAction", "a", "iri", None),
        ("g", "a", "type", ros + "LaunchAction", "iri", None), ("g", "a", "type", ros + "NodeAction", "iri", None), ("g", "a", "hasActionId", "la:x-y:00000000#0", "lit", "string"), ("g", "a", "hasPackage", "5", "lit", "integer"),
        ("g", "r", "type", ros + "Remapping", "iri", None), ("g", "r", "remapFrom", "x", "lit", "string"),
    ]
    got = shapes.report(spark.createDataFrame(rows, "graph string, s string, p string, o string, kind string, dtype string"))
    assert {(r["focus"], r["path"], r["constraint"]) for r in got.collect()} == {("l", "hasFormat", "in"), ("a", "hasPackage", "datatype"), ("a", "hasExecutable", "minCount"), ("r", "remapTo", "minCount")}


def test_items_between_cycles_lie_on_none(spark):
    e = spark.createDataFrame([(1, *x) for x in [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (5, 6)]], "ld_id int, parent int, child int")
    assert sorted(r["id"] for r in tree.cycles(e).collect()) == [1, 2, 4, 5]
    assert sorted(r["id"] for r in tree.cycles(e, spark.createDataFrame([(1, 4)], "ld_id int, id int")).collect()) == [4, 5]


TRIPLES = "graph string, s string, p string, o string, kind string, dtype string"


def test_a_variable_used_twice_is_an_equality(spark):
    t = spark.createDataFrame([("", "a", "likes", "a", "iri", None), ("", "a", "likes", "b", "iri", None)], TRIPLES)
    got = triples.match(t, triples.Pattern("?x", "likes", "?x"))
    assert got.columns == ["graph", "x"] and [r["x"] for r in got.collect()] == ["a"]


def test_products_are_refused_and_patterns_reordered(spark):
    P = triples.Pattern
    t = spark.createDataFrame([("", "a", "p", "b", "iri", None), ("", "b", "q", "c", "iri", None), ("", "c", "r", "d", "iri", None)], TRIPLES)
    with pytest.raises(ValueError):
        triples.solve(t, triples.Query([P("?a", "p", "?b"), P("?x", "r", "?y")]))
    got = triples.solve(t, triples.Query([P("?a", "p", "?b"), P("?c", "r", "?d"), P("?b", "q", "?c")])).collect()
    assert [(r["a"], r["b"], r["c"], r["d"]) for r in got] == [("a", "b", "c", "d")]


def test_a_star_is_one_pass_with_every_combination(spark):
    P = triples.Pattern
    rows = [("", s, p, o, "lit", "string") for s, p, o in [("a", "hasName", "n"), ("a", "hasPackage", "x"), ("a", "hasPackage", "y"), ("b", "hasName", "m"), ("c", "hasName", "n"), ("c", "hasPackage", "n")]]
    t = spark.createDataFrame(rows, TRIPLES)
    got = triples.solve(t, triples.Query([P("?s", "hasName", "?n"), P("?s", "hasPackage", "?k")]))
    assert sorted((r["s"], r["n"], r["k"]) for r in got.collect()) == [("a", "n", "x"), ("a", "n", "y"), ("c", "n", "n")]
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
    same = triples.solve(t, triples.Query([P("?s", "hasName", "?n"), P("?s", "hasPackage", "?n")]))
    assert [r["s"] for r in same.collect()] == ["c"]
    fixed = triples.solve(t, triples.Query([P("?s", "hasName", "n"), P("?s", "hasPackage", "x")]))
    assert [r["s"] for r in fixed.collect()] == ["a"]


def test_issues_of_two_descriptions_of_one_file(spark):
    columns = "ld_id string, file_id string, pos int, action_id string, action_type string, name string, package string, executable string, namespace string, default_value string, confidence double, cond string, included_launch_id string, source_file string"
    row = lambda ld, src: (ld, "f", 0, "la:f:0#0", "node", None, "p", "e", None, None, 1.0, None, "", src)
    got = structural.detect(spark.createDataFrame([row("A", "x"), row("B", "y")], columns), keys=["node_no_name"]).collect()
    assert sorted((r["ld_id"], r["location"]) for r in got) == [("A", "x"), ("B", "y")]


def test_an_include_of_its_own_description(spark):
    rows = spark.createDataFrame([("L", "f", "include", x) for x in ("L", "launch_desc_f", "f", "other")], "ld_id string, file_id string, action_type string, included_launch_id string")
    assert sorted(r["included_launch_id"] for r in structural.include_self(rows).collect()) == ["L", "launch_desc_f"]
