"""Parsing keeps all cores busy, and its work and memory grow with the text only."""

import ast

import pytest

from fleetscope.plans import views
from fleetscope.sources import launch as L
from fleetscope.sources import python_launch


@pytest.mark.parametrize("templates", [views.LAUNCH, views.FEATURES])
@pytest.mark.parametrize("fmt", list(views.LAUNCH))
def test_one_small_file_of_parts_is_parsed_by_all_cores(spark, sf_dir, fmt, templates):
    docs = views.launch_documents(spark, sf_dir, fmt, templates)
    counts = docs.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(counts) >= 4 and max(counts) <= 2 * sum(counts) / len(counts)


def nested(depth):
    inner = "Node(package='p', executable='e')"
    for _ in range(depth):
        inner = f"GroupAction([{inner}])"
    return f"def generate_launch_description():\n    return LaunchDescription([{inner}])\n"


def test_nested_groups_are_settled_once(monkeypatch):
    calls = []
    plain = python_launch.Walker.settle
    monkeypatch.setattr(python_launch.Walker, "settle", lambda self, v: calls.append(1) or plain(self, v))

    def work(depth):
        calls.clear()
        python_launch.read_python(nested(depth))
        return len(calls)

    assert work(40) < 2.5 * work(20)


def test_names_that_are_known_later_are_found_in_lists_that_were_settled():
    text = "def generate_launch_description():\n    p = []\n    n = Node(package='a', executable='b', parameters=p)\n    ld = LaunchDescription([])\n    ld.add_action(n)\n    p.append(q)\n    q = {'k': 'v'}\n    return ld\n"
    (row,) = python_launch.read_python(text)
    assert row["parameters"]["k"]["value"] == "v"


def test_files_of_one_template_share_a_tree(monkeypatch):
    monkeypatch.setattr(python_launch, "_TREES", {})
    made = []
    plain = ast.parse
    monkeypatch.setattr(ast, "parse", lambda *a: made.append(1) or plain(*a))
    texts = [views.FEATURES["python"].replace("{k}", str(k)).replace("{z}", "7").replace("{b}", "b") for k in range(9)]
    shared = [python_launch.read_python(t) for t in texts]
    assert len(made) == 2
    monkeypatch.setattr(python_launch, "MOST_CHARACTERS", 0)
    assert shared == [python_launch.read_python(t) for t in texts] and len(made) == 11


@pytest.mark.parametrize("said", ["'a' \"b{}\"", "r'a{}'", "f'a{{x}}{}'", "'''a{}'''", "'it\\'s {}'", "'' 'a{}'", "'#{}'", "\"it's {}\"", "u'{}'", "b'{}'"])
def test_literals_of_shared_trees(monkeypatch, said):
    monkeypatch.setattr(python_launch, "_TREES", {})
    texts = [f"def generate_launch_description():\n    return LaunchDescription([Node(package={said.format(k)}, executable='e', condition=IfCondition({said.format(k)}))])\n" for k in range(4)]
    shared = [python_launch.read_python(t) for t in texts]
    monkeypatch.setattr(python_launch, "MOST_CHARACTERS", 0)
    assert shared == [python_launch.read_python(t) for t in texts]


def test_bytes_of_a_few_rows_leave_together(spark, monkeypatch):
    sizes = []
    plain = L.record_batch
    monkeypatch.setattr(L, "record_batch", lambda rows, target: sizes.append(len(rows)) or plain(rows, target))
    monkeypatch.setattr(L, "BATCH_ROWS", 8)
    text = views.LAUNCH["xml"].replace("{k}", "1").replace("{z}", "1").replace("{b}", "b")
    run = {}

    class Docs:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            run["f"] = f

    L.parse_documents(Docs())
    import pyarrow as pa

    batch = pa.record_batch({"path": [f"p{i}" for i in range(5)], "format": ["xml"] * 5, "content": [text] * 5})
    assert sum(b.num_rows for b in run["f"]([batch])) == 20 and sizes == [8, 8, 4]
