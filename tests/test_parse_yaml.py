"""YAML texts as yaml's BaseLoader reads them, without its constructor."""

import pytest

from fleetscope.sources import launch as L
from fleetscope.sources import markup


@pytest.mark.parametrize("text", ["a: [1, {b: c}, ~, null, 2.0, true]", "x: &n {k: v}\ny: *n\n", "", "~", "- !!int 3\n- !t v\n", "a: 1\na: 2\n", "<<: {a: b}"])
def test_yaml_as_its_base_loader_reads_it(text):
    import yaml

    assert markup.plain(text) == yaml.load(text, yaml.BaseLoader)


@pytest.mark.parametrize("text", ["a: &l [*l]", "{[a]: b}", "a: *b", "a: b\n---\nc: d\n", "a: ["])
def test_yaml_that_its_base_loader_refuses(text):
    import yaml

    with pytest.raises(yaml.YAMLError) as want:
        yaml.load(text, getattr(yaml, "CBaseLoader", yaml.BaseLoader))
    with pytest.raises(yaml.YAMLError) as got:
        markup.plain(text)
    assert str(got.value) == str(want.value)


def test_yaml_builds_no_tags(monkeypatch):
    import yaml

    def refuse(*_, **__):
        raise AssertionError("built by the loader's constructor")

    monkeypatch.setattr(yaml.constructor.BaseConstructor, "construct_object", refuse)
    assert L.parse("a", "yaml", "launch:\n  - arg: {name: x}\n")[0]["action_type"] == "declare_argument"
