import json

import pytest

from vellum import cli
from vellum.errors import CatalogError
from vellum.output import OutputError, emit
from vellum.params import ParameterError, has_parameters, parameter_names, replace_parameters
from vellum.saved import SavedQueries, SavedQueryError
from vellum.sources.catalog import Mappings, split


def test_mappings_are_kept(tmp_path):
    m = Mappings(tmp_path / "deep" / "m.json")
    m.add("b", "$.x")
    m.add("a", "f.json:$.y")
    again = Mappings(tmp_path / "deep" / "m.json")
    assert again.all() == {"b": "$.x", "a": "f.json:$.y"} and again.has("a") and again.get("c") is None
    assert again.file_of("a") == "f.json" and again.path_of("a") == "$.y" and again.file_of("b") is None
    assert again.listing().splitlines()[1:] == ["  a -> f.json:$.y", "  b -> $.x"]
    for name, path in (("", "$"), ("x", " ")):
        with pytest.raises(CatalogError):
            m.add(name, path)


def test_mapping_parts():
    assert split("$.a['b:c']") == (None, "$.a['b:c']") and split("d/f.json:$.a:b") == ("d/f.json", "$.a:b")


def test_broken_mappings(tmp_path):
    (tmp_path / "m.json").write_text("{")
    with pytest.raises(CatalogError):
        Mappings(tmp_path / "m.json")


def test_saved_queries(tmp_path):
    s = SavedQueries(tmp_path / "q.json")
    s.save("two", "SELECT 2")
    s.save("one", " SELECT 1 ")
    assert list(SavedQueries(tmp_path / "q.json").all()) == ["two", "one"] and s.get("one") == "SELECT 1" and len(s) == 2
    s.delete("two")
    assert not s.has("two")
    with pytest.raises(SavedQueryError):
        s.delete("two")
    for name, text in (("", "x"), ("x", "")):
        with pytest.raises(SavedQueryError):
            s.save(name, text)
    (tmp_path / "q.json").write_text("[")
    assert len(SavedQueries(tmp_path / "q.json")) == 0


def test_parameters():
    text = "SELECT * FROM t WHERE a = '${a}' AND b IN (${b:1, 2}) AND c = '${c:x:y}' AND d = '${d:}'"
    assert parameter_names(text) == ["a", "b", "c", "d"] and has_parameters(text) and not has_parameters("SELECT")
    assert replace_parameters(text, {"a": "${b}\\1"}) == "SELECT * FROM t WHERE a = '${b}\\1' AND b IN (1, 2) AND c = 'x:y' AND d = ''"
    with pytest.raises(ParameterError, match="x, y"):
        replace_parameters("${x} ${y} ${x}")


def test_output(tmp_path, capsys):
    emit('[{"a":1}]', str(tmp_path / "n" / "o.json"), indent=True)
    assert json.loads((tmp_path / "n" / "o.json").read_text()) == [{"a": 1}] and "\n" in (tmp_path / "n" / "o.json").read_text()
    assert str(tmp_path / "n" / "o.json") in capsys.readouterr().out
    emit("[]")
    assert capsys.readouterr().out == "[]\n"
    with pytest.raises(OutputError):
        emit("[]", clipboard=True)


def test_command_line(tmp_path, capsys, spark):
    (tmp_path / "t.json").write_text('{"r": [{"i": 1}, {"i": 2}]}')
    base = ["-d", str(tmp_path), "-c", str(tmp_path / "m.json"), "--queries-file", str(tmp_path / "q.json")]
    assert cli.main([*base, "--add-mapping", "t", "$.r"], spark) == 0
    assert cli.main([*base, "--list-tables"], spark) == 0
    assert cli.main([*base, "--save-query", "big", "SELECT i FROM t WHERE i > ${n}"], spark) == 0
    assert cli.main([*base, "--list-queries"], spark) == 0
    capsys.readouterr()
    assert cli.main([*base, "--run-query", "big", "--param", "n = 1"], spark) == 0
    assert capsys.readouterr().out == '[{"i":2}]\n'
    assert cli.main([*base, "-q", "SELECT i FROM t", "-o", str(tmp_path / "o.json")], spark) == 0
    assert json.loads((tmp_path / "o.json").read_text()) == [{"i": 1}, {"i": 2}]
    for bad in (["--run-query", "none"], ["--run-query", "big"], ["-q", "SELECT"], ["-q", "SELECT * FROM u"], [], ["-q", "SELECT i FROM t", "--param", "x"]):
        assert cli.main([*base, *bad], spark) == 1
    assert cli.main([*base, "--delete-query", "big"], spark) == 0
