"""Queries over JSON documents: what is missing, null or of mixed types, paths, order."""

import json

import pytest

from vellum.engine import Engine
from vellum.errors import CatalogError, UnsupportedError
from vellum.sources.catalog import Mappings

GOODS = [
    {"id": 1, "name": "Lamp", "price": 19.99, "tags": ["a", "b"], "dim": {"w": {"cm": 5}, "size": "15.6 inch"}, "on": True},
    {"id": 2, "name": "Desk", "price": 250, "tags": [], "dim": {"w": {"cm": 120}, "size": "5.0 inch"}, "on": False, "kind": None},
    {"id": 3, "name": None, "price": "9", "tags": None, "kind": "x", "dim": {"size": "6.1 inch"}},
    {"id": 4, "name": "a.b*c", "kind": "y", "tags": [None, {"k": 7}]},
]
SALES = [{"sid": 10, "gid": 2, "n": 1}, {"sid": 11, "gid": 1, "n": 2}, {"sid": 12, "gid": "1", "n": 3}, {"sid": 13, "n": 4}, {"sid": 14, "gid": None}]


@pytest.fixture()
def make(spark, tmp_path):
    def build(files=None, mappings=None, mode="compat"):
        for name, content in (files or {"shop.json": {"data": {"goods": GOODS}, "sales": SALES}}).items():
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text(content if isinstance(content, str) else json.dumps(content))
        m = Mappings()
        for k, v in (mappings or {"goods": "shop.json:$.data.goods", "sales": "shop.json:$.sales[*]"}).items():
            m.add(k, v)
        return Engine(spark, m, str(tmp_path), mode)

    return build


def rows(engine, text, **params):
    return json.loads(engine.execute(text, params))


def test_projection_keeps_null_and_leaves_out_what_is_missing(make):
    e = make()
    assert rows(e, "SELECT id, name, kind FROM goods") == [{"id": 1, "name": "Lamp"}, {"id": 2, "name": "Desk", "kind": None}, {"id": 3, "name": None, "kind": "x"}, {"id": 4, "name": "a.b*c", "kind": "y"}]
    assert rows(e, "SELECT nothing FROM goods") == [{}] * 4
    assert rows(e, "SELECT dim.w.cm, g.dim FROM goods g WHERE id = 1") == [{"cm": 5, "dim": {"size": "15.6 inch", "w": {"cm": 5}}}]
    assert rows(e, "SELECT g FROM goods g WHERE id = 4")[0]["g"]["kind"] == "y"
    assert rows(e, "SELECT goods.id FROM goods g WHERE g.id = 1") == [{}]


def test_names_that_collide(make):
    e = make()
    assert rows(e, "SELECT g.id, g.dim.size AS size, s.n AS id2 FROM goods g JOIN sales s ON g.id = s.gid ORDER BY s.n") == [{"id": 2, "size": "5.0 inch", "id2": 1}, {"id": 1, "size": "15.6 inch", "id2": 2}]
    assert rows(e, "SELECT g.id, h.id FROM goods g JOIN goods h ON g.id = h.id WHERE g.id = 1") == [{"g.id": 1, "h.id": 1}]


def test_comparisons(make):
    e = make()
    ids = lambda where: [r["id"] for r in rows(e, f"SELECT id FROM goods WHERE {where}")]
    assert ids("price = 19.99005") == [1] and ids("price = '19.99'") == [1]
    assert ids("price = 9") == [3] and ids("price > 1") == [1, 2] and ids("price >= 250") == [2] and ids("price < 20") == [1]
    assert ids("on = true") == [1] and ids("on = 1") == [2] and ids("on != 'true'") == [2]
    assert ids("name != 'Lamp'") == [2, 4] and ids("NOT name = 'Lamp'") == [2, 3, 4]
    assert ids("kind IS NULL") == [1, 2] and ids("kind IS NOT NULL") == [3, 4]
    assert ids("dim != 5") == [1, 2, 3] and ids("dim = 5") == []
    assert ids("name >= 'Lamp'") == [1] and ids("name > 'A'") == []
    assert ids("1 = 1") == [] and ids("id BETWEEN 1 AND 2") == [] and ids("NOT id BETWEEN 1 AND 2") == [1, 2, 3, 4]
    assert ids("id IN (1, '2', 7)") == [1, 2] and ids("id NOT IN (1)") == [2, 3, 4] and ids("kind NOT IN ('x')") == [4]
    assert ids("id = name") == []


def test_like(make):
    e = make()
    ids = lambda where: [r["id"] for r in rows(e, f"SELECT id FROM goods WHERE {where}")]
    assert ids("name LIKE 'L%'") == [1] and ids("name LIKE '_esk'") == [2] and ids("name ILIKE 'LAMP'") == [1]
    assert ids("name NOT LIKE 'L%'") == [2, 4] and ids("name LIKE 'a.b*c'") == [4] and ids("name LIKE 'a_b%'") == [4]
    assert ids("name LIKE 'a%b'") == [] and ids("price LIKE '%'") == [3] and ids("price NOT LIKE 'z'") == [3]


def test_joins(make):
    e = make()
    assert [r["sid"] for r in rows(e, "SELECT s.sid FROM goods g JOIN sales s ON g.id = s.gid")] == [11, 10]
    assert [r["sid"] for r in rows(e, "SELECT s.sid FROM goods g JOIN sales s ON s.gid = g.id")] == [11, 10]
    assert rows(e, "SELECT g.id, s.n FROM goods g LEFT JOIN sales s ON g.id = s.gid") == [{"id": 1, "n": 2}, {"id": 2, "n": 1}, {"id": 3}, {"id": 4}]
    assert [r["id"] for r in rows(e, "SELECT g.id FROM goods g LEFT JOIN sales s ON g.id = s.gid WHERE s.sid IS NULL")] == [3, 4]
    nulls = rows(e, "SELECT a.sid AS x, b.sid AS y FROM sales a JOIN sales b ON a.gid = b.gid WHERE a.sid IN (13, 14)")
    assert nulls == [{"x": 14, "y": 14}]
    assert len(rows(e, "SELECT * FROM goods g LEFT JOIN sales s ON g.nope = s.gid")) == 4


def test_unqualified_names_are_looked_up_row_by_row(make):
    e = make({"l.json": [{"i": 1, "v": "l"}, {"i": 2}], "r.json": [{"i": 1, "v": "r"}, {"i": 2, "v": "r"}]}, {"l": "$", "r": "$"})
    assert rows(e, "SELECT v FROM l JOIN r ON l.i = r.i") == [{"v": "l"}, {"v": "r"}]


def test_unnest(make):
    e = make()
    assert rows(e, "SELECT id, t FROM goods, UNNEST(tags) AS x(t)") == [{"id": 1, "t": "a"}, {"id": 1, "t": "b"}, {"id": 4, "t": None}, {"id": 4, "t": {"k": 7}}]
    assert rows(e, "SELECT t.k FROM goods, UNNEST(goods.tags) AS x(t) WHERE k = 7") == [{"k": 7}]
    assert rows(e, "SELECT value FROM goods, UNNEST(tags) AS v WHERE id = 1") == [{"value": "a"}, {"value": "b"}]
    assert rows(e, "SELECT id FROM goods, UNNEST(dim) AS x(t)") == []
    chained = make({"n.json": [{"id": 1, "a": [{"b": [1, 2]}, {"b": [3]}]}]}, {"n": "$"})
    assert [r["y"] for r in rows(chained, "SELECT y FROM n, UNNEST(a) AS p(x), UNNEST(x.b) AS q(y)")] == [1, 2, 3]


def test_order(make):
    e = make({"o.json": [{"i": 1, "v": 10}, {"i": 2, "v": "9 kg"}, {"i": 3}, {"i": 4, "v": None}, {"i": 5, "v": "zebra"}, {"i": 6, "v": 2.5}, {"i": 7, "v": "2.5"}]}, {"o": "$"})
    assert [r["i"] for r in rows(e, "SELECT i FROM o ORDER BY v")] == [3, 6, 7, 2, 1, 4, 5]
    assert [r["i"] for r in rows(e, "SELECT i FROM o ORDER BY v DESC")] == [5, 4, 1, 2, 6, 7, 3]
    assert [r["i"] for r in rows(e, "SELECT i FROM o ORDER BY nope")] == [1, 2, 3, 4, 5, 6, 7]
    assert [r["i"] for r in rows(e, "SELECT TOP 2 i FROM o")] == [1, 2]
    g = make()
    assert [r["id"] for r in rows(g, "SELECT id FROM goods ORDER BY dim.size")] == [4, 2, 3, 1]


def test_distinct_comes_last_and_keeps_the_first(make):
    e = make({"d.json": [{"a": 1, "b": "x"}, {"a": 1.5, "b": "y"}, {"a": 1, "b": "x"}, {"b": "y", "a": 1.5}, {"a": None}, {}, {}, {"a": "1"}]}, {"d": "$"})
    assert rows(e, "SELECT DISTINCT a FROM d") == [{"a": 1}, {"a": 1.5}, {"a": None}, {}, {"a": "1"}]
    assert rows(e, "SELECT DISTINCT a FROM d LIMIT 3") == [{"a": 1}, {"a": 1.5}]
    assert len(rows(e, "SELECT DISTINCT * FROM d")) == 5


def test_star_merges_bindings(make):
    e = make({"l.json": [{"i": 1, "v": "l", "only": 1}], "r.json": [{"i": 1, "v": "r"}]}, {"l": "$", "r": "$"})
    assert rows(e, "SELECT * FROM l JOIN r ON l.i = r.i") == [{"i": 1, "v": "r", "only": 1}]
    assert rows(e, "SELECT * FROM l LEFT JOIN r ON l.v = r.v") == [{"i": 1, "v": "l", "only": 1}]


def test_ctes(make):
    e = make()
    assert [r["id"] for r in rows(e, "WITH c AS (SELECT id, price FROM goods WHERE price > 1 ORDER BY price DESC) SELECT id FROM c LIMIT 1")] == [2]
    assert [r["id"] for r in rows(e, "WITH c AS (SELECT id, name FROM goods ORDER BY name DESC) SELECT c.id FROM c LIMIT 2")] == [3, 4]
    assert rows(e, "WITH goods AS (SELECT sid FROM sales WHERE n = 1) SELECT * FROM goods") == [{"sid": 10}]
    assert rows(e, "WITH a AS (SELECT * FROM goods), b AS (SELECT id FROM a WHERE on = true) SELECT x.id FROM b x JOIN a y ON x.id = y.id") == [{"id": 1}]
    with pytest.raises(CatalogError):
        rows(e, "WITH a AS (SELECT * FROM b), b AS (SELECT * FROM goods) SELECT * FROM a")


def test_field_names_differ_by_case(make):
    e = make({"c.json": [{"Name": 1, "name": 2, "NAME": 3}]}, {"c": "$"})
    assert rows(e, "SELECT Name, name, NAME FROM c") == [{"Name": 1, "name": 2, "NAME": 3}]


def test_sources(make, tmp_path):
    e = make({"many/b.json": {"r": [{"x": 2}]}, "many/a.JSON": {"r": [{"x": 1}]}, "many/c.txt": "no", "One.json": {"r": {"x": 5}}, "bad.json": '{"r": [', "mixed.json": {"r": [1, "a", None, [3], {"x": 9}]}}, {"many": "many:$.r", "one": "$.r", "none": "One.json:$.no.such", "gone": "gone.json:$", "bad": "bad.json:$.r", "mixed": "mixed.json:$.r[*]", "empty": "empty:$"})
    assert [r["x"] for r in rows(e, "SELECT x FROM many")] == [1, 2]
    assert rows(e, "SELECT x FROM one") == [{"x": 5}] and rows(e, "SELECT x FROM none") == [] and rows(e, "SELECT x FROM mixed") == [{"x": 9}]
    (tmp_path / "empty").mkdir()
    for name in ("gone", "empty", "unmapped"):
        with pytest.raises(CatalogError):
            e.sql(f"SELECT * FROM {name}")
    with pytest.raises(Exception, match="(?i)json"):
        e.execute("SELECT * FROM bad")


@pytest.mark.parametrize(("path", "found"), [("$.s.b[*]", [1, 2, 3]), ("$.s.b", [1, 2, 3]), ("$['s']['b'][1]", [2]), ("$.s.b[0:2]", [1, 2]), ("$.s.b[-1]", [3]), ("$..b[*]", [1, 2, 3]), ("$.s.b[?(@.i > 1)]", [2, 3]), ("$.s.b[?(@.k == 'p' || @.i == 3)]", [1, 3]), ("$.s.b[0,2]", [1, 3]), ("$.s.*[*]", [1, 2, 3]), ("$.t[*].b", []), ("$.t[*].b[*]", [7])])
def test_jsonpaths(make, path, found):
    e = make({"p.json": {"s": {"b": [{"i": 1, "k": "p"}, {"i": 2}, {"i": 3}]}, "t": [{"c": [{"i": 7}]}] if ".t" not in path else [{"b": [{"i": 7}]}]}}, {"p": path})
    assert [r["i"] for r in rows(e, "SELECT i FROM p")] == found


def test_strict_mode_refuses_what_compat_passes_over(make):
    compat, strict = make(), make(mode="strict")
    for text in ("SELECT id FROM goods WHERE id BETWEEN 1 AND 2", "SELECT COUNT(*) FROM goods", "SELECT id FROM goods GROUP BY id"):
        compat.execute(text)
        with pytest.raises(UnsupportedError):
            strict.execute(text)


def test_parameters_and_json_lines(make, tmp_path):
    e = make({"l.jsonl": '{"i": 1}\n\n{"i": 2}\n'}, {"l": "lines:l.jsonl"})
    assert rows(e, "SELECT i FROM l WHERE i >= ${low:2}") == [{"i": 2}]
    assert len(rows(e, "SELECT i FROM l WHERE i >= ${low:2}", low="1")) == 2
    e.write("SELECT i FROM l", str(tmp_path / "out"))
    assert sorted("".join(p.read_text() for p in (tmp_path / "out").glob("part-*")).split()) == ['{"i":1}', '{"i":2}']
