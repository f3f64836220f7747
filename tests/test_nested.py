import json

import pyarrow.parquet as pq
import pytest
from cantera.operators import nested
from cantera.plans import training


def brute(v, path="", owner="", top=True):
    out = []
    if isinstance(v, dict):
        if not top:
            out.append((owner, path))
        for k, x in v.items():
            out += brute(x, f"{path}.{k}" if path else k, path, False)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            out += brute(x, f"{path}.{i}" if path else str(i), owner, False)
    return out


PAYLOADS = [
    {"a": [{"b": []}, None, {"c": {"d": [[{"e": 1}], {}]}}], "x": {}, "t": "{no}"}, {"p": {"A": {"values": [{"label": "1", "value": "2,5"}]}}}, [], [{"k": 1}], 3, None, "s",
]


def test_objects_match_brute_force(spark, rows):
    texts = [json.dumps(p) for p in PAYLOADS] + ["", "  ", None, '{"a": [{"b"', "{'a': 1}", '{"a": NaN}', '{"deep": ' * 3000 + "1" + "}" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "raw_id bigint, payload string")
    want = [(i, o, p) for i, v in enumerate(PAYLOADS) for o, p in brute(v)]
    found = rows(nested.json_links(df, "raw_id", "payload"))
    assert [f for f in found if f[0] < len(PAYLOADS)] == sorted(want, key=repr)
    assert {f[0] for f in found} <= {*range(len(PAYLOADS)), len(texts) - 1}


def test_child_tables_and_schema(spark, rows):
    df = spark.createDataFrame([(1, '{"l": [{"n": "1,5", "ord": 2, "ok": true}, {"n": 2, "m": null}]}')], "raw_id bigint, payload string")
    objects = nested.json_objects(df, "raw_id", "payload")
    schema = {(r[0], r[1]): r[2] for r in nested.merged_schema(objects).collect()}
    assert schema == {("l[]", "n"): "double", ("l[]", "ord"): "bigint", ("l[]", "ok"): "boolean", ("l[]", "m"): "string"}
    table = nested.child_table(objects, "l[]", [("n", "double"), ("ord", "bigint"), ("ok", "boolean")])
    assert table.columns == ["record_id", "parent_path", "obj_path", "ord", "n", "ord_", "ok"]
    assert rows(table) == [(1, "", "l.0", 0, 1.5, 2, True), (1, "", "l.1", 1, 2.0, None, None)]


def test_typed_columns(spark, rows):
    schema = "id int, a array<struct<v:int, ord:string, s:struct<w:int>, b:array<struct<z:int>>>>"
    df = spark.createDataFrame([(1, [(7, "o", (8,), [(9,), None]), None]), (2, None), (3, [])], schema)
    found = nested.explode_nested(df, "id")
    assert set(found) == {"a", "a.b"}
    assert found["a"].columns == ["record_id", "parent_ord", "ord", "v", "ord_", "s_w"]
    assert rows(found["a"]) == [(1, "", 0, 7, "o", 8)]
    assert rows(found["a.b"]) == [(1, "0", 0, 9)]


def test_every_path_has_a_table(spark, rows):
    texts = ['{"l": [{"n": "1,5", "N": 1, "q": [{}, {"v": "x"}]}, {"n": 2, "type": null}], "e": {"in": {}}}', '{"l": [{"ok": true}], "top": 1}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "raw_id bigint, payload string")
    found = nested.child_tables(nested.json_objects(df, "raw_id", "payload"))
    assert {k: t.columns[4:] for k, t in found.items()} == {"": ["top"], "l[]": ["N", "n_", "ok", "type"], "l[].q[]": ["v"], "e": [], "e.in": []}
    assert rows(found["l[]"]) == [(0, "", "l.0", 0, 1, 1.5, None, None), (0, "", "l.1", 1, None, 2.0, None, None), (1, "", "l.0", 0, None, None, True, None)]
    assert rows(found["l[].q[]"]) == [(0, "l.0", "l.0.q.0", 0, None), (0, "l.0", "l.0.q.1", 1, "x")]
    assert rows(found["e.in"]) == [(0, "e", "e.in", 0)]


def test_levels_hold_every_object_and_member(spark, small, rows):
    payloads = {r["raw_id"]: r["payload"] for r in pq.read_table(f"{small}/raw_items.parquet", columns=["raw_id", "payload"]).to_pylist()}
    want = {(i, o, p): dict(f) for i, t in payloads.items() for s, o, p, _, f in nested._objects(t) if s}
    seen = {}
    for name in ("lines", "parameters", "values", "quotes", "steps", "others"):
        for r in training.QUERIES[f"p5_{name}"](spark, small).collect():
            x = r.asDict()
            key = x.pop("raw_id"), x.pop("parent_path"), x.pop("obj_path")
            assert key not in seen
            seen[key] = {k: v for k, v in x.items() if k != "ord" and v is not None}
    assert set(seen) == set(want) == {tuple(r) for r in rows(training.p5_found(spark, small))}
    for key, members in want.items():
        given = {k: v for k, v in members.items() if v is not None}
        assert set(given) == set(seen[key])
        assert all(v == seen[key][k] if isinstance(seen[key][k], str) else float(v.replace(",", ".")) == seen[key][k] for k, v in given.items())


def test_deep_payloads_and_long_numbers():
    deep = '{"deep": ' * 6000 + "[" * 6000 + "{}" + "]" * 6000 + "}" * 6000
    assert len(nested._objects(deep)) == 6001 and nested._objects(deep[:-1]) == [] and nested._objects(deep + "}") == []
    assert nested._objects('{"n": ' + "7" * 5000 + ', "m": [{}]}')[0][4] == [("n", "7" * 5000)]
    texts = [json.dumps(p) for p in PAYLOADS] + ['{"a": -0.5e3, "b": "\\u00e9\\n", "c": [true, null, 12]}', " [ ] "]
    assert all(nested._parsed(t) == json.loads(t, parse_int=str) for t in texts)
    for bad in ("", "{", "[1,]", '{"a":1,}', '{"a" 1}', "01", "NaN", "tru", '"a', "[1 2]", "{1: 2}", "[}", '{"a": 1]', "1 2", "]"):
        with pytest.raises(ValueError):
            nested._parsed(bad)
