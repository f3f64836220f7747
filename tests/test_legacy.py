import json

from cantera.sources import legacy


def test_variants(spark, tmp_path):
    value = lambda *v: [{"label": a, "value": b} for a, b in v]
    data = {
        "AB1$": {"ud": "m", "concept": "c", "resumen": "r", "texto": "t", "parameters": {"A": {"label": "W", "values": value(("a", "1"), ("b", "2"))}, "B": {"label": "S", "values": value(("a", "x"), ("b", "y"), ("c", "z"))}}},
        "P1": {"ud": "u", "concept": "plain", "resumen": [], "texto": []},
    }
    (tmp_path / "s.json").write_text(json.dumps(data), encoding="utf-8")
    rows = legacy.read_items(spark, str(tmp_path))
    found = {r["item_key"]: r for r in legacy.variants(rows).collect()}
    assert set(found) == {"P1", *(f"AB1{a}{b}" for a in "ab" for b in "abc")}
    one = found["AB1bc"]
    assert one["parent_key"] == "AB1$" and one["parameters"]["B"]["values"][0]["value"] == "z" and one["parameters"]["A"]["values"][0]["value"] == "2"
    assert found["P1"]["texto"] == "plain"
    assert legacy.derived_only(legacy.variants(rows)).count() == 6
