import random
import re
import unicodedata
from collections import defaultdict

from cantera.llm import copies

SCHEMA = "item_id bigint, resumen string, texto string, digest string, maybe string"


def canon(s):
    s = s.lower()
    keep = []
    for i, c in enumerate(s):
        if unicodedata.category(c)[0] in "LMN":
            keep.append(c)
        elif not c.isspace() and c != "_" and 0 < i < len(s) - 1 and s[i - 1] in "0123456789" and s[i + 1] in "0123456789":
            keep.append(c)
    return "".join(keep)


def brute(rows):
    sets = defaultdict(list)
    for i, r, t in rows:
        if r is not None and t is not None:
            key = canon(r), tuple(sorted(f for x in re.split(r"[\n\r;]", t) if (f := canon(x))))
            if key[0] and key[1]:
                sets[key].append(i)
    return sorted((min(v), len(v)) for v in sets.values() if len(v) > 1)


def test_sets_match_brute_force(spark, rows):
    rnd = random.Random(2)
    base = [("Tubería DN 1,5", "Suministro; Color: rojo\nAncho: 0,40 m³"), ("Viga", "a;b;b"), ("Viga", "a;b"), ("½ pie", "x 3-4 y"), ("½ pie", "x 3 4 y"), ("Ñandú", "é"), ("Nandu", "e")]
    data = []
    for k in range(400):
        r, t = rnd.choice(base)
        parts = t.split(rnd.choice(";\n") if rnd.random() < 0.5 else ";")
        if rnd.random() < 0.5:
            rnd.shuffle(parts)
        t = rnd.choice([";", " ;\n", "\n"]).join(p.upper() if rnd.random() < 0.3 else f" «{p}»! " for p in parts)
        data.append((k, r if rnd.random() < 0.5 else f"{r.upper()} .", t))
    data += [(900, None, "x"), (901, "x", None), (902, "", ""), (903, " .", ";;"), (904, " .", ";;"), (905, "lone", "one"), (906, "big", "w " * 60000), (907, "BIG", "w" * 60000)]
    df = spark.createDataFrame([(*d, "x", "y") for d in data], SCHEMA)
    found = rows(copies.copy_sets(df, "item_id", "resumen", "texto", singletons=False))
    assert found == sorted(brute(data), key=repr)
    every = copies.copy_sets(df, "item_id", "resumen", "texto").toPandas()
    assert every["n_copies"].sum() == len(data)
    assert {902, 903, 904, 905} <= set(every[every["n_copies"] == 1]["record_id"])


def test_filter_has_no_false_negatives(spark, monkeypatch):
    monkeypatch.setattr(copies, "RECORDS", 100)
    df = spark.createDataFrame([(k, f"t{k % 700}", "b", "", "") for k in range(1000)], SCHEMA)
    marked = copies.split_repeats(df, "item_id", "resumen", "texto").toPandas()
    again = marked["digest"].map(bytes).duplicated(keep=False)
    assert marked[again]["maybe"].all() and not marked[~again]["maybe"].any()


def test_empty(spark, rows):
    assert rows(copies.copy_sets(spark.createDataFrame([], SCHEMA), "item_id", "resumen", "texto")) == []
