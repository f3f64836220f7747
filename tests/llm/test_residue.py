from collections import Counter
from hashlib import blake2b

import numpy as np
import pandas as pd

from cantera.llm import ngrams, residue
from cantera.llm.specimens import specimens

NAMES = ["Espesor", "Tipo de terreno", "Anchura"]


def held_out(template):
    return blake2b(template.encode(), digest_size=1).digest()[0] % 5 == 0


def fits(x):
    return not held_out(x[1])


def judged(prose):
    table = np.zeros(ngrams.CELLS)
    cells, counts = ngrams.count(Counter({f" {s} ": n for s, n in prose.items()}), residue.PROSE)
    table[cells] = counts
    return residue.Judge(tuple(NAMES), table, fits)


def test_templates_that_were_not_fitted(small):
    """Recall and precision on templates of which the models saw no text, put among clauses of
    the corpus; look-alikes held out likewise must stay."""
    texts = pd.read_parquet(f"{small}/items.parquet")[["resumen", "texto"]].stack()
    levels = residue.Levels()
    prose = Counter(s for t in texts for s in residue.segments(t, levels))
    sample = specimens(NAMES)
    fitted = [x for x in sample if not held_out(x[1])]
    judge = judged(prose)
    prose = Counter({s: n for s, n in prose.items() if judge.windows([s])[0][0] < residue.MARGIN})
    judge = judged(prose)
    plain = sorted(prose)
    unseen = {label: [x for kind, t, x in sample if held_out(t) and kind == label] for label in ("placeholder", "filler", "notice", "natural")}
    assert all(len(x) > 20 for x in unseen.values())
    found = {label: np.mean([w[0] >= residue.MARGIN for w in judge.windows(x)]) for label, x in unseen.items()}
    inside = [f"{plain[k * 7 % len(plain)]} {x}" for k, x in enumerate(unseen["placeholder"])]
    found["inside"] = np.mean([w[0] >= residue.MARGIN for w in judge.windows(inside)])
    false = sum(w[0] >= residue.MARGIN for w in judge.windows(plain))
    true = {k: len(unseen[k]) * found[k] for k in ("placeholder", "filler", "notice")}
    assert all(found[k] >= 0.9 for k in (*true, "inside")), found
    assert sum(true.values()) / (sum(true.values()) + false) >= 0.95
    # look-alikes of a form never seen are told apart only in part
    assert found["natural"] <= 0.6
    known = [x for kind, t, x in fitted if kind == "natural"]
    assert np.mean([w[0] >= residue.MARGIN for w in judge.windows(known)]) <= 0.05


def test_windows_and_edges(spark, rows):
    prose = ["con tapa abatible, color verde. Medida la unidad ejecutada", "excavación de zanja con medios mecánicos, retirada de sobrantes"]
    data = [(k, prose[k % 2], "x") for k in range(200)]
    data += [(900, "tapa {{ item.color }} abatible", "x"), (901, "<h1>404</h1> <p>The page could not be found</p>", "x"), (902, None, "x"), (903, " ", "x"), (904, "rótulo «acceso denegado», color verde", "x"), (905, prose[0] * 3000 + "\nlorem ipsum dolor sit amet", "x")]
    df = spark.createDataFrame(data, "item_id bigint, text string, kind string")
    found = {r["item_id"]: r for r in residue.residue(df.withColumnRenamed("kind", "field"), ["item_id", "field"], "text", NAMES).collect()}
    assert set(found) == {900, 901, 905}
    assert found[901]["kind"] == "notice" and found[901]["coverage"] > 0.8 and found[905]["coverage"] < 0.01 and found[900]["kind"] == "placeholder"
    assert residue.residue(df.filter("item_id < 0"), ["item_id"], "text", []).collect() == []
