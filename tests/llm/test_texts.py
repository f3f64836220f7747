import base64
import random
from collections import defaultdict

import pytest
from cantera.llm import charforms, encodings, leakage, ngrams, tokens

PLAIN = "Canalización enterrada bajo calzada, con señalización y báculo de 3 m²; montaje según dirección técnica en túnel de línea, marca Größwerk."


def test_tokens_equal_the_public_encoder(spark, small):
    tiktoken = pytest.importorskip("tiktoken")
    path = f"{tokens.FOLDER}/byte_bpe_50k.tiktoken"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    want = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aaab  \n'st é日🚧0<|endoftext|>") for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    texts += [None, "", "a" * 3000, " " * 500, "ab" * 999, PLAIN * 200]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    found = {r[0]: r[1] for r in tokens.encoded(df, "doc_id", "text").collect()}
    assert len(found) == len(texts)
    assert all(found[i] == (want.encode_ordinary(t) if t else []) for i, t in enumerate(texts))
    assert tokens.encoded(df.filter("doc_id < 0"), "doc_id", "text").collect() == []
    model = tokens.ByteBpe(path)
    assert [list(x) for x in model.encode(texts[:50], {})] == [want.encode_ordinary(t) for t in texts[:50]]


def leaks(docs, passages, run=12):
    grams = defaultdict(set)
    for p, t in passages:
        w = charforms.words(t) if t else []
        n = min(run, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams[n, tuple(w[k : k + n])].add(p)
    out = set()
    for d, t in docs:
        w = charforms.words(t) if t else []
        for n in {n for n, _ in grams}:
            for k in range(len(w) - n + 1):
                out |= {(d, p) for p in grams.get((n, tuple(w[k : k + n])), ())}
    return sorted(out, key=repr)


def test_leaks_match_brute_force(spark, rows):
    rnd = random.Random(8)
    word = lambda: rnd.choice(["de", "la", "el", "zanja", "obra", "muro", "cal", "río", "sol", "mar"])
    passages = [(k, " ".join(word() for _ in range(rnd.randint(1, 30)))) for k in range(12)] + [(50, ""), (51, None), (52, "único"), (53, "¡¿?!"), (54, "de de de de de de de de de de de de de")]
    docs = []
    for k in range(120):
        body = " ".join(word() for _ in range(rnd.randint(0, 40)))
        source = rnd.choice(passages)[1] or ""
        cut = source.split()[rnd.randint(0, 3) :]
        docs.append((k, f"{body} {' '.join(cut).upper()}. {body}" if rnd.random() < 0.6 else body))
    docs += [(900, None), (901, ""), (902, "ÚNI​CO"), (903, "unіco"), (904, "de " * 5000)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, term int")
    p = spark.createDataFrame([(*x, 1) for x in passages], "passage_id bigint, text string, at int")
    found = leakage.matches(d, "doc_id", "text", p, "passage_id", "text")
    assert rows(found.select("doc_id", "passage_id")) == leaks(docs, passages)
    assert {(902, 52), (903, 52)} <= {tuple(r) for r in rows(found.select("doc_id", "passage_id"))}
    assert leakage.matches(d.filter("false"), "doc_id", "text", p, "passage_id", "text").collect() == []
    assert leakage.matches(d, "doc_id", "text", p.filter("false"), "passage_id", "text").collect() == []


def test_passages_in_parts_give_the_same(spark, rows, monkeypatch):
    p = spark.createDataFrame([(k, f"uno dos tres {'abcdefghij'[k]}") for k in range(10)] + [(20, None)], "passage_id bigint, text string")
    d = spark.createDataFrame([(k, f"x uno dos tres {'abcdefghij'[k % 10]} y") for k in range(30)], "doc_id bigint, text string")
    want = rows(leakage.matches(d, "doc_id", "text", p, "passage_id", "text"))
    monkeypatch.setattr(leakage, "MOST_WORDS", 15)
    assert len(leakage.in_parts(p, "passage_id", "text")) == 3 and len(want) == 30
    assert rows(leakage.matches(d, "doc_id", "text", p, "passage_id", "text")) == want


def near(docs, passages, run, gap):
    out = {}
    for d, t in docs:
        w = charforms.words(t) if t else []
        for p, s in passages:
            q = charforms.words(s) if s else []
            for at in range(-len(q) + 1, len(w)):
                n, last = 0, None
                for k in range(max(0, -at), min(len(q), len(w) - at)):
                    if w[at + k] == q[k]:
                        n = n + 1 if last is not None and k - last <= gap + 1 else 1
                        last = k
                        if n >= min(run, len(q)):
                            out[d, p] = max(n, out.get((d, p), 0))
    return sorted(((*k, n) for k, n in out.items()), key=repr)


def test_near_matches_equal_brute_force(spark, rows, monkeypatch):
    rnd = random.Random(9)
    word = lambda: rnd.choice(["de", "la", "el", "zanja", "obra", "muro", "cal", "río", "sol", "mar"])
    passages = [(k, " ".join(word() for _ in range(rnd.randint(1, 40)))) for k in range(12)] + [(50, ""), (51, None), (52, "único")]
    passages += [(60, " ".join(f"rara{k}" for k in range(36)))]  # every word is rare, most occur nowhere else
    docs = []
    for k in range(60):
        body = rnd.choice(passages[:12])[1].split()[rnd.randint(0, 3) :]
        docs.append((k, " ".join([word() for _ in range(rnd.randint(0, 30))] + [word() if rnd.random() < 0.2 else w for w in body])))
    third = [f"rara{k}" if k % 3 == 0 else "otra" for k in range(36)]  # twelve words, two differing between each
    docs += [(900, None), (901, ""), (902, "ÚNICO"), (903, " ".join(third)), (904, " ".join(third[:33])), (905, "de " * 300 + " ".join(third))]
    docs += [(906, " ".join("otra" if k == 5 else f"rara{k}" for k in range(14))), (907, " ".join("otra" if 9 < k < 13 else f"rara{k}" for k in range(20)))]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, term int")
    p = spark.createDataFrame([(*x, 1) for x in passages], "passage_id bigint, text string, at int")
    want = near(docs, passages, 12, 2)
    assert {(903, 60, 12), (905, 60, 12), (906, 60, 13)} <= set(want) and not {(904, 60), (907, 60)} & {x[:2] for x in want}
    assert rows(leakage.matches(d, "doc_id", "text", p, "passage_id", "text", gap=2)) == want
    assert leakage.matches(d, "doc_id", "text", p.filter("false"), "passage_id", "text", gap=2).collect() == []
    # stretches and steps far smaller than the documents give the same
    monkeypatch.setattr(leakage, "STRETCH", 16)
    monkeypatch.setattr(leakage, "PAIRS", 100)
    terms = {w: k for k, w in enumerate(sorted({w for _, t in passages if t for w in charforms.words(t)}))}
    held = leakage.NearPassages({i: [terms[w] for w in charforms.words(t)] for i, t in passages if t}, len(terms), 12, 2)
    code = lambda t: leakage.np.array([terms.get(w, -1) for w in charforms.words(t)], "int64")
    assert sorted(((i, *x) for i, t in docs if t for x in held.longest(code(t)).items()), key=repr) == want


def test_forms_that_look_alike():
    same = ["Fijación 3 de", "Fijación 3 de", "Ｆｉjación 3 de", "ﬁ".join(["", ""]) and "Fijаción 3 de", "Fija​ción 3 de", "Fija­ción 3 dе"]
    assert len({charforms.visual_form(x) for x in same}) == 1
    apart = ["m2", "m²", "M2", "1/2", "½", "a", "ª", "á", "à"]
    assert len({charforms.visual_form(x) for x in apart}) == len(apart)
    assert charforms.visual_form("Ω µ") == charforms.visual_form("Ω μ")
    assert charforms.visual_form("\u0600") == "\u0600" and charforms.visual_form("a\u2065b\ufff3\U000e0000") == "ab"
    assert charforms.comparison_form(" M²\t½ ") == "m2 1⁄2"


def test_pairs_of_lookalikes(spark, rows):
    texts = ["obra ya", "obra ya", "оbra ya", "obra ya", "Obra ya", None, "", " ", " ", "x" * 50000, "x" * 49999 + "х"]
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id bigint, text string, looks string")
    want = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (9, 10)]
    assert rows(charforms.lookalike_pairs(df, "doc_id", "text")) == want
    assert rows(charforms.lookalike_pairs(df.filter("false"), "doc_id", "text")) == []
    classes = rows(charforms.lookalike_classes(df, "doc_id", "text").select("record_id", "class_id"))
    assert sorted(classes) == [(0, 0), (1, 0), (2, 0), (3, 0), (9, 9), (10, 9)]
    plain = ["Él «niño» ÑU—x ", "\tÉl  «niño» ñu—x", "İ", "ß", "straße"]
    both = spark.createDataFrame([(i, t) for i, t in enumerate(plain)], "doc_id bigint, text string")
    found = {r[0]: r for r in charforms.form_digests(both, "doc_id", "text").collect()}
    assert {i: bytes(r["folded"]) for i, r in found.items()} == {i: charforms._digest(charforms.comparison_form(t)) for i, t in enumerate(plain)}
    assert all(bytes(r["looks"]) == charforms._digest(charforms.visual_form(plain[i])) for i, r in found.items())
    forms = charforms.normalized(df, "text").orderBy("doc_id").collect()
    assert len({r["text"] for r in forms[:5]}) == 1 and forms[5]["text"] is None and forms[6]["text"] == ""


def garbled(text, chain):
    read_as, truly = chain
    return text.encode(truly).decode(read_as, "replace") if read_as != "cp1252" else "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode(truly))


def test_misread_values_come_back(spark):
    words = ["canalización", "señalización", "báculo", "técnica", "dirección", "galería", "andén", "única", "túnel", "próxima", "mm²", "m³", "añil", "élite", "Maß", "MAÇÃ", "½", "±3", "«obra»"]
    rnd = random.Random(6)
    clean = [" ".join(rnd.choice(words) for _ in range(rnd.randint(2, 9))) + f", pieza {k}" for k in range(1500)]
    bad = {}
    chains = [("cp1252", "utf-8"), ("cp437", "utf-8"), ("mac_roman", "utf-8"), ("cp1250", "utf-8"), ("cp1252", "cp850"), ("cp850", "cp1252")]
    for k, chain in enumerate(chains * 4):
        text = f"canalización técnica en galería {k}, señalización próxima"
        bad[3000 + k] = (text, garbled(text, chain))
    twice = garbled(garbled("dirección técnica", ("cp1252", "utf-8")), ("cp1252", "utf-8"))
    bad[4000] = ("dirección técnica", twice)
    data = [(k, t, 1) for k, t in enumerate(clean)] + [(k, b, 1) for k, (_, b) in bad.items()]
    data += [(5000, "direcci�n", 1), (5001, None, 1), (5002, "", 1), (5003, "plain", 1), (5004, "señalización " * 5000, 1)]
    df = spark.createDataFrame(data, "row_id bigint, value string, chain int")
    found = {r["row_id"]: r["restored"] for r in encodings.misread(df.drop("chain"), ["row_id"], "value").collect()}
    assert set(found) == {*bad, 5000}
    right = sum(found[k] == text for k, (text, _) in bad.items())
    assert right >= 0.9 * len(bad)
    assert encodings.misread(df.filter("false"), ["row_id"], "value").collect() == []


def test_margin_is_validated_on_every_word(spark):
    import numpy as np

    rnd = random.Random(9)
    letters = "abcdeiloprstuáéíóúñ¾Ã"
    words = {w: 3 for w in ("canalización", "canalizaci¾n", "µm")} | {"ñ" + "".join(rnd.choices(letters, k=9)): rnd.randrange(1, 4) for _ in range(4300)}
    words["canalización"] = 90
    df = spark.createDataFrame([(" ".join(ws),) for w, n in words.items() for ws in [[w] * n]], "value string")
    model, counted = encodings.train(df.repartition(3), "value")
    known = {r["word"]: r["n"] for r in counted.rows.collect()}
    assert len(known) > 4000
    assert all(words[w] == n for w, n in known.items())
    runs = encodings._Runs()
    clean = [w for w, n in known.items() if n > 1]
    best = encodings.best_chains(clean, model, runs)
    gain = [0.0 if b is None or known.get(encodings._candidates(w, runs)[b[0]], 0) > encodings.GARBLED * known[w] else b[1] for w, b in zip(clean, best)]
    for least, most in ((1.5, 12.0), (0.5, 40.0)):
        found = [b[1] if b else 0.0 for b in encodings.best_chains(encodings._spoiled([w for w, g in zip(clean, gain) if g < least]), model, runs)]
        errors = {m: sum(f < m for f in found) / len(found) + sum(g >= m for g in gain) / len(gain) for m in np.arange(least, most, 0.5)}
        assert encodings.validate(counted.rows, model, least, most) == min(errors, key=errors.get)
    assert encodings.validate(counted.rows.filter("false"), model) == 6.75


def test_model_probabilities_sum_below_one():
    from collections import Counter

    model = ngrams.model_of(Counter({"abab": 50, "abba": 20}), 3)
    p = sum(2.718281828 ** model.log_probs([f"ab{c}"])[0][2] for c in "abcdefgh")
    assert 0.5 < p <= 1.0
    assert model.score(["abab"])[0] > model.score(["bbbb"])[0]
