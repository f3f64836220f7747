import itertools
import math
import random
import re
from collections import Counter

import pytest

from cantera.functions import text as X
from cantera.operators import dedupe, metrics, reconcile, retrieval
from cantera.plans import catalogue, expand
from cantera.session import Cut
from pyspark.sql import functions as F


def test_marking_and_reports(spark, rows):
    df = spark.createDataFrame([("k1", "a", "x"), ("k2", "a ", "y"), ("k3", "b", "y"), ("k4", "c", "z"), ("k5", None, None)], "k string, r string, t string")
    marked = {r["k"]: r["validation"] for r in dedupe.mark_duplicates(df, "r", "t").collect()}
    assert marked == {"k1": False, "k2": False, "k3": False, "k4": True, "k5": True}
    assert [r["k"] for r in dedupe.unique_items(df, "r", "t").orderBy("k").collect()] == ["k4", "k5"]
    assert {r["k"] for r in dedupe.duplicate_flags(df, "r", "t").collect()} == {"k1", "k2", "k3"}
    assert dedupe.sample_rows(df, 2, "k").collect() == dedupe.sample_rows(df, 2, "k").collect()
    assert dedupe.sample_rows(df, 99, "k").count() == 5


def test_ranking_with_either_query_length(spark):
    docs = spark.createDataFrame([(0, "a b a"), (1, "b c")], "d int, t string")
    asked = spark.createDataFrame([(9, "c a zz")], "q int, t string")
    found = {r["doc"]: r["score"] for r in retrieval.top_k(docs, "d", "t", asked, "q", "t", 5, "reference").collect()}
    assert found == pytest.approx({0: 0.040935, 1: 0.484376}, abs=2e-6)
    assert [r["doc"] for r in retrieval.top_k(docs, "d", "t", asked, "q", "t", 1).collect()] == [1]


def _ranking(docs, asked, k):
    """Query, rank and document by scoring every pair."""
    words = {d: Counter(re.findall(r"\w+", (t or "").lower())) for d, t in docs}
    size = {d: sum(c.values()) for d, c in words.items()}
    cf, mean = sum(words.values(), Counter()), sum(size.values()) / len(docs)
    weight = lambda t, tf, n: math.log((len(docs) + 1) / (cf[t] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))
    for q, text in asked:
        own = Counter(re.findall(r"\w+", (text or "").lower()))
        scores = {d: round(sum(weight(t, n, sum(own.values())) * weight(t, c[t], size[d]) for t, n in own.items() if t in c), 6) for d, c in words.items()}
        for rank, d in enumerate(sorted(scores, key=lambda d: (-scores[d], d))[:k], 1):
            yield q, rank, d


@pytest.mark.parametrize("part, block, common", [(500_000, 1 << 22, 256), (60, 300, 2), (200, 1, 0)])
def test_ranking_sends_few_pairs_and_all_of_the_best(spark, monkeypatch, part, block, common):
    rnd = random.Random(3)
    shares = [1 / (k + 1) for k in range(60)]
    docs = [(f"d{k:03}", " ".join(["de"] * rnd.randrange(4) + [f"w{x}" for x in rnd.choices(range(60), shares, k=rnd.randrange(12))])) for k in range(300)]
    docs += [("e1", None), ("e2", ""), *((f"f{k}", "w1 w2 w3 de") for k in range(30))]
    asked = [(k, " ".join(f"w{x}" for x in rnd.choices(range(62), [*shares, 0.1, 0.1], k=rnd.randrange(1, 8))) + " de") for k in range(50)] + [(50, None), (51, "w61"), (52, "w1 w2 w3 de")]
    monkeypatch.setattr(retrieval, "PART", part)
    monkeypatch.setattr(retrieval, "BLOCK", block)
    monkeypatch.setattr(retrieval, "COMMON", common)
    sent = []

    def watched(df, **aggregates):
        made = Cut(df, **aggregates)
        if "doc" in df.columns:
            sent.append(made.rows.count())
        return made

    monkeypatch.setattr(retrieval, "Cut", watched)
    some = docs if block > 1 else docs[:20] + docs[-5:]
    found = retrieval.top_k(spark.createDataFrame(some, "d string, t string").repartition(2), "d", "t", spark.createDataFrame(asked, "q int, t string"), "q", "t", 10)
    assert sorted((r["query"], r["rank"], r["doc"]) for r in found.collect()) == list(_ranking(some, asked, 10))
    pairs = sum(1 for _, text in asked for _, d in some if set((text or "").split()) & set((d or "").split()))
    assert sum(sent) < pairs / (4 if block > 1000 else 1)


#: Queries on a ranking: what they return is worked out from few candidates that are written before.
RANKED = ["q30_bm25_reference_length", "q31_metrics_single", "q32_metrics_overall", "q31_position_distribution", "q33_metrics_prefix", "q30_bm25_topk"]


@pytest.mark.parametrize("name", RANKED)
def test_queries_on_a_ranking_join_no_words(spark, small, name):
    found = catalogue.QUERIES[name](spark, small)
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() > 0


def test_ranking_of_nothing(spark):
    docs, none = spark.createDataFrame([(2, None), (1, "")], "d int, t string"), spark.createDataFrame([], "d int, t string")
    asked = spark.createDataFrame([(7, "a b"), (8, None)], "q int, t string")
    for length in ("self", "reference"):
        ranked = lambda c, q: [(r["query"], r["rank"], r["doc"], r["score"]) for r in retrieval.top_k(c, "d", "t", q, "q", "t", 5, length).orderBy("query", "rank").collect()]  # noqa: B023, E731
        assert ranked(docs, asked) == [(7, 1, 1, 0.0), (7, 2, 2, 0.0), (8, 1, 1, 0.0), (8, 2, 2, 0.0)]
        assert ranked(none, asked) == [] == ranked(docs, asked.limit(0))


def test_metrics(spark):
    ranks = spark.createDataFrame([(q, k, f"{q}{k}") for q in "abc" for k in (1, 2, 3)], "query string, rank int, doc string")
    asked = spark.createDataFrame([("a", "a1"), ("b", "b3"), ("c", "no")], "query string, gold string")
    hits = metrics.first_hits(ranks, asked, F.col("doc") == F.col("gold"))
    one = metrics.single_match(hits).first()
    assert tuple(one) == pytest.approx((0.666667, 0.444444, 2.0, 2.0, 0.333333))
    assert tuple(metrics.overall(hits).first()) == pytest.approx((0.666667, 0.222222, 0.333333, 0.444444, 0.444444))
    shares = [r["share"] for r in metrics.position_distribution(hits, 3).orderBy("position").collect()]
    assert sum(shares) == pytest.approx(one["success"], abs=1e-5)
    four = spark.createDataFrame([(str(k), k, k) for k in (1, 2, 3, 4)], "query string, hit int, n_retrieved int")
    assert metrics.single_match(four, upper_median=True).first()["median_position"] == 3
    assert metrics.single_match(four).first()["median_position"] == 2.5
    assert metrics.overall(four.filter("hit > 9")).first()["recall"] is None


def test_reconcile(spark):
    pairs = [("1", "a  b", "a b"), ("2", "i >== 5", "i >= 5"), ("3", '< "3"', "< 3"), ("4", "a", "b"), ("5", "s", "s")]
    left = spark.createDataFrame([(k, a) for k, a, _ in pairs] + [("6", "x")], "k string, t string")
    right = spark.createDataFrame([(k, b) for k, _, b in pairs] + [("7", None)], "k string, t string")
    found = reconcile.classify(left, right, "k", "t")
    assert {r["key"]: r["class"] for r in found.collect()} == {"1": "whitespace", "2": "corruption", "3": "corruption", "4": "other", "5": "exact", "6": "only_left", "7": "only_right"}
    assert "| other | 1 |" in reconcile.report(found, "Report")


def test_numbers_and_texts(spark):
    df = spark.createDataFrame([("6,5 kV",), ("1-5",), ("x",), ("  -.5a",)], "t string").select(X.to_number(F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == [6.5, 1.0, 0.0, -0.5]
    df = spark.createDataFrame([(2.0,), (0.16,), (-0.0,), (1e-12,)], "v double").select(X.to_text(F.col("v")).alias("t"))
    assert [r["t"] for r in df.collect()][:3] == ["2", "0.16", "0"]
    letters = spark.range(1, 63).select(X.option_number(X.option_letter(F.col("id"))).alias("k"), "id").collect()
    assert all(r["k"] == r["id"] for r in letters)


def test_families_expand_over_all_parameters(spark, rows, monkeypatch, tmp_path):
    sizes = {"AAA1$": [2, 3, 1, 4, 2], "AAA2$": [3], "AAA3$": [], "AAA4$": [2, 0, 2], "AAA5$": [7, 2], "AAA6$": [1, 1, 5, 3]}
    options = {f: [[f"{f}{i}_{k}" for k in range(n)] for i, n in enumerate(s)] for f, s in sizes.items()}
    kind = "code string, params array<struct<var:string,name:string,options:array<string>>>"
    df = spark.createDataFrame([(f, [("v", "n", o) for o in os]) for f, os in options.items()] + [("AAA7$", None)], kind)
    df.write.parquet(str(tmp_path / "families.parquet"))
    want = [("AAA7$", 0, "AAA7", "")]
    for f, os in options.items():
        for n, picked in enumerate(itertools.product(*map(enumerate, os))):
            want.append((f, n, f[:-1] + "".join(X.LETTERS[k] for k, _ in picked), "|".join(o for _, o in picked)))
    for block, leads in ((4096, 256), (6, 2), (1, 1)):
        monkeypatch.setattr(expand, "BLOCK", block)
        monkeypatch.setattr(expand, "LEADS", leads)
        assert rows(catalogue.QUERIES["q07_family_expand"](spark, str(tmp_path))) == sorted(want, key=repr)
