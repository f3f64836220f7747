import random
from collections import Counter, defaultdict

from cantera.llm import splits
from pyspark.sql import functions as F

SCHEMA = "id string, parent string, item string, label string, root string, u string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def brute(rows):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for _, p, i, _ in rows:
        if p is not None and i is not None:
            up[find("p" + p)] = find("i" + i)
    groups = defaultdict(set)
    for _, p, _, _ in rows:
        if p is not None:
            groups[find("p" + p)].add(p)
    return sorted((a, b) for g in groups.values() for a in g for b in g if a < b)


def test_pairs_match_brute_force(spark, rows):
    rnd = random.Random(3)
    data = [(str(k), rnd.choice([None, *map(str, range(60))]), rnd.choice([None, *map(str, range(90))]), "l") for k in range(160)]
    data += [(f"c{k}", f"chain{k // 2}", f"link{(k + 1) // 2}", "l") for k in range(41)]  # one long chain
    data += [(f"h{k}", f"hub{k % 7}", "hot", "l") for k in range(300)]
    assert rows(splits.related_parents(frame(spark, data), "parent", "item")) == sorted(brute(data), key=repr)


def test_splits_keep_components_and_proportions(spark):
    rnd = random.Random(5)
    data = [(str(k), f"p{min(int(rnd.expovariate(0.01)), 900)}", f"i{k if rnd.random() < 0.97 else rnd.randrange(50)}", rnd.choice("aaaaabbbc")) for k in range(4000)]
    data += [("n1", None, "i7", "a"), ("n2", None, None, None), ("n3", None, "alone", "b"), ("n4", None, "alone", "b")]
    df = frame(spark, data)
    found = splits.grouped_splits(splits.record_groups(df, "id", "parent", "item", F.col("label")), {"train": 0.8, "validation": 0.1, "test": 0.1}).toPandas()
    assert len(found) == len(data) and set(found["split"]) <= {"train", "validation", "test"}
    of = dict(zip(found["record_id"], found["split"]))
    for key in (1, 2):
        by = defaultdict(set)
        for r in data:
            if r[key] is not None:
                by[r[key]].add(of[r[0]])
        assert all(len(s) == 1 for s in by.values())
    share = Counter(of.values())
    assert abs(share["train"] / len(data) - 0.8) < 0.1


def one_by_one(vectors, ratios):
    """Iterative stratification of single components, a step for each."""
    total = Counter()
    for v in vectors.values():
        total.update(v)
    need = {s: {x: r * n for x, n in total.items()} for s, r in ratios.items()}
    room = {s: r * sum(total.values()) for s, r in ratios.items()}
    left, out = dict(vectors), {}
    while left:
        label = min((x for x in total if total[x] > 0), key=lambda x: (total[x], x))
        for c in sorted((c for c in left if label in left[c]), key=lambda c: (-left[c][label], sorted(left[c]), [left[c][x] for x in sorted(left[c])])):
            s = max(ratios, key=lambda s: (round(need[s][label], 6), round(room[s], 6), -list(ratios).index(s)))
            out[c] = s
            for x, n in left.pop(c).items():
                need[s][x] -= n
                room[s] -= n
                total[x] -= n
    return out


def test_classes_are_placed_as_components_one_by_one(spark):
    rnd = random.Random(9)
    vectors = {f"k{i}": {x: rnd.randint(1, 3) for x in rnd.sample([f"l{j}" for j in range(90)], rnd.randint(1, 2))} for i in range(150)}
    vectors |= {f"s{i}": {"a": 1} for i in range(300)} | {f"t{i}": {"a": 1, "b": 2} for i in range(80)}
    ratios = {"x": 0.5, "y": 0.3, "z": 0.2}
    rows = [(f"{c}-{x}-{j}", c, x) for c, v in vectors.items() for x, n in v.items() for j in range(n)]
    found = splits.grouped_splits(spark.createDataFrame(rows, "record_id string, component string, label string"), ratios).toPandas()
    of = dict(zip(found["component"], found["split"]))
    shape = lambda c: tuple(sorted(vectors[c].items()))
    want = Counter((shape(c), s) for c, s in one_by_one(vectors, ratios).items())
    got = Counter((shape(c), s) for c, s in of.items())
    assert len(found) == len(rows) and sum((want - got).values()) <= 3  # ties of equal need


def test_shares():
    assert splits.shares([8.0, 1.0, 1.0], [8, 1, 1], 1, 10) == [8, 1, 1]
    assert sum(splits.shares([0.0, 0.0], [1, 2], 3, 10**9)) == 10**9
    assert splits.shares([5.0, 5.0], [1, 2], 10, 1) == [0, 1]


def test_empty(spark, rows):
    df = frame(spark, [])
    assert rows(splits.related_parents(df, "parent", "item")) == []
    assert rows(splits.grouped_splits(splits.record_groups(df, "id", "parent", "item", F.col("label")), {"a": 1.0})) == []
