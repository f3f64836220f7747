import random
from collections import Counter, defaultdict

from cantera.operators import skew


def data(spark):
    rnd = random.Random(1)
    values = [(("hot" if rnd.random() < 0.6 else rnd.choice("abc")), rnd.choice([None, *range(40)])) for _ in range(3000)]
    values += [(None, 1), ("only null", None), ("tie", 5), ("tie", 3)]
    return values, spark.createDataFrame(values, "k string, v int")


def test_counts_modes_percentiles(spark, rows):
    values, df = data(spark)
    by = defaultdict(list)
    for k, v in values:
        if k is not None:
            by[k].append(v)
    w = skew.compress(df, "k", "v")
    assert rows(skew.key_counts(w)) == sorted(((k, len(v), len({x for x in v if x is not None})) for k, v in by.items()), key=repr)
    modes = []
    for k, v in by.items():
        c = Counter(x for x in v if x is not None)
        if c:
            top = max(c.values())
            modes.append((k, min(x for x in c if c[x] == top), top))
    assert rows(skew.key_modes(w)) == sorted(modes, key=repr)
    want = []
    for k, v in by.items():
        s = sorted(x for x in v if x is not None)
        for f in (0.1, 0.5, 1.0):
            if s:
                want.append((k, f, s[max(1, -(-int(f * 1000) * len(s) // 1000)) - 1]))
    assert rows(skew.key_percentiles(w, [0.1, 0.5, 1.0])) == sorted(want, key=repr)


def test_empty(spark, rows):
    w = skew.compress(spark.createDataFrame([], "k string, v int, n int, item int"), "k", "v")
    assert rows(skew.key_counts(w)) == rows(skew.key_modes(w)) == rows(skew.key_percentiles(w, [0.5])) == []
