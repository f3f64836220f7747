import random

from cantera.operators import hierarchy
from cantera.plans import training


def brute(links):
    parent = {}
    for _, p, c in links:
        if p is None or c is None:
            continue
        p, c = (x.strip().rstrip("#").strip() for x in (p, c))
        if p and c:
            parent.setdefault(c, p)
    out = {}
    for node in set(parent) | set(parent.values()):
        path, at = [node], node
        while at in parent and parent[at] not in path:
            at = parent[at]
            path.append(at)
        if at not in parent:
            out[node] = (at, len(path) - 1, "/".join(reversed(path)))
        else:
            out[node] = ("", -1 if parent[at] == node else -2, "")
    return sorted((k, *v) for k, v in out.items())


def frame(spark, links):
    return spark.createDataFrame(links, "line_no bigint, parent string, child string")


def test_forest_with_cycles_matches_brute_force(spark, rows):
    rnd = random.Random(4)
    links = [(i, f"n{rnd.randrange(max(1, i - 3), i + 1) if i else 0}#", f"n{i + 1}") for i in range(120)]
    links += [(200, "x1#", " x2# "), (201, "x2#", "x3"), (202, "x3#", "x1"), (203, "x3#", "x4"), (204, "x4#", "x5"), (205, "s#", "s#"), (206, "x1#", "x2")]
    links += [(300 + k, "hub#", f"leaf{k}") for k in range(150)]
    links += [(500, None, "a"), (501, "a#", None), (502, " ", "b"), (503, "n5#", "hub")]
    assert rows(hierarchy.node_paths(frame(spark, links))) == sorted(brute(links), key=repr)


def test_long_chain_and_descendants(spark, rows):
    links = [(i, f"c{i}#", f"c{i + 1}") for i in range(70)] + [(100, "c3#", "d1"), (101, "d1#", "d2")]
    df = frame(spark, links)
    found = rows(hierarchy.descendants(df))
    want = []
    for node, _, depth, path in brute(links):
        up = path.split("/")[:-1]
        want += [(a, node, depth - k) for k, a in enumerate(up)]
    assert found == sorted(want, key=repr)


def test_empty_table_and_extra_columns(spark, rows):
    empty = spark.createDataFrame([], "line_no bigint, parent string, child string, node string, keys string")
    assert rows(hierarchy.node_paths(empty)) == []
    assert rows(hierarchy.descendants(empty)) == []
    clash = spark.createDataFrame([(1, "a#", "b", "z", "z")], "line_no bigint, parent string, child string, node string, keys string")
    assert rows(hierarchy.node_paths(clash)) == [("a", "a", 0, "a"), ("b", "a", 1, "a/b")]


def test_first_parent_wins(spark, rows):
    df = frame(spark, [(2, "q#", "x"), (1, "p#", "x")])
    assert ("x", "p", 1, "p/x") in rows(hierarchy.node_paths(df))


def test_items_hang_by_parent_and_by_path(spark, rows, tmp_path):
    links = [("A#", "B#"), ("B#", "C#"), ("C#", "F1$"), ("X#", "Y#"), ("Y#", "X#"), ("B", "never")]
    spark.createDataFrame([(k, *x) for k, x in enumerate(links)], "line_no bigint, parent string, child string").write.parquet(str(tmp_path / "decompositions.parquet"))
    items = [(1, "F1$", None), (2, " F1$ ", []), (3, "C#", ["A#", "B#", "C#"]), (4, None, ["A#", None, " ", "A"]), (5, "other", ["Z#"]), (6, "Y", ["A#"]), (7, None, None)]
    spark.createDataFrame(items, "item_id bigint, parent_key string, chapter_path array<string>").write.parquet(str(tmp_path / "items.parquet"))
    assert rows(training.p2_hanging(spark, str(tmp_path))) == [("A", 5), ("B", 3), ("C", 3), ("F1$", 2), ("Y", 1), ("Z", 1)]
    assert rows(training.p2_item_places(spark, str(tmp_path))) == [(1, "F1$", "A", 3, "A/B/C/F1$"), (2, "F1$", "A", 3, "A/B/C/F1$"), (3, "C", "A", 2, "A/B/C"), (6, "Y", "", -1, "")]
