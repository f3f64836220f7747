import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings items concepts decompositions oeb_texto raw_items families base_concepts eval_passages".split()
SLOW: set[str] = set()


def canon(v):
    if isinstance(v, float):
        return f"{v:.8g}"
    return str(v) if v is not None else None


CORE = [n for m in entry._modules() if not m.__name__.startswith("cantera.llm") for n in m.SQL if n not in SLOW]


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, small, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(canon(r[k]) for k in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(canon(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_entry(spark, small):
    assert entry.entry(spark).columns == ["node_key", "root_key", "depth", "node_path"]
