from cantera.plans import garden
from cantera.sources.records import read_records, register
from cantera.streaming import drops


def test_dropped_files_become_records(spark, tmp_path):
    folder, mark = tmp_path / "drop", tmp_path / "mark"
    folder.mkdir()
    (folder / "a.bc3").write_bytes(garden.TEXT.encode("cp1252"))
    got = []
    for _ in range(2):
        query = drops.each_batch(drops.dropped_records(spark, str(folder)), lambda df, _: got.extend(r["kind"] for r in df.collect()), str(mark))
        query.awaitTermination(120)
        (folder / "b.bc3").write_bytes(b"~C|X|u|late|1||\n")
    assert got.count("P") == 2 and got.count("C") == 10


def test_batch_reader_and_format_agree(spark, tmp_path, rows):
    (tmp_path / "a.bc3").write_bytes(garden.TEXT.encode("cp1252"))
    register(spark)
    columns = ["record_no", "line_no", "kind", "fields"]
    a = read_records(spark, str(tmp_path)).select(columns)
    b = spark.read.format("price_catalog").load(str(tmp_path)).select(columns)
    assert rows(a) == rows(b) and a.count() == 17


def test_arrivals_per_window(spark):
    df = spark.createDataFrame([("a", "2024-01-01 05:00:00"), ("a", "2024-01-01 23:00:00"), ("b", "2024-01-02 00:00:00")], "k string, t string").selectExpr("k", "cast(t as timestamp) as t")
    found = {(str(r["start"])[:10], r["k"]): r["n"] for r in drops.arrivals(df, "t", "k").collect()}
    assert found == {("2024-01-01", "a"): 2, ("2024-01-02", "b"): 1}
