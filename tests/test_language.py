import numpy as np
import pytest

from cantera.functions.text import LETTERS
from cantera.lang import vectors
from cantera.lang.syntax import SyntaxFault, logical_lines, parse
from cantera.plans import garden, items, pricing
from cantera.sources.records import Catalog, decoded, records


def run(program, *chosen):
    return vectors.evaluated(program, np.array(chosen or [[]], np.int64).reshape(max(1, len(chosen)), -1)).to_pylist()


def value(expression):
    return run(parse(f"$Q={expression}\n\\R\\$Q\\"))[0]


@pytest.mark.parametrize(
    ("expression", "text"),
    [("-2^2", "-4"), ("2^3^2", "64"), ("!0+1", "2"), ("2^-1", "0.5"), ('"6,5 kV"*1', "6,5 kV"), ('ATOF("6,5 kV")+0', "6.5"), ('ATOF("1-5")', "1"), ('ATOF("x")', "0"), ("FTOA(2.0)", "2"), ("0.16", "0.16"), ("ROUND(2.345,2)", "2.35"), ("INT(-2.7)", "-2"), ("c+0", "3"), ('"3"*"2"', "6"), ('"a"="b"', "0"), ("10-2-3", "5"), ("1=1&0@1", "1"), ("ATAN2(1,1)", "45"), ("ABS(0-1,2)", "1"), ("SQRT(4,1)", "2"), ("ROUND(1.25,1,9)", "1.3"), ("ROUND(2.5)", "3"), ('"b">"a"', "1"), ('!""', "1")],
)
def test_expressions(expression, text):
    assert value(expression)["resumen"] == text


@pytest.mark.parametrize(
    ("expression", "message"),
    [("1/0", "division by zero"), ("SQRT(0-1)", "square root of negative number"), ("0^(0-1)", "zero to a negative power"), ("ASIN(2)", "outside the domain of ASIN"), ("ABS()", "ABS has too few arguments"), ("ATAN2(1)", "ATAN2 has too few arguments"), ("10^400", "number out of range")],
)
def test_errors_of_one_selection(expression, message):
    found = value(expression)
    assert not found["valid"] and found["error"] == f"evaluation error: {message}" and found["lines"] == []


def test_assembly_of_lines():
    body = '%A=1, # note\n2\n$B="a # b\nc"\nMT01 : 1 +\n 2\n%C=1,\nMT02 : 3\n\\ R \\text # dropped\nmore # kept\nend\\ # dropped\n'
    assert logical_lines(body) == [("%A=1, 2", 1, False), ('$B="a # b\nc"', 3, False), ("MT01 : 1 + 2", 5, False), ("%C=1,", 7, False), ("MT02 : 3", 8, False), ("\\ R \\text\nmore # kept\nend\\", 9, True)]


def test_index_merge_and_messages():
    p = parse("\\X\\p\\q\\\n%M(2,3)=1,2,3,4,5,6\nA : %M(2,1)\nB : 1\nA : %Z+1\nC : 1-1\nD%A : 1\n%%O : 2\n%E=%A=b\n")
    first, second = run(p, [1], [2])
    assert [(x["code"], x["qty"]) for x in first["lines"]] == [("A", 5.0), ("B", 1.0), ("Da", 1.0), ("%O", 2.0)]
    assert first["warnings"] == ["undefined variable %Z"] and first["valid"]
    assert second["error"] == vectors.EXCLUDED and second["lines"]
    good, bad = run(parse("\\X\\p\\q\\\n%M(1)=1\nA : %M(%A)"), [1], [2])
    assert bad["error"] == "evaluation error: index 2 out of range 1..1 in dimension 1"


@pytest.mark.parametrize("body", ["%M(2,2)=1,2,3", "%A=", "A : 1 +* 2", "what is this", "".join(f"\\P{i}\\a\\\n" for i in range(11))])
def test_faults_of_a_body(body):
    with pytest.raises(SyntaxFault):
        parse(body)


def test_stray_expression_is_a_warning():
    assert parse("1+1").warnings == ["line 1: ignored stray expression '1+1'"]


def test_ordinals_run_with_the_last_parameter_fastest():
    assert vectors.selections(np.arange(6), [2, 3]).tolist() == [[a, b] for a in (1, 2) for b in (1, 2, 3)]
    assert vectors.selections(np.arange(1), []).tolist() == [[]] and len(LETTERS) == 62


def test_decoding_and_records():
    assert decoded("﻿ñ\r\nx\ry".encode()) == "ñ\nx\ny"
    assert decoded(b"\xf1 \x92\x81") == "ñ ’\x81"
    text = "noise\n~C|A\\B|u||\nmore||\n~P| F$ |body|x|"
    assert list(records(text)) == [(2, "C", ["A\\B", "u", "", "\nmore", ""]), (4, "P", ["F$", "body|x"])]


def test_garden_items_and_both_backends(spark):
    c = Catalog.from_text(spark, garden.TEXT)
    found = {r["code"]: r for r in items.items(c, include_invalid=True).collect()}
    want = {"GPA100aa": (11.54, 12.23, "Path 1 m (D)"), "GPA100ab": (14.94, 15.84, "Path 1 m (N)"), "GPA100ba": (16.69, 17.69, "Path 2 m (D)")}
    for code, (direct, price, text) in want.items():
        r = found[code]
        assert (r["direct_cost"], r["price"], r["resumen"], r["chapter_path"]) == (direct, price, text, ["G#", "GPA#"])
    assert found["GPA100bb"]["error"] == "No night work at width 2" and found["GPA100bb"]["price"] is None
    assert found["GPA200ba"]["decomposition"] == [] and found["GPA200ba"]["price"] == 38.75
    assert found["GPA100aa"]["texto"] == "Gravel path of width 1 m.\nShift: Day"
    for code, body in c.families_raw.collect():
        a = items.compiled_evaluations(spark.createDataFrame([(code,)], "family string"), parse(body)).orderBy("ordinal").drop("family").collect()
        b = items.evaluations(items.parsed_families(c.families_raw.filter(f"code = '{code}'"))).orderBy("ordinal").drop("family").collect()
        for x, y in zip(a, b, strict=True):
            x, y = x.asDict(True), y.asDict(True)
            for r in (x, y):
                r["lines"] = [(q["ord"], q["code"], round(q["qty"], 9)) for q in r["lines"]]
            assert x == y


def test_selection_and_resolution(spark):
    c = Catalog.from_text(spark, garden.TEXT)
    assert items.resolve(c, "GPA100ab").first()["price"] == 15.84
    assert items.resolve(c, "GPA100", [1, 2]).first()["code"] == "GPA100ab"
    for bad in (lambda: items.resolve(c, "ZZZ"), lambda: items.resolve(c, "GPA100", [3, 1]), lambda: items.select_families(c, names=["NO"]), lambda: items.select_families(c, chapter="NO#"), lambda: Catalog.from_text(spark, "nothing")):
        with pytest.raises(ValueError):
            bad()
    assert {r[0] for r in items.select_families(c, chapter="G#").collect()} == {"GPA100$", "GPA200$"}


def test_composite_prices_cycles_and_warnings(spark):
    concepts = spark.createDataFrame([("A", "u", "", 80.00, ""), ("B", "u", "", 2.0, ""), ("N", "u", "", None, ""), ("X", "u", "", None, ""), ("Y", "u", "", None, "")], "code_key string, unit string, summary string, price double, type string")
    links = [("A", 0, "B", 3.0, 1.0), ("A", 1, "gone", 1.0, 1.0), ("A", 2, "N", 1.0, 1.0), ("A", 3, "%S", 0.5, 1.0), ("A", 4, "X", 0.0, 1.0), ("X", 0, "Y", 1.0, 1.0), ("Y", 0, "X", 1.0, 1.0), ("Z", 0, "A", 2.0, 1.0)]
    df = spark.createDataFrame(links, "parent_key string, ord int, child string, factor double, yield double")
    found = {r["code_key"]: r for r in pricing.priced_concepts(concepts, df).collect()}
    assert float(found["A"]["price"]) == 9.0 and float(found["Z"]["price"]) == 18.0
    assert "unknown concept gone" in found["A"]["warnings"] and "N has no price" in found["A"]["warnings"] and any("differs" in w for w in found["A"]["warnings"])
    assert found["X"]["error"] == "decomposition cycle at X" and found["Y"]["price"] is None
