import pytest

from tidemark.operators import multivalue as mv

SCHEMA = "parent_asin string, details map<string,string>, cell string, n int"


@pytest.mark.parametrize(("text", "marks", "quotes", "wanted"), [
    ("a; b ;; c", (";",), (), ["a", "b", "c"]), ('"a, b", c', (",",), ('"',), ["a, b", "c"]), ('"a ""x"" b", c', (",",), ('"',), ['a "x" b', "c"]),
    ("7,5; 8; 8,5", (",", ";"), (), ["7,5", "8", "8,5"]), ("9 1/2/10/10 1/2", ("/",), (), ["9 1/2", "10", "10 1/2"]), ("10/11/12", ("/",), (), ["10", "11", "12"]),
    ("30,32,34", (",",), (), ["30", "32", "34"]), ("N/A", ("/",), (), ["N/A"]), ("Cotton/Acrylic", ("/",), (), ["Cotton", "Acrylic"]), ("a and b", ("and",), (), ["a", "b"]),
    ("bandana", ("and",), (), ["bandana"]), ('12" x 16"; 14" x 18"', (";",), ('"',), ['12" x 16"', '14" x 18"']), ("1,250 and 2,000", ("and", ","), (), ["1,250", "2,000"]), ('"open, b', (",",), ('"',), ['"open', "b"]),
    ("", (",",), (), []), (" ; ", (";",), (), []), ("é、ü", ("、",), (), ["é", "ü"]),
])
def test_split(text, marks, quotes, wanted):
    assert mv.split(text, marks, quotes) == wanted


@pytest.mark.parametrize(("cell", "wanted"), [('["a", "b"]', '"a", "b"'), ("(a)(b)", "(a)(b)"), (" [ [x] ] ", "x"), ("[a", "[a"), ("", "")])
def test_brackets(cell, wanted):
    assert mv.inner(cell) == wanted


def catalog(spark, cells):
    return spark.createDataFrame([(f"P{i}", {"Material": c, "Other": "a, b"}, "clash", i) for i, c in enumerate(cells)], SCHEMA)


def test_cheapest_dialect(spark, rows):
    plain = ["Suede", "Fleece", "Cork", "Stainless Steel", "Denim", "Stainless Steel", "12,5 cm"] * 2
    packed = ["Suede, Fleece", "Cork; Suede / Denim", '"Suede, lined"; Cork', '["Cork","Denim"]', "Suede; Cork", "Fleece | Denim", "Denim & Suede", "Fleece;\tCork; ", "Suede and Stainless Steel"]
    single = ["Steel, Stainless", "N/A", "Suede;", '"Fleece, lined"', "", "  ", None]
    found = rows(mv.split_values(catalog(spark, plain + packed + single), ("Material",)), "parent_asin", "pos", "item_text")
    wanted = [["Suede", "Fleece"], ["Cork", "Suede", "Denim"], ["Suede, lined", "Cork"], ["Cork", "Denim"], ["Suede", "Cork"], ["Fleece", "Denim"], ["Denim", "Suede"], ["Fleece", "Cork"], ["Suede", "Stainless Steel"]]
    assert found == sorted([(f"P{i + len(plain)}", k, v) for i, vs in enumerate(wanted) for k, v in enumerate(vs, 1)], key=repr)


def test_hot_cell_repeats_and_nulls(spark, rows):
    cells = ["Suede; Cork"] * 60 + ["Suede", "Cork", "Denim; Cork"]
    data = catalog(spark, cells).unionByName(catalog(spark, cells[:3])).unionByName(spark.createDataFrame([(None, {"Material": "a; b"}, "x", 1), ("Q", None, "x", 1), ("R", {}, "x", 1)], SCHEMA))
    found = mv.split_values(data, ("Material",))
    assert found.count() == 2 * 61
    assert mv.split_values(data.limit(0)).count() == 0


def test_long_cell(spark):
    cell = "; ".join(["v1", "v2"] * 1500)
    assert mv.split_values(catalog(spark, [cell, "v1", "v2"]), ("Material",)).count() == 3000


@pytest.mark.parametrize("marks", [",;|/&", ",;|/&+", ",;|/&+·", ",;|/&+·•"])
def test_all_mark_sets_are_read(marks):
    cell = "".join(f"v{i}x {m} " for i, m in enumerate(marks)) + "w"
    found = mv.dialects(cell)
    assert {frozenset(d[0]) for d in found} == {frozenset(s) for s in mv.subsets(tuple(marks))}
    assert len({tuple(mv.split(mv.inner(cell), *d)) for d in found}) == len(found) == 2 ** len(marks)


def test_all_quote_sets_are_read():
    cell = '"a, b", \'c, d\', «e, f», “g, h”'
    assert {frozenset(d[1]) for d in mv.dialects(cell) if d[0]} == {frozenset(s) for s in mv.subsets(('"', "'", "«", "“"))}


def test_marks_inside_numbers_part_nothing():
    assert mv.dialects("1,250 cm") == [((), (), False)]


def test_cell_of_six_marks(spark, rows):
    values = ["Alpha/Beta", "Gamma & Co", "Delta|Wool", "Eps, soft", "Zeta + Eta", "Theta"]
    plain = ["Alpha Beta", "Gamma Co", "Delta Wool", "Eps soft", "Zeta Eta", "Theta"] * 4
    found = mv.split_values(catalog(spark, [*plain, "; ".join(values)]), ("Material",))
    assert rows(found.filter("parent_asin = 'P24'"), "pos", "item_text") == list(enumerate(values, 1))
