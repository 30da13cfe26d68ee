import pytest

from tidemark.llm import listing_facts as lf
from tidemark.llm import product_match as pm

SCHEMA = "parent_asin string, title string, features array<string>, description array<string>, categories array<string>, store string, price double, group_id int"
NAMES = ["Zejalux Nupesupe", "Rebeduv Raharohu", "Tufekast Yedisiri", "Libiwerd Duradere", "Jusehex Jegituma", "Zutelev Femuwevi", "Mezosast Mumitobi", "Kinukock Rubusaso"]


@pytest.mark.parametrize(("text", "wanted"), [("45.3 inches", ("length", 1150.62)), ('44.1" strap', ("length", 1120.14)), ("0.89 m", ("length", 890.0)), ("57-liter", ("volume", 57000.0)), ("item weight of 913 g", ("weight", 913.0)), ("set of 3 in the box", None), ("586 threads", None), ("", None)])
def test_measure(text, wanted):
    got = lf.measure_of([text])
    assert got == wanted or (got[0] == wanted[0] and abs(got[1] - wanted[1]) < 0.1)


@pytest.mark.parametrize(("text", "wanted"), [("3-pack boots", 3), ("set of 10", 10), ("x2", 2), ("12 pcs", 12), ("4 count in the box", 4), ("plain", 1), ("made in small lots of 44", 1)])
def test_pack(text, wanted):
    assert lf.pack_of([text]) == wanted


@pytest.mark.parametrize(("text", "wanted"), [("zejalux vg/8915 boots", "vg8915"), ("model hp5515", "hp5515"), ("fn-316", "fn316"), ("2026 upgrade", None), ("trousers 79 cm", None), ("size uk 5", None)])
def test_model(text, wanted):
    assert lf.model_of(text) == wanted


def listing(i, title, features=(), categories=("All", "Shoes", "Boots")):
    return (f"B{i:04d}", title, list(features), [], list(categories), f"s{i}", float(i), 0)


def catalog(spark, rows):
    noise = [listing(900 + k, f"{n} Teal {kind} {30 + k} cm", (), ("All", "Shoes", kind)) for k, n in enumerate(NAMES * 5) for kind in ["Boots" if k % 2 else "Sandals"]]
    return spark.createDataFrame(rows + noise, SCHEMA)


def pairs(spark, rows):
    colours = spark.createDataFrame([("Navy Blue",), ("Teal",), ("Jet Black",)], "canonical string")
    return {(r.asin_a, r.asin_b) for r in pm.same_products(catalog(spark, rows), colours).collect() if r.asin_b < "B0900"}


def test_same_and_different(spark):
    rows = [
        listing(1, "NEW! Boots - Wahedafe by Kumonix tx3201 20 cm Navy Blue"), listing(2, "KUMONIX WAHEDAFE TX-3201 BOOTS", ["Colour Navy Blue", "Shaft height: 7.9 in"]), listing(3, "Kumonix Wahedaf Navy Blue Boots 200 mm"), listing(4, "Wahe Dafe Kumonix Boots Navy Blue 0.20 m"),
        listing(5, "Kumonix Wahedafe TX3202 Boots Navy Blue 20 cm"), listing(6, "Kumonix Wahedafe TX3201 Boots Jet Black 20 cm"), listing(7, "Kumonix Wahedafe TX3201 Boots Navy Blue 26 cm"), listing(8, "Kumonix Wahedafe TX3201 Boots Navy Blue 20 cm 3-Pack"),
        listing(9, "Kumonix Wahedafe TX3201 Sandals Navy Blue 20 cm", (), ("All", "Shoes", "Sandals")), listing(10, "Kumonix Yegemola Boots Navy Blue 20 cm"), listing(11, None), listing(12, "  "),
    ]
    rows += [listing(1, "NEW! Boots - Wahedafe by Kumonix tx3201 20 cm Navy Blue")]
    assert pairs(spark, rows) == {("B0001", "B0002"), ("B0001", "B0003"), ("B0002", "B0003"), ("B0001", "B0004"), ("B0002", "B0004"), ("B0003", "B0004")}


def test_hot_group_and_empty(spark):
    rows = [listing(i, f"Kumonix Wahedafe TX3201 Boots Navy Blue 20 cm {'Sale' if i % 2 else ''}") for i in range(1, 31)]
    assert len(pairs(spark, rows)) == 30 * 29 // 2
    colours = spark.createDataFrame([], "canonical string")
    assert pm.same_products(catalog(spark, []).limit(0), colours).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a bigint, b bigint")
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 41), 100, 101, 500]], "node bigint")
    assert {r.label for r in pm.components(links, nodes).filter("node <= 40").collect()} == {1}
    assert {(r.node, r.label) for r in pm.components(links, nodes).filter("node > 40").collect()} == {(100, 100), (101, 100), (500, 500)}
