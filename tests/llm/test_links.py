from collections import Counter
from itertools import combinations
from types import SimpleNamespace

import pandas as pd

from tidemark.llm import product_match as pm


COLUMNS = ["block", "class_id", "model", "words", "idfs", "size", "unit", "part", "crossed"]


def links(*classes, parts=None):
    rows = [(1, i, model, [first, second], [9.0, 9.0], float("nan"), 0, parts[i] if parts else 0, bool(parts)) for i, (first, second, model) in enumerate(classes)]
    rows = pd.DataFrame(rows, columns=COLUMNS)
    return {(r.a, r.b, r.through) for part in pm._links(SimpleNamespace(value={}))([rows.astype({"model": object})]) for r in part.itertuples()}


def test_neighbour_of_a_neighbour():
    assert links(("qwerqwer", "asdfasdf", None), ("asdfasdf", "zxcvzxcv", None), ("zxcvzxcv", "tyuityui", None)) == {(0, 1, "same"), (1, 2, "same")}


def test_near_two_groups():
    assert links(("qwerqwer", "asdfasdf", None), ("zxcvzxcv", "tyuityui", None), ("asdfasdf", "zxcvzxcv", None)) == {(0, 2, "same"), (1, 2, "same")}


def test_model_meets_those_behind_the_first():
    assert links(("qwerqwer", "asdfasdf", None), ("asdfasdf", "zxcvzxcv", None), ("zxcvzxcv", "tyuityui", "x1")) == {(0, 1, "same"), (2, 1, "x1")}


def test_classes_of_one_part_meet_elsewhere():
    assert links(("qwerqwer", "asdfasdf", None), ("qwerqwer", "asdfasdf", None), ("asdfasdf", "zxcvzxcv", None), parts=[0, 0, 1]) == {(0, 2, "same"), (1, 2, "same")}


def test_every_two_classes_meet_in_a_unit(spark):
    data = [(1, i) for i in range(47)] + [(2, 5)] + [(3, 7), (3, 8)]
    units = pm.in_units(spark.createDataFrame(data, "block bigint, class_id bigint"), part=10).collect()
    met = {}
    for r in units:
        met.setdefault((r.block, r.unit), []).append((r.class_id, r.part, r.crossed))
    pairs = Counter((block, min(a, b), max(a, b)) for (block, _), rows in met.items() for (a, p, x), (b, q, _) in combinations(rows, 2) if not x or p != q)
    assert pairs == Counter({(1, a, b): 1 for a, b in combinations(range(47), 2)} | {(3, 7, 8): 1})
    assert max(len(rows) for (block, _), rows in met.items() if block == 1) < 40


def test_cosine_weighs_all_words():
    name = lambda *words: pm.Name(words, [9.0] * len(words), {})
    assert pm.cosine(name("qwerqwer", "asdfasdf"), name("qwerqwer", "asdfasdf")) > 0.999
    assert pm.cosine(name("qwerqwer", "asdfasdf", "zxcvzxcv"), name("zxcvzxcv", "qwerqwer", "tyuityui")) > 0.45
    assert pm.cosine(name("qwerqwer"), name("asdfasdf")) == 0.0 == pm.cosine(name(), name())
    assert 0.3 < pm.cosine(name("qwerqwer"), name("asdfasdf"), "x123") < 0.4
