import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import canonical as c

COLOURS = [(1, "Navy Blue"), (2, "Teal"), (3, "Olive Green"), (4, "Lemon"), (5, "Ivory"), (6, "Mustard Yellow"), (7, "Charcoal Gray")]


def osa(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc ", min_size=1, max_size=6), min_size=1, max_size=6), st.text("abc ", max_size=6), st.integers(0, 3))
def test_automaton_agrees_with_brute_force(entries, text, most):
    trie = c.Trie([])
    trie.root = c.Node({(i, e, (), "", False) for i, e in enumerate(entries)}, 0)
    assert trie.search(text, most) == {i: osa(e, text) for i, e in enumerate(entries) if osa(e, text) <= most}


def paths(canonical):
    """All aliases of an entry with the edits they leave, written out."""
    parts, out = c.words(canonical), {}
    for some in itertools.product(*[(w, c.skeleton(w)) for w in parts]):
        for path in (" ".join(some), "".join(some)):
            if len(path) >= 3:
                out[path] = 1 if len(path) > 4 else 0
    for order in itertools.permutations(parts):
        out |= {" ".join(order): 9, "".join(order): 9}
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("abe", min_size=1, max_size=3), min_size=1, max_size=4), min_size=1, max_size=3), st.text("abe ", max_size=9), st.integers(0, 3))
def test_trie_has_all_aliases(entries, text, most):
    wanted = {}
    for i, parts in enumerate(entries):
        near = [d for path, room in paths(" ".join(parts)).items() if (d := osa(path, text)) <= min(room, most)]
        if near:
            wanted[i] = min(near)
    assert c.Trie([(i, " ".join(parts)) for i, parts in enumerate(entries)]).search(text, most) == wanted


@pytest.mark.parametrize("n", [4, 5, 6, 12])
def test_many_words_in_any_order(n):
    names = "amber birch cedar dusky ebony flint grove hazel ivory jade khaki lilac".split()[:n]
    trie, rng = c.Trie([(1, " ".join(names)), (2, "amber birch")]), random.Random(n)
    for _ in range(20):
        rng.shuffle(names)
        typed = " ".join(names)
        assert c.resolve(trie, "Color", typed) == c.resolve(trie, "Color", "".join(names)) == 1
        assert c.resolve(trie, "Color", typed[:5] + "x" + typed[5:]) == 1
    assert trie.made < 20_000 * n


def test_full_trie_begins_anew(monkeypatch):
    monkeypatch.setattr(c, "MOST_NODES", 10)
    trie = c.Trie(COLOURS)
    assert [c.resolve(trie, "Color", t) for t in ("navy blu", "teel", "ivory")] == [1, 2, 5]


@pytest.mark.parametrize(("text", "wanted"), [
    ("navy blue", 1), ("NavyBlue", 1), ("Blue, Navy", 1), ("Nàvy  Blue #12", 1), ("color: lemon", 4), ("in lemon", 4), ("Lemon (38)", 4), ("lemon!", 4), ("Lemonish", 4), ("lEMN", 4), ("ivry", 5), ("mstrd yellow", 6), ("Charcal Gray no. 7", 7),
    ("Te4l", 2), ("N/A", -1), ("unknown", -1), ("opt 355", -1), ("swatch 1", -1), ("0", -1), ("?", -1), ("Vuulkrin", -1), ("multi", -1), ("no. 17", -1), ("x", -1), ("", -1), ("😀", -1), ("lemon " * 5000, -1),
])
def test_resolve(text, wanted):
    assert c.resolve(c.Trie(COLOURS), "Color", text) == wanted


def test_equal_distance_is_no_match():
    trie = c.Trie([(1, "Brick"), (2, "Brink")])
    assert c.resolve(trie, "Color", "Bri k") == -1 or c.resolve(trie, "Color", "Brisk") == -1


def test_details(spark, rows):
    schema = "parent_asin string, details map<string,string>, ref_id int, field_name string"
    data = [("a", {"Color": "lemn", "Material": "Suede; Cork"}, 1, "clash"), ("a", {"Color": "lemn", "Material": "Suede; Cork"}, 1, "clash"), ("b", {"Color": "Lemon", "Material": "suede"}, 1, "x"), ("c", {"Color": " ", "Style": None, "Material": "Steel, Stainless"}, 1, "x"), ("d", {"Color": "???", "Style": "goth"}, 1, "x"), (None, {"Color": "lemn"}, 1, "x"), ("e", None, 1, "x")]
    data += [(f"m{i}", {"Material": m}, 0, "") for i, m in enumerate(["Suede", "Cork", "Stainless Steel"] * 4)]
    entries = [(4, "Color", "Lemon"), (9, "Material", "Suede"), (10, "Material", "Cork"), (11, "Material", "Stainless Steel")]
    canonical = spark.createDataFrame(entries, "ref_id int, field_name string, canonical string")
    catalog = spark.createDataFrame(data, schema)
    found = c.map_details(catalog, canonical)
    assert rows(found) == sorted([("a", "Color", 4), ("b", "Material", 9), ("c", "Material", 11), ("d", "Color", -1), ("d", "Style", -1)], key=repr)
    assert rows(c.unmatched(catalog, canonical)) == sorted([("d", "Color"), ("d", "Style")], key=repr)
    assert c.map_details(catalog.limit(0), canonical).count() == 0
    assert {r.ref_id for r in c.map_details(catalog, canonical.limit(0)).collect()} == {-1}


def test_typos_found(spark):
    rng, trie = random.Random(5), c.Trie(COLOURS)
    right = total = 0
    for _ in range(300):
        ref, name = rng.choice(COLOURS)
        i = rng.randrange(1, len(name) - 1)
        text = rng.choice([name[:i] + name[i + 1 :], name[:i] + "x" + name[i:], name[:i] + "x" + name[i + 1 :], name.upper(), name[:i] + name[i + 1] + name[i] + name[i + 2 :]])
        total += 1
        right += c.resolve(trie, "Color", text) == ref
    assert right >= 0.97 * total
