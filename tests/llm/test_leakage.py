import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import latex, leakage

WORDS = [a + b + c for a in ("ba", "ke", "mo", "ti") for b in ("lo", "re", "su", "na") for c in ("x", "m", "t", "n")]
rng = random.Random(4)
ITEMS = [(i, " ".join(rng.choice(WORDS) for _ in range(50)) + ".") for i in range(6)]
SCHEMA = "doc_id bigint, text string, item_id bigint"


def filler(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def found(spark, docs):
    documents = spark.createDataFrame([(i, t, 7) for i, t in docs], SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    return {(r.item_id, r.doc_id) for r in leakage.find_leaks(documents, items).collect()}


def test_cases(spark):
    w = [t.rstrip(".").split() for _, t in ITEMS]
    replaced = [x if k % 7 else "other" for k, x in enumerate(w[2])]
    docs = [
        (0, filler(100) + " " + ITEMS[0][1] + " " + filler(50)), (1, filler(30) + "\n% " + "\n% ".join(" ".join(w[1][k : k + 5]) for k in range(0, 50, 5)).upper()), (2, " ".join(replaced)),
        (3, " ".join(w[3][:12]) + " " + filler(300) + " " + " ".join(w[3][30:42])), (4, " ".join(w[4][:15])), (5, " ".join(sorted(w[5]))), (6, filler(500)), (7, None), (8, ""), (9, "  "), (10, ITEMS[0][1] + " " + ITEMS[1][1]), (10, ITEMS[0][1]),
        (11, " ".join(w[3][30:42]) + " " + filler(300) + " " + " ".join(w[3][:12])), (12, "\\section{A} " + " ".join(f"\\emph{{{x}}}" if k % 5 else x + " $x^2$ \\cite{a}" for k, x in enumerate(w[0]))),
    ]
    assert found(spark, docs) == {(0, 0), (1, 1), (2, 2), (3, 3), (0, 10), (1, 10), (0, 12)}


def test_removal_and_counts(spark, rows):
    documents = spark.createDataFrame([(1, ITEMS[0][1], 1), (2, "clean", 2), (None, "x", 3)], SCHEMA)
    items = spark.createDataFrame(ITEMS[:2], "item_id bigint, text string")
    assert rows(leakage.without_leaks(documents, items), "doc_id") == [(2,), (None,)]
    assert rows(leakage.leaked_items(documents, items)) == [(0, 1), (1, 0)]
    assert leakage.find_leaks(documents.limit(0), items).count() == leakage.find_leaks(documents, items.limit(0)).count() == 0


def test_latex_words():
    text = r"\newcommand{\Foo}{\textit{Welle}} Die \Foo{} sch\"atzt Stra{\ss}e, caf\'e na\"{\i}ve $\alpha+1$ \cite{x}, \emph{wort} m\o de"
    assert latex.words(text)[-7:] == "schatzt strasse cafe naive wort mode".split()[-7:] or latex.words(text)[-6:] == "schatzt strasse cafe naive wort mode".split()
    assert "welle" in latex.words(text)


def test_pieces_follow_order():
    assert leakage.held(leakage.pieces([(k, k) for k in range(10)])) == 12
    assert leakage.held([(0, 9, 100, 109), (20, 29, 0, 9)]) == 10
    assert leakage.held([(0, 9, 0, 9), (20, 29, 100, 109)]) == 20
    assert leakage.held([]) == 0


def test_long_document(spark):
    assert found(spark, [(1, filler(300_000) + " " + ITEMS[3][1])]) == {(3, 1)}


@pytest.mark.parametrize("size", [1800, 2400, 60_000])
def test_formulas_of_any_length_are_no_words(size):
    formula = ("x_{12} + " * size)[:size]
    for a, b in ("$$", "$$"), ("$", "$"), ("\\(", "\\)"):
        assert latex.words(f"one {a}{formula}{b} two") == ["one", "two"]


def test_open_formulas_end_at_an_empty_line():
    assert latex.words("costs $5 today\n\nand $x$ later") == ["costs", "5", "today", "and", "later"]
    assert latex.words("from \\$5 to \\$7 a piece") == ["from", "5", "to", "7", "a", "piece"]
    assert latex.words("a line \\\\(b) $unclosed") == ["a", "line", "b", "unclosed"]


def test_codes_are_exact_beyond_64_bits_of_words():
    # base ** 3 of this vocabulary passes 2 ** 63
    many = 2_100_000
    index = leakage.Items([(1, " ".join(f"w{i}" for i in range(many)))])
    rng = np.random.default_rng(3)
    ids = rng.integers(1, many + 1, 300_000)
    ids[1000:1500] = np.arange(many - 500, many) + 1
    codes = index.codes(ids)
    hit = np.flatnonzero(np.isin(codes, index.known) & (codes > 0))
    wanted = [k for k in range(len(ids) - 2) if ids[k + 1] == ids[k] + 1 and ids[k + 2] == ids[k] + 2]
    assert hit.tolist() == wanted


def test_bound_is_checked_before_items_are_gathered(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MAX_ITEM_CHARS", 10)
    items = spark.createDataFrame([(1, "far too many words")], "item_id bigint, text string")
    with pytest.raises(ValueError, match="characters of items"):
        leakage.find_leaks(items.select(F.col("item_id").alias("doc_id"), "text"), items)
