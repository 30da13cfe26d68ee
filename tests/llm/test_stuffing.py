import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import stuffing as s

SENTENCE = "Any {} over the {} reproduces some {} of each {} because this {} bends that {}. "
NOUNS = [a + b for a in ("wol", "ked", "zaj", "fob", "vup", "tir", "gan", "mel", "pos", "rud") for b in ("osax", "ukox", "ujo", "oal", "eth", "ina", "erm", "ulo")]
rng = random.Random(8)


def article(n):
    return "\\begin{document}\n" + "".join(SENTENCE.format(*(rng.choice(NOUNS) for _ in range(6))) for _ in range(n))


def covered_by_hand(tokens, sizes, least):
    hit = set()
    for i in range(len(tokens)):
        for n in range(least, len(tokens) - i + 1):
            part = tokens[i : i + n]
            if sum(tokens[k : k + n] == part for k in range(len(tokens) - n + 1)) < 2:
                break
            hit |= set(range(i, i + n))
    return sum(sizes[i] for i in hit)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=18), st.integers(1, 3))
def test_automaton_agrees_with_brute_force(tokens, least):
    sizes = [t + 1 for t in tokens]
    assert s.repeated(tokens, sizes, least) == covered_by_hand(tokens, sizes, least)


def stuffed(text):
    return s.is_stuffed(*s.measure(text))


def test_pages():
    goods = ["daypack", "winter hat", "jaratron", "zamial"]
    words = ", ".join(rng.choice(["cheap ", "best ", "buy online ", ""]) + rng.choice(goods) for _ in range(150))
    links = "\n".join(f"\\item \\href{{https://h{i}.invalid/p{i * 7}}}{{{rng.choice(goods)}}}" for i in range(40))
    tags = " ".join("#" + rng.choice(["buy", "sale"]) + rng.choice(goods).replace(" ", "") for _ in range(60))
    talk = " ".join(f"Your {g} your cheap {g}. The sale {g} for the {g}." for g in (rng.choice(goods) for _ in range(60)))
    for text in (words, f"\\keywords{{{words}}}", "% " + words.replace(", ", "\n% "), links, tags, talk, "\\documentclass{a}\n\\begin{document}\n\\maketitle\n" + words + "\\end{document}"):
        assert stuffed(text), text[:60]
    apparatus = "".join(f"\\bibitem{{k{i}}} A. Name, {SENTENCE.format(*(rng.choice(NOUNS) for _ in range(6)))} \\emph{{Acta}} {i} (19{i % 90 + 10}). \\url{{https://a{i}.test/{i}}}\n" for i in range(30))
    for text in (None, "", " \n", "A short note.", article(1), article(40), article(4) + apparatus, "\\input{a}\n\\input{b}", "Keywords: one, two, three", "a" * 200_000):
        assert not (text and stuffed(text)), (text or "")[:60]


def test_table(spark, rows):
    page = "cheap hat, " * 80
    docs = spark.createDataFrame([(1, page, True), (2, article(20), True), (3, None, True), (4, "", True), (1, page, True), (None, page, True)], "doc_id bigint, text string, stuffed boolean")
    assert rows(s.stuffed_pages(docs)) == [(1,)]
    assert s.measure_pages(docs).count() == 6 and s.stuffed_pages(docs.limit(0)).count() == 0


def test_long_formulas_are_no_tokens():
    prose = "We show that the map is open and that it has a bounded kernel for each of the cases in this text. "
    short = s.measure(prose * 3)
    for a, b in ("\\begin{align*}", "\\end{align*}"), ("\\[", "\\]"), ("$$", "$$"), ("\\begin{equation}", "\\end{equation}"):
        assert s.measure(prose + a + "x_{12} + \\alpha y = " * 2000 + b + prose * 2) == short
    # one that is never closed is text
    assert s.measure(prose + "\\begin{align} " + prose * 2)[0] == short[0]
