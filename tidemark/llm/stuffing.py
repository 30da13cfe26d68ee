"""Pages of repeated keywords, links or tags: coverage by repeated substrings of the page's suffix automaton, and
missing clause structure."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

from tidemark.llm import latex

# The body begins behind the last of these; definitions and class lines before it are preamble.
_BEGIN = re.compile(r"\\maketitle|\\begin\{document\}")
_PREAMBLE = re.compile(r"^[ \t]*(?:%+[ \t]*draft[^\n]*|\\(?:document(?:class|style)|usepackage|title|author|date|(?:re)?newcommand|providecommand|def)\b[^\n]*)$", re.M)
# References, which are neither words nor clauses.
_REFERENCE = re.compile(r"\\(?:cite\w*|ref|eqref|label|pageref|input|include|begin|end|bibitem|section|subsection)\*?(?:\[[^\]]*\])?\{[^{}]*\}")
_TOKEN = re.compile(r"(?P<url>(?:https?://|www\.)[^\s{}\\,]+)|(?P<tag>[#@]\w[\w-]*)|(?P<word>[^\W\d_]+(?:['’-][^\W\d_]+)*)|(?P<number>\d+)|(?P<end>[.!?;:](?=\s|\\|\}|$|[\"')])|\n[ \t%]*\n)|(?P<mark>[,/|&•·*=>\n]|\\\\|\\item\b)")

#: Words that hold clauses together in the corpus' languages: articles, determiners, prepositions, conjunctions and
#: auxiliary verbs. Fixed values.
FUNCTION_WORDS = frozenset(
    """
    a an the this that these those each every some any one our no all its their his her and or but so because since
    while whereas unless until if when where once though although as than of in on at by for from with without over
    under above below between within inside into through across along against around near behind beyond before after
    during despite toward towards is are was were be been has have had do does can could may might must will would
    not which who whose we it they he she there here such also both either
    le la les un une des du de cette ce cet ces chaque toute tout tous toutes notre nos et ou mais donc car parce que
    quand lorsque puisque si où dont sans avec sur sous dans par pour entre vers contre après avant depuis pendant
    derrière devant malgré selon près est sont était a ont au aux en ne pas plus bien
    der die das den dem des ein eine einer eines einem einen jede jeder jedes jeden jedem diese dieser dieses diesen
    unsere unser unserer keine kein keiner und oder aber denn weil während obwohl wenn wo dass daß als ohne mit für
    durch gegen um über unter auf an bei von vom zu zum zur nach vor hinter neben zwischen aus ist sind war hat haben
    wird werden nicht sich auch
    el los las una uno unos unas del al cada toda todo todos todas nuestra nuestro esta este estas estos y o u e pero
    pues porque aunque cuando donde mientras que si sin con sobre bajo por para entre hacia contra tras desde hasta
    según durante ante es son fue ha han no se ni más
    """.split()
)

#: Shortest repeat that counts, in tokens; fewest tokens of a page to be judged; least coverage by repeats; least sum
#: of the two measures.
LEAST_REPEAT, LEAST_TOKENS, LEAST_COVERED, LEAST_SCORE = 2, 20, 0.25, 0.85


def body(text: str) -> str:
    """What follows the preamble."""
    last = None
    for last in _BEGIN.finditer(text):  # noqa: B007
        pass
    return _PREAMBLE.sub("", text[last.end() :] if last else text)


def repeated(tokens: list[int], sizes: list[int], least: int = LEAST_REPEAT) -> int:
    """Characters (``sizes`` of the tokens) covered by substrings of at least ``least`` tokens that occur twice or more.

    The suffix automaton of the page is built online. The longest suffix of a prefix that occurs elsewhere is the
    prefix's own state if another state links to it, else the state that it links to; these are the repeated
    substrings that can't be extended to the left, and their union is what any repeat covers.
    """
    step: list[dict] = [{}]
    link, length, prefixes = [-1], [0], []
    last = 0
    for t in tokens:
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and t not in step[p]:
            step[p][t] = now
            p = link[p]
        if p >= 0:
            q = step[p][t]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(step)
                step.append(step[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(t) == q:
                    step[p][t] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
        prefixes.append(now)
    linked = set(link)
    covered, left = 0, len(tokens)
    for i in range(len(tokens) - 1, -1, -1):
        state = prefixes[i]
        n = length[state] if state in linked else length[link[state]]
        if n >= least:
            left = min(left, i - n + 1)
        if i >= left:
            covered += sizes[i]
    return covered


def measure(text: str) -> tuple[int, float, float]:
    """(tokens, covered, clauses) of a page's body: number of tokens (words, links, tags, numbers), share of their
    characters in repeats, share of the words' characters in clauses. All links count as one token, so do all tags
    and all numbers. A clause is a run of at least five words up to a mark that ends a sentence, a fifth of them
    function words, without a separator (comma, slash, bar, line end, link and the like) at every third word."""
    text = body(text)
    if "\\" in text:
        text = latex.letters(_REFERENCE.sub(" ", latex.without_formulas(latex.expand(text), displayed=True)))
    known: dict[str, int] = {}
    tokens, sizes = [], []
    word_chars = clause_chars = words = functions = chars = marks = 0
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "word":
            if text[m.start() - 1 : m.start()] == "\\":
                continue  # a command
            w = m[0].lower()
            tokens.append(known.setdefault(w, len(known)))
            sizes.append(len(w))
            words += 1
            chars += len(w)
            functions += w in FUNCTION_WORDS
        elif kind == "mark":
            marks += 1
        elif kind == "end":
            if words >= 5 and functions >= 0.2 * words and marks <= 0.35 * words:
                clause_chars += chars
            word_chars += chars
            words = functions = chars = marks = 0
        else:
            tokens.append(known.setdefault(kind, len(known)))
            sizes.append(m.end() - m.start())
            marks += kind != "number"
    if words >= 5 and functions >= 0.2 * words and marks <= 0.35 * words:
        clause_chars += chars
    word_chars += chars
    total = sum(sizes)
    return len(tokens), repeated(tokens, sizes) / total if total else 0.0, clause_chars / word_chars if word_chars else 0.0


def is_stuffed(tokens: int, covered: float, clauses: float) -> bool:
    """Whether repeats and words outside clauses together make up the page. A page of a few tokens is merely short,
    one without repeats merely bare."""
    return tokens >= LEAST_TOKENS and covered >= LEAST_COVERED and covered + (1 - clauses) >= LEAST_SCORE


def measure_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, tokens, covered, clauses, stuffed) of each row of ``documents`` (doc_id, text).

    Null, empty and blank texts have no token and aren't stuffed; repeated rows are measured each; other columns are
    ignored; an empty table gives none. Whole texts are read; time and memory are linear in the longest text. No
    shuffle.
    """

    def run(batches):
        for batch in batches:
            rows = [measure(text) if text else (0, 0.0, 0.0) for text in batch["text"].tolist()]
            out = pd.DataFrame(rows, columns=["tokens", "covered", "clauses"], index=batch.index)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), **out, "stuffed": [is_stuffed(*r) for r in rows]})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, tokens bigint, covered double, clauses double, stuffed boolean")


def stuffed_pages(documents: DataFrame) -> DataFrame:
    """(doc_id) of the pages made of repeated keywords, links or tags; one row for each doc_id."""
    return measure_pages(documents).filter("stuffed AND doc_id IS NOT NULL").select("doc_id").distinct()
