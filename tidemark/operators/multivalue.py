"""Splitting of fields that hold several values, by the dialect (delimiters and quote) of least description length."""

from __future__ import annotations

import re
from hashlib import blake2b
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.engine import cut, lookup_skewed, spread, trimmed

#: Delimiters a dialect may use; `and` stands for the word between white space. Fixed values.
DELIMITERS = (",", ";", "|", "/", "\n", "&", "+", "·", "•", "\t", "、", "；", "，", "and")
#: Opening and closing quotes.
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»"}
BRACKETS = {"[": "]", "(": ")", "{": "}"}
#: Texts that say that there is no value; a mark in them separates nothing. Fixed values.
PLACEHOLDERS = ("n/a", "n.a.", "n / a", "none", "null", "unknown", "tbd", "not applicable", "not/applicable", "w/o", "-", "--", "?")

#: Bits a character of a spelled value, bits that announce a value the code book lacks, bits a delimiter or quote of
#: the dialect, bits a delimiter or quote that a value still holds (codes are those of a value's words), bits a quote
#: at a value's end whose partner lies in another value.
CHAR_BITS, NEW_BITS, MARK_BITS, LEFT_BITS, TORN_BITS = 4.7, 16.0, 1.0, 6.0, 120.0

# A number: thousands in groups of three, a decimal comma or point, a fraction or a mixed fraction.
_NUMBER = re.compile(r"(?<![\d.,/])(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+,\d+|\d+\.\d+)(?![\d]|[.,/]\d)|(?<![\d/])\d+ \d+/\d+(?!\d)|(?<![\d/])\d+/\d+(?![\d/])")
# Two whole numbers with a comma between could also be two values: here the comma counts as one of a number only where one digit follows.
_TIGHT = re.compile(r"\d+,\d{2}")
_DIGIT = re.compile(r"\d")
_PLACEHOLDER = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(p) for p in PLACEHOLDERS if "/" in p) + r")(?!\w)", re.I)
_LEFT = re.compile("[" + re.escape("".join([m for m in DELIMITERS if len(m) == 1] + [*QUOTES, *QUOTES.values()])) + "]")
_TORN = re.compile(r"^([\"'“‘«])(?!.*[\"'”’»]$)|^(?![\"'“‘«]).*(?<![\dsS])[\"'”’»]$", re.S)
_SPLITTERS: dict = {}


def _splitter(marks: tuple) -> re.Pattern:
    if marks not in _SPLITTERS:
        _SPLITTERS[marks] = re.compile("|".join(r"(?<=\s)and(?=\s)" if m == "and" else re.escape(m) for m in marks), re.I)
    return _SPLITTERS[marks]


def inner(cell: str) -> str:
    """The cell without white space at its ends and without brackets around the whole of it."""
    cell = cell.strip()
    while len(cell) > 1 and BRACKETS.get(cell[0]) == cell[-1]:
        depth, end = 0, -1
        for i, c in enumerate(cell):
            depth += (c == cell[0]) - (c == cell[-1])
            if not depth:
                end = i
                break
        if end != len(cell) - 1:
            break
        cell = cell[1:-1].strip()
    return cell


def _cuts(text: str, marks: tuple, tight: bool) -> list[tuple[int, int, str]]:
    """Where the marks lie outside numbers and placeholders, with the mark."""
    found = [(*m.span(), m[0].lower()) for m in _splitter(marks).finditer(text)] if marks else []
    if not found:
        return []
    kept = [m.span() for m in _NUMBER.finditer(text) if not (tight and _TIGHT.fullmatch(m[0]))] if _DIGIT.search(text) else []
    kept += [m.span() for m in _PLACEHOLDER.finditer(text)] if "/" in text else []
    return [c for c in found if not any(a <= c[0] < b for a, b in kept)] if len(kept) < 9 else _outside(found, kept)


def _outside(found: list, kept: list) -> list:
    inside = {i for a, b in kept for i in range(a, b)}
    return [c for c in found if c[0] not in inside]


def split(text: str, marks: tuple, quotes: tuple, tight: bool = False) -> list[str]:
    """The values of ``text`` in one dialect: pieces between ``marks`` that lie outside quotes, numbers and placeholders.

    A quote opens only at the start of a piece and closes only at its end; one that doesn't close is plain text.
    ``tight`` reads a comma between a number and two or more digits as a mark. Empty pieces are left out.
    """
    return _pieces(text, _cuts(text, marks, tight), marks, quotes)


def _pieces(text: str, cuts: list[tuple[int, int, str]], marks: tuple, quotes: tuple) -> list[str]:
    pieces, at, k = [], 0, 0
    while at <= len(text):
        start = at
        while start < len(text) and text[start].isspace() and text[start] not in marks:
            start += 1
        if start < len(text) and text[start] in quotes:
            close, i, body = QUOTES[text[start]], start + 1, []
            while i < len(text):
                if text[i] == close:
                    if text[i + 1 : i + 2] == close:
                        i += 1
                    else:
                        break
                body.append(text[i])
                i += 1
            after = i + 1
            while after < len(text) and text[after].isspace() and text[after] not in marks:
                after += 1
            while k < len(cuts) and cuts[k][0] < after:
                k += 1
            if i < len(text) and (after >= len(text) or k < len(cuts) and cuts[k][0] == after):
                pieces.append("".join(body).strip())
                if after >= len(text):
                    break
                at = cuts[k][1]
                continue
            k = 0
        while k < len(cuts) and cuts[k][0] < at:
            k += 1
        if k == len(cuts):
            pieces.append(text[at:].strip())
            break
        pieces.append(text[at : cuts[k][0]].strip())
        at = cuts[k][1]
    return [p for p in pieces if p]


def subsets(items: tuple) -> list[tuple]:
    """All subsets, the largest first."""
    return [some for n in range(len(items), -1, -1) for some in combinations(items, n)]


def readings(cell: str):
    """Each dialect (marks, quotes, tight) that reads the cell differently, with its values; the finest first.

    Every set of the marks and quotes that the cell has is tried, however many: 2 to the power of the number of their
    kinds, of which there are fourteen and five. Marks that only lie inside numbers or placeholders part nothing and
    aren't tried."""
    text = inner(cell)
    if text.lower() in PLACEHOLDERS:
        yield ((), (), False), split(text, (), ())
        return
    there = tuple(m for m in DELIMITERS if m in text or m == "and" and "and" in text.lower())
    tight_too = "," in there and bool(_TIGHT.search(text))
    cuts = {tight: _cuts(text, there, tight) for tight in ((False, True) if tight_too else (False,))}
    marks = tuple(m for m in there if any(c[2] == m for c in cuts[tight_too]))
    quotes = tuple(q for q in QUOTES if q in text)
    seen = set()
    for some in subsets(marks):
        for with_quotes in subsets(quotes):
            for tight in (False, True) if "," in some and tight_too else (False,):
                own = cuts[tight] if len(some) == len(marks) else [c for c in cuts[tight] if c[2] in some]
                read = _pieces(text, own, some, with_quotes)
                # a reading is known by its digest: readings of a long cell would fill the memory
                digest = blake2b("\x00".join(read).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if digest not in seen:
                    seen.add(digest)
                    yield (some, with_quotes, tight), read


def dialects(cell: str) -> list[tuple]:
    """The dialects of readings()."""
    return [dialect for dialect, _ in readings(cell)]


def code_key(value: str) -> str:
    """What values share a code: their words without case and order, shares of a whole being one word."""
    return " ".join(sorted(re.findall(r"[^\W_]+|#%", re.sub(r"\d+(?:[.,]\d+)?\s*%", "#%", value.lower())))) or value.lower()


def _spell(dialect: tuple) -> str:
    return "\x00".join(["\x01".join(dialect[0]), "".join(dialect[1]), "t" if dialect[2] else ""])


def _unspell(name: str) -> tuple:
    marks, quotes, tight = name.split("\x00")
    return tuple(m for m in marks.split("\x01") if m), tuple(quotes), bool(tight)


PARSE_COLUMNS = ["field_name", "cell", "rank", "dialect", "mark_bits", "keys", "lengths", "own"]


def _parses(batches):
    for batch in batches:
        rows, held = [], 0
        for field, cell in zip(batch["field_name"], batch["cell"], strict=True):
            own = set()
            for rank, (dialect, values) in enumerate(readings(cell)):
                if held > 1_000_000:  # characters: a cell of many marks has many readings
                    yield pd.DataFrame(rows, columns=PARSE_COLUMNS)
                    rows, held = [], 0
                held += len(cell)
                keys = [code_key(v) for v in values]
                own = own or set(keys)
                left = sum(len(_LEFT.findall(_NUMBER.sub("", v))) for v in values)
                bits = MARK_BITS * (len(dialect[0]) + len(dialect[1])) + LEFT_BITS * left + TORN_BITS * sum(bool(_TORN.search(v)) for v in values)
                rows.append((field, cell, rank, _spell(dialect), bits, keys, [len(v) for v in values], [k in own for k in keys]))
        yield pd.DataFrame(rows, columns=PARSE_COLUMNS)


def choose_dialects(cells: DataFrame) -> DataFrame:
    """The cheapest dialect of each distinct (field_name, cell): columns field_name, cell, dialect, n_values.

    Code lengths are those of the field's values over all its cells: a value costs log2(total / count), counted in
    the finest reading of all *other* cells; one that no other cell has is spelled out. Ties go to the coarser
    reading.
    """
    parses = cut(spread(cells, "field_name", "cell").mapInPandas(_parses, "field_name string, cell string, rank int, dialect string, mark_bits double, keys array<string>, lengths array<int>, own array<boolean>"))
    book = parses.filter("rank = 0").select("field_name", F.explode(F.array_distinct("keys")).alias("key")).groupBy("field_name", "key").agg(F.count("*").alias("n"))
    totals = book.groupBy("field_name").agg(F.sum("n").alias("total"))
    uses = parses.select("field_name", "cell", "rank", "dialect", "mark_bits", F.size("keys").alias("n_values"), F.posexplode_outer(F.arrays_zip("keys", "lengths", "own")).alias("pos", "v"))
    uses = uses.select("field_name", "cell", "rank", "dialect", "mark_bits", "n_values", F.col("v.keys").alias("key"), F.col("v.lengths").alias("length"), F.col("v.own").alias("own"))
    coded = lookup_skewed(uses, book, ["field_name", "key"], "n", ["n"]).join(F.broadcast(totals), "field_name")
    others = F.coalesce("n", F.lit(0)) - F.when(F.col("own"), 1).otherwise(0)
    bits = F.when(F.col("key").isNull(), 0.0).when(others > 0, F.log2(F.col("total") / others) + 1).otherwise(F.log2("total") + NEW_BITS + F.col("length") * CHAR_BITS)
    costs = coded.groupBy("field_name", "cell", "rank", "dialect", "mark_bits", "n_values").agg((F.sum(bits) + F.col("mark_bits")).alias("bits"))
    best = costs.groupBy("field_name", "cell").agg(F.min(F.struct(F.round("bits", 6), -F.col("rank"), "dialect", "n_values")).alias("b"))
    return best.select("field_name", "cell", F.col("b.dialect").alias("dialect"), F.col("b.n_values").alias("n_values"))


def _read(batches):
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            values = split(inner(row.cell), *_unspell(row.dialect))
            rows.extend((row.parent_asin, row.field_name, i, v) for i, v in enumerate(values, 1))
        yield pd.DataFrame(rows, columns=["parent_asin", "field_name", "pos", "item_text"]).astype({"pos": "int32"})


def detail_cells(catalog: DataFrame, fields: tuple) -> DataFrame:
    """Distinct (parent_asin, field_name, cell) of the named entries of ``details`` whose text isn't null or blank."""
    pairs = catalog.filter("parent_asin IS NOT NULL").select("parent_asin", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.try_element_at("details", F.lit(f)).alias("cell")) for f in fields])).alias("c"))
    return pairs.select("parent_asin", "c.field_name", "c.cell").filter(trimmed("cell") != "").distinct()


def cell_counts(cells: DataFrame) -> DataFrame:
    """Distinct (field_name, cell) with the number of products that have it."""
    return cells.groupBy("field_name", "cell").agg(F.count("*").alias("products"))


def with_dialects(cells: DataFrame) -> DataFrame:
    """``cells`` with the dialect and number of values of each cell; the products of one cell may be any share of all."""
    counts = cut(cell_counts(cells))
    chosen = choose_dialects(counts.select("field_name", "cell")).join(counts, ["field_name", "cell"])
    return lookup_skewed(cells, chosen, ["field_name", "cell"], "products", ["dialect", "n_values"])


def split_values(catalog: DataFrame, fields: tuple = ("Material", "Size")) -> DataFrame:
    """One row (parent_asin, field_name, pos, item_text) for each value of a cell that holds at least two.

    Null, empty and blank cells, null keys and cells of one value give no row; repeated rows of a product count
    once; columns besides parent_asin and details are ignored; an empty table gives none. pos counts from 1 in the
    order of the cell. Two different cells of one product and field both give their rows.
    """
    cells = with_dialects(cut(detail_cells(catalog, fields))).filter("n_values > 1")
    return cells.select("parent_asin", "field_name", "cell", "dialect").mapInPandas(_read, "parent_asin string, field_name string, pos int, item_text string")
