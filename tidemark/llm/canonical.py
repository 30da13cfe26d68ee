"""Mapping of freely typed values to a canonical list: a trie of entries and aliases, searched by a Levenshtein automaton."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.engine import cut, lookup_skewed, spread
from tidemark.operators.multivalue import cell_counts, detail_cells, with_dialects

#: Words around a value that name no value, besides the field's own name. Fixed values.
FILLERS = frozenset("color colour shade tone look finish in type kind style material fabric made of genuine real std new no nr num col ca approx".split())
#: Words that announce a stock code rather than a value. Fixed values.
CODES = frozenset("opt option swatch lot sku ref item code".split())
#: Texts that stand for no value. Fixed values.
PLACEHOLDERS = frozenset("na n/a none null nil unknown tbd misc other others various assorted multi multicolor multicolour default standard undefined unspecified see picture as shown not applicable".split())

#: Largest broadcast trie, in entries of the canonical table; the table is a fixed list, this is its checked bound.
MAX_ENTRIES = 100_000


def bound(length: int) -> int:
    """Edits allowed in a text of so many characters."""
    return 0 if length < 3 else 1 if length < 6 else 2 if length < 9 else 3


def fold(text: str) -> str:
    """Lower case without accents and compatibility forms."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


def words(text: str) -> list[str]:
    """Words of letters and digits; a change from lower to upper case parts words only where the text has both."""
    if re.search(r"[a-z]{2}[A-Z][a-z]", text):
        text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", text)
    return re.findall(r"[^\W_]+", fold(text))


def core(field: str, text: str) -> list[str]:
    """The words that can name a value: without fillers, the field's name, running numbers and version marks."""
    bare = re.sub(r"\(\s*[\w .]*\s*\)|#\s*\d+|\bv\s*\d+\b|\bno\.?\s*\d+", " ", text, flags=re.I)
    found = [re.sub(r"(?<=\w{3})ish$", "", w) for w in words(bare)]
    found = [w for w in found if w != field.lower() and w not in FILLERS]
    return [w for w in found if not w.isdigit()] if any(not w.isdigit() for w in found) else found


def skeleton(word: str) -> str:
    """The word without its vowels after the first letter."""
    return word[:1] + re.sub("[aeiou]", "", word[1:])


#: Edits that a path of whole words leaves: all that the text's length allows. Nodes kept before a trie begins anew.
ANY_EDITS, MOST_NODES = 9, 1_000_000


class Node:
    """A place in the trie: the entries that end here with the edits that they leave, and what may follow.

    ``open`` holds, for each alias that comes through here, (entry, rest of its word, words to come, joint, shortened):
    whole words may come in any order, shortened ones in the entry's. The nodes below are made when first asked for."""

    __slots__ = ("below", "depth", "ends", "open")

    def __init__(self, aliases: set, depth: int):
        self.depth, self.below, self.ends, self.open = depth, None, [], []
        for alias in aliases:
            self._add(*alias)

    def _add(self, ref_id, rest, to_come, joint, shortened):
        if rest:
            self.open.append((ref_id, rest, to_come, joint, shortened))
        elif not to_come:
            if not shortened:
                self.ends.append((ref_id, ANY_EDITS))
            elif self.depth >= 3:
                self.ends.append((ref_id, 1 if self.depth > 4 else 0))
        elif shortened:
            for form in {to_come[0], skeleton(to_come[0])}:
                self._add(ref_id, joint + form, to_come[1:], joint, True)
        else:
            for i, word in enumerate(to_come):
                if word not in to_come[:i]:
                    self._add(ref_id, joint + word, to_come[:i] + to_come[i + 1 :], joint, False)

    def children(self) -> tuple[dict, int]:
        """The nodes below by letter, and how many were made now."""
        if self.below is not None:
            return self.below, 0
        follow: dict[str, set] = {}
        for ref_id, rest, to_come, joint, shortened in self.open:
            follow.setdefault(rest[0], set()).add((ref_id, rest[1:], to_come, joint, shortened))
        self.below = {c: Node(aliases, self.depth + 1) for c, aliases in follow.items()}
        return self.below, len(self.below)


class Trie:
    """Entries under their aliases: the words in any order, apart or written together, and in the entry's order words
    shortened to their consonants (with at most one edit more). Any number of words: the orders of an entry are
    followed word by word, by which of its words are still to come, and only as far as searches go."""

    def __init__(self, entries):
        self.aliases = set()
        for ref_id, canonical in entries:
            parts = tuple(words(canonical))
            for joint in (" ", "") if len(parts) > 1 else ("",):
                for i, word in enumerate(parts):
                    self.aliases.add((ref_id, word, tuple(sorted(parts[:i] + parts[i + 1 :])), joint, False))
                if parts:
                    self.aliases.add((ref_id, skeleton(parts[0]), parts[1:], joint, True))
                    self.aliases.add((ref_id, parts[0], parts[1:], joint, True))
        self.root, self.made = Node(self.aliases, 0), 1

    def search(self, text: str, most: int) -> dict[int, int]:
        """Distance (insertion, deletion, replacement, swap of neighbours) of each entry within ``most`` edits of ``text``.

        The automaton's state is the row of edit distances from the path so far to each prefix of ``text``; a branch
        ends once no distance of its row is within ``most``.
        """
        if self.made > MOST_NODES:
            self.root, self.made = Node(self.aliases, 0), 1
        found: dict[int, int] = {}
        first = list(range(len(text) + 1))
        stack = [(self.root, first, None, "")]
        while stack:
            node, row, before, last = stack.pop()
            if node.ends and row[-1] <= most:
                for ref_id, room in node.ends:
                    if row[-1] <= room:
                        found[ref_id] = min(found.get(ref_id, 99), row[-1])
            children, made = node.children()
            self.made += made
            for c, below in children.items():
                step = [row[0] + 1]
                for i, t in enumerate(text, 1):
                    d = min(step[i - 1] + 1, row[i] + 1, row[i - 1] + (t != c))
                    if before is not None and i > 1 and t == last and text[i - 2] == c:
                        d = min(d, before[i - 2] + 1)
                    step.append(d)
                if min(step) <= most:
                    stack.append((below, step, row, c))
        return found


def resolve(trie: Trie, field: str, text: str) -> int:
    """ref_id of the one entry nearest to ``text``, -1 where none is within the bound or two are equally near."""
    named = core(field, text)
    if not named or any(w in CODES for w in named) or all(w in PLACEHOLDERS for w in named) or fold(text).strip() in PLACEHOLDERS:
        return -1
    best: dict[int, int] = {}
    for form in {" ".join(named), "".join(named)}:
        for ref_id, d in trie.search(form, bound(len(form))).items():
            best[ref_id] = min(best.get(ref_id, 99), d)
    if not best:
        return -1
    least = min(best.values())
    nearest = [r for r, d in best.items() if d == least]
    return nearest[0] if len(nearest) == 1 else -1


def map_values(values: DataFrame, canonical: DataFrame) -> DataFrame:
    """``values`` (distinct field_name, cell) with ref_id: the entry's own id for an exact text, else the nearest
    entry's, -1 where none is meant. Each distinct text is searched once, whatever the number of its rows."""
    spark = values.sparkSession
    entries = canonical.filter("canonical IS NOT NULL AND field_name IS NOT NULL AND ref_id IS NOT NULL").select("ref_id", "field_name", "canonical").distinct().take(MAX_ENTRIES + 1)
    if len(entries) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} canonical entries")
    by_field: dict[str, list] = {}
    for e in sorted(entries):
        by_field.setdefault(e.field_name, []).append((e.ref_id, e.canonical))
    shared = spark.sparkContext.broadcast(by_field)

    def find(batches):
        tries = {f: Trie(e) for f, e in shared.value.items()}
        exact = {(f, c): r for f, e in shared.value.items() for r, c in e}
        for batch in batches:
            ids = [exact[f, c] if (f, c) in exact else resolve(tries[f], f, c) if f in tries else -1 for f, c in zip(batch["field_name"], batch["cell"], strict=True)]
            yield batch[["field_name", "cell"]].assign(ref_id=pd.array(ids, dtype="int32"), is_exact=[(f, c) in exact for f, c in zip(batch["field_name"], batch["cell"], strict=True)])

    return values.select("field_name", "cell").mapInPandas(find, "field_name string, cell string, ref_id int, is_exact boolean")


def map_details(catalog: DataFrame, canonical: DataFrame, fields: tuple = ("Color", "Material", "Style"), several: tuple = ("Material",)) -> DataFrame:
    """(parent_asin, field_name, ref_id) for each product and field whose cell isn't null or blank, isn't exactly a
    canonical text and, for the fields in ``several``, doesn't hold several values.

    Null keys, null, empty and blank cells give no row; repeated rows count once; two different cells of a product
    and field give one row each unless they mean the same entry. Other columns are ignored; empty tables give none.
    With no entry for a field every cell of it gives -1.
    """
    plain = tuple(f for f in fields if f not in several)
    cells = detail_cells(catalog, plain)
    if several:
        single = with_dialects(cut(detail_cells(catalog, several))).filter("coalesce(n_values, 0) < 2")
        cells = cells.unionByName(single.select("parent_asin", "field_name", "cell"))
    cells = cut(cells)
    counts = cell_counts(cells)
    mapped = cut(map_values(spread(counts, "field_name", "cell"), canonical).join(counts, ["field_name", "cell"]))
    found = lookup_skewed(cells, mapped, ["field_name", "cell"], "products", ["ref_id", "is_exact"])
    return found.filter("NOT is_exact").select("parent_asin", "field_name", "ref_id").distinct()


def unmatched(catalog: DataFrame, canonical: DataFrame, **kw) -> DataFrame:
    """Report of what fits none: (parent_asin, field_name)."""
    return map_details(catalog, canonical, **kw).filter(F.col("ref_id") == -1).select("parent_asin", "field_name")
