"""What a product listing states, apart from its wording: model code, measure, pack count, colour, and its name's words."""

from __future__ import annotations

import re
import unicodedata

#: Unit, quantity and size of one unit in mm, ml or g. Fixed values.
UNITS = {
    "mm": ("length", 1.0), "millimeter": ("length", 1.0), "millimetre": ("length", 1.0), "cm": ("length", 10.0), "centimeter": ("length", 10.0), "centimetre": ("length", 10.0),
    "m": ("length", 1000.0), "meter": ("length", 1000.0), "metre": ("length", 1000.0), "in": ("length", 25.4), "inch": ("length", 25.4), "inche": ("length", 25.4), '"': ("length", 25.4), "ft": ("length", 304.8), "feet": ("length", 304.8), "foot": ("length", 304.8),
    "ml": ("volume", 1.0), "cl": ("volume", 10.0), "l": ("volume", 1000.0), "liter": ("volume", 1000.0), "litre": ("volume", 1000.0), "gal": ("volume", 3785.41), "gallon": ("volume", 3785.41), "fl oz": ("volume", 29.5735), "qt": ("volume", 946.353),
    "g": ("weight", 1.0), "gram": ("weight", 1.0), "kg": ("weight", 1000.0), "kilogram": ("weight", 1000.0), "oz": ("weight", 28.3495), "ounce": ("weight", 28.3495), "lb": ("weight", 453.592), "pound": ("weight", 453.592),
}
#: Ratio below which two statements of a measure, rounded in different units, are the same.
SAME_RATIO = 1.03

_MEASURE = re.compile(r"(?<![\w.,/-])(\d+(?:[.,]\d+)?)\s*-?\s*(" + "|".join(re.escape(u) + ("" if u == '"' else "s?") for u in sorted(UNITS, key=len, reverse=True)) + r")(?!\w|\s+(?:the|a|small)\b)\.?", re.I)
_PACK = re.compile(r"\b(?:(?:pack|set|box|lot|bundle|case)\s+of\s+(\d+)|(\d+)\s*-?\s*(?:pack|packs|pcs|pc|pieces|piece|count|ct|pk|units)\b|x\s?(\d+)(?![\w.]))(?!\s+(?:of|in)\s+small)", re.I)
_MODEL = re.compile(r"(?<![\w-])(?:model\s+|ref\.?\s+|no\.?\s+)?([a-z]{1,4})\s?[-/ ]?\s?(\d{2,6})(?![\w.,]*\d|\s*(?:mm|cm|ml|m|in|g|kg|l|oz)\b)", re.I)
_WORD = re.compile(r"[a-z0-9]+")
#: Words before a number that make no model code with it. Fixed values.
NO_CODE = frozenset("x of by in for to at no the a uk eu us size pack set box count lot from and is with new plus top on or as".split())


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c)).lower().replace("″", '"').replace("”", '"').replace("’", "'")


def model_of(title: str) -> str | None:
    """Letters and digits of the first model code of a title."""
    for m in _MODEL.finditer(title):
        if m[1] not in NO_CODE and m[1] not in UNITS:
            return m[1] + m[2]
    return None


def measure_of(texts: list[str]) -> tuple[str, float] | None:
    """Quantity and value in mm, ml or g of the first measure stated."""
    for text in texts:
        for m in _MEASURE.finditer(text):
            unit = m[2].lower()
            unit = unit if unit in UNITS else unit[:-1]
            if unit in UNITS and (value := float(m[1].replace(",", "."))) > 0:
                return UNITS[unit][0], value * UNITS[unit][1]
    return None


def pack_of(texts: list[str]) -> int:
    """Pieces; 1 where none are stated."""
    for text in texts:
        if (m := _PACK.search(text)) and (n := int(m[1] or m[2] or m[3])) > 0:
            return n
    return 1


def colour_of(texts: list[str], colours: re.Pattern) -> str | None:
    """The first colour named in a statement of colour, else in the title."""
    for text in texts:
        if m := colours.search(text):
            return m[0]
    return None


def colour_pattern(names) -> re.Pattern:
    parts = sorted({r"[\s-]+".join(map(re.escape, _WORD.findall(fold(n)))) for n in names if n and n.strip()}, key=len, reverse=True)
    return re.compile(r"(?<!\w)(?:" + "|".join(parts) + r")(?!\w)" if parts else r"(?!)")
