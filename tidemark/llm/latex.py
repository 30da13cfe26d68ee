"""Plain words of LaTeX texts: accents as typed made alike, own macros replaced, markup and formulas left out."""

from __future__ import annotations

import re
import unicodedata

WORD = re.compile(r"[^\W_]+")
_ACCENT = re.compile(r"\{?\\(?:[\"'`^~=.]|[uvHtcdbrk](?=[\s{\\]))\s*(?:\{\s*\\?([A-Za-z])\s*\}|\\?([A-Za-z]))\}?")
_LETTER = re.compile(r"\{?\\(ss|ae|AE|oe|OE|aa|AA|o|O|l|L|i|j)(?:\{\}|\}|(?![A-Za-z]) ?)")
_MACRO = re.compile(r"\\(?:(?:re)?newcommand|providecommand)\*?\s*\{?\s*\\([A-Za-z]+)\s*\}?\s*(?:\[\d\])?\s*\{((?:[^{}]|\{[^{}]*\})*)\}|\\def\s*\\([A-Za-z]+)\s*\{((?:[^{}]|\{[^{}]*\})*)\}")
# What begins and ends formulas. A formula can't hold an empty line; escaped dollars and line breaks begin none.
_DELIMITER = re.compile(r"\\\\|\\\$|\$\$?|\\[()\[\]]|\\(begin|end)\{(equation|align|displaymath|eqnarray|gather|multline|math)\*?\}|(?:\r\n?|\n)[ \t]*(?:\r\n?|\n)")
_CLOSES = {"$": "$", "$$": "$$", "\\(": "\\)", "\\[": "\\]"}
# References with their keys, commands (their arguments stay), soft hyphens, words broken at a line's end.
_MARKUP = re.compile(r"\\(?:cite\w*|ref|eqref|label|pageref|url|input|include|begin|end|bibitem)\*?\s*(?:\[[^\]]*\])?\s*\{[^{}]*\}|\\-|(?<=\w)-[ \t]*\r?\n[ \t%]*(?=[a-z])|\\[A-Za-z]+\*?")
#: Letters that decomposition leaves whole. Fixed values.
_WHOLE = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ı": "i", "æ": "ae", "œ": "oe"})
_MARKS = re.compile("[\u0300-\u036f\u00ad\u200b-\u200d\u2060\ufeff]+")


def fold(text: str) -> str:
    """Case and accents away."""
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold().translate(_WHOLE)


def expand(text: str) -> str:
    """Own macros without parameters replaced by what they stand for; their definitions say so once more."""
    if "\\newcommand" not in text and "\\providecommand" not in text and "\\def" not in text and "\\renewcommand" not in text:
        return text
    meant = {m[1] or m[3]: m[2] if m[1] else m[4] for m in _MACRO.finditer(text)}
    meant = {k: v for k, v in meant.items() if "#" not in v and "\\" + k not in v}
    if not meant:
        return text
    used = re.compile(r"\\(" + "|".join(sorted(meant, key=len, reverse=True)) + r")(?![A-Za-z])(?:\{\})?")
    return used.sub(lambda m: meant[m[1]], text)


def letters(text: str) -> str:
    """Accent commands replaced by their letters without accent."""
    return _LETTER.sub(lambda m: m[1], _ACCENT.sub(lambda m: m[1] or m[2], text))


def without_formulas(text: str, displayed: bool) -> str:
    """``text`` with its formulas, of whatever length, replaced by spaces; displayed ones other than in dollars only if
    ``displayed``. A formula that isn't closed (if not an environment, before an empty line) is text. One pass over the
    delimiters."""
    parts, kept, opened, last = [], 0, None, {}
    for m in _DELIMITER.finditer(text):
        mark = m[0]
        if mark in ("\\\\", "\\$"):
            continue
        if opened is None:
            if mark in _CLOSES and (displayed or mark != "\\["):
                opened = m.start(), _CLOSES[mark]
            elif m[1] == "begin" and displayed:
                close = "\\end" + mark[6:]
                if last.setdefault(close, text.rfind(close)) > m.start():
                    opened = m.start(), close
        elif mark == opened[1] or mark[0] == opened[1][0] == "$":
            parts.append(text[kept : opened[0]])
            kept, opened = m.end(), None
        elif mark[0] in "\r\n" and opened[1][:4] != "\\end":
            opened = None
    return " ".join([*parts, text[kept:]]) if parts else text


def plain(text: str) -> str:
    """``text`` in folded form, with markup replaced by spaces."""
    if "\\" in text:
        text = letters(expand(text))
    if "$" in text or "\\(" in text:
        text = without_formulas(text, displayed=False)
    return fold(_MARKUP.sub(lambda m: "" if m[0][0] == "-" or m[0] == "\\-" else " ", text))


def words(text: str) -> list[str]:
    return WORD.findall(plain(text))
