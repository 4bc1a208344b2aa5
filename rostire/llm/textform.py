"""Consistent form of text, and the comparison keys built on it.

Consistent form: letters, digits and marks composed and of ordinary width; no invisible characters;
ordinary gaps between words; one script within a word; Romanian letters in Romanian words. Letter
case, repeated spaces, quotation marks and dashes stay.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of Greek and Cyrillic that look like Latin ones.
LOOK_ALIKE = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԁ": "D",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "τ": "t",
}
# Letters of older encodings in place of the Romanian ones.
ROMANIAN = {"ş": "ș", "ţ": "ț", "Ş": "Ș", "Ţ": "Ț", "ǎ": "ă", "Ǎ": "Ă"}

#: Characters that need no look: a text of these alone is in consistent form. Java and Python read it alike.
PLAIN = r"\t\n\r\x20-\x7e¡-¬®-įı-ŝŠšŤ-ǌǏ-ǯǱ-ɏ‐-‧‰-⁞€"
SUSPECT = f"[^{PLAIN}]"
_SUSPECT = re.compile(SUSPECT)
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
#: A word as it is spelt: letters, digits and marks with invisible characters inside. Java and Python read it alike.
SPELT = r"[\p{L}\p{N}\p{M}\p{Cf}]+"
_SPELT = regex.compile(SPELT)
_INVISIBLE = regex.compile(r"[\p{Cf}--[؀-؅۝܏࣢]͏︀-️ᅟᅠ឴឵]", flags=regex.V1)
_GAP = regex.compile(r"[\p{Zs}\x0b\x0c\x85\x1c-\x1f--\x20]", flags=regex.V1)
_LINE = re.compile("[  ]")
_NOT_ROMANIAN = re.compile("[ğıİöüçÖÜÇĞñ]")
_SHAPED = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
_TO_LATIN = str.maketrans(LOOK_ALIKE)
_TO_ROMANIAN = str.maketrans(ROMANIAN)


@lru_cache(maxsize=1 << 14)
def _ordinary(ch: str) -> str:
    """Ordinary-width, unligatured form of a letter, digit or mark; other characters as they are."""
    tag = ud.decomposition(ch).partition(" ")[0]
    if tag[:1] != "<" or ud.category(ch)[0] not in "LNM" or ud.category(ch) == "No":
        return ch
    if tag in _SHAPED or (tag == "<compat>" and ud.name(ch, "").startswith("LATIN SMALL LIGATURE")):
        return ud.normalize("NFKC", ch)
    return ch


@lru_cache(maxsize=1 << 14)
def script(ch: str) -> str:
    """L, C or G for a Latin, Cyrillic or Greek letter, else an empty string."""
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "L" if ch.isalpha() else ""
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G" if ch.isalpha() else ""
    if 0x400 <= o < 0x530:
        return "C" if ch.isalpha() else ""
    return ""


_FROM_LATIN: dict[str, dict[str, str]] = {"C": {}, "G": {}}
for _a, _b in LOOK_ALIKE.items():
    _FROM_LATIN[script(_a)].setdefault(_b, _a)


@lru_cache(maxsize=1 << 16)
def consistent_word(word: str) -> str:
    """Consistent form of one run of letters, digits and marks, without its context."""
    w = ud.normalize("NFD", "".join(map(_ordinary, word)))
    found = {s for s in map(script, w) if s}
    if len(found) > 1:
        if all(script(c) in ("", "L") or c in LOOK_ALIKE for c in w):
            w = w.translate(_TO_LATIN)
        else:
            for s in ("C", "G"):
                back = _FROM_LATIN[s]
                if s in found and all(script(c) in ("", s) or c in back for c in w):
                    w = "".join(back.get(c, c) if script(c) == "L" else c for c in w)
                    break
    w = ud.normalize("NFC", w)
    if not _NOT_ROMANIAN.search(w):
        w = w.translate(_TO_ROMANIAN)
    return w


def _kind(word: str) -> str:
    """The single script of a word's Latin, Cyrillic or Greek letters; '*' for several, '' for none."""
    found = {s for s in map(script, word) if s}
    return found.pop() if len(found) == 1 else "*" if found else ""


def _disguised(words: list[str]) -> list[int]:
    """Words wholly of look-alikes among Latin neighbours, in a text with no real word of that script."""
    kinds = [_kind(w) for w in words]
    out = []
    for s in ("C", "G"):
        own = [i for i, k in enumerate(kinds) if k == s]
        if not own or any(script(c) == s and c not in LOOK_ALIKE for i in own for c in ud.normalize("NFD", words[i])):
            continue
        named = [i for i, k in enumerate(kinds) if k]
        at = {i: n for n, i in enumerate(named)}
        for i in own:
            near = [kinds[named[j]] for j in (at[i] - 1, at[i] + 1) if 0 <= j < len(named)]
            if near and all(k == "L" for k in near):
                out.append(i)
    return out


def visible(text: str) -> str:
    """The text with ordinary gaps and without invisible characters."""
    return _LINE.sub("\n", _GAP.sub(" ", _INVISIBLE.sub("", text))).replace("％", "%")


def consistent(text: str | None) -> str | None:
    """Consistent form of a whole text; null stays null, an empty text stays empty."""
    if text is None or _SUSPECT.search(text) is None:
        return text
    return _in_context(visible(text), lambda w: consistent_word(w) if _SUSPECT.search(w) else w)


def rebuilt(text: str, canonical: dict[str, str]) -> str:
    """Consistent form of a text from the canonical members of its words; words without an entry are canonical.

    What is no matter of single words, gaps, invisible characters and disguises in context, follows.
    """
    return _in_context(visible(_SPELT.sub(lambda m: canonical.get(m.group(), m.group()), text)), str)


def _in_context(text: str, form: Callable[[str], str]) -> str:
    """The text with every word in its form, and those unmasked that only their neighbours give away."""
    out, last, words = [], 0, []
    for m in _WORD.finditer(text):
        out.append(text[last : m.start()])
        last = m.end()
        words.append(form(m.group()))
    for i in _disguised(words):
        words[i] = ud.normalize("NFC", ud.normalize("NFD", words[i]).translate(_TO_LATIN))
    parts = [x for pair in zip(out, words) for x in pair]
    parts.append(text[last:])
    return "".join(parts)


_FOLD = str.maketrans({c: ud.normalize("NFD", c)[0] for c in "ăâîșțéáóíúüöőűèàêùñäçëïôûìòãõåćčšžńśźżęą"})
_COMMON = (("ă", "a"), ("ș", "s"), ("â", "a"), ("î", "i"), ("ț", "t"), ("„", '"'), ("”", '"'), ("—", "-"))
_MARKS = regex.compile(r"\p{M}+")
_RUN = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    """Consistent form without case and diacritics."""
    return _folded(consistent(text))


def _folded(text: str) -> str:
    t = text.casefold()
    for a, b in _COMMON:
        t = t.replace(a, b)
    if t.isascii():
        return t
    t = t.translate(_FOLD)
    return t if t.isascii() else _MARKS.sub("", ud.normalize("NFD", t))


def words_of(text: str | None) -> list[str]:
    """Words (runs of letters and digits) in consistent form, without case and diacritics."""
    return _RUN.findall(folded(text)) if text else []


_folded_char = lru_cache(maxsize=1 << 14)(_folded)


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each of ``words_of(text)``, with its marks, in the consistent form of the text."""
    form = consistent(text)
    parts = [_folded_char(c) for c in form]
    at = [i for i, p in enumerate(parts) for _ in p]
    spans = []
    for m in _RUN.finditer("".join(parts)):
        end = at[m.end() - 1] + 1
        while end < len(parts) and not parts[end]:
            end += 1
        spans.append((at[m.start()], end))
    return spans


_LOOSE = regex.compile(r"[\p{P}\p{Z}\p{C}]+")
_KEPT = re.compile(r"[^\W_]+|[$+<=>^`|~¢-¦¨©¬®-±´¸×÷€⁄⁒]+")
_SIGN = re.compile(r"[^\W_]")


def copy_key(text: str | None) -> str | None:
    """What stays of a text when whitespace, letter case and punctuation do not count.

    Null for a text without letters and digits: such texts are no copies of anything.
    """
    if not text:
        return None
    if _SUSPECT.search(text) is None:
        t = "".join(_KEPT.findall(text.casefold()))
    else:
        t = ud.normalize("NFC", _LOOSE.sub("", consistent(text).casefold()))
    return t if _SIGN.search(t) else None


@F.pandas_udf(T.StringType())
def _consistent_udf(s: pd.Series) -> pd.Series:
    return s.map(consistent, na_action="ignore")


def consistent_form(col: Column) -> Column:
    """Column in consistent form. Plain texts never leave the JVM; only the suspect ones are sent to Python."""
    return F.coalesce(_consistent_udf(F.when(col.rlike(SUSPECT), col)), col)
