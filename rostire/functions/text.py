"""String primitives, as columns.

Patterns for Java are written with ``(?U)`` so that classes follow Unicode as Python's do. What needs a running
position (sentences, pauses) is one Arrow call for a batch of rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character replacements of the clean layer.
LEGACY = ("şŞţŢ", "șȘțȚ")
QUOTES = ("“”„«»‘’ʼ", "\"\"\"\"\"'''")
#: Python's whitespace, which is wider than Java's.
SPACE = r"(?U)[\s\x1c-\x1f]+"
# Abbreviations whose period ends no sentence.
PROTECTED_ABBREVIATIONS = ("dr", "d-na", "d-nul", "prof", "ing", "nr", "art", "pag", "str", "bd", "sec", "min", "max", "etc", "ex", "cf", "vol", "cap", "fig")
# Spans whose marks end no sentence, and tokens.
URL = r"\bhttps?://\S+|\bwww\.\S+"
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
DATE = r"\b\d{1,2}\.\d{1,2}\.\d{2,4}\b"
DECIMAL = r"\b\d+[.,]\d+\b"
TOKEN = r"(?U)\w+(?:[-’']\w+)*|[^\w\s]"
#: Stand-ins for ``. ! ? …`` inside protected spans (private use).
_HIDDEN = ("", ".!?…")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, however often and in whatever lambda it is used.

    A column that a lambda captures is otherwise inlined and computed anew for every element.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def regex_map(col: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """Replace every match by ``fn(match)``; a null result leaves the match as it is."""

    def run(c: Column) -> Column:
        found = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda m: F.coalesce(fn(m), m))
        return F.array_join(F.zip_with(F.split(c, pattern, -1), found, lambda t, m: F.concat(F.coalesce(t, F.lit("")), F.coalesce(m, F.lit("")))), "")

    return let(col, run)


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(col: Column) -> Column:
    """Composed form; texts of Latin letters without combining marks stay in the JVM."""
    return F.coalesce(_nfc(F.when(col.rlike(r"[^\x00-˿Ͱ-ͳЀ-҂‐-‧‰-⁞€]"), col)), col)


def legacy_diacritics(col: Column) -> Column:
    """Romanian letters with comma for those with cedilla."""
    return F.translate(col, *LEGACY)


def straight_quotes(col: Column) -> Column:
    """Straight quotation marks for all others."""
    return F.translate(col, *QUOTES)


def collapse_space(col: Column) -> Column:
    """Every run of whitespace as one space."""
    return F.regexp_replace(col, SPACE, " ")


def clean(col: Column) -> Column:
    """The clean layer's text: composed, diacritics, quotes, whitespace, stripped."""
    return F.trim(collapse_space(straight_quotes(legacy_diacritics(nfc(col)))))


def struct_lists(rows: list[list[tuple] | None], kinds: dict[str, pa.DataType]) -> pa.Array:
    """Arrow lists of structs from lists of tuples; None is a null list."""
    flat = [x for r in rows if r for x in r]
    ends = np.cumsum([0] + [len(r or ()) for r in rows])
    starts = pa.array([None if r is None else int(e) for r, e in zip(rows, ends)] + [int(ends[-1])], pa.int32())
    columns = list(zip(*flat)) if flat else [[] for _ in kinds]
    return pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds)))


_HIDE, _SHOW = str.maketrans(_HIDDEN[1], _HIDDEN[0]), str.maketrans(*_HIDDEN)
#: What each pattern needs to be there at all, and the pattern. A run of marks after a span is hidden with it only if
#: the span itself ends in a terminal mark: then the run's first mark lies inside.
_PROTECTED = [
    (need, re.compile(f"(?:{p})(?:(?<=[.!?…])[.!?…]*)?", flags))
    for need, p, flags in (
        ("/w", URL, re.I), ("@", EMAIL, 0), (".", DATE, 0), (".,", DECIMAL, 0),
        (".", rf"\b(?:{'|'.join(sorted(map(re.escape, PROTECTED_ABBREVIATIONS), key=len, reverse=True))})\.", re.I),
    )
]
SEGMENT = re.compile(r"""[^.!?…]*[.!?…]+["')\]]*|[^.!?…]+\Z""")


def hidden(text: str) -> str:
    """The text with terminal marks inside URLs, addresses, dates, decimals and abbreviations as stand-ins."""
    low = text.lower()
    for need, pattern in _PROTECTED:
        if any(c in low for c in need):
            text = pattern.sub(lambda m: m[0].translate(_HIDE), text)
    return text


def sentence_spans(text: str) -> list[tuple[str, int, int]]:
    """Sentences of a clean text with their offsets."""
    out = []
    for m in SEGMENT.finditer(hidden(text)):
        one = m[0].strip(" ")
        if one:
            start = m.start() + len(m[0]) - len(m[0].lstrip(" "))
            out.append((one.translate(_SHOW), start, start + len(one)))
    return out


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def _segment(texts: pa.Array) -> pa.Array:
    return struct_lists([None if t is None else sentence_spans(t) for t in texts.to_pylist()], {"text": pa.string(), "start": pa.int32(), "end": pa.int32()})


def segment(col: Column) -> Column:
    """Sentences of a clean text as ``array<struct<text,start,end>>``, with code-point offsets.

    One Arrow call for each batch, in time linear in the text; native arrays could only be grown by copying.
    """
    return _segment(col)


def punctuation_type(col: Column) -> Column:
    """Sentence type by the last mark alone."""
    return F.when(col.endswith("?"), "interrogative").when(col.endswith("!"), "exclamative").otherwise("declarative")


# Names of pause marks.
PAUSE_NAMES = {",": "comma", ";": "semicolon", ":": "colon", ".": "period", "!": "exclamation", "?": "question"}


_PAUSE = re.compile(r"\.\.\.|…|[,;:.!?]")


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("offset", T.IntegerType()), T.StructField("category", T.StringType())])))
def _pauses(texts: pa.Array) -> pa.Array:
    rows = [None if t is None else [(m.start(), PAUSE_NAMES.get(m[0], "ellipsis")) for m in _PAUSE.finditer(t)] for t in texts.to_pylist()]
    return struct_lists(rows, {"offset": pa.int32(), "category": pa.string()})


def pause_locations(col: Column) -> Column:
    """``array<struct<offset,category>>`` of the pause marks, ellipses first and their dots not again."""
    return _pauses(col)


def dedup_key(col: Column) -> Column:
    """Text without differences of whitespace and case."""
    return F.lower(F.replace(F.trim(collapse_space(col)), F.lit("ß"), F.lit("ss")))


def slug(col: Column) -> Column:
    """A name fit for files."""
    return F.regexp_replace(col, r"[^A-Za-z0-9._-]+", "_")


def detokenize(tokens: Column, space_after: Column) -> Column:
    """Text of tokens and of flags that say whether a space follows."""
    return F.trim(F.array_join(F.zip_with(tokens, space_after, lambda t, s: F.concat(F.coalesce(t, F.lit("")), F.when(F.coalesce(s, F.lit(True)), " ").otherwise(""))), ""))


def contains_any(col: Column, markers: list[str]) -> Column:
    """Whether any marker stands in the text as a substring, letter case aside."""
    low = F.lower(col)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in markers], F.lit(False))


def paragraph_starts(col: Column) -> Column:
    """Sentence indices at which a paragraph of the original text starts, after its terminal runs."""
    counts = F.transform(F.split(col, r"(?U)\n\s*\n", -1), lambda p: F.greatest(F.lit(1), F.size(F.regexp_extract_all(p, F.lit("[.!?…]+"), F.lit(0)))))
    start = F.struct(F.lit(0).alias("sum"), F.array(F.lit(0)).alias("at"))
    step = lambda x, n: F.struct((x["sum"] + n).alias("sum"), F.concat(x["at"], F.array(x["sum"] + n)).alias("at"))
    return F.aggregate(counts, start, step, lambda x: F.slice(x["at"], 1, F.size(x["at"]) - 1))


def parse_feats(col: Column) -> Column:
    """``A=B|C=D`` as a map; null, empty and ``_`` give an empty map."""
    ok = col.isNotNull() & (col != "") & (col != "_")
    return F.when(ok, F.str_to_map(col, F.lit(r"\|"), F.lit("="))).otherwise(F.expr("cast(map() as map<string,string>)"))


# How the signs of addresses are read.
SIGNS = {"@": "arond", ".": "punct", "/": "slash", "-": "liniuță", "_": "liniuță jos", ":": "două puncte", "?": "semnul întrebării", "=": "egal", "&": "și", "+": "plus"}
_ADDRESS = re.compile(rf"{EMAIL}|{URL}", re.I)
_ACRONYM = re.compile(r"\b[A-ZĂÂÎȘȚ]{2,6}\b")


def read_out(text: str, acronyms: dict[str, str] | None = None) -> str:
    """Addresses with their signs in words, and listed acronyms in full; a mark that ends an address stays."""

    def address(m: re.Match) -> str:
        body = m[0].rstrip(".!?…,;:")
        words = re.sub(r"[@./\-_:?=&+]+", lambda s: "".join(f" {SIGNS[c]} " for c in s[0]), re.sub(r"(?i)^https?://", "", body))
        return " ".join(words.split()) + m[0][len(body) :]

    text = _ADDRESS.sub(address, text)
    return _ACRONYM.sub(lambda m: (acronyms or {}).get(m[0], m[0]), text)


def expand_addresses(col: Column, acronyms: dict[str, str] | None = None) -> Column:
    """``read_out`` for a column; only texts that hold an address or capitals leave the JVM."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: read_out(t, acronyms), na_action="ignore")

    return F.coalesce(run(F.when(col.rlike(r"@|://|(?i)www\.|\p{Lu}{2}"), col)), col)
