"""Problem 8: evaluation texts leaking into training text.

Method: a broadcast hash set of the held-out items' normalised word n-grams; corpus windows are looked
up in it, hits are verified word by word, and the spans or documents can be removed.

* A document is only scanned, never shuffled: the leak of ``RUN`` successive words holds a whole
  window of ``RUN // 2`` words that starts at a multiple of it, so every such window is looked up and
  a hit is extended in both directions. Nothing is missed and most positions are never hashed.
* The set is broadcast only while the items have at most ``HELD_CHARS`` characters in all, which is counted first. A
  larger set stays distributed: its windows meet those of the documents in one join on their hash, and the pairs
  of document and item that meet are verified with their texts. Either way the corpus is scanned once.

Edge cases: null and empty texts hold nothing; items shorter than ``RUN`` words cannot leak; repeated
items and documents give the same rows once; empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textform import consistent, word_spans, words_of

#: Successive words that make a leak.
RUN = 14
#: Characters of held-out text that are broadcast at most (an index of a few tens of MB).
HELD_CHARS = 2_500_000

_SPAN = "{key} {kind}, item_id long, doc_from int, doc_to int, item_from int, item_to int, item_words int"


class ItemIndex:
    """Held-out items by their windows of ``run // 2`` words."""

    def __init__(self, run: int = RUN) -> None:
        self.run, self.step = run, max(1, run // 2)
        self.items: list[tuple[int, list[str]]] = []
        self.at: dict[str, list[tuple[int, int]]] = defaultdict(list)

    def add(self, item_id: int, words: list[str]) -> None:
        if len(words) < self.run:
            return
        self.items.append((item_id, words))
        for i in range(len(words) - self.step + 1):
            self.at[" ".join(words[i : i + self.step])].append((len(self.items) - 1, i))

    def spans(self, words: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """``item_id, doc_from, doc_to, item_from, item_to, item_words`` of each leak, as word positions."""
        found = set()
        n, step = len(words), self.step
        if n < self.run:
            return []
        for i in range(0, n - step + 1, step):
            for k, j in self.at.get(" ".join(words[i : i + step]), ()):
                item_id, other = self.items[k]
                a, b = i, j
                while a and b and words[a - 1] == other[b - 1]:
                    a, b = a - 1, b - 1
                c, d = i + step, j + step
                while c < n and d < len(other) and words[c] == other[d]:
                    c, d = c + 1, d + 1
                if c - a >= self.run:
                    found.add((item_id, a, c, b, d, len(other)))
        return sorted(found)


_SPANS = ["doc_id", "item_id", "doc_from", "doc_to", "item_from", "item_to", "item_words"]


def leaked_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = RUN, held_chars: int = HELD_CHARS) -> DataFrame:
    """Every maximal run of at least ``run`` words that a document shares with an item."""
    kind = _SPAN.format(key="doc_id", kind=docs.schema[doc_id].dataType.simpleString())
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    held = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item_text")).where("item_id IS NOT NULL AND item_text IS NOT NULL").distinct()
    if (held.agg(F.sum(F.length("item_text") + 1)).first()[0] or 0) > held_chars:
        return _joined_spans(slim, held, run, kind)
    index = ItemIndex(run)
    for row in held.orderBy("item_id", "item_text").collect():  # at most HELD_CHARS characters
        index.add(row["item_id"], words_of(row["item_text"]))
    shared = docs.sparkSession.sparkContext.broadcast((index.items, dict(index.at)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = ItemIndex(run)
        own.items, own.at = shared.value
        for b in batches:
            rows = [(d, *s) for d, t in zip(b["doc_id"], b["text"]) for s in own.spans(words_of(t))]
            yield pd.DataFrame(rows, columns=_SPANS)

    return slim.mapInPandas(scan, kind)


def _joined_spans(slim: DataFrame, held: DataFrame, run: int, kind: str) -> DataFrame:
    """Leaked spans where the windows of the items are too many to be broadcast."""
    step = ItemIndex(run).step

    def windows(key: str, text: str, every: int):  # noqa: ANN202
        def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for k, t in zip(b[key], b[text]):
                    ws = words_of(t)
                    if len(ws) >= run:
                        rows += {(k, xxhash.xxh64_intdigest(" ".join(ws[i : i + step])) - (1 << 63)) for i in range(0, len(ws) - step + 1, every)}
                yield pd.DataFrame(rows, columns=[key, "window"])

        return cut_up

    doc = kind.split(", ")[0]
    mine = slim.mapInPandas(windows("doc_id", "text", step), f"{doc}, window long")
    theirs = held.mapInPandas(windows("item_id", "item_text", 1), "item_id long, window long")
    met = mine.join(theirs, "window").select("doc_id", "item_id").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = set()
            for d, t, i, x in zip(b["doc_id"], b["text"], b["item_id"], b["item_text"]):
                index = ItemIndex(run)
                index.add(i, words_of(x))
                rows |= {(d, *s) for s in index.spans(words_of(t))}
            yield pd.DataFrame(list(rows), columns=_SPANS)

    return met.join(slim, "doc_id").join(held, "item_id").mapInPandas(verify, kind)


def leak_report(spans: DataFrame) -> DataFrame:
    """``item_id, documents, most_words, most_share``: how far each leaked item stands in the corpus."""
    per = spans.groupBy("item_id", "doc_id").agg(F.max(F.col("item_to") - F.col("item_from")).alias("words"), F.max("item_words").alias("item_words"))
    return per.groupBy("item_id").agg(
        F.count("*").alias("documents"), F.max("words").alias("most_words"), F.round(F.max(F.col("words") / F.col("item_words")), 3).alias("most_share")
    )


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """Consistent form of a text without the words from ``a`` to before ``b`` of each span."""
    at, text = word_spans(text), consistent(text)
    out, last = [], 0
    for a, b in sorted(spans):
        start, end = at[a][0], at[b - 1][1]
        if start > last:
            out.append(text[last:start])
        last = max(last, end)
    out.append(text[last:])
    return "".join(out).strip()


def remove_leaks(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text", most_share: float = 0.5) -> DataFrame:
    """Documents concerned, cleaned: ``doc_id, removed_words, text``.

    The leaked words are cut out; if they are more than ``most_share`` of a document, its text is null.
    Of deliveries of a document with unequal texts the least text is cleaned. Spans of a document come together by its id: they are at most as many as its words.
    """
    merged = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("doc_from", "doc_to"))).alias("spans"))

    @F.pandas_udf("struct<removed_words:int, text:string>")
    def cut_out(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(texts, found):
            n = len(words_of(t))
            pairs = [(x["doc_from"], x["doc_to"]) for x in s if x["doc_to"] <= n]
            gone = len({i for a, b in pairs for i in range(a, b)})
            rows.append((gone, None if gone > most_share * max(1, n) else without_spans(t, pairs)))
        return pd.DataFrame(rows, columns=["removed_words", "text"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text"))
    return slim.join(merged, "doc_id").select("doc_id", cut_out("text", "spans").alias("x")).select("doc_id", "x.removed_words", "x.text")
