"""Problem 1: same or near-same records across splits.

Method: a suffix array over the concatenated texts, partitioned by its leading words. Suffixes of both splits
stand in it together, sorted; neighbours that share two words or more form an interval, and the cross-split
neighbours within one are candidates. The spans two candidates share are merged into coverage, coverage selects
the pairs, and an exact comparison of word order confirms them.

* Records with equal words form one class before anything is compared, so copies never pair up here.
* The array is sparse: of each record it holds the suffixes at its rarest word pairs. How many follows from the
  edits a case may have, whatever their places (see ``kept``), so no case is lost and no partner is capped.
* Rarity comes from the counts of word pairs over all records, hashed into a table of fixed size: that table is
  all that reaches the driver, and any order of rarity gives the same result.
* Within an interval partners are sought by length and place, then by a 128-bit word signature that no case can
  fail. An interval that more than ``HOT`` suffixes could share is split into a grid of cells, each of which
  meets a part of the held-out and a part of the training suffixes: no task grows with a hot phrase.

Edge cases: null texts and texts without words are no cases; a repeated delivery counts once; equal
texts in both splits are a case; a null id or split is left out; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut, shuffle_width
from .textform import words_of

#: Share of the longer text's words that must stand in the other in the same order.
SHARE = 0.8
#: Slots of the table of word pair counts (a power of two), suffixes an interval may hold before it is split, and
#: candidate pairs looked at together.
SLOTS, HOT, LOOK = 1 << 17, 200_000, 1 << 20


def needed(n: int, m: int = 0, share: float = SHARE) -> int:
    """Words two texts of n and m words must share in order."""
    return math.ceil(share * max(n, m) - 1e-9)


def common_in_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & at.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@F.pandas_udf(T.StringType())
def _word_key(s: pd.Series) -> pd.Series:
    return s.map(lambda t: " ".join(words_of(t)) or None, na_action="ignore")


def covered(a: list[str], b: list[str]) -> int:
    """Words of a under the runs of two words or more that also stand in b, merged."""
    held = set(zip(b, b[1:]))
    n, last = 0, -1
    for i, pair in enumerate(zip(a, a[1:])):
        if pair in held:
            n += 1 if last == i else 2
            last = i + 1
    return n


def shared_pairs(n: int, m: int, share: float = SHARE) -> int:
    """Word pairs that two texts of n and m words share at least, side by side in both, if they are a case.

    Of the c words in order c - 1 follow one another; every word that one text has beyond them parts at most two.
    """
    c = needed(n, m, share)
    return max(1, c - 1 - (n - c) - (m - c))


@F.pandas_udf(T.StructType([T.StructField("covered", T.IntegerType()), T.StructField("common", T.IntegerType())]))
def _compared(a: pd.Series, b: pd.Series, share: pd.Series) -> pd.DataFrame:
    """Coverage of a by b, and their words in order where the coverage suffices for a case, else 0."""
    rows = []
    for x, y, s in zip(a, b, share):
        x, y = x.split(" "), y.split(" ")
        on = covered(x, y)
        rows.append((on, common_in_order(x, y) if on > shared_pairs(len(x), len(y), s) else 0))
    return pd.DataFrame(rows, columns=["covered", "common"]).astype("int32")


@lru_cache(maxsize=1 << 14)
def kept(n: int, share: float = SHARE) -> int:
    """How many of the rarest of a text's n - 1 word pairs must be looked at, for partners of any length.

    A case shares at least ``shared_pairs`` of them. If the rarest of the shared ones were not among the kept, all
    of them would be left out, and fewer than that many are.
    """
    least = min(shared_pairs(n, m, share) for m in range(max(1, math.ceil(share * n - 1e-9)), math.floor(n / share + 1e-9) + 1))
    return max(0, min(n - 1, n - least))


class _Words:
    """Hashes of words as 64-bit numbers, kept for words that come again."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def hashes(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of the keys in a row, and the number of words of each key."""
        words = " ".join(keys).split(" ") if keys else []
        if len(self.known) > 500_000:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh64_intdigest(w)
        return np.array(list(map(self.known.__getitem__, words)), dtype=np.uint64), np.array([k.count(" ") + 1 for k in keys], dtype=np.int64)


def _pairs(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of the word pair at each place, the text of the place, and whether a pair begins there."""
    high = h >> np.uint64(32)
    text = np.repeat(np.arange(len(size)), size)
    code = (high << np.uint64(32)) | np.append(high[1:], np.uint64(0))
    return code, text, np.append(text[1:] == text[:-1], False)


def _slot(code: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)


def pair_rarity(classes: DataFrame) -> Broadcast:
    """Broadcast counts of the word pairs of all classes, in a table of SLOTS numbers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, total = _Words(), np.zeros(SLOTS, dtype=np.int64)
        for b in batches:
            code, _, on = _pairs(*own.hashes(b["key"].tolist()))
            total += np.bincount(_slot(code[on]), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"slot": at, "n": total[at]})

    table = np.zeros(SLOTS, dtype=np.int64)
    for slot, n in classes.select("key").mapInPandas(count, "slot int, n long").groupBy("slot").agg(F.sum("n")).collect():  # at most SLOTS rows
        table[slot] = n
    return classes.sparkSession.sparkContext.broadcast(table)


_ENTRY = "pair long, cell int, rest long, num long, place long, train boolean, s0 long, s1 long"


def suffix_array(classes: DataFrame, counts: Broadcast, share: float = SHARE, hot: int = HOT) -> DataFrame:
    """The sparse suffix array over ``num, key, held_out, train``, partitioned by its leading word pair and sorted.

    A suffix is held by the codes of its first four words, ``pair`` and ``rest``; ``place`` packs the length of the
    text and the position.
    """

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, table = _Words(), counts.value
        for b in batches:
            h, size = own.hashes(b["key"].tolist())
            code, text, on = _pairs(h, size)
            bit = np.uint64(1) << ((h >> np.uint64(8)) & np.uint64(63))
            side = (h >> np.uint64(14)) & np.uint64(1)
            first = np.cumsum(size) - size
            s0, s1 = (np.bitwise_or.reduceat(np.where(side == np.uint64(k), bit, np.uint64(0)), first) for k in (0, 1))
            later = [np.append(text[k:], [-1] * k)[: len(text)] == text for k in (2, 3)]  # whether the text goes on so far
            rest = np.append(code[2:], [np.uint64(0)] * 2)[: len(text)] & np.where(later[0], np.where(later[1], ~np.uint64(0), np.uint64(0xFFFFFFFF00000000)), np.uint64(0))
            at = np.flatnonzero(on)
            seen = table[_slot(code[at])]
            order = np.lexsort((code[at], seen, text[at]))
            at, seen = at[order], seen[order]
            t = text[at]
            most = np.array([kept(int(n), share) for n in size])
            start = np.searchsorted(t, np.arange(len(size)))
            rank = np.arange(len(at)) - start[t]
            # Every occurrence of the last pair that is kept, so that the places that match are among them.
            edge = code[at[np.minimum(start + np.maximum(most, 1) - 1, max(len(at) - 1, 0))]] if len(at) else np.zeros(len(size), np.uint64)
            take = (most[t] > 0) & ((rank < most[t]) | (code[at] == edge[t]))
            at, seen, t = at[take], seen[take], t[take]
            grid = np.ceil(np.sqrt(np.maximum(seen, 1) / hot)).astype(np.int64)
            num = b["num"].to_numpy(np.int64)
            for train in (False, True):
                mine = b["train" if train else "held_out"].to_numpy(bool)[t]
                i = np.repeat(np.flatnonzero(mine), grid[mine])
                g, k = grid[i], np.arange(len(i)) - np.repeat(np.cumsum(grid[mine]) - grid[mine], grid[mine])
                salt = num[t[i]] % g
                cell = salt + g * k if train else k + g * salt
                for lo in range(0, len(i), 200_000):
                    j, x = i[lo : lo + 200_000], t[i[lo : lo + 200_000]]
                    yield pd.DataFrame({
                        "pair": code[at[j]].view(np.int64), "cell": cell[lo : lo + 200_000], "rest": rest[at[j]].view(np.int64), "num": num[x],
                        "place": size[x] << 32 | (at[j] - first[x]), "train": train, "s0": s0[x].view(np.int64), "s1": s1[x].view(np.int64),
                    })

    return (
        classes.select("num", "key", "held_out", "train").mapInPandas(entries, _ENTRY)
        .repartition(shuffle_width(classes.sparkSession), "pair", "cell")
        .sortWithinPartitions("pair", "cell", "rest")
    )


def _meetings(e: dict[str, np.ndarray], share: float) -> Iterator[pd.DataFrame]:
    """Cross-split neighbours ``a, b`` in the whole intervals ``e``, as long as they can be a case."""
    new = (e["pair"][1:] != e["pair"][:-1]) | (e["cell"][1:] != e["cell"][:-1])
    block = np.concatenate([[0], np.cumsum(new)]).astype(np.int64)
    n, at = e["place"] >> 32, e["place"] & 0xFFFFFFFF
    held, train = np.flatnonzero(~e["train"]), np.flatnonzero(e["train"])
    train = train[np.lexsort((n[train], block[train]))]
    key = (block[train] << 32) | n[train]
    low = np.searchsorted(key, (block[held] << 32) | np.ceil(share * n[held] - 1e-9).astype(np.int64))
    many = np.searchsorted(key, (block[held] << 32) | np.floor(n[held] / share + 1e-9).astype(np.int64), "right") - low
    held, low, many = held[many > 0], low[many > 0], many[many > 0]
    ends = np.cumsum(many)
    for first in range(0, int(ends[-1]) if len(ends) else 0, LOOK):
        k = np.arange(first, min(first + LOOK, ends[-1]))  # meetings numbered through, whatever row they belong to
        row = np.searchsorted(ends, k, "right")
        a, b = held[row], train[low[row] + k - (ends[row] - many[row])]
        least = np.ceil(share * np.maximum(n[a], n[b]) - 1e-9).astype(np.int64)
        fits = (np.minimum(at[a], at[b]) + np.minimum(n[a] - at[a], n[b] - at[b]) >= least) & (e["num"][a] != e["num"][b])
        a, b, least = a[fits], b[fits], least[fits]
        differ = sum(np.bitwise_count((e[s][a] ^ e[s][b]).view(np.uint64)).astype(np.int64) for s in ("s0", "s1"))
        fits = differ <= n[a] + n[b] - 2 * least
        if fits.any():
            yield pd.DataFrame({"a": e["num"][a[fits]], "b": e["num"][b[fits]]}).drop_duplicates()


def cross_neighbours(array: DataFrame, share: float = SHARE) -> DataFrame:
    """``a, b``: class pairs that meet in an interval of the array; a is held out, b in training."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("pair", "cell", "place", "num", "train", "s0", "s1")
        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            e = {k: batch[k].to_numpy() for k in names}
            if not len(e["pair"]):
                continue
            held.append(e)
            if (e["pair"][0], e["cell"][0]) == (e["pair"][-1], e["cell"][-1]) and len(held) > 1 and (held[0]["pair"][-1], held[0]["cell"][-1]) == (e["pair"][0], e["cell"][0]):
                continue  # all of one interval: it goes on
            e = {k: np.concatenate([x[k] for x in held]) for k in names}
            last = np.flatnonzero((e["pair"] != e["pair"][-1]) | (e["cell"] != e["cell"][-1]))
            done = last[-1] + 1 if len(last) else 0  # the last interval may go on in the next batch
            held = [{k: v[done:] for k, v in e.items()}]
            if done:
                yield from _meetings({k: v[:done] for k, v in e.items()}, share)
        if held:
            yield from _meetings({k: np.concatenate([x[k] for x in held]) for k in names}, share)

    return array.mapInPandas(walk, "a long, b long").distinct()


class Overlaps:
    """Overlaps between held-out and training records, as class pairs with their members."""

    def __init__(self, members: DataFrame, classes: DataFrame, pairs: DataFrame) -> None:
        #: ``id, train, cid``; ``cid, key, held_out, train``; ``a, b, words, covered, common`` (words of a), where a may be b.
        self.members, self.classes, self.pairs = members, classes, pairs

    def id_pairs(self) -> DataFrame:
        """``held_id, train_id`` of every overlap between records."""
        m = self.members
        left = m.where("NOT train").select(F.col("id").alias("held_id"), F.col("cid").alias("a"))
        right = m.where("train").select(F.col("id").alias("train_id"), F.col("cid").alias("b"))
        return self.pairs.select("a", "b").join(left, "a").join(right, "b").select("held_id", "train_id")


def cross_split_overlaps(df: DataFrame, id_col: str = "id", text_col: str = "text", split_col: str = "split", train: str = "train", share: float = SHARE) -> Overlaps:
    """All overlaps between records of the training split and of any other split.

    Two records overlap if ``share`` of the words of the longer text also stand in the other in the
    same order, both in consistent form, without case and diacritics.
    """
    side = F.lower(F.trim(F.col(split_col)))
    keyed = (
        df.select(F.col(id_col).cast("string").alias("id"), (side == train).alias("train"), _word_key(F.col(text_col)).alias("key"))
        .where("id IS NOT NULL AND train IS NOT NULL AND key IS NOT NULL")
        .withColumn("cid", F.unhex(F.md5("key")))
    )
    records = cut(keyed, "records")
    members = records.select("id", "train", "cid").distinct()
    classes = records.groupBy("cid").agg(F.first("key").alias("key"), (~F.bool_and("train")).alias("held_out"), F.bool_or("train").alias("train"))
    classes = cut(classes.withColumn("num", F.monotonically_increasing_id()), "texts")
    met = cross_neighbours(suffix_array(classes, pair_rarity(classes), share), share)
    text = classes.select("num", "cid", "key")
    checked = (
        met.join(text.select(F.col("num").alias("a"), F.col("cid").alias("cid_a"), F.col("key").alias("key_a")), "a")
        .join(text.select(F.col("num").alias("b"), F.col("cid").alias("cid_b"), F.col("key").alias("key_b")), "b")
        .withColumn("x", _compared("key_a", "key_b", F.lit(share)))
    )
    words = F.size(F.split("key_a", " "))
    longest = F.greatest(words, F.size(F.split("key_b", " ")))
    near = checked.where(F.col("x.common") >= F.ceil(F.lit(share) * longest - 1e-9)).select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"), words.alias("words"), "x.covered", "x.common")
    same = classes.where("held_out AND train").select(
        F.col("cid").alias("a"), F.col("cid").alias("b"), *[F.size(F.split("key", " ")).alias(k) for k in ("words", "covered", "common")]
    )
    return Overlaps(members, classes, cut(near.unionByName(same), "pairs"))
