"""Problem 2: duplicates hidden by formatting differences.

Method: recursive radix partitioning on canonical bytes. Records are counted by their leading bytes;
buckets over the capacity are split by further bytes until each fits (or holds one value only); each
bucket is then counted in a trie with terminal counters.

* Canonical bytes: the text in consistent form without whitespace, punctuation and letter case; for
  JSON records all fields, nested ones too, whatever their order (the order in arrays counts).
* Every input partition first counts its own copies, so a value that a third of all rows share
  becomes one row per partition before the shuffle. It never gathers in one task.
* The directory of oversized buckets holds at most rows / capacity prefixes a level; it is joined, and
  broadcast only where Spark measures it small.
* Members find their class by a 128-bit digest of the canonical bytes; the adaptive join splits hot ones.

Edge cases: null, empty and letterless texts and payloads that are no JSON object are no copies;
repeated deliveries of a key count once; ties go to the smallest key; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut, shuffle_width
from .textform import copy_key

#: Distinct rows a bucket may hold before it is split.
CAPACITY = 20_000
#: Bytes of the first level (JSON records agree in the first seven); every further level doubles them.
FIRST_BYTES = 16
#: Distinct values, and their bytes, that a task counts before it passes its counts on.
FLUSH, FLUSH_BYTES = 50_000, 1 << 25
STRIDE = 16
#: Values with copies that are passed on together.
ROWS = 10_000


def _refuse(x: str) -> float:
    raise ValueError(x)


def _canonical(x: object) -> str:
    """Canonical text of a JSON value; \\x1e and \\x1f never occur in copy keys."""
    if isinstance(x, dict):
        return "{" + "\x1e".join(f"{k}\x1f{_canonical(x[k])}" for k in sorted(x, key=lambda k: (k != "text", k))) + "}"
    if isinstance(x, list):
        return "[" + "\x1e".join(map(_canonical, x)) + "]"
    if isinstance(x, str):
        return '"' + (copy_key(x) or "")
    if isinstance(x, bool) or x is None:
        return json.dumps(x)
    return repr(float(x)) if isinstance(x, float) or abs(x) < 1 << 53 else repr(x)


def record_key(payload: str | None) -> str | None:
    """Canonical text of a JSON object; null if it is none, or holds no letter or digit in its text."""
    try:
        x = json.loads(payload, parse_constant=_refuse) if payload else None
        if not isinstance(x, dict) or ("text" in x and isinstance(x["text"], str) and copy_key(x["text"]) is None):
            return None
        return _canonical(x) if x else None
    except (ValueError, RecursionError, OverflowError):
        return None


@F.pandas_udf(T.StringType())
def _copy_key(s: pd.Series) -> pd.Series:
    return s.map(copy_key, na_action="ignore")


@F.pandas_udf(T.StringType())
def _record_key(s: pd.Series) -> pd.Series:
    return s.map(record_key, na_action="ignore")


def canonical_records(df: DataFrame, key: str, value: str, tbl: str, json_object: bool = False) -> DataFrame:
    """``tbl, rec_key, canon`` (bytes) of each record that can have copies."""
    udf = _record_key if json_object else _copy_key
    return (
        df.select(F.lit(tbl).alias("tbl"), F.col(key).cast("string").alias("rec_key"), udf(F.col(value)).alias("canon"))
        .where("canon IS NOT NULL AND rec_key IS NOT NULL")
        .withColumn("canon", F.encode("canon", "UTF-8"))
    )


_COUNTED = "tbl string, canon binary, first_key string, n long"


def _count_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of equal canonical bytes within a partition, passed on whenever FLUSH values or FLUSH_BYTES are held."""
    held: dict[tuple, list] = {}
    size = 0

    def out() -> pd.DataFrame:
        rows = [(t, c, *v) for (t, c), v in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["tbl", "canon", "first_key", "n"])

    for b in batches:
        for t, k, c in zip(b["tbl"], b["rec_key"], b["canon"]):
            v = held.get((t, c))
            if v is None:
                held[t, c] = [k, 1]
                size += len(c)
            else:
                v[0], v[1] = min(v[0], k), v[1] + 1
            if len(held) >= FLUSH or size >= FLUSH_BYTES:
                size = 0
                yield out()
    yield out()


class Trie:
    """Trie over byte strings in strides, with a counter and the smallest key at each terminal."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, value: bytes, key: str, n: int) -> None:
        node = self.root
        for i in range(0, len(value) - len(value) % STRIDE, STRIDE):
            node = node.setdefault(value[i : i + STRIDE], {})
        end = value[len(value) - len(value) % STRIDE :]
        held = node.get((end,))
        if held is None:
            node[end,] = [key, n]
        else:
            held[0], held[1] = min(held[0], key), held[1] + n

    def terminals(self) -> Iterator[tuple[bytes, str, int]]:
        stack = [(b"", self.root)]
        while stack:
            at, node = stack.pop()
            for step, x in node.items():
                if isinstance(step, tuple):
                    yield at + step[0], x[0], x[1]
                else:
                    stack.append((at + step, x))


def _count_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Values with at least two copies; rows come sorted by bucket, so one trie is held at a time."""
    at, trie, rows = None, Trie(), []

    def frame() -> pd.DataFrame:
        full = pd.DataFrame(rows, columns=["tbl", "canon", "first_key", "n"])
        rows.clear()
        return full

    for b in batches:
        for t, p, c, k, n in zip(b["tbl"], b["bucket"], b["canon"], b["first_key"], b["n"]):
            if at != (t, p):
                if at is not None:
                    rows += [(at[0], *x) for x in trie.terminals() if x[2] > 1]
                    if len(rows) >= ROWS:
                        yield frame()
                at, trie = (t, p), Trie()
            trie.add(c, k, n)
    if at is not None:
        rows += [(at[0], *x) for x in trie.terminals() if x[2] > 1]
    yield frame()


def radix_buckets(counted: DataFrame, capacity: int = CAPACITY, first: int = FIRST_BYTES) -> DataFrame:
    """``counted`` with the radix ``bucket`` of each row: its leading bytes, more of them where needed."""
    open_, done, width = counted.withColumn("bucket", F.expr(f"substring(canon, 1, {first})")), None, first
    while True:
        sizes = open_.groupBy("tbl", "bucket").agg(F.count("*").alias("held"), F.max(F.length("canon")).alias("longest"))
        big = cut(sizes.where((F.col("held") > capacity) & (F.length("bucket") == width) & (F.col("longest") > width)).select("tbl", "bucket"), "oversized")
        if big.isEmpty():
            return open_ if done is None else done.unionByName(open_)
        fits = open_.join(big, ["tbl", "bucket"], "left_anti")
        done = fits if done is None else done.unionByName(fits)
        width *= 2
        # Only rows of oversized buckets go on to the next level.
        open_ = cut(open_.join(big, ["tbl", "bucket"], "left_semi").withColumn("bucket", F.expr(f"substring(canon, 1, {width})")), "split")


def copy_classes(records: DataFrame, capacity: int = CAPACITY, first: int = FIRST_BYTES) -> DataFrame:
    """``tbl, canon, first_key, n``: each value that two or more records share, with their number.

    ``records`` has ``tbl, rec_key, canon`` and holds each record once.
    """
    counted = cut(records.select("tbl", "rec_key", "canon").mapInPandas(_count_partition, _COUNTED), "counted")
    parts = shuffle_width(records.sparkSession)
    return (
        radix_buckets(counted, capacity, first)
        .repartition(parts, "tbl", "bucket")
        .sortWithinPartitions("tbl", "bucket")
        .select("tbl", "bucket", "canon", "first_key", "n")
        .mapInPandas(_count_buckets, _COUNTED)
    )


def collapse(records: DataFrame, capacity: int = CAPACITY, first: int = FIRST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Classes of copies ``tbl, key_a, n`` and their other members ``tbl, key_a, key_b``.

    ``records``: ``tbl, rec_key, canon``; repeated deliveries of a key with equal content count once, with unequal
    content each belongs to the class of its own.
    """
    digest = F.unhex(F.md5("canon")).alias("digest")
    known = cut(records.select("tbl", "rec_key", "canon").distinct().select("tbl", "rec_key", "canon", digest), "canon")
    classes = cut(copy_classes(known, capacity, first).select("tbl", digest, F.col("first_key").alias("key_a"), "n"), "classes")
    members = (
        known.select("tbl", "rec_key", "digest")
        .join(classes, ["tbl", "digest"])
        .where(F.col("rec_key") != F.col("key_a"))
        .select("tbl", "key_a", F.col("rec_key").alias("key_b"))
    )
    return classes.select("tbl", "key_a", "n"), members
