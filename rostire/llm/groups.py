"""Problem 6: splits that keep related records together.

Method: frontier breadth-first components. Adjacency lists are hash-partitioned; many seeds expand at
once; labels that collide are merged in a small graph; groups are split in the order of a hash of
their component.

* Only the graph of names is searched. Records are first reduced to their keys (map-side combining),
  so an author with a third of all rows is one row before any join.
* Every hop is one join of the frontier with the adjacency lists and one table in the shared folder.
  A part of the nodes, picked by hash, are seeds; nodes that no seed reaches seed the next turn.
* The label graph is some times smaller than the graph. While it is larger than ``SMALL`` edges it is
  searched the same way; then one task unites it. Nothing of it reaches the driver.
* Cumulative sizes in hash order come from bucket totals and a window inside each bucket.

Edge cases: null names are no edge, a name linked to itself neither; keys without links are groups of
their own; null keys have no group, and each record without a key is split by itself; a record delivered under
several keys goes by the smallest; null ids name no record; empty tables give no rows; repeated edges change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut

#: One node in so many is a seed of the first turn.
SEEDS = 4
#: Edges of a label graph that one task unites.
SMALL = 100_000
#: Buckets of the hash order at least and at most, and groups of one bucket beyond the least.
BUCKETS, MOST_BUCKETS, PER_BUCKET = 1 << 10, 1 << 20, 50_000
#: Tables of labels that are read together before they are written as one.
TABLES = 6


def _unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of at most SMALL edges, each named by its smallest label."""
    up: dict[str, str] = {}

    def top(x: str) -> str:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for b in batches:
        for x, y in zip(b["a"], b["b"]):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    yield pd.DataFrame([(x, top(x)) for x in up], columns=["node", "label"])


def components(edges: DataFrame, seeds: int = SEEDS, small: int = SMALL, level: int = 0) -> DataFrame:
    """``node, label`` of every node of the undirected edges ``a, b``; equal labels mean one component.

    ``level`` salts the choice of seeds, so that the seeds of one level are not all seeds of the next.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    adj = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().repartition("a"), "adjacency")
    nodes = cut(adj.select(F.col("a").alias("node")).distinct(), "nodes")
    held: list[DataFrame] = []

    def add(new: DataFrame) -> None:
        """New labels stand in a table of their own; now and then all are written as one."""
        held.append(new)
        if len(held) >= TABLES:
            held[:] = [cut(reduce(DataFrame.unionByName, held), "labels")]

    def unlabelled(some: DataFrame) -> DataFrame:
        for t in held:
            some = some.join(t.select("node"), "node", "left_anti")
        return some

    part = seeds
    while True:
        frontier = cut(unlabelled(nodes).where(F.pmod(F.xxhash64("node", F.lit(level)), F.lit(part)) == 0).select("node", F.col("node").alias("label")), "frontier")
        add(frontier)
        grew = not frontier.isEmpty()
        while not frontier.isEmpty():
            met = frontier.join(adj, frontier["node"] == adj["a"]).select(F.col("b").alias("node"), "label").groupBy("node").agg(F.min("label").alias("label"))
            frontier = cut(unlabelled(met), "frontier")
            add(frontier)
        if part == 1:
            break
        if grew and unlabelled(nodes).isEmpty():
            break
        part = max(1, part // 2)
    labels = cut(reduce(DataFrame.unionByName, held), "labels")
    # Seeds that met: edges between nodes of different labels.
    la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("x")), labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
    met = cut(adj.where("a < b").join(la, "a").join(lb, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "collisions")
    many = met.count()
    if not many:
        return labels
    merged = met.repartition(1).mapInPandas(_unite, "node string, label string") if many <= small else components(met, seeds, small, level + 1)
    names = merged.select(F.col("node").alias("label"), F.col("label").alias("merged"))
    return labels.join(names, "label", "left").select("node", F.coalesce("merged", "label").alias("label"))


def grouped_keys(edges: DataFrame) -> DataFrame:
    """``key, group_key`` of every linked name; the group is named by its smallest key."""
    labels = cut(components(edges), "components")
    least = labels.groupBy("label").agg(F.min("node").alias("group_key"))
    return labels.join(least, "label").select(F.col("node").alias("key"), "group_key")


def tidy(c: Column) -> Column:
    """A name without outer spaces and letter case."""
    return F.lower(F.trim(c))


def key_splits(records: DataFrame) -> DataFrame:
    """``key, n, low, high``: records and outermost splits of each key of ``key, split, id``."""
    return records.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min("split").alias("low"), F.max("split").alias("high"))


def named_keys(keys: DataFrame, links: DataFrame) -> DataFrame:
    """``keys`` with the ``group_key`` of each ``key``."""
    return keys.join(grouped_keys(links), "key", "left").withColumn("group_key", F.coalesce("group_key", "key"))


def groups_of(keys: DataFrame, links: DataFrame) -> DataFrame:
    """``group_key, n, low, high`` of the groups that have records."""
    return named_keys(keys, links).groupBy("group_key").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def spread_groups(groups: DataFrame) -> DataFrame:
    """``group_key`` of groups whose records stand in two or more splits."""
    return groups.where("low <> high").select("group_key")


def assign_splits(groups: DataFrame, shares: dict[str, float], seed: int = 5) -> DataFrame:
    """``group_key, n, split``: every group to the split in which the middle of its records falls.

    Groups are laid end to end in the order of a hash; ``shares`` are cumulated in their order.
    """
    h = F.shiftrightunsigned(F.xxhash64("group_key", F.lit(seed)), 1)
    placed = cut(groups.select("group_key", "n", h.alias("h")), "placed")
    buckets, n = BUCKETS, placed.count()
    while buckets < MOST_BUCKETS and buckets * PER_BUCKET < n:
        buckets *= 2
    placed = placed.withColumn("bucket", F.shiftrightunsigned("h", 64 - buckets.bit_length()).cast("int"))
    totals = placed.groupBy("bucket").agg(F.sum("n").alias("t"))
    before = totals.select("bucket", (F.sum("t").over(Window.orderBy("bucket")) - F.col("t")).alias("before"), F.sum("t").over(Window.partitionBy(F.lit(1))).alias("whole"))
    inside = F.sum("n").over(Window.partitionBy("bucket").orderBy("h", "group_key").rowsBetween(Window.unboundedPreceding, 0))
    at = placed.withColumn("upto", inside).join(F.broadcast(before), "bucket")  # at most MOST_BUCKETS rows
    middle = (F.col("before") + F.col("upto") - F.col("n") / 2) / F.col("whole")
    total, edge, case = sum(shares.values()), 0.0, None
    for name, share in shares.items():
        edge += share / total
        case = F.when(middle <= edge, name) if case is None else case.when(middle <= edge, name)
    return at.select("group_key", "n", case.otherwise(list(shares)[-1]).alias("split"))


def assign_records(records: DataFrame, links: DataFrame, shares: dict[str, float], seed: int = 5) -> DataFrame:
    """``tbl, id, group_key, split``: a split for every record of ``tbl, id, key``, each ``id`` of a ``tbl`` once.

    A record without a key has no ``group_key`` and is placed, by the hash of its table and id, among the groups
    as one of its own, so that the shares are those of all records.
    """
    alone = F.concat("tbl", F.lit("\0"), F.col("id").cast("string"))
    own = cut(records.where("id IS NOT NULL").groupBy("tbl", "id").agg(F.min("key").alias("key")), "records")
    keyed = named_keys(own.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n")), links).select("key", "group_key", "n", F.lit(True).alias("grouped"))
    units = cut(keyed.unionByName(own.where("key IS NULL").select(alone.alias("key"), alone.alias("group_key"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("grouped"))), "units")
    splits = assign_splits(units.groupBy("group_key").agg(F.sum("n").alias("n")), shares, seed).select("group_key", "split")
    homes = units.join(splits, "group_key").select("key", F.when(F.col("grouped"), F.col("group_key")).alias("group_key"), "split")
    return own.select("tbl", "id", F.coalesce("key", alone).alias("key")).join(homes, "key").select("tbl", "id", "group_key", "split")
