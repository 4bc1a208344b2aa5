"""Problem 7: filling fixed-capacity containers with items.

Method: linear grouping. Large lengths are rounded up within groups of equal cardinality; over these few sizes the
best mix of configurations is found by linear programming (column generation, with a knapsack for the next
configuration); it is rounded down, actual documents are put in for the planned sizes, the last place of a container
going to the largest document that still fits, what is left over is planned one container at a time, and small
documents go best-fit into the gaps.

* Token counts are made once and kept; texts are never shuffled. Documents are spread over shards of
  about ``SHARD`` items by hash, and each shard and capacity is packed by itself: a shard holds
  thousands of items, so little is lost at its edge, and no task grows with the corpus.
* A document longer than the capacity is cut into full containers and one rest; nothing else is split.

Edge cases: null texts count as empty; empty texts are items of no tokens and go with others; repeated
documents are packed once each row id; capacities that are null or below one are left out.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: Where the public tokenizer's ranks lie; a parameter everywhere below.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Items of a shard, groups of equal cardinality, and the part of a capacity from which a length is large.
SHARD, GROUPS, LARGE = 8192, 40, 0.1
#: Units of a capacity in which the linear program measures sizes, its steps at most, and groups of the rest.
UNITS, STEPS, FINE = 512, 400, 600


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a ranks file, once in each worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """``doc_id, tokens`` of each document."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(ranks)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]})

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    return slim.mapInPandas(count, f"doc_id {kind}, tokens int")


def best_configurations(sizes: np.ndarray, counts: np.ndarray, units: int) -> list[tuple[np.ndarray, float]]:
    """The cheapest mix of configurations that covers ``counts`` items of the ``sizes``: how many of each size, how often.

    The program's columns are generated: under the prices of the present basis the most valuable configuration is
    found by a knapsack, built up one item at a time, and enters the basis if it is worth more than a container.
    """
    base = np.diag((units // sizes).astype(float))
    at = np.arange(units + 1)[None, :] - sizes[:, None]
    at[at < 0] = units + 1  # no room
    used = counts.astype(float)
    for _ in range(STEPS):
        inverse = np.linalg.inv(base)
        used, prices = inverse @ counts, inverse.sum(0)
        best, layers = np.append(np.zeros(units + 1), -np.inf), []
        for _ in range(units // int(sizes.min())):
            tried = best[at] + prices[:, None]
            last = tried.argmax(0)
            value = tried[last, np.arange(units + 1)]
            more = value > best[:-1] + 1e-12
            if not more.any():
                break
            layers.append((last, more))
            best = np.append(np.where(more, value, best[:-1]), -np.inf)
        room = int(best[:-1].argmax())
        if best[room] <= 1 + 1e-6:
            break
        column = np.zeros(len(sizes))
        for last, more in layers[::-1]:
            if more[room]:
                column[last[room]] += 1
                room -= sizes[last[room]]
        change = inverse @ column
        ratio = np.where(change > 1e-9, used / np.maximum(change, 1e-9), np.inf)
        base[:, int(ratio.argmin())] = column
    return list(zip(base.T.astype(int), np.maximum(used, 0.0)))


def plan_groups(sizes: list[int], capacity: int, groups: int = GROUPS) -> tuple[list[list[int]], list[int]]:
    """Containers for large items by the best configurations over few sizes, and the items left over.

    Items are positions in ``sizes``, which are in descending order.
    """
    if not sizes:
        return [], []
    units, step = min(capacity, UNITS), max(1, -(-len(sizes) // groups))
    by: dict[int, list[int]] = {}
    for i in range(0, len(sizes), step):  # a group is as large as its largest item, in whole units
        by.setdefault(-(-sizes[i] * units // capacity), []).extend(range(i, min(i + step, len(sizes))))
    rounded = sorted(by, reverse=True)
    stock = [[(sizes[i], i) for i in by[s]][::-1] for s in rounded]  # ascending
    mix = best_configurations(np.array(rounded), np.array([len(x) for x in stock], dtype=float), units)

    def largest(gap: int) -> tuple[int, int] | None:
        for x in stock:
            if x and x[0][0] <= gap:
                return x.pop(bisect.bisect_right(x, (gap, len(sizes))) - 1)
        return None

    out: list[list[int]] = []
    for column, times in sorted(mix, key=lambda m: int(np.flatnonzero(m[0])[0])):  # those with the largest sizes first
        places = [int(k) for k in np.flatnonzero(column) for _ in range(column[k])]
        for _ in range(int(times + 1e-9)):
            if any(len(stock[k]) < column[k] for k in set(places)):
                break
            box = [stock[k].pop() for k in places[:-1]]
            gap = capacity - sum(size for size, _ in box)
            while (one := largest(gap)) is not None:
                gap -= one[0]
                box.append(one)
            out.append([i for _, i in box])
    return out, sorted(i for x in stock for _, i in x)


def plan_large(sizes: list[int], capacity: int, groups: int = FINE) -> list[list[int]]:
    """Containers for the items left over, one configuration at a time: the largest, with the best filling of the rest.

    Items are positions in ``sizes``, which are in descending order.
    """
    if not sizes:
        return []
    step = max(1, -(-len(sizes) // groups))
    members = [list(range(i, min(i + step, len(sizes)))) for i in range(0, len(sizes), step)]
    rounded = [sizes[m[0]] for m in members]  # up to the largest of its group
    merged: dict[int, list[int]] = {}
    for s, m in zip(rounded, members):
        merged.setdefault(s, []).extend(m)
    rounded = sorted(merged, reverse=True)
    left = [merged[s][::-1] for s in rounded]  # largest last, taken first
    full = (1 << (capacity + 1)) - 1
    out: list[list[int]] = []
    while True:
        g = next((k for k, m in enumerate(left) if m), None)
        if g is None:
            return out
        # The largest size that is left, with the best filling of the rest: sums as bits of a number.
        parts, reach = [], [1 << rounded[g]]
        for k in range(g, len(rounded)):
            n = min(len(left[k]) - (k == g), (capacity - rounded[g]) // rounded[k])
            m = 1
            while n > 0:
                use = min(m, n)
                parts.append((k, use))
                reach.append((reach[-1] | reach[-1] << use * rounded[k]) & full)
                n, m = n - use, m * 2
        total = reach[-1].bit_length() - 1
        config = {g: 1}
        for (k, use), before in zip(parts[::-1], reach[-2::-1]):
            if not before >> total & 1:
                config[k] = config.get(k, 0) + use
                total -= use * rounded[k]
        for _ in range(min(len(left[k]) // use for k, use in config.items())):
            out.append([left[k].pop() for k, use in config.items() for _ in range(use)])


def pack(sizes: list[int], capacity: int, groups: int = GROUPS, large: float = LARGE) -> list[int]:
    """Container number of each item; every size is at most the capacity."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    big = [i for i in order if sizes[i] > large * capacity]
    home = [0] * len(sizes)
    gaps: list[tuple[int, int]] = []
    n = 0
    planned, over = plan_groups([sizes[i] for i in big], capacity, groups)
    rest = plan_large([sizes[big[k]] for k in over], capacity)
    for box in planned + [[over[k] for k in b] for b in rest]:
        for k in box:
            home[big[k]] = n
        gaps.append((capacity - sum(sizes[big[k]] for k in box), n))
        n += 1
    gaps.sort()
    for i in order[len(big) :]:
        k = bisect.bisect_left(gaps, (sizes[i], -1))
        if k == len(gaps):
            gap, box, n = capacity, n, n + 1
        else:
            gap, box = gaps.pop(k)
        home[i] = box
        bisect.insort(gaps, (gap - sizes[i], box))
    return home


def fill_containers(counts: DataFrame, specs: DataFrame, shard_items: int = SHARD) -> DataFrame:
    """``spec_id, container, doc_id, token_from, token_to`` of each piece of each document.

    ``counts`` has ``doc_id, tokens``; ``specs`` has ``spec_id, capacity_tokens``. Container names are
    unique within a spec.
    """
    kind = counts.schema["doc_id"].dataType.simpleString()
    counts = cut(counts, "tokens")
    shards = max(1, -(-counts.count() // shard_items))
    kinds = specs.schema["spec_id"].dataType.simpleString()
    caps = specs.where("spec_id IS NOT NULL AND capacity_tokens >= 1").select("spec_id", "capacity_tokens").distinct()
    sets = caps.orderBy("spec_id", "capacity_tokens").collect()  # the table of capacities is small and fixed
    each = F.array(*[F.struct(F.lit(r["spec_id"]).alias("spec_id"), F.lit(r["capacity_tokens"]).alias("cap")) for r in sets]) if sets else F.array().cast(f"array<struct<spec_id:{kinds},cap:int>>")
    items = counts.select("doc_id", "tokens", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), F.explode(each).alias("x")).select("doc_id", "tokens", "shard", "x.spec_id", "x.cap")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        cap, shard = int(pdf["cap"].iloc[0]), int(pdf["shard"].iloc[0])
        pdf = pdf.sort_values("doc_id", kind="stable")
        rows, ids, starts, sizes = [], [], [], []
        n = 0
        for d, t in zip(pdf["doc_id"], pdf["tokens"]):
            whole = t // cap if t > cap else 0
            for k in range(whole):
                rows.append((f"{cap}-{shard}-f{n}", d, k * cap, (k + 1) * cap))
                n += 1
            if t - whole * cap or not whole:
                ids.append(d)
                starts.append(whole * cap)
                sizes.append(int(t - whole * cap))
        for d, a, s, box in zip(ids, starts, sizes, pack(sizes, cap)):
            rows.append((f"{cap}-{shard}-{box}", d, a, a + s))
        out = pd.DataFrame(rows, columns=["container", "doc_id", "token_from", "token_to"])
        out.insert(0, "spec_id", pdf["spec_id"].iloc[0])
        return out

    return items.groupBy("spec_id", "cap", "shard").applyInPandas(fill, f"spec_id {kinds}, container string, doc_id {kind}, token_from int, token_to int")


def fill_report(filled: DataFrame, specs: DataFrame) -> DataFrame:
    """``spec_id, containers, tokens, fill``: how full the containers of each capacity are."""
    per = filled.groupBy("spec_id", "container").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("t")).groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    return per.join(specs.select("spec_id", "capacity_tokens").distinct(), "spec_id").select(
        "spec_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 5).alias("fill")
    )
