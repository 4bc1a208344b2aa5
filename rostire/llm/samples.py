"""Problem 5: a sample that matches target category proportions.

Method: calibration by Newton iterations on the exponential-tilting dual, with category moments
aggregated distributedly; the resulting probabilities are drawn by the pivotal method; floors are
filled up after the draw and gaps reported.

* Records fall into membership patterns (which of a plan's categories they have). The counts of the
  patterns, aggregated with map-side combining, are sufficient for all moments; they stay distributed
  and are only brought to the driver while they are at most ``PATTERNS``.
* What a goal can reach at all is the limit of its moment as its multiplier grows (``ceilings``). A category whose
  ceiling is below its target or floor is unmet and taken whole; floors raise the targets of small ones. Where
  single goals can be reached but not together, the report says so (``conflict``) and gives what is expected.
* The pivotal method runs within hash partitions and passes one undecided record on from each; those
  few meet in a last task. Draws depend on ids and the seed only, so a lost task repeats itself.

Edge cases: null categories belong to none; a record counts once per id (of unequal deliveries that with the least
categories) and for each of its distinct phenomena; targets without records or of an unknown field are reported
as gaps; empty tables give an empty sample and full gaps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, shuffle_width

#: Patterns held on the driver at most; more are summed on the executors in every iteration.
PATTERNS = 100_000
#: Categories of one plan (bits of a pattern).
CATEGORIES = 60
ITERATIONS, TOLERANCE = 60, 1e-7


class Plan:
    """Targets of one plan: its categories, as written and as compared, with their fields."""

    def __init__(self, name: str, rows: list) -> None:
        if len(rows) > CATEGORIES:
            raise ValueError(f"plan {name} has more than {CATEGORIES} categories")
        self.name = name
        self.written = [r["category"] for r in rows]
        self.compared = [r["category"].strip().lower() for r in rows]
        self.fields = [r["field_name"] for r in rows]
        self.sample = rows[0]["sample_permille"]
        self.share = np.array([r["target_permille"] for r in rows], dtype=np.int64)
        self.least = np.array([r["min_rows"] or 0 for r in rows], dtype=np.int64)

    def mask(self) -> Column:
        """Bits of the categories a record has."""
        out = F.lit(0).cast("long")
        for k, (f, c) in enumerate(zip(self.fields, self.compared)):
            out = out + F.when(F.array_contains(F.col(f"cat_{f}"), c), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
        return out


def plans_of(targets: DataFrame) -> list[Plan]:
    """Plans of a target table; rows without plan, field, category or numbers are left out."""
    names = ["plan_name", "field_name", "category", "sample_permille", "target_permille", "min_rows"]
    rows = targets.select(*names).where("plan_name IS NOT NULL AND field_name IS NOT NULL AND category IS NOT NULL AND sample_permille IS NOT NULL AND target_permille IS NOT NULL").distinct().orderBy(*names).collect()
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["plan_name"], []).append(r)
    return [Plan(n, rs) for n, rs in by.items()]


def tilted(lam: np.ndarray, x: np.ndarray, base: float) -> np.ndarray:
    """Probabilities of patterns with features ``x`` under the dual ``lam``."""
    return np.minimum(1.0, base * np.exp(np.clip(x @ lam, -40, 40)))


def features(masks: np.ndarray, free: list[int], sized: bool) -> np.ndarray:
    """A one for the size of the sample (else for records of no category), then the calibrated memberships."""
    return np.stack([np.ones(len(masks)) if sized else (masks == 0).astype(float), *(((masks >> k) & 1).astype(float) for k in free)], axis=1)


def ceilings(moments: Callable, width: int) -> np.ndarray:
    """What the totals of ``width`` categories can reach: the moments where all multipliers of the dual are at their limit."""
    return np.round(moments(np.append(0.0, np.full(width, 80.0)))[0][1:]).astype(np.int64)


def calibrate(moments: Callable, goal: np.ndarray) -> np.ndarray:
    """Newton iterations on the dual: ``moments(lam)`` gives the expected totals and their derivative."""
    lam = np.zeros(len(goal))
    total, slope = moments(lam)
    scale = np.maximum(1.0, goal)
    for _ in range(ITERATIONS):
        miss = goal - total
        if np.abs(miss / scale).max() < TOLERANCE:
            break
        step = np.linalg.lstsq(slope + 1e-9 * np.trace(slope) * np.eye(len(goal)) + 1e-12 * np.eye(len(goal)), miss, rcond=None)[0]
        step *= min(1.0, 3.0 / max(1e-12, np.abs(step).max()))
        size, better = 1.0, False
        while size > 1e-4:
            t, s = moments(lam + size * step)
            if (((goal - t) / scale) ** 2).sum() < ((miss / scale) ** 2).sum():
                lam, total, slope, better = lam + size * step, t, s, True
                break
            size /= 4
        if not better:
            break
    return lam


def few_patterns(patterns: DataFrame, plan: Plan) -> tuple[np.ndarray, np.ndarray] | None:
    """Masks and counts of a plan's patterns; None if they are more than PATTERNS."""
    few = patterns.where(F.col("plan") == plan.name).select("mask", "n").limit(PATTERNS + 1).collect()
    return None if len(few) > PATTERNS else (np.array([r["mask"] for r in few], dtype=np.int64), np.array([r["n"] for r in few], dtype=float))


def _moments_of(patterns: DataFrame, few: tuple[np.ndarray, np.ndarray] | None, plan: Plan, free: list[int], taken: int, base: float, sized: bool) -> Callable:
    """Moments over the patterns that are not taken whole, ``few`` if they are."""

    def of(masks: np.ndarray, n: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = features(masks, free, sized)
        p = tilted(lam, x, base)
        w = n * np.where(p < 1, p, 0.0)
        return (n * p) @ x, (x * w[:, None]).T @ x

    if few is not None:
        free_of = (few[0] & taken) == 0
        return lambda lam: of(few[0][free_of], few[1][free_of], lam)
    open_ = patterns.where((F.col("plan") == plan.name) & (F.col("mask").bitwiseAND(F.lit(taken).cast("long")) == 0)).select("mask", "n")

    def spread(lam: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                t, s = of(b["mask"].to_numpy(), b["n"].to_numpy(float), lam)
                yield pd.DataFrame({"k": range(len(t) + s.size), "v": [*t, *s.ravel()]})

        sums = {r["k"]: r["v"] for r in open_.mapInPandas(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
        d = len(free) + 1
        flat = np.array([sums.get(k, 0.0) for k in range(d + d * d)])
        return flat[:d], flat[d:].reshape(d, d)

    return spread


def _draw(seed: int, *parts: object) -> float:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, (seed, *parts)))) / 2.0**64


def pivotal(units: Iterator[tuple], seed: int, last: bool) -> Iterator[tuple]:
    """Sequential pivotal method over ``plan, id, probability`` in order of plan.

    Yields ``plan, id, 1.0`` of every chosen unit and ``plan, id, p`` of one undecided unit a plan,
    which is drawn by itself if ``last``.
    """
    held: tuple | None = None

    def leave(h: tuple) -> Iterator[tuple]:
        if not last:
            yield h
        elif _draw(seed, "last", h[0], h[1]) < h[2]:
            yield h[0], h[1], 1.0

    for u in units:
        plan, i, p = u
        if held and held[0] != plan:
            yield from leave(held)
            held = None
        if p >= 1:
            yield plan, i, 1.0
        elif p > 0:
            if held is None:
                held = u
                continue
            a, b = held, u
            s = a[2] + b[2]
            r = _draw(seed, a[0], a[1], b[1])
            if s < 1:
                held = (plan, (a if r < a[2] / s else b)[1], s)
            else:
                win, rest = (a, b) if r < (1 - b[2]) / max(2 - s, 1e-300) else (b, a)
                yield plan, win[1], 1.0
                held = (plan, rest[1], s - 1) if s - 1 > 1e-12 else None
    if held:
        yield from leave(held)


class CalibratedSample:
    """``sample``: ``plan_name, id``; ``report``: one row for each plan and category."""

    def __init__(self, sample: DataFrame, report: DataFrame) -> None:
        self.sample, self.report = sample, report


def _bit_counts(width: int) -> list[Column]:
    """Records of each category of a plan, by the bits of their masks."""
    return [F.sum(F.when(F.expr(f"(mask & {1 << k}L) <> 0"), 1).otherwise(0)).alias(f"b{k}") for k in range(width)]


def topped_up(sample: DataFrame, masks: DataFrame, floors: dict[tuple[str, int], int], seed: int) -> DataFrame:
    """``sample`` with records added, by lowest draw hash, to each plan's categories that are below their floor.

    ``floors`` are no more than what is available, by plan and number of the category.
    """
    width = 1 + max((k for _, k in floors), default=0)
    drawn = {r["plan"]: r for r in sample.join(masks, ["plan", "id"]).groupBy("plan").agg(*_bit_counts(width)).collect()}
    added: dict[str, list[int]] = {}
    for (plan, k), floor in sorted(floors.items()):
        more = added.setdefault(plan, [0] * width)
        need = floor - (drawn[plan][f"b{k}"] if plan in drawn else 0) - more[k]
        if need <= 0:
            continue
        left = masks.where((F.col("plan") == plan) & F.expr(f"(mask & {1 << k}L) <> 0")).join(sample, ["plan", "id"], "left_anti")
        extra = cut(left.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(need).select("plan", "id", "mask"), "topped")
        for j, n in enumerate(extra.agg(*_bit_counts(width)).first()):
            more[j] += n or 0
        sample = sample.unionByName(extra.select("plan", "id"))
    return sample


def calibrated_sample(records: DataFrame, targets: DataFrame, fields: dict[str, Column], id_col: str = "id", seed: int = 11) -> CalibratedSample:
    """Sample of ``records`` for each plan of ``targets``.

    ``fields`` gives for each field name an array of the categories of a record. A target is met if the
    records suffice: ``unmet`` marks categories with fewer records than N * sample * target, exactly,
    or fewer than their floor; ``short`` those with fewer than their floor in the sample; ``conflict`` those whose
    goal could be reached alone, but not beside the others'.
    """
    spark = records.sparkSession
    tidy = lambda a: F.array_distinct(F.transform(F.filter(a, lambda x: x.isNotNull()), lambda x: F.lower(F.trim(x))))
    slim = records.select(F.col(id_col).cast("string").alias("id"), *[F.coalesce(tidy(c), F.array().cast("array<string>")).alias(f"cat_{f}") for f, c in fields.items()])
    plans = plans_of(targets)
    for f in sorted({f for p in plans for f in p.fields} - set(fields)):  # no record has a category of an unknown field
        slim = slim.withColumn(f"cat_{f}", F.array().cast("array<string>"))
    if not plans:
        empty = spark.createDataFrame([], "plan_name string, id string")
        return CalibratedSample(empty, spark.createDataFrame([], "plan_name string, category string, records long, available long, target double, floor long, expected double, sampled long, unmet boolean, short boolean, conflict boolean"))
    per = F.array(*[F.struct(F.lit(p.name).alias("plan"), p.mask().alias("mask")) for p in plans])
    masks = cut(slim.where("id IS NOT NULL").groupBy("id").agg(F.min(per).alias("per")).select("id", F.explode("per").alias("x")).select("id", "x.plan", "x.mask"), "masks")
    patterns = cut(masks.groupBy("plan", "mask").agg(F.count("*").alias("n")), "patterns")
    width = max(len(p.share) for p in plans)
    bit = [F.sum(F.when(F.expr(f"(mask & {1 << k}L) <> 0"), F.col("n")).otherwise(0)).alias(f"b{k}") for k in range(width)]
    sums = {r["plan"]: r for r in patterns.groupBy("plan").agg(F.sum("n").alias("total"), *bit).collect()}

    probs, lines = F.lit(0.0), []
    for p in plans:
        s = sums.get(p.name)
        total = s["total"] if s else 0
        size = total * p.sample / 1000
        base = min(1.0, max(p.sample / 1000, 1e-9))
        few = few_patterns(patterns, p)
        have = ceilings(_moments_of(patterns, few, p, list(range(len(p.share))), 0, base, True), len(p.share))
        exact = [int(total) * int(p.sample) * int(t) for t in p.share]  # in millionths of a record
        unmet = [int(h) * 1_000_000 < e or int(h) < int(m) for h, e, m in zip(have, exact, p.least)]
        goal = np.maximum(np.array(exact) / 1e6, np.minimum(p.least, have))
        whole = [k for k in range(len(have)) if have[k] and goal[k] >= have[k]]
        taken = sum(1 << k for k in whole)
        free = [k for k in range(len(have)) if have[k] and k not in whole]
        expected, lam, sized = np.minimum(goal, have).astype(float), np.zeros(len(free) + 1), True
        if total:
            # What the categories taken whole bring to the others counts against their goals.
            cross = patterns.where((F.col("plan") == p.name) & (F.col("mask").bitwiseAND(F.lit(taken).cast("long")) != 0))
            given = cross.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *bit).first()
            rest = np.array([max(0.0, size - given["total"]), *(max(0.0, goal[k] - (given[f"b{k}"] or 0)) for k in free)])
            moments = _moments_of(patterns, few, p, free, taken, base, sized)
            lam = calibrate(moments, rest)
            got = moments(lam)[0]
            if np.abs((rest - got) / np.maximum(1.0, rest)).max() > 1e-3:
                # Size and shares contradict each other: the shares go first, the rest fills up.
                sized = False
                none = patterns.where((F.col("plan") == p.name) & (F.col("mask") == 0)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
                rest[0] = min(float(none), max(0.0, rest[0] - rest[1:].sum()))
                moments = _moments_of(patterns, few, p, free, taken, base, sized)
                lam = calibrate(moments, rest)
                got = moments(lam)[0]
            for j, k in enumerate(free):
                expected[k] = (given[f"b{k}"] or 0) + got[j + 1]
        inner = F.when(F.lit(sized) | (F.col("mask") == 0), F.lit(float(lam[0]))).otherwise(F.lit(0.0))
        for j, k in enumerate(free):
            inner = inner + F.when(F.expr(f"(mask & {1 << k}L) <> 0"), F.lit(float(lam[j + 1]))).otherwise(F.lit(0.0))
        own = F.when(F.expr(f"(mask & {taken}L) <> 0"), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(base) * F.exp(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), inner)))))
        probs = F.when(F.col("plan") == p.name, own).otherwise(probs)
        lines += [(p.name, p.written[k], k, int(total), int(have[k]), exact[k] / 1e6, int(p.least[k]), float(expected[k]), bool(unmet[k]), bool(not unmet[k] and abs(expected[k] - goal[k]) > max(0.5, 1e-3 * goal[k]))) for k in range(len(have))]

    parts = shuffle_width(spark)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = (u for b in batches for u in zip(b["plan"], b["id"], b["p"]))
        rows: list = []
        for r in pivotal(units, seed, last=False):
            rows.append(r)
            if len(rows) >= 20_000:
                yield pd.DataFrame(rows, columns=["plan", "id", "p"])
                rows = []
        yield pd.DataFrame(rows, columns=["plan", "id", "p"])

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = (u for b in batches for u in zip(b["plan"], b["id"], b["p"]))
        yield pd.DataFrame(list(pivotal(units, seed, last=True)), columns=["plan", "id", "p"])

    kind = "plan string, id string, p double"
    drawn = masks.select("plan", "id", "mask", probs.alias("p")).repartition(parts, "id").sortWithinPartitions("plan", "mask", F.xxhash64("id", F.lit(seed)), "id")
    one = cut(drawn.select("plan", "id", "p").mapInPandas(first, kind), "drawn")
    left = one.where("p < 1").repartition(1).sortWithinPartitions("plan", "id")  # one row a partition and plan
    sample = cut(one.where("p >= 1").select("plan", "id").unionByName(left.mapInPandas(second, kind).select("plan", "id")), "sample")

    sample = topped_up(sample, masks, {(name, k): min(least, have) for name, _, k, _, have, _, least, *_ in lines}, seed)

    got = sample.join(masks, ["plan", "id"]).groupBy("plan").agg(*_bit_counts(width))
    long = got.select("plan", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"b{k}").alias("sampled")) for k in range(width)])).alias("x")).select("plan", "x.k", "x.sampled")
    head = spark.createDataFrame(lines, "plan_name string, category string, k int, records long, available long, target double, floor long, expected double, unmet boolean, conflict boolean")
    report = head.join(long, (head["plan_name"] == long["plan"]) & (head["k"] == long["k"]), "left").select(
        "plan_name", "category", "records", "available", "target", "floor", F.round("expected", 3).alias("expected"), F.coalesce("sampled", F.lit(0)).cast("long").alias("sampled"), "unmet",
        (F.coalesce("sampled", F.lit(0)) < F.col("floor")).alias("short"), "conflict",
    )
    return CalibratedSample(sample.select(F.col("plan").alias("plan_name"), "id"), report)
